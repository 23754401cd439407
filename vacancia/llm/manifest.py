"""Merkle manifest of a dataset by butterfly exchange.

Each row is a leaf, each source a tree of its leaves by doc_id, and the sources' roots, by name, are the leaves of one more tree.
A tree is dealt into blocks of ``fanout ** inner`` leaves that follow one another; a block hashes its own levels by itself. Above, the
blocks work round by round: in round r the block b sits at a table with those blocks whose number differs from its own in digit r only (base
``fanout``). All of a table lay down the root of the subtree that they hold, and each takes all of them: its siblings, which go to its
proof, and the hash of all, the root that it holds from then on. So blocks of one subtree hash the same ancestors each for itself, every block
ends with the top of its tree and the upper part of all its proofs, and nothing is sent down. The last subtree of a level may have too
few blocks to fill its seats; they then sit at several tables each. No task sees more than a block or the ``fanout`` rows of a table.

Leaves get their places by a sort over ranges and running counts of the ranges, so that a source with a third of all rows is spread over many tasks.

Nulls in any hashed column are written ``-``. Null doc_ids come first, equal doc_ids go by leaf hash, and repeated rows are leaves of their own. A null
source is a source, first in order. A source of one row has that row's leaf as its root, and a table of one source has the source's root as root.
An empty table gives no rows. Other columns are left out.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import ascii_lower

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The hash of a row; ``text`` in place of its own text."""
    return F.sha2(F.concat(*[field(text if text is not None and c == "text" else F.col(c)) for c in FIELDS]), 256)


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text was changed on its way: A-Z become a-z where 5 divides the CRC of doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf(ascii_lower(F.col("text")))).otherwise(leaf())


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``at``, the place in its tree from 0, and ``total``, the number of leaves of the tree."""
    ranges = cut_lineage(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    # the id holds the range above its 33 low bits and counts rows below
    ranges = ranges.withColumn("part", F.shiftright("at", 33))
    counts = ranges.groupBy("tree", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    counts = counts.select("tree", "part", (F.sum("n").over(whole.orderBy("part")) - F.col("n") - F.col("low")).alias("shift"), F.sum("n").over(whole).alias("total"))
    return ranges.join(counts, ["tree", "part"]).withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift")


def depth(total: Column, fanout: int) -> Column:
    """Levels between the leaves of a tree and its root."""
    powers = [fanout ** k for k in range(62) if fanout ** k < 2 ** 62]
    return sum(((total > F.lit(p)).cast("int") for p in powers[1:]), (total > F.lit(1)).cast("int"))


def above(nodes: Column, fanout: int) -> Column:
    """The parents of a list of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, fanout), ""), 256))


def blocks(rows: DataFrame, order: list[Column], fanout: int, inner: int) -> DataFrame:
    """(tree, block, total, depth, leaves, level0, level1, ...): the leaves of each block in order and the nodes of its own levels."""
    carried = [c for c in rows.columns if c not in ("tree", "leaf")]
    out = (placed(rows, order).withColumn("block", F.floor(F.col("at") / fanout ** inner).cast("long")).groupBy("tree", "block", "total")
           .agg(F.sort_array(F.collect_list(F.struct("at", "leaf", *carried))).alias("leaves"))
           .withColumn("depth", depth(F.col("total"), fanout)).withColumn("level0", F.col("leaves.leaf")))
    for k in range(inner):
        out = out.withColumn(f"level{k + 1}", F.when(F.col("depth") > k, above(F.col(f"level{k}"), fanout)).otherwise(F.col(f"level{k}")))
    return out


def exchange(held: DataFrame, fanout: int, inner: int, most: int) -> DataFrame:
    """(tree, block, top, upper): ``held`` (tree, block, total, depth, root) after as many rounds as a tree of depth ``most`` needs."""
    step = "array<struct<before:string,after:string>>"
    held = held.withColumn("upper", F.array().cast(step))
    for r in range(most - inner):
        width = fanout ** r
        # a tree with fewer levels is done: its blocks keep what they have, each alone at its table
        active = F.col("depth") > inner + r
        n_blocks = F.ceil(F.col("total") / fanout ** inner)
        subtree = F.floor(F.col("block") / width).cast("long")
        seats = F.least(F.lit(width), n_blocks - subtree * width).cast("long")
        own = F.col("block") % width
        sat = (held.withColumn("subtree", subtree).withColumn("own", own)
               .withColumn("seat", F.explode(F.when(active, F.sequence(own, F.lit(width - 1).cast("long"), seats)).otherwise(F.array(own)))))
        table = Window.partitionBy("tree", F.floor(F.col("subtree") / fanout), "seat").orderBy("subtree").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        place = (F.col("subtree") % fanout).cast("int")
        met = sat.withColumn("run", F.collect_list("root").over(table)).filter("seat = own")
        siblings = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("before"),
                            F.array_join(F.slice("run", place + 2, F.lit(fanout)), "").alias("after"))
        held = met.select("tree", "block", "total", "depth", F.when(active, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("root")).alias("root"),
                          F.when(active, F.concat("upper", F.array(siblings).cast(step))).otherwise(F.col("upper")).alias("upper"))
    return held.select("tree", "block", F.col("root").alias("top"), "upper")


def proved(block_rows: DataFrame, upper: DataFrame, fanout: int, inner: int) -> DataFrame:
    """One row per leaf: its own columns, the columns of ``upper`` but for the path, and ``path``, the siblings before and after from level to level."""
    rest = [c for c in upper.columns if c not in ("tree", "block", "upper")]

    def siblings(i: Column, k: int) -> Column:
        node = F.floor(i / fanout ** k).cast("int")
        place, start = node % fanout, node - node % fanout
        nodes = F.col(f"level{k}")
        return F.when(F.col("depth") > k, F.struct(F.array_join(F.slice(nodes, start + 1, place), "").alias("before"),
                                                   F.array_join(F.slice(nodes, start + place + 2, F.lit(fanout - 1) - place), "").alias("after")))
    met = block_rows.join(upper, ["tree", "block"])
    path = lambda i: F.concat(F.filter(F.array(*[siblings(i, k) for k in range(inner)]), lambda x: x.isNotNull()), F.col("upper"))
    each = F.explode(F.transform("leaves", lambda x, i: F.struct(x.alias("x"), path(i).alias("path"))))
    return met.select("tree", *rest, each.alias("e")).select("tree", *rest, "e.x.*", "e.path")


def tree(rows: DataFrame, order: list[Column], fanout: int, inner: int, attach=None) -> tuple[DataFrame, DataFrame]:
    """Leaves with their paths, and the top of each tree. ``attach`` may widen the blocks' (tree, block, top, upper) before leaves take them."""
    block_rows = blocks(rows, order, fanout, inner)
    held = cut_lineage(block_rows.select("tree", "block", "total", "depth", F.col(f"level{inner}")[0].alias("root")))
    most = held.agg(F.max("depth")).first()[0] or 0
    upper = cut_lineage(exchange(held, fanout, inner, most))
    tops = upper.filter("block = 0").select("tree", "top")
    return proved(block_rows, attach(upper, tops) if attach else upper, fanout, inner), tops


def folded(path: Column, start: Column) -> Column:
    """The root to which a leaf and its path lead."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def manifest(docs: DataFrame, fanout: int = 16, inner: int = 3, arrived: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, arrived): a proof for each row; ``arrived`` is a leaf as it was recomputed elsewhere, by default its own."""
    rows = docs.select(field(F.col("source")).alias("tree"), "source", "doc_id", leaf().alias("leaf"), (leaf() if arrived is None else arrived).alias("arrived"))
    names = rows.select("tree", "source").distinct()

    def with_sources(upper: DataFrame, tops: DataFrame) -> DataFrame:
        inner_order = [F.col("source").asc_nulls_first()]
        sources = tops.join(names, "tree").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "source", F.col("top").alias("leaf"))
        ends, _ = tree(sources, inner_order, fanout, inner)
        ends = cut_lineage(ends.select(F.col("name").alias("tree"), F.col("top").alias("root"), F.col("path").alias("last")))
        return upper.join(ends, "tree").select("tree", "block", F.col("top").alias("subroot"), "root", F.concat("upper", "last").alias("upper"))

    out, _ = tree(rows, [F.col("doc_id").asc_nulls_first(), F.col("leaf")], fanout, inner, with_sources)
    return out.select("doc_id", "source", "leaf", "subroot", "root", "path", "arrived")


def verified(docs: DataFrame, fanout: int = 16, inner: int = 3, arrived: Column | None = None) -> DataFrame:
    """:func:`manifest` with proof_sha256 in place of the path, the root recomputed from what arrived, and whether it is the manifest's."""
    got = manifest(docs, fanout, inner, arrived)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    return got.select("doc_id", "source", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("path"), F.col("arrived")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
