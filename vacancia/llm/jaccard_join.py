"""Exact Jaccard join of documents on word shingles, as a metric-space join.

Jaccard distance is a metric, but almost all documents lie at distance 1 from any pivot document, so regions around a
bounded number of pivots would hold everything. The space is therefore cut twice.

1. Strips, from ``STRIPS_FROM`` percent on. The range of the hash is cut into more strips than two linked sets of a class of sizes can differ in elements, so some
   strips hold the same elements of both, and a cell is all that a set has in a strip. Single shingles that many texts have in common tie nothing, so that the groups of
   tied sets stay those of near copies, however many sets there are; by single shingles, groups of other sets grow together as the input grows.
   Below that, and on request (``sparing``), cells are single shingles. Shingles have one total order for the whole table: by region of the hash, then by how many sets placed a shingle, counted
   exactly, then by hash. Two linked sets share an element among the first ``n - ceil(percent * n / 100) + 1`` of each, whatever
   the order. A set places only the elements of the first regions that hold so many (``region_ends``), so a part of all shingles is
   shuffled and counted, and of these, shingles that one set alone placed leave at once. What is shuffled is in proportion to the input. On request
   (``sparing``) a table of counts of fixed size (``SLOT_BITS``) spares many of those that are alone the shuffle; it fills up from some ten million
   of them on, so that a large input gains nothing. Sets of a cell tie to the least of them, cell by cell and
   apart where sizes leave a gap that no link bridges. Sets that are tied, directly or through others, form a group, which is cut where the sizes of its sets leave a gap that no
   link bridges; linked documents are always in one group.
2. Pivots. Within a group distances spread, and the join is one of Voronoi regions: documents go to their nearest pivot
   and, if they lie within twice the radius of a farther one, into that region as well (triangle inequality).
   Members within the radius of a pivot are linked to it and need no comparison with each other. Regions join recursively until
   they are small enough to be compared at once; regions that pivots no longer divide are compared block by block.

Groups above ``at_once`` documents, or a thousand times as many elements, are spread over tasks by salted chunks. Classes, not pairs, are returned; no pair is lost
and none is approximated (64-bit shingle hashes). Nulls and texts without words have an empty set and link with nothing.
Rows without doc_id take no part. Rows that share a doc_id share a class. Equal sets are collapsed before any comparison.
"""
from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import BASES, Rolling, batches, mix, signed, windows, word_hashes

SLOT_BITS = 24          # slots of the table of counts; 16 MB as levels, whatever the input
CHUNK_BITS = 16         # slots that are merged together
STRIPS_FROM = 90        # percent from which cells are strips; below, a strip holds too few elements
FILTER_BITS = 1 << 24   # bits of the filter that spares documents outside all groups a shuffle; 2 MB, whatever the input


def shingles(text: bytes, size: int, rolling: Rolling) -> np.ndarray:
    """Distinct shingle hashes in ascending order; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(windows(rolling, hashes, min(size, len(words))))


def slots(found: np.ndarray) -> np.ndarray:
    return (mix(found) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix(n, percent: int):
    """How many elements of a set of ``n``, the first in any one order, meet those of every linked set."""
    return n + percent * n // -100 + 1


def region_bounds(percent: int) -> np.ndarray:
    """Upper bounds of the regions of the hash, each about twice as wide as the part of a set that is needed, three tenths at most."""
    width = max(min(2 * (100 - percent), 30), 2)
    return np.array([(at << 64) // 100 for at in range(width, 100, width)], np.uint64)


def region_ends(found: np.ndarray, percent: int, bounds: np.ndarray) -> np.ndarray:
    """Where the first regions of a set (ascending) end, up to the one that completes its prefix."""
    ends = np.r_[np.searchsorted(found, bounds), len(found)]
    return ends[: np.searchsorted(ends, prefix(len(found), percent)) + 1]


def cells(found: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """The elements of a set (ascending) by which it can meet linked sets: those of its first regions, in order of level and hash."""
    held = found[: region_ends(found, percent, region_bounds(percent))[-1]]
    return held[np.argsort(levels[slots(held)], kind="stable")]


def tally(field: np.ndarray):
    """Non-zero slots as (chunk, payload): steps between slots and their counts."""
    full = np.flatnonzero(field)
    bounds = np.searchsorted(full, np.arange(0, len(field) + 1, 1 << CHUNK_BITS))
    for chunk, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if lo < hi:
            steps = np.diff(full[lo:hi] - (chunk << CHUNK_BITS), prepend=0).astype(np.uint16)
            yield chunk, zlib.compress(steps.tobytes() + field[full[lo:hi]].tobytes(), 1)


def outlines(size: int):
    """One row per document: the size of its set and two hashes of it."""
    def run(iterator):
        rolling = Rolling(BASES[0])
        for batch in batches(iterator):
            rows = []
            for text in batch.column("text"):
                found = shingles(text.as_py(), size, rolling)
                rows.append((len(found), *((np.sum(mix(found), dtype=np.uint64), np.sum(mix(found ^ np.uint64(BASES[1])), dtype=np.uint64)) if len(found) else (0, 0))))
            n, a, b = (np.array(x, np.uint64) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(signed(a)), pa.array(signed(b))], names=["doc_id", "n_shingles", "s1", "s2"])
    return run


def tallies(size: int, percent: int):
    """For each task its tally, by slot, of the shingles that documents place."""
    def run(iterator):
        rolling, field, bounds = Rolling(BASES[0]), np.zeros(1 << SLOT_BITS, np.uint32), region_bounds(percent)
        for batch in batches(iterator):
            for text in batch.column("text"):
                found = shingles(text.as_py(), size, rolling)
                if len(found):
                    np.add.at(field, slots(found[: region_ends(found, percent, bounds)[-1]]), np.uint32(1))
        for chunk, payload in tally(field):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([payload], pa.binary())], names=["chunk", "payload"])
    return run


def merged(iterator):
    """Tallies of the chunks of a partition, added up; counts become levels, four to a doubling."""
    total: dict[int, np.ndarray] = {}
    for batch in iterator:
        for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist()):
            raw = zlib.decompress(payload)
            n = len(raw) // 6
            at = np.cumsum(np.frombuffer(raw, np.uint16, n).astype(np.int64))
            total.setdefault(chunk, np.zeros(1 << CHUNK_BITS, np.uint64))[at] += np.frombuffer(raw, np.uint32, n, 2 * n)
    for chunk, counts in total.items():
        level = np.floor(4 * np.log2(np.maximum(counts, 1).astype(np.float64))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["chunk", "payload"])


def slot_levels(rows: DataFrame) -> np.ndarray:
    """The level of each slot; at most ``1 << SLOT_BITS`` bytes reach the driver."""
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    for row in rows.repartition("chunk").mapInArrow(merged, "chunk int, payload binary").collect():
        levels[row["chunk"] << CHUNK_BITS: (row["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(zlib.decompress(row["payload"]), np.uint8)
    return levels


def placed(size: int, percent: int, levels=None):
    """(cell, s1, extent) of the elements that a set places, with ``levels`` but those it knows to be alone; ``extent`` is the set's size and where
    the element's region ends in it. A task places equal sets once as far as it remembers them."""
    def run(iterator):
        rolling, table, bounds, known = Rolling(BASES[0]), levels and levels.value, region_bounds(percent), set()
        for batch in batches(iterator):
            made = []
            for text in batch.column("text"):
                found = shingles(text.as_py(), size, rolling)
                s1 = np.sum(mix(found), dtype=np.uint64)
                if not len(found) or int(s1) in known:
                    continue
                if len(known) >= 1 << 18:
                    known.clear()
                known.add(int(s1))
                ends = region_ends(found, percent, bounds)
                at = np.arange(ends[-1]) if table is None else np.flatnonzero(table[slots(found[: ends[-1]])])
                made.append((found[at], np.full(len(at), s1), (len(found) << 32) + ends[np.searchsorted(ends, at, "right")]))
            if made:
                cell, s1, extent = (np.concatenate(x) for x in zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(signed(cell)), pa.array(signed(s1)), pa.array(extent.astype(np.int64))], names=["cell", "s1", "extent"])
    return run


def ties(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): ties between the sets, named by s1, that placed ``rows`` (cell, s1, extent). Linked sets are tied, directly or through others. A tie may come repeatedly.

    Elements alone in their cell come first in their region, and only their number is needed: what the region holds less what is shared of it.
    """
    c = F.col
    mates = Window.partitionBy("cell")
    shared = (rows.select("*", F.count("*").over(mates).alias("f"), F.min("s1").over(mates).alias("low"), F.max("s1").over(mates).alias("high"))
              .filter("low < high").select("cell", "s1", "extent", "f"))
    region = Window.partitionBy("s1", "extent")
    ranked = shared.withColumn("k", F.dense_rank().over(region.orderBy("f", "cell"))).withColumn("m", F.max("k").over(region))
    n, end = F.shiftright("extent", 32), c("extent").bitwiseAND(F.lit(0xFFFFFFFF))
    first = n + F.floor(F.lit(-percent) * n / 100) + 1
    kept = ranked.filter(end - c("m") + c("k") <= first).select("cell", "s1", n.alias("size"))
    ordered = Window.partitionBy("cell").orderBy("size")
    gap = (100 * F.lag("size").over(ordered) < percent * c("size")).cast("int")
    runs = kept.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("run", F.sum("gap").over(ordered))
    return runs.select(F.min("s1").over(Window.partitionBy("cell", "run")).alias("a"), c("s1").alias("b")).filter("a <> b")


class Strips:
    """How finely sets are cut: classes of sizes, each a third wider than the one before, and per class a number of strips.

    Linked sets of ``a`` and ``b`` elements differ in ``(a + b) * (100 - percent) / (100 + percent)`` at most, ``apart`` in the class of the larger one, and each of these touches one strip. Of
    ``apart + spare`` strips at least ``spare`` are alike. They share a cell, unless all of these are empty in both: a set with ``spare`` empty strips, one
    in 100,000 at most, places its empty strips too. A set is placed in its own class and in those of larger sets that it may be linked to.
    """

    def __init__(self, percent: int):
        self.percent, self.lows, self.cuts, low = percent, [], [], 1
        while low < 1 << 31:
            high = max(low + 1, low * 4 // 3)
            apart = 2 * (high - 1) * (100 - percent) // (100 + percent)
            spare = next((n for n in range(1, 200) if self._empty(apart + n, n, percent * low / 100) < 1e-5), 200)
            self.lows.append(low)
            self.cuts.append((apart, spare))
            low = high

    @staticmethod
    def _empty(strips: int, n: int, size: float) -> float:
        """At most how likely a set of ``size`` elements leaves ``n`` of its strips empty."""
        ways = math.lgamma(strips + 1) - math.lgamma(n + 1) - math.lgamma(strips - n + 1)
        return math.exp(min(ways + size * math.log1p(-n / strips), 0)) if n < strips else 0.0

    def cells(self, found: np.ndarray) -> np.ndarray:
        """The cells of a set (ascending). In a class where linked sets are equal there are none."""
        made, mixed = [], mix(found ^ np.uint64(BASES[0]))
        for at in range(bisect.bisect_right(self.lows, len(found)) - 1, len(self.lows)):
            apart, spare = self.cuts[at]
            if 100 * len(found) < self.percent * self.lows[at]:
                break
            if not apart:
                continue
            strip = ((found >> np.uint64(32)) * np.uint64(apart + spare)) >> np.uint64(32)
            first = np.flatnonzero(np.r_[True, strip[1:] != strip[:-1]])
            name = np.uint64(at << 33)
            made.append(mix(np.add.reduceat(mixed, first) + mix(name + strip[first])))
            if apart + spare - len(first) >= spare:
                made.append(mix(name + np.setdiff1d(np.arange(apart + spare, dtype=np.uint64), strip[first]) + np.uint64(1 << 32)))
        return np.concatenate(made) if made else np.zeros(0, np.uint64)


def stripped(size: int, percent: int):
    """(cell, s1) of the strips of each set. A task places equal sets once as far as it remembers them."""
    def run(iterator):
        rolling, strips, known = Rolling(BASES[0]), Strips(percent), set()
        for batch in batches(iterator):
            made = []
            for text in batch.column("text"):
                found = shingles(text.as_py(), size, rolling)
                s1 = np.sum(mix(found), dtype=np.uint64)
                if not len(found) or int(s1) in known:
                    continue
                if len(known) >= 1 << 18:
                    known.clear()
                known.add(int(s1))
                cell = strips.cells(found)
                made.append((cell, np.full(len(cell), s1)))
            if made:
                cell, s1 = (np.concatenate(x) for x in zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(signed(cell)), pa.array(signed(s1))], names=["cell", "s1"])
    return run


def strip_ties(rows: DataFrame) -> DataFrame:
    """(a, b): the sets of each cell of ``rows`` (cell, s1) tied to the least of them. A tie may come repeatedly."""
    return rows.select(F.min("s1").over(Window.partitionBy("cell")).alias("a"), F.col("s1").alias("b")).filter("a <> b")


def filtered_sets(size: int, bits):
    """(doc_id, s1, set) of the documents whose bit is set; false positives go in the join that follows."""
    def run(iterator):
        rolling, field = Rolling(BASES[0]), bits.value
        for batch in batches(iterator):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            slot = mix(ids.view(np.uint64)) % np.uint64(FILTER_BITS)
            hit = np.flatnonzero(field[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            if len(hit):
                sets = [shingles(batch.column("text")[int(i)].as_py(), size, rolling) for i in hit]
                s1 = np.array([np.sum(mix(x), dtype=np.uint64) for x in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(signed(s1)), pa.array([x.tobytes() for x in sets], pa.binary())],
                                                 names=["doc_id", "s1", "elements"])
    return run


# ---- joining inside a group ---------------------------------------------------------------------

class Members:
    """Sets of some documents of a group, with exact overlaps by counting along posting lists."""

    def __init__(self, elements: list[bytes]):
        sets = [np.frombuffer(x, np.uint64) for x in elements]
        self.size = np.array([len(x) for x in sets], np.int64)
        self.values = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(self.values, kind="stable")
        self.sorted, self.posted = self.values[order], self.owner[order]
        self.sets = sets

    def overlaps(self, elements: np.ndarray) -> np.ndarray:
        """Intersection size of ``elements`` with every member."""
        lo, hi = np.searchsorted(self.sorted, elements, "left"), np.searchsorted(self.sorted, elements, "right")
        total = int((hi - lo).sum())
        if not total:
            return np.zeros(len(self.size), np.int64)
        at = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(total)
        return np.bincount(self.posted[at], minlength=len(self.size))


class Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def linked(inter: np.ndarray, a, b, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def region(members: Members, who: np.ndarray, forest: Forest, percent: int, small: int = 48, pivots: int = 12) -> None:
    """Join the members ``who``: compare all if few, else divide them by pivots; the distances to pivots rule out pairs."""
    radius = 1 - percent / 100
    part = Members([members.sets[i].tobytes() for i in who]) if len(who) < len(members.size) else members
    n = len(who)

    def compare(i: int, among: np.ndarray) -> None:
        inter = part.overlaps(part.sets[i])
        for j in among[linked(inter[among], part.size[i], part.size[among], percent)].tolist():
            forest.join(int(who[i]), int(who[j]))

    if n <= small:
        for i in range(n - 1):
            compare(i, np.arange(i + 1, n))
        return
    chosen = np.unique(np.linspace(0, n - 1, pivots).astype(np.int64))
    inter = np.array([part.overlaps(part.sets[p]) for p in chosen])
    distance = 1 - inter / (part.size[None, :] + part.size[chosen][:, None] - inter)
    for row, p in enumerate(chosen.tolist()):
        for j in np.flatnonzero(linked(inter[row], part.size[p], part.size, percent)).tolist():
            forest.join(int(who[p]), int(who[j]))
    home = distance.min(axis=0)
    regions = [np.flatnonzero(distance[row] <= home + 2 * radius + 1e-9) for row in range(len(chosen))]
    owns = distance.argmin(axis=0)
    if sum(len(x) for x in regions) <= 0.8 * n * math.sqrt(len(chosen)) and max(map(len, regions)) <= 0.7 * n:
        for row, inside in enumerate(regions):
            if (owns[inside] == row).any():
                region(members, who[inside], forest, percent, small, pivots)
        return
    # pivots do not divide this region: each member against those that the triangle inequality and the classes leave
    roots = np.array([forest.root(int(x)) for x in who])
    for i in range(n - 1):
        near = (np.abs(distance[:, i + 1:] - distance[:, i, None]) <= radius + 1e-9).all(axis=0) & (roots[i + 1:] != roots[i])
        among = np.flatnonzero(near) + i + 1
        if len(among):
            before = forest.root(int(who[i]))
            compare(i, among)
            if forest.root(int(who[i])) != before or len(among) > n // 4:
                roots = np.array([forest.root(int(x)) for x in who])


def at_once_join(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        members, forest = Members(pdf["elements"].tolist()), Forest(len(pdf))
        region(members, np.arange(len(pdf)), forest, percent)
        ids = pdf["rep"].to_numpy()
        return pd.DataFrame({"rep": ids, "other": ids[[forest.root(i) for i in range(len(ids))]]})
    return run


def chunk_join(percent: int):
    """Links between the members of a chunk and some probes; one link for each member and class of probes."""
    def run(members_pdf: pd.DataFrame, probes_pdf: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(members_pdf) and len(probes_pdf):
            members, ids = Members(members_pdf["elements"].tolist()), members_pdf["rep"].to_numpy()
            forest = Forest(len(ids) + len(probes_pdf))
            for k, (probe, elements) in enumerate(zip(probes_pdf["probe"].tolist(), probes_pdf["probe_elements"])):
                own = np.frombuffer(elements, np.uint64)
                inter = members.overlaps(own)
                for j in np.flatnonzero(linked(inter, len(own), members.size, percent)).tolist():
                    if forest.join(len(ids) + k, j):
                        made.append((int(ids[j]), probe))
        return pd.DataFrame(made, columns=["rep", "other"]).astype("int64")
    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): least node of each component of the edges (a, b), by alternating large and small stars.

    Raises if ``rounds`` do not suffice; they are logarithmic in the longest path. ``open`` marks what a round has changed; a round that changes
    nothing is the last. A node may have any number of higher neighbours: they meet its least one in a join.
    """
    c = F.col

    def both(first, second):
        return F.explode(F.array(F.struct(*first), F.struct(*second))).alias("e")

    pairs = cut_lineage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct().withColumn("open", F.lit(True)))
    for _ in range(rounds):
        if pairs.filter("open").isEmpty():
            stars = pairs.select(c("hi").alias("node"), c("lo").alias("root"))
            return stars.unionByName(stars.select(c("root").alias("node"), "root").distinct())
        near = pairs.select(both((c("hi").alias("node"), c("lo").alias("near")), (c("lo").alias("node"), c("hi").alias("near")))).select("e.*")
        least = near.groupBy("node").agg(F.min("near").alias("m"))
        large = pairs.join(least, c("lo") == c("node")).select("hi", F.least("lo", "m").alias("to"), (c("m") < c("lo")).alias("moved"))
        own = Window.partitionBy("hi")
        small = large.select("hi", "to", F.min("to").over(own).alias("m"), F.max("to").over(own).alias("most"), F.max("moved").over(own).alias("moved"))
        changed = (c("moved") | (c("m") < c("most"))).alias("open")
        made = small.select(both((c("hi"), c("m").alias("lo"), changed), (c("to").alias("hi"), c("m").alias("lo"), changed))).select("e.*").filter("hi > lo")
        pairs = cut_lineage(made.groupBy("hi", "lo").agg(F.max("open").alias("open")))
    raise RuntimeError("components are not settled")


def classes(docs: DataFrame, size: int = 3, percent: int = 90, at_once: int = 4000, pivots: int = 32, chunk: int = 2000, sparing: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    texts = given.filter("doc_id is not null")
    outline = cut_lineage(given.mapInArrow(outlines(size), "doc_id long, n_shingles long, s1 long, s2 long"))
    levels = spark.sparkContext.broadcast(slot_levels(texts.mapInArrow(tallies(size, percent), "chunk int, payload binary"))) if sparing else None
    own = outline.filter("doc_id is not null and n_shingles > 0")
    # equal sets are one node, named by its least doc_id; rows that share a doc_id but not the text are told apart by s1
    reps = own.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"))
    if percent < STRIPS_FROM or sparing:
        pairs = ties(texts.mapInArrow(placed(size, percent, levels), "cell long, s1 long, extent long"), percent)
    else:
        pairs = strip_ties(texts.mapInArrow(stripped(size, percent), "cell long, s1 long"))
    tied = components(pairs).select(F.col("node").alias("s1"), F.col("root").alias("grp"))
    groups = cut_lineage(by_size(cut_lineage(tied.join(reps, "s1").select("rep", "s1", "size", "grp")), percent))

    def members(some: DataFrame) -> DataFrame:
        """The sets of ``some`` rows of groups. They move twice, to their row and to their group; a repeated row's sets are one."""
        bits = spark.sparkContext.broadcast(member_bits(some))
        sets = texts.mapInArrow(filtered_sets(size, bits), "doc_id long, s1 long, elements binary").withColumnRenamed("doc_id", "rep")
        return sets.groupBy("rep", "s1").agg(F.first("elements").alias("elements")).join(some.select("rep", "s1", "grp", "n"), ["rep", "s1"])

    few, many = groups.filter(F.col("n") <= at_once), groups.filter(F.col("n") > at_once)
    links = members(few).groupBy("grp").applyInPandas(at_once_join(percent), "rep long, other long")
    if not many.isEmpty():
        links = links.unionByName(spread_links(cut_lineage(members(many)), percent, pivots, chunk))
    same_doc = own.join(reps.drop("size"), ["s1", "s2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    settled = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")).unionByName(same_doc))
    least = settled.select(F.col("node").alias("doc_id"), F.col("root").alias("least"))
    return outline.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def by_size(groups: DataFrame, percent: int) -> DataFrame:
    """Groups (rep, s1, size, grp) cut where sizes leave a gap that no link can bridge; those with one member left go.

    Linked sets differ in size by at most 100 / ``percent``. ``n`` is the members of a group, or a thousandth of their elements if that is more.
    """
    sizes = groups.groupBy("grp", "size").agg(F.count("*").alias("own"), F.min("rep").alias("rep"))
    ordered, part = Window.partitionBy("grp").orderBy("size"), Window.partitionBy("grp", "part")
    gap = (100 * F.lag("size").over(ordered) < percent * F.col("size")).cast("int")
    steps = sizes.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("part", F.sum("gap").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    counted = steps.select("grp", "size", F.min("rep").over(part).alias("least"), F.sum("own").over(part).alias("members"), F.sum(F.col("own") * F.col("size")).over(part).alias("elements"))
    n = F.greatest(F.col("members"), F.col("elements") / 1000).cast("long")
    return groups.join(counted.filter("members > 1"), ["grp", "size"]).select("rep", "s1", F.col("least").alias("grp"), n.alias("n"))


def member_bits(groups: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits over the members' ids, of the same size for any input."""
    def slots(iterator):
        for batch in iterator:
            ids = np.array(batch.column("rep").to_pylist(), np.int64)
            slot = mix(ids.view(np.uint64)) % np.uint64(FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(signed(np.uint64(1) << (slot & np.uint64(63))))], names=["w", "b"])
    field = np.zeros(FILTER_BITS // 64, np.uint64)
    rows = groups.select("rep").mapInArrow(slots, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    field[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return field.view(np.uint8)


def against(members: DataFrame, probes: DataFrame, percent: int, chunk: int, block: int = 256) -> DataFrame:
    """Exact links of members with probes of the same group: chunks of members meet blocks of probes."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("np") / block)).cast("long")
    sized = probes.groupBy("grp").agg(F.count("*").alias("np"))
    left = (members.join(sized, "grp").withColumn("c", F.pmod(F.xxhash64("rep"), chunks))
            .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select("grp", "c", "b", "rep", "elements"))
    right = (probes.join(sized, "grp").withColumn("b", F.pmod(F.xxhash64("rep", F.lit(1)), blocks))
             .withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).select("grp", "c", "b", "rep", "elements")
             .toDF("p_grp", "p_c", "p_b", "probe", "probe_elements"))  # both sides come from one table: the names keep them apart
    return left.groupBy("grp", "c", "b").cogroup(right.groupBy("p_grp", "p_c", "p_b")).applyInPandas(chunk_join(percent), "rep long, other long")


def spread_links(large: DataFrame, percent: int, pivots: int, chunk: int) -> DataFrame:
    """Links of groups that are too large for one task: all members against ``pivots`` per group, then those that no pivot
    holds against all members."""
    # about ``pivots`` members of each group, by hash: no ranking of a group
    chosen = large.filter(F.pmod(F.xxhash64("rep", F.lit(2)), F.col("n")) < pivots)
    first = cut_lineage(against(large, chosen, percent, chunk))
    held = first.select("rep").unionByName(first.select(F.col("other").alias("rep"))).distinct()
    rest = large.join(held, "rep", "left_anti").select(*large.columns)
    # two pivots' classes may touch through members only: each pivot's members beyond it are probed as well
    touching = components(first.select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    by_class = large.join(touching, "rep").groupBy("grp", "root").agg(F.count("*").alias("k"))
    main = by_class.groupBy("grp").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    minor = large.join(touching, "rep").join(main, "grp").filter("root <> main").select(*large.columns)
    return first.unionByName(against(large, rest.unionByName(minor), percent, chunk))
