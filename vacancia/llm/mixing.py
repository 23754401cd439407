"""Mixing sources to target weights by weighted fair queueing.

Sources get targets from weights: shares of the total, no source above ``most`` times its size, the excess reshared by weight.
Each source's documents are shuffled by a hash of doc_id and queue up to ``most`` times over. A copy's virtual finish time is the words of its source up
to and with it, divided by the source's target. All copies are ordered by finish time over ranges of equal width, and the mix ends
where the running total reaches the budget, the sum of the targets.

Running sums are taken in two steps, within buckets of a key's range and over the buckets' totals, so that a source with a third of all rows
is spread over many tasks. Ties go by hash, doc_id, text, source. Documents without words are never taken. Null texts are empty, null
sources are one source, last in order. Repeated rows queue one after another. Reruns agree. Other columns are kept by :func:`mixed`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import WORD, numbered, unused

PRICES = (5, 2, 1)
BUCKETS = 2048      # ranges per source and of the whole queue


def sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("size", F.regexp_count(text, F.lit(WORD)).cast("long"))


def targets(sized: DataFrame, prices: tuple[int, ...] = PRICES, most: int = 3) -> DataFrame:
    """(source, source_size, target) with one row per source. Rounds end when no source is above its bound."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the distinct sources in order; a source table is small against its documents
    placed = Window.orderBy(F.col("source").asc_nulls_last())
    table = cut_lineage(per.withColumn("price", F.element_at(F.array(*map(F.lit, prices)), ((F.row_number().over(placed) - 1) % len(prices) + 1).cast("int")))
                        .withColumn("bound", most * F.col("source_size")))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("price") * F.lit(level) >= F.col("bound")
        held, n, free = table.agg(F.coalesce(F.sum(F.when(above, F.col("bound"))), F.lit(0)), F.count_if(above),
                                  F.coalesce(F.sum(F.when(~above, F.col("price"))), F.lit(0))).first()
        if n == full or not free:
            break
        level, full = (total - held) / free, n
    target = F.lit(0.0) if level is None else F.least(F.col("price") * F.lit(float(level)), F.col("bound").cast("double"))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def running(rows: DataFrame, keys: list[str], bucket: str, order: list, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row, in order of bucket, then ``order``."""
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = totals.withColumn("_before", F.sum("_sum").over(by.orderBy(bucket)) - F.col("_sum")).drop("_sum")
    renamed = before.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, bucket])], "_before")
    on = None
    for i, c in enumerate([*keys, bucket]):
        one = rows[c].eqNullSafe(F.col(f"_k{i}"))
        on = one if on is None else on & one
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(renamed, on).drop(*[f"_k{i}" for i in range(len(keys) + 1)])
    return joined.withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_before")


def queued(docs: DataFrame, most: int = 3, seed: int = 0, row: str | None = None) -> tuple[DataFrame, float]:
    """Rows (row, doc_id, source, size, source_size, target, key, upto) and the budget; ``row`` names a column of numbers."""
    sized = sizes(docs.select("doc_id", "source", "text", (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))).drop("text")
    sized = cut_lineage(sized)
    goal = targets(sized, most=most)
    # doc_id in text form: the same shuffle in any engine
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = sized.withColumn("key", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"))
    rows = rows.withColumn("bucket", F.floor(F.col("key") / (2 ** 48 // BUCKETS)).cast("int"))
    placed = running(rows, ["source"], "bucket", ["key", F.col("doc_id").asc_nulls_first(), "size", "row"], "size", "upto")
    met = placed.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "bucket")
    return cut_lineage(met), goal.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]


def taken_copies(queue: DataFrame, budget: float, most: int = 3, at_once: int = 50_000) -> Column:
    """How many copies of a row of ``queue`` end before the running total of all copies, by finish time, passes the budget."""
    finish = lambda copy: (F.col("upto") + copy * F.col("source_size")).cast("double") / F.col("target")
    queue = queue.filter("size > 0 and target > 0")
    copies = queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", finish(F.col("copy")))
    lo, hi = 0.0, (copies.agg(F.max("finish")).first()[0] or 0.0) * (1 + 1e-9)
    before, inside = (lambda f: F.lit(False)), (lambda f: F.lit(True))
    while True:
        # ranges of equal width; the one in which the budget runs out is cut again until it is small enough to be sorted at once
        step = (hi - lo) / BUCKETS
        place = lambda f, lo=lo, step=step: F.floor((f - F.lit(lo)) / F.lit(step))
        if step <= 0 or lo + step <= lo:
            break
        found = copies.filter(inside(F.col("finish"))).groupBy(place(F.col("finish")).alias("range")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        total, cut = 0, None
        for r in found.orderBy("range").collect():  # at most BUCKETS + 1 rows
            if total + r["words"] > budget:
                cut = r
                break
            total += r["words"]
        if cut is None:
            return F.when((F.col("size") > 0) & (F.col("target") > 0), most).otherwise(0)
        budget -= total
        before, inside = _narrowed(before, inside, place, cut["range"])
        lo = lo + cut["range"] * step
        hi = lo + step
        if cut["n"] <= at_once:
            break
    tuple_of = lambda f, copy: F.struct(f.alias("f"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"),
                                        F.col("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("row"), copy.alias("copy"))
    order = tuple_of(F.col("finish"), F.col("copy"))
    ranked = copies.filter(inside(F.col("finish"))).select(order.alias("o"), "size").withColumn(
        "total", F.sum("size").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)))
    last = ranked.filter(F.col("total") <= F.lit(budget)).agg(F.max("o").alias("o")).select("o.*").first()

    def taken(copy: int) -> Column:
        f = finish(F.lit(copy))
        if last["f"] is None:
            return before(f)
        bound = F.struct(*[F.lit(v).cast(t).alias(k) for (k, v), t in zip(last.asDict().items(), ("double", "boolean", "string", "long", "long", "long", "int"))])
        return before(f) | (inside(f) & (tuple_of(f, F.lit(copy)) <= bound))
    some = (F.col("size") > 0) & (F.col("target") > 0)
    return F.when(some, sum((taken(c).cast("int") for c in range(1, most)), taken(0).cast("int"))).otherwise(0)


def _narrowed(before, inside, place, cut):
    return (lambda f: before(f) | (inside(f) & (place(f) < cut))), (lambda f: inside(f) & (place(f) == cut))


def mix(docs: DataFrame, most: int = 3, seed: int = 0, row: str | None = None) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken) of every row; ``row`` is its monotonically increasing id, or the named column."""
    queue, budget = queued(docs, most, seed, row)
    copies = taken_copies(queue, budget, most)
    return queue.select("row", "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, most: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns of ``docs``, whatever their names.

    Rows are joined by numbers that do not depend on how the files are split. An empty table gives an empty mix; rows without words are not taken.
    """
    row, times, copy = unused(docs, "row", "times", "copy")
    held = numbered(docs, row)
    plan = mix(held, most, seed, row).filter("taken > 0").select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias(times))
    return held.join(plan, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
