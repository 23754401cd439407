"""Exact top-k by inner product: columnar branch and bound.

Candidates are packed into blocks in vertical layout (one array per dimension), queries into smaller blocks. For a query, scores grow by
blocks of dimensions; the norm of the dimensions that remain, of query and candidate, bounds what is still to come
(Cauchy-Schwarz). Candidates whose upper bound is below the best k-th lower bound leave, and the survivors are compacted before
the next block. A first pass over one candidate block gives every query a k-th score to start from.

Components become floor(256 x). Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without vec_id. A query meets vectors of its own length only. Rows with the query's own vec_id are not its candidates; repeated rows
are candidates one by one, and repeated query rows answer one by one. Ties go to the smaller vec_id. Scores beyond 64 bits saturate.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

DIMENSIONS = 16      # dimensions a step
SAFE = 2.0 ** 62


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): quantised vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # floor() gives a long; beyond 2**44 a float times 256 is whole already
    scaled = F.transform(x, lambda v: F.when(F.abs(v) < 2.0 ** 44, F.floor(v * 256.0).cast("double")).otherwise(v * 256.0))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), scaled.alias("v")))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(dim, block, ids, m): blocks of about ``size`` vectors; m holds doubles, dimension after dimension."""
    n = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = rows.join(n, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        m = np.stack(pdf["v"].to_numpy()).T
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]],
                             "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "m": [np.ascontiguousarray(m).tobytes()]})
    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block long, ids binary, m binary")


def block_top(q: np.ndarray, own: int, ids: np.ndarray, m: np.ndarray, rest: np.ndarray, k: int, floor_: float):
    """The k best (score, vec_id) of one block for query ``q`` that may reach ``floor_``; ``rest[j]`` are norms from step j on."""
    alive = np.flatnonzero(ids != own)
    exact = np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * len(q) < SAFE
    kind = np.int64 if exact else object
    total = np.zeros(len(alive), kind)
    qi = q.astype(np.int64) if exact else np.array([int(x) for x in q], object)
    steps = range(0, len(q), DIMENSIONS)
    for j, at in enumerate(steps):
        part = m[at: at + DIMENSIONS, alive]
        part = part.astype(np.int64) if exact else np.vectorize(int, otypes=[object])(part)
        total = total + qi[at: at + DIMENSIONS] @ part
        if at + DIMENSIONS >= len(q) or len(alive) <= k:
            continue
        bound = np.linalg.norm(q[at + DIMENSIONS:]) * rest[j + 1][alive] * (1 + 1e-9) + 1.0
        about = total.astype(float)
        bound += np.abs(about) * 1e-15
        low = about - bound
        floor_ = max(floor_, np.partition(low, len(low) - k)[len(low) - k])
        stay = about + bound >= floor_
        if not stay.all():
            alive, total = alive[stay], total[stay]
    if not exact:
        total = np.array([max(-2**63, min(2**63 - 1, x)) for x in total], np.int64)
    order = np.lexsort((ids[alive], ~total))[:k]  # ~x falls as x rises, without overflow
    return total[order], ids[alive][order]


def searched(k: int):
    def run(iterator):
        for pdf in iterator:
            for row in pdf.itertuples(index=False):
                qs, ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
                q = np.frombuffer(row.q_m, np.float64).reshape(row.dim, -1)
                m = np.frombuffer(row.m, np.float64).reshape(row.dim, -1)
                rest = [np.sqrt((m[at:] ** 2).sum(axis=0)) for at in range(0, row.dim, DIMENSIONS)]
                floors = np.frombuffer(row.floors, np.float64) if row.floors is not None else np.full(len(qs), -np.inf)
                out = []
                for i, own in enumerate(qs.tolist()):
                    score, found = block_top(q[:, i], own, ids, m, rest, k, floors[i] if i < len(floors) else -np.inf)
                    out += [(row.dim, row.q_block, i, own, int(s), int(c)) for s, c in zip(score, found)]
                yield pd.DataFrame(out, columns=["dim", "q_block", "q_row", "query_id", "score", "vec_id"])
    return run


FOUND = "dim int, q_block long, q_row int, query_id long, score long, vec_id long"


def top(vectors: DataFrame, is_query, k: int = 5, block: int = 4096, query_block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds, against all rows."""
    rows = usable(vectors)
    candidates = cut_lineage(packed(rows, block))
    asked = cut_lineage(packed(rows.filter(is_query), query_block).select(
        "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m")))
    # every block of queries meets every block of candidates of its length: the stated search, in blocks
    number = rows.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    spread = asked.join(number, "dim")

    def meet(pairs: DataFrame) -> DataFrame:
        cells = pairs.join(candidates, ["dim", "block"])
        width = max(1, cells.sparkSession.sparkContext.defaultParallelism)
        return cells.repartition(4 * width, "dim", "q_block", "block").mapInPandas(searched(k), FOUND)

    first = meet(spread.withColumn("block", F.lit(0).cast("long")).drop("blocks").withColumn("floors", F.lit(None).cast("binary")))
    kth = first.groupBy("dim", "q_block", "q_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    floors = kth.groupBy("dim", "q_block").applyInPandas(floor_rows, "dim int, q_block long, floors binary")
    found = meet(spread.join(floors, ["dim", "q_block"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks"))
    order = Window.partitionBy("dim", "q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def floor_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Known k-th scores of a query block as an array; a query without one starts from nothing."""
    floors = np.full(int(pdf["q_row"].max()) + 1, -np.inf)
    known = pdf[pdf["kth"].notna()]
    floors[known["q_row"].to_numpy()] = np.nextafter(known["kth"].to_numpy(float), -np.inf)
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "q_block": [pdf["q_block"].iloc[0]], "floors": [floors.tobytes()]})
