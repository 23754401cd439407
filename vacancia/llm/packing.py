"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length. Pieces are dealt by hash to shards of about ``shard`` pieces, and
each shard is packed in decreasing order: a piece goes to the open bin with the least room that holds it; if none does,
the bin size with the least expected cost per token opens. The cost of a size is its length and a fixed ``overhead`` a sequence; the expected fill counts
the room left over only as far as pieces that are still to come can use it. In the end every bin is downsized to
the shortest permitted length that holds its contents.

Null and empty texts have no pieces; they are returned with bin null. Repeated rows and rows without doc_id are packed like others. Shards follow from
the row's place, so ``docs`` must be repeatable, such as a file scan. Other columns are ignored.
"""
from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import WORD

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16


def best_fit(sizes: np.ndarray, lengths=LENGTHS, overhead: int = OVERHEAD):
    """Bin number, offset in the bin and final length of the bin, for each size. Sizes are positive and fit the largest length."""
    order = np.argsort(-sizes, kind="stable")
    # tokens still to come in pieces of at most a given size
    waiting = np.bincount(sizes, weights=sizes, minlength=max(lengths) + 1)
    rooms: list[tuple[int, int]] = []      # (room, bin), sorted
    used: list[int] = []
    which, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        size = int(sizes[i])
        waiting[size] -= size
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            def cost(length: int) -> float:
                left = length - size
                return (length + overhead) / (size + min(left, waiting[: left + 1].sum()))
            room = min((x for x in lengths if x >= size), key=lambda x: (cost(x), x))
            number = len(used)
            used.append(0)
        which[i], offset[i] = number, used[number]
        used[number] += size
        if room > size:
            bisect.insort(rooms, (room - size, number))
    final = np.array([min(x for x in lengths if x >= u) for u in used], np.int64) if used else np.zeros(0, np.int64)
    return which, offset, final[which] if len(which) else which


def packer(lengths, overhead):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], ignore_index=True)
        which, offset, final = best_fit(pdf["n"].to_numpy(np.int64), lengths, overhead)
        return pdf[["doc_id", "piece", "start", "n"]].assign(bin=pdf["shard"].to_numpy() * (1 << 32) + which, offset=offset, capacity=final)
    return run


def pieces(docs: DataFrame, lengths=LENGTHS) -> DataFrame:
    """(row, doc_id, piece, start, n) in words; a document without words is one piece of 0."""
    most = max(lengths)
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words.alias("words"))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / most)))))
    return cut.select("row", "doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.col("words") - F.col("piece") * most, F.lit(most)).alias("n"))


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard: int = 10_000) -> DataFrame:
    """(doc_id, piece, start, n, bin, offset, capacity): where every piece lies."""
    cut = pieces(docs, lengths)
    shards = max(1, -(-docs.count() // shard))
    dealt = cut.filter("n > 0").withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    where = docs.schema["doc_id"].dataType.simpleString()
    put = dealt.groupBy("shard").applyInPandas(packer(lengths, overhead), f"doc_id {where}, piece long, start long, n long, bin long, offset long, capacity long")
    empty = cut.filter("n = 0").select("doc_id", "piece", "start", "n", *[F.lit(None).cast("long").alias(c) for c in ("bin", "offset", "capacity")])
    return put.unionByName(empty)
