"""Substring dedup by seed and extend on winnowed anchors.

Seeds: of the ``anchor``-word runs of every window of ``size`` words, the one with the least hash (leftmost of equals) is
the window's anchor, so equal windows have equal anchors at equal offsets. Anchors that occur once anywhere are dropped.
Extension: each anchor occurrence owns a stretch of consecutive windows, which reaches from the words before the anchor to
those after it (its context). Contexts that occur twice repeat as a whole. A context that occurs once is extended window by window:
its windows, and those of one occurrence of each other context of the anchor, are compared by two 64-bit hashes. Consecutive
repeating windows merge to maximal repeats. No pair of occurrences is ever formed: anchors, contexts and windows are counted
with a map-side combine, and flags go back by joins that adaptive execution can split.

Nulls and texts under ``size`` words have no windows. Repeated rows are occurrences of each other. Rows without doc_id
count like others. Extra columns are ignored by :func:`repeats` and kept by :func:`dedup`.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import BASES, Rolling, batches, keyed, mix, same, signed, windows, word_hashes

KEY = ["doc_id", "text_key"]


#: Low bits of a window minimum that hold the place, so that of equal hashes the leftmost wins; texts are shorter than that.
PLACE_BITS = 26


def stretches(hashes: np.ndarray, size: int, anchor: int, rolling: Rolling):
    """Anchor position, its hash, and first and last window of the anchor's stretch."""
    grams = windows(rolling, hashes, anchor)
    span = size - anchor + 1
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < span:
        # minima over ``width`` double until two of them cover the span
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    least = (least & place).astype(np.int64)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    return least[first], grams[least[first]], first, last


def seeds(size: int, anchor: int):
    """Every anchor occurrence with its stretch of windows and the hash of all words of the stretch (its context)."""
    def run(iterator):
        rolling = Rolling(BASES[0])
        for batch in batches(iterator):
            lists, counts, keep = [], [], []
            for row, text in enumerate(batch.column("text")):
                words = text.as_py().split()
                if len(words) < size:
                    continue
                hashes = word_hashes(words)
                at, seed, first, last = stretches(hashes, size, anchor, rolling)
                whole = rolling.ranges(rolling.prefix(hashes), first, last + size)
                lists.append((seed, mix(whole + (at - first).astype(np.uint64)), first, last))
                counts.append(len(at))
                keep.append(row)
            if keep:
                out = batch.select(KEY).take(pa.array(np.repeat(keep, counts)))
                seed, context, first, last = (np.concatenate(x) for x in zip(*lists))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(signed(seed)), pa.array(signed(context)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    names=[*KEY, "seed", "context", "first", "last"])
    return run


def extended(size: int):
    """The windows of the stretches asked for, with two hashes each."""
    def run(iterator):
        rolling, second = Rolling(BASES[0]), Rolling(BASES[1])
        for batch in batches(iterator):
            rows, starts, k1, k2 = [], [], [], []
            for row, (text, asked) in enumerate(zip(batch.column("text"), batch.column("stretches"))):
                hashes = word_hashes(text.as_py().split())
                start = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in asked.as_py()])
                rows.append(np.full(len(start), row))
                starts.append(start)
                k1.append(rolling.ranges(rolling.prefix(hashes), start, start + size))
                k2.append(second.ranges(second.prefix(mix(hashes)), start, start + size))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in KEY), pa.array(np.concatenate(starts).astype(np.int32)),
                 pa.array(signed(np.concatenate(k1))), pa.array(signed(np.concatenate(k2)))], names=[*KEY, "start", "k1", "k2"])
    return run


def repeats(docs: DataFrame, size: int = 35, anchor: int = 5) -> DataFrame:
    """(doc_id, text_key, windows): ranges (first, last) of starts of windows of ``size`` words whose words also start elsewhere."""
    texts = keyed(docs).select(*KEY, F.encode("text", "utf-8").alias("text"))
    where = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(seeds(size, anchor), f"doc_id {where}, text_key long, seed long, context long, first int, last int")
    shared = found.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    # one occurrence of each context stands for all of them
    some = cut_lineage(found.join(shared, "seed").withColumn("mark", F.xxhash64(*KEY, "first")))
    contexts = some.groupBy("seed", "context").agg(F.count("*").alias("n"), F.min("mark").alias("stands"))
    several = contexts.groupBy("seed").agg(F.count("*").alias("contexts"))
    met = some.join(contexts.join(several, "seed"), ["seed", "context"])
    # all windows of a context that occurs twice repeat; the windows of single contexts are held against those of each other context
    sure = met.filter("n > 1").select(*KEY, "first", "last")
    asked = (met.filter("contexts > 1 and (n = 1 or mark = stands)").groupBy(*KEY)
             .agg(F.collect_set(F.struct("first", "last")).alias("stretches")))
    # only occurrences that stand for a context bring their windows, so repeated rows do not count a window twice
    rows = same(texts, asked, KEY, "inner").select(*KEY, "text", "stretches").mapInArrow(
        extended(size), f"doc_id {where}, text_key long, start int, k1 long, k2 long")
    again = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2")
    open_ = rows.join(again, ["k1", "k2"], "left_semi").select(*KEY, F.col("start").alias("first"), F.col("start").alias("last"))
    return sure.unionByName(open_).groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("windows"))


def maximal(ranges: list, size: int) -> list[tuple[int, int]]:
    """Word spans (start, end) of ranges of window starts, merged where they follow on each other or overlap."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if spans and first <= spans[-1][1] + 1:
            spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
        else:
            spans.append((first, last))
    return [(first, last + size) for first, last in spans]


def removal(size: int, output):
    """For each text: number of words, number of removed ones, and ``output`` of the kept words."""
    def run(iterator):
        for batch in batches(iterator):
            made = []
            for text, ranges in zip(batch.column("text"), batch.column("windows")):
                words = text.as_py().split()
                spans = maximal([(x["first"], x["last"]) for x in ranges.as_py() or []], size)
                gone = np.zeros(len(words), bool)
                for a, b in spans:
                    gone[a:b] = True
                kept = [w for w, x in zip(words, gone.tolist()) if not x] if spans else words
                made.append((len(words), int(gone.sum()), output(kept, text.as_py(), spans), [{"start": a, "end": b} for a, b in spans]))
            n, removed, out, spans = zip(*made)
            rest = [c for c in batch.schema.names if c not in ("text", "windows")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[*rest, "n_words", "n_removed", "out", "spans"])
    return run


def kept_text(kept: list[bytes], text: bytes, spans) -> str:
    """The text itself where nothing repeats, else the kept words with single spaces."""
    return b" ".join(kept).decode() if spans else text.decode()


def kept_digest(kept: list[bytes], text: bytes, spans) -> str:
    import hashlib
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def removed(docs: DataFrame, size: int = 35, anchor: int = 5, output=kept_text) -> DataFrame:
    """Per row: doc_id, text_key, n_words, n_removed, out (what ``output`` makes of the kept words), spans of maximal repeats in words."""
    texts = keyed(docs).select(*KEY, F.encode("text", "utf-8").alias("text"))
    joined = same(texts, repeats(docs, size, anchor), KEY, "left").select(*KEY, "text", "windows")
    where = texts.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(removal(size, output), f"doc_id {where}, text_key long, n_words long, n_removed long, out string, "
                             "spans array<struct<start: long, end: long>>")


def dedup(docs: DataFrame, size: int = 35, anchor: int = 5) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, keeping its other columns."""
    kept = removed(docs, size, anchor).select(*KEY, F.col("out").alias("_kept")).distinct()
    return (same(docs.withColumn("text_key", F.xxhash64("text")), kept, KEY, "left")
            .withColumn("text", F.when(F.col("text").isNull(), None).otherwise(F.col("_kept"))).select(*docs.columns))
