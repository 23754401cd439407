"""Byte-wise dedup by bucket-pointer refinement of sampled suffixes.

Removed is every byte covered by a run of ``size`` bytes that also starts earlier: in a smaller doc_id, or earlier in the same document.

Identifiers of depth ``GRAM`` name the runs of that many bytes. The sampled suffixes start at the least identifier of each window of ``size`` bytes (leftmost
of equals), so equal windows sample the same suffix at the same distance; a suffix owns a stretch of windows that follow one another.
The identifier is its initial bucket. Identifiers of twice the depth come from the identifiers at a position and at a later offset, and are used
again for the next depth until they name whole windows; those of a stretch's first and last window, which overlap, name all its bytes. A bucket is refined
by sorting on these: suffixes that agree repeat each other as a whole, and of each finer bucket only the earliest suffix is left. Where a bucket has several
finer ones, the bytes of what is left meet again by bucket, and their windows are sorted by identifiers (two of 64 bits): all but the earliest of equal ones repeat.

A slice of some megabytes is sorted by itself before anything is shuffled. Of suffixes that agree, one leaves the slice. Buckets of more than ``WIDE`` finer ones in a slice, or rows
among slices, are wide: not the bytes of their suffixes meet but single windows, spread by identifier, of equal ones one per slice. So a bucket or window that a third of all rows
share brings few rows per slice to a task. What a slice knows travels under a key of its own. Long texts are worked in pieces of ``PIECE`` windows; a stretch cut there only asks for its windows.

Nulls are empty. Null doc_ids come first. Rows with one doc_id and different texts go by a hash of the text; rows equal in both are one
document and share its result. Texts under ``size`` bytes keep all. Matches never cross documents. Extra columns are ignored by :func:`removed`
and kept by :func:`dedup`. An empty table gives no rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import batches, keyed, mix, same, signed

KEY = ["doc_id", "text_key"]
GRAM = 25
PIECE = 1 << 20
WIDE = 64
SLICE = 32 << 20
ASK, REPEATS, OPEN, OPEN_WIDE = 0, 1, 2, 3
#: Two odd multipliers for each family of identifiers.
FAMILIES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def paired(ids: np.ndarray, offset: int, family: int) -> np.ndarray:
    """Identifiers of depth d + offset, from those of depth d at a position and ``offset`` later."""
    one, two = (np.uint64(x) for x in FAMILIES[family])
    return mix(ids[:-offset] * one + (ids[offset:] ^ two) * two) if len(ids) > offset else ids[:0]


def named(data: np.ndarray, depth: int, family: int) -> np.ndarray:
    """Identifiers of all runs of ``depth`` bytes."""
    return deepened(mix(data.astype(np.uint64) + np.uint64(FAMILIES[family][0])), 1, depth, family)


def deepened(ids: np.ndarray, reached: int, depth: int, family: int) -> np.ndarray:
    """Identifiers of depth ``depth`` from those of depth ``reached``, by doubling; the last offset may be shorter, so that halves overlap."""
    while reached < depth:
        step = min(reached, depth - reached)
        ids, reached = paired(ids, step, family), reached + step
    return ids


def sampled(data: np.ndarray, ends: np.ndarray, size: int):
    """Of bytes of documents that end at ``ends``: bucket, finer bucket, first and last window of each sampled suffix's stretch."""
    ids = named(data, GRAM, 0)
    whole = deepened(ids, GRAM, size, 0)
    span = size - GRAM + 1
    # the least of the upper halves, with the place in the lower one
    least = (ids & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(ids), dtype=np.uint64)
    width = 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:len(at)]
    inside = np.arange(len(at)) + size <= ends[doc]
    changes = np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]
    first = np.flatnonzero(changes)
    last = np.r_[first[1:], len(at)] - 1
    first, last = first[inside[first]], last[inside[first]]
    finer = mix(whole[first] * np.uint64(FAMILIES[1][0]) + whole[last] + ((at[first] - first) << 20 | (last - first)).astype(np.uint64))
    return ids[at[first]], finer, first, last, doc[first]


def pieces(batch, size: int):
    """(rows, starts within rows, bytes, ends) of stretches of text of about PIECE bytes; texts too short for a window are left out."""
    rows, starts, parts, held = [], [], [], 0
    for row, text in enumerate(batch.column("text")):
        raw = np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)
        for start in range(0, max(len(raw) - size + 1, 0), PIECE):
            part = raw[start:start + PIECE + size - 1]
            rows.append(row)
            starts.append(start)
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield rows, starts, parts
                rows, starts, parts, held = [], [], [], 0
    if parts:
        yield rows, starts, parts


def order_of(batch) -> np.ndarray:
    """Rank of each row of a batch by doc_id, nulls first, then text_key; equal rows share it."""
    ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
    rank = {k: i for i, k in enumerate(sorted({(d is not None, d if d is not None else 0, k) for d, k in zip(ids, keys)}))}
    return np.array([rank[d is not None, d if d is not None else 0, k] for d, k in zip(ids, keys)])


def together(row: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Ranges of window starts, one for those of a row that follow on each other."""
    if not len(row):
        return row, first, last
    by = np.lexsort((first, row))
    row, first, last = row[by], first[by], last[by]
    new = np.r_[True, (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)]
    at = np.flatnonzero(new)
    return row[at], first[at], np.maximum.reduceat(last, at)


def own_keys(row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys that spread what needs no meeting."""
    return mix(mix(row.astype(np.uint64)) + first.astype(np.uint64))


def repeated_before(*columns) -> np.ndarray:
    """Whether a row equals the row before in all columns."""
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def span(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A range in one number: its first place above 32 bits of length."""
    return first << 32 | (last - first)


def suffixes(size: int):
    """Per slice: what must meet the suffixes of other slices (ASK; a marker of a wide bucket has no finer one), what repeats and what to open window by window."""
    def run(iterator):
        for batch in batches(iterator, SLICE):
            found = []
            for rows, starts, parts in pieces(batch, size):
                bucket, finer, first, last, part = sampled(np.concatenate(parts), np.cumsum([len(p) for p in parts]), size)
                begin = np.cumsum([0, *[len(p) for p in parts]])[:-1]
                shift = np.array(starts)[part] - begin[part]
                found.append((bucket, finer, np.array(rows)[part], first + shift, last + shift))
            if not found:
                continue
            bucket, finer, row, first, last = (np.concatenate(x) for x in zip(*found))
            rank = order_of(batch)
            by = np.lexsort((first, rank[row], finer, bucket))
            bucket, finer, row, first, last = bucket[by], finer[by], row[by], first[by], last[by]
            again = repeated_before(bucket, finer)
            head = ~again
            # equal rows are one document: the same suffix of both is no repeat
            sure = again & ~repeated_before(rank[row], first)
            new_bucket = ~repeated_before(bucket)
            number = np.cumsum(new_bucket) - 1
            wide = np.bincount(number[head])[number] > WIDE
            s_row, s_first, s_last = together(row[sure], first[sure], last[sure])
            ask, open_, marker = head & ~wide, head & wide, new_bucket & wide
            n = int(ask.sum())
            take = np.concatenate([row[ask], row[marker], row[open_], s_row])
            kinds = np.repeat([ASK, ASK, OPEN_WIDE, REPEATS], [n, marker.sum(), open_.sum(), len(s_row)])
            buckets = np.concatenate([bucket[ask], bucket[marker], own_keys(row[open_], first[open_]), own_keys(s_row, s_first)])
            finers = np.concatenate([finer[ask], np.zeros(len(take) - n, np.uint64)])
            spans = np.concatenate([span(first[x], last[x]) for x in (ask, marker, open_)] + [span(s_first, s_last)])
            # in order of documents: rows of one document that go the same way follow on each other, which compresses
            o = np.lexsort((spans, take))
            out = batch.select(KEY).take(pa.array(take[o]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(signed(buckets[o])), pa.array(kinds[o].astype(np.int8)), pa.array(signed(finers[o]), mask=o >= n),
                                              pa.array(spans[o])], names=[*KEY, "bucket", "kind", "finer", "span"])
    return run


MEETING = "key long, k2 long, bytes binary, span long, known boolean"


def opened(size: int):
    """Per slice: the bytes of each stretch to open, under its bucket. Of a wide bucket the windows, under their identifiers, the earliest of equal ones, and those known to repeat."""
    def run(iterator):
        for batch in batches(iterator, SLICE):
            rows, keys, spans, parts, wide = [], [], [], [], []
            for row, (text, asked) in enumerate(zip(batch.column("text"), batch.column("asked"))):
                raw = text.as_py()
                for r in asked.as_py():
                    first, last = r["span"] >> 32, (r["span"] >> 32) + (r["span"] & 0xFFFFFFFF)
                    if r["kind"] == OPEN_WIDE:
                        wide.append((row, first, raw[first:last + size]))
                    else:
                        rows.append(row)
                        keys.append(r["bucket"])
                        spans.append(r["span"])
                        parts.append(raw[first:last + size])
            if rows:
                yield meeting(batch, np.array(rows), np.array(keys, np.int64), np.zeros(len(rows), np.int64), parts, np.array(spans, np.int64), False)
            if wide:
                rank = order_of(batch)
                row, start, k1, k2 = windows_of(*zip(*wide), size)
                later, row, start, k1, k2 = sorted_windows(rank[row], row, start, k1, k2)
                s_row, s_first, s_last = together(row[later], start[later], start[later])
                ask = ~repeated_before(k1, k2)
                yield meeting(batch, row[ask], signed(k1[ask]), signed(k2[ask]), None, span(start[ask], start[ask]), False)
                if len(s_row):
                    yield meeting(batch, s_row, signed(own_keys(s_row, s_first)), np.zeros(len(s_row), np.int64), None, span(s_first, s_last), True)
    return run


def meeting(batch, row, key, k2, parts, spans, known) -> pa.RecordBatch:
    out = batch.select(KEY).take(pa.array(row))
    n = len(row)
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(key), pa.array(k2), pa.array(parts, pa.binary()) if parts else pa.nulls(n, pa.binary()), pa.array(spans),
                                       pa.array(np.full(n, known))], names=[*KEY, "key", "k2", "bytes", "span", "known"])


def windows_of(rows, firsts, parts, size: int):
    """(row, start, k1, k2) of all windows of parts of texts, about PIECE bytes at once."""
    out, start = [], 0
    while start < len(parts):
        end, held = start, 0
        while end < len(parts) and held < PIECE:
            held += len(parts[end])
            end += 1
        length = np.array([len(p) for p in parts[start:end]])
        n = length - size + 1
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(length) - length, n) + within
        data = np.frombuffer(b"".join(parts[start:end]), np.uint8)
        out.append((np.repeat(rows[start:end], n), np.repeat(firsts[start:end], n) + within, named(data, size, 0)[at], named(data, size, 1)[at]))
        start = end
    return tuple(np.concatenate(x) for x in zip(*out))


def sorted_windows(rank, row, start, k1, k2):
    """Windows in order of identifier, rank and start, and whether an earlier one has the same identifier; equal rows are one document."""
    by = np.lexsort((start, rank, k2, k1))
    rank, row, start, k1, k2 = rank[by], row[by], start[by], k1[by], k2[by]
    new = ~repeated_before(k1, k2)
    heads = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    later = ~new & ((rank != rank[heads]) | (start != start[heads]))
    return later, row, start, k1, k2


def met(size: int):
    """Rows in order of key, all of a key in one partition -> the ranges of windows that start earlier elsewhere. Holds the rows of one key, or an Arrow batch, at a time."""
    names = [*KEY, "key", "k2", "bytes", "span", "known"]

    def settle(rows: pa.Table):
        batch = rows.combine_chunks().to_batches()[0]
        known = batch.column("known").to_numpy(zero_copy_only=False)
        spans = batch.column("span").to_numpy()
        alone = np.array(batch.column("bytes").is_null()) & ~known
        parts_at = np.flatnonzero(np.array(batch.column("bytes").is_valid()))
        row, start = np.flatnonzero(alone), spans[alone] >> 32
        k1, k2 = (batch.column(c).to_numpy().view(np.uint64)[alone] for c in ("key", "k2"))
        if len(parts_at):
            parts = batch.column("bytes").take(pa.array(parts_at)).to_pylist()
            more = windows_of(parts_at, spans[parts_at] >> 32, parts, size)
            row, start, k1, k2 = (np.concatenate(x) for x in zip((row, start, k1, k2), more))
        later, row, start, _, _ = sorted_windows(order_of(batch)[row], row, start, k1, k2)
        row, first, last = together(row[later], start[later], start[later])
        row, spans = np.concatenate([row, np.flatnonzero(known)]), np.concatenate([span(first, last), spans[known]])
        if len(row):
            out = batch.select(KEY).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(spans)], names=[*KEY, "span"])

    def run(iterator):
        held = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch.select(names)])
            now = pa.concat_tables([held, now]) if held is not None else now
            keys = now.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from settle(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield from settle(held)
    return run


def not_least(keys: list[str]) -> Column:
    """Whether an earlier suffix has the same ``keys``; equal rows are one document, so a row's twin is no earlier one."""
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text_key", F.shiftright("span", 32).alias("first"))
    return place != F.min(place).over(Window.partitionBy(*keys))


def repeats(texts: DataFrame, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """Two tables (doc_id, text_key, spans of window starts): whole stretches that repeat, and windows that do. ``texts`` holds doc_id, text_key and binary text."""
    where = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_key long"
    found = texts.mapInArrow(suffixes(size), f"{where}, bucket long, kind byte, finer long, span long")
    bucket = Window.partitionBy("bucket", "kind")
    several = F.min("finer").over(bucket) < F.max("finer").over(bucket)
    wide = (F.count("finer").over(bucket) < F.count("*").over(bucket)) | (F.count("*").over(bucket) > WIDE * 16)
    asked = found.select("*", several.alias("several"), wide.alias("wide"), not_least(["bucket", "kind", "finer"]).alias("later"))
    kind = (F.when(F.col("kind") != ASK, F.col("kind")).when(F.col("finer").isNull(), None).when(F.col("later"), REPEATS)
            .when(F.col("wide"), OPEN_WIDE).when(F.col("several"), OPEN))
    known = cut_lineage(asked.select(*KEY, "span", "bucket", kind.cast("int").alias("kind")).filter("kind is not null")
                        .groupBy(*KEY).agg(F.collect_list(F.when(F.col("kind") == REPEATS, F.col("span"))).alias("whole"),
                                           F.collect_list(F.when(F.col("kind") != REPEATS, F.struct("span", "bucket", "kind"))).alias("asked")))
    rows = same(texts, known.filter(F.size("asked") > 0).select(*KEY, "asked"), KEY, "inner").select(*KEY, "text", "asked").mapInArrow(opened(size), f"{where}, {MEETING}")
    later = rows.repartition("key").sortWithinPartitions("key").mapInArrow(met(size), f"{where}, span long")
    return known.select(*KEY, "whole"), later.groupBy(*KEY).agg(F.collect_list("span").alias("single"))


def maximal(found: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Byte spans (start, end) covered by ranges of window starts, merged where they touch."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(last + size, spans[-1][1]))
        else:
            spans.append((first, last + size))
    return spans


def removal(size: int, output):
    """For each text: number of bytes, of removed bytes, the spans, and ``output`` of the kept bytes."""
    def run(iterator):
        for batch in batches(iterator):
            made = []
            for text, whole, single in zip(batch.column("text"), batch.column("whole"), batch.column("single")):
                raw = text.as_py()
                spans = maximal([(x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in [*(whole.as_py() or []), *(single.as_py() or [])]], size)
                edges = [0, *[x for s in spans for x in s], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                made.append((len(raw), len(raw) - len(kept), output(kept), [{"start": a, "end": b} for a, b in spans]))
            n, gone, out, spans = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(KEY).columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[*KEY, "n_bytes", "n_removed", "out", "spans"])
    return run


def kept_text(kept: bytes) -> str:
    """The kept bytes as text; what a cut leaves of a character goes."""
    return kept.decode(errors="ignore")


def kept_digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def removed(docs: DataFrame, size: int = 100, output=kept_text) -> DataFrame:
    """Per row: doc_id, text_key, n_bytes, n_removed, out (what ``output`` makes of the kept bytes), spans (maximal removed runs, in bytes)."""
    texts = keyed(docs).select(*KEY, F.encode("text", "utf-8").alias("text"))
    stretches, singles = repeats(texts, size)
    joined = same(same(texts, stretches, KEY, "left"), singles, KEY, "left").select(*KEY, "text", "whole", "single")
    where = texts.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(removal(size, output), f"doc_id {where}, text_key long, n_bytes long, n_removed long, out string, "
                             "spans array<struct<start: long, end: long>>")


def dedup(docs: DataFrame, size: int = 100) -> DataFrame:
    """``docs`` with ``text`` freed of repeated bytes, keeping its other columns, whatever their names."""
    kept = removed(docs, size).select(F.col("doc_id").alias("doc_id"), "text_key", "out").distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))
    text = F.when(F.col("row.text").isNull(), None).otherwise(F.col("out"))
    return same(row, kept, KEY, "left").select(F.col("row").withField("text", text).alias("row")).select("row.*")
