"""Row keys, null-safe joins, running sums over ranges, and hashing of words inside tasks."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: A word is a run of characters that are not one of these; no other Unicode space counts.
SPACES = "\x20\t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Odd multipliers of the rolling hashes; two give 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def ascii_lower(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, UPPER, LOWER)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): repeated rows share the key, and so their result. Other columns are left out."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))


def same(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Join on equal columns, null equal to null; the right side's copies of the columns go."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in columns else c) for c in right.columns])
    on = None
    for c in columns:
        one = left[c].eqNullSafe(renamed[f"_r_{c}"])
        on = one if on is None else on & one
    return left.join(renamed, on, how).drop(*[f"_r_{c}" for c in columns])


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, underscores put in front until no column of ``docs`` has the name in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def aside(docs: DataFrame, needed: set[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step(docs)`` with the columns of ``docs``, where all but ``needed`` wait under names that no operator uses."""
    waiting = [c if c in needed else f"aside {i}" for i, c in enumerate(docs.columns)]
    out = step(docs.select(*[F.col(f"`{c}`").alias(w) for c, w in zip(docs.columns, waiting)]))
    return out.select(*[F.col(f"`{w}`").alias(c) for c, w in zip(docs.columns, waiting)])


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number per row that is the same in every scan, however the files are split: file, then row inside it.

    The files are numbered by a broadcast table of one row per file, a list that the driver holds for the scan anyway. A frame
    that is no file scan is written once with its numbers.
    """
    path, place, file = unused(docs, "file_path", "row_index", "file_number")
    try:
        at = docs.metadataColumn("_metadata")
        placed = docs.select("*", at["file_path"].alias(path), at["row_index"].alias(place))
        placed.schema
    except AnalysisException:
        return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()))
    files = placed.select(path).distinct().withColumn(file, F.row_number().over(Window.orderBy(path)).cast("long"))
    return placed.join(F.broadcast(files), path).withColumn(name, F.shiftleft(F.col(file), 40) + F.col(place)).drop(path, place, file)


# ---- inside tasks -------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Hashes of any ranges of a word sequence, by prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 4096)
            up, down = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.powers, self.inverses = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._grow(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], dtype=np.uint64, out=sums[1:])
        return sums

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverses[start] + (end - start).astype(np.uint64))


def windows(rolling: Rolling, hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    start = np.arange(max(len(hashes) - size + 1, 0))
    return rolling.ranges(rolling.prefix(hashes), start, start + size)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def batches(iterator, limit: int = 4 << 20) -> Iterator:
    """Slices of Arrow batches of about ``limit`` bytes of text, so that a worker holds few texts at once."""
    for batch in iterator:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
