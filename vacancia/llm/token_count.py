"""Token counts of a byte-level BPE vocabulary by distinct pre-tokens.

A text is cut at the special strings of the vocabulary and into pre-tokens, whose frequencies are counted per document.
Pieces never cross pre-tokens, so the pieces of each distinct pre-token are counted once, and documents sum frequency times
pieces; no ids are built. Frequent short pre-tokens (the head, at most ``head`` entries of ``HEAD_BYTES`` bytes) are joined
on the map side from a broadcast table of proven size, which also takes the hot keys away from the shuffle; all others are
brought together by hash partitions of the pre-token. Longer ones (rules of dashes, runs of blanks) may be hot too and are
salted over as many parts as the session shuffles into. The head only decides where a pre-token is joined, never the count.
A task holds the pre-tokens of ``PIECE`` characters of a text and the codes of ``AT_ONCE`` pre-tokens at a time.

Null texts are empty and have no tokens. Repeated rows are counted row by row. Rows without doc_id are counted too. Other columns are ignored.
Rows are numbered by task, so ``docs`` must come from a repeatable source such as a file scan.
"""
from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, functions as F

from .common import batches

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD_BYTES = 32
PIECE, AT_ONCE = 1 << 18, 2_000


def model_of(path: str):
    """The vocabulary, read once per process and state of its file, on one thread. Functions shipped by value get this module's
    names anew in each task, so it is kept with the names of its library, which a worker imports once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers
    kept, at = vars(tokenizers).setdefault("_vacancia_models", {}), os.stat(path)
    state = at.st_ino, at.st_mtime_ns, at.st_size
    if path not in kept or kept[path][0] != state:
        kept[path] = state, tokenizers.Tokenizer.from_file(path)
    return kept[path][1]


def lengths(model, words: list[str]) -> list[int]:
    """Number of pieces of each pre-token."""
    return [len(e.ids) for at in range(0, len(words), AT_ONCE) for e in model.encode_batch(words[at:at + AT_ONCE], add_special_tokens=False)]


def stretches(text: str):
    """The text in parts of ``PIECE`` characters or more; no pre-token holds a space behind another character, so it may be cut there."""
    start = 0
    while len(text) - start > PIECE:
        end = text.find(" ", start + PIECE)
        while end > 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def cut(text: str, special: list[str], find) -> tuple[Counter, int]:
    """Frequencies of the pre-tokens, and the number of special strings."""
    parts = regex.split("|".join(map(regex.escape, sorted(special, key=len, reverse=True))), text) if any(s in text for s in special) else [text]
    seen = Counter()
    for part in parts:
        for stretch in stretches(part):
            seen.update(find(stretch))
    return seen, len(parts) - 1


def sampled(special):
    def run(iterator):
        find = regex.compile(PATTERN).findall
        for batch in batches(iterator):
            seen = Counter()
            for text in batch.column("text"):
                seen.update(cut(text.as_py(), special, find)[0])
            kept = [(w, n) for w, n in seen.items() if len(w.encode()) <= HEAD_BYTES]
            if kept:
                words, n = zip(*kept)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n, pa.int64())], names=["piece", "n"])
    return run


def frequencies(special, head):
    """Rows to be joined: one per document (``piece`` null) with its bytes and the tokens of head pre-tokens and special strings,
    and one per other pre-token of the document with its frequency. ``row`` numbers the documents of a task."""
    def run(iterator):
        from pyspark import TaskContext
        find, known = regex.compile(PATTERN).findall, head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches(iterator):
            rows, size, piece, times, of = [], [], [], [], []
            for at, text in enumerate(batch.column("text")):
                text = text.as_py()
                pieces, n = cut(text, special, find)
                other = 0
                for word, count in pieces.items():
                    if (k := known.get(word)) is not None:
                        n += k * count
                    else:
                        piece.append(word)
                        times.append(count)
                        other += 1
                piece.append(None)
                times.append(n)
                rows.append(row)
                row += 1
                size.append(len(text.encode()))
                of.append(other + 1)
            last = np.cumsum(of) - 1
            own = np.zeros(last[-1] + 1, bool)
            own[last] = True
            at = np.repeat(np.arange(len(of)), of)
            empty = pa.array(~own)
            ids = pa.compute.if_else(empty, pa.scalar(None, batch.column("doc_id").type), batch.column("doc_id").take(pa.array(at)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.array(rows, np.int64)[at]), pa.array(np.array(size, np.int64)[at], mask=~own), pa.array(piece, pa.string()), pa.array(times, pa.int64())],
                names=["doc_id", "row", "n_bytes", "piece", "times"])
    return run


def piece_counts(path: str):
    """Rows with ``n`` in place of piece and times. Partitions come in order of piece, so that each distinct piece is counted
    once, but for the ends of batches; the documents' own rows pass."""
    def run(iterator):
        model = model_of(path)
        for batch in batches(iterator):
            coded = batch.column("piece").dictionary_encode()
            names = coded.dictionary.to_pylist()
            counts = np.array(lengths(model, names) + [1], np.int64)
            which = coded.indices.fill_null(len(names)).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "n_bytes")), pa.array(counts[which] * batch.column("times").to_numpy())],
                                             names=["doc_id", "row", "n_bytes", "n"])
    return run


def counted(docs: DataFrame, path: str, head: int = 100_000, sample: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row; ``path`` names a vocabulary file that every executor has."""
    spark = docs.sparkSession
    model = model_of(path)
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # head: frequent pre-tokens of about ``sample`` rows
    share = max(1, round(texts.count() / sample))
    frequent = (texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").mapInArrow(sampled(special), "piece string, n long")
                .groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "piece").limit(head).select("piece").collect())
    names = [r["piece"] for r in frequent]
    known = spark.sparkContext.broadcast(dict(zip(names, lengths(model, names))))
    where = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(frequencies(special, known), f"doc_id {where}, row long, n_bytes long, piece string, times long")
    # equal pre-tokens meet in one partition, long ones in one per salt; the documents' own rows have no piece and are dealt out by number
    salt = F.pmod("row", F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.repartition(F.when(F.col("piece").isNull(), F.col("row")).when(F.octet_length("piece") > HEAD_BYTES, F.xxhash64("piece", salt))
                             .otherwise(F.xxhash64("piece")))
    joined = dealt.sortWithinPartitions("piece").mapInArrow(piece_counts(path), f"doc_id {where}, row long, n_bytes long, n long")
    return joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("row")
