"""Suffix dedup, conversation repair and the manifest on edge cases and against brute force."""
import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from conftest import EDGES, LONG
from pyspark.sql import functions as F

from vacancia.llm import manifest, suffix_dedup, turn_repair


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def want(made):
    return sorted(made, key=key)


# ---- suffix dedup -------------------------------------------------------------------------------

def kept(docs, **more):
    return rows(suffix_dedup.removed(docs, output=suffix_dedup.kept_digest, **more).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "out"))


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(3))
    base = " ".join(word() for _ in range(250))
    docs = [(i, " ".join(word() for _ in range(rng.choice([20, 40, 60])))) for i in range(60)]
    docs += [(100 + i, base[rng.randrange(400):][:rng.randrange(90, 400)] + "é" * rng.randrange(80)) for i in range(80)]
    docs += [(300 + i, "x" * n) for i, n in enumerate((0, 99, 100, 101, 350, 2000))]
    return docs + [(400, base * 3), (401, None), (None, base[50:300]), (402, "\U0001F600" * 60)]


@pytest.mark.parametrize("piece", [1 << 20, 41])
def test_suffixes(frame, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    docs = passages(5)
    assert kept(frame(docs).repartition(6)) == want(brute.suffixes(docs))
    assert kept(frame(docs[:40]), size=30) == want(brute.suffixes(docs[:40], 30))


def test_suffixes_meet_in_one_slice_or_many(frame, monkeypatch):
    docs = passages(6)
    alone = kept(frame(docs).repartition(len(docs), "doc_id"))
    together = kept(frame(docs).coalesce(1))
    assert alone == together == want(brute.suffixes(docs))


def test_suffixes_of_equal_rows(frame, edges, empty):
    twice = [d for d in EDGES if d[0] is not None] + [(8, LONG), (20, LONG + " tail")]
    by_id = {}
    for doc, n, removed, _, _ in kept(frame(twice)):
        by_id.setdefault(doc, set()).add((n, removed))
    assert all(len(v) == 1 for v in by_id.values())     # rows equal in id and text share their result
    n = len(LONG.encode())
    assert by_id[7] == {(n, max(x[2] for x in brute.suffixes([(7, LONG)])))} and by_id[8] == {(n, n)} and by_id[20] == {(n + 5, n + 5)}
    assert len(kept(edges)) == len(EDGES) and kept(empty) == []


def test_suffix_dedup_keeps_other_columns(frame):
    docs = frame([(1, "α" * 80 + "one"), (2, "α" * 80 + "two"), (3, None)])
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs.withColumn("row", F.lit("mine")).withColumn("out", F.lit("yours"))).collect()}
    assert got[2]["text"] == "two" and got[1]["text"] != "two" and got[3]["text"] is None
    assert {(r["row"], r["out"], r["text_key"]) for r in got.values()} == {("mine", "yours", 1)}


def test_identifiers_name_runs():
    data = np.frombuffer(b"abcabcabcaXabcabcabca", np.uint8)
    for depth in (1, 2, 3, 5, 10):
        ids = suffix_dedup.named(data, depth, 0)
        runs = [bytes(data[i:i + depth]) for i in range(len(data) - depth + 1)]
        assert len(ids) == len(runs) and all((ids[i] == ids[j]) == (runs[i] == runs[j]) for i in range(len(ids)) for j in range(len(ids)))


# ---- conversation repair ------------------------------------------------------------------------

def test_alignment_against_all_repairs():
    rng = random.Random(2)
    for k in range(1500):
        turns = "".join(rng.choice("ssuuuaaaxSUAXddd" if k % 2 else "uauauauasd") for _ in range(rng.randrange(1, 10)))
        expected = brute.cheapest(turns)
        assert turn_repair.whole(turns) == expected
        cuts = sorted(rng.sample(range(1, len(turns)), min(len(turns) - 1, rng.randrange(4))))
        parts = [turn_repair.part(turns[a:b]) for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        way = turn_repair.joined([turn_repair.ranked(p) for p in parts])
        costs, ranks = turn_repair.ranked(way)
        cost, _, end = min((costs[s] + 2 * len(turn_repair.CLOSING[s]), ranks[s], s) for s in range(4) if costs[s] is not None)
        path = way[0, end][2]
        assert (cost, "".join(p[a, b][1] for p, a, b in zip(parts, path, path[1:])) + turn_repair.CLOSING[end]) == expected


TURNS = "conv_id long, turn long, role string, text string, at long, first long, audit string"


def talks(seed, n=300):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system"] * 6 + [None, "", "tool", "u", "agent"]
    texts = [None, "", " \n", "hi", "ok.", "yes?", "é!", "long " * 3000] + [f"t{i}." for i in range(60)]
    return [(rng.choice([None, 1, 2, 3, 2 ** 60 + 1]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def table(spark, given):
    return spark.createDataFrame([(*g, 1, 2, "mine") for g in given], TURNS).repartition(3)


def hurt(given):
    out = []
    for conv, turn, role, text in given:
        text = " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def complete(given, found):
    there = {f[0] for f in found}
    return want(found + [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {g[0] for g in given} - there])


@pytest.mark.parametrize("bits", [10, 2])
def test_conversations(spark, frame, empty, bits):
    given = talks(4) + [(50 + i, t, r, x) for i in range(40) for t, (r, x) in enumerate([("user", f"a{i}."), ("assistant", "b.")] * (i % 3))]
    assert rows(turn_repair.digest(table(spark, given), bits)) == complete(given, brute.conversations(hurt(given)))
    assert rows(turn_repair.digest(table(spark, []), bits)) == []


def test_one_conversation_holds_most_turns(spark, frame, empty):
    given = [(7, i % 900, ("user", "assistant", "user", "system")[i * i % 4], f"text {i % 700}" + ".?"[: i % 3 % 2 + 1]) for i in range(1500)]
    given += [(8, 0, "user", "same.")] * 400
    split, once = (rows(turn_repair.digest(table(spark, given), bits)) for bits in (4, 12))
    assert split == once and split[0][1:4] != (0, 0, 0)


def test_repaired_turns(spark, frame, empty):
    given = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "b"), (2, 0, "tool", None), (3, 0, "user", "q?")]
    found, lines = turn_repair.repair(table(spark, given))
    assert {r["conv_id"]: r["audit"] for r in found.collect()} == {1: "KRK", 2: "D", 3: "KI"}
    got = [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in lines.orderBy("conv_id", "at", "sub").collect()]
    assert got == [(1, "K", "system", "s."), (1, "R", "user", "a."), (1, "K", "assistant", "b"), (3, "K", "user", "q?"), (3, "I", "assistant", "")]


# ---- manifest -----------------------------------------------------------------------------------

def lowered(doc, text):
    return brute.lower(text) if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 else text


@pytest.mark.parametrize("fanout, inner", [(16, 3), (2, 1), (3, 2)])
def test_manifest(frame, empty, fanout, inner):
    docs = [(i, f"Text {i} É", "s0" if i % 3 else None if i % 2 else f"host{i}") for i in range(150)] + [(7, "Other", "s0"), (7, "Other", "s0"), (None, None, "s0")]
    docs += [(d, t, "edge") for d, t in EDGES]
    given = frame(docs)
    plain = [((r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]), lowered(r["doc_id"], r["text"])) for r in given.collect()]
    got = manifest.verified(given, fanout, inner, manifest.tampered(given))
    expected = [(*x, x[5] == x[3]) for x in brute.manifest(plain, fanout)]
    assert rows(got.drop("source")) == want(expected)
    assert {x[6] for x in expected} == {True, False}
    assert manifest.verified(empty, fanout, inner).count() == 0


def test_manifest_proofs_hold(frame):
    given = frame([(i, "t", f"s{i % 40}") for i in range(400)])
    got = manifest.verified(given, 4, 1)
    assert got.filter("verified").count() == 400 and got.select("root").distinct().count() == 1
    one = manifest.verified(frame([(1, "t", "s")]), 4, 1).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_suffixes_of_wide_buckets(frame, monkeypatch):
    rng = random.Random(9)
    line = "every document carries this very common line of text and all of them do so without end. "
    docs = [(i, "".join(rng.choice("abcdef ") for _ in range(90)) + line + (line if i % 3 else "") + "".join(rng.choice("abcdef ") for _ in range(90))) for i in range(250)]
    for wide in (1, 64):
        monkeypatch.setattr(suffix_dedup, "WIDE", wide)
        assert kept(frame(docs).repartition(9)) == want(brute.suffixes(docs))
