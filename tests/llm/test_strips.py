"""Cells of the Jaccard join that single shingles, however many texts have them, do not fill."""
import random

import numpy as np

from vacancia.llm import jaccard_join


def test_linked_sets_share_a_strip():
    rng, met = np.random.default_rng(6), 0
    for percent in (90, 97):
        strips = jaccard_join.Strips(percent)
        for step in range(1500):
            n = int(rng.integers(1, (30, 300, 2500)[step % 3]))
            # every fifth set lies in a corner of the hash, so that most of its strips are empty
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(4 if step % 5 == 0 else 0))
            drop, add = rng.integers(0, n // 12 + 2, 2)
            b = np.unique(np.r_[rng.permutation(a)[int(drop):], rng.integers(0, 2**64, int(add), dtype=np.uint64)])
            inter = len(np.intersect1d(a, b))
            if inter < max(len(a), len(b)) and 100 * inter >= percent * (len(a) + len(b) - inter):
                met += 1
                assert len(np.intersect1d(strips.cells(a), strips.cells(b)))
    assert met > 500


def test_texts_of_common_passages_are_not_tied(spark, monkeypatch):
    rng, seen, settle = random.Random(9), [], jaccard_join.components
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(120)]
    rows = [(i, " ".join(rng.sample(passages, 30))) for i in range(300)]
    rows += [(1000 + i, f"{text} one more") for i, text in rows[:10]]
    monkeypatch.setattr(jaccard_join, "components", lambda edges, *rest: (seen.append(edges.distinct().count()), settle(edges, *rest))[1])
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert seen[0] < 150
