"""Rules the reference states row by row, against brute force on small random fixtures."""
import random

import pytest
from pyspark.sql import functions as F

from vacancia.operators import health, reports, snapshot, tracker

CLUSTER_STOP = {"senior", "lead", "engineer"}


@pytest.mark.parametrize("seed", [1, 2])
def test_first_wins(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, f"u{rnd.randint(0, 12)}", f"C{rnd.randint(0, 2)}", f"T{rnd.randint(0, 6)}") for i in range(120)]
    rnd.shuffle(rows)
    urls, pairs, want = set(), set(), []
    for seq, url, co, title in sorted(rows):
        if url not in urls and (co, title) not in pairs:
            urls.add(url)
            pairs.add((co, title))
            want.append(seq)
    df = spark.createDataFrame(rows, "seq long, url string, company string, title string").repartition(3)
    assert sorted(r.seq for r in snapshot.first_wins(df).collect()) == want


def _same(a, b):
    shared = [w for w in a if w in b]
    return len(shared) >= 2 and len(shared) >= 0.6 * min(len(a), len(b))


def test_clusters_are_greedy_leaders(spark):
    rnd = random.Random(7)
    words = ["gameplay", "engine", "tools", "artist", "rigging", "level", "senior", "network", "audio"]
    apps = []
    for pos in range(1, 91):
        role = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))
        apps.append((pos, pos, rnd.choice(["Acme", "Beta Inc"]), role, f"{rnd.randint(0, 50) / 10}/5", rnd.choice(["Applied", "Evaluated", "Offer", "SKIP"])))
    want, ranks = {}, {"skip": 0, "evaluated": 2, "applied": 3, "offer": 6}
    for co in ("Acme", "Beta Inc"):
        mine = [(a, [w for w in a[3].split() if w not in CLUSTER_STOP]) for a in apps if a[2] == co]
        done = set()
        for i, (lead, lw) in enumerate(mine):
            if lead[0] in done:
                continue
            group = [lead]
            done.add(lead[0])
            for other, ow in mine[i + 1:]:
                if other[0] not in done and _same(lw, ow):
                    group.append(other)
                    done.add(other[0])
            group.sort(key=lambda a: -float(a[4][:-2]))
            best = group[0][5]
            for a in group[1:]:
                if ranks[a[5].lower()] > ranks[best.lower()]:
                    best = a[5]
            want[group[0][0]] = (best, len(group))
    df = spark.createDataFrame(apps, "num long, pos long, company string, role string, score string, status string").repartition(3)
    got = {r.num: (r.status, r.members) for r in tracker.dedupe_applications(df).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_entry_numbers(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(1, 60)) for i in range(40)]
    high, want = 20, {}
    for seq, num in rows:
        high = num if num > high else high + 1
        want[seq] = high
    df = spark.createDataFrame(rows, "file_seq long, num long").repartition(5)
    got = tracker.assign_numbers(df, spark.createDataFrame([(20,)], "m0 long"))
    assert {r.file_seq: r.num for r in got.collect()} == want


def test_mirrors(spark):
    rows = [
        (1, "Engine Programmer", "https://careers.riot.com/1", "Riot Games", "Dublin, IE"),
        (2, "Engine  Programmer!", "https://gamejobs.co/a", "Riot", ""),
        (3, "Engine Programmer", "https://gamejobs.co/b", "Ubisoft", "Dublin"),
        (4, "Engine Programmer", "https://gamejobs.co/c", "Riot", "Paris, FR"),
        (5, "Producer", "https://hitmarker.net/d", "WB Games", "Cary"),
        (6, "Producer", "https://www.gamedevjobs.com/e", "Warner Bros. Games", "Cary, NC"),
        (7, "Producer", "https://gamedevjobs.com/f", "Warner Bros", "Leeds"),
    ]
    df = spark.createDataFrame(rows, "seq long, title string, url string, company string, location string")
    marks = {r.seq: r.mirror_tier for r in snapshot.mark_mirrors(df).collect()}
    assert marks == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: 2, 7: None}


def test_snapshot_dedup_is_idempotent_and_keeps_countries(spark):
    rows = [
        (1, "A", "https://hitmarker.net/1", "Epic", "Montreal, Canada", "https://jobs.epic.com/77/"),
        (2, "A", "https://jobs.epic.com/77", "Epic Games", "Cary, United States", None),
        (3, "B", "https://x.com/jobs/123456", "Epic", "", None), (4, "B2", "https://y.com/jobs/123456-b", "epic", "", None),
        (5, "C", "https://z.com/c", "Epic", "Oslo", "mailto:a@b.c"), (6, "C", "https://z.com/d", "Epic", "Oslo", "mailto:a@b.c"),
    ]
    df = spark.createDataFrame(rows, "seq long, title string, url string, company string, location string, applyUrl string")
    once = snapshot.dedupe_snapshot(df)
    got = {r.seq: r.location for r in once.collect()}
    assert got == {2: "Cary, United States / Canada", 3: "", 5: "Oslo", 6: "Oslo"}
    assert {r.seq for r in snapshot.dedupe_snapshot(once).collect()} == set(got)


def test_health_fold(spark):
    state = spark.createDataFrame([("a", 2, "2024-01-01", "e", "http"), ("b", 1, "2024-01-02", None, None), ("gone", 9, "2023-01-01", None, None)],
                                  "company string, fails long, since string, lastError string, kind string")
    now = spark.createDataFrame([("a", False, "boom", "http"), ("b", True, None, None), ("new", False, "x", "network")], "company string, ok boolean, error string, kind string")
    tracked = spark.createDataFrame([("a",), ("b",)], "company string")
    got = {r.company: (r.fails, r.since, r.alert) for r in health.fold_health(state, now, F.lit("2024-02-01"), 3, tracked).collect()}
    assert got == {"a": (3, "2024-01-01", True), "new": (1, "2024-02-01", False)}


def test_evidence_gate_closes(spark):
    rows = spark.createDataFrame([("evaluated",)] * 4 + [("applied",)], "state string")
    assert reports.with_evidence(reports.funnel(rows), rows, 5).count() == 0
    assert reports.with_evidence(reports.funnel(rows), rows, 1).count() == 2
