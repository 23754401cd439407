"""First-wins rules on narrow rows, counted lookups and one-pass reports against plain Python."""
import random

import pytest
from pyspark.sql import functions as F

from vacancia.operators import companies, health, reports, snapshot, tracker

POSTINGS = "seq long, url string, company string, title string, location string, applyUrl string, postedDate date, filtered boolean"


def postings(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(10_000), n):
        link = rng.choice([None, "", f"https://www.acme.com/jobs/{rng.randrange(12)}/"])
        host = rng.choice(["acme.com", "gamejobs.co", "gamedevjobs.com"])
        place = rng.choice(["Berlin, Germany", "Paris, France", "Oslo", "", "Berlin, Germany / Lyon", " / oslo / Oslo / Berlin"])
        rows.append((seq, f"https://{host}/jobs/{rng.randrange(30)}", rng.choice(["Acme", "acme ", "", None]), f"Artist {rng.randrange(4)}", place, link, None, rng.random() < 0.5))
    return rows


@pytest.fixture(params=["number", "tuple"])
def ordered(request, spark):
    """The same postings with a number, or a tuple, as order."""
    def make(rows):
        df = spark.createDataFrame(rows, POSTINGS).repartition(3)
        return df if request.param == "number" else df.withColumn("seq", F.struct((F.col("seq") / 7).cast("int").alias("a"), (F.col("seq") % 7).alias("b")))
    return make


def number(seq):
    return seq if isinstance(seq, int) else seq["a"] * 7 + seq["b"]


def no_whole_rows(df):
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    return df.collect()


def test_same_url(ordered):
    rows = postings(1)
    want = {}
    for r in sorted(rows):
        first, flag = want.get(r[1], (r[0], True))
        want[r[1]] = (first, flag and r[7])
    got = {r["url"]: (number(r["seq"]), r["filtered"]) for r in no_whole_rows(snapshot.merge_same_url(ordered(rows)))}
    assert got == want


def test_offices(ordered):
    rows = postings(2)
    want, plain = {}, set()
    for seq, _, company, title, place, *_ in sorted(rows, key=lambda r: r[0]):
        key = ((company or "").strip().lower(), title)
        if not key[0]:
            plain.add(seq)
            continue
        first, n, one, offices = want.setdefault(key, [seq, 0, place, []])
        want[key][1] += 1
        offices += [o.strip() for o in place.split(" / ") if o.strip() and o.strip().lower() not in [x.lower() for x in offices]]
        seen = []
        for o in offices:
            if o.lower() not in [x.lower() for x in seen]:
                seen.append(o)
        offices[:] = seen
    expected = {(first, one if n == 1 else " / ".join(offices)) for first, n, one, offices in want.values()}
    got = snapshot.merge_offices(ordered(rows)).collect()
    assert {(number(r["seq"]), r["location"]) for r in got if (r["company"] or "").strip()} == expected
    assert {number(r["seq"]) for r in got if not (r["company"] or "").strip()} == plain


def test_links_and_first_per_key(ordered):
    rows = postings(3)
    df = ordered(rows)
    best = {}
    for r in rows:
        best[r[3]] = min(best.get(r[3], r[0]), r[0])
    assert {r["title"]: number(r["seq"]) for r in no_whole_rows(snapshot.first_per_key(df, ["title"], F.col("seq")))} == best
    links = {}
    for seq, url, *_, apply_url, _, _ in rows:
        target = (apply_url or "").strip() or url
        key = target.replace("https://www.", "https://").rstrip("/")
        links.setdefault(key, []).append(("acme.com" not in url, seq))
    assert {number(r["seq"]) for r in snapshot.collapse_links(df).collect()} == {min(v)[1] for v in links.values()}


def test_counts_agree_with_the_snapshot(ordered):
    rows = postings(4)
    df = ordered(rows)
    kept, counts = snapshot.dedupe_snapshot(df).collect(), snapshot.dedupe_counts(df).first()
    assert counts["kept"] == len(kept) and sum(counts) == len(rows)


def test_best_role_url(spark):
    rng = random.Random(5)
    words = ["engine", "gine", "tools", "artist", "art", "level", "ui", "rig"]
    listed = [(rng.choice(["Acme", "Beta"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) + rng.choice(["", "s", " Senior"]), f"u{i}", i) for i in rng.sample(range(200), 90)]
    apps = [(i, rng.choice(["Acme", "Beta", "Gone"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    want = {}
    for pos, company, role in apps:
        asked = [w for w in role.lower().split() if len(w) > 2]
        ranked = sorted((-sum(w in title.lower() for w in asked), at, url) for co, title, url, at in listed if co == company)
        if ranked:
            want[pos] = ranked[0][2]
    got = tracker.best_role_url(spark.createDataFrame(apps, "pos long, company string, role string"),
                                spark.createDataFrame(listed, "company string, title string, url string, lpos long").repartition(3))
    assert {r["pos"]: r["url"] for r in got.collect()} == want


def test_tracked_lookup_counts_without_pairs(spark):
    rng = random.Random(6)
    hosts = ["jobs.one.com", "one.com", "two.org", "a.b.two.org", None]
    entries = [(rng.choice(["Acme", "acme!", "Beta", "Gamma"]), *(h and f"https://{h}/x" for h in (rng.choice(hosts) for _ in range(4))), rng.choice([None, None, "unresolved"])) for _ in range(40)]
    table = spark.createDataFrame(entries, "name string, careers_url string, api string, endpoint string, feed_url string, status string").withColumns(
        {c: F.lit(None).cast("string") for c in ("recipe", "parser", "provider")})
    asked = [("Acme", None), ("Beta", "https://www.two.org"), ("Nobody", "http://one.com:80/"), ("Nobody", "https://three.net"), ("Listed", None)]
    domain = lambda u: ".".join(u.split("//")[1].split("/")[0].split(":")[0].split(".")[-2:]) if u else ""
    want = set()
    for name, url in asked:
        hits = [e for e in entries if e[0].lower().strip("!") == name.lower() or (url and domain(url) in {domain(u) for u in e[1:5]})]
        able = any(e[1] or e[2] for e in hits)
        want.add((name, "tracked" if able else "backlog" if hits or name == "Listed" else "unknown", len(hits) or int(name == "Listed")))
    got = companies.tracked_lookup(spark.createDataFrame(asked, "query string, url string"), table, spark.createDataFrame([("listed",)], "name string"))
    assert {tuple(r) for r in got.collect()} == want


def test_totals_in_one_pass(spark):
    gap = "array<struct<description:string,severity:string,mitigation:string>>"
    rows = [(i, "positive" if i % 3 == 0 else "negative", float(i % 5), ["FDE", "", None][i % 3], ["remote", "geo"][i % 2],
             [("US-only residency", "Hard", "")] * (i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, f"num long, outcome string, points double, archetype string, remote_policy string, gaps {gap}")
    got = reports.totals(df).collect()
    whole = next(r for r in got if r["by"] == "all")
    assert (whole["total"], whole["positive"], whole["lowest"]) == (30, 10, 1.0)
    assert {r["subject"]: r["total"] for r in got if r["by"] == "archetype"} == {"FDE": 10, "Unknown": 20}
    assert sum(r["gaps"] for r in got if r["by"] == "blocker" and r["subject"]) == sum(len(r[5]) for r in rows)


def test_samples(spark):
    rows = [("a", f"t{i}", i) for i in range(20)] + [("b", None, 1), ("b", "x", 2)]
    got = health.samples(spark.createDataFrame(rows, "company string, title string, seq long").repartition(4), ["company"], "title", "seq", 5)
    assert {r["company"]: r["samples"] for r in got.collect()} == {"a": [f"t{i}" for i in range(5)], "b": ["x"]}
