"""Stateful streams over many micro-batches, in shuffled order."""
import random

from vacancia.streaming import streams


def drained(spark, tmp_path, rows, schema, make, key):
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f={i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in/*")
    return streams.latest(streams.drain(make(source), "update"), key).collect()


def test_streaks_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, f"2024-01-{d:02d}", rng.random() < 0.6) for c in "ab" for d in range(1, 6) for _ in range(2)]
    rng.shuffle(rows)
    got = {r.company: (r.fails, r.since, r.last) for r in drained(spark, tmp_path, rows, "company string, run string, ok boolean", lambda s: streams.failure_streaks(s, 2), "company")}
    want = {}
    for company in "ab":
        runs = {}
        for c, run, ok in rows:
            if c == company:
                runs[run] = runs.get(run, True) and ok
        fails, since = 0, None
        for run in sorted(runs):
            fails, since = (0, None) if runs[run] else (fails + 1, since or run)
        want[company] = (fails, since, max(runs))
    assert got == want


def test_ledger_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, i, rng.choice(["hit", "miss", "reject"]), rng.choice("pq"), "medium") for i, k in enumerate("ab" * 8)]
    want = {}
    for key in "ab":
        hit, missed, refused = "", set(), set()
        for k, _, kind, provider, _ in rows:
            if k == key and kind == "hit":
                hit = provider
            elif k == key and kind == "miss":
                missed.add(provider)
            elif k == key:
                refused.add(provider)
                hit = "" if hit == provider else hit
        want[key] = (hit, ",".join(sorted(missed)), ",".join(sorted(refused)))
    rng.shuffle(rows)
    got = drained(spark, tmp_path, rows, "key string, seq long, kind string, provider string, conf string", lambda s: streams.coverage_ledger(s, 2), "key")
    assert {r.key: (r.hit, r.missed, r.rejected) for r in got} == want


def test_reposts_in_any_order(spark, tmp_path):
    """Another url 80 days before is a repost wherever the days lie; the same url, one 91 days before and an unknown url are none."""
    import datetime
    start = datetime.date(2024, 1, 1)
    rows = [("a", "Dev", "u1", 0), ("a", "dev", "u2", 80), ("a", "Dev", "u2", 85), ("a", "Dev", "u3", 91), ("a", "Dev", "u3", 91), ("a", "Art", "u4", 5), ("a", "Dev", None, 20),
            ("b", "Dev", "u5", 3), (None, "Dev", "u6", 4), (None, "Dev", "u7", 5), ("a", "Dev", "u8", None)]
    rng = random.Random(7)
    rows += [("c", "Dev", rng.choice("pqr"), rng.randint(0, 400)) for _ in range(25)]
    want = {}
    for c, title, url, day in rows:
        old = [r for r in rows if c and url and day is not None and r[0] == c and r[1].lower() == title.lower() and r[2] not in (None, url) and r[3] is not None and day - 90 <= r[3] < day]
        n = sum(r[0] == c and r[1].lower() == title.lower() and r[2:] == (url, day) for r in rows)
        want[c, title.lower(), url, None if day is None else start + datetime.timedelta(day)] = (n, len(old), len({r[2] for r in old}))
    rng.shuffle(rows)
    given = [(c, t, u, None if d is None else start + datetime.timedelta(d)) for c, t, u, d in rows]
    schema = "company string, title string, url string, postedDate date"
    for i in range(0, len(given), 5):
        spark.createDataFrame(given[i:i + 5], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f={i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    got = streams.latest(streams.drain(streams.reposts(source), "update"), "company", "role_key", "url", "day").collect()
    assert {(r.company, r.role_key, r.url, r.day): (r.n, r.reposts, r.urls) for r in got} == want
    assert want["a", "dev", "u2", start + datetime.timedelta(80)] == (1, 1, 1)
