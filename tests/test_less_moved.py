"""First-wins rules at size: what is moved for a row, and what repeated orders give."""
import contextlib
import io

from pyspark.sql import functions as F

from vacancia.operators import snapshot

SCHEMA = "seq long, url string, company string, title string, location string, applyUrl string"
ROWS = [(1, "https://acme.com/a", "Acme", "A", "Oslo", "https://x.com/1"), (2, "https://gamejobs.co/b", "Acme Studios", "A", "", ""),
        (3, "https://gamedevjobs.com/c", "Acme", "A", "Rome", ""), (4, "https://gamejobs.co/d", "Beta", "B", "Rome", ""), (5, "https://gamedevjobs.com/e", "Beta Studios", "B", "Rome", ""),
        (6, "https://acme.com/jobs/123456", "Acme", "C", "Oslo", ""), (7, "https://acme.com/x/123456", "Acme", "D", "Oslo", ""), (8, "https://acme.com/f", "Acme", "E", "Oslo", "https://x.com/1"),
        (None, "https://acme.com/g", "Acme", "F", "Oslo", "")]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Physical Plan ==")[1]


def test_an_employer_is_asked_for_in_one_way(spark):
    names = [("acme", 1), ("acme studios", 2), ("studios", 3)]
    employers = spark.createDataFrame([(n, n, r) for n, r in names], "company_key string, alias string, roles int").withColumn("core", snapshot.names.core_tokens(F.col("company_key")))
    probes, targets = (snapshot._employer_keys(employers, *sides) for sides in (("inside", "around", "word", "letters"), ("around", "inside", "letters", "word")))
    used, useful = snapshot._ways(probes, targets)
    # by its words from inside; a name of general words only has its whole self
    assert sorted((r.company_key, r.kind) for r in used.collect()) == [("acme", "inside"), ("acme studios", "inside"), ("studios", "fold")]
    assert sorted((r.company_key, r.kind) for r in useful.collect()) == [("acme", "inside"), ("acme studios", "inside"), ("studios", "fold")]


def test_marks_and_counts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    codes = {"norway": "NO"}
    marks = {r.seq: r.gone for r in snapshot.snapshot_marks(df, codes=codes).collect()}
    assert marks == {1: None, 2: "title", 3: "title", 4: None, 5: "title", 6: None, 7: "id", 8: "link", None: "link"}
    assert snapshot.dedupe_counts(df, codes=codes).first().asDict() == {"by_link": 2, "by_id": 1, "by_title": 3, "kept": 3}
    assert sorted(r.seq for r in snapshot.dedupe_snapshot(df, codes=codes).collect()) == [1, 4, 6]


def test_repeated_orders_give_as_many_rows_as_before(spark):
    df = spark.createDataFrame([r for r in ROWS[:-1] for _ in range(2)], SCHEMA).repartition(3)
    marks = snapshot.snapshot_marks(df, codes={"norway": "NO"}).groupBy("gone").count().collect()
    assert {r.gone: r["count"] for r in marks} == {"link": 2, "id": 8, "title": 24, None: 12}
    assert snapshot.dedupe_snapshot(df, codes={"norway": "NO"}).count() == 24


def test_a_link_passes_on_one_row_per_task(spark, monkeypatch):
    seen, store = [], snapshot.stored
    monkeypatch.setattr(snapshot, "stored", lambda df: (seen.append(plan(df)), store(df))[1])
    snapshot.dedupe_counts(spark.createDataFrame(ROWS, SCHEMA), codes={"norway": "NO"}).collect()
    assert sum("WindowGroupLimit" in p for p in seen) == 1


def test_only_shared_keys_of_winners_are_kept(spark, monkeypatch):
    rows = [(1, "u1", "Acme", "A"), (2, "u1", "Acme", "B"), (3, "u3", "Acme", "B"), (4, "u4", "Acme", "C"), (5, "u5", "Acme", "A"), (6, "u5", "Acme", "D"), (6, "u5", "Acme", "D")]
    made, store = [], snapshot.stored
    monkeypatch.setattr(snapshot, "stored", lambda df: (made.append(store(df)), made[-1])[1])
    got = snapshot.first_wins(spark.createDataFrame(rows, "seq long, url string, company string, title string"))
    assert sorted(r.seq for r in got.collect()) == [1, 3, 4, 6, 6]
    first = {r.seq: (r.won, r.url is None, r._pair is None) for r in made[1].collect()}
    assert first[1] == (True, False, False) and first[4] == (True, True, True) and not first[2][0]


def test_an_office_is_found_without_a_join(spark, tmp_path):
    rows = [(1, "Acme", "A", "Oslo / Rome", None), (2, "acme", "a", "oslo / Paris", None), (3, "Acme", "B", None, None), (4, "", "A", "X", None), (5, "Acme", "C", "Bern", None), (5, "Acme", "D", "Ulm", None)]
    df = spark.createDataFrame(rows, "seq long, company string, title string, location string, postedDate date")
    want = {("A", "Oslo / Rome / Paris"), ("B", None), ("A", "X"), ("C", "Bern"), ("D", "Ulm")}
    # a row without an order lists no office
    late = spark.createDataFrame([(None, "Acme", "A", "Bonn", None)], df.schema)
    for given in (df.unionByName(late), df.withColumn("seq", F.struct("seq", "title"))):
        given.write.parquet(f"{tmp_path}/{len(given.schema['seq'].dataType.simpleString())}")
        got = snapshot.merge_offices(spark.read.parquet(f"{tmp_path}/{len(given.schema['seq'].dataType.simpleString())}"))
        planned = plan(got)
        assert "WindowGroupLimit" in planned and planned.count("Join") <= 2
        assert {(r.title, r.location) for r in got.collect()} == want
