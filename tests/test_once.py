"""Work that is done once per row, and state that is written once per role."""
import contextlib
import io
import re

import pandas as pd
from pyspark.sql import functions as F

from vacancia.functions import dates, text
from vacancia.operators import classify, experience, snapshot, tracker
from vacancia.sources import feeds
from vacancia.streaming import streams

L = F.lit


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Physical Plan ==")[1]


def test_few_date_formats_are_tried(values):
    def tried(s):
        return sum(values(*[dates._may_fit(L(s), signs) for _, signs in dates._TEXT_FORMATS]))
    assert [tried(s) for s in ("", "13 Jun 2026 00:00:00 GMT", "2024-01-02", "2024/01/02", "Jun 1, 2024")] == [0, 2, 1, 1, 3]
    got = values(*[dates.iso_instant(L(s)) for s in ("2024-01-02t03:04:05z", "2024-01-02T03:04+01:00", "2024-01-02 03:04:05.678", "13 Jun 2026 00:00:00 +0100",
                                                     "2024/01/02", "Jun 1, 2024", "June 1, 2024", "1 Jun 2024", "2024-01-02 03:04:05 utc")])
    assert got == ("2024-01-02T03:04:05.000Z", "2024-01-02T02:04:00.000Z", "2024-01-02T03:04:05.678Z", "2026-06-12T23:00:00.000Z", "2024-01-02T00:00:00.000Z",
                   "2024-06-01T00:00:00.000Z", "2024-06-01T00:00:00.000Z", "2024-06-01T00:00:00.000Z", "2024-01-02T03:04:05.000Z")


def test_items_are_read_once(spark):
    xml = "<item><title><![CDATA[A &amp;#34; B]]></title><link>https://r/1</link><pubDate>Sat, 13 Jun 2026 00:00:00 GMT</pubDate></item>"
    rows = feeds.rss_feed(spark.createDataFrame([("Acme", xml)], "company string, body string"))
    assert rows.first().title == "A &#34; B"
    assert plan(rows).count("CDATA") == 3
    sitemap = "<url><loc>https://g/A-at-B</loc><lastmod>2024-01-02</lastmod></url>"
    rows = feeds.sitemap_postings(spark.createDataFrame([("Acme", sitemap)], "company string, body string"))
    assert rows.first().company == "B" and plan(rows).count("CDATA") == 2


def test_signs_are_literals(values):
    body = "a — b “c” … ‘d’ x → y •• z​ €5"
    assert values(text.ascii_html(L(body))) == ('a - b "c" ... \'d\' x to y |  | z EUR 5',)
    counts = {r.sign: r.n for r in values(text.ascii_sign_counts(L(body + "<b title='—'>—</b>")))[0]}
    assert (counts["em-dash"], counts["smart-double-quote"], counts["bullet"], counts["zero-width"], counts["pound"]) == (2, 2, 2, 1, 0)
    assert values(text.ascii_html(L(None).cast("string"))) == (None,)
    assert str(text.ascii_signs(F.col("x"))).count("regexp_replace") <= 6


def test_entities(values):
    got = values(*[text.decode_entities(L(s)) for s in ("plain", "[{&#34;a&#34;:&#34;x &amp;amp; y&#34;}]", "&amp;#34;", "&QUOT;&#039;&#8364;&#127;&#0;", "a & b")])
    assert got == ("plain", '[{"a":"x &amp; y"}]', "&#34;", "\"'€\x7f", "a & b")


def test_names_in_a_text():
    names = ["new zealand", "new york", "new york city", "united states", "a b"]
    found = re.compile(classify._any_name(names))
    for s in ("in new york today", "new zealan", "xnew zealandx", "united state", "aa b", "", "new yor"):
        assert bool(found.search(s)) == any(n in s for n in names), s


def test_headings_and_marks(values):
    assert values(experience.plain(L(f"{experience.OPEN}3 years{experience.SHUT} x"))) == ("3 years x",)
    assert "translate" not in str(experience.plain(F.col("x")))
    assert values(experience.tone(L("Nice to have: a. Required: b")), experience.tone(L("Required: b. Nice to have: a")), experience.tone(L("none"))) == (False, True, None)


def test_listed_rows_are_read_once(spark, tmp_path):
    spark.createDataFrame([("Acme", "Level Designer", "u1", 2), ("Acme", "Cook", "u0", 1), ("Beta", "Cook", "u3", 3)], "company string, title string, url string, lpos long").write.parquet(f"{tmp_path}/listed")
    apps = spark.createDataFrame([(1, "Acme", "Designer"), (2, "Acme", "Pilot"), (3, "Beta", "QA"), (4, "Nil", "Cook")], "pos long, company string, role string")
    got = tracker.best_role_url(apps, spark.read.parquet(f"{tmp_path}/listed"))
    assert {(r.pos, r.url) for r in got.collect()} == {(1, "u1"), (2, "u0"), (3, "u3")}
    assert f"{tmp_path}/listed" not in plan(got)


def test_offices_are_made_once(spark, tmp_path):
    rows = [(1, "Acme", "A", "Oslo / Rome", None), (2, "acme", "a", "oslo / Paris", None), (3, "Acme", "B", None, None), (4, "", "A", "X", None)]
    spark.createDataFrame(rows, "seq long, company string, title string, location string, postedDate date").write.parquet(f"{tmp_path}/rows")
    got = snapshot.merge_offices(spark.read.parquet(f"{tmp_path}/rows"))
    assert plan(got).count(f"{tmp_path}/rows") == 2
    assert {(r.seq, r.location) for r in got.collect()} == {(1, "Oslo / Rome / Paris"), (3, None), (4, "X")}


def test_narrow_facts_and_cities(spark):
    schema = "seq long, url string, company string, title string, location string, applyUrl string"
    rows = [(1, "https://acme.com/a", "Acme", "A", "France", "https://x.com/1"), (2, "https://acme.com/b", "Acme", "A", "Spain", "https://x.com/1"),
            (3, "https://gamejobs.co/c", "Acme", "A", "France", ""), (4, "https://gamejobs.co/d", "Acme", "A", "France / Spain", "")]
    df = spark.createDataFrame(rows, schema)
    assert not {"location", "_at"} & set(snapshot.posting_facts(df, codes={"france": "FR", "spain": "ES"}).columns)
    got = {r.seq: r.location for r in snapshot.dedupe_snapshot(df, codes={"france": "FR", "spain": "ES"}).collect()}
    # the survivor's city is that of its widened place
    assert set(got) == {1, 3} and got[1] != "France" and got[3] == "France"


def test_first_wins_ends_without_a_url(spark):
    rows = [(1, None, "Acme", "A"), (2, None, "Acme", "B"), (3, "u", "Acme", "A"), (4, "u", "Acme", "C"), (None, "v", "Acme", "D")]
    got = snapshot.first_wins(spark.createDataFrame(rows, "seq long, url string, company string, title string"))
    assert sorted(r.seq for r in got.collect()) == [1, 4]


def test_state_is_written_once_per_role():
    class State(dict):
        calls = 0

        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            State.calls += 1
            self[key] = value
    reposts = streams._Reposts(90)
    reposts.seen = State()
    batch = pd.DataFrame([("cA", "dev", day, f"u{day % 3}") for day in range(50)] + [("", "dev", 1, "")], columns=["company", "role_key", "number", "mark"])
    out = pd.concat(reposts.handleInputRows((0,), iter([batch]), None))
    assert len(out) == 51 and State.calls == 2
    out = pd.concat(reposts.handleInputRows((0,), iter([batch.iloc[49:50]]), None))
    assert out[["number", "n"]].values.tolist() == [[49, 2]] and State.calls == 3
