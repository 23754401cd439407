from pyspark.sql import functions as F

from vacancia.sources import feeds, files, shapes, sinks


def body(spark, *texts):
    return spark.createDataFrame([("Acme", t) for t in texts], "company string, body string")


def test_broken_json_gives_no_rows(spark):
    got = feeds.json_feed(body(spark, "{oops", '{"jobs": null}', '{"jobs": [{"title": "A", "absolute_url": "https://a"}, {"title": "no url"}]}'), feeds.FEEDS["greenhouse"])
    assert [(r.title, r.url, r.postedDate) for r in got.collect()] == [("A", "https://a", "")]


def test_smartrecruiters_url(spark):
    text = '{"content": [{"id": "7", "name": "QA (Dont Nod)", "ref": "https://api.smartrecruiters.com/v1/companies/DONTNOD/postings/7", "location": {"city": "Paris", "remote": true}}]}'
    r = feeds.json_feed(body(spark, text), feeds.FEEDS["smartrecruiters"]).first()
    assert (r.url, r.location, r.workMode) == ("https://jobs.smartrecruiters.com/DONTNOD/7-qa-dont-nod", "Paris", "remote")


def test_slug_fallback(values):
    p = feeds.slug_posting(F.lit("https://gamejobs.co/Lead-Artist-at-Sea-at-Netflix-8057"))
    assert values(p["title"], p["company"]) == ("Lead Artist at Sea", "Netflix")
    p = feeds.slug_posting(F.lit("https://gamejobs.co/Lead-Artist"))
    assert values(p["title"], p["company"]) == ("Lead Artist", "")
    assert values(feeds.dated_slug_title(F.lit("https://g.com/jobs/senior-artist-0a1b2c3d4"))) == ("Senior Artist",)


def test_remote_job_title(spark):
    xml = "<item><title>Acme is hiring a QA Lead (Remote Job)</title><link>https://r/1</link><pubDate>Sat, 13 Jun 2026 00:00:00 GMT</pubDate></item>"
    r = feeds.rss_feed(body(spark, xml), feeds.REMOTE_JOB_TITLE, always_remote=True).first()
    assert (r.title, r.company, r.workMode, r.postedDate) == ("QA Lead", "Acme", "remote", "2026-06-13T00:00:00.000Z")


def test_tsv_with_missing_columns(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("# ledger\nacme\tAcme\t2\tlever\tashby,breezy\t2024-01-01\nbeta\tBeta\t1\t\t\t\tverify\tlever\n")
    rows = {r.key: r for r in files.read_tsv(spark, str(tmp_path), files.LEDGER).collect()}
    assert rows["acme"].hit_conf is None and rows["acme"].missed == "ashby,breezy" and rows["beta"].rejected == "lever"


def test_report_summary_wins(spark):
    text = '## Machine Summary\n\n```yaml\ncompany: "Acme"\nscore: 4.4\nhard_stops: []\nsoft_gaps:\n  - "No healthcare"\ntop_strengths:\n  - "Pipelines"\nnext_action: "Follow up on ticket #42"\n```\n| Global | 3/5 |\n'
    r = files.report_rows(spark.createDataFrame([("p", text)], "path string, content string")).first()
    assert (r.company, r.scores["global"], r.next_action, r.top_strengths) == ("Acme", 4.4, "Follow up on ticket #42", ["Pipelines"])
    assert [g.description for g in r.gaps] == ["No healthcare"]


def test_snapshot_sink(spark, tmp_path):
    df = spark.range(5).select(F.col("id").cast("string").alias("url"))
    header = sinks.write_snapshot(df, str(tmp_path), F.lit("now")).first()
    assert header["count"] == 5 and spark.read.json(f"{tmp_path}/jobs").count() == 5


def test_recipe_html(spark):
    filler = "x " * 400
    page = ("<ul><li class='job open' data-id=7><h3>Artist &amp; <b>Lead</b></h3><a href=\"/j/7\">more</a><span class=\"place\">Oslo</span></li>"
            "<li class=\"ad\"><h3>No</h3><a href='/no'>x</a></li>"
            f"<li class=\"job\" data-id='8'><h3>Coder {filler}<a href=https://o.example/8>go</a><em>Studio</em></li></ul>")
    pages = spark.createDataFrame([("Acme", page), ("Nil", None), (None, "")], "company string, body string")
    recipe = {"list_selector": "li.job", "fields": {"title": "h3", "url": "a@href", "location": ".place", "company": "em"}, "url_base": "https://b.example"}
    got = sorted(tuple(r) for r in feeds.recipe_html(pages, recipe).collect())
    assert got == [("Artist & Lead", "https://b.example/j/7", "Acme", "Oslo"), ("Coder " + filler + "go Studio", "https://o.example/8", "Studio", "")]
    own = feeds.recipe_html(pages, {"list_selector": "li[data-id=8]", "fields": {"title": "em", "url": "@data-id"}, "url_base": "u/"}).collect()
    assert [tuple(r) for r in own] == [("Studio", "u/8", "Acme", "")]


def test_shapes_read_each_field_alone(spark):
    good = ('{"offers": [{"title": "A", "careers_url": "https://x.recruitee.com/o/a", "city": "Gent", "country": null, "remote": true, "hybrid": true, "published_at": "soon"},'
            ' {"title": {"no": 1}, "url": "http://x.recruitee.com/o/b", "department": 7}, null, {}]}')
    rows = shapes.postings(body(spark, good, '{"offers": []}'), shapes.SHAPES["recruitee"]).collect()
    assert (rows[0].title, rows[0].url, rows[0].location, rows[0].workMode, rows[0].postedDate) == ("A", "https://x.recruitee.com/o/a", "Gent", "remote", "")
    assert [(r.url, r.workMode) for r in rows[1:]] == [("", ""), ("", "")]


def test_shapes_keep_the_first_of_a_document(spark):
    items = ",".join('{"slug": "%s", "position": "%s", "city": "Minsk"}' % x for x in [("b", ""), ("b", "first"), ("a", "other"), ("b", "second"), ("no/slug", "x")])
    rows = shapes.postings(body(spark, '{"items": [%s]}' % items, '{"items": [%s]}' % items), shapes.SHAPES["huntflow"]).collect()
    assert [(r.url, r.title) for r in rows] == [("/vacancy/b", "first"), ("/vacancy/a", "other")] * 2


def test_shapes_reject_what_is_no_list(spark):
    bad = [None, "", "{oops", '{"items": {}}', "[]", "null", '{"items": null}']
    got = shapes.rejected(body(spark, *bad, '{"items": []}'), shapes.SHAPES["teamtailor"]).collect()
    assert [(r.body, r.reason) for r in got] == list(zip(bad, ["no body", "no body", "not JSON", "no list", "no list", "no list", "no list"]))
    assert shapes.postings(body(spark, *bad), shapes.SHAPES["teamtailor"]).count() == 0


def test_mode_labels(spark):
    labels = ["Hybrid (Southampton, GB)", "On-site(Rome)", "Remote", "Remote work", "Lyon (Remote)", ""]
    text = "[%s]" % ",".join('{"name": "n", "url": "u", "workLocations": ["%s"]}' % x for x in labels)
    got = shapes.postings(body(spark, text), shapes.SHAPES["rippling"]).collect()
    assert [(r.location, r.workMode) for r in got] == [("Southampton, GB", "hybrid"), ("Rome", "onsite"), ("", "remote"), ("Remote work", ""), ("Lyon (Remote)", ""), ("", "")]


def test_islands(spark):
    page = '<input type="hidden" value="[{&quot;id&quot;: 7, &quot;Posting_Title&quot;: &quot;A &amp;amp; B&quot;}, {&quot;id&quot;: &quot;a/b&quot;, &quot;Posting_Title&quot;: &quot;C&quot;}]" id="jobs">'
    got = shapes.postings(body(spark, page, "<html>", None), shapes.SHAPES["zohorecruit"]).collect()
    assert [(r.url, r.title) for r in got] == [("/jobs/Careers/7", "A &amp; B")]
    text = '<script id="__NEXT_DATA__">{"props": {"pageProps": {"dehydratedState": {"queries": [{"queryKey": ["x"], "state": {"data": [{"openingId": 1, "title": "no"}]}}]}}}}</script>'
    assert [r.reason for r in shapes.rejected(body(spark, text), shapes.SHAPES["greetinghr"]).collect()] == ["no list"]


def test_shapes_parse_a_body_once_and_read_a_path_once(spark):
    page = '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"dehydratedState":{"queries":[{"queryKey":["openings"],"state":{"data":[{"openingId":7,"title":"Dev"},{"openingId":7,"title":"Again"},null]}}]}}}}</script>'
    bodies = spark.createDataFrame([("Co", "https://x", page), ("No", "https://x", "<p>"), ("Null", "https://x", None)], "company string, origin string, body string").repartition(1)
    out = shapes.postings(bodies, shapes.SHAPES["greetinghr"])
    assert [(r.title, r.url, r.company, r.workMode) for r in out.collect()] == [("Dev", "https://x/o/7", "Co", "")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("NEXT_DATA") == plan.count("$.openingId") == plan.count("$.title") == 1
