import datetime as dt

from pyspark.sql import functions as F

from vacancia.functions import dates, names, numbers, text, urls
from vacancia.functions.patterns import compile_key, keys_hit, match_span

L = F.lit


def test_keys_match_like_ecmascript(values):
    cases = [("Program", "Senior Programmer", True), ("UI", "build guild", False), ("ui", "UI/UX", True), ("C++", "Modern C++ dev", True),
             (", SE", "Stockholm, SE", True), ("SE", "USERS", False), ("/(game|tools?) engineer/", "Tool  Engineer", True),
             ("/game engineer/", "endgame engineer", False), ("malmö", "MALMÖ", True), ("/\\bQA\\b/", "ÉQA x", True),
             ("/a b/", "a b", True), ("/x$/", "x\n", False)]
    got = values(*[keys_hit(L(t), [k]) for k, t, _ in cases])
    assert list(got) == [w for _, _, w in cases]
    assert compile_key("  ") is None and compile_key("/(/") is None


def test_match_span(values):
    assert values(match_span(L("Unreal Engine"), "engine")["start"], match_span(L("Unreal Engine"), "engine")["end"]) == (7, 13)
    assert values(match_span(L("Unreal"), "engine")) == (None,)


def test_text(values):
    got = values(text.decode_entities(L("a&#43;&#x2B;&lt;b&gt;&amp;lt;&nbsp;&#39;")), text.strip_html(L("<script>x</script><p>8&#43; y<br>z</p>")),
                 text.slugify_title(L("Head of R&D, Clash Royale")), text.slugify_title(L("Senior Server Engineer, Tech ")),
                 text.address_city(L("Candy Saga in Stockholm, Stockholm County, Sweden")), text.cut_with_ellipsis(L("x" * 130), 120))
    assert got == ("a++<b>&lt; '", "8+ y z", "head-of-rd-clash-royale", "senior-server-engineer-tech-", "Stockholm, Stockholm County, Sweden",
                   "x" * 117 + "...")
    body = "<p title=\"a—b\">x — y</p><style>—</style>“q” → z"
    assert values(text.ascii_html(L(body))) == ("<p title=\"a—b\">x - y</p><style>—</style>\"q\" to z",)


def test_urls(values):
    u = "https://WWW.Example.com:8080/Jobs/12345-x/?gh_jid=678901&a=1"
    assert values(urls.host(L(u)), urls.posting_id(L(u)), urls.link_key(L(u))) == ("example.com", "678901", "example.com/jobs/12345-x?gh_jid=678901")
    assert values(urls.posting_id(L("https://x.y/jobs/8ac1-uuid")), urls.link_key(L("mailto:a@b.c")), urls.link_key(L("nonsense"))) == (None, None, None)
    codes = values(*[urls.guard_code(L(x)) for x in ("http://172.20.1.1/x", "http://172.40.1.1/", "ftp://a.b/", "x", "https://localhost/")])
    assert codes == ("blocked_host", None, "unsupported_protocol", "invalid_url", "blocked_host")
    assert values(urls.registrable_domain(L("a.b.co.uk")), urls.registrable_domain(L("a.b.com")), urls.studio_slug(L("https://jobs.jobvite.com/amberstudiocareers/x"))) == (
        "b.co.uk", "b.com", "amberstudiocareers")


def test_company_guard(spark):
    cases = [("Warner Bros. Games", "WB Games", True), ("Riot", "Riot Montreal", True), ("Ubisoft", "Riot", False), ("Games", "Studios", False),
             ("Games Inc", "games, inc.", True), ("", "Riot", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    rows = df.withColumns(names.guard_columns("x", F.col("a")) | names.guard_columns("y", F.col("b"))).select(
        "want", names.company_compatible("x", "y").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_roles(spark):
    cases = [("Staff Software Engineer, API", "Staff Software Engineer, Kubernetes Platform", False), ("Senior Gameplay Programmer", "Gameplay Programmer (Remote)", True),
             ("Artist", "Artist", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r.want == r.got for r in names.with_same_role(df, "a", "b", "got").collect())


def test_dates(values):
    got = values(dates.iso_instant(L("1700000000")), dates.iso_instant(L("1700000000000")), dates.iso_instant(L("2024-01-02 03:04:05 UTC")),
                 dates.iso_instant(L("Sat, 13 Jun 2026 00:00:00 GMT")), dates.iso_instant(L("soon")), dates.strict_date(L(" 2024-02-30 ")), dates.iso_week(L("2024-12-30").cast("date")))
    assert got == ("2023-11-14T22:13:20.000Z", "2023-11-14T22:13:20.000Z", "2024-01-02T03:04:05.000Z", "2026-06-13T00:00:00.000Z", "", None, "2025-W01")
    now = L("2024-03-10 12:00:00")
    assert values(dates.relative_instant(L("3 weeks ago"), now), dates.relative_instant(L("an hour ago"), now)) == (dt.datetime(2024, 2, 18, 12), dt.datetime(2024, 3, 10, 11))


def test_numbers(values):
    assert values(numbers.first_number(L("**4.2/5**")), numbers.first_number(L("N/A")), numbers.out_of_five(L("4/5")), numbers.leading_number(L("4.5/5")), numbers.leading_number(L("x4"))) == (
        4.2, 0.0, 4.0, 4.5, None)
