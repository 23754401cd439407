"""Source, sink and extension-point queries. Bodies are built by Spark from the given tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..functions.names import import_key
from ..operators import companies, snapshot, tracker
from ..plans import plugins
from ..session import checkpoint_dir
from ..sources import feeds, files, sinks
from .filters import BATCH_SQL, batch
from .joins import listed
from .registry import query

C = F.col


def items(t):
    """Order lines with their part, one array per order (an order has a handful of lines)."""
    line = F.struct("l_linenumber", "l_partkey", "p_name", "p_type", "l_shipdate", "l_quantity", "l_suppkey")
    return (t.read("lineitem").join(t.read("part"), C("l_partkey") == C("p_partkey"))
            .groupBy("l_orderkey").agg(F.collect_list(line).alias("items"))
            .select(F.concat(F.lit("Co"), C("l_orderkey").cast("string")).alias("company"), "l_orderkey", "items"))


LINES_SQL = """ln AS (SELECT *, 'Co' || l_orderkey AS company, strftime(l_shipdate, '%Y-%m-%dT00:00:00.000Z') AS iso FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def payload(t, each, wrap=lambda rows: rows):
    """Landed documents: ``each`` renders one line, ``wrap`` the document around them."""
    return items(t).select("company", wrap(F.transform("items", each)).alias("body"))


def text_payload(t, each, head="", tail=""):
    return payload(t, each, lambda rows: F.concat(F.lit(head), F.array_join(rows, "\n"), F.lit(tail)))


def key(x):
    return x["l_partkey"].cast("string")


def day(x, fmt="yyyy-MM-dd"):
    return F.date_format(x["l_shipdate"], fmt)


@query("src01_json_feed", f"""WITH {LINES_SQL} SELECT p_name AS title, 'https://boards.greenhouse.io/x/jobs/' || l_partkey AS url, company, p_type AS location, iso AS "postedDate", 'Make a ' || p_name || ' & more' AS description FROM ln""")
def src01(t):
    body = payload(t, lambda x: F.struct(
        x["p_name"].alias("title"), F.concat(F.lit("https://boards.greenhouse.io/x/jobs/"), key(x)).alias("absolute_url"), F.struct(x["p_type"].alias("name")).alias("location"),
        F.when(x["l_quantity"] > 25, day(x)).alias("first_published"), day(x, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        F.concat(F.lit("&lt;p&gt;Make a &lt;b&gt;"), x["p_name"], F.lit("&lt;/b&gt; &amp;amp; more&lt;/p&gt;")).alias("content")),
        lambda rows: F.to_json(F.struct(rows.alias("jobs"))))
    return feeds.json_feed(body, feeds.FEEDS["greenhouse"]).select("title", "url", "company", "location", "postedDate", "description")


@query("src01_json_feed_list", f"""WITH {LINES_SQL} SELECT p_name AS title, 'https://jobs.lever.co/x/' || l_partkey AS url, company, strftime(l_shipdate + INTERVAL 10 YEAR, '%Y-%m-%dT00:00:00.000Z') AS "postedDate", CASE WHEN l_quantity > 25 THEN 'remote' ELSE '' END AS "workMode", p_type AS department FROM ln""")
def src01b(t):
    body = payload(t, lambda x: F.struct(
        x["p_name"].alias("text"), F.concat(F.lit("https://jobs.lever.co/x/"), key(x)).alias("hostedUrl"), F.unix_millis((x["l_shipdate"] + F.make_interval(years=F.lit(10))).cast("timestamp")).alias("createdAt"),
        F.when(x["l_quantity"] > 25, F.lit("Remote")).otherwise(F.lit("unspecified")).alias("workplaceType"), F.struct(F.lit("").alias("department"), x["p_type"].alias("team")).alias("categories")),
        lambda rows: F.to_json(rows))
    return feeds.json_feed(body, feeds.FEEDS["lever"]).select("title", "url", "company", "postedDate", "workMode", "department")


@query("src02_search_feed", f"""WITH {LINES_SQL} SELECT p_name AS title, 'https://board.example.com/' || l_partkey AS url, p_type AS company, CASE WHEN l_quantity > 25 THEN 'Town, ' || p_brand ELSE p_brand END AS location, iso AS "postedDate",
    CASE WHEN l_quantity > 40 THEN 'https://apply.example.com/' || l_partkey END AS "applyUrl" FROM ln""")
def src02(t):
    brands = t.read("part").select(C("p_partkey").alias("bk"), "p_brand")
    rows = t.read("lineitem").join(t.read("part"), C("l_partkey") == C("p_partkey"))
    place = F.array(F.struct(F.when(C("l_quantity") > 25, F.lit("Town")).otherwise(C("p_brand")).alias("title"),
                             F.array(F.struct(F.lit("region").alias("type"), F.lit("R").alias("title")), F.struct(F.lit("country").alias("type"), C("p_brand").alias("title"))).alias("parents")))
    doc = F.struct(C("p_name").alias("title"), F.concat(F.lit("https://board.example.com/"), C("l_partkey").cast("string")).alias("url"), F.unix_timestamp(C("l_shipdate").cast("timestamp")).alias("postDate"),
                   F.when(C("l_quantity") > 40, F.concat(F.lit("https://apply.example.com/"), C("l_partkey").cast("string"))).otherwise(F.lit("jobs@x")).alias("jobApplicationUrl"),
                   F.struct(C("p_type").alias("title")).alias("jobCompany"), place.alias("jobLocation"))
    docs = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct(doc.alias("document"))).alias("hits"))
    return feeds.search_feed(docs.select(F.to_json(F.struct(F.array(F.struct("hits")).alias("results"))).alias("body"))).select(
        "title", "url", "company", "location", "postedDate", "applyUrl")


@query("src03_position_variants", f"""WITH {LINES_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY l_quantity = 1 DESC) AS rn, min(l_quantity) OVER (PARTITION BY l_orderkey, p_type) AS q FROM ln)
  SELECT company, p_type AS base, count(*) AS n FROM v WHERE rn = 1 GROUP BY company, p_type""")
def src03(t):
    body = payload(t, lambda x: F.struct(
        F.concat(x["p_type"], F.when(x["l_quantity"] > 25, F.concat(F.lit("-"), key(x))).otherwise(F.lit(""))).alias("uid"), x["p_name"].alias("name"),
        F.concat(F.lit("https://www.comeet.com/jobs/"), key(x)).alias("url_active_page"), F.lit("Hybrid").alias("workplace_type")), lambda rows: F.to_json(rows))
    return feeds.position_variants(body).groupBy("company", F.substring_index("uid", "-", 1).alias("base")).agg(F.count("*").alias("n"))


@query("src04_rss_feed", f"""WITH {LINES_SQL} SELECT CASE WHEN l_quantity > 40 THEN 'Just ' || p_name || ' & co' ELSE p_name END AS title, 'https://rss.example.com/' || l_partkey AS url, CASE WHEN l_quantity > 40 THEN '' ELSE p_type END AS company,
    CASE WHEN l_quantity > 25 AND l_quantity <= 40 THEN 'Town' ELSE '' END AS location, CASE WHEN l_quantity <= 25 THEN 'remote' ELSE '' END AS "workMode", iso AS "postedDate" FROM ln""")
def src04(t):
    def item(x):
        title = (F.when(x["l_quantity"] > 40, F.concat(F.lit("Just "), x["p_name"], F.lit(" &amp; co"))).otherwise(F.concat(
            x["p_type"], F.lit(" is hiring a "), x["p_name"], F.when(x["l_quantity"] > 25, F.lit(" to work from Town")).otherwise(F.lit(" to work remotely")))))
        return F.concat(F.lit("<item><title><![CDATA["), title, F.lit("]]></title><link>https://rss.example.com/"), key(x), F.lit("</link><pubDate>"), day(x, "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT</pubDate></item>"))
    return feeds.rss_feed(text_payload(t, item, "<rss>", "</rss>"))


@query("src05_html_listing", """WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(<a href=.*?</a>)</li>', 1)) AS block FROM pages)
  SELECT page_id, regexp_extract(block, 'href="([^"]+)"', 1) AS url, count(*) AS n FROM b WHERE regexp_extract(block, '>([^<]+)<', 1) <> '' GROUP BY ALL""")
def src05(t):
    pages = t.pages.select(C("page_id").cast("string").alias("company"), C("html").alias("body"))
    listing = feeds.HtmlListing(r"(?s)<li>(<a href=.*?</a>)</li>", {"title": ">([^<]+)<", "url": 'href="([^"]+)"'})
    return feeds.html_listing(pages, listing).groupBy(C("company").cast("bigint").alias("page_id"), "url").agg(F.count("*").alias("n"))


@query("src06_json_island", f"""WITH {LINES_SQL} SELECT p_name || ' "A&B"' AS title, 'https://zoho.example.com/jobs/Careers/' || l_partkey AS url, company FROM ln WHERE l_quantity > 10""")
def src06(t):
    body = payload(t, lambda x: F.struct(key(x).alias("id"), F.concat(x["p_name"], F.lit(' "A&B"')).alias("Posting_Title"), (x["l_quantity"] > 10).alias("Publish")),
                   lambda rows: F.concat(F.lit('<html><input type="hidden" id="jobs" value="'), F.replace(F.replace(F.to_json(rows), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&#34;")), F.lit('"></html>')))
    return feeds.json_island(body, r'(?i)<input[^>]*\bid="jobs"[^>]*\bvalue="([^"]*)"', "array<struct<id:string,Posting_Title:string,Publish:boolean>>",
                             {"title": "item.Posting_Title", "url": "concat('https://zoho.example.com/jobs/Careers/', item.id)", "publish": "string(item.Publish)"},
                             "title <> '' and publish <> 'false'").select("title", "url", "company")


def _sitemap(t):
    def entry(x):
        slug = F.concat(F.replace(x["p_name"], F.lit(" "), F.lit("-")), F.lit("-at-home-at-"), F.initcap(x["p_type"]), F.when(x["l_quantity"] > 30, F.concat(F.lit("-"), key(x))).otherwise(F.lit("")))
        return F.concat(F.lit("<url><loc>https://gamejobs.co/"), F.when(x["l_quantity"] < 5, F.lit("sitemap.xml")).otherwise(slug), F.lit("</loc><lastmod>2024-01-02</lastmod></url>"))
    return text_payload(t, entry, "<urlset>", "</urlset>")


SITEMAP_SQL = f"""{LINES_SQL}, sm AS (SELECT DISTINCT replace(p_name, ' ', '-') || '-at-home-at-' || left(p_type, 1) || lower(substr(p_type, 2)) || CASE WHEN l_quantity > 30 THEN '-' || l_partkey ELSE '' END AS slug, p_name || ' at home' AS title, left(p_type, 1) || lower(substr(p_type, 2)) AS company FROM ln WHERE l_quantity >= 5)"""


@query("src07_sitemap_postings", f"WITH {SITEMAP_SQL} SELECT 'https://gamejobs.co/' || slug AS url, title, company, '2024-01-02T00:00:00.000Z' AS \"postedDate\" FROM sm")
def src07(t):
    return feeds.sitemap_postings(_sitemap(t)).select("url", "title", "company", "postedDate")


@query("src07_sitemap_index", f"WITH {LINES_SQL} SELECT DISTINCT 'https://x.example.com/sitemaps/jobs-' || p_type || '.xml' AS url FROM ln WHERE l_quantity > 25")
def src07b(t):
    body = text_payload(t, lambda x: F.concat(F.lit("<sitemap><loc>https://x.example.com/sitemaps/"), F.when(x["l_quantity"] > 25, F.lit("jobs")).otherwise(F.lit("pages")), F.lit("-"), x["p_type"], F.lit(".xml</loc></sitemap>")))
    return feeds.sitemap_index(body, "jobs")


@query("src08_twin_slugs", f"WITH {SITEMAP_SQL} SELECT slug FROM sm WHERE NOT (regexp_matches(slug, '-[0-9]+$') AND regexp_replace(slug, '-[0-9]+$', '') IN (SELECT slug FROM sm))")
def src08(t):
    return snapshot.twin_slugs(feeds.sitemap_postings(_sitemap(t)).select("slug"))


@query("src09_markdown_table", f"""WITH {LINES_SQL} SELECT p_name AS title, 'https://apply.workable.com/x/' || l_partkey AS url, company, 'Town' AS location, CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type END AS department, iso AS "postedDate" FROM ln""")
def src09(t):
    def row(x):
        return F.concat(F.lit("| "), x["p_name"], F.when(x["l_quantity"] > 25, F.lit(" | Extra")).otherwise(F.lit("")), F.lit(" | "), F.when(x["p_type"] == "PROMO", F.lit("Department")).otherwise(x["p_type"]),
                        F.lit(" | Town | Full | Remote | "), day(x), F.lit(" | [View](https://apply.workable.com/x/"), key(x), F.lit(".md) |"))
    return feeds.markdown_table(text_payload(t, row, "| Title | Department | Location | Type | Mode | Posted | Details |\n|---|\n"))


@query("src10_recipe_json", f"""WITH {LINES_SQL} SELECT p_name AS title, CASE WHEN l_quantity > 25 THEN 'https://own.example.com/job/' || l_partkey ELSE 'https://own.example.com/en/' || p_type || '/' || l_partkey END AS url, company, CASE WHEN l_quantity > 25 THEN 'Town, City' ELSE 'Hall' END AS location FROM ln""")
def src10(t):
    body = payload(t, lambda x: F.concat(
        F.lit('{"head": {"name": "'), x["p_name"], F.lit('"}, "id": '), key(x), F.lit(', "kind": "'), x["p_type"], F.lit('"'),
        F.when(x["l_quantity"] > 25, F.concat(F.lit(', "link": "/job/'), key(x), F.lit('", "loc": [{"name": "Town"}, "City"]'))).otherwise(F.lit(', "loc": {"text": "Hall"}')), F.lit("}")),
        lambda rows: F.concat(F.lit('{"data": {"list": ['), F.array_join(rows, ","), F.lit("]}}")))
    recipe = {"list_path": "data.list", "fields": {"title": "head.name", "url": "link", "location": "loc"}, "url_template": "/en/{kind}/{id}", "url_base": "https://own.example.com"}
    return feeds.recipe_json(body, recipe)


@query("src11_recipe_html", """WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(<a href=.*?</a>)', 1)) AS block FROM pages)
  SELECT CAST(page_id AS VARCHAR) AS company, 'https://x.example.com' || regexp_extract(block, 'href="([^"]+)"', 1) AS url, count(*) AS n FROM b WHERE regexp_extract(block, '>([^<]+)<', 1) <> '' GROUP BY ALL""")
def src11(t):
    pages = t.pages.select(C("page_id").cast("string").alias("company"), C("html").alias("body"))
    return feeds.recipe_html(pages, {"list_selector": "li", "fields": {"title": "a", "url": "a@href"}, "url_base": "https://x.example.com"}).groupBy("company", "url").agg(F.count("*").alias("n"))


@query("src12_json_ld", """SELECT page_id, 'Job ' || page_id AS title, CASE WHEN page_id > 100 THEN 'Org' ELSE 'Plain' END AS company, CASE WHEN page_id > 100 THEN 'Town, DE' ELSE 'City, X' END AS location, CASE WHEN page_id > 100 THEN 'remote' ELSE '' END AS "workMode",
    '2024-01-02T00:00:00.000Z' AS "postedDate" FROM pages""")
def src12(t):
    k = C("page_id").cast("string")
    big = C("page_id") > 100
    node = F.when(big, F.concat(F.lit('{"@graph": [{"@type": "Organization"}, {"@type": ["JobPosting", "X"], "title": "Job '), k, F.lit('", "datePosted": "2024-01-02", "jobLocationType": "TELECOMMUTE", "hiringOrganization": {"name": " Org "}, "jobLocation": [{"address": {"addressLocality": "Town", "addressRegion": "Town", "addressCountry": {"name": "DE"}}}]}]}'))).otherwise(
        F.concat(F.lit('{"@type": "JobPosting", "title": " Job '), k, F.lit('", "datePosted": "2024-01-02T00:00:00Z", "hiringOrganization": "Plain", "jobLocation": {"address": "Team Saga in City, X"}}')))
    body = F.concat("html", F.lit('<script type="application/ld+json">{"@type": "BreadcrumbList"}</script><script type="application/ld+json">'), node, F.lit("</script>"))
    return feeds.json_ld(t.pages.select("page_id", body.alias("body"))).select("page_id", "title", "company", "location", "workMode", "postedDate")


@query("src13_label_values", f"WITH {LINES_SQL} SELECT company, p_type AS level, count(*) AS n FROM ln GROUP BY ALL")
def src13(t):
    rows = items(t).select("company", F.explode("items").alias("x"))
    body = F.concat(F.lit("<dl><dt>Level</dt> <dd>"), "x.p_type", F.lit("</dd><dt>Location</dt><dd>Hybrid&nbsp;(<b>Town</b>)</dd><dt>LEVEL</dt><dd>other</dd></dl>"))
    return rows.withColumn("m", feeds.label_values(body)).filter("m['location'] = 'Hybrid ( Town )'").groupBy("company", C("m")["level"].alias("level")).agg(F.count("*").alias("n"))


@query("src14_apply_link", """SELECT page_id, CASE WHEN contains(url, '?page') THEN '' WHEN contains(url, 'utm') THEN 'https://ats.example.com/j/' || page_id WHEN contains(url, '#') THEN '' ELSE 'https://ats.example.com/?a=1&b=' || page_id END AS apply FROM pages""")
def src14(t):
    k, u = C("page_id").cast("string"), C("url")
    href = (F.when(F.contains(u, F.lit("?page")), F.lit("/cdn-cgi/l/email")).when(F.contains(u, F.lit("utm")), F.concat(F.lit("https://jsv3.recruitics.com/redirect?rx_url=https%3A%2F%2Fats.example.com%2Fj%2F"), k))
            .when(F.contains(u, F.lit("#")), F.lit("https://www.gamejobs.co/login")).otherwise(F.concat(F.lit("https://ats.example.com/?a=1&amp;b="), k)))
    body = F.concat("html", F.lit('<a href="https://no.example.com">Apply now</a><a class="x" href="'), href, F.lit('"><b>Apply</b> </a>'))
    return t.pages.select("page_id", feeds.apply_link(body, "gamejobs.co").alias("apply"))


@query("src15_parser_rows", "SELECT c_name AS title, 'https://p.example.com/' || c_custkey AS url, c_mktsegment AS company FROM customer WHERE c_acctbal > 0")
def src15(t):
    rows = t.read("customer").select(F.lit("").alias("title"), F.concat(F.lit(" "), "c_name").alias("name"), F.when(C("c_acctbal") > 0, F.concat(F.lit("https://p.example.com/"), C("c_custkey").cast("string"))).alias("job_url"), C("c_mktsegment").alias("company"))
    return feeds.parser_rows(rows).select("title", "url", "company")


def lines(t):
    """Tracker file: one pipe row per application, plus header and short rows."""
    row = F.concat_ws(" | ", F.lit("|").substr(1, 0), C("num").cast("string"), "date", "company", "role", "score", "status", "pdf", "report", "notes", F.lit("").substr(1, 0))
    head = t.read("region").select(F.when(C("r_regionkey") > 2, F.lit("| # | Date | Company | Role | Score | Status | PDF | Report | Notes |")).otherwise(F.lit("| 7 | short |")).alias("line"))
    return t.application.select(F.concat(F.trim(row), F.lit(" |")).alias("line")).select(F.regexp_replace("line", r"^\| ?", "| ").alias("line")).unionByName(head)


@query("src16_tracker_rows", "SELECT num, date, company, role, score, status, pdf, report, notes FROM application")
def src16(t):
    return files.tracker_rows(lines(t))


@query("src17_additions", """SELECT file_seq, num, company, score, CASE replace(status, '**', '') WHEN 'Evaluated' THEN 'Evaluated' WHEN 'monitor' THEN 'SKIP' WHEN 'Hold' THEN 'Evaluated' WHEN 'Entrevista' THEN 'Interview' ELSE 'Discarded' END AS status, CASE WHEN file_seq > 500 THEN 'added' ELSE '' END AS notes FROM addition WHERE num <> 0""")
def src17(t):
    sep, a = F.lit("\t"), t.addition
    plain = F.replace("status", F.lit("**"), F.lit(""))
    tab = F.concat_ws("\t", C("num").cast("string"), "date", "company", "role", plain, "score", "pdf", F.lit("r"), F.when(C("file_seq") > 500, C("notes")))
    swapped = F.concat_ws("\t", C("num").cast("string"), "date", "company", "role", "score", plain, "pdf", F.lit("r"), F.when(C("file_seq") > 500, C("notes")))
    pipe = F.concat(F.lit("| "), F.concat_ws(" | ", C("num").cast("string"), "date", "company", "role", "score", "status", "pdf", F.lit("r"), F.when(C("file_seq") > 500, C("notes"))), F.lit(" |"))
    body = F.when(F.startswith("score", F.lit("4")), pipe).when(F.startswith("score", F.lit("3")), swapped).otherwise(tab)
    return files.addition_rows(a.select("file_seq", body.alias("content"))).select("file_seq", "num", "company", "score", "status", "notes")


@query("src18_follow_up_rows", "SELECT appNum AS \"appNum\", date, count(*) AS n FROM follow_up GROUP BY ALL")
def src18(t):
    body = t.follow_up.select(F.concat(F.lit("| 1 | "), C("appNum").cast("string"), F.lit(" | "), "date", F.lit(" | C | R | mail | Ann |")).alias("line"))
    return files.follow_up_rows(body).groupBy("appNum", "date").agg(F.count("*").alias("n"))


def scratch(t, name):
    """A fresh folder below the session's checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("src19_tsv_lists", f"WITH {BATCH_SQL} SELECT id, url, source, notes FROM bi")
def src19(t):
    folder = scratch(t, "batch")
    batch(t).write.csv(folder, sep="\t", quote="")
    return files.read_tsv(t.spark, folder, files.BATCH_INPUT)


@query("src20_batch_notes", f"""WITH {BATCH_SQL} SELECT id, CASE WHEN contains(notes, '| http') THEN split_part(notes, '| ', 3) ELSE url END AS job_url, CASE WHEN contains(notes, ' @ ') THEN regexp_extract(notes, ' @ ([^|]+) \\|', 1) END AS company, CASE WHEN contains(notes, ' @ ') THEN regexp_extract(notes, '^(.*) @ ', 1) END AS role FROM bi""")
def src20(t):
    return tracker.parse_batch_notes(batch(t))


@query("src21_url_harvest", """SELECT DISTINCT unnest(regexp_extract_all(html || ' https://end.example.com/' || page_id || ') ', 'https?://[^\\s|)]+')) AS url FROM pages""")
def src21(t):
    return files.harvest_urls(t.pages.select(F.concat("html", F.lit(" https://end.example.com/"), C("page_id").cast("string"), F.lit(") ")).alias("line")))


@query("src22_company_roles", "SELECT DISTINCT lower(company) AS company, lower(role) AS role FROM application")
def src22(t):
    return files.company_roles(lines(t).filter("not contains(line, 'short')"))


def report_texts(t):
    """Markdown reports of the applications; those of pending orders carry no summary."""
    r = t.report
    summary = F.concat(F.lit("## Machine Summary\n\n```yaml\ncompany: \"Acme #1\"\narchetype: "), F.coalesce("archetype", F.lit("")), F.lit("\nscore: "), C("score").cast("string"),
                       F.lit("\nhard_stops: []\nsoft_gaps:\n  - \"No domain\"\ntop_strengths:\n  - A\n  - 'B'\n```\n"))
    body = F.concat(
        F.lit("# Evaluation\n\n**URL:** https://jobs.example.com/"), F.regexp_extract("path", r"(\d+)", 1), F.lit("\n**Batch ID:** 7\n\n"), F.when(C("severity") == "Hard", summary).otherwise(F.lit("")),
        F.lit("\n| Field | Value |\n|---|---|\n| **Archetype** | Table |\n| **Remote** | "), F.coalesce(F.nullif("remote", F.lit("")), F.lit("-")), F.lit(" |\n| **Team size** | "), "teamSize",
        F.lit(" |\n| **TL;DR** | "), F.repeat(F.lit("long text "), 15), F.lit(" |\n| Global | 3.5/5 |\n| Red flags | -1 |\n\n| Gap | Severity | Mitigation |\n|---|---|---|\n| "), "gap", F.lit(" | "), "severity",
        F.lit(" | Learn |\n| no DOMAIN | Low | x |\n\n## End\n"))
    return r.select("path", body.alias("content"))


@query("src23_report_fields", """SELECT path, CASE WHEN severity = 'Hard' THEN 'Acme #1' END AS company, CASE WHEN severity = 'Hard' AND coalesce(archetype, '') <> '' THEN archetype ELSE 'Table' END AS archetype, CASE WHEN remote = '' THEN '-' ELSE remote END AS remote, teamSize AS team_size,
    CASE WHEN severity = 'Hard' THEN score ELSE 3.5 END::DOUBLE AS score, (-1.0)::DOUBLE AS red_flags, CASE WHEN severity = 'Hard' THEN 'A|B' ELSE '' END AS strengths FROM report""")
def src23(t):
    return files.report_rows(report_texts(t)).select("path", "company", "archetype", "remote", "team_size", C("scores.global").alias("score"), C("scores.redFlags").alias("red_flags"), F.array_join("top_strengths", "|").alias("strengths"))


@query("src24_gap_table", """SELECT path, CASE WHEN severity = 'Hard' THEN 'No domain=soft gap|' ELSE '' END || gap || '=' || lower(severity) || CASE WHEN severity = 'Hard' THEN '' ELSE '|no DOMAIN=low' END AS gaps FROM report""")
def src24(t):
    return files.report_rows(report_texts(t)).select("path", F.array_join(F.transform("gaps", lambda g: F.concat(g["description"], F.lit("="), g["severity"])), "|").alias("gaps"))


@query("src25_header_preview", """SELECT path, left(repeat('long text ', 15), 117) || '...' AS tldr, CASE WHEN remote = '' THEN '-' ELSE remote END AS remote, 'https://jobs.example.com/' || regexp_extract(path, '([0-9]+)', 1) AS url, '7' AS batch_id FROM report""")
def src25(t):
    return report_texts(t).select("path", files.header_preview(C("content")).alias("h")).select("path", "h.tldr", "h.remote", "h.url", "h.batch_id")


@query("src26_directory_names", "SELECT DISTINCT c_name || ' & Co' AS name FROM customer")
def src26(t):
    body = t.read("customer").select(F.lit("").alias("company"), F.concat(F.lit('<li><a class="companyLink" href="#">'), "c_name", F.lit(" &amp; Co</a></li>")).alias("body"))
    return feeds.directory_names(body, r'class="companyLink"[^>]*>([^<]+)</a>').distinct()


@query("src26_directory_cells", """SELECT DISTINCT CASE c_mktsegment WHEN 'BUILDING' THEN 'Big Builders' WHEN 'MACHINERY' THEN 'Machine' ELSE 'Plain' END AS name FROM customer WHERE c_mktsegment <> 'FURNITURE'""")
def src26b(t):
    cell = F.when(C("c_mktsegment") == "BUILDING", "Big Builders Studio AB").when(C("c_mktsegment") == "MACHINERY", "Machine – Saga Ltd").when(C("c_mktsegment") == "FURNITURE", "ALL CAPS AB").otherwise("Plain och Simple Inc")
    cell = F.when(C("c_mktsegment") == "BUILDING", F.lit("Big Builders AB")).otherwise(cell)
    return feeds.directory_cells(t.read("customer").select(F.concat(F.lit("COUNTY 12   "), cell, F.lit("    www.example.com\nprose, more prose")).alias("body"))).distinct()


# --- sinks --------------------------------------------------------------------------------------

@query("snk01_snapshot", "SELECT url, title, company FROM posting WHERE NOT filtered")
def snk01(t):
    folder = scratch(t, "snapshot")
    sinks.write_snapshot(t.posting.filter("not filtered").select("url", "title", "company"), folder, F.lit("2024-01-01T00:00:00Z"))
    return t.spark.read.schema("url string, title string, company string").json(f"{folder}/jobs")


@query("snk02_history_append", "SELECT status, portal, count(*) AS n, count(DISTINCT url) AS urls FROM (SELECT url, 'skipped_expired' AS status, department AS portal FROM posting WHERE filtered UNION ALL SELECT url, 'added', department FROM posting WHERE NOT filtered) GROUP BY ALL")
def snk02(t):
    folder = scratch(t, "history")
    rows = t.posting.withColumn("source", C("department"))
    sinks.append_history(sinks.history_rows(rows.filter("filtered"), F.lit("2024-01-01"), F.lit("skipped_expired")), folder)
    sinks.append_history(sinks.history_rows(rows.filter("not filtered"), F.lit("2024-01-02"), F.lit("added")), folder)
    return t.spark.read.parquet(folder).groupBy("status", "portal").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("snk03_inbox_append", "SELECT '- [ ] ' || url || ' | ' || company || ' | ' || title || '  unverified' AS line, count(*) AS n FROM posting GROUP BY 1")
def snk03(t):
    folder = scratch(t, "inbox")
    sinks.append_inbox(sinks.inbox_rows(t.posting, "unverified"), folder)
    return t.spark.read.parquet(folder).groupBy("line").agg(F.count("*").alias("n"))


@query("snk04_reset", "SELECT url FROM posting WHERE filtered")
def snk04(t):
    a, b, c, d = (scratch(t, n) for n in ("inbox", "history", "inbox-new", "history-new"))
    t.posting.select(C("filtered").alias("done"), "url").write.parquet(a)
    t.posting.select("url", F.lit("added").alias("status")).write.parquet(b)
    sinks.reset(t.spark, a, b, c, d)
    return t.spark.read.parquet(c).select("url").unionByName(t.spark.read.parquet(d).select("url"))


@query("snk05_state_tables", "SELECT s_name AS company, s_acctbal > 0 AS ok FROM supplier")
def snk05(t):
    folder = scratch(t, "state")
    sinks.write_state(t.read("supplier").select(C("s_name").alias("company"), (C("s_acctbal") > 0).alias("ok")), folder)
    return t.spark.read.parquet(folder)


# --- extension points ---------------------------------------------------------------------------

@query("udx01_source_plugins", f"WITH {LINES_SQL} SELECT 'list' AS source, count(*) AS n FROM ln UNION ALL SELECT 'rss', count(*) FROM ln")
def udx01(t):
    plugins.source("list")(lambda p: feeds.json_feed(p, feeds.FEEDS["lever"]).withColumn("source", F.lit("list")))
    plugins.source("rss")(lambda p: feeds.rss_feed(p).withColumn("source", F.lit("rss")))
    lever = payload(t, lambda x: F.struct(x["p_name"].alias("text"), key(x).alias("hostedUrl")), lambda rows: F.to_json(rows)).withColumn("source", F.lit("list"))
    rss = text_payload(t, lambda x: F.concat(F.lit("<item><title>"), x["p_name"], F.lit("</title><link>"), key(x), F.lit("</link></item>"))).withColumn("source", F.lit("rss"))
    return plugins.collect(lever.unionByName(rss), ["list", "rss"]).groupBy("source").agg(F.count("*").alias("n"))


@query("udx02_enricher_plugins", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the') THEN 'The' ELSE '' END AS tags, text LIKE '%license%' AS licensed FROM documents""")
def udx02(t):
    licensed = (lambda d: d.withColumn("licensed", F.contains("text", F.lit("license"))))
    return plugins.apply_enrichers(t.documents, [plugins.skills_enricher({"The": ["the"]}), licensed]).select("doc_id", F.array_join("skills", "|").alias("tags"), "licensed")


@query("udx03_post_step", f"WITH {LINES_SQL} SELECT company, title, count(*) AS n FROM (SELECT DISTINCT company, p_name AS title FROM ln) GROUP BY ALL")
def udx03(t):
    plugins.source("offices")(lambda p: feeds.json_feed(p, feeds.FEEDS["greenhouse"]).withColumn("seq", F.struct("company", "url", "postedDate")))
    plugins.post_step("offices")(snapshot.merge_offices)
    body = payload(t, lambda x: F.struct(x["p_name"].alias("title"), F.concat(F.lit("https://g.example.com/"), key(x)).alias("absolute_url"), F.struct(x["p_type"].alias("name")).alias("location")), lambda rows: F.to_json(F.struct(rows.alias("jobs"))))
    return plugins.collect(body.withColumn("source", F.lit("offices")), ["offices"]).groupBy("company", "title").agg(F.count("*").alias("n"))


@query("udx04_link_patterns", "SELECT c_custkey, 'own' AS provider, 'c' || c_nationkey AS slug FROM customer")
def udx04(t):
    table = [*companies.BOARD_LINKS, ("own", "own-board.example.com", "sub")]
    url = F.concat(F.lit("https://C"), C("c_nationkey").cast("string"), F.lit(".own-board.example.com/jobs/1"))
    return t.read("customer").select("c_custkey", companies.link_identity(url, table).alias("i")).select("c_custkey", "i.provider", "i.slug")
