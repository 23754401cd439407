"""Landed feed payloads to postings.

``payload`` has company and body, one row per fetched document. Every reader is a projection with an
``explode``; documents are parsed where they lie, and rows stay where their document was read.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, text, urls
from ..functions.patterns import let
from ..operators import classify

POSTING = ["title", "url", "company", "location"]


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


# --- JSON ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class JsonFeed:
    """How one feed lists its postings: schema of the body, the list inside, and SQL per column."""
    schema: str
    items: str
    columns: dict[str, str]
    keep: str = "url <> ''"
    dates: tuple[str, ...] = ("postedDate",)
    modes: tuple[str, ...] = ("workMode",)
    epochs: tuple[str, ...] = ()


FEEDS: dict[str, JsonFeed] = {
    "greenhouse": JsonFeed(
        "jobs array<struct<title:string,absolute_url:string,location:struct<name:string>,first_published:string,updated_at:string,content:string>>",
        "doc.jobs", {"title": "item.title", "url": "item.absolute_url", "location": "item.location.name",
                     "postedDate": "coalesce(nullif(item.first_published, ''), item.updated_at)", "description": "item.content"}),
    "lever": JsonFeed(
        "array<struct<text:string,hostedUrl:string,createdAt:string,workplaceType:string,descriptionPlain:string,"
        "categories:struct<location:string,department:string,team:string>>>",
        "doc", {"title": "item.text", "url": "item.hostedUrl", "location": "item.categories.location", "postedDate": "item.createdAt",
                "workMode": "item.workplaceType", "department": "coalesce(nullif(item.categories.department, ''), item.categories.team)",
                "description": "item.descriptionPlain"}, keep="true", epochs=("postedDate",)),
    "ashby": JsonFeed(
        "jobs array<struct<title:string,jobUrl:string,location:string,publishedAt:string,department:string,team:string,"
        "workplaceType:string,isRemote:boolean,descriptionPlain:string>>",
        "doc.jobs", {"title": "item.title", "url": "item.jobUrl", "location": "item.location", "postedDate": "item.publishedAt",
                     "workMode": "coalesce(nullif(item.workplaceType, ''), if(item.isRemote, 'remote', if(item.isRemote is null, '', 'onsite')))",
                     "department": "coalesce(nullif(item.department, ''), item.team)", "description": "item.descriptionPlain"}, keep="true"),
    "smartrecruiters": JsonFeed(
        "content array<struct<id:string,name:string,ref:string,releasedDate:string,department:struct<label:string>,"
        "location:struct<city:string,region:string,country:string,remote:boolean>>>",
        "doc.content", {"title": "item.name",
                        "url": "concat('https://jobs.smartrecruiters.com/', regexp_extract(item.ref, '/companies/([^/]+)/', 1), '/', item.id, "
                               "if(item.name = '', '', '-'), regexp_replace(regexp_replace(lower(item.name), '[^a-z0-9]+', '-'), '^-|-$', ''))",
                        "location": "concat_ws(', ', nullif(item.location.city, ''), nullif(item.location.region, ''), nullif(item.location.country, ''))",
                        "postedDate": "item.releasedDate", "department": "item.department.label",
                        "workMode": "if(item.location.remote is null, '', if(item.location.remote, 'remote', 'onsite'))"}),
}


def json_feed(payload: DataFrame, feed: JsonFeed) -> DataFrame:
    """Postings of one JSON feed; bodies that do not parse give no rows."""
    schema = feed.schema if feed.schema.startswith("array") else f"struct<{re.sub(r'^(\w+) ', r'\1:', feed.schema)}>"
    items = (payload.withColumn("doc", F.from_json("body", schema))
             .select("company", F.explode(F.expr(feed.items)).alias("item")))
    rows = items.select("company", *[F.expr(f"coalesce({sql}, '')").alias(n) for n, sql in feed.columns.items()])
    clean = {n: dates.iso_epoch(F.col(n)) if n in feed.epochs else dates.iso_instant(F.col(n)) for n in feed.dates if n in feed.columns}
    clean |= {n: classify.work_mode(F.col(n)) for n in feed.modes if n in feed.columns}
    if "description" in feed.columns:
        clean["description"] = text.strip_html(text.decode_entities(F.col("description")))
    return rows.withColumns(clean).filter(feed.keep)


SEARCH = ("struct<results:array<struct<hits:array<struct<document:struct<title:string,url:string,postDate:string,"
          "jobApplicationUrl:string,jobCompany:struct<title:string>,jobLevel:struct<title:string>,"
          "jobLocation:array<struct<title:string,parents:array<struct<type:string,title:string>>>>>>>>>>")


def search_feed(payload: DataFrame) -> DataFrame:
    """Postings of a search-engine answer: documents of the first result, city with its country."""
    hits = F.get(F.from_json("body", SEARCH)["results"], F.lit(0))["hits"]
    d = F.col("d")
    place = F.get(d["jobLocation"], F.lit(0))
    country = F.get(F.filter(place["parents"], lambda p: p["type"] == "country"), F.lit(0))["title"]
    city = _blank(place["title"])
    location = F.when((city != "") & (country != "") & (country != city), F.concat(city, F.lit(", "), country)).when(
        city != "", city).otherwise(F.coalesce(country, F.lit("")))
    link = _blank(d["jobApplicationUrl"])
    return payload.select(F.explode(hits["document"]).alias("d")).filter("coalesce(d.title, '') <> '' and coalesce(d.url, '') <> ''").select(
        d["title"].alias("title"), d["url"].alias("url"), F.coalesce(d["jobCompany"]["title"], F.lit("")).alias("company"),
        location.alias("location"), dates.iso_epoch(d["postDate"]).alias("postedDate"),
        _blank(d["jobLevel"]["title"]).alias("experienceLevel"),
        F.when(F.rlike(link, F.lit("(?i)^https?://")), link).alias("applyUrl"))


POSITIONS = ("array<struct<uid:string,name:string,url_comeet_hosted_page:string,url_active_page:string,workplace_type:string,"
             "time_updated:string,department:string,experience_level:string,location:struct<name:string,is_remote:boolean>>>")


def position_variants(payload: DataFrame) -> DataFrame:
    """Positions listed once per office: one row per base uid, the base record before its variants.

    Variants of a position come in one document, so they are settled inside it, without a shuffle.
    """
    url = "coalesce(nullif(p.url_comeet_hosted_page, ''), p.url_active_page, '')"
    listed = F.filter(F.from_json("body", POSITIONS), lambda p: (F.trim(p["name"]) != "") & (
        F.coalesce(F.nullif(p["url_comeet_hosted_page"], F.lit("")), p["url_active_page"], F.lit("")) != ""))
    bases = F.array_distinct(F.transform(F.filter(F.col("listed"), lambda p: p["uid"].isNotNull()), lambda p: F.substring_index(p["uid"], "-", 1)))
    best = F.transform(F.col("bases"), lambda b: F.coalesce(
        F.get(F.reverse(F.filter(F.col("listed"), lambda p: p["uid"] == b)), F.lit(0)),
        F.get(F.filter(F.col("listed"), lambda p: F.substring_index(p["uid"], "-", 1) == b), F.lit(0))))
    no_uid = F.filter(F.col("listed"), lambda p: p["uid"].isNull())
    mode = classify.work_mode(F.col("p.workplace_type"))
    return (payload.select("company", listed.alias("listed")).withColumn("bases", bases).select("company", F.explode(F.concat(best, no_uid)).alias("p"))
            .select(F.trim("p.name").alias("title"), F.expr(url).alias("url"), "company", _blank(F.col("p.location.name")).alias("location"),
                    dates.iso_instant(F.col("p.time_updated")).alias("postedDate"), F.col("p.uid").alias("uid"),
                    F.when(mode != "", mode).when(F.col("p.location.is_remote"), "remote").otherwise("").alias("workMode")))


def recipe_json(payload: DataFrame, recipe: dict) -> DataFrame:
    """Postings by configured dotted paths; ``url_template`` fills in where a posting has no url."""
    def at(path: str) -> Column:
        return F.try_variant_get("item", "$." + path, "string")

    fields = recipe.get("fields", {})
    root = "$" + (("." + recipe["list_path"]) if recipe.get("list_path") else "")
    items = payload.select("company", F.explode(F.try_variant_get(F.try_parse_json("body"), root, "array<variant>")).alias("item"))
    url = at(fields["url"]) if fields.get("url") else F.lit(None).cast("string")
    if recipe.get("url_template"):
        parts = re.findall(r"([^{}]*)(?:\{([^}]+)\})?", recipe["url_template"])
        filled = F.concat(*[x for lit, key in parts for x in ([F.lit(lit)] if lit else []) + ([F.coalesce(at(key.strip()), F.lit(""))] if key else [])])
        url = F.coalesce(F.nullif(url, F.lit("")), filled)
    base = recipe.get("url_base", "")
    url = F.when(F.rlike(url, F.lit("^[a-z]+://")), url).when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit(base), url)).otherwise("")
    loc = fields.get("location")
    names = F.try_variant_get("item", f"$.{loc}", "array<variant>") if loc else F.lit(None)
    place = F.coalesce(*[F.nullif(at(f"{loc}.{k}"), F.lit("")) for k in ("name", "text", "city")]) if loc else F.lit("")
    listed = F.array_join(F.transform(names, lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string"))), ", ") if loc else F.lit("")
    location = F.coalesce(F.nullif(listed, F.lit("")), place, at(loc) if loc else F.lit("")) if loc else F.lit("")
    company = F.coalesce(F.nullif(F.trim(at(fields["company"])), F.lit("")), F.col("company")) if fields.get("company") else F.col("company")
    return items.select(_blank(at(fields["title"])).alias("title"), url.alias("url"), company.alias("company"),
                        _blank(location).alias("location")).filter("title <> '' and url <> ''")


def parser_rows(rows: DataFrame) -> DataFrame:
    """Rows of a user's own parser brought to posting columns."""
    have = set(rows.columns)

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in have], F.lit(""))

    return rows.select(F.trim(first("title", "name")).alias("title"), F.trim(first("url", "jobUrl", "job_url", "applyUrl", "apply_url")).alias("url"),
                       F.trim(first("company", "entry_name")).alias("company"), F.trim(first("location", "locations")).alias("location")
                       ).filter("title <> '' and url <> ''")


# --- XML, HTML, sitemaps, tables ----------------------------------------------------------------

def blocks(payload: DataFrame, pattern: str) -> DataFrame:
    """One row per matching block of the body (first group), with the position inside it."""
    found = F.regexp_extract_all("body", F.lit(pattern), F.lit(1))
    return payload.select("company", F.posexplode(found).alias("pos", "block"))


def tag(c: Column, name: str) -> Column:
    """Text of the first element of that name, CDATA opened, entities decoded."""
    inner = F.regexp_extract(c, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
    return F.trim(text.decode_entities(F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))


# Title shapes of two boards: company, role, then place or the remote mark.
HIRING_TITLE = r"^(.*?) is hiring an? (.*?) to work (?:from (.*?)|(remotely))\.?$"
REMOTE_JOB_TITLE = r"(?i)^(.*?) is hiring (?:an? )?(.*?)\s*\(Remote Job\)\.?$"


def rss_feed(payload: DataFrame, title_pattern: str = HIRING_TITLE, always_remote: bool = False) -> DataFrame:
    """RSS items; company, role, place and remote hint come out of the title, which is kept when it does not fit."""
    # read inside the list, so that the filter on url and title does not read them once more
    read = lambda block: F.struct(tag(block, "link").alias("url"), tag(block, "title").alias("raw"), tag(block, "pubDate").alias("published"))
    found = F.regexp_extract_all("body", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    items = payload.select(F.explode(F.transform(found, read)).alias("item")).select("item.*")
    raw, fits = F.col("raw"), F.rlike("raw", F.lit(title_pattern))

    def part(i: int) -> Column:
        if i > re.compile(title_pattern).groups:
            return F.lit("")
        return F.when(fits, F.trim(F.regexp_extract(raw, title_pattern, i))).otherwise("")

    remote = F.lit("remote") if always_remote else F.when(part(4) != "", "remote").otherwise("")
    return items.filter("url <> '' and raw <> ''").select(
        F.when(fits, part(2)).otherwise(raw).alias("title"), "url", part(1).alias("company"), part(3).alias("location"),
        remote.alias("workMode"), dates.iso_instant(F.col("published")).alias("postedDate"))


@dataclass(frozen=True)
class HtmlListing:
    """A listing page: pattern of one block and a pattern per column, first group."""
    block: str
    columns: dict[str, str] = field(default_factory=dict)


def html_listing(payload: DataFrame, listing: HtmlListing) -> DataFrame:
    rows = blocks(payload, listing.block)
    values = {n: text.strip_html(F.regexp_extract("block", p, 1)) for n, p in listing.columns.items()}
    out = rows.select("company", *[c.alias(n) for n, c in values.items()])
    return out.filter("title <> '' and url <> ''")


def json_island(payload: DataFrame, island: str, schema: str, columns: dict[str, str], keep: str = "title <> ''") -> DataFrame:
    """JSON carried inside a page (attribute or script): cut out, entities decoded, parsed, exploded."""
    raw = text.decode_entities(F.regexp_extract("body", island, 1))
    items = payload.select("company", F.explode(F.from_json(raw, schema)).alias("item"))
    return items.select("company", *[F.expr(f"coalesce({sql}, '')").alias(n) for n, sql in columns.items()]).filter(keep)


def sitemap_index(payload: DataFrame, part: str = "jobs") -> DataFrame:
    """Distinct sub-sitemaps whose address mentions ``part``."""
    locs = F.transform(F.regexp_extract_all("body", F.lit(r"(?s)<loc>(.*?)</loc>"), F.lit(1)), lambda u: text.decode_entities(F.trim(u)))
    return payload.select(F.explode(F.filter(locs, lambda u: F.contains(u, F.lit(part)))).alias("url")).distinct()


def slug_posting(url: Column) -> dict[str, Column]:
    """Title and company of a '/Title-at-Company-7' address, split at the last '-at-'."""
    slug = F.regexp_replace(F.replace(F.url_decode(F.replace(urls.path(url), F.lit("+"), F.lit("%2B"))), F.lit("\u0000"), F.lit("")), "^/+", "")
    split = r"(?i)^(.*)-at-(.*)$"
    has = F.rlike(slug, F.lit(split))

    def words(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(c, "-+", " "), r"\s+", " "))

    return {"slug": slug, "title": F.when(has, words(F.regexp_extract(slug, split, 1))).otherwise(words(slug)),
            "company": F.when(has, words(F.regexp_replace(F.regexp_extract(slug, split, 2), r"-\d+$", ""))).otherwise("")}


def sitemap_postings(payload: DataFrame) -> DataFrame:
    """Postings named by the addresses of a sitemap, with the entry's last change."""
    # read inside the list, so that the filter on the address does not read it once more
    read = lambda block: F.struct(tag(block, "loc").alias("url"), dates.iso_instant(tag(block, "lastmod")).alias("postedDate"))
    entries = F.transform(F.regexp_extract_all("body", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)), read)
    located = payload.select(F.explode(entries).alias("entry")).select("entry.*")
    # the slug's parts follow from the address, so they are read once per address
    return located.filter(F.rlike("url", F.lit("(?i)-at-"))).dropDuplicates(["url"]).withColumns(slug_posting(F.col("url")))


def dated_slug_title(url: Column) -> Column:
    """'/jobs/senior-artist-0a1b2c3d' to 'Senior Artist': trailing hex id dropped, words capitalised."""
    slug = F.regexp_replace(F.regexp_replace(urls.path(url), "^/+", ""), "(?i)^jobs/", "")
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(slug, "(?i)-[0-9a-f]{8,}$", ""), "-+", " ")))


def markdown_table(payload: DataFrame, host: str = "apply.workable.com") -> DataFrame:
    """Rows of a Markdown table. Columns count from the details cell leftwards, since cells may be put in front."""
    lines = payload.select("company", F.explode(F.split("body", "\n")).alias("line")).filter("startswith(line, '|') and contains(line, '[View]')")
    cells = lines.withColumn("cells", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)))
    at = F.array_position(F.transform("cells", lambda x: F.contains(x, F.lit("[View]"))), F.lit(True)).cast("int")
    link = F.regexp_replace(F.regexp_extract("line", r"\[View\]\(([^)]+)\)", 1), r"\.md$", "")
    rows = cells.withColumns({"at": at, "url": link}).filter((F.col("at") > 7) & F.startswith("url", F.lit(f"https://{host}/")))

    def cell(back: int) -> Column:
        return F.get("cells", F.col("at") - 1 - back)

    return rows.select(F.get("cells", F.lit(1)).alias("title"), "url", "company", cell(4).alias("location"),
                       F.when(cell(5) != "Department", cell(5)).otherwise("").alias("department"),
                       dates.iso_instant(cell(1)).alias("postedDate")).filter("title not in ('', 'Title')")


def json_ld(payload: DataFrame) -> DataFrame:
    """First JobPosting of a page's JSON-LD blocks, graphs and lists included."""
    scripts = F.regexp_extract_all("body", F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.transform(scripts, lambda s: F.try_parse_json(F.trim(s)))
    nodes = F.flatten(F.transform(parsed, lambda d: F.coalesce(
        F.try_variant_get(d, "$", "array<variant>"), F.try_variant_get(d, "$['@graph']", "array<variant>"), F.array(d))))
    kind = (lambda n: (F.try_variant_get(n, "$['@type']", "string") == "JobPosting") | F.array_contains(
        F.coalesce(F.try_variant_get(n, "$['@type']", "array<string>"), F.array().cast("array<string>")), "JobPosting"))
    first = F.get(F.filter(nodes, lambda n: F.coalesce(kind(n), F.lit(False))), F.lit(0))

    def at(path: str) -> Column:
        return F.try_variant_get("n", path, "string")

    def spot(part: str) -> Column:
        return F.coalesce(*[F.coalesce(at(f"$.jobLocation{i}.address.{part}.name"), at(f"$.jobLocation{i}.address.{part}")) for i in ("[0]", "")])

    plain = F.coalesce(at("$.jobLocation[0].address"), at("$.jobLocation.address"), at("$.jobLocation[0]"), at("$.jobLocation"))
    place = text.place_string(spot("addressLocality"), spot("addressRegion"), spot("addressCountry"))
    rows = payload.select(*[c for c in payload.columns if c != "body"], first.alias("n")).filter("n is not null")
    raw = F.when(place != "", place).when(F.startswith(plain, F.lit("{")) | F.startswith(plain, F.lit("[")), "").otherwise(text.address_city(plain))
    return rows.withColumn("raw", F.coalesce(raw, F.lit(""))).select(
        *[c for c in rows.columns if c not in ("n", "company")], _blank(at("$.title")).alias("title"),
        _blank(F.coalesce(at("$.hiringOrganization.name"), at("$.hiringOrganization"))).alias("company"),
        classify.place_only(F.col("raw")).alias("location"),
        F.when(at("$.jobLocationType") == "TELECOMMUTE", "remote").otherwise(classify.location_mode(F.col("raw"))).alias("workMode"),
        dates.iso_instant(at("$.datePosted")).alias("postedDate"), text.strip_html(at("$.description")).alias("description"))


def label_values(body: Column, pattern: str = r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>") -> Column:
    """map of lower-case label to value; the first of equal labels wins."""
    def clean(group: int) -> Column:
        return F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(group)), lambda s: text.strip_html(s))

    pairs = F.arrays_zip(F.transform(clean(1), lambda k: F.lower(k)).alias("k"), clean(2).alias("v"))
    return first_wins_map(F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))


def first_wins_map(pairs: Column) -> Column:
    """map from array<struct<key,value>>: blanks dropped, the first value of a key kept."""
    full = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    once = let(full, lambda rows: let(F.transform(rows, lambda q: q["key"]), lambda keys: F.filter(
        rows, lambda p, i: F.array_position(keys, p["key"]) == i + 1)))
    return F.map_from_entries(once)


def apply_link(body: Column, own_host: str, redirect_host: str = "recruitics.com", param: str = "rx_url") -> Column:
    """Target of the link whose whole text is 'Apply'; a tracking redirect is opened, own pages give ''."""
    anchors = F.regexp_extract_all(body, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    apply = F.get(F.filter(anchors, lambda a: F.lower(F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]*>", ""), r"\s+", " "))) == "apply"), F.lit(0))
    href = text.decode_entities(F.trim(F.regexp_extract(apply, r"(?i)href=[\"']([^\"']+)[\"']", 1)))
    target = F.when(urls.on_hosts(urls.host(href), [redirect_host]), F.try_url_decode(urls.query_param(href, param))).otherwise(href)
    fine = urls.is_web(href) & (urls.host(href) != own_host) & urls.is_web(target)
    return F.coalesce(F.when(fine, target), F.lit(""))


# --- recipe for pages ---------------------------------------------------------------------------

_PART = re.compile(r"""\[\s*(?P<attr>[\w:-]+)\s*(?:=\s*["']?(?P<value>[^"'\]]*)["']?\s*)?\]|(?P<mark>[.\#])(?P<name>[\w-]+)|(?P<tag>[A-Za-z][\w-]*)""")
# Entities that recipe pages are decoded for, in this order.
_PAGE_ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">"}


def page_tokens(html: Column) -> Column:
    """Tags and the texts between them, in order; a sign < that opens no tag is text."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?s)(<[^>]*>|[^<]+|<)"), F.lit(1))


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^<([A-Za-z][\w-]*)[\s/>]", 1))


def tag_attribute(token: Column, name: str) -> Column:
    """Value of an attribute without its quotes; '' when it is not there."""
    quoted = F.regexp_extract(token, rf"(?is)[\s\"']{re.escape(name)}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.trim(F.regexp_replace(quoted, r"^[\"']|[\"']$", ""))


def compound(selector: str):
    """Element name ('' for any) and test of an opening tag. Classes and ids match a whole word of the attribute."""
    name, tests = "", []
    for m in _PART.finditer(selector):
        if m["tag"]:
            name = m["tag"].lower()
            tests.append(lambda t, n=name: tag_name(t) == n)
        elif m["mark"]:
            kind = "class" if m["mark"] == "." else "id"
            tests.append(lambda t, kind=kind, n=m["name"]: F.rlike(tag_attribute(t, kind), F.lit(rf"(?i)\b{re.escape(n)}\b")))
        elif m["value"]:
            tests.append(lambda t, n=m["attr"], v=m["value"].lower(): F.lower(tag_attribute(t, n)) == v)
        else:
            tests.append(lambda t, n=m["attr"]: F.rlike(t, F.lit(rf"(?i)[\s\"']{re.escape(n)}(?=[\s=/>])")))

    def test(token: Column) -> Column:
        return reduce(lambda a, b: a & b, [f(token) for f in tests], tag_name(token) != "")
    return name, test


def page_text(tokens: Column) -> Column:
    """The texts of tokens; every tag parts words."""
    joined = F.array_join(F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit(r"(?s)^<.*>$")), " ").otherwise(t)), "")
    decoded = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _PAGE_ENTITIES.items(), joined)
    return text.squeeze(decoded)


def element_blocks(tokens: Column, selector: str) -> Column:
    """array<array<string>>: from each element that the selector finds up to the next one."""
    _, test = compound(selector)
    numbers = F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i + 1)), lambda i: i.isNotNull())
    return let(numbers, lambda at: F.transform(at, lambda s, k: F.slice(tokens, s, F.coalesce(F.get(at, k + 1), F.size(tokens) + 1) - s)))


def block_field(block: Column, spec: str) -> Column:
    """``selector`` (text of the element), ``selector@attribute``, ``@attribute`` (of the block's own tag), or '' (text of the block)."""
    selector, _, attribute = (part.strip() for part in spec.partition("@"))
    if not selector:
        return tag_attribute(F.get(block, F.lit(0)), attribute) if attribute else page_text(block)
    name, test = compound(selector)

    def inside(rest: Column) -> Column:
        # the element ends at the closing tag of its name; without a name, at the next tag
        closing = F.lit(rf"(?i)^</{name}\s*>" if name else "^<")
        return let(F.array_position(F.transform(rest, lambda t: F.rlike(t, closing)), F.lit(True)).cast("int"),
                   lambda end: page_text(F.when(end > 0, F.slice(rest, 1, end - 1)).otherwise(rest)))

    def found(at: Column) -> Column:
        value = tag_attribute(F.get(block, at - 1), attribute) if attribute else let(F.slice(block, at + 1, F.size(block)), inside)
        return F.when(at > 0, value).otherwise("")
    return let(F.array_position(F.transform(block, test), F.lit(True)).cast("int"), found)


def recipe_html(payload: DataFrame, recipe: dict) -> DataFrame:
    """Postings of pages by configured selectors, one row per block that has a title and a url."""
    fields, base = recipe.get("fields", {}), recipe.get("url_base", "")
    block = payload.select("company", F.explode(element_blocks(page_tokens(F.col("body")), recipe["list_selector"])).alias("block"))
    optional = lambda name: block_field(F.col("block"), fields[name]) if fields.get(name) else F.lit("")
    read = block.select(
        block_field(F.col("block"), fields.get("title") or "").alias("title"), block_field(F.col("block"), fields.get("url") or "").alias("url"),
        F.coalesce(F.nullif(optional("company"), F.lit("")), "company", F.lit("")).alias("company"), optional("location").alias("location"))
    full = F.when(F.rlike("url", F.lit("^[a-z]+://")), F.col("url")).otherwise(F.concat(F.lit(base), F.col("url")))
    return read.filter("title <> '' and url <> ''").select(*[full.alias(c) if c == "url" else F.col(c) for c in POSTING])


# --- directories --------------------------------------------------------------------------------

def directory_names(payload: DataFrame, pattern: str) -> DataFrame:
    """Company names a directory page links to, entities decoded."""
    return blocks(payload, pattern).select(F.trim(text.decode_entities(F.col("block"))).alias("name")).filter("name <> ''")


def directory_cells(payload: DataFrame) -> DataFrame:
    """Company-shaped cells of a text layout, cut at dashes, '&' and legal endings."""
    from ..operators.predicates import LEGAL_ENDING, company_shaped
    cells = (payload.select(F.explode(F.split("body", "\n")).alias("line"))
             .select(F.explode(F.split("line", r"\s{2,}")).alias("cell")).filter(company_shaped(F.col("cell"))))
    head = F.get(F.split(F.get(F.split(F.get(F.split(F.trim("cell"), r"\s+[\x{2013}\x{2014}-]\s+"), F.lit(0)), r"\s+&\s+"), F.lit(0)), r"(?i)\s+och\s+"), F.lit(0))
    return cells.select(F.trim(F.regexp_replace(F.regexp_replace(head, LEGAL_ENDING, ""), r"\s+", " ")).alias("name")).filter("length(name) >= 3")
