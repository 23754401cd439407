"""JSON answers of job boards, read as VARIANT, with the bodies that cannot be read beside the postings.

A ``Shape`` says where the list lies and what each column is. A body is parsed once; each field is read on its own, so that a
field of another type blanks only itself. ``payload`` has company, body and, where links are made of the board's own address,
origin. Rows stay where their document was read; a board that repeats a posting inside one document does not shuffle either.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, text
from ..functions.patterns import let
from ..operators import classify


@dataclass(frozen=True)
class Shape:
    """``columns``: SQL per column, ``{a.b}`` for the trimmed text at that path of the item ('' when absent), company and origin
    by name. ``island`` cuts the JSON out of a page (first group), ``escaped`` opens its entities; ``pick`` is the key of the cached
    query, among those at ``items``, whose data is the list. ``need``: columns that must not be blank. ``unique``: column whose first row in a document stays. ``finish``:
    columns worked out of these."""
    items: str
    columns: dict[str, str]
    need: tuple[str, ...] = ("title", "url")
    unique: str | None = None
    finish: dict[str, Callable[[], Column]] = field(default_factory=dict)
    island: str = ""
    escaped: bool = False
    pick: str = ""


_PATH = re.compile(r"\{([^{}]+)\}")


def _texts(templates: list[str]) -> dict[str, str]:
    """SQL of the text at each path that the templates name, by path; each is read once per item, however often it is named."""
    return {path: f"trim(coalesce(try_variant_get(item, '$.{path}', 'string'), ''))" for path in dict.fromkeys(p for t in templates for p in _PATH.findall(t))}


def _first_of(*options: str) -> str:
    return f"coalesce({', '.join(f'nullif({o}, {chr(39) * 2})' for o in options)}, '')"


def _listed(*parts: str) -> str:
    return f"concat_ws(', ', {', '.join(f'nullif({p}, {chr(39) * 2})' for p in parts)})"


def _two(a: str, b: str, same: str = "=") -> str:
    """Both, or one where the other is blank or equal to it."""
    return f"if({a} <> '' and {b} <> '' and not ({same.join(f'lower({x})' if same == ' = ' else x for x in (a, b))}), concat({a}, ', ', {b}), {_first_of(a, b)})"


def _iso() -> Column:
    return dates.iso_instant(F.col("postedDate"))


def _mode() -> Column:
    return classify.work_mode(F.col("workMode"))


def _text() -> Column:
    return text.strip_html(text.decode_entities(F.col("description")))


# A label of the form "Mode (Place)".
MODE_LABEL = r"(?i)^(hybrid|remote|on-?site|in-office|in-person|onsite)\s*\((.+)\)\s*$"
_LABEL = _first_of("{workLocation.label}", "{workLocations[0]}")


def _label_place() -> Column:
    label = F.col("location")
    return F.when(F.rlike(label, F.lit(MODE_LABEL)), F.trim(F.regexp_extract(label, MODE_LABEL, 2))).when(classify.work_mode(label) != "", "").otherwise(label)


def _label_mode() -> Column:
    label = F.col("location")
    return classify.work_mode(F.when(F.rlike(label, F.lit(MODE_LABEL)), F.regexp_extract(label, MODE_LABEL, 1)).otherwise(label))


def _site_place() -> Column:
    place = F.trim(classify.place_only(F.col("location")))
    return F.when(place != "", place).otherwise(F.col("country"))


def _site_mode() -> Column:
    mode = classify.work_mode(F.col("workMode"))
    return F.when(mode != "", mode).otherwise(classify.location_mode(F.col("location")))


def _place_mode() -> Column:
    mode = F.col("workMode")
    return F.when(mode != "", mode).otherwise(classify.work_mode(F.col("location")))


# Titles that are no postings (talent pool, referral).
NON_JOB = r"(?i)인재\\s*풀|talent\\s*pool|추천\\s*제도|사외\\s*추천|임직원\\s*추천|referral"
_POSITION = "openingJobPosition.openingJobPositions[0]"


def _korean() -> Column:
    """Street addresses of Korean boards name no country."""
    place = F.col("location")
    return F.when((place != "") & ~F.rlike(place, F.lit("(?i)korea")), F.concat(place, F.lit(", South Korea"))).otherwise(place)


_FROM_CODE = "if({shortcode} = '', '', concat('https://apply.workable.com/j/', {shortcode}))"
_CITY = f"trim(split({_first_of('{location.city}', '{atsLocation.city}')}, ',')[0])"

SHAPES: dict[str, Shape] = {
    "recruitee": Shape("$.offers", {
        "title": "{title}", "company": "company",
        "url": f"regexp_extract({_first_of('{careers_url}', '{url}')}, '^https://[a-z0-9][a-z0-9-]*[.]recruitee[.]com(?:[/?#].*)?$', 0)",
        "location": _first_of("{location}", _listed("{city}", "{country}")), "postedDate": _first_of("{published_at}", "{created_at}"),
        "department": "{department}", "description": "{description}",
        "workMode": "case when {remote} = 'true' then 'remote' when {hybrid} = 'true' then 'hybrid' when {on_site} = 'true' then 'onsite' else '' end"},
        need=(), finish={"postedDate": _iso, "description": _text}),
    "teamtailor": Shape("$.items", {
        "title": "{title}", "url": "{url}", "company": _first_of("{_jobposting.hiringOrganization.name}", "company"),
        "location": _two(*(_first_of(f"{{_jobposting.jobLocation[0].address.{p}}}", f"{{_jobposting.jobLocation.address.{p}}}") for p in ("addressLocality", "addressCountry"))),
        "postedDate": _first_of("{date_published}", "{_jobposting.datePosted}"), "description": "{content_html}"},
        finish={"postedDate": _iso, "description": _text}),
    "breezy": Shape("$", {
        "title": "{name}", "url": "{url}", "company": _first_of("{company.name}", "company"),
        "location": _two(_first_of("{location.name}", "{locations[0].name}"), _first_of("{location.country.name}", "{locations[0].country.name}"), " = "),
        "postedDate": "{published_date}", "department": "{department}",
        "workMode": f"case when {_first_of('{location.is_remote}', '{locations[0].is_remote}')} <> 'true' then '' "
                    f"when contains(lower({_first_of('{location.remote_details.value}', '{locations[0].remote_details.value}')}), 'anywhere') then 'anywhere' else 'remote' end"},
        finish={"postedDate": _iso}),
    "bamboohr": Shape("$.result", {
        "title": "{jobOpeningName}", "url": "if({id} = '' or origin = '', '', concat(origin, '/careers/', {id}))", "company": "company",
        "location": f"concat_ws(', ', array_distinct(filter(array({_CITY}, {_first_of('{location.state}', '{atsLocation.state}')}, {{atsLocation.country}}), p -> p <> '')))",
        "department": "{departmentLabel}", "workMode": "if({isRemote} = 'true', 'remote', '')"},
        unique="url", finish={"workMode": _place_mode}),
    "hibob": Shape("$.jobAdDetails", {
        "title": "{title}", "url": "if({id} = '', '', concat(origin, '/jobs?jobId=', replace(url_encode({id}), '+', '%20')))", "company": "company",
        "location": _first_of("{site}", "{country}"), "country": "{country}", "postedDate": "{publishedAt}", "department": "{department}",
        "workMode": _first_of("{workspaceTypeId}", "{workspaceType}")},
        unique="url", finish={"postedDate": _iso, "workMode": _site_mode, "location": _site_place}),
    "huntflow": Shape("$.items", {
        "title": "{position}", "company": "company", "location": "{city}", "department": "{division}",
        "url": "if({slug} rlike '^[A-Za-z0-9._-]+$' and {archived_at} = '', concat(origin, '/vacancy/', {slug}), '')",
        "workMode": r"if({city} rlike '(?i)\\bremote\\b', 'remote', '')"}, unique="url"),
    "rippling": Shape("$", {
        "title": "{name}", "url": "{url}", "company": "company", "location": _LABEL, "department": "{department.label}", "workMode": "''"},
        finish={"workMode": _label_mode, "location": _label_place}),
    "workday": Shape("$.jobPostings", {
        "title": "{title}", "url": "if({externalPath} = '', '', concat(origin, {externalPath}))", "company": "company", "location": "{locationsText}"}),
    "workable": Shape("$.jobs", {
        "title": "{title}", "company": "company",
        "url": f"regexp_extract({_first_of('{url}', _FROM_CODE)}, '^https://apply[.]workable[.]com/.*$', 0)",
        "location": _listed("{city}", "{state}", "{country}"), "postedDate": "{published_on}", "department": "{department}", "description": "{description}"},
        finish={"postedDate": _iso, "description": _text}),
    "personio": Shape("$", {
        "title": "{name}", "url": "if({id} = '' or origin = '', '', concat(origin, '/job/', {id}))", "company": "company", "location": "{office}",
        "department": "{department}"}, unique="url"),
    "aggregate": Shape("$", {
        "title": "{title}", "url": "{source_url}", "company": "{company}", "location": "{location}", "postedDate": "{posted_at}",
        "department": "{department}", "ats": "{source_ats}", "workMode": "{workplace}", "remote": "{remote}"},
        finish={"postedDate": _iso, "workMode": lambda: F.when(_mode() != "", _mode()).when(F.col("remote") == "true", "remote").otherwise("")}),
    "eightfold": Shape("$.positions", {
        "title": "{name}", "url": _first_of("{canonicalPositionUrl}", "{positionUrl}"), "company": "company", "location": "{location}",
        "postedDate": _first_of("{t_create}", "{t_update}"), "department": _first_of("{department}", "{business_unit}"),
        "workMode": _first_of("{work_location_option}", "{location_flexibility}")},
        unique="url", finish={"postedDate": _iso, "workMode": _mode}),
    "zohorecruit": Shape("$", {
        "title": _first_of("{Posting_Title}", "{Job_Opening_Name}"), "company": "company", "location": _listed("{City}", "{Country}"),
        "url": "if({id} rlike '^[A-Za-z0-9]+$' and {Publish} <> 'false', concat(origin, '/jobs/Careers/', {id}), '')",
        "workMode": "if({Remote_Job} = 'true', 'remote', '')"},
        unique="url", island=r"""(?i)<input(?=[^>]*\bid="jobs")[^>]*\bvalue="([^"]*)\"""", escaped=True),
    "greetinghr": Shape("$.props.pageProps.dehydratedState.queries", {
        "title": f"if({{title}} rlike '{NON_JOB}', '', {{title}})", "company": "company", "postedDate": "{openDate}",
        "url": "if({openingId} = '' or {deploy} = 'false', '', concat(origin, '/o/', replace(url_encode({openingId}), '+', '%20')))",
        "location": _first_of(f"{{{_POSITION}.workspacePlace.place}}", f"{{{_POSITION}.workspacePlace.location}}"),
        "department": f"{{{_POSITION}.workspaceOccupation.occupation}}", "workMode": f"if({{{_POSITION}.workspacePlace.workFromHome}} = 'true', 'remote', '')"},
        unique="url", finish={"postedDate": _iso, "location": _korean, "workMode": lambda: F.when(F.col("workMode") != "", F.col("workMode")).when(F.col("location") != "", "onsite").otherwise("")},
        island=r"""(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>""", pick='["openings"]'),
}


def landed(payload: DataFrame, shape: Shape) -> DataFrame:
    """``payload`` with its list as ``listed``, or why there is none as ``reason``: 'no body', 'not JSON' or 'no list'."""
    body = F.regexp_extract("body", shape.island, 1) if shape.island else F.col("body")
    doc = F.try_parse_json(text.decode_entities(body) if shape.escaped else body)
    listed = F.try_variant_get(doc, shape.items, "array<variant>")
    if shape.pick:
        cached = F.filter(listed, lambda q: F.try_variant_get(q, "$.queryKey", "string") == shape.pick)
        listed = F.try_variant_get(F.get(cached, F.lit(0)), "$.state.data", "array<variant>")
    parsed = payload.withColumn("listed", listed)
    reason = F.when(F.col("listed").isNotNull(), None).when(F.trim(F.coalesce("body", F.lit(""))) == "", "no body").when(doc.isNull(), "not JSON").otherwise("no list")
    parsed = parsed.withColumn("reason", reason)
    return parsed if "origin" in payload.columns else parsed.withColumn("origin", F.lit(""))


def rejected(payload: DataFrame, shape: Shape) -> DataFrame:
    """(company, reason, body) of the bodies without a list of postings."""
    return landed(payload, shape).filter("reason is not null").select("company", "reason", "body")


def _first_rows(rows: Column, unique: str) -> Column:
    """Rows of an array whose ``unique`` occurs there first, by sorting places rather than comparing all."""
    places = F.array_sort(F.transform(rows, lambda r, i: F.struct(r[unique].alias("k"), i.alias("i"))))
    firsts = let(places, lambda s: F.filter(s, lambda e, at: (at == 0) | (F.get(s, at - 1)["k"] != e["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: e["i"])), lambda i: F.get(rows, i))


def postings(payload: DataFrame, shape: Shape) -> DataFrame:
    """Postings of the bodies that could be read, one column per entry of the shape."""
    texts = _texts(list(shape.columns.values()))
    names = {path: f"item.f{i}" for i, path in enumerate(texts)}
    read = ", ".join(f"'f{i}', {sql}" for i, sql in enumerate(texts.values()))
    made = ", ".join(f"'{name}', {_PATH.sub(lambda m: names[m[1]], sql)}" for name, sql in shape.columns.items())
    need = " and ".join(f"r.{c} <> ''" for c in shape.need) or "true"
    rows = F.expr(f"filter(transform(transform(filter(listed, item -> not is_variant_null(item)), item -> named_struct({read})), item -> named_struct({made})), r -> {need})")
    if shape.unique:
        rows = let(rows, lambda r: _first_rows(r, shape.unique))
    # a list that is missing explodes to no row; a filter on it would parse every body twice
    out = landed(payload, shape).select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumns({n: f() for n, f in shape.finish.items()})
