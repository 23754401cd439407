"""JSON answers of job boards as VARIANT shapes, and the bodies that cannot be read. Each document lists its postings twice
where a board may repeat one, and postings without title or link between them."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import shapes
from .registry import query
from .sources import LINES_SQL, day, key, payload

C = F.col
LN = f"WITH {LINES_SQL}"
ORIGIN = "https://jobs.example.com"


def lit(value):
    return F.lit(value)


def named(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def read(t, name, render, wrap, *columns):
    """Postings of the shape from documents that ``wrap`` puts around the rendered lines."""
    body = payload(t, render, lambda rows: F.to_json(wrap(rows))).withColumn("origin", lit(ORIGIN))
    return shapes.postings(body, shapes.SHAPES[name]).select("title", "url", "company", "location", *columns)


def heavy(x, then, otherwise):
    return F.when(x["l_quantity"] > 25, then).otherwise(otherwise)


def stamp(x):
    return day(x, "yyyy-MM-dd HH:mm:ss' UTC'")


@query("src01_recruitee", f"""{LN} SELECT p_name AS title, CASE WHEN l_quantity > 25 THEN 'https://studio.recruitee.com/o/' || l_partkey ELSE '' END AS url, company, CASE WHEN l_quantity > 25 THEN 'Gent, ' || p_type ELSE p_type END AS location,
    iso AS "postedDate", 'hybrid' AS "workMode", 'Art & ' || p_type AS description FROM ln""")
def recruitee(t):
    return read(t, "recruitee", lambda x: named(
        title=x["p_name"], careers_url=F.concat(heavy(x, lit("https://studio.recruitee.com/o/"), lit("https://studio.elsewhere.com/o/")), key(x)),
        city=heavy(x, lit("Gent"), lit("")), country=x["p_type"], created_at=stamp(x), hybrid=lit(True), on_site=lit(True), remote=lit(False),
        description=F.concat(lit("<p>Art &amp; <b>"), x["p_type"], lit("</b></p>"))), lambda rows: named(offers=rows), "postedDate", "workMode", "description")


@query("src01_teamtailor", f"""{LN} SELECT p_name AS title, 'https://t.example.com/' || l_partkey AS url, CASE WHEN l_quantity > 25 THEN p_type ELSE company END AS company,
    CASE WHEN l_quantity > 25 THEN 'Malmö, ' || p_type ELSE p_type END AS location, iso AS "postedDate" FROM ln WHERE l_quantity > 5""")
def teamtailor(t):
    place = lambda x: named(address=named(addressLocality=heavy(x, lit("Malmö"), x["p_type"]), addressCountry=x["p_type"]))
    return read(t, "teamtailor", lambda x: named(
        title=F.when(x["l_quantity"] > 5, x["p_name"]), url=F.concat(lit("https://t.example.com/"), key(x)),
        _jobposting=named(datePosted=day(x), jobLocation=F.array(place(x)), hiringOrganization=named(name=heavy(x, x["p_type"], lit(" "))))),
        lambda rows: named(items=rows), "postedDate")


@query("src01_breezy", f"""{LN} SELECT p_name AS title, 'https://b.example.com/' || l_partkey AS url, company, CASE WHEN l_quantity > 25 THEN 'Town, ' || p_type ELSE lower(p_type) END AS location, iso AS "postedDate",
    CASE WHEN l_quantity > 40 THEN 'anywhere' WHEN l_quantity > 25 THEN 'remote' ELSE '' END AS "workMode", p_type AS department FROM ln""")
def breezy(t):
    return read(t, "breezy", lambda x: named(
        name=x["p_name"], url=F.concat(lit("https://b.example.com/"), key(x)), published_date=day(x, "yyyy-MM-dd'T'HH:mm:ss'Z'"), department=x["p_type"],
        locations=F.array(named(name=heavy(x, lit("Town"), F.lower(x["p_type"])), country=named(name=x["p_type"]), is_remote=x["l_quantity"] > 25,
                                remote_details=named(value=F.when(x["l_quantity"] > 40, lit("Remote-Anywhere")).otherwise(lit("remote-location")))))),
        lambda rows: rows, "postedDate", "workMode", "department")


@query("src01_bamboohr", f"""{LN} SELECT DISTINCT p_name AS title, '{ORIGIN}/careers/' || l_partkey AS url, company, 'Leamington, ' || p_type AS location, 'remote' AS "workMode", p_type AS department FROM ln""")
def bamboohr(t):
    return read(t, "bamboohr", lambda x: named(
        id=x["l_partkey"], jobOpeningName=F.concat(lit(" "), x["p_name"]), departmentLabel=x["p_type"], isRemote=lit(True),
        atsLocation=named(city=lit("Leamington, England"), state=x["p_type"], country=x["p_type"])), lambda rows: named(result=F.concat(rows, rows)), "workMode", "department")


@query("src01_hibob", f"""{LN} SELECT DISTINCT p_name AS title, '{ORIGIN}/jobs?jobId=a%20' || l_partkey AS url, company, CASE WHEN l_partkey % 2 = 0 THEN 'London Studio' ELSE p_type END AS location,
    CASE WHEN l_partkey % 2 = 0 THEN 'hybrid' ELSE 'remote' END AS "workMode" FROM ln""")
def hibob(t):
    even = lambda x, a, b: F.when(x["l_partkey"] % 2 == 0, a).otherwise(b)
    return read(t, "hibob", lambda x: named(
        id=F.concat(lit("a "), key(x)), title=x["p_name"], site=even(x, lit("London Studio"), lit("Remote")), country=x["p_type"],
        workspaceType=even(x, lit("Hybrid"), lit(""))), lambda rows: named(jobAdDetails=F.concat(rows, rows)), "workMode")


@query("src01_huntflow", f"""{LN} SELECT DISTINCT p_name AS title, '{ORIGIN}/vacancy/v-' || l_partkey AS url, company, CASE WHEN l_partkey % 3 = 1 THEN 'Minsk or Remote' ELSE 'Minsk' END AS location,
    CASE WHEN l_partkey % 3 = 1 THEN 'remote' ELSE '' END AS "workMode", p_type AS department FROM ln WHERE l_partkey % 3 > 0 AND l_partkey % 7 > 0""")
def huntflow(t):
    return read(t, "huntflow", lambda x: named(
        slug=F.concat(F.when(x["l_partkey"] % 3 == 0, lit("a/b")).otherwise(lit("v-")), key(x)), position=x["p_name"], division=x["p_type"],
        city=F.when(x["l_partkey"] % 3 == 1, lit("Minsk or Remote")).otherwise(lit("Minsk")), archived_at=F.when(x["l_partkey"] % 7 == 0, day(x))),
        lambda rows: named(items=F.concat(rows, rows)), "workMode", "department")


@query("src01_rippling", f"""{LN} SELECT p_name AS title, 'https://r.example.com/' || l_partkey AS url, company, CASE WHEN l_quantity > 40 THEN '' ELSE p_type END AS location,
    CASE WHEN l_quantity > 40 THEN 'remote' WHEN l_quantity > 25 THEN 'hybrid' ELSE '' END AS "workMode", p_type AS department FROM ln""")
def rippling(t):
    label = lambda x: F.when(x["l_quantity"] > 40, lit("Remote")).otherwise(heavy(x, F.concat(lit("Hybrid ("), x["p_type"], lit(")")), x["p_type"]))
    return read(t, "rippling", lambda x: named(
        name=x["p_name"], url=F.concat(lit("https://r.example.com/"), key(x)), department=named(label=x["p_type"]),
        workLocation=named(label=F.when(x["l_quantity"] > 10, label(x))), workLocations=F.array(label(x))), lambda rows: rows, "workMode", "department")


@query("src01_workday", f"""{LN} SELECT p_name AS title, '{ORIGIN}/job/' || l_partkey AS url, company, p_type AS location FROM ln WHERE l_quantity > 5""")
def workday(t):
    return read(t, "workday", lambda x: named(
        title=x["p_name"], externalPath=F.when(x["l_quantity"] > 5, F.concat(lit("/job/"), key(x))), locationsText=x["p_type"]), lambda rows: named(total=F.size(rows), jobPostings=rows))


@query("src01_workable", f"""{LN} SELECT p_name AS title, 'https://apply.workable.com/j/' || l_partkey AS url, company, 'Riga, ' || p_type AS location, iso AS "postedDate", p_type AS department FROM ln WHERE l_quantity > 10""")
def workable(t):
    return read(t, "workable", lambda x: named(
        title=x["p_name"], shortcode=heavy(x, key(x), lit("")),
        url=F.when(x["l_quantity"] <= 25, F.concat(F.when(x["l_quantity"] > 10, lit("https://apply.workable.com/j/")).otherwise(lit("http://workable.com/j/")), key(x))),
        city=lit("Riga"), state=lit(" "), country=x["p_type"], published_on=day(x), department=x["p_type"]), lambda rows: named(jobs=rows), "postedDate", "department")


@query("src01_personio", f"""{LN} SELECT DISTINCT p_name AS title, '{ORIGIN}/job/' || l_partkey AS url, company, p_type AS location, '' AS department FROM ln""")
def personio(t):
    return read(t, "personio", lambda x: named(id=x["l_partkey"], name=x["p_name"], office=x["p_type"]), lambda rows: F.concat(rows, rows), "department")


@query("src01_aggregate", f"""{LN} SELECT p_name AS title, 'https://a.example.com/' || l_partkey AS url, p_type AS company, 'Oslo' AS location, iso AS "postedDate", CASE WHEN l_quantity > 25 THEN 'onsite' ELSE 'remote' END AS "workMode", 'lever' AS ats FROM ln""")
def aggregate(t):
    return read(t, "aggregate", lambda x: named(
        title=x["p_name"], source_url=F.concat(lit("https://a.example.com/"), key(x)), company=x["p_type"], location=lit("Oslo"), posted_at=day(x), source_ats=lit("lever"),
        workplace=heavy(x, lit("On-site"), lit("unknown")), remote=lit(True)), lambda rows: rows, "postedDate", "workMode", "ats")


@query("src01_eightfold", f"""{LN} SELECT DISTINCT p_name AS title, 'https://e.example.com/' || l_partkey AS url, company, 'Seoul' AS location, '2024-05-06T07:08:09.000Z' AS "postedDate", 'hybrid' AS "workMode", p_type AS department FROM ln""")
def eightfold(t):
    return read(t, "eightfold", lambda x: named(
        name=x["p_name"], positionUrl=F.concat(lit("https://e.example.com/"), key(x)), location=lit("Seoul"), t_update=lit(1714979289), work_location_option=lit("hybrid"),
        business_unit=x["p_type"]), lambda rows: named(positions=F.concat(rows, rows)), "postedDate", "workMode", "department")


@query("src06_zohorecruit", f"""{LN} SELECT DISTINCT p_name || ' "A&B"' AS title, '{ORIGIN}/jobs/Careers/' || l_partkey AS url, company, 'Pune, ' || p_type AS location, 'remote' AS "workMode" FROM ln WHERE l_partkey % 4 > 0""")
def zohorecruit(t):
    render = lambda x: named(id=key(x), Job_Opening_Name=F.concat(x["p_name"], lit(' "A&B"')), City=lit("Pune"), Country=x["p_type"], Remote_Job=lit(True), Publish=x["l_partkey"] % 4 > 0)
    page = payload(t, render, lambda rows: F.concat(lit('<html><input type="hidden" id="jobs" value="'), F.replace(F.replace(
        F.to_json(F.concat(rows, rows)), lit("&"), lit("&amp;")), lit('"'), lit("&#34;")), lit('"></html>')))
    return shapes.postings(page.withColumn("origin", lit(ORIGIN)), shapes.SHAPES["zohorecruit"])


@query("src06_greetinghr", f"""{LN} SELECT DISTINCT p_name AS title, '{ORIGIN}/o/' || l_partkey AS url, company, CASE WHEN l_partkey % 2 = 0 THEN 'Seongnam, South Korea' ELSE '' END AS location,
    CASE WHEN l_partkey % 2 = 0 THEN 'onsite' ELSE 'remote' END AS "workMode", p_type AS department FROM ln WHERE l_partkey % 3 = 0""")
def greetinghr(t):
    opening = lambda x: named(openingId=x["l_partkey"], deploy=x["l_partkey"] % 3 != 1, title=F.when(x["l_partkey"] % 3 == 2, lit("Talent  Pool")).otherwise(x["p_name"]),
                              openingJobPosition=named(openingJobPositions=F.array(named(workspaceOccupation=named(occupation=x["p_type"]), workspacePlace=named(
                                  place=F.when(x["l_partkey"] % 2 == 0, lit(" Seongnam")).otherwise(lit("")), workFromHome=x["l_partkey"] % 2 == 1)))))
    cached = lambda name, rows: named(queryKey=F.array(lit(name)), state=named(data=rows))
    page = payload(t, opening, lambda rows: F.concat(lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(named(props=named(pageProps=named(dehydratedState=named(
        queries=F.array(cached("career", F.slice(rows, 1, 0)), cached("openings", F.concat(rows, rows)))))))), lit("</script>")))
    return shapes.postings(page.withColumn("origin", lit(ORIGIN)), shapes.SHAPES["greetinghr"]).select("title", "url", "company", "location", "workMode", "department")


@query("src01_rejected", """SELECT 'Co' || o_orderkey AS company, CASE o_orderkey % 5 WHEN 0 THEN 'no body' WHEN 1 THEN 'not JSON' ELSE 'no list' END AS reason, CASE o_orderkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '{"items": [' WHEN 2 THEN '{"items": {}}' ELSE 'null' END AS body
    FROM orders WHERE o_orderkey % 5 < 4""")
def broken(t):
    kind = C("o_orderkey") % 5
    body = F.when(kind == 0, " ").when(kind == 1, '{"items": [').when(kind == 2, '{"items": {}}').when(kind == 3, "null").otherwise('{"items": []}')
    landed = t.read("orders").select(F.concat(lit("Co"), C("o_orderkey").cast("string")).alias("company"), body.alias("body"))
    return shapes.rejected(landed, shapes.SHAPES["huntflow"])
