"""Filters over postings, applications, companies, pages and sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import classify, health, predicates, snapshot, targeting
from ..plans.tables import SEQ
from .registry import query

C = F.col
KEY = [C(f"landing.{s}").alias(s) for s in SEQ]
KEYS = ", ".join(SEQ).replace("l_linenumber", "CAST(l_linenumber AS BIGINT) AS l_linenumber")

TITLE_POSITIVE, TITLE_NEGATIVE = ["Widget", "gear", "bolt"], ["OLD ", "promo"]


@query("flt01_title_filter", f"""SELECT {KEYS}, title FROM posting
  WHERE regexp_matches(lower(title), 'widget|gear|bolt') AND NOT regexp_matches(lower(title), 'old |promo')""")
def flt01(t):
    return t.posting.filter(predicates.title_filter(C("title"), TITLE_POSITIVE, TITLE_NEGATIVE)).select(*KEY, "title")


LOCATIONS = {"always_allow": ["Europe"], "block": ["remote", "ASIA", " "], "allow": ["nation_1", "africa"]}


@query("flt02_location_filter", f"""SELECT {KEYS}, location FROM posting
  WHERE CASE WHEN trim(location) = '' THEN TRUE WHEN contains(lower(location), 'europe') THEN TRUE
    WHEN regexp_matches(lower(location), 'remote|asia') THEN FALSE ELSE regexp_matches(lower(location), 'nation_1|africa') END""")
def flt02(t):
    return t.posting.filter(predicates.location_filter(C("location"), LOCATIONS)).select(*KEY, "location")


FLAT = {"combine": "min", "role": {"widget": 1.0, "gear": 0.8, "promo": 0, "default": 0.3},
        "location": {"europe": 1.0, "asia": 0, "default": 0.5}, "company": {"/supplier#0+7/": 0, "default": 1}}


@query("flt04_targeting_gate", f"""SELECT {KEYS}, title, location, company FROM posting
  WHERE NOT regexp_matches(title, '(?i)(^|[^A-Za-z0-9])promo') AND NOT regexp_matches(location, '(?i)(^|[^A-Za-z0-9])asia')
    AND NOT regexp_matches(company, '(?i)\\bsupplier#0+7')""")
def flt04(t):
    return targeting.flat_gate(t.posting, FLAT).select(*KEY, "title", "location", "company")


BLOCKED = ["supplier#000000003 studios", " Supplier#000000005 Studios ", "Supplier#000000009"]


@query("flt05_employer_blocklist", f"""SELECT {KEYS}, company,
    coalesce(filtered, FALSE) OR (lower(trim(company)) IN ('supplier#000000003 studios', 'supplier#000000005 studios', 'supplier#000000009')
      AND regexp_extract(url, '^https?://(?:www\\.)?([^/]+)', 1) IN ('gamejobs.co', 'gamedevjobs.com')) AS filtered FROM posting""")
def flt05(t):
    return predicates.flag_blocked(t.posting, BLOCKED, snapshot.AGGREGATORS).select(*KEY, "company", "filtered")


@query("flt06_fuzzy_blocklist", f"""WITH b AS (SELECT DISTINCT regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k, lower(c_name) AS low FROM customer WHERE c_acctbal < 0),
  names AS (SELECT DISTINCT company FROM posting)
  SELECT {KEYS}, company FROM posting WHERE company IN (SELECT company FROM names n WHERE EXISTS (SELECT 1 FROM b
    WHERE b.low = lower(n.company) OR (length(k) >= 6 AND contains(regexp_replace(lower(n.company), '[^a-z0-9]', '', 'g'), right(k, 9)))))""")
def flt06(t):
    # block list: numbers of customers in debt, met inside the employer names
    blocked = t.read("customer").filter("c_acctbal < 0").select(F.right(C("c_name"), F.lit(9)).alias("name"))
    return predicates.fuzzy_blocked_join(t.posting, blocked).select(*KEY, "company")


@query("flt07_off_theme", r"""SELECT s_name, p_name,
    regexp_matches(s_name || p_name, '(?i)\b(small|animation studios?|slots?|hot rod)\b') OR regexp_matches(regexp_replace(lower(s_name || p_name), '[^a-z0-9]', '', 'g'), '(redanvil|bluegizmo)') AS off_theme
  FROM (SELECT DISTINCT s_name || ' ' AS s_name, p_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)""")
def flt07(t):
    rows = (t.read("lineitem").join(t.read("part"), C("l_partkey") == C("p_partkey"))
            .join(t.read("supplier"), C("l_suppkey") == C("s_suppkey"))
            .select(F.concat("s_name", F.lit(" ")).alias("s_name"), "p_name").distinct())
    return rows.withColumn("off_theme", predicates.off_theme(
        F.concat("s_name", "p_name"), r"\b(small|animation studios?|slots?|hot rod)\b", "(redanvil|bluegizmo)"))


GROUPS = [
    {"name": "Role", "field": "title", "combine": "min", "weight": 3, "filters": [
        {"name": "Widget", "keywords": ["widget", "gizmo"], "weight": 1.5},
        {"name": "Rods", "keywords": ["/r(od|ing)/"], "weight": 0.6, "unless": ["Remote"]},
        {"name": "Old", "keywords": ["old"], "weight": 0},
        {"name": "Other", "else": True, "weight": 0.8}]},
    {"name": "Region", "field": ["location", "workmode"], "combine": "max", "weight": 2, "filters": [
        {"name": "Remote", "keywords": ["remote"], "weight": 1.2, "priority": True},
        {"name": "Asia", "keywords": ["asia"], "weight": 0},
        {"name": "Europe", "keywords": ["europe", "/(middle) east/"], "weight": 1.1},
        {"name": "Muted", "keywords": ["hybrid"]}]},
    {"name": "Company", "field": "company", "combine": "avg", "weight": 1, "filters": [
        {"keywords": ["supplier"], "weight": 0.9}, {"keywords": ["/studios?/"], "weight": 0.7, "unless": ["nowhere"]},
        {"name": "Blocked", "keywords": ["/0+13\\b/"], "weight": 0, "unless": ["Widget"]}]},
]
# The group configuration above, filter by filter, as SQL booleans.
GROUP_SQL = r"""
  h AS (SELECT *, regexp_matches(title, '(?i)(^|[^A-Za-z0-9])(widget|gizmo)') AS widget, regexp_matches(title, '(?i)\br(od|ing)') AS rods,
      regexp_matches(title, '(?i)(^|[^A-Za-z0-9])old') AS old,
      regexp_matches(location || ' ' || coalesce(workMode, ''), '(?i)(^|[^A-Za-z0-9])remote') AS remote,
      regexp_matches(location || ' ' || coalesce(workMode, ''), '(?i)(^|[^A-Za-z0-9])asia') AS asia,
      regexp_matches(location || ' ' || coalesce(workMode, ''), '(?i)((^|[^A-Za-z0-9])europe|\b(middle)\s+east)') AS europe,
      regexp_matches(company, '(?i)(^|[^A-Za-z0-9])supplier') AS supplier, regexp_matches(company, '(?i)\bstudios?') AS studios,
      regexp_matches(company, '(?i)\b0+13\b') AS thirteen FROM posting),
  m AS (SELECT *, rods AND NOT remote AS m_rods, NOT (widget OR (rods AND NOT remote) OR old) AS m_other, asia AND NOT remote AS m_asia,
      thirteen AND NOT widget AS m_blocked FROM h),
  s AS (SELECT *, coalesce(least(CASE WHEN widget THEN 1.5 END, CASE WHEN m_rods THEN 0.6 END, CASE WHEN old THEN 0.0 END, CASE WHEN m_other THEN 0.8 END), 0.5)::DOUBLE AS s1,
      coalesce(greatest(CASE WHEN remote THEN 1.2 END, CASE WHEN m_asia THEN 0.0 END, CASE WHEN europe THEN 1.1 END), 0.5)::DOUBLE AS s2,
      CASE WHEN supplier OR studios OR m_blocked THEN ((CASE WHEN supplier THEN 0.9 ELSE 0 END) + (CASE WHEN studios THEN 0.7 ELSE 0 END))
        / ((CASE WHEN supplier THEN 1 ELSE 0 END) + (CASE WHEN studios THEN 1 ELSE 0 END) + (CASE WHEN m_blocked THEN 1 ELSE 0 END)) ELSE 0.5 END AS s3,
      old OR m_asia OR m_blocked AS excluded FROM m)"""


@query("flt08_drop_reason", f"""WITH {GROUP_SQL} SELECT {KEYS}, CASE WHEN old THEN 'title' WHEN m_asia THEN 'location' WHEN m_blocked THEN 'company' END AS drop_reason FROM s""")
def flt08(t):
    return targeting.score_groups(t.posting.withColumn("skills", F.lit(None).cast("array<string>")), GROUPS).select(*KEY, "drop_reason")


@query("flt10_sector_blocklist", f"SELECT {KEYS}, department FROM posting WHERE coalesce(trim(lower(department)), '') NOT IN ('promo', 'large')")
def flt10(t):
    return t.posting.filter(predicates.sector_allowed(C("department"), [" Promo", "LARGE", ""])).select(*KEY, "department")


@query("flt11_source_scope", """SELECT doc_id, source, lang, source NOT IN ('src1', 'src7') AS in_scope,
    source = 'src1' OR regexp_replace(lower(lang), '[^a-z0-9]', '', 'g') = 'src1' AS pinned FROM documents""")
def flt11(t):
    return t.documents.select(
        "doc_id", "source", "lang",
        predicates.in_source_scope(C("source"), C("source"), C("lang"), ["src1", "src7"]).alias("in_scope"),
        predicates.in_source_scope(C("source"), C("source"), C("lang"), [], studio="SRC1").alias("pinned"))


@query("flt12_allow_lists", f"SELECT {KEYS} FROM posting WHERE regexp_matches(lower(location), 'europe|nation_2') AND contains(lower(title), 'ring')")
def flt12(t):
    keep = predicates.allow_list(C("location"), ["Europe", " NATION_2 "]) & predicates.allow_list(C("title"), "ring") & predicates.allow_list(C("title"), [" "])
    return t.posting.filter(keep).select(*KEY)


@query("flt13_entry_selected", "SELECT seq, name FROM company WHERE coalesce(enabled, TRUE) AND contains(lower(name), 'nation_1')")
def flt13(t):
    return t.company.filter(predicates.entry_selected(C("enabled"), C("name"), "Nation_1")).select("seq", "name")


# Addresses as they come: pages, mail addresses, private hosts and plain words.
_GUARDED = """SELECT page_id, url, CASE WHEN contains(url, '#') THEN 'mailto:jobs@example.com' WHEN contains(url, '?page') THEN 'not a url'
  WHEN contains(url, 'spam') THEN 'http://192.168.0.7/' || page_id WHEN contains(url, '//m.') THEN 'ftp://m.example.com/x'
  WHEN contains(url, '//blog') THEN 'https://LOCALHOST:8080/x' ELSE url END AS link FROM pages"""


def _guarded(t):
    u = C("url")
    link = (F.when(F.contains(u, F.lit("#")), F.lit("mailto:jobs@example.com")).when(F.contains(u, F.lit("?page")), F.lit("not a url"))
            .when(F.contains(u, F.lit("spam")), F.concat(F.lit("http://192.168.0.7/"), C("page_id").cast("string")))
            .when(F.contains(u, F.lit("//m.")), F.lit("ftp://m.example.com/x"))
            .when(F.contains(u, F.lit("//blog")), F.lit("https://LOCALHOST:8080/x")).otherwise(u))
    return t.pages.select("page_id", link.alias("link"))


@query("flt14_url_guard", f"""WITH g AS ({_GUARDED}), k AS (SELECT page_id, link, CASE WHEN NOT contains(link, ':') THEN 'invalid_url'
    WHEN NOT regexp_matches(link, '^https?:') THEN 'unsupported_protocol' WHEN regexp_matches(lower(link), '^https?://(192\\.168\\.|localhost)') THEN 'blocked_host' END AS code FROM g)
  SELECT page_id, link, code, CASE WHEN code = 'blocked_host' THEN 'skipped_blocked_host' WHEN code IS NOT NULL THEN 'skipped_invalid_url' END AS status FROM k""")
def flt14(t):
    return _guarded(t).withColumn("code", urls.guard_code(C("link"))).withColumn("status", urls.guard_status(C("code")))


@query("flt15_aged_tail", f"SELECT {KEYS}, url FROM posting WHERE postedDate < TIMESTAMP '2001-01-01' - INTERVAL 45 DAY")
def flt15(t):
    return t.posting.filter(predicates.aged(C("url"), C("postedDate"), F.to_timestamp(F.lit("2001-01-01")), 45)).select(*KEY, "url")


BOARD_SQL = """b AS (SELECT *, CASE WHEN regexp_matches(s, 'no aplicar|no_aplicar|geo blocker') OR s = 'skip' THEN 'skip'
      WHEN regexp_matches(s, 'interview|entrevista') THEN 'interview' WHEN s = 'offer' OR contains(s, 'oferta') THEN 'offer'
      WHEN regexp_matches(s, 'responded|respondido') THEN 'responded' WHEN regexp_matches(s, 'applied|aplicado') OR s IN ('enviada', 'aplicada', 'sent') THEN 'applied'
      WHEN regexp_matches(s, 'rejected|rechazado') OR s = 'rechazada' THEN 'rejected'
      WHEN regexp_matches(s, 'discarded|descartado|^dup') OR s IN ('descartada', 'cerrada', 'cancelada') THEN 'discarded'
      WHEN regexp_matches(s, 'evaluated|evaluada') OR s IN ('condicional', 'hold', 'monitor', 'evaluar', 'verificar') THEN 'evaluated' ELSE s END AS state,
      coalesce(TRY_CAST(regexp_extract(score, '(\\d+\\.?\\d*)/5', 1) AS DOUBLE), 0) AS points FROM
    (SELECT *, regexp_replace(lower(trim(replace(status, '**', ''))), '^(.+?) 202.*$', '\\1') AS s FROM application))"""


def board(t):
    from ..operators.reports import board as read
    return read(t.application)


@query("flt16_board_tabs", f"""WITH {BOARD_SQL} SELECT num, 'top' AS tab FROM b WHERE points >= 4.0 AND state <> 'skip'
  UNION ALL SELECT num, 'interview' FROM b WHERE state = 'interview'""")
def flt16(t):
    rows = board(t)
    # one pass: the tabs a row belongs to
    tabs = F.array_compact(F.array(*[F.when(predicates.on_tab(x, C("state"), C("points")), F.lit(x)) for x in ("top", "interview")]))
    return rows.select("num", F.explode(tabs).alias("tab"))


@query("flt17_search", "SELECT num, company, role FROM application WHERE contains(lower(company), 'rig') OR contains(lower(role), 'rig') OR contains(lower(notes), 'rig')")
def flt17(t):
    return t.application.filter(predicates.search("RIG", C("company"), C("role"), C("notes"))).select("num", "company", "role")


BATCH_SQL = """bi AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS id,
    'https://jackjill.example.com/' || o_orderkey AS url, 'mail' AS source, CASE WHEN o_orderstatus = 'P' THEN 'no details' ELSE
    'Engine Programmer ' || o_orderpriority || ' @ ' || c_name || ' | 80% | ' || CASE WHEN o_orderstatus = 'F' THEN 'https://real.example.com/' || o_orderkey ELSE 'n/a' END END AS notes
    FROM orders JOIN customer ON o_custkey = c_custkey),
  st AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'failed' ELSE 'running' END AS status,
    CAST(o_custkey AS VARCHAR) AS report_num, CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) AS VARCHAR) AS score,
    CAST(floor(o_totalprice / 100000) AS BIGINT) AS retries FROM orders WHERE o_orderstatus <> 'O')"""


def batch(t):
    o = t._orders()
    key = C("o_orderkey").cast("string")
    real = F.when(C("o_orderstatus") == "F", F.concat(F.lit("https://real.example.com/"), key)).otherwise(F.lit("n/a"))
    return o.select(
        F.when(C("o_orderpriority") == "5-LOW", F.concat(F.lit("x"), key)).otherwise(key).alias("id"),
        F.concat(F.lit("https://jackjill.example.com/"), key).alias("url"), F.lit("mail").alias("source"),
        F.when(C("o_orderstatus") == "P", F.lit("no details")).otherwise(F.concat(
            F.lit("Engine Programmer "), "o_orderpriority", F.lit(" @ "), "c_name", F.lit(" | 80% | "), real)).alias("notes"))


def batch_state(t):
    return t.read("orders").filter("o_orderstatus <> 'O'").select(
        C("o_orderkey").cast("string").alias("id"),
        F.when(C("o_orderpriority") == "1-URGENT", "completed").when(C("o_orderpriority") == "2-HIGH", "failed").otherwise("running").alias("status"),
        C("o_custkey").cast("string").alias("report_num"),
        F.floor(C("o_totalprice") / 10000).cast("string").alias("score"), F.floor(C("o_totalprice") / 100000).alias("retries"))


@query("flt18_pending_batch", f"""WITH {BATCH_SQL} SELECT bi.id, coalesce(status, 'none') AS status, coalesce(retries, 0) AS retries FROM bi LEFT JOIN st USING (id)
  WHERE regexp_matches(bi.id, '^[0-9]+$') AND CAST(bi.id AS BIGINT) >= 100 AND coalesce(status, 'none') <> 'completed' AND (coalesce(status, 'none') <> 'failed' OR retries < 3)""")
def flt18(t):
    return predicates.pending_batch(batch(t), batch_state(t), max_retries=3, start_from=100).select("id", "status", "retries")


@query("flt21_has_context", """SELECT c_custkey, c_acctbal > 5000 OR c_mktsegment = 'BUILDING' OR c_nationkey > 20 AS has_context FROM customer""")
def flt21(t):
    seg = C("c_mktsegment") == "BUILDING"
    return t.read("customer").select("c_custkey", predicates.has_context(
        logo=F.when(C("c_acctbal") > 5000, F.lit("logo")), games=F.when(seg, F.array("c_name")).otherwise(F.array().cast("array<string>")),
        founded=F.lit(None), country=F.when(C("c_nationkey") > 20, C("c_nationkey")), description=F.lit(""), website=F.lit(None)).alias("has_context"))


@query("flt22_bare_city", """SELECT DISTINCT location, trim(location) <> '' AND NOT contains(location, ',') AND lower(trim(location)) NOT IN ('nation_3', 'nation_4') AS bare FROM
  (SELECT CASE WHEN c_acctbal < 0 THEN n_name || ', ' || r_name WHEN c_acctbal > 9000 THEN '' ELSE n_name END AS location FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def flt22(t):
    places = (t.read("customer").join(t.read("nation"), C("c_nationkey") == C("n_nationkey"))
              .join(t.read("region"), C("n_regionkey") == C("r_regionkey"))
              .select(F.when(C("c_acctbal") < 0, F.concat("n_name", F.lit(", "), "r_name")).when(C("c_acctbal") > 9000, F.lit(""))
                      .otherwise(C("n_name")).alias("location")).distinct())
    return places.withColumn("bare", predicates.bare_city(C("location"), ["nation_3", "nation_4"]))


_CELLS = "SELECT doc_id, unnest(regexp_split_to_array(text, '[.\\n]')) AS cell FROM documents"


@query("flt23_company_shaped", f"""WITH c AS (SELECT doc_id, trim(trim(cell) || CASE WHEN length(cell) < 30 THEN ' Ltd' ELSE '' END) AS cell FROM ({_CELLS}))
  SELECT doc_id, cell, count(*) AS n FROM c WHERE length(cell) BETWEEN 3 AND 45 AND NOT regexp_matches(cell, '[.,;:!?()/]|[0-9]') AND cell <> upper(cell)
    AND len(regexp_split_to_array(cell, '\\s+')) <= 6 AND regexp_matches(cell, '(?i)\\s+(AB|Aktiebolag|HB|AS|ApS|Oy|Ltd|Inc|LLC|GmbH)\\.?$') GROUP BY ALL""")
def flt23(t):
    cells = t.documents.select("doc_id", F.explode(F.split("text", r"[.\n]")).alias("raw"))
    cell = F.concat(F.trim("raw"), F.when(F.length("raw") < 30, F.lit(" Ltd")).otherwise(F.lit("")))
    return (cells.select("doc_id", F.trim(cell).alias("cell")).filter(predicates.company_shaped(C("cell")))
            .groupBy("doc_id", "cell").agg(F.count("*").alias("n")))


@query("flt24_defunct", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def flt24(t):
    end_year = F.when(C("o_orderstatus") == "F", F.year("o_orderdate"))
    return t.read("orders").withColumn("endYear", end_year).filter("endYear IS NULL").select("o_orderkey", "o_custkey")


@query("flt25_detail_drop", f"""SELECT {KEYS}, CASE WHEN p_size > 10 THEN 'Detail ' || p_brand ELSE department END AS department FROM posting JOIN part ON l_partkey = p_partkey WHERE NOT (p_size > 45)""")
def flt25(t):
    detail = t.read("part").select(C("p_partkey").alias("pk"), (C("p_size") > 45).alias("drop"), F.when(
        C("p_size") > 10, F.concat(F.lit("Detail "), "p_brand")).otherwise(F.lit("")).alias("department")).filter("drop or department != ''")
    rows = t.posting.withColumn("pk", C("landing.l_partkey"))
    return snapshot.overlay_detail(rows, detail, "pk", ["department"]).select(*KEY, "department")


HEALTH_SQL = """SELECT company AS source, count(*) AS attempted, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok AND kind = 'throttled') AS throttled,
  count(*) FILTER (NOT ok AND kind = 'blocked') AS blocked, count(*) FILTER (NOT ok AND kind = 'http') AS other FROM outcome GROUP BY company, run"""


@query("flt26_publish_gate", """SELECT company, run, count(*) AS attempted FROM outcome GROUP BY company, run
  HAVING count(*) >= 2 AND count(*) FILTER (ok) = 0 AND count(*) FILTER (kind IN ('throttled', 'blocked')) = count(*)""")
def flt26(t):
    per = t.outcome.withColumn("source", F.struct("company", "run"))
    return health.blackouts(health.source_health(per)).select("source.company", "source.run", "attempted")


@query("flt27_backlog", """SELECT seq, name FROM company WHERE NOT CASE WHEN recipe IN ('json', 'html') THEN TRUE WHEN recipe IN ('blocked', 'browser', 'unresolved') THEN FALSE
  WHEN parser IS NOT NULL OR provider IS NOT NULL THEN TRUE WHEN status = 'unresolved' THEN FALSE WHEN careers_url IS NOT NULL THEN TRUE ELSE FALSE END AND coalesce(recipe, '') <> 'blocked'""")
def flt27(t):
    return predicates.backlog(t.company).select("seq", "name")
