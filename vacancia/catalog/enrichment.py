"""Classification and enrichment queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import strict_date
from ..functions.numbers import leading_number
from ..functions.text import contacts
from ..operators import classify, companies, reports
from .filters import BOARD_SQL, KEY, KEYS, board
from .registry import query

C = F.col
VOCABULARY = {"The": ["the"], "French": ["/(les|des) /", "avec"], "German": ["nicht"], "Mail": ["@mail"], "Never": ["zzzzqqq"]}
_VOCAB_SQL = {"The": r"(^|[^A-Za-z0-9])the", "French": r"(\b(les|des)\s+|(^|[^A-Za-z0-9])avec)", "German": r"(^|[^A-Za-z0-9])nicht",
              "Mail": "@mail", "Never": r"(^|[^A-Za-z0-9])zzzzqqq"}
_TAGS = "concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in _VOCAB_SQL.items()) + ")"


@query("enr01_skills", f"""SELECT doc_id, CASE WHEN lang <> 'es' THEN {_TAGS} END AS tags FROM documents""")
def enr01(t):
    text = F.when(C("lang") != "es", C("text"))  # Spanish texts stand for descriptions never fetched
    return t.documents.select("doc_id", F.array_join(classify.skills(text, VOCABULARY), "|").alias("tags"))


# sponsorship with words of the test texts: the guard and both phrase lists are parameters
_NONE, _SOME = [r"\bthe\s+(?:of|and)\b[^.!?]{0,24}the\w*", r"\bnicht\s+der\b"], [r"\b(?:with|from)\s+the\b", r"\bdes\s+les\b"]


@query("enr02_sponsorship", r"""SELECT doc_id, CASE WHEN contains(t, 'the') OR contains(t, 'des') THEN
    CASE WHEN contains(t, 'the') AND regexp_matches(t, '\bthe\s+(?:of|and)\b[^.!?]{0,24}the\w*|\bnicht\s+der\b') THEN 'none'
      WHEN contains(t, 'the') AND regexp_matches(t, '\b(?:with|from)\s+the\b|\bdes\s+les\b') THEN 'offered' END END AS stance
  FROM (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM documents)""")
def enr02(t):
    return t.documents.select("doc_id", classify.sponsorship(C("text"), "the", _NONE, _SOME).alias("stance"))


@query("enr03_experience")
def enr03(t):
    from ..operators.experience import with_experience
    # every description carries its size as a requirement sentence, so that all rows take the full rule
    text = F.concat("text", F.lit(" We ask for at least "), (C("n_chars") % 20 + 1).cast("string"),
                    F.lit("+ years of industry experience with the team."))
    rows = with_experience(t.documents.select("doc_id", text.alias("text")), VOCABULARY)
    return rows.select("doc_id", "experience.years", "experience.label", "experience.context", "experience.industry",
                       F.array_join("experience.skills", "|").alias("skills"))


@query("enr04_detail_needed", f"SELECT doc_id, CASE WHEN trim(text) <> '' AND lang <> 'de' THEN {_TAGS} END AS tags FROM documents")
def enr04(t):
    from ..plans.plugins import apply_enrichers, skills_enricher
    rows = t.documents.withColumn("text", F.when(C("lang") != "de", C("text")))
    return apply_enrichers(rows, [skills_enricher(VOCABULARY)]).select("doc_id", F.array_join("skills", "|").alias("tags"))


# spellings of arrangements, one per event type
_MODES = {"click": "Fully_Remote", "view": " On-Site ", "purchase": "Work from anywhere", "signup": "HYBRID", "error": "unspecified"}


@query("enr05_work_mode", """SELECT event_id, CASE event_type WHEN 'click' THEN 'remote' WHEN 'view' THEN 'onsite' WHEN 'purchase' THEN 'anywhere' WHEN 'signup' THEN 'hybrid' ELSE '' END AS mode FROM events""")
def enr05(t):
    return t.read("events").select("event_id", classify.work_mode(classify.lookup(C("event_type"), _MODES)).alias("mode"))


_PLACES_SQL = """SELECT c_custkey, n_name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN n_name || ', Remote' WHEN 'BUILDING' THEN 'Remote (' || n_name || ')'
    WHEN 'FURNITURE' THEN n_name || ' - Hybrid or Remote' WHEN 'HOUSEHOLD' THEN 'Anywhere' ELSE n_name || ', Onsite; Germany' END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _places(t):
    n, seg = C("n_name"), C("c_mktsegment")
    place = (F.when(seg == "AUTOMOBILE", F.concat(n, F.lit(", Remote"))).when(seg == "BUILDING", F.concat(F.lit("Remote ("), n, F.lit(")")))
             .when(seg == "FURNITURE", F.concat(n, F.lit(" - Hybrid or Remote"))).when(seg == "HOUSEHOLD", F.lit("Anywhere"))
             .otherwise(F.concat(n, F.lit(", Onsite; Germany"))))
    return t.read("customer").join(t.read("nation"), C("c_nationkey") == C("n_nationkey")).select("c_custkey", n, seg, place.alias("place"))


@query("enr06_location_split", f"""SELECT c_custkey, CASE WHEN place = 'Anywhere' THEN '' WHEN place LIKE '%Germany' THEN n_name || ', Germany' ELSE n_name END AS place,
    CASE WHEN place = 'Anywhere' THEN 'anywhere' WHEN contains(place, 'Remote') THEN 'remote' ELSE 'onsite' END AS mode FROM ({_PLACES_SQL})""".replace(
    "n_name || ', Germany'", "n_name || ' ; Germany'"))
def enr06(t):
    return _places(t).select("c_custkey", classify.place_only(C("place")).alias("place"), classify.location_mode(C("place")).alias("mode"))


# tags on titles: delimited ones count, prose does not
_TAGGED = {"ECONOMY": " (Remote)", "LARGE": " - Fully Remote or Hybrid", "MEDIUM": " Remote Execution", "PROMO": " [on-site, full time]", "SMALL": " | EMEA | Distributed", "STANDARD": " (Hybrid casual)"}


@query("enr07_title_mode", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'remote' WHEN 'LARGE' THEN 'remote' WHEN 'PROMO' THEN 'onsite' WHEN 'SMALL' THEN 'anywhere' ELSE '' END AS mode FROM part""")
def enr07(t):
    return t.read("part").select("p_partkey", classify.title_mode(F.concat("p_name", classify.lookup(C("p_type"), _TAGGED))).alias("mode"))


@query("enr08_mode_precedence", f"""SELECT {KEYS}, CASE WHEN workMode IS NOT NULL THEN workMode WHEN contains(location, 'Remote') THEN 'remote' WHEN contains(title, '(Remote)') THEN 'remote' ELSE '' END AS mode FROM posting""")
def enr08(t):
    return t.posting.select(*KEY, classify.resolved_mode(C("workMode"), C("location"), C("title")).alias("mode"))


CODES = {"nation_1": "N1", "nation_2": "N2", "nation_3": "N3", "nation_12": "N12", "middle east": "ME", "america": "US", "germany": "DE"}


@query("enr09_countries", """WITH p AS (SELECT c_custkey, lower(n_name) AS n, lower(r_name) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT c_custkey, concat_ws('|', CASE n WHEN 'nation_1' THEN 'N1' WHEN 'nation_2' THEN 'N2' WHEN 'nation_3' THEN 'N3' WHEN 'nation_12' THEN 'N12' END,
    CASE r WHEN 'middle east' THEN 'ME' WHEN 'america' THEN 'US' END) AS codes FROM p""")
def enr09(t):
    rows = (t.read("customer").join(t.read("nation"), C("c_nationkey") == C("n_nationkey"))
            .join(t.read("region"), C("n_regionkey") == C("r_regionkey")).select("c_custkey", F.concat("n_name", F.lit(" / "), "r_name").alias("place")))
    return rows.select("c_custkey", F.array_join(classify.countries_named(C("place"), CODES), "|").alias("codes"))


_REGIONS = ["Quito, Ecuador", "ACCRA / GHANA", "Amman (Jordan)", "Atlanta, Georgia", "Cary, NC; San Francisco, CA", "Sites in Papua New Guinea or Sri Lanka", "Paris, France - Leeds, England", "Country: Bosnia & Herzegovina"]


@query("enr09_regions", """SELECT c_custkey, ['EC', 'GH', 'JO', '', '', 'LK|PG', 'FR|GB', 'BA'][c_custkey % 8 + 1] AS codes FROM customer""")
def enr09b(t):
    place = F.get(F.array(*map(F.lit, _REGIONS)), C("c_custkey") % 8)
    return t.read("customer").select("c_custkey", F.array_join(F.array_sort(classify.countries_named(place)), "|").alias("codes"))


ALIASES = {"nation 1": "One", "nation 2": "Two", "middle east": "Gulf", "europe": "Europe"}


@query("enr10_country_of_location", """SELECT c_custkey, CASE r_name WHEN 'MIDDLE EAST' THEN 'Gulf' WHEN 'EUROPE' THEN 'Europe' ELSE CASE n_name WHEN 'NATION_1' THEN 'One' WHEN 'NATION_2' THEN 'Two' END END AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def enr10(t):
    rows = (t.read("customer").join(t.read("nation"), C("c_nationkey") == C("n_nationkey"))
            .join(t.read("region"), C("n_regionkey") == C("r_regionkey")).select("c_custkey", F.concat("n_name", F.lit(", in the "), "r_name").alias("a"), F.concat("n_name", F.lit(","), "r_name").alias("b"), "c_acctbal"))
    place = F.replace(F.when(C("c_acctbal") < 5000, C("a")).otherwise(C("b")), F.lit("_"), F.lit(" "))
    return rows.select("c_custkey", classify.country_of_location(place, ALIASES).alias("country"))


SIGNALS = [("A1", r"\b(nation_1|nation_12)\b"), ("EU", r"\b(europe|eur)\b"), ("XX", r"\bnation_2")]


@query("enr11_country_signals", r"""SELECT c_custkey, CASE WHEN regexp_matches(p, '\b(nation_1|nation_12)\b') THEN 'A1' WHEN regexp_matches(p, '\b(europe|eur)\b') THEN 'EU' WHEN regexp_matches(p, '\bnation_2') THEN 'XX' ELSE '' END AS code,
    c_mktsegment = 'BUILDING' AND regexp_matches(p, '\b(nation_1|nation_12|europe|eur)\b|\bnation_2') AND NOT (NOT regexp_matches(p, '\b(nation_1|nation_12)\b') AND regexp_matches(p, '\b(europe|eur)\b')) AS contradicts
  FROM (SELECT c_custkey, c_mktsegment, lower(n_name || ', ' || r_name) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def enr11(t):
    rows = (t.read("customer").join(t.read("nation"), C("c_nationkey") == C("n_nationkey"))
            .join(t.read("region"), C("n_regionkey") == C("r_regionkey")).select("c_custkey", "c_mktsegment", F.concat("n_name", F.lit(", "), "r_name").alias("p")))
    own = F.when(C("c_mktsegment") == "BUILDING", F.lit("eu")).otherwise(F.lit(""))
    return rows.select("c_custkey", classify.signalled_country(C("p"), SIGNALS).alias("code"), classify.country_contradicts(own, C("p"), SIGNALS).alias("contradicts"))


_LIVE_SQL = r"""SELECT page_id, url, html, CASE WHEN contains(url, '?page') THEN 404 WHEN contains(url, '//m.') THEN 410 ELSE 200 END AS status,
    url || CASE WHEN contains(url, 'utm') THEN '&error=true' ELSE '' END AS final_url,
    CASE WHEN contains(url, '/de/') THEN 'This job has expired. ' ELSE '' END || CASE WHEN contains(url, '/es/') THEN '12 jobs found' WHEN contains(url, '/fr/') THEN left(html, 40) ELSE html END AS body,
    contains(url, '#') AS control FROM pages"""
_CODE_SQL = r"""CASE WHEN status IN (404, 410) THEN 'http_gone' WHEN regexp_matches(final_url, '(?i)[?&]error=true') THEN 'expired_url'
    WHEN contains(body, 'job has expired') THEN 'expired_body' WHEN control THEN 'apply_control_visible' WHEN regexp_matches(body, '\d+ jobs? found') THEN 'listing_page'
    WHEN length(trim(body, E' \t\n\r')) < 300 THEN 'insufficient_content' ELSE 'no_apply_control' END"""


def _live(t):
    u = C("url")
    body = F.concat(F.when(F.contains(u, F.lit("/de/")), F.lit("This job has expired. ")).otherwise(F.lit("")),
                    F.when(F.contains(u, F.lit("/es/")), F.lit("12 jobs found")).when(F.contains(u, F.lit("/fr/")), F.left("html", F.lit(40))).otherwise(C("html")))
    rows = t.pages.select(
        "page_id", F.when(F.contains(u, F.lit("?page")), 404).when(F.contains(u, F.lit("//m.")), 410).otherwise(200).alias("status"),
        F.concat(u, F.when(F.contains(u, F.lit("utm")), F.lit("&error=true")).otherwise(F.lit(""))).alias("final_url"), body.alias("body"),
        F.when(F.contains(u, F.lit("#")), F.array(F.lit("Apply now"))).otherwise(F.array(F.lit("Share"))).alias("controls"))
    return rows.withColumn("live", classify.liveness(C("status"), C("final_url"), C("body"), C("controls")))


@query("enr12_liveness", f"""SELECT page_id, CASE code WHEN 'apply_control_visible' THEN 'active' WHEN 'no_apply_control' THEN 'uncertain' ELSE 'expired' END AS result, code FROM (SELECT page_id, {_CODE_SQL} AS code FROM ({_LIVE_SQL}))""")
def enr12(t):
    return _live(t).select("page_id", "live.result", "live.code")


@query("enr13_liveness_route", f"""SELECT page_id, route, CASE route WHEN 'expired' THEN 'skipped_expired' ELSE 'added' END AS history_status FROM
    (SELECT page_id, CASE code WHEN 'apply_control_visible' THEN 'verified' WHEN 'no_apply_control' THEN 'unverified' ELSE 'expired' END AS route FROM (SELECT page_id, {_CODE_SQL} AS code FROM ({_LIVE_SQL})))""")
def enr13(t):
    route = classify.liveness_route(C("live.result"), C("live.code"))
    return _live(t).select("page_id", route.alias("route"), classify.route_history_status(route, C("live.code")).alias("history_status"))


@query("enr14_closed_notice", """SELECT page_id, len(list_filter(regexp_extract_all(html, 'class="([^"]*)"', 1), lambda x: regexp_matches(x, '\\b(ad|nav)\\b') AND NOT contains(x, 'hidden'))) > 0 AS closed FROM pages""")
def enr14(t):
    return t.pages.select("page_id", classify.closed_notice(C("html"), "(?:ad|nav)", "hidden").alias("closed"))


@query("enr15_fetch_error", """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'timeout' WHEN s IN (429, 503) OR (event_type = 'view' AND value > 50) THEN 'throttled' WHEN s IN (401, 403) THEN 'blocked' WHEN s = 404 THEN 'notfound' WHEN s IS NOT NULL THEN 'http' ELSE 'network' END AS kind
  FROM (SELECT *, CASE event_type WHEN 'error' THEN CASE WHEN value > 100 THEN 429 WHEN value > 50 THEN 503 WHEN value > 20 THEN 403 ELSE 500 END WHEN 'click' THEN 404 WHEN 'purchase' THEN 401 END AS s FROM events)""")
def enr15(t):
    v, e = C("value"), C("event_type")
    status = F.when(e == "error", F.when(v > 100, 429).when(v > 50, 503).when(v > 20, 403).otherwise(500)).when(e == "click", 404).when(e == "purchase", 401)
    message = F.when((e == "view") & (v > 50), F.lit("Rate-limit hit")).otherwise(F.lit("socket hang up"))
    return t.read("events").select("event_id", classify.fetch_error_kind(F.when(e == "signup", F.lit("AbortError")), status, message).alias("kind"))


STATE_SQL = """CASE s WHEN 'evaluada' THEN 'evaluated' WHEN 'hold' THEN 'evaluated' WHEN 'aplicado' THEN 'applied' WHEN 'rechazado' THEN 'rejected' WHEN 'entrevista' THEN 'interview' WHEN 'monitor' THEN 'skip' ELSE s END"""
CLEAN_SQL = "regexp_replace(lower(trim(replace(status, '**', ''))), '\\s+\\d{4}-\\d{2}-\\d{2}.*$', '')"
OUTCOME_SQL = "CASE WHEN state IN ('interview', 'offer', 'responded', 'applied') THEN 'positive' WHEN state IN ('rejected', 'discarded') THEN 'negative' WHEN state = 'skip' THEN 'self_filtered' ELSE 'pending' END"


@query("enr16_report_status", f"SELECT num, {STATE_SQL} AS state FROM (SELECT num, {CLEAN_SQL} AS s FROM application)")
def enr16(t):
    return t.application.select("num", classify.report_status(C("status")).alias("state"))


_LABEL_SQL = """CASE WHEN s LIKE 'duplicado%' THEN 'Discarded' WHEN s IN ('rechazado', 'rejected') THEN 'Rejected' WHEN s LIKE 'aplicado 2024%' OR s = 'applied' THEN 'Applied' WHEN s IN ('hold', 'evaluada', 'evaluated') THEN 'Evaluated'
  WHEN s IN ('monitor', 'skip') THEN 'SKIP' WHEN s = 'discarded' THEN 'Discarded' WHEN s IN ('interview', 'entrevista') THEN 'Interview' WHEN s = 'offer' THEN 'Offer' WHEN s = 'responded' THEN 'Responded' END"""


# 'Rechazado' is no exact alias of the strict reader, which knows 'rechazada' and dated forms
@query("enr17_strict_status", f"""SELECT num, {_LABEL_SQL.replace("'rechazado', ", "")} AS status, CASE WHEN s LIKE 'duplicado%' THEN trim(status) END AS to_notes, s = 'rechazado' AS unknown
  FROM (SELECT num, status, lower(trim(replace(status, '**', ''))) AS s FROM application)""")
def enr17(t):
    return t.application.select("num", classify.strict_status(C("status")).alias("x")).select("num", "x.status", "x.to_notes", "x.unknown")


@query("enr18_merge_status", f"""SELECT num, coalesce({_LABEL_SQL.replace("s LIKE 'aplicado 2024%'", "s = 'aplicado'")}, 'Evaluated') AS status FROM (SELECT num, {CLEAN_SQL} AS s FROM application)""")
def enr18(t):
    return t.application.select("num", classify.merge_status(C("status")).alias("status"))


@query("enr19_board_status", f"WITH {BOARD_SQL} SELECT num, state FROM b")
def enr19(t):
    return board(t).select("num", "state")


@query("enr20_outcome", f"SELECT num, {OUTCOME_SQL} AS outcome FROM (SELECT num, {STATE_SQL} AS state FROM (SELECT num, {CLEAN_SQL} AS s FROM application))")
def enr20(t):
    return t.application.select("num", classify.outcome(classify.report_status(C("status"))).alias("outcome"))


POLICY_SQL = """CASE remote WHEN 'US only remote' THEN 'geo-restricted' WHEN 'Hybrid, two days in the office' THEN 'hybrid/onsite' WHEN 'Remote anywhere' THEN 'global remote' WHEN 'Remote, Africa' THEN 'regional remote' ELSE 'unknown' END"""


@query("enr21_remote_policy", f"SELECT path, {POLICY_SQL} AS policy FROM report")
def enr21(t):
    return t.report.select("path", classify.remote_policy(C("remote")).alias("policy"))


SIZE_SQL = "CASE WHEN teamSize = 'small team' THEN 'startup' WHEN n <= 50 THEN 'startup' WHEN n <= 500 THEN 'scaleup' ELSE 'enterprise' END"


@query("enr22_company_size", f"SELECT path, {SIZE_SQL} AS size FROM (SELECT path, teamSize, TRY_CAST(regexp_extract(teamSize, '[0-9]+') AS BIGINT) AS n FROM report)")
def enr22(t):
    return t.report.select("path", classify.company_size(C("teamSize")).alias("size"))


BLOCKER_SQL = r"""CASE WHEN severity = 'Nice to have' THEN NULL WHEN regexp_matches(lower(gap), '\b(residency|us[- ]only|canada|location|visa|geo|country|region)\b') THEN 'geo-restriction'
  WHEN regexp_matches(lower(gap), '\b(javascript|typescript|python|ruby|java|go|rust|node|react|angular|vue|django|flask|rails)\b') THEN 'stack-mismatch'
  WHEN regexp_matches(lower(gap), '\b(senior|staff|lead|principal|director|manager|head)\b') THEN 'seniority-mismatch' WHEN regexp_matches(lower(gap), '\b(hybrid|on-?site|office|relocat)\b') THEN 'onsite-requirement' ELSE 'other' END"""


@query("enr23_blocker_type", f"SELECT path, {BLOCKER_SQL} AS blocker FROM report")
def enr23(t):
    return t.report.select("path", classify.blocker_type(C("gap"), C("severity")).alias("blocker"))


TODAY = "2001-09-01"
CADENCE_SQL = f"""a AS (SELECT num, company, role, {STATE_SQL} AS state, CAST(date AS DATE) AS applied_on FROM (SELECT *, {CLEAN_SQL} AS s FROM application)),
  f AS (SELECT appNum, count(*) AS n, max(date) AS last FROM follow_up GROUP BY appNum),
  j AS (SELECT a.*, coalesce(n, 0) AS follow_ups, CAST(last AS DATE) AS last, date_diff('day', applied_on, DATE '{TODAY}') AS since_app, date_diff('day', CAST(last AS DATE), DATE '{TODAY}') AS since_last
    FROM a LEFT JOIN f ON num = appNum WHERE state IN ('applied', 'responded', 'interview')),
  u AS (SELECT *, CASE state WHEN 'applied' THEN CASE WHEN follow_ups >= 2 THEN 'cold' WHEN follow_ups = 0 AND since_app >= 7 THEN 'overdue' WHEN follow_ups > 0 AND since_last >= 7 THEN 'overdue' ELSE 'waiting' END
      WHEN 'responded' THEN CASE WHEN since_app < 1 THEN 'urgent' WHEN since_app >= 3 THEN 'overdue' ELSE 'waiting' END ELSE CASE WHEN since_app >= 1 THEN 'overdue' ELSE 'waiting' END END AS urgency,
    CAST(CASE state WHEN 'applied' THEN CASE WHEN follow_ups >= 2 THEN NULL WHEN follow_ups = 0 THEN applied_on + 7 ELSE last + 7 END
      WHEN 'responded' THEN coalesce(last, applied_on) + 3 ELSE applied_on + 1 END AS DATE) AS next_date FROM j)"""


def cadence(t):
    from ..operators.tracker import cadence as run
    return run(t.application, t.follow_up, F.to_date(F.lit(TODAY)))


@query("enr24_urgency", f"WITH {CADENCE_SQL} SELECT num, state, follow_ups, since_app AS days_since_app, since_last AS days_since_last, urgency FROM u")
def enr24(t):
    return cadence(t).select("num", "state", "follow_ups", "days_since_app", "days_since_last", "urgency")


@query("enr25_next_follow_up", f"WITH {CADENCE_SQL} SELECT num, next_date, date_diff('day', DATE '{TODAY}', next_date) AS days_until FROM u")
def enr25(t):
    return cadence(t).select("num", "next_date", "days_until")


@query("flt19_overdue_only", f"WITH {CADENCE_SQL} SELECT num, urgency FROM u WHERE urgency IN ('overdue', 'urgent')")
def flt19(t):
    return cadence(t).filter(C("urgency").isin("overdue", "urgent")).select("num", "urgency")


@query("flt20_actionable", f"WITH {CADENCE_SQL} SELECT num, state, applied_on FROM j")
def flt20(t):
    from ..operators.tracker import actionable
    return actionable(t.application).select("num", "state", "applied_on")


@query("enr26_contacts", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all('Emailed Ann at ' || text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+')) AS email FROM documents)
  SELECT doc_id, email, count(*) AS n FROM m GROUP BY ALL""")
def enr26(t):
    found = t.documents.select("doc_id", F.explode(contacts(F.concat(F.lit("Emailed Ann at "), "text"))).alias("c"))
    return found.groupBy("doc_id", "c.email").agg(F.count("*").alias("n"))


@query("enr26_contact_names", "SELECT num, 'ann.' || regexp_extract(notes, 'ann\\.(\\d+)', 1) || '@mail.example.com' AS email, 'Ann' AS name FROM application")
def enr26b(t):
    return t.application.select("num", F.explode(contacts(C("notes"))).alias("c")).select("num", "c.email", "c.name")


STRONG, WEAK, TERMS = r"\b(widget|hot rod|gear (red|x))\b", r"\b(bolt|small)\b", ["widg", "anvil"]


@query("enr27_title_signal", r"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\b(widget|hot rod)\b') THEN 'strong' WHEN regexp_matches(p_name, '\b(bolt|small)\b') THEN 'weak' ELSE 'none' END AS signal, regexp_matches(p_name, 'widg|anvil') AS in_domain FROM part")
def enr27(t):
    return t.read("part").select("p_partkey", classify.title_signal(C("p_name"), STRONG, WEAK).alias("signal"), classify.title_in_domain(C("p_name"), TERMS).alias("in_domain"))


@query("enr28_placeholder_board", """SELECT p_brand, CAST(p_size AS BIGINT) AS p_size, bool_and(starts_with(p_name, 'small') OR starts_with(p_name, 'new')) AS demo FROM part GROUP BY p_brand, p_size""")
def enr28(t):
    title = F.concat(F.when(F.rlike("p_name", F.lit("^(small|new)")), F.lit(" Demo - ")).otherwise(F.lit("Demonstrator ")), "p_name")
    return t.read("part").groupBy("p_brand", "p_size").agg(F.bool_and(F.rlike(title, F.lit(r"(?i)^\s*DEMO\b"))).alias("demo"))


@query("enr29_slug_tier", """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'high' WHEN p_size > 25 THEN CASE WHEN length(slug) >= 6 AND NOT regexp_matches(slug, '^(hotrod|redring)$') THEN 'medium' ELSE 'verify' END ELSE 'medium' END AS tier,
    NOT (p_type <> 'PROMO' AND p_size > 25 AND (length(slug) < 6 OR regexp_matches(slug, '^(hotrod|redring)$'))) AS trusted FROM (SELECT *, replace(p_name, ' ', '') AS slug FROM part)""")
def enr29(t):
    tier = classify.slug_tier(F.when(C("p_type") == "PROMO", F.lit("high")), C("p_size") > 25, F.replace("p_name", F.lit(" "), F.lit("")), "^(hotrod|redring)$")
    return t.read("part").select("p_partkey", tier.alias("tier"), classify.tier_trusted(tier).alias("trusted"))


@query("enr30_entry_kind", """SELECT seq, CASE WHEN recipe IN ('html', 'blocked') THEN 'custom' WHEN parser IS NOT NULL THEN 'local-parser' WHEN provider IS NOT NULL THEN provider WHEN coalesce(careers_url, api) IS NOT NULL THEN 'auto-detect' END AS provider,
    CASE WHEN recipe IS NOT NULL THEN recipe WHEN parser IS NOT NULL THEN 'parser' WHEN provider IS NOT NULL OR coalesce(careers_url, api) IS NOT NULL THEN 'ats' ELSE coalesce(status, 'unresolved') END AS kind,
    CASE WHEN recipe IS NOT NULL THEN recipe = 'html' ELSE parser IS NOT NULL OR provider IS NOT NULL OR coalesce(careers_url, api) IS NOT NULL END AS scannable FROM company""")
def enr30(t):
    return t.company.select("seq", classify.entry_kind(C("recipe"), C("parser"), C("provider"), C("careers_url"), C("status"), C("api")).alias("k")).select("seq", "k.*")


# links of every kind of host, one per customer
_LINKS_SQL = """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'https://boards.greenhouse.io/co' || c_nationkey || '/jobs/12345' WHEN 'BUILDING' THEN 'https://co' || c_nationkey || '.teamtailor.com/jobs/7'
    WHEN 'FURNITURE' THEN CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE 'https://www.hitmarker.net/jobs/' || c_custkey END WHEN 'HOUSEHOLD' THEN 'https://careers.co' || c_nationkey || '.co.uk/jobs' ELSE 'https://x.icims.com/' || c_nationkey END AS url, c_name AS company FROM customer"""


def links(t):
    n, k = C("c_nationkey").cast("string"), C("c_custkey").cast("string")
    seg = C("c_mktsegment")
    url = (F.when(seg == "AUTOMOBILE", F.concat(F.lit("https://boards.greenhouse.io/co"), n, F.lit("/jobs/12345")))
           .when(seg == "BUILDING", F.concat(F.lit("https://co"), n, F.lit(".teamtailor.com/jobs/7")))
           .when(seg == "FURNITURE", F.when(C("c_acctbal") < 0, F.lit("n/a")).otherwise(F.concat(F.lit("https://www.hitmarker.net/jobs/"), k)))
           .when(seg == "HOUSEHOLD", F.concat(F.lit("https://careers.co"), n, F.lit(".co.uk/jobs")))
           .otherwise(F.concat(F.lit("https://x.icims.com/"), n)))
    return t.read("customer").select("c_custkey", url.alias("url"), C("c_name").alias("company"))


_CLASS_SQL = """SELECT *, CASE WHEN contains(url, 'hitmarker') THEN 'aggregator' WHEN regexp_matches(url, 'greenhouse|teamtailor|icims') THEN 'platform' ELSE 'custom' END AS class,
    CASE WHEN url = 'n/a' THEN '(unparseable)' WHEN contains(url, 'hitmarker') THEN 'hitmarker.net' WHEN contains(url, 'greenhouse') THEN 'greenhouse' WHEN contains(url, 'teamtailor') THEN 'teamtailor' WHEN contains(url, 'icims') THEN 'icims'
      ELSE regexp_extract(url, '(co[0-9]+\\.co\\.uk)', 1) END AS label FROM (""" + _LINKS_SQL + ")"


@query("enr31_host_class", f"SELECT c_custkey, class, label FROM ({_CLASS_SQL})")
def enr31(t):
    return links(t).select("c_custkey", companies.host_class(C("url")).alias("h")).select("c_custkey", "h.*")


@query("enr32_link_identity", f"""SELECT c_custkey, CASE WHEN contains(url, 'greenhouse') THEN 'greenhouse' WHEN contains(url, 'teamtailor') THEN 'teamtailor' END AS provider,
    CASE WHEN contains(url, 'greenhouse') OR contains(url, 'teamtailor') THEN regexp_extract(url, '(co[0-9]+)', 1) END AS slug,
    CASE WHEN contains(url, 'greenhouse') THEN regexp_extract(url, '^(.*)/jobs/', 1) WHEN contains(url, 'teamtailor') THEN regexp_extract(url, '^(https://[^/]+)', 1) END AS careers_url FROM ({_LINKS_SQL})""")
def enr32(t):
    return links(t).select("c_custkey", companies.link_identity(C("url")).alias("i")).select("c_custkey", "i.*")


@query("enr33_credit_role", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'developer' WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN NULL ELSE 'publisher' END AS role FROM orders""")
def enr33(t):
    pub = C("o_orderpriority") != "5-LOW"
    other = (C("o_orderstatus") == "O") & (C("o_orderpriority") == "1-URGENT")
    credits = F.array(F.struct(C("o_custkey").alias("company"), (C("o_orderstatus") == "F").alias("developer"), pub.alias("publisher")),
                      F.struct((C("o_custkey") + 1).alias("company"), F.lit(True).alias("developer"), other.alias("publisher")))
    return t.read("orders").select("o_orderkey", classify.credit_role(credits, C("o_custkey")).alias("role"))


@query("enr34_age_band", "SELECT o_orderkey, CASE WHEN d < 30 THEN 'fresh' WHEN d <= 60 THEN 'aging' ELSE 'stale' END AS band FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-10') AS d FROM orders)")
def enr34(t):
    return t.read("orders").select("o_orderkey", classify.age_band(C("o_orderdate"), F.to_date(F.lit("2001-08-10"))).alias("band"))


@query("enr35_score_fallback", f"""SELECT num, CASE WHEN starts_with(status, '**') THEN coalesce(r.score, 0) ELSE CAST(replace(a.score, '/5', '') AS DOUBLE) END::DOUBLE AS points, {POLICY_SQL.replace("ELSE 'unknown'", "WHEN 'zz' THEN '' ELSE 'unknown'")} AS policy
  FROM application a LEFT JOIN report r ON r.path = regexp_extract(a.report, '\\]\\(([^)]+)\\)', 1)""")
def enr35(t):
    apps = t.application.withColumn("score", F.when(F.startswith("status", F.lit("**")), F.lit("N/A")).otherwise(C("score")))
    return reports.enrich(apps, t.report).select("num", "points", C("remote_policy").alias("policy"))


_VET_SQL = r"""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'medium' ELSE 'high' END AS confidence, p_brand, p_name, p_type FROM part WHERE p_brand <> 'Brand#3'"""


@query("enr36_hit_vetting", f"""SELECT 'P' || p_partkey AS name, lower(p_brand) || '.example.com/' || p_partkey AS "where",
    CASE WHEN confidence = 'medium' AND (p_type = 'SMALL' OR NOT contains(p_name, 'widget')) THEN 'verify' ELSE confidence END AS confidence,
    CASE WHEN confidence = 'medium' AND p_type = 'SMALL' THEN 'loc ''Berlin'' ≠ US' WHEN confidence = 'medium' AND NOT contains(p_name, 'widget') THEN 'no domain signal in 1 title(s)' END AS flag FROM ({_VET_SQL})""")
def enr36(t):
    hits = t.read("part").select(
        F.concat(F.lit("P"), "p_partkey").alias("name"), F.concat(F.lower("p_brand"), F.lit(".example.com/"), "p_partkey").alias("where"),
        F.when(C("p_size") > 25, "medium").otherwise("high").alias("confidence"), F.lit("US").alias("country"),
        F.when(C("p_type") == "SMALL", "Berlin").otherwise("Remote").alias("loc"), F.array("p_name").alias("titles"))
    tracked = t.read("part").filter("p_brand = 'Brand#3'").select(F.concat(F.lower("p_brand"), F.lit(".example.com")).alias("host")).distinct()
    return companies.vet_hits(hits, tracked, content=r"\b(widget)\b")


_LABELS = {"AUTOMOBILE": "Hybrid (NATION, Sud)", "BUILDING": "remote", "FURNITURE": "On-site (Town)", "HOUSEHOLD": "Town (North)", "MACHINERY": "In-person (Hall)"}


@query("enr37_labelled_place", """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'NATION, Sud' WHEN 'BUILDING' THEN '' WHEN 'FURNITURE' THEN 'Town' WHEN 'HOUSEHOLD' THEN 'Town (North)' ELSE 'Hall' END AS place,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'hybrid' WHEN 'BUILDING' THEN 'remote' WHEN 'FURNITURE' THEN 'onsite' ELSE '' END AS mode FROM customer""")
def enr37(t):
    place, mode = classify.labelled_place(classify.lookup(C("c_mktsegment"), _LABELS))
    return t.read("customer").select("c_custkey", place.alias("place"), mode.alias("mode"))
