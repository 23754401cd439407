"""Aggregate and sort queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, companies, health, reports, snapshot, targeting, tracker
from .enrichment import BLOCKER_SQL, CADENCE_SQL, CLEAN_SQL, OUTCOME_SQL, POLICY_SQL, SIZE_SQL, STATE_SQL, _CLASS_SQL, cadence, links
from .filters import BATCH_SQL, BOARD_SQL, GROUP_SQL, GROUPS, batch_state, board
from .joins import HISTORY_SQL, LEDGER_SQL, MINE_KEY, STREAK_SQL, ledger, PROVIDERS
from .registry import query

C = F.col
REPORT_SQL = f"""en AS (SELECT a.num, a.date, a.company, a.notes, {STATE_SQL} AS state, r.archetype, coalesce(r.score, 0) AS rs, r.gap, r.severity, {POLICY_SQL} AS remote_policy,
    CASE WHEN r.path IS NULL THEN 'unknown' ELSE {SIZE_SQL} END AS company_size, CAST(replace(a.score, '/5', '') AS DOUBLE) AS points FROM (SELECT *, {CLEAN_SQL} AS s FROM application) a
    LEFT JOIN (SELECT *, TRY_CAST(regexp_extract(teamSize, '[0-9]+') AS BIGINT) AS n FROM report) r ON r.path = regexp_extract(a.report, '\\]\\(([^)]+)\\)', 1)),
  ro AS (SELECT *, {OUTCOME_SQL} AS outcome FROM en)"""
_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in classify.OUTCOMES)


def enriched(t):
    return reports.enrich(t.application, t.report)


@query("agg01_funnel", f"WITH {REPORT_SQL} SELECT state, count(*) AS n FROM ro GROUP BY state")
def agg01(t):
    return reports.funnel(enriched(t))


_FUNNEL_SQL = f"""WITH {BOARD_SQL}, n AS (SELECT count(*) AS t, count(*) FILTER (state IN ('applied', 'responded', 'interview', 'offer', 'rejected')) AS a, count(*) FILTER (state IN ('responded', 'interview', 'offer')) AS r,
    count(*) FILTER (state IN ('interview', 'offer')) AS i, count(*) FILTER (state = 'offer') AS o FROM b)"""


@query("agg02_progress_funnel", f"""{_FUNNEL_SQL} SELECT stage, cnt AS n, round(CAST(pct AS DOUBLE), 6) AS pct FROM n, LATERAL (VALUES ('Evaluated', t, 100.0::DOUBLE), ('Applied', a, 100.0 * a / t), ('Responded', r, 100.0 * r / a), ('Interview', i, 100.0 * i / a), ('Offer', o, 100.0 * o / a)) v(stage, cnt, pct)""")
def agg02(t):
    return reports.progress_funnel(board(t)).select("stage", "n", F.round("pct", 6).alias("pct"))


@query("agg02_progress_rates", f"{_FUNNEL_SQL} SELECT round(100.0 * r / a, 6)::DOUBLE AS response_rate, round(100.0 * i / a, 6)::DOUBLE AS interview_rate, round(100.0 * o / a, 6)::DOUBLE AS offer_rate FROM n")
def agg02b(t):
    return reports.progress_rates(board(t)).select(*[F.round(x, 6).alias(x) for x in ("response_rate", "interview_rate", "offer_rate")])


@query("agg03_score_by_outcome", f"""WITH {REPORT_SQL} SELECT o.outcome, coalesce(round(avg(points), 2), 0)::DOUBLE AS avg_score, coalesce(min(points), 0) AS min_score, coalesce(max(points), 0) AS max_score, count(points) AS n
  FROM (SELECT unnest(['positive', 'negative', 'self_filtered', 'pending']) AS outcome) o LEFT JOIN (SELECT * FROM ro WHERE points > 0) USING (outcome) GROUP BY o.outcome""")
def agg03(t):
    return reports.score_by_outcome(enriched(t))


for _by, _name in (("archetype", "agg04_archetypes"), ("remote_policy", "agg04_remote_policies"), ("company_size", "agg04_company_sizes")):
    query(_name, f"WITH {REPORT_SQL} SELECT coalesce({_by}, 'Unknown') AS {_by}, count(*) AS total, {_COUNTS}, CAST(round(100.0 * count(*) FILTER (outcome = 'positive') / count(*)) AS BIGINT) AS conversion FROM ro GROUP BY 1")(
        lambda t, by=_by: reports.breakdown(enriched(t), by))


@query("agg05_blockers", f"WITH {REPORT_SQL} SELECT blocker, count(*) AS frequency, CAST(round(100.0 * count(*) / (SELECT count(*) FROM ro)) AS BIGINT) AS percentage FROM (SELECT {BLOCKER_SQL} AS blocker FROM ro WHERE gap IS NOT NULL) WHERE blocker IS NOT NULL GROUP BY blocker")
def agg05(t):
    return reports.blockers(enriched(t))


@query("agg06_score_threshold", f"WITH {REPORT_SQL} SELECT min(points) FILTER (outcome = 'positive' AND points > 0) AS lowest, coalesce(floor(min(points) FILTER (outcome = 'positive' AND points > 0) * 10) / 10, 3.5)::DOUBLE AS recommended FROM ro")
def agg06(t):
    return reports.score_threshold(enriched(t))


@query("agg07_technology_gaps", f"""WITH {REPORT_SQL} SELECT skill, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(gap, '\\b(Python|React|Rust|Go|Docker|Kubernetes|AWS)\\b')) AS skill FROM ro WHERE outcome IN ('negative', 'self_filtered')) GROUP BY skill ORDER BY frequency DESC, skill LIMIT 15""")
def agg07(t):
    return reports.technology_gaps(enriched(t))


@query("agg08_recommendations", f"""WITH {REPORT_SQL}, k AS (SELECT {BLOCKER_SQL} AS blocker, count(*) AS n, CAST(round(100.0 * count(*) / (SELECT count(*) FROM ro)) AS BIGINT) AS pct FROM ro WHERE gap IS NOT NULL GROUP BY 1),
  a AS (SELECT coalesce(archetype, 'Unknown') AS archetype, count(*) AS total, CAST(round(100.0 * count(*) FILTER (outcome = 'positive') / count(*)) AS BIGINT) AS conv FROM ro GROUP BY 1),
  p AS (SELECT remote_policy, count(*) AS total, CAST(round(100.0 * count(*) FILTER (outcome = 'positive') / count(*)) AS BIGINT) AS conv FROM ro GROUP BY 1),
  m AS (SELECT min(points) FILTER (outcome = 'positive' AND points > 0) AS lowest FROM ro)
  SELECT 'tighten-location' AS rule, blocker AS subject, CAST(pct AS DOUBLE) AS value, 'high' AS impact FROM k WHERE blocker = 'geo-restriction' AND pct >= 10
  UNION ALL SELECT 'filter-stack', blocker, pct, 'high' FROM k WHERE blocker = 'stack-mismatch' AND pct >= 15
  UNION ALL SELECT 'score-floor', 'score', floor(lowest * 10) / 10, 'medium' FROM m WHERE lowest > 3.0
  UNION ALL SELECT * FROM (SELECT 'double-down', archetype, conv, 'medium' FROM a WHERE total >= 2 AND conv > 0 ORDER BY conv DESC, total DESC, archetype LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'avoid-policy', remote_policy, total, 'medium' FROM p WHERE total >= 2 AND conv = 0 ORDER BY total DESC, remote_policy LIMIT 1)""".replace("pct >= 10", "pct >= 20"))
def agg08(t):
    return reports.recommendations(enriched(t))


@query("agg09_evidence_gate", f"WITH {REPORT_SQL} SELECT state, count(*) AS n FROM ro WHERE (SELECT count(*) FROM ro WHERE state <> 'evaluated') >= 5 GROUP BY state")
def agg09(t):
    rows = enriched(t)
    return reports.with_evidence(reports.funnel(rows), rows, 5)


@query("agg10_metadata", f"WITH {REPORT_SQL} SELECT count(*) AS total, min(date) AS first_date, max(date) AS last_date, {_COUNTS} FROM ro")
def agg10(t):
    return reports.metadata(enriched(t))


@query("agg11_board_metrics", f"WITH {BOARD_SQL} SELECT count(*) AS total, round(avg(points) FILTER (points > 0), 6) AS avg_score, max(points) AS top_score, count(*) FILTER (contains(pdf, '✅')) AS with_pdf, count(*) FILTER (state NOT IN ('skip', 'rejected', 'discarded')) AS actionable, count(*) FILTER (state = 'offer') AS offers FROM b")
def agg11(t):
    return reports.board_metrics(board(t)).withColumn("avg_score", F.round("avg_score", 6))


@query("agg11_status_map", f"WITH {BOARD_SQL} SELECT string_agg(state || '=' || n, ',' ORDER BY state) AS by_status FROM (SELECT state, count(*) AS n FROM b GROUP BY state)")
def agg11b(t):
    return reports.status_counts(board(t)).select(F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_status"))


@query("agg12_progress_metrics", f"WITH {BOARD_SQL} SELECT count(*) FILTER (state = 'offer') AS offers, count(*) FILTER (state NOT IN ('skip', 'rejected', 'discarded')) AS active, round(avg(points) FILTER (points > 0), 6) AS avg_score, max(points) AS top_score FROM b")
def agg12(t):
    return reports.board_metrics(board(t)).select("offers", C("actionable").alias("active"), F.round("avg_score", 6).alias("avg_score"), "top_score")


@query("agg13_score_buckets", f"""WITH {BOARD_SQL} SELECT x.bucket, count(points) AS n FROM (SELECT unnest(['4.5-5.0', '4.0-4.4', '3.5-3.9', '3.0-3.4', '<3.0']) AS bucket) x LEFT JOIN
  (SELECT points, CASE WHEN points >= 4.5 THEN '4.5-5.0' WHEN points >= 4 THEN '4.0-4.4' WHEN points >= 3.5 THEN '3.5-3.9' WHEN points >= 3 THEN '3.0-3.4' ELSE '<3.0' END AS bucket FROM b WHERE points > 0) USING (bucket) GROUP BY x.bucket""")
def agg13(t):
    return reports.score_buckets(board(t))


_WEEK_SQL = "SELECT strftime(CAST(date AS DATE), '%G-W%V') AS week, count(*) AS n FROM application GROUP BY 1 ORDER BY week DESC LIMIT 8"


@query("agg14_weekly_activity", _WEEK_SQL)
def agg14(t):
    return reports.weekly_activity(board(t))


@query("win09_last_weeks", f"SELECT week, n FROM ({_WEEK_SQL})")
def win09(t):
    return reports.weekly_activity(board(t), 8)


_COUNTER_SQL = f"""WITH {GROUP_SQL}, {HISTORY_SQL} SELECT CASE WHEN filtered THEN 'hidden' WHEN old THEN 'filtered_title' WHEN m_asia THEN 'filtered_location' WHEN m_blocked THEN 'filtered_company'
    WHEN url IN (SELECT url FROM hist WHERE status <> 'skipped_expired') THEN 'duplicate' ELSE 'new' END AS reason, count(*) AS n FROM s GROUP BY 1"""


@query("agg15_scan_counters", _COUNTER_SQL)
def agg15(t):
    from ..plans.board import history
    scored = targeting.score_groups(t.posting.withColumn("skills", F.lit(None).cast("array<string>")), GROUPS)
    seen = snapshot.seen_urls(history(t)).withColumn("seen", F.lit(True))
    rows = scored.join(seen, "url", "left").withColumn("reason", health.scan_reason(C("drop_reason"), C("filtered"), F.coalesce("seen", F.lit(False))))
    return health.scan_counters(rows)


@query("agg16_source_health", "SELECT company AS source, count(*) AS attempted, count(*) FILTER (ok) AS ok, count(*) FILTER (kind = 'throttled') AS throttled, count(*) FILTER (kind = 'blocked') AS blocked, count(*) FILTER (kind = 'http') AS other FROM outcome GROUP BY company")
def agg16(t):
    return health.source_health(t.outcome.withColumn("source", C("company")))


STRONG, WEAK = r"\b(widget|hot rod)\b", r"\b(bolt|small)\b"


def mined(t):
    """Boards: one per brand; the employer spelling varies with the part type."""
    rows = t.read("lineitem").join(t.read("part"), C("l_partkey") == C("p_partkey")).select(
        F.lit("greenhouse").alias("provider"), C("p_brand").alias("slug"),
        F.when(C("p_size") > 40, F.concat("p_brand", F.lit(" Studio"))).when(C("p_size") > 30, F.concat("p_brand", F.lit("Games"))).when(C("p_size") < 3, F.concat("p_brand", F.lit(" "), F.lower("p_type"))).otherwise(C("p_brand")).alias("company"),
        C("p_name").alias("title"), F.when(C("p_type") != "PROMO", F.lit("Gaming Company")).otherwise(F.lit("Other")).alias("category"))
    return companies.mine_boards(rows, strong=STRONG, weak=WEAK)


MINED_SQL = f"""mr AS (SELECT lower(p_brand) AS slug, CASE WHEN p_size > 40 THEN p_brand || ' Studio' WHEN p_size > 30 THEN p_brand || 'Games' WHEN p_size < 3 THEN p_brand || ' ' || lower(p_type) ELSE p_brand END AS company, p_type,
    CASE WHEN regexp_matches(p_name, '\\b(widget|hot rod)\\b') THEN 'strong' WHEN regexp_matches(p_name, '\\b(bolt|small)\\b') THEN 'weak' END AS sig FROM lineitem JOIN part ON l_partkey = p_partkey),
  mb AS (SELECT 'greenhouse' AS provider, slug, count(*) AS jobs, count(*) FILTER (sig = 'strong') AS strong, count(*) FILTER (sig = 'weak') AS weak, count(*) FILTER (p_type <> 'PROMO') AS tagged, count(DISTINCT company) AS spellings,
    count(DISTINCT {MINE_KEY.format('company')}) AS identities, min_by(company, {{'a': NOT contains(company, ' '), 'b': -length(company), 'c': company}}) AS name, count(sig) AS hits FROM mr GROUP BY slug)"""


@query("agg17_mined_boards", f"WITH {MINED_SQL} SELECT provider, slug, jobs, strong, weak, tagged, hits FROM mb")
def agg17(t):
    return mined(t).select("provider", "slug", "jobs", "strong", "weak", "tagged", "hits")


@query("agg18_candidates", f"WITH {MINED_SQL} SELECT slug, hits >= 1 AND (strong >= 1 OR 1.0 * hits / jobs >= 0.34 OR (jobs <= 30 AND 1.0 * tagged / jobs >= 0.5)) AS candidate, strong >= 1 OR 1.0 * hits / jobs >= 0.5 AS confident FROM mb")
def agg18(t):
    return mined(t).select("slug", companies.is_candidate().alias("candidate"), companies.is_confident().alias("confident"))


@query("agg19_identities", f"WITH {MINED_SQL} SELECT slug, spellings, identities, name FROM mb")
def agg19(t):
    return mined(t).select("slug", "spellings", "identities", "name")


@query("agg20_unknown_hosts", f"SELECT class, label, count(DISTINCT company) AS companies, count(*) AS jobs FROM ({_CLASS_SQL}) WHERE NOT regexp_matches(url, 'greenhouse|teamtailor') GROUP BY class, label")
def agg20(t):
    return companies.unknown_hosts(links(t))


@query("agg20_shared_domains", f"SELECT label, count(DISTINCT company) AS companies FROM ({_CLASS_SQL}) WHERE class = 'custom' AND label <> '(unparseable)' GROUP BY label HAVING count(DISTINCT company) >= 2")
def agg20b(t):
    return companies.shared_domains(companies.unknown_hosts(links(t))).select("label", "companies")


@query("agg21_add_decision", f"""WITH {MINED_SQL}, lv AS (SELECT lower(p_brand) AS slug, CAST(floor(avg(p_size)) AS BIGINT) - 25 AS live_jobs FROM part GROUP BY 1),
  j AS (SELECT mb.*, coalesce(live_jobs, 0) AS lj, {MINE_KEY.format('name')} AS nk FROM mb LEFT JOIN lv USING (slug)),
  r AS (SELECT *, CASE WHEN lj <= 0 THEN 'feed not live' WHEN lower(trim(name)) IN ('brand#7 studio', 'brand#12') THEN 'blocklisted' WHEN 1.0 * tagged / jobs < 0.5 THEN 'not tagged' WHEN NOT (strong >= 1 OR 1.0 * hits / jobs >= 0.5) THEN 'low confidence' WHEN identities > 3 THEN 'ambiguous board' END AS reason FROM j)
  SELECT slug, name, reason FROM r""".replace("identities > 3", "identities > 1"))
def agg21(t):
    live = t.read("part").groupBy(F.lower("p_brand").alias("slug")).agg((F.floor(F.avg("p_size")) - 25).alias("live_jobs")).withColumn("provider", F.lit("greenhouse"))
    return companies.add_decision(mined(t), live, ["greenhouse"], ["Brand#7 Studio", "Brand#12"]).select("slug", "name", "reason")


@query("agg22_company_hints", """WITH p AS (SELECT lower(company) AS company_key, *, CASE WHEN contains(location, 'MIDDLE EAST') THEN 'Gulf' WHEN contains(location, 'EUROPE') THEN 'Europe' WHEN contains(location, 'NATION_1,') THEN 'One' END AS country FROM posting),
  n AS (SELECT company_key, country, count(*) AS n, min(seq) AS f FROM p WHERE country IS NOT NULL GROUP BY 1, 2)
  SELECT p.company_key, arg_min(url, seq) FILTER (contains(url, 'careers')) AS page, (SELECT country FROM n WHERE n.company_key = p.company_key ORDER BY n.n DESC, f LIMIT 1) AS country FROM p GROUP BY p.company_key""")
def agg22(t):
    rows = t.posting.withColumn("companyUrl", F.when(F.contains("url", F.lit("careers")), C("url")))
    rows = rows.withColumn("location", F.replace("location", F.lit("_"), F.lit(" ")))
    hints = companies.company_hints(rows, {"middle east": "Gulf", "europe": "Europe", "nation 1": "One"})
    return hints.select("company_key", C("companyUrl").alias("page"), "country")


def audit(t):
    attempts = t.read("supplier").select(C("s_name").alias("company"), (C("s_acctbal") > 0).alias("ok"), F.when(C("s_acctbal") < -500, F.lit("throttled")).when(C("s_acctbal") <= 0, F.lit("notfound")).alias("kind"))
    rows = (t.read("lineitem").join(t.read("part"), C("l_partkey") == C("p_partkey"))
            .join(t.read("supplier"), C("l_suppkey") == C("s_suppkey")))
    titled = rows.select(C("s_name").alias("company"), F.when(C("s_nationkey") == 7, F.concat(F.lit("DEMO - "), "p_name")).otherwise(C("p_name")).alias("title"))
    return health.feed_audit(attempts, titled, ["widget"], 2)


AUDIT_SQL = """tt AS (SELECT s_name AS company, count(*) AS jobs, count(*) FILTER (contains(p_name, 'widget')) AS hits, bool_and(s_nationkey = 7) AS demo FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name),
  au AS (SELECT s_name AS company, CASE WHEN s_acctbal < -500 THEN 'throttled' WHEN s_acctbal <= 0 THEN 'dead' WHEN jobs IS NULL THEN 'empty' WHEN demo THEN 'suspect' WHEN hits = 0 THEN CASE WHEN jobs >= 2 THEN 'suspect' ELSE 'lean' END ELSE 'ok' END AS status,
    CASE WHEN s_acctbal > 0 THEN coalesce(jobs, 0) ELSE 0 END AS jobs, CASE WHEN s_acctbal > 0 AND NOT coalesce(demo, FALSE) THEN coalesce(hits, 0) ELSE 0 END AS hits FROM supplier LEFT JOIN tt ON tt.company = s_name)"""


@query("agg23_feed_audit", f"WITH {AUDIT_SQL} SELECT * FROM au")
def agg23(t):
    return audit(t)


@query("agg23_feed_samples", "SELECT company, string_agg(title, '|' ORDER BY seq) AS samples FROM (SELECT company, title, seq, row_number() OVER (PARTITION BY company ORDER BY seq) AS rn FROM posting) WHERE rn <= 5 GROUP BY company")
def agg23b(t):
    return health.samples(t.posting.select("company", "title", "seq"), ["company"], "title", "seq", 5).select("company", F.array_join("samples", "|").alias("samples"))


@query("agg24_audit_summary", f"WITH {AUDIT_SQL} SELECT status, count(*) AS n FROM au GROUP BY status")
def agg24(t):
    return health.audit_summary(audit(t))


@query("agg24_flagged", f"WITH {AUDIT_SQL} SELECT company, status FROM au WHERE status IN ('suspect', 'dead')")
def agg24b(t):
    return health.audit_flagged(audit(t)).select("company", "status")


@query("agg25_ledger_coverage", f"""WITH {LEDGER_SQL} SELECT provider, count(*) FILTER (hit = provider) AS hit, count(*) FILTER (hit <> provider AND CASE provider WHEN 'ashby' THEN m_ashby WHEN 'lever' THEN m_lever WHEN 'breezy' THEN m_breezy ELSE FALSE END) AS cleared, count(*) AS total, '2024-01-01' AS last_probe
  FROM lg, (SELECT unnest(['ashby', 'breezy', 'greenhouse', 'lever']) AS provider) GROUP BY provider""")
def agg25(t):
    return companies.ledger_coverage(ledger(t), PROVIDERS)


def shards(t):
    """Ledger rows of three parallel runs, one per order status, merged by customer."""
    p = C("o_orderpriority")
    hit = F.when(p == "1-URGENT", F.lit("lever")).otherwise(F.lit(""))
    return t._orders().select(
        C("c_custkey").alias("key"), C("c_name").alias("name"), F.length("o_orderpriority").alias("version"), hit.alias("hit"), F.when(p == "1-URGENT", F.lit("medium")).otherwise(F.lit("")).alias("hit_conf"),
        F.array(p).alias("missed"), F.when(p == "5-LOW", F.array("o_orderstatus")).otherwise(F.array().cast("array<string>")).alias("rejected"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last"), C("o_orderkey").alias("shard"))


@query("agg26_shard_merge", """WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT c_custkey AS key, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS missed, coalesce(string_agg(DISTINCT CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus END, ',' ORDER BY CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus END), '') AS rejected,
    max(length(o_orderpriority)) AS version, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'lever' ELSE '' END AS hit, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM o GROUP BY 1) SELECT * FROM m""")
def agg26(t):
    return companies.merge_shards(shards(t)).select("key", F.array_join("missed", ",").alias("missed"), F.array_join("rejected", ",").alias("rejected"), "version", "hit", "last")


@query("agg27_batch_summary", f"WITH {BATCH_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('completed', 'failed')) AS pending, count(*) FILTER (status = 'completed') AS scored, (floor(10 * avg(CAST(score AS DOUBLE)) FILTER (status = 'completed')) / 10)::DOUBLE AS avg_score FROM st")
def agg27(t):
    return health.batch_summary(batch_state(t))


@query("agg28_cadence_counts", f"WITH {CADENCE_SQL} SELECT count(*) AS actionable, count(*) FILTER (urgency = 'urgent') AS urgent, count(*) FILTER (urgency = 'overdue') AS overdue, count(*) FILTER (urgency = 'waiting') AS waiting, count(*) FILTER (urgency = 'cold') AS cold, (SELECT count(*) FROM application) AS tracked FROM u")
def agg28(t):
    return reports.cadence_counts(cadence(t), t.application)


def integrity(t):
    files = t.read("orders").filter("o_orderstatus <> 'F'").select(F.concat(F.lit("reports/"), C("o_orderkey").cast("string"), F.lit(".md")).alias("path"))
    lines = t._orders().select(F.when(C("c_acctbal") < 0, F.concat(F.lit("| "), "c_name", F.lit(" | x |"))).otherwise(F.concat(F.lit("| 1 | 2 | 3 | 4 | 5 | 6 | 7 | 8 | "), "c_name", F.lit(" |"))).alias("line"))
    pending = t.addition.select(F.concat(C("file_seq").cast("string"), F.lit(".tsv")).alias("name"))
    return reports.integrity(t.application, files, lines, pending)


@query("agg29_integrity", f"""WITH rp AS (SELECT count(*) AS n FROM (SELECT 1 FROM application GROUP BY regexp_replace(lower(company), '[^a-z0-9]', '', 'g'), regexp_replace(lower(role), '[^a-z0-9 ]', '', 'g') HAVING count(*) > 1))
  SELECT 'status_unknown' AS check_name, 'error' AS level, count(*) AS n FROM (SELECT {CLEAN_SQL} AS s FROM application) WHERE s LIKE 'duplicado%' UNION ALL SELECT 'status_bold', 'error', count(*) FROM application WHERE contains(status, '**')
  UNION ALL SELECT 'status_date', 'error', count(*) FROM application WHERE contains(status, '2024-') UNION ALL SELECT 'repeat', 'warning', n FROM rp
  UNION ALL SELECT 'broken_link', 'error', count(*) FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW' UNION ALL SELECT 'row_format', 'error', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0
  UNION ALL SELECT 'pending', 'warning', count(*) FROM addition""")
def agg29(t):
    return reports.integrity_summary(integrity(t))


@query("agg30_resolve_costs", "SELECT event_type AS outcome, count(*) AS n, round(sum(value), 4) AS cost, round(avg(value), 4) AS avg_cost FROM events GROUP BY event_type")
def agg30(t):
    rows = t.read("events").select(C("event_type").alias("outcome"), C("value").alias("cost"))
    return health.resolve_costs(rows).select("outcome", "n", F.round("cost", 4).alias("cost"), F.round("avg_cost", 4).alias("avg_cost"))


_RUN_SQL = """SELECT CAST(ts AS DATE) AS run, count(*) FILTER (event_type = 'purchase') AS hits, count(*) FILTER (event_type = 'signup') AS review, count(*) FILTER (event_type = 'error') AS uncertain, count(*) FILTER (event_type IN ('view', 'click')) AS clean_misses,
    date_diff('millisecond', min(date_trunc('millisecond', ts)), max(date_trunc('millisecond', ts))) AS duration_ms FROM events GROUP BY 1 ORDER BY run DESC LIMIT 50"""


@query("agg31_run_history", _RUN_SQL)
def agg31(t):
    name = classify.lookup(C("event_type"), {"purchase": "trusted", "signup": "review", "error": "uncertain"}, F.lit("miss"))
    rows = health.run_row(t.read("events").select(C("ts").cast("date").alias("run"), name.alias("outcome"), C("ts").cast("timestamp").alias("ts")))
    return health.append_run(rows.filter("run < DATE '2024-01-10'"), rows.filter("run >= DATE '2024-01-10'"), 50)


@query("agg32_tracker_statistics", "SELECT count(*) AS total, round(avg(p) FILTER (p > 0), 6) AS avg_score, round(100.0 * count(*) FILTER (pdf = '✅') / count(*), 6)::DOUBLE AS pct_pdf, 100.0::DOUBLE AS pct_report FROM (SELECT *, CAST(replace(score, '/5', '') AS DOUBLE) AS p FROM application)")
def agg32(t):
    return reports.statistics(t.application).select("total", F.round("avg_score", 6).alias("avg_score"), F.round("pct_pdf", 6).alias("pct_pdf"), "pct_report")


@query("agg33_discovery", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 30 THEN 'trusted' ELSE 'review' END WHEN event_type = 'signup' THEN 'skipped' WHEN event_type = 'error' THEN 'uncertain' ELSE 'miss' END AS outcome FROM events) GROUP BY outcome ORDER BY n DESC""")
def agg33(t):
    e = C("event_type")
    out = health.discovery_outcome(e == "purchase", F.when(C("value") > 30, "medium").otherwise("verify"), e == "signup", e == "error")
    return t.read("events").groupBy(out.alias("outcome")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


# --- sorts --------------------------------------------------------------------------------------

_KEYS = {"score": "points DESC", "date": "date DESC", "company": "lower(company)", "status": "pr"}
_PRIORITY = "CASE state WHEN 'interview' THEN 0 WHEN 'offer' THEN 1 WHEN 'responded' THEN 2 WHEN 'applied' THEN 3 WHEN 'evaluated' THEN 4 WHEN 'skip' THEN 5 WHEN 'rejected' THEN 6 WHEN 'discarded' THEN 7 ELSE 8 END"


for _mode, _key in _KEYS.items():
    query(f"srt01_by_{_mode}", f"WITH {BOARD_SQL}, p AS (SELECT *, {_PRIORITY} AS pr FROM b) SELECT num, state, points FROM p ORDER BY {_key}, pos")(
        lambda t, m=_mode: board(t).orderBy(*reports.sort_keys(m)).select("num", "state", "points"))


@query("srt02_grouped", f"WITH {BOARD_SQL}, p AS (SELECT *, {_PRIORITY} AS pr FROM b) SELECT num, state FROM p ORDER BY pr, date DESC, pos")
def srt02(t):
    return board(t).orderBy(*reports.sort_keys("date", grouped=True)).select("num", "state")


@query("srt03_status_priority", f"WITH {BOARD_SQL} SELECT num, CAST({_PRIORITY} AS BIGINT) AS priority FROM b")
def srt03(t):
    return board(t).select("num", classify.board_priority(C("state")).alias("priority"))


@query("srt04_urgency_order", f"WITH {CADENCE_SQL} SELECT num, urgency FROM u ORDER BY CASE urgency WHEN 'urgent' THEN 0 WHEN 'overdue' THEN 1 WHEN 'waiting' THEN 2 ELSE 3 END, num")
def srt04(t):
    return cadence(t).orderBy(classify.urgency_order(C("urgency")), "num").select("num", "urgency")


@query("srt05_longest_streaks", f"WITH {STREAK_SQL} SELECT company, since, fails FROM sk ORDER BY fails DESC, company, since LIMIT 10")
def srt05(t):
    return health.longest_streaks(health.failure_streaks(t.outcome), 10).select("company", "since", "fails")


@query("srt06_candidate_order", f"WITH {MINED_SQL} SELECT slug, round(1.0 * hits / jobs, 6)::DOUBLE AS share, jobs FROM mb ORDER BY 1.0 * hits / jobs DESC, jobs DESC, slug")
def srt06(t):
    share = C("hits") / C("jobs")
    return mined(t).orderBy(share.desc(), F.desc("jobs"), "slug").select("slug", F.round(share, 6).alias("share"), "jobs")


@query("srt07_file_order", "SELECT name FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'x.tsv' || o_orderstatus ELSE 'row-' || o_orderkey || '.tsv' END AS name FROM orders) GROUP BY name ORDER BY coalesce(TRY_CAST(regexp_replace(name, '[^0-9]', '', 'g') AS BIGINT), 0), name")
def srt07(t):
    name = F.when(C("o_orderpriority") == "1-URGENT", F.concat(F.lit("x.tsv"), "o_orderstatus")).otherwise(F.concat(F.lit("row-"), C("o_orderkey").cast("string"), F.lit(".tsv")))
    return t.read("orders").select(name.alias("name")).distinct().orderBy(tracker.file_order(C("name")))
