"""Streaming queries: the given tables read as streams to their end."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from .joins import STREAK_SQL
from .registry import query

C = F.col


def stream(t, name):
    """One of the given tables as a file stream."""
    return t.spark.readStream.schema(t.read(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def line_stream(t):
    """Order lines as postings: part name, supplier and a url per line's part and supplier."""
    url = F.concat(F.lit("https://lines.example.com/"), C("l_suppkey").cast("string"), F.lit("/"), C("l_partkey").cast("string"))
    return (stream(t, "lineitem").join(t.read("part"), C("l_partkey") == C("p_partkey"))
            .select(url.alias("url"), C("l_suppkey").cast("string").alias("company"), C("p_name").alias("title"),
                    C("l_shipdate").cast("timestamp").alias("postedDate"), "l_returnflag"))


@query("str01_new_postings", "SELECT DISTINCT 'https://lines.example.com/' || l_suppkey || '/' || l_partkey AS url FROM lineitem WHERE 'https://lines.example.com/' || l_suppkey || '/' || l_partkey NOT IN (SELECT 'https://lines.example.com/' || l_suppkey || '/' || l_partkey FROM lineitem WHERE l_shipdate < DATE '1998-01-01')")
def str01(t):
    seen = t.read("lineitem").filter("l_shipdate < DATE '1998-01-01'").select(F.concat(F.lit("https://lines.example.com/"), C("l_suppkey").cast("string"), F.lit("/"), C("l_partkey").cast("string")).alias("url"))
    return streams.drain(streams.new_postings(line_stream(t), seen).select("url"))


@query("str02_history_append", "SELECT event_type AS portal, CASE WHEN value > 100 THEN 'skipped_expired' ELSE 'added' END AS status, count(*) AS n FROM events GROUP BY ALL")
def str02(t):
    folder = streams.fresh_folder(t.spark, "history")
    rows = stream(t, "events").select("event_id", C("event_type").alias("portal"), F.when(C("value") > 100, "skipped_expired").otherwise("added").alias("status"))
    streams.append_outcomes(rows, folder)
    return t.spark.read.parquet(folder).groupBy("portal", "status").agg(F.count("*").alias("n"))


@query("str03_failure_streaks", f"""WITH {STREAK_SQL}, lr AS (SELECT company, max(run) AS until FROM rn GROUP BY company) SELECT lr.company, coalesce(sk.fails, 0) AS fails, CAST(sk.since AS VARCHAR) AS since, CAST(lr.until AS VARCHAR) AS last, coalesce(sk.fails, 0) >= 2 AS alert
  FROM lr LEFT JOIN sk ON sk.company = lr.company AND sk.until = lr.until""")
def str03(t):
    rows = stream(t, "events").select(C("user_id").cast("string").alias("company"), C("ts").cast("date").cast("string").alias("run"), (C("event_type") != "error").alias("ok"))
    return streams.latest(streams.drain(streams.failure_streaks(rows, 2), "update"), "company")


@query("str04_coverage_ledger", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, event_type, 'p' || CAST(floor(value / 50) AS BIGINT) AS p FROM events)
  SELECT key, coalesce(string_agg(DISTINCT CASE WHEN event_type IN ('view', 'click', 'error') THEN e.p END, ',' ORDER BY CASE WHEN event_type IN ('view', 'click', 'error') THEN e.p END), '') AS missed,
    coalesce(string_agg(DISTINCT CASE WHEN event_type = 'signup' THEN e.p END, ',' ORDER BY CASE WHEN event_type = 'signup' THEN e.p END), '') AS rejected, coalesce(any_value(CASE WHEN ok THEN h.p END), '') AS hit, CASE WHEN any_value(ok) THEN 'medium' ELSE '' END AS conf
  FROM e LEFT JOIN (SELECT l.key, l.p, NOT EXISTS (SELECT 1 FROM e r WHERE r.key = l.key AND r.p = l.p AND r.event_type = 'signup' AND r.event_id > l.at) AS ok
    FROM (SELECT key, arg_max(p, event_id) AS p, max(event_id) AS at FROM e WHERE event_type = 'purchase' GROUP BY key) l) h USING (key) GROUP BY key""")
def str04(t):
    kind = F.when(C("event_type") == "purchase", "hit").when(C("event_type") == "signup", "reject").otherwise("miss")
    rows = stream(t, "events").select(C("user_id").cast("string").alias("key"), C("event_id").alias("seq"), kind.alias("kind"),
                                      F.concat(F.lit("p"), F.floor(C("value") / 50).cast("string")).alias("provider"), F.lit("medium").alias("conf"))
    return streams.latest(streams.drain(streams.coverage_ledger(rows, 2), "update"), "key").select("key", "hit", "conf", "missed", "rejected")


@query("str05_weekly_activity", "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1")
def str05(t):
    rows = stream(t, "orders").select(C("o_orderdate").cast("timestamp").alias("at"))
    out = streams.drain(streams.weekly_activity(rows, "at"), "complete")
    return out.select(C("week.start").cast("date").alias("week"), "n")


@query("str06_repost_windows", """WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS company, p_name AS role_key, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
  w AS (SELECT company, role_key, unnest([0, 1, 2]) AS k, CAST(floor(date_diff('day', DATE '1970-01-01', d) / 30) AS BIGINT) AS b FROM p)
  SELECT company, role_key, CAST(DATE '1970-01-01' + CAST((b - k) * 30 AS INTEGER) AS DATE) AS window_start, count(*) AS n FROM w GROUP BY ALL""")
def str06(t):
    out = streams.drain(streams.repost_windows(line_stream(t)), "complete")
    return out.select("company", "role_key", C("span.start").cast("date").alias("window_start"), "n")


@query("str07_reposts", """WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS company, p_name AS role_key, 'https://lines.example.com/' || l_suppkey || '/' || l_partkey AS url, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey),
  d AS (SELECT company, role_key, url, day, count(*) AS n FROM p GROUP BY ALL)
  SELECT d.company, d.role_key, d.url, d.day, d.n, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS reposts, count(DISTINCT o.url) AS urls
  FROM d LEFT JOIN d o ON o.company = d.company AND o.role_key = d.role_key AND o.url <> d.url AND o.day < d.day AND o.day >= d.day - 90 GROUP BY ALL""")
def str07(t):
    return streams.latest(streams.drain(streams.reposts(line_stream(t)), "update"), "company", "role_key", "url", "day")
