"""Scalar function queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, names, numbers, text, urls
from ..operators import reports, tracker
from ..sources import feeds
from .joins import MINE_KEY
from .registry import query

C = F.col


@query("txt_a_entities", r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#8364;', '€'), '&amp;', '&') || 'é€' AS html FROM pages""")
def txt_a(t):
    return t.pages.select("page_id", text.decode_entities(F.concat("html", F.lit("&#233;&#x20AC;"))).alias("html"))


@query("txt_b_strip_html", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""")
def txt_b(t):
    return t.pages.select("page_id", text.strip_html(C("html")).alias("body"))


@query("txt_c_slugify", r"SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(replace(text, 'ß', '?'))), '[^a-z0-9\s]', '', 'g'), '\s+', '-', 'g') AS slug FROM documents")
def txt_c(t):
    return t.documents.select("doc_id", text.slugify_title(C("text")).alias("slug"))


_NAME = "CASE WHEN s_acctbal < 0 THEN 'The ' || s_name || ' Games, Inc.' WHEN s_acctbal < 4000 THEN 'Supplier (' || s_suppkey || ') Studios' WHEN s_acctbal < 7000 THEN 'supplier' || s_suppkey || 'gamesltd' ELSE s_name || ' Technologies Group' END"
_NOISE = "ab|inc|ltd|llc|studios?|games?|interactive|entertainment|group|the"


@query("txt_d_name_keys", f"""WITH n AS (SELECT s_suppkey, {_NAME} AS n FROM supplier) SELECT s_suppkey, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS alnum_key, trim(regexp_replace(regexp_replace(lower(n), '[()]', '', 'g'), '[^a-z0-9 ]', '', 'g')) AS spaced_key,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(n), ' inc\\.$', ''), ' group$', ''), ' co\\.$', '')) AS board_key, {MINE_KEY.format('n')} AS mine_key,
    array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(n), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('the', 'games', 'inc', 'studios', 'group')), ' ') AS track_key,
    regexp_replace(regexp_replace(lower(n), '\\b({_NOISE})\\b', '', 'g'), '[^a-z0-9]+', '', 'g') AS probe_key, lower(n) AS lookup_key,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(n), '\\b(studios?|games?|inc|the|co)\\b', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS core_name FROM n""")
def txt_d(t):
    bal, s, k = C("s_acctbal"), C("s_name"), C("s_suppkey").cast("string")
    n = (F.when(bal < 0, F.concat(F.lit("The "), s, F.lit(" Games, Inc."))).when(bal < 4000, F.concat(F.lit("Supplier ("), k, F.lit(") Studios")))
         .when(bal < 7000, F.concat(F.lit("supplier"), k, F.lit("gamesltd"))).otherwise(F.concat(s, F.lit(" Technologies Group"))))
    rows = t.read("supplier").select("s_suppkey", n.alias("n"))
    keys = ["alnum_key", "spaced_key", "board_key", "mine_key", "track_key", "probe_key", "lookup_key", "core_name"]
    return rows.select("s_suppkey", *[getattr(names, k)(C("n")).alias(k) for k in keys])


@query("txt_e_fold", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS folded FROM documents")
def txt_e(t):
    return t.documents.select("doc_id", text.fold(C("text")).alias("folded"))


@query("txt_f_slugs_domains", """WITH n AS (SELECT p_partkey, p_name || ' Studios (EU)' AS n, replace(p_name, ' ', '') AS a, replace(p_name, ' ', '-') AS h FROM part)
  SELECT p_partkey, a || 'studios,' || h || '-studios,' || a AS slugs, array_to_string(list_transform(['com', 'io'], lambda e: a || 'studios.' || e), ',') || ',' || array_to_string(list_transform(['com', 'io'], lambda e: a || 'eu.' || e), ',') AS domains FROM n""")
def txt_f(t):
    n = F.concat("p_name", F.lit(" Studios (EU)"))
    return t.read("part").select("p_partkey", F.array_join(names.name_slugs(n), ",").alias("slugs"), F.array_join(names.domain_guesses(n, ["com", "io"]), ",").alias("domains"))


@query("txt_g_report_links", "SELECT num, '[' || num || '](../reports/' || num || '.md)' AS report, num AS report_number, regexp_extract(report, '\\]\\(([^)]+)\\)', 1) AS target FROM application")
def txt_g(t):
    return t.application.select("num", tracker.rewrite_links(C("report"), "../").alias("report"), tracker.report_number(C("report")).alias("report_number"), tracker.link_target(C("report")).alias("target"))


_SIGNS = [("—", "-"), ("–", "-"), ("“", '"'), ("…", "..."), (" ", " "), ("€", "EUR ")]


@query("txt_h_ascii_signs", f"""SELECT doc_id, {"replace(" * 6}replace(text, ' ', ' — “x” … ')""" + "".join(f", '{a}', '{b}')" for a, b in [("—", "-"), ("–", "-"), ("“", '"'), ("”", '"'), ("…", "..."), (" ", " ")]) + " AS body, len(string_split(text, ' ')) - 1 AS dashes FROM documents WHERE NOT regexp_matches(text, '[<>€£·•→←↑↓‘-‟​-‍⁠﻿]')")
def txt_h(t):
    clean = t.documents.filter(~F.rlike("text", F.lit("[<>€£·•→←↑↓‘-‟​-‍⁠﻿]")))
    body = F.replace("text", F.lit(" "), F.lit(" — “x” … "))
    rows = clean.select("doc_id", body.alias("b"))
    counts = text.ascii_sign_counts(C("b"))
    dashes = F.get(F.filter(counts, lambda x: x["sign"] == "em-dash"), F.lit(0))["n"]
    return rows.select("doc_id", text.ascii_html(C("b")).alias("body"), dashes.alias("dashes"))


@query("txt_i_truncate", r"""SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 117) || '...' ELSE text END AS cut, CASE WHEN length(f) <= 100 THEN f ELSE regexp_replace(left(f, 100), '\s+\S*$', '') || '…' END AS words FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)""")
def txt_i(t):
    return t.documents.select("doc_id", text.cut_with_ellipsis(C("text"), 120).alias("cut"), text.cut_at_word(C("text"), 100).alias("words"))


@query("txt_j_places", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN n_name || ', ' || r_name ELSE 'Gaming ' || n_name END AS city, n_name || ', ' || r_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def txt_j(t):
    rows = t.read("customer").join(t.read("nation"), C("c_nationkey") == C("n_nationkey")).join(t.read("region"), C("n_regionkey") == C("r_regionkey"))
    raw = F.when(C("c_acctbal") < 0, F.concat(F.lit(" Team in Saga in "), "n_name", F.lit(", "), "r_name")).otherwise(F.concat(F.lit("Gaming "), "n_name"))
    return rows.select("c_custkey", text.address_city(raw).alias("city"), text.place_string(C("n_name"), C("r_name"), C("n_name")).alias("place"))


@query("txt_k_hosts", r"""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS host, regexp_extract(url, '([^./]+\.[^./]+)(?:[/?#]|$)', 1) AS domain FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+', 0) AS url FROM pages)""")
def txt_k(t):
    return t.pages.select("page_id", urls.host(C("url")).alias("host"), urls.registrable_domain(urls.host(C("url"))).alias("domain"))


@query("txt_k_own_hosts", """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '' WHEN 'BUILDING' THEN '' ELSE 'own.example.co.uk' END AS own, CASE WHEN c_acctbal < 0 THEN '' ELSE 'studio.dk' END AS mail, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'github.com' WHEN 'BUILDING' THEN 'itch.io' ELSE 'co.uk' END AS loose FROM customer""")
def txt_k2(t):
    seg = C("c_mktsegment")
    url = F.when(seg == "AUTOMOBILE", "https://github.com/x").when(seg == "BUILDING", "https://x.itch.io/y").otherwise("https://www.own.example.co.uk:8080/jobs?a=1")
    mail = F.when(C("c_acctbal") < 0, "Ann@GMAIL.com").otherwise("ann@www.studio.dk")
    return t.read("customer").select("c_custkey", urls.own_host(url).alias("own"), urls.mail_host(mail).alias("mail"), urls.last_two_labels(url).alias("loose"))


@query("txt_l_posting_id", r"SELECT url, CASE WHEN contains(url, 'gh_jid') THEN regexp_extract(url, 'gh_jid=([0-9]+)', 1) ELSE regexp_extract(url, '/([0-9]{5,})$', 1) END AS id, count(*) AS n FROM posting GROUP BY 1, 2")
def txt_l(t):
    return t.posting.groupBy("url").agg(F.count("*").alias("n")).select("url", urls.posting_id(C("url")).alias("id"), "n")


@query("txt_m_studio_slug", """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'amber' WHEN 'BUILDING' THEN 'AmberCareers' ELSE NULL END AS slug FROM customer""")
def txt_m(t):
    seg = C("c_mktsegment")
    url = F.when(seg == "AUTOMOBILE", "https://amber.teamtailor.com/jobs/1").when(seg == "BUILDING", "https://jobs.jobvite.com/en/AmberCareers/x").when(seg == "FURNITURE", "no url").otherwise("https://www.example.com/jobs/")
    return t.read("customer").select("c_custkey", urls.studio_slug(url).alias("slug"))


@query("txt_n_link_key", r"SELECT DISTINCT url, regexp_replace(split_part(split_part(url, '://', 2), '?', 1), '^www\.', '') || CASE WHEN contains(url, 'gh_jid') THEN '?gh_jid=' || regexp_extract(url, 'gh_jid=([0-9]+)', 1) ELSE '' END AS key FROM posting")
def txt_n(t):
    return t.posting.select("url").distinct().select("url", urls.link_key(F.concat("url", F.when(F.contains("url", F.lit("?")), F.lit("&utm=1")).otherwise(F.lit("/")))).alias("key"))


@query("txt_o_posting_url", "SELECT p_partkey, 'https://x.example.com/' || url_encode(p_name) || '/' || p_partkey || '/' || replace(p_name, ' ', '-') AS url FROM part")
def txt_o(t):
    values = {"name": C("p_name"), "id": C("p_partkey"), "slug": text.slugify_title(C("p_name"))}
    return t.read("part").select("p_partkey", urls.posting_url("https://x.example.com/{name}/{id}/{slug}", values).alias("url"))


@query("dat_a_any_date", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%dT%H:%M:%S.000Z') END AS iso FROM orders""")
def dat_a(t):
    d = (C("o_orderdate") + F.make_interval(years=F.lit(10))).cast("timestamp")
    p = C("o_orderpriority")
    raw = (F.when(p == "1-URGENT", F.lit("soon")).when(p == "2-HIGH", F.unix_millis(d).cast("string")).when(p == "3-MEDIUM", F.unix_seconds(d).cast("string"))
           .when(p == "5-LOW", F.concat(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return t.read("orders").select("o_orderkey", dates.iso_instant(raw).alias("iso"))


@query("dat_b_relative_date", """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN TIMESTAMP '2024-05-01' - INTERVAL 1 DAY WHEN 'LARGE' THEN TIMESTAMP '2024-05-01' - INTERVAL 30 DAY WHEN 'MEDIUM' THEN TIMESTAMP '2024-05-01' ELSE TIMESTAMP '2024-05-01' - to_weeks(CAST(p_size AS INTEGER)) END AS at FROM part""".replace("END AS at FROM", "END AS posted FROM"))
def dat_b(t):
    raw = (F.when(C("p_type") == "PROMO", F.lit("lately")).when(C("p_type") == "SMALL", F.lit("Yesterday")).when(C("p_type") == "LARGE", F.lit("posted a month ago"))
           .when(C("p_type") == "MEDIUM", F.lit("just now")).otherwise(F.concat(F.lit("Posted "), C("p_size").cast("string"), F.lit(" weeks ago"))))
    return t.read("part").select("p_partkey", dates.relative_instant(raw, F.lit("2024-05-01 00:00:00")).alias("posted"))


@query("dat_c_strict_date", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01') AS days, CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) AS next FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderpriority = '5-LOW'""")
def dat_c(t):
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(C("o_orderpriority") == "5-LOW", F.lit("T00")).otherwise(F.lit(" ")))
    day = dates.strict_date(raw)
    return t.read("orders").select("o_orderkey", day.alias("day"), dates.days_between(day, F.to_date(F.lit("2001-09-01"))).alias("days"), F.date_add(day, 7).alias("next"))


@query("dat_d_iso_week", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week FROM orders")
def dat_d(t):
    return t.read("orders").select("o_orderkey", dates.iso_week(C("o_orderdate")).alias("week"))


@query("num_a_score_parse", """SELECT num, CASE WHEN pdf = '✅' THEN 4.25 ELSE CAST(replace(score, '/5', '') AS DOUBLE) END::DOUBLE AS first_number, CASE WHEN pdf = '✅' THEN 0.0 ELSE CAST(replace(score, '/5', '') AS DOUBLE) END::DOUBLE AS out_of_five, CASE WHEN pdf = '✅' THEN NULL ELSE CAST(replace(score, '/5', '') AS DOUBLE) END AS leading FROM application""")
def num_a(t):
    raw = F.when(C("pdf") == "✅", F.lit("**~4.25**")).otherwise(C("score"))
    return t.application.select("num", numbers.first_number(raw).alias("first_number"), numbers.out_of_five(raw).alias("out_of_five"), numbers.leading_number(raw).alias("leading"))


@query("num_b_combine", "SELECT p_partkey, least(a, b, c) AS low, greatest(a, b, c) AS high, round(a * b * c, 6) AS product, round((a + b + c) / 3, 6) AS mean FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, 0.5::DOUBLE AS c FROM part)")
def num_b(t):
    w = F.array(C("p_size").cast("double"), "p_retailprice", F.lit(0.5))
    return t.read("part").select("p_partkey", numbers.combine(w, "min").alias("low"), numbers.combine(w, "max").alias("high"), F.round(numbers.combine(w, "multiply"), 6).alias("product"), F.round(numbers.combine(w, "average"), 6).alias("mean"))


@query("num_c_percentages", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 0.0 ELSE round(100.0 * p_size / (26 - p_size), 6) END::DOUBLE AS pct, CASE WHEN p_size > 25 THEN 0 ELSE CAST(floor(100.0 * p_size / (26 - p_size) + 0.5) AS BIGINT) END AS whole FROM part")
def num_c(t):
    whole = F.when(C("p_size") > 25, 0).otherwise(26 - C("p_size"))
    return t.read("part").select("p_partkey", F.round(numbers.safe_pct(C("p_size"), whole), 6).alias("pct"), numbers.whole_pct(C("p_size"), whole).alias("whole"))


@query("arr_a_token_sets", """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [lower(p_type), split_part(p_name, ' ', 1), 'widget'] AS b FROM part)
  SELECT p_partkey, CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS BIGINT) AS overlap, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset, left(a[1], 1) || left(a[2], 1) AS initials FROM w""")
def arr_a(t):
    rows = t.read("part").select("p_partkey", F.split("p_name", " ").alias("a"), F.array(F.lower("p_type"), F.substring_index("p_name", " ", 1), F.lit("widget")).alias("b"))
    return rows.select("p_partkey", F.size(names.shared_words(C("a"), C("b"))).alias("overlap"), (F.size(F.array_except("a", "b")) == 0).alias("subset"), names.initials(C("a")).alias("initials"))


@query("arr_b_list_normalise", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || '|' || p_brand ELSE p_name END AS items FROM part")
def arr_b(t):
    raw = F.array(F.concat(F.lit(" "), "p_name"), F.when(C("p_size") > 25, C("p_brand")), F.lit("  "))
    return t.read("part").select("p_partkey", F.array_join(text.clean_list(raw), "|").alias("items"))


@query("jsn_a_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'https://x.example.com/' || json_extract_string(props, '$.k') || '/' || event_type AS url FROM events")
def jsn_a(t):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.read("events").select("event_id", k.alias("k"), urls.posting_url("https://x.example.com/{k}/{kind}", {"k": k, "kind": C("event_type")}).alias("url"))


@query("map_a_first_wins", "SELECT p_partkey, p_name AS level, p_brand AS place FROM part")
def map_a(t):
    def pair(k, v):
        return F.struct(F.lit(k).alias("key"), v.alias("value"))
    m = feeds.first_wins_map(F.array(pair("level", F.lit("")), pair("level", C("p_name")), pair("place", C("p_brand")), pair("level", C("p_type"))))
    return t.read("part").select("p_partkey", m.alias("m")).select("p_partkey", C("m")["level"].alias("level"), C("m")["place"].alias("place"))
