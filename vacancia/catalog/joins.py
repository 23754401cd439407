"""Join, de-duplication, set and window queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, urls
from ..functions.numbers import first_number
from ..functions.text import fold
from ..operators import companies, health, predicates, snapshot, tracker
from ..plans.board import history
from .enrichment import links
from .filters import BATCH_SQL, KEY, KEYS, batch, batch_state
from .registry import query

C = F.col
FOLD = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
HISTORY_SQL = "hist AS (SELECT url, CASE WHEN l_quantity > 40 THEN 'skipped_expired' ELSE 'added' END AS status, company, title, seq AS lpos, postedDate FROM posting WHERE postedDate < DATE '1998-01-01')"


@query("jon01_unseen_urls", f"WITH {HISTORY_SQL} SELECT {KEYS}, url FROM posting WHERE url NOT IN (SELECT url FROM hist WHERE status <> 'skipped_expired')")
def jon01(t):
    return snapshot.unseen(t.posting, snapshot.seen_urls(history(t))).select(*KEY, "url")


@query("jon02_untracked_pairs", f"""SELECT {KEYS} FROM posting WHERE lower(company) || '::' || lower(title) NOT IN
    (SELECT DISTINCT lower(s_name) || '::' || lower(p_name || ' ' || p_type) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_tax > 0.06)""")
def jon02(t):
    tracked = (t.read("lineitem").filter("l_tax > 0.06").join(t.read("part"), C("l_partkey") == C("p_partkey"))
               .join(t.read("supplier"), C("l_suppkey") == C("s_suppkey"))
               .select(C("s_name").alias("company"), F.concat(F.lit(" "), "p_name", F.lit(" "), "p_type").alias("role")))
    return snapshot.untracked(t.posting, tracked).select(*KEY)


@query("jon03_first_wins")
def jon03(t):
    return snapshot.first_wins(t.posting).select(*KEY, "url", "company", "title")


PAGES_SQL = """u AS (SELECT lower(trim(name)) AS key, CASE WHEN job_url_template IS NOT NULL THEN regexp_extract(job_url_template, '^([^{]*/)', 1) ELSE careers_url END AS page, seq FROM company
    WHERE careers_url IS NOT NULL AND NOT contains(careers_url, 'gamejobs.co')),
  al AS (SELECT trim(regexp_replace(key, '\\s*\\([^)]*\\)\\s*', ' ', 'g')) AS key, count(*) AS n, arg_min(page, seq) AS page FROM u WHERE contains(key, '(') GROUP BY 1),
  pg AS (SELECT key, page FROM u UNION ALL SELECT key, page FROM al WHERE n = 1 AND key NOT IN (SELECT key FROM u))"""


@query("jon04_company_pages", f"WITH {PAGES_SQL} SELECT {KEYS}, company, page AS \"companyUrl\" FROM posting LEFT JOIN pg ON lower(trim(company)) = key")
def jon04(t):
    return snapshot.with_company_page(t.posting, t.company).select(*KEY, "company", "companyUrl")


@query("jon05_detail_overlay", f"""SELECT {KEYS}, CASE WHEN p_size > 25 THEN p_brand ELSE experienceLevel END AS "experienceLevel", CASE WHEN p_size > 40 THEN 'Detail: ' || p_name ELSE title END AS title FROM posting JOIN part ON l_partkey = p_partkey""")
def jon05(t):
    detail = t.read("part").select(C("p_partkey").alias("pk"), F.lit(None).cast("boolean").alias("drop"),
                                   F.when(C("p_size") > 25, C("p_brand")).otherwise(F.lit("")).alias("experienceLevel"),
                                   F.when(C("p_size") > 40, F.concat(F.lit("Detail: "), "p_name")).alias("title"))
    return snapshot.overlay_detail(t.posting.withColumn("pk", C("landing.l_partkey")), detail, "pk", ["experienceLevel", "title"]).select(
        *KEY, "experienceLevel", "title")


# employers are 'Supplier#n', 'Supplier#n Studios' and 'n': equal without generic words, or a word subset
_MIRROR_SQL = f"""p AS (SELECT *, {FOLD.format('title')} AS tk, regexp_extract(company, '([0-9]+)', 1) AS ck, {FOLD.format("split_part(location, ',', 1)")} AS city FROM posting),
  d AS (SELECT DISTINCT tk, ck, city FROM p WHERE l_returnflag = 'N'), a AS (SELECT DISTINCT tk, ck, city FROM p WHERE l_returnflag = 'A'),
  m AS (SELECT p.*, CASE WHEN l_returnflag <> 'N' AND EXISTS (SELECT 1 FROM d WHERE d.tk = p.tk AND d.ck = p.ck AND (d.city = '' OR p.city = '' OR d.city = p.city)) THEN 1
    WHEN l_returnflag = 'R' AND EXISTS (SELECT 1 FROM a WHERE a.tk = p.tk AND a.ck = p.ck AND (a.city = '' OR p.city = '' OR a.city = p.city)) THEN 2 END AS tier FROM p)"""
POSTING_FLAG = ", l_returnflag"


def _with_flag(sql: str) -> str:
    """The mirror SQL tells direct rows, boards and last resort by their host."""
    flag = "CASE WHEN contains(url, 'gamedevjobs.com') THEN 'R' WHEN contains(url, 'gamejobs.co') THEN 'A' ELSE 'N' END"
    return sql.replace("FROM posting)", f"FROM (SELECT *, {flag} AS l_returnflag FROM posting))", 1)


@query("jon06_mirrors", _with_flag(f"WITH {_MIRROR_SQL} SELECT {KEYS}, CAST(tier AS BIGINT) AS mirror_tier FROM m"))
def jon06(t):
    return snapshot.mark_mirrors(t.posting).select(*KEY, "mirror_tier")


@query("jon07_company_compatible", """WITH n AS (SELECT s_suppkey AS k, s_name AS a, CASE WHEN s_acctbal < 0 THEN upper(s_name) || ' Games Ltd.' WHEN s_acctbal < 3000 THEN 'The ' || substr(s_name, 10) || ' Group' WHEN s_acctbal < 6000 THEN 'S' || left(substr(s_name, 10), 1)
    WHEN s_acctbal < 8000 THEN 'Studio Games' ELSE s_name || '1' END AS b, s_acctbal FROM supplier) SELECT k, a, b, s_acctbal < 6000 AS fits FROM n""")
def jon07(t):
    s, bal = C("s_name"), C("s_acctbal")
    b = (F.when(bal < 0, F.concat(F.upper(s), F.lit(" Games Ltd."))).when(bal < 3000, F.concat(F.lit("The "), F.substring(s, 10, 99), F.lit(" Group")))
         .when(bal < 6000, F.concat(F.lit("S"), F.substring(s, 10, 1))).when(bal < 8000, F.lit("Studio Games")).otherwise(F.concat(s, F.lit("1"))))
    return t.read("supplier").select(C("s_suppkey").alias("k"), s.alias("a"), b.alias("b")).withColumns(
        names.guard_columns("x", C("a")) | names.guard_columns("y", C("b"))).select("k", "a", "b", names.company_compatible("x", "y").alias("fits"))


@query("jon08_city_compatible", f"""WITH c AS (SELECT c_custkey, n_name || ', ' || r_name AS a, CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 5000 THEN lower(n_name) || ' (West), XX' ELSE replace(n_name, '_', '-') END AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT c_custkey, b = '' OR {FOLD.format("split_part(a, ',', 1)")} = {FOLD.format("split_part(b, ',', 1)")} AS fits FROM c""")
def jon08(t):
    n, bal = C("n_name"), C("c_acctbal")
    rows = (t.read("customer").join(t.read("nation"), C("c_nationkey") == C("n_nationkey")).join(t.read("region"), C("n_regionkey") == C("r_regionkey")))
    a = F.concat(n, F.lit(", "), "r_name")
    b = F.when(bal < 0, F.lit("")).when(bal < 5000, F.concat(F.lower(n), F.lit(" (West), XX"))).otherwise(F.replace(n, F.lit("_"), F.lit("-")))
    return rows.select("c_custkey", names.city_compatible(a, b).alias("fits"))


# --- tracker merge ------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower(role), '\\s+'), lambda w: (length(w) > 3 OR w = 'api') AND w NOT IN ('senior', 'lead'))"
_BASE = "['engineer', 'designer', 'software', 'systems', 'backend']"
_HIT = f"""len(list_filter(a.w, lambda x: list_contains(e.w, x))) >= 2 AND len(list_filter(a.w, lambda x: list_contains(e.w, x) AND NOT list_contains({_BASE}, x))) > 0
    AND len(list_filter(a.w, lambda x: list_contains(e.w, x))) >= 0.6 * least(len(a.w), len(e.w))"""
MERGE_SQL = f"""e AS (SELECT *, {_WORDS} AS w, CAST(regexp_extract(report, '\\[(\\d+)\\]', 1) AS BIGINT) AS rep FROM existing),
  a AS (SELECT *, {_WORDS} AS w, TRY_CAST(regexp_extract(report, '\\[(\\d+)\\]', 1) AS BIGINT) AS rep FROM addition),
  r AS (SELECT a.file_seq, min(e.pos) AS pos FROM a JOIN e ON a.company = e.company AND {_HIT} GROUP BY a.file_seq),
  mt AS (SELECT a.*, coalesce(e1.pos, e2.pos, r.pos) AS mpos FROM a LEFT JOIN e e1 ON a.rep = e1.rep LEFT JOIN e e2 ON a.num = e2.num LEFT JOIN r ON a.file_seq = r.file_seq)"""


@query("jon09_addition_match", f"WITH {MERGE_SQL} SELECT file_seq, mpos AS match_num FROM mt")
def jon09(t):
    return tracker.match_additions(t.addition, t.existing).select("file_seq", C("match.pos").alias("match_num"))


def _role_pairs(t):
    """A role against the same role in another wording, one row per order."""
    a = t.application.select("num", "role", "company")
    return a.withColumn("other", F.concat(F.replace("role", F.lit("Gameplay"), F.lit("Combat")), F.lit(" (Berlin)")))


_PAIR_SQL = "pr AS (SELECT num, role, replace(role, 'Gameplay', 'Combat') || ' (berlin)' AS other FROM application)"


@query("jon10_role_match_merge", f"""WITH {_PAIR_SQL}, x AS (SELECT num, {_WORDS} AS a, list_filter({_WORDS.replace('role', "replace(other, ' (berlin)', '')")}, lambda w: TRUE) AS b FROM pr),
  o AS (SELECT num, a, b, list_filter(a, lambda w: list_contains(b, w)) AS s FROM x)
  SELECT num, len(s) >= 2 AND len(list_filter(s, lambda w: NOT list_contains({_BASE}, w))) > 0 AND len(s) >= 0.6 * least(len(a), len(b)) AS same FROM o""")
def jon10(t):
    return names.with_same_role(_role_pairs(t), "role", "other", "same").select("num", "same")


_CWORDS = "list_filter(regexp_split_to_array(lower(role), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('senior', 'lead', 'engineer'))"


@query("jon11_role_match_cluster", f"""WITH {_PAIR_SQL}, x AS (SELECT num, {_CWORDS} AS a, {_CWORDS.replace('role', "replace(other, ' (berlin)', '')")} AS b FROM pr),
  o AS (SELECT num, a, b, list_filter(a, lambda w: list_contains(b, w)) AS s FROM x) SELECT num, len(s) >= 2 AND len(s) >= 0.6 * least(len(a), len(b)) AS same FROM o""")
def jon11(t):
    return names.with_same_role(_role_pairs(t), "role", "other", "same", names.cluster_role_words, None).select("num", "same")


@query("jon12_application_report", "SELECT num, archetype, remote FROM application LEFT JOIN report ON path = regexp_extract(application.report, '\\]\\(([^)]+)\\)', 1)")
def jon12(t):
    return tracker.with_report(t.application, t.report.select("path", "archetype", "remote")).select("num", "archetype", "remote")


@query("jon13_follow_ups", "SELECT num, coalesce(n, 0) AS follow_ups, last AS last_follow_up FROM application LEFT JOIN (SELECT appNum, count(*) AS n, max(date) AS last FROM follow_up GROUP BY appNum) ON num = appNum")
def jon13(t):
    return tracker.with_follow_ups(t.application, t.follow_up).select("num", "follow_ups", "last_follow_up")


# --- job urls -----------------------------------------------------------------------------------

def headers(t):
    """Report headers: completed orders carry a url, pending ones a batch id."""
    o = t._orders()
    key = C("o_orderkey").cast("string")
    return o.select(
        F.concat(F.when(C("o_orderpriority") == "5-LOW", F.lit("../")).otherwise(F.lit("")), F.lit("reports/"), key, F.lit(".md")).alias("path"),
        F.when((C("o_orderstatus") == "F") & (C("o_orderpriority") == "2-HIGH"), F.concat(F.lit("https://header.example.com/"), key)).alias("url"),
        F.when(C("o_orderstatus") == "P", C("o_custkey").cast("string")).alias("batch_id")).filter("url is not null or batch_id is not null")


def listed(t):
    """Scan history of the customers' own postings: one per order line with a part name."""
    return (t.read("lineitem").join(t.read("part"), C("l_partkey") == C("p_partkey"))
            .join(t.read("orders"), C("l_orderkey") == C("o_orderkey")).join(t.read("customer"), C("o_custkey") == C("c_custkey"))
            .select(C("c_name").alias("company"), F.concat("p_name", F.lit(" "), F.when(C("p_size") > 30, F.lit("gameplay engine")).otherwise(F.lit("level narrative"))).alias("title"),
                    F.concat(F.lit("https://seen.example.com/"), C("l_orderkey").cast("string"), F.lit("/"), C("l_partkey").cast("string"), F.lit("/"), C("l_linenumber").cast("string")).alias("url"),
                    F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("lpos")))


LISTED_SQL = """ls AS (SELECT c_name AS company, p_name || ' ' || CASE WHEN p_size > 30 THEN 'gameplay engine' ELSE 'level narrative' END AS title,
    'https://seen.example.com/' || l_orderkey || '/' || l_partkey || '/' || l_linenumber AS url, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS lpos
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
_BEST = """(SELECT pos, arg_min(url, lpos) AS url FROM (SELECT pos, url, lpos, hits, max(hits) OVER (PARTITION BY pos) AS top FROM (SELECT ap.pos, l.url, l.lpos,
    len(list_filter(regexp_split_to_array(lower(ap.role), '\\s+'), lambda w: length(w) > 2 AND contains(lower(l.title), w))) AS hits FROM application ap JOIN {} l ON l.company = ap.company)) WHERE hits = top GROUP BY pos)"""


@query("jon15_best_role_url", f"WITH {LISTED_SQL} SELECT * FROM {_BEST.format('ls')}")
def jon15(t):
    return tracker.best_role_url(t.application, listed(t)).select("pos", "url")


@query("jon14_job_urls", f"""WITH {BATCH_SQL}, {LISTED_SQL}, jb AS (SELECT id, CASE WHEN contains(notes, '| http') THEN split_part(notes, '| ', 3) ELSE url END AS job_url,
      CASE WHEN contains(notes, ' @ ') THEN regexp_extract(notes, ' @ ([^|]+) \\|', 1) END AS company, CASE WHEN contains(notes, ' @ ') THEN regexp_extract(notes, '^(.*) @ ', 1) END AS title FROM bi),
    hd AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '../' ELSE '' END || 'reports/' || o_orderkey || '.md' AS path, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'https://header.example.com/' || o_orderkey END AS u1,
      CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR) END AS bid FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') OR o_orderstatus = 'P'),
    fin AS (SELECT jb.id, job_url, unnest([report_num, lpad(report_num, CAST(greatest(3, length(report_num)) AS INTEGER), '0')]) AS no FROM st JOIN jb USING (id) WHERE status = 'completed'),
    f3 AS (SELECT no, arg_max(job_url, id) AS u3 FROM fin GROUP BY no),
    nt AS (SELECT company, title, job_url AS url, id AS lpos FROM jb WHERE company IS NOT NULL),
    j AS (SELECT ap.pos, hd.u1, jb.job_url AS u2, CASE WHEN hd.path IS NOT NULL THEN f3.u3 END AS u3, b4.url AS u4, b5.url AS u5 FROM application ap LEFT JOIN hd ON hd.path = regexp_extract(ap.report, '\\]\\(([^)]+)\\)', 1)
      LEFT JOIN jb ON jb.id = hd.bid LEFT JOIN f3 ON f3.no = regexp_extract(ap.report, '\\[(\\d+)\\]', 1) LEFT JOIN {_BEST.format('ls')} b4 ON b4.pos = ap.pos LEFT JOIN {_BEST.format('nt')} b5 ON b5.pos = ap.pos)
  SELECT pos, coalesce(u1, u2, u3, u4, u5) AS job_url, CAST(CASE WHEN u1 IS NOT NULL THEN 1 WHEN u2 IS NOT NULL THEN 2 WHEN u3 IS NOT NULL THEN 3 WHEN u4 IS NOT NULL THEN 4 WHEN u5 IS NOT NULL THEN 5 END AS BIGINT) AS tier FROM j""")
def jon14(t):
    return tracker.job_urls(t.application, headers(t), batch(t), batch_state(t), listed(t))


@query("jon16_broken_links", """SELECT num FROM application WHERE regexp_extract(report, '\\]\\(([^)]+)\\)', 1) NOT IN (SELECT CASE WHEN c_acctbal > 0 THEN 'reports/' || o_orderkey || '.md' ELSE '../reports/' || o_orderkey || '.md' END FROM orders JOIN customer ON o_custkey = c_custkey)
    AND 'data/' || regexp_extract(report, '\\]\\(([^)]+)\\)', 1) NOT IN (SELECT 'data/reports/' || o_orderkey || '.md' FROM orders WHERE o_orderstatus = 'F')""")
def jon16(t):
    k = C("o_orderkey").cast("string")
    files = t._orders().select(F.concat(F.when(C("c_acctbal") > 0, F.lit("")).otherwise(F.lit("../")), F.lit("reports/"), k, F.lit(".md")).alias("path")).unionByName(
        t.read("orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("data/reports/"), k, F.lit(".md")).alias("path")))
    return tracker.broken_links(t.application, files, "data/").select("num")


MINE_KEY = "regexp_replace(regexp_replace(regexp_replace(lower({}), '\\b(ab|inc|ltd|llc|gmbh|studios?|games?|interactive|entertainment|group|the|co)\\b', '', 'g'), '[^a-z0-9]', '', 'g'), '(ltd|llc|gmbh|studios?|interactive|entertainment|group|games?)', '', 'g')"


@query("jon17_not_tracked", f"""WITH cand AS (SELECT c_custkey, replace(c_name, 'Customer', 'The Supplier') || ' Games' AS name, 'https://careers.example.com/' || c_nationkey AS url, c_nationkey FROM customer)
  SELECT c_custkey FROM cand WHERE {MINE_KEY.format('name')} NOT IN (SELECT {MINE_KEY.format('s_name')} FROM supplier) AND CAST(c_nationkey AS VARCHAR) NOT IN (SELECT CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_acctbal < -900)""")
def jon17(t):
    cand = t.read("customer").select("c_custkey", F.concat(F.replace("c_name", F.lit("Customer"), F.lit("The Supplier")), F.lit(" Games")).alias("name"),
                                     C("c_nationkey").cast("string").alias("slug"))
    tracked = t.read("supplier").select(C("s_name").alias("tname"), F.when(C("s_acctbal") < -900, C("s_nationkey").cast("string")).alias("tslug"))
    keys = {"name_key": (names.mine_key(C("name")), names.mine_key(C("tname"))), "slug_key": (C("slug"), C("tslug"))}
    return companies.not_tracked(cand, tracked, keys).select("c_custkey")


_DOMAIN = "regexp_extract(split_part(split_part(split_part({}, '//', 2), '/', 1), ':', 1), '([^.]+\\.[^.]+)$', 1)"
ASKED_URL = ("CASE WHEN c_acctbal < 0 THEN 'https://www.gamejobs.co/x' WHEN c_acctbal < 2000 THEN 'http://www.example.net:8080/?q=1' "
             "WHEN c_acctbal < 4000 THEN 'https://example.io' WHEN c_acctbal < 6000 THEN 'https://careers.example.com/' END")


@query("jon18_tracked_lookup", f"""WITH k AS (SELECT seq, lower(replace(name, '#', ' ')) AS nm, [{', '.join(_DOMAIN.format(u) for u in ('careers_url', 'api', 'endpoint', 'feed_url'))}] AS hosts,
    CASE WHEN recipe IS NOT NULL THEN recipe = 'html' ELSE parser IS NOT NULL OR provider IS NOT NULL OR careers_url IS NOT NULL OR api IS NOT NULL END AS ok FROM company),
  b AS (SELECT c_custkey, lower(replace(replace(c_name, 'Customer', 'Supplier'), '#', ' ')) AS qn, {ASKED_URL} AS u FROM customer), q AS (SELECT *, {_DOMAIN.format('u')} AS qd FROM b),
  h AS (SELECT c_custkey, bool_or(ok) AS ok, count(*) AS n FROM (SELECT c_custkey, seq, ok FROM q JOIN k ON nm = qn UNION SELECT c_custkey, seq, ok FROM q JOIN (SELECT seq, ok, unnest(hosts) AS host FROM k) ON host = qd) GROUP BY c_custkey)
  SELECT q.c_custkey, CASE WHEN h.ok THEN 'tracked' WHEN h.n > 0 THEN 'backlog' WHEN q.qn IN (SELECT lower(replace(replace(c_name, 'Customer', 'Supplier'), '#', ' ')) FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'backlog' ELSE 'unknown' END AS status,
    CASE WHEN h.n > 0 THEN h.n WHEN q.qn IN (SELECT lower(replace(replace(c_name, 'Customer', 'Supplier'), '#', ' ')) FROM customer WHERE c_mktsegment = 'BUILDING') THEN 1 ELSE 0 END AS matches FROM q LEFT JOIN h USING (c_custkey)""")
def jon18(t):
    asked = t.read("customer").select(F.replace("c_name", F.lit("Customer"), F.lit("The Supplier")).alias("query"), "c_custkey", F.expr(ASKED_URL).alias("url"))
    research = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"))
    found = companies.tracked_lookup(asked.select("query", "url"), t.company, research)
    return found.join(asked.select("query", "c_custkey"), "query").select("c_custkey", "status", "matches")


def candidates(t):
    """Catalogue companies: customers named like suppliers, some with a suffix or a place."""
    k, seg = F.substring("c_name", 10, 99), C("c_mktsegment")
    name = (F.when(seg == "AUTOMOBILE", F.concat(F.lit("Supplier#"), k)).when(seg == "BUILDING", F.concat(F.lit("supplier#"), k, F.lit(" Games")))
            .when(seg == "FURNITURE", F.concat(F.lit("Supplier#"), k, F.lit(" North"))).otherwise(F.concat(F.lit("Other "), k)))
    return t.read("customer").select(C("c_custkey").alias("cand_id"), name.alias("cand_name"), C("c_nationkey").alias("cand_country"),
                                     F.when(C("c_acctbal") > 0, 3).otherwise(0).alias("games"), F.when(C("c_acctbal") > 5000, F.lit("logo")).alias("logo"),
                                     F.when(C("c_acctbal") > 8000, 1).alias("start_date"))


def wanted(t):
    return t.read("supplier").select(C("s_suppkey").alias("company_key"), C("s_name").alias("name"), C("s_nationkey").alias("country"),
                                     F.when(C("s_acctbal") > 8000, names.alnum_key(F.concat("s_name", F.lit("gamescareers")))).alias("slug_key"))


@query("jon19_company_match", """WITH c AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'supplier#' || substr(c_name, 10) WHEN 'BUILDING' THEN 'supplier#' || substr(c_name, 10) || ' games' WHEN 'FURNITURE' THEN 'supplier#' || substr(c_name, 10) || ' north' ELSE 'other ' || substr(c_name, 10) END AS k,
      c_nationkey AS cc, CASE WHEN c_acctbal > 0 THEN 3 ELSE 0 END AS g, c_acctbal FROM customer),
  p AS (SELECT s_suppkey, id, k, lower(s_name) AS want, g, cc = s_nationkey AS agrees, CASE WHEN s_acctbal > 8000 THEN replace(lower(s_name), '#', '') || 'gamescareers' END AS slug,
      CASE WHEN k = lower(s_name) THEN 100 WHEN k = lower(s_name) || ' games' THEN 55 ELSE 5 END + CASE WHEN g > 0 THEN least(30, 8 + g * 3) ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 12 ELSE 0 END + CASE WHEN c_acctbal > 8000 THEN 4 ELSE 0 END
      + CASE WHEN cc = s_nationkey THEN 50 ELSE -12 END AS score, k IN (lower(s_name), lower(s_name) || ' games') OR (cc = s_nationkey AND g > 0) AS sound FROM supplier JOIN c ON k = lower(s_name) OR starts_with(k, lower(s_name) || ' ')),
  r AS (SELECT s_suppkey, (SELECT arg_min(id, -length(regexp_replace(k, '[^a-z0-9]', '', 'g'))) FROM p x WHERE x.s_suppkey = p.s_suppkey AND contains(slug, regexp_replace(k, '[^a-z0-9]', '', 'g')) AND g > 0) AS slug_id,
      arg_min(CASE WHEN sound THEN id END, CAST(-score AS BIGINT) * 100000 + id) AS top_raw, min(CAST(-score AS BIGINT) * 100000 + id) AS m FROM p GROUP BY s_suppkey),
  t AS (SELECT r.*, (SELECT CASE WHEN sound THEN id END FROM p WHERE p.s_suppkey = r.s_suppkey ORDER BY score DESC, id LIMIT 1) AS top_id,
      (SELECT arg_min(id, id) FROM p WHERE p.s_suppkey = r.s_suppkey AND agrees AND g > 0 AND starts_with(k, want || ' ')) AS brand_id FROM r)
  SELECT s_suppkey AS company_key, CASE WHEN slug_id IS NOT NULL THEN 'slug' WHEN top_id IS NOT NULL THEN 'score' ELSE 'brand' END AS via, coalesce(slug_id, top_id, brand_id) AS cand_id FROM t WHERE coalesce(slug_id, top_id, brand_id) IS NOT NULL""")
def jon19(t):
    return companies.match_companies(wanted(t), candidates(t)).select("company_key", "via", "cand_id")


@query("jon20_provider_routing", """SELECT seq, CASE WHEN provider = 'nope' THEN NULL WHEN provider IS NOT NULL THEN provider WHEN parser IS NOT NULL THEN 'local-parser' WHEN contains(link, 'lever') THEN 'lever' WHEN contains(link, 'teamtailor') THEN 'teamtailor' END AS provider,
    CASE WHEN provider = 'nope' THEN 'unknown provider: nope' END AS error FROM (SELECT *, CASE WHEN seq < 40 THEN 'https://jobs.lever.co/x' WHEN country = 'NATION_7' THEN 'https://www.x.teamtailor.com/jobs' ELSE careers_url END AS link FROM company)""")
def jon20(t):
    link = F.when(C("seq") < 40, F.lit("https://jobs.lever.co/x")).when(C("country") == "NATION_7", F.lit("https://www.x.teamtailor.com/jobs")).otherwise(C("careers_url"))
    return t.company.select("seq", companies.route_provider(C("provider"), C("parser"), link, ["greenhouse", "lever"]).alias("r")).select("seq", "r.*")


@query("jon21_batch_state", f"WITH {BATCH_SQL} SELECT bi.id, coalesce(status, 'none') AS status, coalesce(retries, 0) AS retries FROM bi LEFT JOIN st USING (id)")
def jon21(t):
    return predicates.batch_with_state(batch(t), batch_state(t)).select("id", "status", "retries")


# previous health: failures before 15 January; this run: the outcomes of that day
_HEALTH_SQL = """prev AS (SELECT company, count(*) AS fails, CAST(min(run) AS VARCHAR) AS since, max(error) AS lastError, max(kind) AS kind FROM outcome WHERE run < DATE '2024-01-15' AND NOT ok GROUP BY company),
  tracked AS (SELECT DISTINCT company FROM outcome WHERE event_id >= 0 AND source = 'purchase' AND run > DATE '2024-01-20'),
  now AS (SELECT company, bool_and(ok) AS ok, max(error) AS error, max(kind) AS kind FROM outcome WHERE run = DATE '2024-01-15' GROUP BY company)"""


@query("jon22_health_fold", f"""WITH {_HEALTH_SQL} SELECT coalesce(p.company, n.company) AS company, CASE WHEN n.company IS NOT NULL THEN coalesce(fails, 0) + 1 ELSE fails END AS fails, coalesce(since, '2024-01-15') AS since,
    left(CASE WHEN n.company IS NOT NULL THEN error ELSE lastError END, 300) AS "lastError", CASE WHEN n.company IS NOT NULL THEN error ELSE lastError END AS error, CASE WHEN n.company IS NOT NULL THEN n.kind ELSE p.kind END AS kind, CASE WHEN n.company IS NOT NULL THEN coalesce(fails, 0) + 1 ELSE fails END >= 8 AS alert
  FROM prev p FULL JOIN now n ON p.company = n.company WHERE NOT coalesce(n.ok, FALSE) AND (n.company IS NOT NULL OR p.company IN (SELECT company FROM tracked))""")
def jon22(t):
    o = t.outcome
    prev = o.filter("run < DATE '2024-01-15' and not ok").groupBy("company").agg(
        F.count("*").alias("fails"), F.min("run").cast("string").alias("since"), F.max("error").alias("lastError"), F.max("kind").alias("kind"))
    now = o.filter("run = DATE '2024-01-15'").groupBy("company").agg(F.bool_and("ok").alias("ok"), F.max("error").alias("error"), F.max("kind").alias("kind"))
    tracked = o.filter("source = 'purchase' and run > DATE '2024-01-20'").select("company").distinct()
    return health.fold_health(prev, now, F.to_date(F.lit("2024-01-15")), 8, tracked)


@query("jon23_reposts", f"""WITH p AS (SELECT company, {FOLD.format('title')} AS role_key, url, CAST(postedDate AS DATE) AS day FROM posting),
  d AS (SELECT company, role_key, url, day, count(*) AS n FROM p GROUP BY ALL)
  SELECT d.company, d.role_key, d.url, d.day, d.n, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS reposts FROM d LEFT JOIN d o ON o.company = d.company AND o.role_key = d.role_key AND o.url <> d.url AND o.day < d.day AND o.day >= d.day - 90 GROUP BY ALL""")
def jon23(t):
    return snapshot.repost_counts(t.posting)


@query("jon24_remove_expired", f"SELECT {KEYS} FROM posting WHERE url NOT IN (SELECT url FROM posting WHERE postedDate < DATE '1996-01-01' AND filtered)")
def jon24(t):
    expired = t.posting.filter("postedDate < DATE '1996-01-01' and filtered").select("url").distinct()
    return t.posting.join(expired, "url", "left_anti").select(*KEY)


@query("jon25_status_update", "SELECT num, CASE WHEN o_orderstatus = 'O' AND c_acctbal < 0 THEN 'Rejected' ELSE status END AS status FROM application JOIN orders ON num = o_orderkey JOIN customer ON o_custkey = c_custkey")
def jon25(t):
    changes = t._orders().filter("o_orderstatus = 'O' and c_acctbal < 0").select(C("o_orderkey").alias("report_number"), F.lit("Rejected").alias("new_status"))
    return tracker.apply_status_updates(t.application, changes).select("num", "status")


@query("jon26_flagged_pool", "SELECT seq, name FROM company WHERE country IN (SELECT n_name FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name HAVING avg(c_acctbal) > 4500)")
def jon26(t):
    flagged = (t.read("customer").join(t.read("nation"), C("c_nationkey") == C("n_nationkey")).groupBy(C("n_name").alias("country"))
               .agg(F.avg("c_acctbal").alias("a")).filter("a > 4500"))
    return t.company.join(flagged, "country", "left_semi").select("seq", "name")


# --- de-duplication -----------------------------------------------------------------------------

@query("dup01_same_url", "SELECT url, arg_min(title, seq) AS title, arg_min(company, seq) AS company, bool_and(filtered) AS filtered FROM posting GROUP BY url")
def dup01(t):
    return snapshot.merge_same_url(t.posting).select("url", "title", "company", "filtered")


LINK_SQL = r"""lk AS (SELECT *, regexp_extract(coalesce("applyUrl", url), '^https?://(?:www\.)?([^/?]+)', 1) || regexp_replace(regexp_extract(coalesce("applyUrl", url), '^https?://[^/?]+(/[^?]*)?', 1), '/+$', '')
    || CASE WHEN contains(coalesce("applyUrl", url), 'gh_jid') THEN '?' || regexp_extract(coalesce("applyUrl", url), '(gh_jid=[0-9]+)', 1) ELSE '' END AS link, contains(url, 'gamejobs.co') OR contains(url, 'gamedevjobs.com') AS agg FROM posting),
  w AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY agg, seq) AS rn FROM lk)"""


@query("dup02_apply_links", f"WITH {LINK_SQL} SELECT {KEYS}, url FROM w WHERE rn = 1")
def dup02(t):
    return snapshot.collapse_links(t.posting).select(*KEY, "url")


# regions stand for countries: each employer has one nation, so links are widened to the part alone
REGION_CODES = {"africa": "AF", "america": "US", "asia": "AS", "europe": "EU"}


@query("dup03_country_union", r"""WITH p AS (SELECT *, 'https://one.example.com/jobs/' || l_partkey AS u, coalesce(CASE WHEN contains(location, 'AFRICA') THEN 'AF' WHEN contains(location, 'AMERICA') THEN 'US' WHEN contains(location, 'ASIA') THEN 'AS' WHEN contains(location, 'EUROPE') THEN 'EU' END) AS code FROM posting),
  f AS (SELECT u, min(seq) AS first FROM p GROUP BY u), s AS (SELECT p.u, p.code, p.location, p.seq FROM p JOIN f ON p.u = f.u AND p.seq = f.first),
  x AS (SELECT p.u, p.code, min(p.seq) AS first_at FROM p JOIN s ON s.u = p.u WHERE p.code IS NOT NULL AND s.code IS NOT NULL AND p.code <> s.code GROUP BY p.u, p.code),
  l AS (SELECT u, string_agg(CASE code WHEN 'AF' THEN 'Africa' WHEN 'US' THEN 'United States' WHEN 'AS' THEN 'Asia' ELSE 'Europe' END, ' / ' ORDER BY first_at) AS names FROM x GROUP BY u)
  SELECT s.u AS url, s.location || coalesce(' / ' || l.names, '') AS location FROM s LEFT JOIN l USING (u)""")
def dup03(t):
    rows = t.posting.withColumns({"url": F.concat(F.lit("https://one.example.com/jobs/"), C("landing.l_partkey").cast("string")), "applyUrl": F.lit(None).cast("string")})
    return snapshot.collapse_links(rows, codes=REGION_CODES).select("url", "location")


ID_SQL = r"""i AS (SELECT *, CASE WHEN contains(url, 'gamejobs.co') OR contains(url, 'gamedevjobs.com') THEN NULL WHEN contains(url, 'gh_jid') THEN regexp_extract(url, 'gh_jid=([0-9]+)', 1) ELSE regexp_extract(url, '/([0-9]{5,})$', 1) END AS pid FROM posting),
  k AS (SELECT *, row_number() OVER (PARTITION BY company, pid ORDER BY seq) AS rn FROM i)"""


@query("dup04_posting_ids", f"WITH {ID_SQL} SELECT {KEYS}, url FROM k WHERE pid IS NULL OR rn = 1")
def dup04(t):
    return snapshot.collapse_ids(t.posting).select(*KEY, "url")


@query("dup05_mirror_counts", _with_flag(f"WITH {_MIRROR_SQL} SELECT CAST(tier AS BIGINT) AS mirror_tier, count(*) AS n FROM m GROUP BY tier"))
def dup05(t):
    return snapshot.mark_mirrors(t.posting).groupBy("mirror_tier").agg(F.count("*").alias("n"))


_SNAPSHOT_SQL = f"""WITH {LINK_SQL}, i AS (SELECT *, CASE WHEN agg THEN NULL WHEN contains(url, 'gh_jid') THEN regexp_extract(url, 'gh_jid=([0-9]+)', 1) ELSE regexp_extract(url, '/([0-9]{{5,}})$', 1) END AS pid FROM w WHERE rn = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY company, pid ORDER BY seq) AS rk FROM i), s1 AS (SELECT * EXCLUDE (link, agg, rn, pid, rk) FROM k WHERE pid IS NULL OR rk = 1),
  {_with_flag(_MIRROR_SQL).replace('FROM posting)', 'FROM s1)', 1)}"""


@query("dup06_snapshot_dedup", f"{_SNAPSHOT_SQL} SELECT {KEYS}, url, company, title FROM m WHERE tier IS NULL")
def dup06(t):
    return snapshot.dedupe_snapshot(t.posting).select(*KEY, "url", "company", "title")


@query("dup06_snapshot_counts", f"{_SNAPSHOT_SQL} SELECT CAST((SELECT count(*) FROM posting) - (SELECT count(*) FROM i) AS BIGINT) AS by_link, CAST((SELECT count(*) FROM i) - (SELECT count(*) FROM s1) AS BIGINT) AS by_id, count(*) FILTER (tier IS NOT NULL) AS by_title, count(*) FILTER (tier IS NULL) AS kept FROM m")
def dup06b(t):
    return snapshot.dedupe_counts(t.posting)


@query("dup07_office_merge", f"""WITH p AS (SELECT lower(trim(company)) AS co, {FOLD.format('title')} AS tk, *, CASE WHEN l_suppkey > 0 THEN split_part(location, ',', 2) || CASE WHEN l_quantity > 25 THEN '' ELSE ' East' END END AS loc FROM posting),
  h AS (SELECT co, tk, arg_min(title, seq) AS title, arg_min(loc, seq) AS loc1, count(*) AS n, max(postedDate) AS postedDate FROM p GROUP BY co, tk),
  o AS (SELECT co, tk, lower(trim(loc)) AS low, arg_min(trim(loc), seq) AS office, min(seq) AS first_at FROM p WHERE trim(loc) <> '' GROUP BY 1, 2, 3),
  l AS (SELECT co, tk, string_agg(office, ' / ' ORDER BY first_at) AS locs FROM o GROUP BY co, tk)
  SELECT co AS company_key, h.title, h.postedDate AS "postedDate", CASE WHEN n = 1 THEN loc1 ELSE coalesce(locs, '') END AS location FROM h LEFT JOIN l USING (co, tk)""")
def dup07(t):
    part = F.coalesce(F.get(F.split("location", ","), F.lit(1)), F.lit(""))
    loc = F.concat(part, F.when(C("landing.l_quantity") > 25, F.lit("")).otherwise(F.lit(" East")))
    rows = t.posting.withColumn("location", F.when(C("landing.l_suppkey") > 0, loc))
    return snapshot.merge_offices(rows).select(F.lower("company").alias("company_key"), "title", "postedDate", "location")


@query("dup08_tracker_clusters")
def dup08(t):
    return tracker.dedupe_applications(t.application).select("num", "company", "role", "score", "status", "members")


@query("dup09_exact_repeats", """SELECT regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS company_key, regexp_replace(lower(role), '[^a-z0-9 ]', '', 'g') AS role_key, count(*) AS n, min(num) AS first_num, max(num) AS last_num FROM application GROUP BY 1, 2 HAVING count(*) > 1""")
def dup09(t):
    return tracker.exact_repeats(t.application)


@query("dup10_hit_store", """WITH s AS (SELECT lower(trim(c_name)) || '|' || 'https://x.example.com/' || c_nationkey AS key, c_name AS name, 'https://x.example.com/' || c_nationkey AS page, 'old' AS provider, '2024-01-01' AS f, '2024-01-02' AS l FROM customer WHERE c_acctbal > 3000),
  n AS (SELECT lower(trim(c_name)) || '|' || 'https://x.example.com/' || c_nationkey AS key, upper(c_name) AS name, 'https://x.example.com/' || c_nationkey AS page, c_mktsegment AS provider, '2024-02-01' AS f FROM customer WHERE c_acctbal < 6000 AND c_mktsegment <> 'BUILDING')
  SELECT coalesce(n.key, s.key) AS key, coalesce(n.name, s.name) AS name, coalesce(n.page, s.page) AS careers_url, coalesce(n.provider, s.provider) AS provider, least(coalesce(s.f, n.f), coalesce(n.f, s.f)) AS first_seen, CASE WHEN n.key IS NOT NULL THEN n.f ELSE s.l END AS last_seen FROM s FULL JOIN n ON s.key = n.key""")
def dup10(t):
    page = F.concat(F.lit("https://x.example.com/"), C("c_nationkey").cast("string")).alias("careers_url")
    cu = t.read("customer")
    store = cu.filter("c_acctbal > 3000").select(C("c_name").alias("name"), page, F.lit("old").alias("provider"), F.lit("2024-01-01").alias("first_seen"), F.lit("2024-01-02").alias("last_seen"))
    hits = cu.filter("c_acctbal < 6000").select(F.upper("c_name").alias("name"), page, F.when(C("c_mktsegment") != "BUILDING", C("c_mktsegment")).alias("provider"))
    return companies.merge_hit_store(store, hits, F.lit("2024-02-01"))


def titles(t):
    """Catalogue titles: parts shipped by a supplier; popularity from quantities."""
    return t.read("lineitem").join(t.read("part"), C("l_partkey") == C("p_partkey")).select(
        C("l_suppkey").alias("company_id"), F.when(C("p_size") > 25, F.upper("p_name")).otherwise(C("p_name")).alias("name"), C("l_quantity").alias("pop"), C("l_extendedprice").alias("rating"),
        F.year("l_shipdate").alias("year"), F.when(C("l_returnflag") == "N", "developer").otherwise("publisher").alias("role"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("seq"))


_SHELF_SQL = """tl AS (SELECT l_suppkey AS company_id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name, l_quantity AS pop, l_extendedprice AS rating, CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag = 'N' AS dev,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey),
  sh AS (SELECT company_id, lower(name) AS title_key, arg_min(name, seq) AS name, max(pop) AS pop, max(rating) AS rating, max(year) AS year, CASE WHEN bool_or(dev) THEN 'developer' ELSE 'publisher' END AS role FROM tl GROUP BY 1, 2)"""


@query("dup11_shelf_merge", f"WITH {_SHELF_SQL} SELECT * FROM sh")
def dup11(t):
    return companies.merge_shelf(titles(t))


@query("win08_top_titles", f"WITH {_SHELF_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY pop DESC, rating DESC, year DESC, title_key) AS place FROM sh) SELECT company_id, title_key, place FROM r WHERE place <= 10")
def win08(t):
    return companies.top_shelf(companies.merge_shelf(titles(t)), 10).select("company_id", "title_key", "place")


@query("dup12_import_first_wins", """WITH l AS (SELECT c_custkey, 'Supplier ' || c_nationkey || CASE WHEN c_acctbal < 0 THEN ' Games' ELSE ' Productions AB' END AS name FROM customer),
  k AS (SELECT *, 'supplier' || regexp_extract(name, '([0-9]+)', 1) AS key FROM l) SELECT key AS name_key, arg_min(name, c_custkey) AS name, min(c_custkey) AS seq FROM k WHERE key NOT IN (SELECT 'supplier' || s_nationkey FROM supplier WHERE s_acctbal < -500) GROUP BY key""")
def dup12(t):
    leads = t.read("customer").select(C("c_custkey").alias("seq"), F.concat(F.lit("Supplier "), C("c_nationkey").cast("string"), F.when(C("c_acctbal") < 0, F.lit(" Games")).otherwise(F.lit(" Productions AB"))).alias("name"))
    tracked = t.read("supplier").filter("s_acctbal < -500").select(F.concat(F.lit("The Supplier "), C("s_nationkey").cast("string")).alias("name"))
    return companies.import_new(leads, tracked, names.import_key).select("name_key", "name", "seq")


# --- windows ------------------------------------------------------------------------------------

@query("win01_first_per_key", f"SELECT company, {FOLD.format('title')} AS role_key, arg_min(url, seq) AS url FROM posting GROUP BY 1, 2")
def win01(t):
    rows = t.posting.select("company", fold(C("title")).alias("role_key"), "url", "seq")
    return snapshot.first_per_key(rows, ["company", "role_key"], C("seq")).select("company", "role_key", "url")


@query("win02_best_in_group", "SELECT company, arg_min(num, -CAST(replace(score, '/5', '') AS DOUBLE) * 1000000000 + pos) AS num, max(CAST(replace(score, '/5', '') AS DOUBLE)) AS points FROM application GROUP BY company")
def win02(t):
    points = first_number(C("score"))
    return t.application.groupBy("company").agg(F.min_by("num", F.struct((-points).alias("a"), "pos")).alias("num"), F.max(points).alias("points"))


@query("win03_latest_follow_up", "SELECT appNum, max(date) AS last_follow_up FROM follow_up GROUP BY appNum")
def win03(t):
    return t.follow_up.groupBy("appNum").agg(F.max("date").alias("last_follow_up"))


@query("win04_entry_numbers", f"""WITH {MERGE_SQL}, nw AS (SELECT file_seq, 2 * num AS num, row_number() OVER (ORDER BY file_seq) AS i FROM mt WHERE mpos IS NULL)
  SELECT file_seq, CAST(i + greatest((SELECT max(num) FROM existing), max(num - i) OVER (ORDER BY i)) AS BIGINT) AS num FROM nw""")
def win04(t):
    new = tracker.match_additions(t.addition, t.existing).filter("match is null").select("file_seq", (2 * C("num")).alias("num"))
    # doubled, about half of the wanted numbers lie above the highest in use, so that wanted and running ones both occur
    highest = t.existing.agg(F.max("num").alias("m0"))
    return tracker.assign_numbers(new, highest)


@query("win05_first_better", f"""WITH {MERGE_SQL}, b AS (SELECT mt.file_seq, mt.mpos, mt.score, CAST(replace(mt.score, '/5', '') AS DOUBLE) AS ns, CAST(replace(e.score, '/5', '') AS DOUBLE) AS os FROM mt JOIN e ON e.pos = mt.mpos)
  SELECT mpos AS pos, arg_min(score, file_seq) AS score FROM b WHERE ns > os GROUP BY mpos""")
def win05(t):
    return tracker.updates(tracker.match_additions(t.addition, t.existing)).select("pos", "score")


@query("plan_tracker_merge", f"""WITH {MERGE_SQL}, b AS (SELECT mt.file_seq, mt.mpos, CAST(replace(mt.score, '/5', '') AS DOUBLE) AS ns, CAST(replace(e.score, '/5', '') AS DOUBLE) AS os FROM mt JOIN e ON e.pos = mt.mpos)
  SELECT 'updated' AS action, count(DISTINCT mpos) AS n FROM b WHERE ns > os UNION ALL SELECT 'added', count(*) FROM mt WHERE mpos IS NULL
  UNION ALL SELECT 'kept', (SELECT count(*) FROM existing) - (SELECT count(DISTINCT mpos) FROM b WHERE ns > os)""")
def plan_merge(t):
    return tracker.merge_tracker(t.existing, t.addition).groupBy("action").agg(F.count("*").alias("n"))


STREAK_SQL = """rn AS (SELECT company, run, bool_and(ok) AS ok FROM outcome GROUP BY company, run), il AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY company ORDER BY run) AS island FROM rn),
  sk AS (SELECT company, min(run) AS since, max(run) AS until, count(*) AS fails FROM il WHERE NOT ok GROUP BY company, island)"""


@query("win06_failure_streaks", f"WITH {STREAK_SQL} SELECT * FROM sk")
def win06(t):
    return health.failure_streaks(t.outcome)


@query("win06_current_streaks", f"WITH {STREAK_SQL} SELECT sk.* FROM sk JOIN (SELECT company, max(run) AS until FROM rn GROUP BY company) USING (company, until)")
def win06b(t):
    return health.current_streaks(t.outcome)


@query("win07_most_specific_slug", """WITH p AS (SELECT s_suppkey, c_custkey, substr(c_name, 10) || CASE WHEN c_acctbal > 5000 THEN 'x' ELSE '' END AS nm, CAST(floor(abs(c_acctbal)) AS BIGINT) AS games FROM supplier JOIN customer ON s_nationkey = c_nationkey)
  SELECT s_suppkey, arg_min(c_custkey, [-length(nm), -games, c_custkey]) AS cand_id FROM p GROUP BY s_suppkey""")
def win07(t):
    nm = F.concat(F.substring("c_name", 10, 99), F.when(C("c_acctbal") > 5000, F.lit("x")).otherwise(F.lit("")))
    games = F.floor(F.abs("c_acctbal"))
    order = F.struct((-F.length(nm)).alias("a"), (-games).alias("b"), C("c_custkey"))
    best = t.read("customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", order).alias("cand_id"))
    return t.read("supplier").join(best, C("s_nationkey") == C("c_nationkey")).select("s_suppkey", "cand_id")


# --- sets ---------------------------------------------------------------------------------------

@query("set01_seen_union", f"WITH {HISTORY_SQL} SELECT url FROM hist WHERE status <> 'skipped_expired' UNION SELECT DISTINCT url FROM posting WHERE filtered UNION SELECT 'https://careers.example.com/' || s_suppkey || '/jobs' FROM supplier WHERE s_acctbal <= 6000")
def set01(t):
    return snapshot.seen_urls(history(t), t.posting.filter("filtered"),
                              t.read("supplier").filter("s_acctbal <= 6000").select(F.concat(F.lit("https://careers.example.com/"), C("s_suppkey").cast("string"), F.lit("/jobs")).alias("url")))


@query("set02_source_union", "SELECT source, count(*) AS n, count(title) AS titled, count(company) AS named FROM (SELECT 'lines' AS source, title, company FROM posting UNION ALL SELECT 'pages', 'page', NULL FROM pages UNION ALL SELECT 'docs', NULL, lang FROM documents) GROUP BY source")
def set02(t):
    frames = [t.posting.select("title", "company", F.lit("lines").alias("source")), t.pages.select(F.lit("page").alias("title"), F.lit("pages").alias("source")),
              t.documents.select(C("lang").alias("company"), F.lit("docs").alias("source"))]
    return snapshot.union_postings(frames).groupBy("source").agg(F.count("*").alias("n"), F.count("title").alias("titled"), F.count("company").alias("named"))


PROVIDERS = ["ashby", "breezy", "greenhouse", "lever"]


def ledger(t):
    """Coverage ledger: a hit, misses, rejections and a version per customer."""
    seg, bal = C("c_mktsegment"), C("c_acctbal")
    missed = F.array_compact(F.array(F.when(bal < 5000, F.lit("ashby")), F.when(bal > 2000, F.lit("lever")), F.when(seg == "BUILDING", F.lit("breezy"))))
    return t.read("customer").select(
        C("c_custkey").alias("key"), C("c_name").alias("name"), F.when(seg == "HOUSEHOLD", 1).otherwise(2).alias("version"),
        F.when(bal > 7000, F.lit("greenhouse")).otherwise(F.lit("")).alias("hit"), F.when(bal > 8500, F.lit("high")).when(bal > 7000, F.lit("verify")).otherwise(F.lit("")).alias("hit_conf"),
        missed.alias("missed"), F.when(seg == "MACHINERY", F.array(F.lit("greenhouse"))).otherwise(F.array().cast("array<string>")).alias("rejected"), F.lit("2024-01-01").alias("last"))


LEDGER_SQL = """lg AS (SELECT c_custkey AS key, c_name AS name, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 2 END AS version, CASE WHEN c_acctbal > 7000 THEN 'greenhouse' ELSE '' END AS hit,
    CASE WHEN c_acctbal > 8500 THEN 'high' WHEN c_acctbal > 7000 THEN 'verify' ELSE '' END AS hit_conf, c_acctbal < 5000 AS m_ashby, c_acctbal > 2000 AS m_lever, c_mktsegment = 'BUILDING' AS m_breezy, c_mktsegment = 'MACHINERY' AS rejected FROM customer)"""


@query("set03_open_providers", f"""WITH {LEDGER_SQL} SELECT key, CASE WHEN version < 2 THEN concat_ws(',', 'ashby', 'breezy', CASE WHEN NOT rejected THEN 'greenhouse' END, 'lever') WHEN hit <> '' AND hit_conf IN ('high', 'medium') THEN ''
    ELSE concat_ws(',', CASE WHEN NOT m_ashby THEN 'ashby' END, CASE WHEN NOT m_breezy THEN 'breezy' END, CASE WHEN NOT rejected THEN 'greenhouse' END, CASE WHEN NOT m_lever THEN 'lever' END) END AS open FROM lg""")
def set03(t):
    all_ids = F.array(*[F.lit(p) for p in PROVIDERS])
    return ledger(t).select("key", F.array_join(companies.ledger_open(C("hit"), C("hit_conf"), C("missed"), C("rejected"), C("version"), 2, all_ids), ",").alias("open"))


def ledger_results(t):
    """One probe result per order customer in debt or rich: a fresh hit or a further miss."""
    return t.read("customer").filter("c_acctbal < 0 or c_acctbal > 6000").select(
        C("c_custkey").alias("key"), F.upper("c_name").alias("name"), F.when(C("c_acctbal") < 0, F.lit("lever")).alias("hit"),
        F.when(C("c_acctbal") < 0, F.lit("medium")).alias("hit_conf"), F.when(C("c_acctbal") > 6000, F.array(F.lit("breezy"))).alias("missed"))


@query("set04_ledger_merge", f"""WITH {LEDGER_SQL}, r AS (SELECT c_custkey AS key, c_acctbal < 0 AS fresh FROM customer WHERE c_acctbal < 0 OR c_acctbal > 6000)
  SELECT lg.key, CASE WHEN r.key IS NOT NULL THEN upper(name) ELSE name END AS name, CAST(CASE WHEN r.key IS NOT NULL THEN 2 ELSE version END AS BIGINT) AS version, CASE WHEN fresh THEN 'lever' ELSE hit END AS hit, CASE WHEN fresh THEN 'medium' ELSE hit_conf END AS hit_conf,
    CASE WHEN r.key IS NULL THEN concat_ws(',', CASE WHEN m_ashby THEN 'ashby' END, CASE WHEN m_lever THEN 'lever' END, CASE WHEN m_breezy THEN 'breezy' END) WHEN version < 2 THEN CASE WHEN NOT fresh THEN 'breezy' ELSE '' END
      ELSE concat_ws(',', CASE WHEN m_ashby THEN 'ashby' END, CASE WHEN m_breezy OR NOT fresh THEN 'breezy' END, CASE WHEN m_lever THEN 'lever' END) END AS missed,
    CASE WHEN r.key IS NOT NULL THEN '2024-03-01' ELSE '2024-01-01' END AS last FROM lg LEFT JOIN r ON lg.key = r.key""")
def set04(t):
    merged = companies.merge_ledger(ledger(t), ledger_results(t), 2, F.lit("2024-03-01"))
    return merged.select("key", "name", "version", "hit", "hit_conf", F.array_join("missed", ",").alias("missed"), "last")


@query("set05_reject_hits", f"""WITH {LEDGER_SQL}, r AS (SELECT c_custkey AS key, CASE WHEN c_nationkey > 12 THEN 'greenhouse' ELSE 'lever' END AS p FROM customer WHERE c_acctbal > 8000)
  SELECT lg.key, CASE WHEN r.p = hit THEN '' ELSE hit END AS hit, CASE WHEN r.p = hit THEN '' ELSE hit_conf END AS hit_conf,
    concat_ws(',', CASE WHEN rejected THEN 'greenhouse' END, CASE WHEN r.p IS NOT NULL AND NOT (rejected AND r.p = 'greenhouse') THEN r.p END) AS rejected, CAST(CASE WHEN r.key IS NOT NULL THEN 2 ELSE version END AS BIGINT) AS version FROM lg LEFT JOIN r ON lg.key = r.key""")
def set05(t):
    rejections = t.read("customer").filter("c_acctbal > 8000").select(C("c_custkey").alias("key"), C("c_name").alias("name"), F.when(C("c_nationkey") > 12, F.lit("greenhouse")).otherwise(F.lit("lever")).alias("provider"))
    out = companies.reject_hits(ledger(t), rejections, 2, F.lit("2024-03-01"))
    return out.select("key", "hit", "hit_conf", F.array_join("rejected", ",").alias("rejected"), "version")


@query("set06_remaining", "SELECT s_suppkey AS key FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND s_suppkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 2000)")
def set06(t):
    return companies.remaining(t.read("supplier").select(C("s_suppkey").alias("key")), t.read("customer").filter("c_acctbal > 5000").select(C("c_custkey").alias("key")),
                               t.read("orders").filter("o_totalprice < 2000").select(C("o_custkey").alias("key")))


@query("set07_candidate_union", "SELECT c_custkey AS cand_id, CASE WHEN c_acctbal < 5000 THEN 'wide ' || c_name ELSE c_name END AS name FROM customer WHERE c_acctbal > 1000 OR c_acctbal < 5000")
def set07(t):
    cu = t.read("customer")
    exact = cu.filter("c_acctbal > 1000").select(C("c_custkey").alias("cand_id"), C("c_name").alias("name"))
    wide = cu.filter("c_acctbal < 5000").select(C("c_custkey").alias("cand_id"), F.concat(F.lit("wide "), "c_name").alias("name"))
    return companies.merge_candidates(exact, wide)
