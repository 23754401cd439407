"""Targeting and scoring queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import match_span
from ..operators import snapshot, targeting
from .filters import GROUP_SQL, GROUPS, KEY, KEYS
from .registry import query

C = F.col


def scored(t):
    return targeting.score_groups(t.posting.withColumn("skills", F.lit(None).cast("array<string>")), GROUPS)


@query("tgt01_compile_key", r"""SELECT DISTINCT p_name, p_type, regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9])ring') AS stem, regexp_matches(p_name, '(?i)\b(old|new)\s+r(od|ing)') AS pattern,
    regexp_matches(p_name || ', ' || p_type, '(?i), sm') AS punctuation FROM part""")
def tgt01(t):
    from ..functions.patterns import keys_hit
    return t.read("part").select("p_name", "p_type", keys_hit(C("p_name"), ["ring"]).alias("stem"),
                                 keys_hit(C("p_name"), ["/(old|new) r(od|ing)/"]).alias("pattern"),
                                 keys_hit(F.concat("p_name", F.lit(", "), "p_type"), [", sm", "", "/(/"]).alias("punctuation")).distinct()


@query("tgt02_match_span", r"""SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the') THEN
    length(regexp_extract(text, '(?is)^(.*?(?:^|[^A-Za-z0-9]))the', 1)) END AS BIGINT) AS start_at,
    CAST(CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the') THEN length(regexp_extract(text, '(?is)^(.*?(?:^|[^A-Za-z0-9]))the', 1)) + 3 END AS BIGINT) AS end_at FROM documents""")
def tgt02(t):
    span = match_span(C("text"), "the")
    return t.documents.select("doc_id", span["start"].alias("start_at"), span["end"].alias("end_at"))


CATEGORY = {"widget": 0.9, "old": 0.2, "old wid": 0.6, "r": 0.7, "ring": 1.2, "/(hot|cold) r(od|ing)/": 1.5, "default": 0.4}
# longest match first; a claimed span suppresses what it overlaps. Titles are 'adjective noun'.
_CATEGORY_SQL = r"""SELECT p_name, CASE WHEN regexp_matches(p_name, '^(hot|cold) r(od|ing)') THEN [1.5]
    WHEN p_name = 'old widget' THEN [0.6] WHEN p_name LIKE 'old r%' THEN CASE WHEN p_name = 'old ring' THEN [0.2, 1.2] ELSE [0.2, 0.7] END
    WHEN p_name LIKE 'old %' THEN [0.2] WHEN p_name LIKE '% widget' THEN CASE WHEN p_name LIKE 'red%' THEN [0.7, 0.9] ELSE [0.9] END
    WHEN p_name LIKE '% ring' THEN CASE WHEN p_name LIKE 'red%' THEN [0.7, 1.2] ELSE [1.2] END
    WHEN p_name LIKE 'red %' OR p_name LIKE '% rod' THEN [0.7] ELSE [0.4] END AS w FROM part"""


@query("tgt03_category_score", f"""WITH k AS (SELECT DISTINCT * FROM ({_CATEGORY_SQL})) SELECT p_name, CAST(list_max(w) AS DOUBLE) AS high, CAST(list_min(w) AS DOUBLE) AS low,
    round(CAST(list_avg(w) AS DOUBLE), 6) AS mean, round(CAST(list_product(w) AS DOUBLE), 6) AS product FROM k""")
def tgt03(t):
    # 'r' is found at its first place only, so 'red ring' holds the span of 'r' in 'red' and all of 'ring'
    modes = {"high": "max", "low": "min", "mean": "average", "product": "multiply"}
    rows = targeting.category_scores(t.read("part").select("p_name").distinct(), {n: ("p_name", CATEGORY, m) for n, m in modes.items()})
    return rows.select("p_name", "high", "low", F.round("mean", 6).alias("mean"), F.round("product", 6).alias("product"))


@query("tgt04_field_text", f"""SELECT {KEYS}, location || ' ' || coalesce(workMode, '') AS combined, title || ' ' || company || ' ' || location || ' ' || department || ' ' || experienceLevel AS everything,
    coalesce(CASE WHEN l_quantity > 30 THEN '' WHEN l_quantity > 10 THEN 'skill ' || department END, '') AS skills_text, l_quantity > 10 AS known FROM posting""")
def tgt04(t):
    q = C("landing.l_quantity")
    rows = t.posting.withColumn("skills", F.when(q > 30, F.array().cast("array<string>")).when(q > 10, F.array(F.lit("skill"), "department")))
    return rows.select(*KEY, targeting.field_text(["location", "workmode"]).alias("combined"), targeting.field_text("any").alias("everything"),
                       targeting.field_text("skills").alias("skills_text"), targeting.field_known("skills").alias("known"))


@query("tgt05_group_match", f"""WITH {GROUP_SQL} SELECT {KEYS}, concat_ws('|', CASE WHEN widget THEN 'Widget' END, CASE WHEN m_rods THEN 'Rods' END, CASE WHEN old THEN 'Old' END) AS role,
    concat_ws('|', CASE WHEN remote THEN 'Remote' END, CASE WHEN m_asia THEN 'Asia' END, CASE WHEN europe THEN 'Europe' END,
      CASE WHEN regexp_matches(location || ' ' || coalesce(workMode, ''), '(?i)(^|[^A-Za-z0-9])hybrid') THEN 'Muted' END) AS region,
    concat_ws('|', CASE WHEN supplier THEN 'supplier' END, CASE WHEN studios THEN '/studios?/' END, CASE WHEN m_blocked THEN 'Blocked' END) AS company FROM s""")
def tgt05(t):
    g = C("group_scores")
    return scored(t).select(*KEY, *[F.array_join(g[i]["matched"], "|").alias(n) for i, n in enumerate(["role", "region", "company"])])


@query("tgt06_group_score", f"WITH {GROUP_SQL} SELECT {KEYS}, s1 AS role, s2 AS region, round(CAST(s3 AS DOUBLE), 6) AS company FROM s")
def tgt06(t):
    g = C("group_scores")
    return scored(t).select(*KEY, g[0]["score"].alias("role"), g[1]["score"].alias("region"), F.round(g[2]["score"], 6).alias("company"))


@query("tgt07_excluded", f"WITH {GROUP_SQL} SELECT {KEYS}, excluded FROM s")
def tgt07(t):
    return scored(t).select(*KEY, "excluded")


@query("tgt08_fit", f"WITH {GROUP_SQL} SELECT {KEYS}, round((3 * s1 + 2 * s2 + s3) / 6, 6) AS fit FROM s")
def tgt08(t):
    return scored(t).select(*KEY, F.round("fit", 6).alias("fit"))


LEGACY = {"weights": {"location": 2, "role": 3, "seniority": 0, "company": 5, "note": "x"}, "combine": "max",
          "location": {"europe": 1.0, "default": 0.25}, "role": {"widget": 1.0, "gear": 0.5}, "seniority": {"old": 1},
          "company": {"/studios?/": 0.3, "default": 0.6}}


@query("tgt09_legacy_fit", f"""SELECT {KEYS}, round(0.2 * CASE WHEN regexp_matches(location, '(?i)europe') THEN 1.0 ELSE 0.25 END
    + 0.3 * CASE WHEN contains(title, 'widget') THEN 1.0 WHEN contains(title, 'gear') THEN 0.5 ELSE 0 END + 0.5 * CASE WHEN contains(company, 'Studios') THEN 0.3 ELSE 0.6 END, 6)::DOUBLE AS fit FROM posting""")
def tgt09(t):
    return targeting.legacy_fit(t.posting, LEGACY).select(*KEY, F.round("fit", 6).alias("fit"))


@query("tgt10_rank", f"WITH {GROUP_SQL} SELECT {KEYS}, company, round((3 * s1 + 2 * s2 + s3) / 6, 6) AS fit FROM s ORDER BY round((3 * s1 + 2 * s2 + s3) / 6, 6) DESC, company, seq")
def tgt10(t):
    rows = scored(t).withColumn("fit", F.round("fit", 6))
    return rows.orderBy(F.desc("fit"), "company", "seq").select(*KEY, "company", "fit")


@query("tgt12_dimensions", """SELECT o_orderkey, round(0.25 * a + 0.15 * b + 0.15 * c + 0.1 * a + 0.1 * b + 0.05 * (c + a + b + c + a), 6)::DOUBLE AS total FROM (SELECT o_orderkey,
    1 + CAST(floor(o_totalprice / 125000) AS BIGINT) AS a, CAST(left(o_orderpriority, 1) AS BIGINT) AS b, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 5 ELSE 3 END AS c FROM orders)""")
def tgt12(t):
    a, b = 1 + F.floor(C("o_totalprice") / 125000), F.left("o_orderpriority", F.lit(1)).cast("long")
    c = F.when(C("o_orderstatus") == "F", 1).when(C("o_orderstatus") == "O", 5).otherwise(3)
    dims = dict(zip(targeting.DIMENSION_WEIGHTS, [a, b, c, a, b, c, a, b, c, a]))
    return t.read("orders").withColumns(dims).select("o_orderkey", F.round(targeting.dimension_total(), 6).alias("total"))


@query("tgt13_score_bands", """SELECT o_orderkey, CASE WHEN p >= 4.5 THEN 'strong' WHEN p >= 4.0 THEN 'good' WHEN p >= 3.5 THEN 'decent' ELSE 'against' END AS band FROM (SELECT o_orderkey, floor(o_totalprice / 10000) / 10 AS p FROM orders)""")
def tgt13(t):
    return t.read("orders").select("o_orderkey", targeting.score_band(F.floor(C("o_totalprice") / 10000) / 10).alias("band"))


# the types with words of the test texts
TYPES = {"English": ["the", "and", "with", "from"], "French": ["les", "des", "avec"], "German": ["der", "und", "nicht"], "Spanish": ["los", "que", "para"]}
_HITS = ", ".join(
    "(" + " + ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9]){w}') THEN 1 ELSE 0 END" for w in words) + f") AS {n}"
    for n, words in TYPES.items())


@query("tgt14_archetypes", f"""WITH h AS (SELECT doc_id, {_HITS} FROM documents), u AS (SELECT doc_id, n, pos, name FROM h, LATERAL (VALUES (English, 0, 'English'), (French, 1, 'French'), (German, 2, 'German'), (Spanish, 3, 'Spanish')) v(n, pos, name)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rn FROM u WHERE n > 0)
  SELECT d.doc_id, coalesce(string_agg(name, ' / ' ORDER BY rn), '') AS types FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND rn <= 2 GROUP BY d.doc_id""")
def tgt14(t):
    return t.documents.select("doc_id", F.array_join(targeting.archetypes(C("text"), TYPES), " / ").alias("types"))


@query("plan_ranked_new_postings", f"""WITH {GROUP_SQL}, seen AS (SELECT DISTINCT url FROM posting WHERE l_shipdate < DATE '1998-01-01' AND NOT l_tax > 0.06)
  SELECT url, company, title, round((3 * s1 + 2 * s2 + s3) / 6, 6) AS fit FROM s WHERE NOT excluded AND NOT coalesce(filtered, FALSE) AND url NOT IN (SELECT url FROM seen)
  ORDER BY fit DESC, company, seq""".replace("l_shipdate", "postedDate").replace("l_tax > 0.06", "l_quantity > 40"))
def plan_ranked(t):
    from ..plans.board import ranked_new_postings
    return ranked_new_postings(t, GROUPS).select("url", "company", "title", "fit")
