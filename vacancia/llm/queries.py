"""The registered queries of this package, one per operator, over whole tables, and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import jaccard_join, license_scan, manifest, mixing, packing, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_count, topk_search, toxicity, turn_repair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    import public_tokenizers
    got = token_count.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_secret_scans(spark, sf_dir):
    got = secret_scan.scanned(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return got.select("doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
                      F.sha2(secret_scan.joined(F.col("_base")), 256).alias("base_sha256"), secret_scan.joined(F.col("_spans")).alias("spans"))


def op3_topk_search(spark, sf_dir):
    got = topk_search.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row")


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"), size=3, percent=90)


def op6_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "_q.*")


def op7_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.scored(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_license_scans(spark, sf_dir):
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    got = substring_dedup.removed(table(spark, sf_dir, "documents"), size=35, output=substring_dedup.kept_digest)
    return got.select("doc_id", "n_words", "n_removed", F.col("out").alias("kept_sha256"))


def op11_suffix_array_dedup(spark, sf_dir):
    got = suffix_dedup.removed(table(spark, sf_dir, "documents"), size=100, output=suffix_dedup.kept_digest)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("out").alias("kept_sha256"))


def op12_conversation_repair(spark, sf_dir):
    return turn_repair.digest(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return manifest.verified(docs, arrived=manifest.tampered(docs)).drop("source")


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_counts, op2_secret_scans, op3_topk_search, op4_mixing, op5_jaccard_join, op6_quality_rules, op7_toxicity,
    op8_best_fit_packing, op9_license_scans, op10_substring_dedup, op11_suffix_array_dedup, op12_conversation_repair, op13_merkle_manifest, pipeline)}

_SPACE = r"[\x20\x09-\x0D]+"
ORACLES = {
    "op3_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
    "op10_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        rep AS (SELECT md5(t) AS t FROM win GROUP BY 1 HAVING count(*) > 1),
        hit AS (SELECT doc_id, i FROM win WHERE md5(t) IN (SELECT t FROM rep)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_mixing": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')) AS BIGINT) AS size,
                   CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0')[1:12] AS BIGINT) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS price FROM d GROUP BY source),
        -- sources in the order in which they fill up; the level at which the first k are full
        f AS (SELECT *, row_number() OVER o AS k, coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
                     sum(price) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total
              FROM s WINDOW o AS (ORDER BY 3.0 * source_size / price, source NULLS LAST)),
        l AS (SELECT min_by(CAST(total - held AS DOUBLE) / free, k) AS level FROM f WHERE price * (CAST(total - held AS DOUBLE) / free) < 3 * source_size),
        t AS (SELECT source, source_size, least(CAST(price AS DOUBLE) * level, CAST(3 * source_size AS DOUBLE)) AS target FROM s, l),
        q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT doc_id, size, CAST(upto + copy * source_size AS DOUBLE) / target AS finish, source, key, copy FROM q, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND target > 0),
        r AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, copy ROWS UNBOUNDED PRECEDING) AS run FROM c),
        k AS (SELECT doc_id, sum(size) AS taken FROM r WHERE run <= (SELECT sum(target) FROM t) GROUP BY doc_id)
        SELECT q.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)""",
    "op11_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
        -- maximal runs: a window that starts behind the end of all before it opens one
        run AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
            SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM late)),
        span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY doc_id, g),
        cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, count(*) AS n, sum(b - a) AS gone FROM span GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
               sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(1, n + 2), lambda k:
                   substr(h, CAST(2 * CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END + 1 AS BIGINT),
                          CAST(2 * ((CASE WHEN k = n + 1 THEN len(h) // 2 ELSE a[k] END) - (CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END)) AS BIGINT))), '') END)) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
        c AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda s, b: xor(s >> 8, crc[(xor(s, b) & 255) + 1])), 4294967295) % 20 AS code FROM k, t),
        d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE code <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, role[1:1] AS h,
                     trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS body FROM d),
        q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
        f AS (SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS dup, body <> '' AND nth = 1 AND NOT body[-1:] IN ('.', '!', '?') AS cut,
                     CASE WHEN lag(i) OVER w IS NOT NULL AND NOT lag(h) OVER w || h IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        -- states: 0 nothing yet, 1 after s, 2 after u, 3 after a; the best way to each of them, turn by turn, with up to two inserts before a turn
        dp AS (SELECT DISTINCT conv_id, 0 AS i, 0 AS st, {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS m FROM f
               UNION ALL
               SELECT conv_id, i, to_st, min({'cost': cost, 'audit': audit, 'lines': lines}) FROM (
                   SELECT conv_id, i, CASE WHEN e = 'D' THEN s WHEN lead THEN 1 WHEN s = 2 THEN 3 ELSE 2 END AS to_st,
                          m.cost + 2 * n + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND cut THEN 1 ELSE 0 END AS cost, m.audit || repeat('I', n) || e AS audit,
                          m.lines || (CASE WHEN st = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)[1:n]
                              || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || text] END AS lines
                   FROM (SELECT *, e = 'K' AND s = 0 AND h = 's' AS lead FROM (
                       SELECT f.*, st, m, n, e, CASE n WHEN 0 THEN st WHEN 1 THEN CASE WHEN st = 2 THEN 3 ELSE 2 END ELSE CASE WHEN st = 2 THEN 2 ELSE 3 END END AS s
                       FROM dp JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i + 1, (VALUES (0), (1), (2)) AS x(n), (VALUES ('D'), ('K'), ('R')) AS y(e)))
                   WHERE e = 'D' OR (NOT blank AND NOT dup AND (e = 'R' OR lead OR h = CASE WHEN s = 2 THEN 'a' ELSE 'u' END)))
               GROUP BY conv_id, i, to_st),
        ends AS (SELECT conv_id, min({'cost': m.cost + CASE st WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': m.audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                                      'lines': m.lines || CASE st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END}) AS m
                 FROM dp JOIN (SELECT conv_id AS c, max(i) AS n FROM f GROUP BY 1) ON dp.conv_id IS NOT DISTINCT FROM c AND i = n GROUP BY conv_id),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(cut) AS truncated, sum(bad) AS illegal
              FROM f GROUP BY conv_id)
        SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
               CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(m.cost, 0) AS BIGINT) AS cost, coalesce(m.audit, '') AS audit,
               sha256(coalesce(array_to_string(m.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ends ON a.conv_id IS NOT DISTINCT FROM ends.conv_id""",
    "op13_merkle_manifest": """
        WITH RECURSIVE f AS (SELECT doc_id, source, concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head, text FROM documents),
        -- CRC-32 of the decimal digits
        t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        c AS (SELECT f.*, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda s, b: xor(s >> 8, crc[(xor(s, b) & 255) + 1])) AS s FROM f, t),
        h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                     sha256(head || coalesce(strlen(text) || ':' || CASE WHEN xor(s, 4294967295) % 5 = 0
                         THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS arrived FROM c),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM h),
        n AS (SELECT source, 0 AS lvl, pos, leaf AS h, total FROM p
              UNION ALL SELECT source, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (total + 15) // 16 FROM n WHERE total > 1 GROUP BY source, lvl, pos // 16, total),
        sub AS (SELECT source, h AS subroot FROM n WHERE total = 1),
        sp AS (SELECT source, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM sub),
        m AS (SELECT 0 AS lvl, pos, subroot AS h, total FROM sp
              UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (total + 15) // 16 FROM m WHERE total > 1 GROUP BY lvl, pos // 16, total),
        -- siblings of each leaf, level by level; those of the sources' tree follow
        way AS (SELECT doc_id, leaf, n.lvl AS lvl, string_agg(h, '' ORDER BY n.pos) FILTER (n.pos < p.pos >> (4 * lvl)) AS b, string_agg(h, '' ORDER BY n.pos) FILTER (n.pos > p.pos >> (4 * lvl)) AS a
                FROM p JOIN n ON p.source IS NOT DISTINCT FROM n.source AND n.total > 1 AND n.pos >> 4 = p.pos >> (4 * lvl + 4) GROUP BY doc_id, leaf, p.pos, n.lvl
                UNION ALL SELECT doc_id, leaf, 100 + m.lvl, string_agg(h, '' ORDER BY m.pos) FILTER (m.pos < sp.pos >> (4 * lvl)), string_agg(h, '' ORDER BY m.pos) FILTER (m.pos > sp.pos >> (4 * lvl))
                FROM p JOIN sp ON p.source IS NOT DISTINCT FROM sp.source JOIN m ON m.total > 1 AND m.pos >> 4 = sp.pos >> (4 * lvl + 4) GROUP BY doc_id, leaf, sp.pos, m.lvl),
        step AS (SELECT doc_id, leaf, coalesce(b, '') AS b, coalesce(a, '') AS a, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY lvl) AS k FROM way),
        fold AS (SELECT doc_id, leaf, arrived AS h, 0 AS k FROM p
                 UNION ALL SELECT f.doc_id, f.leaf, sha256(b || h || a), f.k + 1 FROM fold f JOIN step s ON f.doc_id = s.doc_id AND f.leaf = s.leaf AND s.k = f.k + 1),
        final AS (SELECT doc_id, leaf, max_by(h, k) AS folded_root FROM fold GROUP BY doc_id, leaf),
        proof AS (SELECT doc_id, leaf, sha256(string_agg(b || a, '' ORDER BY k)) AS proof_sha256 FROM step GROUP BY doc_id, leaf)
        SELECT p.doc_id, p.leaf, subroot, (SELECT h FROM m WHERE total = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
               folded_root = (SELECT h FROM m WHERE total = 1) AS verified
        FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source JOIN final USING (doc_id, leaf) LEFT JOIN proof USING (doc_id, leaf)""",
}
