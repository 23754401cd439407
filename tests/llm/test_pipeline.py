"""Stages hand on the columns of documents, and their decisions take effect."""
import random

import brute
import corpus_pipeline
from conftest import EDGES
from pyspark.sql import functions as F
from vacancia.llm import mixing, quality_rules, secret_scan
from vacancia.llm.common import numbered, unused


def test_stages(spark, frame, tmp_path):
    rng = random.Random(6)
    vocabulary = ["the", "of", "and", "to", "in"] * 12 + ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(160)) + "." for _ in range(30)]
    good, other = prose[0], prose[1] + " token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    words = good.split()
    near = " ".join([*words[:80], "changed", *words[81:]])
    docs = frame([*[(d, t) for d, t in EDGES if len(t or "") < 100], *enumerate(prose[2:], 100), (50, good), (51, near), (52, other)])
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number == 0:
            assert {50, 51, 52} <= {r.doc_id for r in docs.collect()}
        if number == 1:
            assert {50, 52} <= {r.doc_id for r in docs.collect()} and 51 not in {r.doc_id for r in docs.collect()}
        if number == 2:
            assert "[SECRET]" in next(r.text for r in docs.collect() if r.doc_id == 52)
    assert docs.filter("bin is not null").count() > 0


def test_near_duplicates_by_row(spark, frame):
    """Rows with null and repeated ids are handled like others: one row per class stays, the one with the least doc_id."""
    rng = random.Random(8)
    made = lambda: " ".join("".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(120))
    a, b, c, d = (made() for _ in range(4))
    near = lambda t: t + " more"
    docs = [(1, a), (1, a), (9, near(a)), (9, b), (None, c), (None, c), (20, near(c)), (None, d), (None, near(d)), (5, None), (5, ""), (None, None)]
    docs += [(i, rng.choice([a, b, made()])) for i in range(30, 60)]
    rng.shuffle(docs)
    parent = {row: root for row, _, root in brute.classes([(i, t) for i, (_, t) in enumerate(docs)], 5, 80)}
    groups = {}
    for row, root in parent.items():
        groups.setdefault(root, []).append(row)
    key = lambda r: (docs[r][0] is None, docs[r][0] or 0)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame(docs), "unused").collect()]
    for rows in groups.values():
        # rows of one class with equal ids may differ in text: any of them may be the one that stays
        texts = {docs[r] for r in rows}
        stay = [x for x in got if x in texts]
        if all(docs[r][1] for r in rows):
            assert len(stay) == 1 and stay[0][0] == docs[min(rows, key=key)][0]
    assert len(got) == len(groups)


CLASHES = ["_q", "_row", "_spans", "_base", "_copy", "_one", "_refs", "row", "times", "copy", "file_path", "row_index", "_metadata", "component_id", "a.b", "aside 0"]


def test_clashing_columns_keep_their_values(spark, tmp_path):
    prose = " ".join(["the of and to in a is that for it with as was on be by at from his her"] + [f"word{i} and the other of it" for i in range(40)]) + "."
    docs = spark.createDataFrame([(i, f"{prose} {i} token = 24be64439e3e49cf46b2d7c90f360{i:03}", "en", f"s{i % 2}", 1) for i in range(20)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{i} of "), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(CLASHES)])
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for step in (lambda d: quality_rules.keep(d, far_classes=2.0, far_words=2.0, most_repeated=100), secret_scan.redacted, mixing.mixed,
                 lambda d: corpus_pipeline.near_duplicates(spark, d, "unused")):
        out = step(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert got
        for r in got:
            assert [r[c] for c in CLASHES] == [f"{i} of {r['doc_id']}" for i in range(len(CLASHES))]
    assert all("[SECRET]" in r.text for r in secret_scan.redacted(docs).collect())


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(0, 5000, 1, 3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x y "), 50).alias("text")).write.option("parquet.block.size", 20000).parquet(path)
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = {r.doc_id: r.n for r in numbered(spark.read.parquet(path), "n").collect()}
            assert len(set(found.values())) == 5000
            seen.append(found)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1]
    made = numbered(spark.range(10).withColumn("N", F.lit(1)), unused(spark.createDataFrame([(1,)], "N int"), "n")[0])
    assert made.select("_n").distinct().count() == 10


def test_stages_of_an_empty_table_and_very_long_texts(spark, frame, tmp_path):
    for docs in (frame([]), frame([(1, None), (2, "w " * 60000), (3, "w " * 60000), (None, "x" * 200000), (4, "")])):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, kept, "unused")
            rows = out.collect()
            assert bool(rows) == bool(docs.count())
            if name == "n-gram Jaccard join":
                assert sorted(r.doc_id or 0 for r in rows) == ([0, 1, 2, 4] if rows else [])
        assert stage is corpus_pipeline.packs
        assert corpus_pipeline.quality(spark, docs, "unused").count() == 0
