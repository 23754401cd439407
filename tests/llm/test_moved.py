"""What the Jaccard join moves: in proportion to the input, in few stages."""
import random

import corpus_pipeline
from pyspark.sql import functions as F

from vacancia.llm import jaccard_join


def texts(n, words=120):
    rng = random.Random(8)
    return [(i, " ".join(str(rng.randrange(10**9)) for _ in range(words))) for i in range(n)]


def test_elements_moved_are_in_proportion_to_the_input(spark):
    def moved(n):
        docs = spark.createDataFrame(texts(n), "doc_id long, text string").withColumn("text", F.encode("text", "utf-8"))
        return docs.mapInArrow(jaccard_join.placed(3, 90), "cell long, s1 long, extent long").count()
    assert moved(2000) < 1.1 * 10 * moved(200)


def test_no_table_of_counts_unless_asked_for(spark, monkeypatch):
    rows = texts(30)
    rows += [(100 + i, t + " " + "more") for i, t in rows[:10]] + [(200, None), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spared = sorted(map(tuple, jaccard_join.classes(docs, sparing=True).collect()), key=str)
    monkeypatch.setattr(jaccard_join, "slot_levels", None)
    assert sorted(map(tuple, jaccard_join.classes(docs).collect()), key=str) == spared
    assert {(100 + i, i) for i in range(10)} <= {(d, c) for d, _, c in spared}


def test_components_take_few_stages(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(500 + i, 300) for i in range(3)] + [(7, 7), (None, 1)]
    sc = spark.sparkContext
    sc.setJobGroup("components", "components")
    got = {(r.node, r.root) for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    tracker = sc.statusTracker()
    jobs = tracker.getJobIdsForGroup("components")
    sc.setJobGroup("others", "others")
    assert got == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(200)} | {(n, 300) for n in (300, 500, 501, 502)}
    stages = sum(len(tracker.getJobInfo(j).stageIds) for j in jobs)
    assert stages < 130


def test_pipeline_step_sends_no_table_of_counts(spark, frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "slot_levels", None)
    rows = texts(12)
    rows += [(50, rows[3][1] + " more"), (None, rows[4][1]), (60, None)]
    got = corpus_pipeline.near_duplicates(spark, frame(rows), "unused")
    assert sorted(r.doc_id for r in got.collect()) == [*range(12), 60]
