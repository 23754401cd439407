from pyspark.sql import functions as F

from vacancia.operators import targeting

SCHEMA = "title string, company string, location string, department string, workMode string, experienceLevel string, skills array<string>"


def score(spark, rows, groups):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + SCHEMA)
    return targeting.score_groups(df, groups).orderBy("i").collect()


def job(title="", company="", location="", mode=None, skills=None):
    return (title, company, location, None, mode, None, skills)


def test_maximal_munch(spark):
    df = spark.createDataFrame([("Gameplay Engineer",), ("Unreal Engine",), ("Chef",)], "t string")
    got = targeting.category_scores(df, {"s": ("t", {"Engineer": 1.0, "Engine": 0.2, "default": 0.5}, "min")})
    assert {r.t: r.s for r in got.collect()} == {"Gameplay Engineer": 1.0, "Unreal Engine": 0.2, "Chef": 0.5}


def test_skills_group_abstains_on_unknown(spark):
    groups = [{"name": "Skills", "field": "skills", "weight": 1, "filters": [{"name": "Unity", "keywords": ["unity"], "weight": 1}, {"name": "none", "else": True, "weight": 0}]}]
    rows = score(spark, [job(skills=None), job(skills=[]), job(skills=["Unity"])], groups)
    assert [(r.fit, r.excluded) for r in rows] == [(0.5, False), (0.0, True), (1.0, False)]


def test_unless_and_priority(spark):
    groups = [
        {"name": "Mode", "field": "workmode", "filters": [{"name": "Remote", "keywords": ["remote"], "weight": None}]},
        {"name": "Region", "field": "location", "weight": 1, "filters": [
            {"name": "Poland", "keywords": ["Poland"], "weight": 0, "unless": ["remote", "missing"]}, {"name": "Asia", "keywords": ["asia"], "weight": 0},
            {"name": "Home", "keywords": ["home"], "weight": 1.5, "priority": True}]}]
    rows = score(spark, [job(location="Poland"), job(location="Poland", mode="remote"), job(location="Asia home"), job(location="Asia")], groups)
    assert [r.excluded for r in rows] == [True, False, False, True]
    assert [r.drop_reason for r in rows] == ["location", None, None, "location"]
    assert rows[2].fit == 1.5


def test_archetypes(spark):
    df = spark.createDataFrame([("QA tester writing a test plan for Unity gameplay",), ("cook",)], "t string")
    got = [r.a for r in df.select(targeting.archetypes(F.col("t")).alias("a")).collect()]
    assert got == [["QA / QA Automation", "Gameplay Programmer"], []]
