"""Aggregates over the tracker: funnels, outcomes, gaps, recommendations, progress, integrity."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names
from ..functions.dates import iso_week, strict_date
from ..functions.numbers import first_number, leading_number, out_of_five, safe_pct, whole_pct
from ..session import cut_lineage
from . import classify, tracker


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _dimension(df: DataFrame, name: str, values: list) -> DataFrame:
    """A fixed list of labels with their position, so that absent ones still report zero."""
    rows = F.posexplode(F.array(*[F.lit(v) for v in values])).alias("pos", name)
    return df.sparkSession.range(1).select(rows)


# --- pattern report -----------------------------------------------------------------------------

def enrich(apps: DataFrame, reports: DataFrame) -> DataFrame:
    """Applications with normal status, outcome, score and report buckets.

    The score falls back to the report's global score, the remote policy to the notes.
    """
    c = F.col
    joined = tracker.with_report(apps, reports.select(
        "path", "archetype", "remote", "teamSize", "gaps", c("score").alias("report_score")))
    state = classify.report_status(c("status"))
    return joined.select(
        *apps.columns, "archetype", "gaps", state.alias("state"), classify.outcome(state).alias("outcome"),
        F.coalesce(leading_number(c("score")), c("report_score"), F.lit(0.0)).alias("points"),
        classify.remote_policy(F.coalesce(F.nullif(c("remote"), F.lit("")), c("notes"))).alias("remote_policy"),
        classify.company_size(c("teamSize")).alias("company_size"))


def funnel(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("state").agg(F.count("*").alias("n"))


def score_by_outcome(enriched: DataFrame) -> DataFrame:
    """Mean (two decimals), minimum, maximum and count of positive scores per outcome, zeros kept."""
    stats = (enriched.filter("points > 0").groupBy("outcome")
             .agg(F.round(F.avg("points"), 2).alias("avg_score"), F.min("points").alias("min_score"),
                  F.max("points").alias("max_score"), F.count("*").alias("n")))
    return (_dimension(enriched, "outcome", classify.OUTCOMES).join(stats, "outcome", "left")
            .select("outcome", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("avg_score", "min_score", "max_score", "n")]))


def breakdown(enriched: DataFrame, by: str) -> DataFrame:
    """Rows per value of ``by`` and outcome with the share of positive ones in whole percent."""
    value = F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("Unknown"))
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in classify.OUTCOMES]
    return (enriched.groupBy(value.alias(by)).agg(F.count("*").alias("total"), *counts)
            .withColumn("conversion", whole_pct(F.col("positive"), F.col("total"))))


def gap_rows(enriched: DataFrame) -> DataFrame:
    return enriched.select("num", "outcome", F.explode("gaps").alias("gap"))


def blockers(enriched: DataFrame, rules=classify.BLOCKERS) -> DataFrame:
    """Blocking gap kinds with their frequency and percent of all applications."""
    kinds = (gap_rows(enriched).withColumn("blocker", classify.blocker_type(F.col("gap.description"), F.col("gap.severity"), rules))
             .filter("blocker is not null").groupBy("blocker").agg(F.count("*").alias("frequency")))
    total = enriched.agg(F.count("*").alias("total"))
    return kinds.join(F.broadcast(total)).select("blocker", "frequency", whole_pct(F.col("frequency"), F.col("total")).alias("percentage"))


def score_threshold(enriched: DataFrame) -> DataFrame:
    """Lowest positive score floored to one decimal; 3.5 when there is none."""
    low = F.min(F.when((F.col("outcome") == "positive") & (F.col("points") > 0), F.col("points")))
    return enriched.agg(low.alias("lowest")).select(
        "lowest", F.coalesce(F.floor(F.col("lowest") * 10) / 10, F.lit(3.5)).alias("recommended"))


def technology_gaps(enriched: DataFrame, top: int = 15, pattern: str = classify.TECHNOLOGIES) -> DataFrame:
    lost = gap_rows(enriched.filter(F.col("outcome").isin("negative", "self_filtered")))
    return (lost.select(F.explode(classify.technologies(F.col("gap.description"), pattern)).alias("skill"))
            .groupBy("skill").agg(F.count("*").alias("frequency"))
            .orderBy(F.desc("frequency"), "skill").limit(top))


def totals(enriched: DataFrame, rules=classify.BLOCKERS) -> DataFrame:
    """Counts by archetype, by remote policy, by blocker and over all, from one pass: (by, subject, total, positive, gaps, lowest).

    Rows are repeated for their gaps, and only the first repeat counts as a row.
    """
    c = F.col
    positive = c("outcome") == "positive"
    known = lambda name: F.coalesce(F.nullif(c(name), F.lit("")), F.lit("Unknown")).alias(name)
    rows = enriched.select(known("archetype"), known("remote_policy"), positive.alias("good"),
                           F.when(positive & (c("points") > 0), c("points")).alias("points"), F.posexplode_outer("gaps").alias("at", "gap"))
    blocker = classify.blocker_type(c("gap.description"), c("gap.severity"), rules)
    # the pattern tests come before the rows are repeated for the sets
    marked = rows.select("archetype", "remote_policy", blocker.alias("blocker"), "points", (F.coalesce("at", F.lit(0)) == 0).alias("row"), "good")
    by = [c("archetype"), c("remote_policy"), c("blocker")]
    level = F.grouping_id()
    sets = marked.groupingSets([[by[0]], [by[1]], [by[2]], []], *by).agg(
        level.alias("level"), F.count_if("row").alias("total"), F.count_if(c("row") & c("good")).alias("positive"), F.count("*").alias("gaps"), F.min("points").alias("lowest"))
    name = F.element_at(F.create_map(*[F.lit(x) for x in (3, "archetype", 5, "remote_policy", 6, "blocker", 7, "all")]), c("level").cast("int"))
    return sets.select(name.alias("by"), F.coalesce(*by).alias("subject"), "total", "positive", "gaps", "lowest")


def recommendations(enriched: DataFrame, rules=classify.BLOCKERS) -> DataFrame:
    """Rule rows (rule, subject, value, impact) that the aggregates trigger; the rules see the small table of :func:`totals` only."""
    c = F.col
    found = cut_lineage(totals(enriched, rules).filter("subject is not null or by = 'all'"))
    whole = F.broadcast(found.filter("by = 'all'").select(c("total").alias("all")))     # one row
    share = found.join(whole).withColumn("share", whole_pct(c("gaps"), c("all"))).withColumn("conversion", whole_pct(c("positive"), c("total")))

    def row(df: DataFrame, rule: str, subject: Column, value: Column, impact: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"),
                         value.cast("double").alias("value"), F.lit(impact).alias("impact"))

    def first(df: DataFrame, *order) -> DataFrame:
        return df.orderBy(*order).limit(1)

    kinds, remote = share.filter("by = 'archetype' and total >= 2"), share.filter("by = 'remote_policy' and total >= 2")
    floor = F.floor(c("lowest") * 10) / 10
    return _union([
        row(share.filter("by = 'blocker' and subject = 'geo-restriction' and share >= 20"), "tighten-location", c("subject"), c("share"), "high"),
        row(share.filter("by = 'blocker' and subject = 'stack-mismatch' and share >= 15"), "filter-stack", c("subject"), c("share"), "high"),
        row(share.filter("by = 'all' and lowest > 3.0"), "score-floor", F.lit("score"), floor, "medium"),
        row(first(kinds.filter("conversion > 0"), F.desc("conversion"), F.desc("total"), "subject"), "double-down", c("subject"), c("conversion"), "medium"),
        row(first(remote.filter("conversion = 0"), F.desc("total"), "subject"), "avoid-policy", c("subject"), c("total"), "medium"),
    ])


def evidence(enriched: DataFrame, threshold: int = 5) -> DataFrame:
    return enriched.agg(F.count_if(F.col("state") != "evaluated").alias("current")).select(
        "current", F.lit(threshold).alias("threshold"), (F.col("current") >= threshold).alias("enough"))


def with_evidence(report: DataFrame, enriched: DataFrame, threshold: int = 5) -> DataFrame:
    """The report, or no rows while too few applications went beyond evaluation."""
    gate = evidence(enriched, threshold).filter("enough").select("enough")
    return report.join(F.broadcast(gate)).drop("enough")


def metadata(enriched: DataFrame) -> DataFrame:
    day = F.nullif(F.col("date"), F.lit(""))
    return enriched.agg(F.count("*").alias("total"), F.min(day).alias("first_date"), F.max(day).alias("last_date"),
                        *[F.count_if(F.col("outcome") == o).alias(o) for o in classify.OUTCOMES])


# --- dashboard ----------------------------------------------------------------------------------

CLOSED = ["skip", "rejected", "discarded"]


def board(apps: DataFrame) -> DataFrame:
    """Applications as the dashboard reads them: normal status, score out of five, document flag."""
    return apps.withColumns({"state": classify.board_status(F.col("status")), "points": out_of_five(F.col("score")),
                             "has_pdf": F.contains(F.coalesce("pdf", F.lit("")), F.lit("✅"))})


def board_metrics(rows: DataFrame) -> DataFrame:
    scored = F.when(F.col("points") > 0, F.col("points"))
    return rows.agg(
        F.count("*").alias("total"), F.coalesce(F.avg(scored), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.max(scored), F.lit(0.0)).alias("top_score"), F.count_if("has_pdf").alias("with_pdf"),
        F.count_if(~F.col("state").isin(CLOSED)).alias("actionable"),
        F.count_if(F.col("state") == "offer").alias("offers"))


def status_counts(rows: DataFrame) -> DataFrame:
    """One row with the map of status counts, folded from one row per status."""
    return rows.groupBy("state").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("by_status"))


def progress_funnel(rows: DataFrame) -> DataFrame:
    """Rows that reached each stage; shares of all for the first step, of applied after it."""
    c = F.col

    def reached(*states: str) -> Column:
        return F.count_if(c("state").isin(*states))

    one = rows.agg(F.count("*").alias("t"), reached("applied", "responded", "interview", "offer", "rejected").alias("a"),
                   reached("responded", "interview", "offer").alias("r"), reached("interview", "offer").alias("i"),
                   reached("offer").alias("o"))
    stages = [("Evaluated", "t", None), ("Applied", "a", "t"), ("Responded", "r", "a"), ("Interview", "i", "a"), ("Offer", "o", "a")]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(pos).alias("pos"), F.lit(label).alias("stage"), c(n).alias("n"),
                 (safe_pct(c(n), c(of)) if of else F.lit(100.0)).alias("pct"))
        for pos, (label, n, of) in enumerate(stages)])))


def progress_rates(rows: DataFrame) -> DataFrame:
    stages = {"Responded": "response_rate", "Interview": "interview_rate", "Offer": "offer_rate"}
    return progress_funnel(rows).agg(*[F.max(F.when(F.col("stage") == s, F.col("pct"))).alias(n) for s, n in stages.items()])


BUCKETS = ["4.5-5.0", "4.0-4.4", "3.5-3.9", "3.0-3.4", "<3.0"]


def score_buckets(rows: DataFrame) -> DataFrame:
    p = F.col("points")
    label = (F.when(p >= 4.5, BUCKETS[0]).when(p >= 4.0, BUCKETS[1]).when(p >= 3.5, BUCKETS[2])
             .when(p >= 3.0, BUCKETS[3]).otherwise(BUCKETS[4]))
    counted = rows.filter(p > 0).groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
    return _dimension(rows, "bucket", BUCKETS).join(counted, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def weekly_activity(rows: DataFrame, weeks: int = 8) -> DataFrame:
    """Applications per ISO week, the last ``weeks`` weeks that have any."""
    day = strict_date(F.col("date"))
    return (rows.filter(day.isNotNull()).groupBy(iso_week(day).alias("week")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("week")).limit(weeks).orderBy("week"))


def statistics(apps: DataFrame) -> DataFrame:
    score = F.nullif(first_number(F.col("score")), F.lit(0.0))
    return apps.agg(
        F.count("*").alias("total"), F.avg(score).alias("avg_score"),
        (100 * F.avg(F.contains(F.coalesce("pdf", F.lit("")), F.lit("✅")).cast("int"))).alias("pct_pdf"),
        (100 * F.avg(tracker.link_target(F.col("report")).isNotNull().cast("int"))).alias("pct_report"))


def cadence_counts(entries: DataFrame, apps: DataFrame) -> DataFrame:
    total = apps.agg(F.count("*").alias("tracked"))
    return entries.agg(F.count("*").alias("actionable"), *[
        F.count_if(F.col("urgency") == u).alias(u) for u in classify.URGENCY_ORDER]).join(F.broadcast(total))


# --- sorts of the dashboard ---------------------------------------------------------------------

def sort_keys(mode: str, grouped: bool = False) -> list[Column]:
    c = F.col
    modes = {"score": F.desc("points"), "date": F.desc("date"), "company": F.lower("company").asc(),
             "status": classify.board_priority(c("state")).asc()}
    chosen = modes[mode]
    if grouped:
        return [modes["status"], modes["score"] if mode == "status" else chosen, c("pos").asc()]
    return [chosen, c("pos").asc()]


# --- integrity ----------------------------------------------------------------------------------

_SCORE = r"^\d+\.?\d*/5$"


def integrity(apps: DataFrame, files: DataFrame, raw_lines: DataFrame, pending: DataFrame, folder: str = "data/") -> DataFrame:
    """One row per finding (check_name, level, item, shown); ``shown`` is the start of a long item."""
    c = F.col
    status = F.coalesce("status", F.lit(""))
    clean = F.trim(F.regexp_replace(F.lower(F.trim(F.replace(status, F.lit("**"), F.lit("")))), r"\s+\d{4}-\d{2}-\d{2}.*$", ""))
    known = [*classify.LABELS, *classify.STATUS_ALIASES]
    score = F.trim(F.replace(F.coalesce("score", F.lit("")), F.lit("**"), F.lit("")))

    def found(df: DataFrame, name: str, level: str, item: Column) -> DataFrame:
        return df.select(F.lit(name).alias("check_name"), F.lit(level).alias("level"), item.cast("string").alias("item"))

    # every per-row check in one pass over the tracker
    checks = [("status_unknown", "error", ~clean.isin(known)), ("status_bold", "error", F.contains(status, F.lit("**"))),
              ("status_date", "error", F.rlike(status, F.lit(r"\d{4}-\d{2}-\d{2}"))),
              ("score_format", "error", ~(F.rlike(score, F.lit(_SCORE)) | score.isin("N/A", "DUP"))),
              ("score_bold", "warning", F.contains(F.coalesce("score", F.lit("")), F.lit("**")))]
    hits = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("check_name"), F.lit(l).alias("level")))
                                     for n, l, test in checks]))
    per_row = apps.select("num", F.explode(hits).alias("h")).select("h.*", c("num").cast("string").alias("item"))
    rows = raw_lines.filter(F.startswith("line", F.lit("|")) & ~F.contains("line", F.lit("---")) & ~F.contains("line", F.lit("Empresa"))
                            & (F.size(F.split("line", r"\|")) < 9))
    return _union([
        per_row, found(tracker.exact_repeats(apps), "repeat", "warning", c("first_num")),
        found(tracker.broken_links(apps, files, folder), "broken_link", "error", c("num")),
        found(rows, "row_format", "error", c("line")),
        found(pending, "pending", "warning", c("name"))]).withColumn("shown", F.substring("item", 1, 80))


def integrity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check_name", "level").agg(F.count("*").alias("n"))
