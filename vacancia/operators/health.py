"""Source health, scan counters, batches and feed audits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import classify, predicates


def scan_reason(excluded_dim: Column, filtered: Column, seen: Column) -> Column:
    """What became of a collected posting, in the order the scan decides."""
    return (F.when(filtered, "hidden").when(excluded_dim.isNotNull(), F.concat(F.lit("filtered_"), excluded_dim))
            .when(seen, "duplicate").otherwise("new"))


def scan_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def source_health(outcomes: DataFrame, by: str = "source") -> DataFrame:
    kind = F.coalesce("kind", F.lit(""))
    failed = ~F.col("ok")
    return outcomes.groupBy(by).agg(
        F.count("*").alias("attempted"), F.count_if("ok").alias("ok"),
        F.count_if(failed & (kind == "throttled")).alias("throttled"),
        F.count_if(failed & (kind == "blocked")).alias("blocked"),
        F.count_if(failed & ~kind.isin("throttled", "blocked")).alias("other"))


def blackouts(health: DataFrame) -> DataFrame:
    return health.filter(predicates.blackout(F.col("attempted"), F.col("ok"), F.col("throttled"), F.col("blocked")))


def fold_health(previous: DataFrame, outcomes: DataFrame, today: Column, threshold: int = 10,
                tracked: DataFrame | None = None) -> DataFrame:
    """Next health table (company, fails, since, lastError, kind, alert).

    A success clears the record, a failure extends the previous streak even for a name no longer tracked,
    and a record of a company that was not attempted is carried on only while it is tracked.
    """
    c = F.col
    now = outcomes.filter(F.coalesce("company", F.lit("")) != "").select(
        "company", "ok", c("error").alias("_error"), c("kind").alias("_kind"), F.lit(True).alias("_tried"))
    both = previous.join(now, "company", "full_outer")
    if tracked is not None:
        names = tracked.select(F.lower(F.trim("company")).alias("_low"), F.lit(True).alias("_tracked")).distinct()
        both = both.join(names, F.lower(F.trim("company")) == c("_low"), "left")
        keep = c("_tried").isNotNull() | c("_tracked").isNotNull()
    else:
        keep = F.lit(True)
    failed = c("_tried").isNotNull()
    # the shown text is short; the whole one tells apart what differs later
    whole = F.when(failed, F.nullif("_error", F.lit(""))).otherwise(c("error") if "error" in previous.columns else c("lastError"))
    return (both.filter(keep & ~F.coalesce(c("ok"), F.lit(False))).select(
        "company",
        F.when(failed, F.coalesce("fails", F.lit(0)) + 1).otherwise(c("fails")).cast("long").alias("fails"),
        F.coalesce("since", F.when(failed, today.cast("string"))).alias("since"),
        F.substring(whole, 1, 300).alias("lastError"), whole.alias("error"),
        F.when(failed, F.nullif("_kind", F.lit(""))).otherwise(c("kind")).alias("kind"))
        .withColumn("alert", c("fails") >= threshold))


def one_outcome_per_run(outcomes: DataFrame) -> DataFrame:
    """One row per company and run; a run counts as reached only when every attempt was."""
    return outcomes.groupBy("company", "run").agg(F.bool_and("ok").alias("ok"))


def failure_streaks(outcomes: DataFrame) -> DataFrame:
    """Every streak of failed runs (company, since, until, fails); islands between successes.

    Attempts are folded to one row per run first, so a company's window holds its runs, not its events.
    """
    by_run = Window.partitionBy("company").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = one_outcome_per_run(outcomes).withColumn("island", F.sum(F.col("ok").cast("int")).over(by_run))
    return (runs.filter(~F.col("ok")).groupBy("company", "island")
            .agg(F.min("run").alias("since"), F.max("run").alias("until"), F.count("*").alias("fails")).drop("island"))


def current_streaks(outcomes: DataFrame) -> DataFrame:
    """The streak a company is on after its last run."""
    last = one_outcome_per_run(outcomes).groupBy("company").agg(F.max("run").alias("until"))
    return failure_streaks(outcomes).join(last, ["company", "until"], "left_semi")


def longest_streaks(streaks: DataFrame, top: int = 10) -> DataFrame:
    return streaks.orderBy(F.desc("fails"), "company", "since").limit(top)


# --- feed audit ---------------------------------------------------------------------------------

def samples(df: DataFrame, keys: list[str], value: str, order: str, n: int) -> DataFrame:
    """First ``n`` values per key as an array. Ranks above ``n`` are dropped before the shuffle, so a hot key brings ``n`` rows per task."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_rank") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("v")))), lambda x: x["v"])
    return ranked.groupBy(*keys).agg(F.array_compact(listed).alias("samples"))


def feed_audit(attempts: DataFrame, postings: DataFrame, terms: list[str] = classify.GENEROUS_TERMS,
               suspect_min: int = 5) -> DataFrame:
    """Status of every attempted company feed with its postings and domain hits.

    ``attempts`` has company, ok and kind; throttled and blocked stay apart from dead feeds.
    """
    c = F.col
    title = F.coalesce("title", F.lit(""))
    counted = postings.groupBy("company").agg(
        F.count("*").alias("jobs"), F.count_if(classify.title_in_domain(title, terms)).alias("hits"),
        F.bool_and(F.rlike(title, F.lit(r"(?i)^\s*DEMO\b"))).alias("demo"))
    jobs, hits = F.coalesce("jobs", F.lit(0)), F.coalesce("hits", F.lit(0))
    status = (F.when(~c("ok"), F.when(c("kind").isin("throttled", "blocked"), c("kind")).otherwise("dead"))
              .when(jobs == 0, "empty").when(c("demo"), "suspect")
              .when(hits == 0, F.when(jobs >= suspect_min, "suspect").otherwise("lean")).otherwise("ok"))
    return attempts.join(counted, "company", "left").select(
        "company", status.alias("status"), F.when(c("ok"), jobs).otherwise(F.lit(0)).alias("jobs"),
        F.when(c("ok") & ~F.coalesce("demo", F.lit(False)), hits).otherwise(F.lit(0)).alias("hits"))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count("*").alias("n"))


def audit_flagged(audit: DataFrame, include_empty: bool = False) -> DataFrame:
    return audit.filter(F.col("status").isin("suspect", "dead", *(["empty"] if include_empty else [])))


# --- batches and runs ---------------------------------------------------------------------------

def batch_summary(state: DataFrame) -> DataFrame:
    """Totals by state and the mean score of completed rows, cut (not rounded) to one decimal."""
    c = F.col
    done, failed = c("status") == "completed", c("status") == "failed"
    score = F.when(done, c("score").try_cast("decimal(10,2)"))
    mean = F.sum(score) / F.count(score)
    return state.agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"),
                     F.count_if(~done & ~failed).alias("pending"), F.count(score).alias("scored"),
                     (F.floor(mean * 10) / 10).cast("double").alias("avg_score"))


def resolve_costs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.avg("cost").alias("avg_cost"))


def run_row(results: DataFrame) -> DataFrame:
    """History row per run: trusted hits, hits to review, uncertain and clean misses, duration."""
    c = F.col
    return results.groupBy("run").agg(
        F.count_if(c("outcome") == "trusted").alias("hits"), F.count_if(c("outcome") == "review").alias("review"),
        F.count_if(c("outcome") == "uncertain").alias("uncertain"), F.count_if(c("outcome") == "miss").alias("clean_misses"),
        (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("duration_ms"))


def append_run(history: DataFrame, row: DataFrame, keep: int = 50) -> DataFrame:
    return row.unionByName(history).orderBy(F.desc("run")).limit(keep)


def discovery_outcome(hit: Column, confidence: Column, skipped: Column, uncertain: Column) -> Column:
    return (F.when(hit & (confidence == "verify"), "review").when(hit, "trusted").when(skipped, "skipped")
            .when(uncertain, "uncertain").otherwise("miss"))
