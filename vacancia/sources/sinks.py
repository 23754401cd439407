"""Sinks: snapshot, history, inbox and state tables. All are distributed writes to a folder."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HISTORY = ["url", "first_seen", "portal", "title", "company", "status", "location"]


def write_snapshot(postings: DataFrame, folder: str, generated: Column) -> DataFrame:
    """Snapshot of postings in ``folder``/jobs and its header (generated, count) in ``folder``/header.

    The count is observed while the rows are written, so postings are computed once.
    """
    from pyspark.sql import Observation
    seen = Observation()
    postings.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{folder}/jobs")
    header = postings.sparkSession.range(1).select(generated.alias("generated"), F.lit(seen.get["n"]).alias("count"))
    header.write.mode("overwrite").json(f"{folder}/header")
    return header


def history_rows(postings: DataFrame, day: Column, status: Column) -> DataFrame:
    return postings.select("url", day.cast("string").alias("first_seen"), F.col("source").alias("portal"), "title", "company",
                           status.alias("status"), F.coalesce("location", F.lit("")).alias("location"))


def append_history(rows: DataFrame, folder: str) -> None:
    rows.select(*HISTORY).write.mode("append").parquet(folder)


def inbox_rows(postings: DataFrame, note: str = "") -> DataFrame:
    """Pending inbox entries, with the line as the checkbox list shows it."""
    line = F.concat_ws(" | ", F.concat(F.lit("- [ ] "), "url"), "company", "title")
    return postings.select(F.lit(False).alias("done"), "url", "company", "title", F.lit(note).alias("note"),
                           F.concat(line, F.lit(f"  {note}" if note else "")).alias("line"))


def append_inbox(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def reset(spark, inbox: str, history: str, inbox_out: str, history_out: str) -> None:
    """Fresh state: the inbox keeps only done rows, the history starts empty. Written to new folders, since
    a job must not overwrite what it reads."""
    spark.read.parquet(inbox).filter("done").write.mode("overwrite").parquet(inbox_out)
    spark.read.parquet(history).filter("false").write.mode("overwrite").parquet(history_out)


def write_state(table: DataFrame, folder: str) -> None:
    """Overwrite a state table (health, ledger, audit, flag list)."""
    table.write.mode("overwrite").parquet(folder)
