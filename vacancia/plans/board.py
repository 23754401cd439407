"""Flagship plan: which new, not excluded postings fit best?"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import snapshot, targeting
from .tables import Tables


def history(t: Tables) -> DataFrame:
    """Scan history: what was posted before 1998, large quantities standing for expired rows."""
    return t.posting.filter("postedDate < DATE '1998-01-01'").select(
        "url", F.when(F.col("landing.l_quantity") > 40, snapshot.TOMBSTONE).otherwise("added").alias("status"),
        "company", "title", F.col("seq").alias("lpos"), "postedDate")


def ranked_new_postings(t: Tables, groups: list[dict]) -> DataFrame:
    scored = targeting.score_groups(
        snapshot.unseen(t.posting, snapshot.seen_urls(history(t))).withColumn("skills", F.lit(None).cast("array<string>")), groups)
    open_rows = scored.filter(~F.col("excluded") & ~F.coalesce("filtered", F.lit(False)))
    return open_rows.withColumn("fit", F.round("fit", 6)).orderBy(F.desc("fit"), "company", "seq")
