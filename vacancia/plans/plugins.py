"""Extension points: sources, enrichers, post-steps and link patterns registered by name."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import classify

Source = Callable[[DataFrame], DataFrame]
SOURCES: dict[str, Source] = {}
POST_STEPS: dict[str, Source] = {}
ENRICHERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def source(name: str):
    """Register a function from landed payloads to postings."""
    def add(fn: Source) -> Source:
        SOURCES[name] = fn
        return fn
    return add


def post_step(name: str):
    """Register a step over all postings of one source, such as an office merge."""
    def add(fn: Source) -> Source:
        POST_STEPS[name] = fn
        return fn
    return add


def collect(payload: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Postings of every named source with its post-step, as one frame; each source reads only its rows."""
    from ..operators.snapshot import union_postings
    frames = []
    for name in names or list(SOURCES):
        rows = SOURCES[name](payload.filter(F.col("source") == name))
        frames.append(POST_STEPS.get(name, lambda d: d)(rows))
    return union_postings(frames)


def skills_enricher(vocabulary: dict[str, list[str]], needs: str = "text") -> Callable[[DataFrame], DataFrame]:
    """Tags of the description; NULL where the needed field is blank."""
    def run(df: DataFrame) -> DataFrame:
        tags = classify.skills(F.col(needs), vocabulary)
        return df.withColumn("skills", F.when(F.coalesce(needs, F.lit("")) != "", tags))
    return run


def sponsorship_enricher(needs: str = "text") -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        return df.withColumn("sponsorship", F.when(F.coalesce(needs, F.lit("")) != "", classify.sponsorship(F.col(needs))))
    return run


def apply_enrichers(df: DataFrame, enrichers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for enrich in enrichers:
        df = df.transform(enrich)
    return df
