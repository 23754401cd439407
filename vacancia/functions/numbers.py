"""Scores, weights and percentages."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_number(c: Column) -> Column:
    """First number of a score text, 0 when there is none (merge and cluster rule)."""
    token = F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit("**"), F.lit("")), r"([\d.]+)", 1)
    # a token such as 4.2.1 reads as its leading number
    return F.coalesce(F.regexp_extract(token, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double"), F.lit(0.0))


def out_of_five(c: Column) -> Column:
    """Number before '/5', 0 when there is none (dashboard rule)."""
    return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+\.?\d*)/5", 1).try_cast("double"), F.lit(0.0))


def leading_number(c: Column) -> Column:
    """Number a text opens with, NULL when it opens otherwise (pattern report rule)."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def combine(weights: Column, mode: str = "max") -> Column:
    if mode == "min":
        return F.array_min(weights)
    if mode == "multiply":
        return F.aggregate(weights, F.lit(1.0), lambda a, w: a * w)
    if mode in ("average", "avg"):
        return F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) / F.size(weights)
    return F.array_max(weights)


def safe_pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double") * 100.0)


def whole_pct(part: Column, whole: Column) -> Column:
    return F.round(safe_pct(part, whole), 0).cast("long")
