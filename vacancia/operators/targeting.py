"""Weighted keyword targeting compiled from configuration to Column expressions.

Nothing here iterates over rows: a configuration of groups and filters becomes one narrow projection.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import combine
from ..functions.patterns import any_of, compile_key, keys_hit

NEUTRAL = 0.5
_PLAIN = {"company": "company", "location": "location", "department": "department", "workmode": "workMode",
          "experiencelevel": "experienceLevel", "title": "title"}


# --- flat category scores -----------------------------------------------------------------------

def category_scores(df: DataFrame, scores: dict[str, tuple[str, dict, str]]) -> DataFrame:
    """Add score columns {name: (text column, {key: weight, default: weight}, combine mode)}.

    The longest match claims its span and suppresses shorter ones that overlap it. Each key is searched
    once per row in a projection of its own; the claims are settled on the resulting numbers.
    """
    keep, spans, out = df.columns, {}, {}
    for n, (name, (column, weights, mode)) in enumerate(scores.items()):
        text, candidates = F.coalesce(F.col(column), F.lit("")), []
        for i, (key, weight) in enumerate(weights.items()):
            pattern = compile_key(key)
            if key == "default" or pattern is None or not _is_number(weight):
                continue
            at, size = f"_at_{n}_{i}", f"_size_{n}_{i}"
            spans[at] = F.regexp_instr(text, F.lit(pattern))
            spans[size] = F.length(F.regexp_substr(text, F.lit(pattern)))
            candidates.append(F.when(F.col(at) > 0, F.struct(
                (-F.col(size)).alias("shorter"), F.lit(-len(str(key))).alias("key_shorter"), F.lit(i).alias("pos"),
                F.col(at).alias("start"), (F.col(at) + F.col(size)).alias("end"), F.lit(float(weight)).alias("weight"))))
        out[name] = _settle(candidates, weights.get("default"), mode)
    return df.withColumns(spans).select(*keep, *[c.alias(n) for n, c in out.items()])


def _is_number(w) -> bool:
    return isinstance(w, (int, float)) and not isinstance(w, bool)


def _settle(candidates: list[Column], fallback, mode: str) -> Column:
    default = F.lit(float(fallback) if _is_number(fallback) else 0.0)
    if not candidates:
        return default
    kept_type = "array<struct<shorter:int,key_shorter:int,pos:int,start:int,end:int,weight:double>>"
    kept = F.aggregate(F.array_sort(F.array_compact(F.array(*candidates))), F.array().cast(kept_type),
                       lambda acc, c: F.when(
                           F.exists(acc, lambda k: (c["start"] < k["end"]) & (c["end"] > k["start"])), acc
                       ).otherwise(F.concat(acc, F.array(c))),
                       lambda acc: combine(F.transform(acc, lambda k: k["weight"]), mode))
    found = any_of([c.isNotNull() for c in candidates])
    return F.when(found, kept).otherwise(default)


def flat_gate(df: DataFrame, targeting: dict) -> DataFrame:
    """Keep rows whose role, location and company scores are all positive; a missing map passes."""
    mode = targeting.get("combine", "min")
    dims = [(d, c) for d, c in (("role", "title"), ("location", "location"), ("company", "company")) if targeting.get(d)]
    scored = category_scores(df, {f"_{d}_score": (c, targeting[d], mode) for d, c in dims})
    for d, _ in dims:
        scored = scored.filter(F.col(f"_{d}_score") > 0)
    return scored.select(*df.columns)


def legacy_fit(df: DataFrame, ranking: dict) -> DataFrame:
    """Add the four category scores and ``fit``, their mean under normalised positive weights."""
    weights = {k: float(v) for k, v in ranking.get("weights", {}).items() if _is_number(v) and v > 0}
    total, mode = sum(weights.values()), ranking.get("combine", "max")
    dims = {"location": "location", "role": "title", "seniority": "title", "company": "company"}
    scored = category_scores(df, {f"{d}_score": (c, ranking.get(d, {}), mode) for d, c in dims.items()})
    fit = F.lit(0.0)
    for d in dims:
        if d in weights:
            fit = fit + F.lit(weights[d] / total) * F.col(f"{d}_score")
    return scored.withColumn("fit", fit)


# --- groups -------------------------------------------------------------------------------------

def field_text(field) -> Column:
    """Text a group reads: one field, several joined by blanks, or 'any' of the plain ones."""
    if isinstance(field, (list, tuple)):
        return F.concat_ws(" ", *[field_text(f) for f in field])
    if field == "skills":
        return F.coalesce(F.array_join(F.col("skills"), " "), F.lit(""))
    if field == "any":
        return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit(""))
                                  for c in ("title", "company", "location", "department", "experienceLevel")])
    return F.coalesce(F.col(_PLAIN.get(field, "title")), F.lit(""))


def field_known(field) -> Column:
    """Only skills can be unknown: NULL means the description was never read."""
    fields = field if isinstance(field, (list, tuple)) else [field]
    return F.col("skills").isNotNull() if all(f == "skills" for f in fields) else F.lit(True)


def filter_label(f: dict) -> str:
    named = str(f.get("name") or "").strip()
    return named or next((str(k).strip() for k in f.get("keywords") or [] if str(k).strip()), "")


def filter_index(groups: list[dict]) -> dict[str, tuple[int, int]]:
    """Label to (group, filter) position, first one wins; catch-alls cannot be referenced."""
    index: dict[str, tuple[int, int]] = {}
    for gi, group in enumerate(groups):
        for fi, f in enumerate(group.get("filters") or []):
            label = filter_label(f).lower()
            if label and not f.get("else"):
                index.setdefault(label, (gi, fi))
    return index


def _weight(f: dict) -> float | None:
    w = f.get("weight")
    return float(w) if _is_number(w) else None


def _hit(gi: int, fi: int) -> str:
    return f"_hit_{gi}_{fi}"


def with_hits(df: DataFrame, groups: list[dict]) -> DataFrame:
    """One boolean per keyword filter, so that each regular expression runs once per row."""
    hits = {}
    for gi, group in enumerate(groups):
        text = field_text(group.get("field", "title"))
        for fi, f in enumerate(group.get("filters") or []):
            if not f.get("else"):
                hits[_hit(gi, fi)] = keys_hit(text, f.get("keywords") or [])
    return df.withColumns(hits)


def matched_filters(groups: list[dict]) -> list[list[tuple[dict, Column]]]:
    """Per group the filters with their match condition, over a frame made by :func:`with_hits`."""
    index = filter_index(groups)
    out = []
    for gi, group in enumerate(groups):
        known = field_known(group.get("field", "title"))
        keyword, catch_all = [], None
        for fi, f in enumerate(group.get("filters") or []):
            if f.get("else"):
                catch_all = f
                continue
            hit = F.col(_hit(gi, fi))
            targets = [index[r] for r in (str(u).strip().lower() for u in f.get("unless") or []) if r in index]
            if targets:
                hit = hit & ~any_of([F.col(_hit(*t)) for t in targets])
            keyword.append((f, known & hit))
        matched = list(keyword)
        if catch_all is not None:
            matched.append((catch_all, known & ~any_of([c for _, c in keyword])))
        rescued = any_of([c for f, c in matched if f.get("priority")])
        out.append([(f, c & ~rescued if _weight(f) == 0 and not f.get("priority") and any(
            g.get("priority") for g, _ in matched) else c) for f, c in matched])
    return out


def group_score(group: dict, matched: list[tuple[dict, Column]]) -> Column:
    """Active weights of the matched filters combined; neutral when none is active."""
    active = [(w, c) for f, c in matched if (w := _weight(f)) is not None]
    if not active:
        return F.lit(NEUTRAL)
    values = [F.when(c, F.lit(w)) for w, c in active]
    mode = group.get("combine") or "min"
    if mode in ("avg", "average"):
        total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
        count = sum((c.cast("int") for _, c in active[1:]), active[0][1].cast("int"))
        best = F.when(count > 0, total / count)
    elif len(values) == 1:
        best = values[0]
    else:
        best = F.greatest(*values) if mode == "max" else F.least(*values)
    return F.coalesce(best, F.lit(NEUTRAL))


def excluded(matched: list[list[tuple[dict, Column]]]) -> Column:
    return any_of([c for group in matched for f, c in group if _weight(f) == 0])


def drop_reason(groups: list[dict], matched: list[list[tuple[dict, Column]]]) -> Column:
    """Dimension of the first group that excludes a row: location over company over title; NULL keeps."""
    out = F.lit(None).cast("string")
    for group, filters in reversed(list(zip(groups, matched))):
        fields = group.get("field", "title")
        fields = fields if isinstance(fields, (list, tuple)) else [fields]
        dim = next((d for d in ("location", "company") if d in fields), "title")
        hard = [c for f, c in filters if _weight(f) == 0]
        if hard:
            out = F.when(any_of(hard), F.lit(dim)).otherwise(out)
    return out


def score_groups(df: DataFrame, groups: list[dict]) -> DataFrame:
    """Add ``fit``, ``excluded``, ``drop_reason`` and ``group_scores`` (name, score, matched labels)."""
    keep = df.columns
    hit = with_hits(df, groups)
    matched = matched_filters(groups)
    names = [f"_score_{i}" for i in range(len(groups))]
    scored = hit.withColumns({n: group_score(g, m) for n, g, m in zip(names, groups, matched)})
    total = sum(float(g.get("weight") or 0) for g in groups)
    weighted = F.lit(0.0)
    for n, g in zip(names, groups):
        weighted = weighted + F.lit(float(g.get("weight") or 0)) * F.col(n)
    breakdown = F.array(*[
        F.struct(F.lit(g.get("name", "")).alias("name"), F.col(n).alias("score"),
                 F.array_compact(F.array(*[F.when(c, F.lit(filter_label(f))) for f, c in m
                                           if not f.get("else") and filter_label(f)] or
                                         [F.lit(None).cast("string")])).alias("matched"))
        for n, g, m in zip(names, groups, matched)])
    return scored.select(*keep, (weighted / total if total else F.lit(NEUTRAL)).alias("fit"),
                         excluded(matched).alias("excluded"), drop_reason(groups, matched).alias("drop_reason"),
                         breakdown.alias("group_scores"))


# --- documented score rules ---------------------------------------------------------------------

# Weights in percent of the ten comparison dimensions.
DIMENSION_WEIGHTS = {
    "north_star": 25, "cv_match": 15, "level": 15, "compensation": 10, "growth": 10, "remote": 5, "reputation": 5,
    "stack": 5, "speed": 5, "culture": 5,
}
BANDS = [(4.5, "strong"), (4.0, "good"), (3.5, "decent")]
# Signal words of the six posting types.
ARCHETYPES = {
    "Gameplay Programmer": ["gameplay", "mechanics", "player", "combat", "C++", "Blueprint", "game feel"],
    "Engine / Tools Programmer": ["engine", "tools", "pipeline", "rendering", "optimization", "build systems", "low-level"],
    "Game / Systems Designer": ["game design", "systems design", "balancing", "economy", "level design", "narrative", "encounter"],
    "Technical Artist": ["shader", "rigging", "tech art", "DCC", "Houdini", "VFX", "pipeline", "Substance"],
    "Producer / Project Manager": ["producer", "milestone", "scrum", "scheduling", "stakeholder", "production", "live ops"],
    "QA / QA Automation": ["QA", "test plan", "bug", "test automation", "TestRail", "quality assurance", "compatibility"],
}


def dimension_total(weights: dict[str, int] = DIMENSION_WEIGHTS) -> Column:
    total = F.lit(0.0)
    for name, percent in weights.items():
        total = total + F.col(name) * (percent / 100.0)
    return total


def score_band(score: Column) -> Column:
    out = F.lit("against")
    for floor, label in reversed(BANDS):
        out = F.when(score >= floor, F.lit(label)).otherwise(out)
    return out


def archetypes(text: Column, table: dict[str, list[str]] = ARCHETYPES) -> Column:
    """Up to two types with the most signal hits, ties in table order; empty when nothing hits."""
    counted = F.array(*[
        F.struct((-sum((keys_hit(text, [k]).cast("int") for k in keys[1:]), keys_hit(text, keys[:1]).cast("int"))).alias("n"),
                 F.lit(i).alias("pos"), F.lit(name).alias("name"))
        for i, (name, keys) in enumerate(table.items())])
    return F.transform(F.slice(F.array_sort(F.filter(counted, lambda c: c["n"] < 0)), 1, 2), lambda c: c["name"])
