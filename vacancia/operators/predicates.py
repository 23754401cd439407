"""Row filters over postings, applications, companies, batches and sources."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names, urls
from ..functions.patterns import contains_any, java_pattern


def keyword_list(value) -> list[str]:
    """Configured keywords: a bare string counts as one, blanks and non-strings are left out."""
    items = [] if value is None else value if isinstance(value, (list, tuple)) else [value]
    return [k.strip().lower() for k in items if isinstance(k, str) and k.strip()]


def title_filter(title: Column, positive: list[str] = (), negative: list[str] = ()) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    wanted = contains_any(low, [k.lower() for k in positive]) if positive else F.lit(True)
    return wanted & ~contains_any(low, [k.lower() for k in negative])


def location_filter(location: Column, config: dict | None) -> Column:
    """Blank passes; always_allow outranks block, which outranks allow."""
    if not config:
        return F.lit(True)
    always, block, allow = (keyword_list(config.get(k)) for k in ("always_allow", "block", "allow"))
    low = F.lower(F.coalesce(location, F.lit("")))
    return (F.when(F.trim(low) == "", F.lit(True)).when(contains_any(low, always), F.lit(True))
            .when(contains_any(low, block), F.lit(False))
            .otherwise(contains_any(low, allow) if allow else F.lit(True)))


def blocked_employer(company: Column, blocked: list[str]) -> Column:
    key = F.lower(F.trim(F.coalesce(company, F.lit(""))))
    listed = keyword_list(blocked)
    return (key != "") & key.isin(listed) if listed else F.lit(False)


def flag_blocked(df: DataFrame, blocked: list[str], aggregators: list[str]) -> DataFrame:
    """Set ``filtered`` on listed employers seen at an aggregator; rows are flagged, not dropped."""
    hit = blocked_employer(F.col("company"), blocked) & urls.host(F.col("url")).isin(aggregators)
    flag = F.coalesce(F.col("filtered"), F.lit(False)) if "filtered" in df.columns else F.lit(False)
    return df.withColumn("filtered", flag | hit)


def fuzzy_blocked(company: Column, blocked: list[str]) -> Column:
    """Exact name, or a listed name of six letters or more inside the despaced one (short list)."""
    import re
    keys = [re.sub("[^a-z0-9]", "", b.lower()) for b in blocked]
    return (F.coalesce(company, F.lit("")) != "") & (
        F.lower(company).isin([b.lower() for b in blocked])
        | contains_any(names.alnum_key(company), [k for k in keys if len(k) >= 6]))


def fuzzy_blocked_join(df: DataFrame, blocked: DataFrame, name: str = "company") -> DataFrame:
    """Rows of ``df`` whose company holds a listed name, for block lists of any size.

    Listed keys are grouped by their length first; each row then emits its substrings of just those
    lengths, so the containment test is an equi join and never a cross join.
    """
    keys = (blocked.select(names.alnum_key(F.col("name")).alias("k")).filter(F.length("k") >= 6).distinct())
    lengths = keys.select(F.length("k").alias("n")).distinct().agg(F.collect_set("n").alias("ns"))
    companies = df.select(name).distinct().withColumn("_k", names.alnum_key(F.col(name)))
    grams = (companies.crossJoin(F.broadcast(lengths))
             .select(name, "_k", F.explode("ns").alias("n")).filter(F.length("_k") >= F.col("n"))
             .select(name, F.explode(F.transform(
                 F.sequence(F.lit(1), F.length("_k") - F.col("n") + 1),
                 lambda i: F.substring(F.col("_k"), i, F.col("n")))).alias("k")))
    exact = companies.join(blocked.select(F.lower("name").alias("low")).distinct(),
                           F.lower(F.col(name)) == F.col("low"), "left_semi").select(name)
    hit = grams.join(keys, "k", "left_semi").select(name).unionByName(exact).distinct()
    return df.join(hit, name, "left_semi")


# Employers of neighbouring trades, as words and glued into one.
OFF_THEME = (r"\b(vfx|fx\b|visual ?effects|imageworks|cinesite|framestore|feature animation|animation studios?|casino"
             r"|gambling|i-?gaming|sportsbook|betting|lottery|slots?|poker|wager)\b")
OFF_THEME_GLUED = "(vfx|visualeffects|imageworks|cinesite|framestore)"


def off_theme(company: Column, words: str = OFF_THEME, glued: str = OFF_THEME_GLUED) -> Column:
    text = F.coalesce(company, F.lit(""))
    return F.rlike(text, F.lit(java_pattern(words))) | F.rlike(names.alnum_key(text), F.lit(glued))


def sector_allowed(department: Column, blocked: list[str]) -> Column:
    sector = F.lower(F.trim(F.coalesce(department, F.lit(""))))
    listed = keyword_list(blocked)
    return (sector == "") | ~sector.isin(listed) if listed else F.lit(True)


def in_source_scope(source_ats: Column, source_studio: Column, company: Column, covered: list[str],
                    studio: str | None = None) -> Column:
    """A pinned studio must match exactly; otherwise sources covered directly are skipped."""
    if studio and studio.strip():
        s = studio.strip().lower()
        import re
        return (F.lower(F.coalesce(source_studio, F.lit(""))) == s) | (
            names.alnum_key(company) == re.sub("[^a-z0-9]", "", s))
    return ~F.coalesce(source_ats, F.lit("")).isin(covered) if covered else F.lit(True)


def allow_list(text: Column, wanted) -> Column:
    """Any wanted part inside the text; a blank list keeps everything."""
    listed = keyword_list(wanted)
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), listed) if listed else F.lit(True)


def entry_selected(enabled: Column, name: Column, part: str = "") -> Column:
    keep = F.coalesce(enabled, F.lit(True)) & (F.trim(F.coalesce(name, F.lit(""))) != "")
    return keep & F.contains(F.lower(name), F.lit(part.lower())) if part else keep


def aged(url: Column, posted: Column, now: Column, days: int) -> Column:
    """Web postings with a readable date more than ``days`` back."""
    return F.rlike(F.coalesce(url, F.lit("")), F.lit("(?i)^https?://")) & posted.isNotNull() & (
        posted < now - F.make_interval(days=F.lit(days)))


def on_tab(tab: str, status: Column, score: Column) -> Column:
    if tab == "all":
        return F.lit(True)
    return (score >= 4.0) & (status != "skip") if tab == "top" else status == tab


def search(query: str, *columns: Column) -> Column:
    if not query:
        return F.lit(True)
    return contains_any(F.lower(F.concat_ws("\u0000", *columns)), [query.lower()])


def pending_batch(batch: DataFrame, state: DataFrame, max_retries: int, start_from: int = 0,
                  retry_failed: bool = False) -> DataFrame:
    """Batch rows to run next: numeric id from ``start_from`` on, not completed, retries left."""
    known = batch_with_state(batch, state)
    runnable = F.rlike("id", F.lit("^[0-9]+$")) & (F.coalesce("url", F.lit("")) != "") & (
        F.col("id").try_cast("long") >= start_from)
    left = F.col("retries") < max_retries
    wanted = (F.col("status") == "failed") & left if retry_failed else (
        (F.col("status") != "completed") & ((F.col("status") != "failed") | left))
    return known.filter(runnable & wanted)


def batch_with_state(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Batch rows with the status and retries of their state row: 'none' and 0 when there is none."""
    joined = batch.join(state.select("id", "status", "retries"), "id", "left")
    return joined.withColumns({"status": F.coalesce("status", F.lit("none")),
                               "retries": F.coalesce("retries", F.lit(0))})


def has_context(*, logo, games, founded, country, description, website) -> Column:
    texts = [F.coalesce(c.cast("string"), F.lit("")) != "" for c in (logo, founded, country, description, website)]
    out = F.coalesce(F.size(games), F.lit(0)) > 0
    for t in texts:
        out = out | t
    return out


def bare_city(location: Column, countries: list[str]) -> Column:
    """A place that still needs its country: no comma and not itself a country."""
    loc = F.trim(F.coalesce(location, F.lit("")))
    return (loc != "") & ~F.contains(loc, F.lit(",")) & ~F.lower(loc).isin(countries)


# Legal endings that mark a company name.
LEGAL_ENDING = r"(?i)\s+(AB|Aktiebolag|HB|AS|ApS|Oy|Ltd|Inc|LLC|GmbH)\.?$"


def company_shaped(cell: Column) -> Column:
    c = F.trim(cell)
    return (F.length(c).between(3, 45) & ~F.contains(c, F.lit("�")) & ~F.rlike(c, F.lit(r"[.,;:!?()/]|\d"))
            & (c != F.upper(c)) & (F.size(F.split(c, r"\s+")) <= 6) & F.rlike(c, F.lit(LEGAL_ENDING)))


def blackout(attempted: Column, ok: Column, throttled: Column, blocked: Column) -> Column:
    """A source that was tried twice or more and only ever throttled or blocked."""
    return (ok == 0) & (attempted >= 2) & (throttled + blocked == attempted)


def entry_scannable(recipe: Column, parser: Column, provider: Column, status: Column, url: Column) -> Column:
    """Backlog rule: recipe kind, parser, provider, an 'unresolved' mark, then any address."""
    from .classify import SCANNABLE_RECIPES, TAG_RECIPES

    def given(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return (F.when(recipe.isin(SCANNABLE_RECIPES), True).when(recipe.isin(TAG_RECIPES), False)
            .when(given(parser) | given(provider), True).when(status == "unresolved", False)
            .when(given(url), True).otherwise(False))


def backlog(companies: DataFrame, include_blocked: bool = False) -> DataFrame:
    c = F.col
    open_entry = (F.coalesce("name", F.lit("")) != "") & ~entry_scannable(
        c("recipe"), c("parser"), c("provider"), c("status"), c("careers_url"))
    if not include_blocked:
        open_entry = open_entry & (F.coalesce("recipe", F.lit("")) != "blocked")
    return companies.filter(open_entry)
