"""Company identity: routing, tracked lookup, board mining, candidate matching, coverage ledger."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names, urls
from ..functions.patterns import java_pattern, let
from . import classify, predicates

# --- links and hosts ----------------------------------------------------------------------------

# Hosted boards and the place of the company's handle in their links.
# (provider, host suffix, where): "sub" is the first host label, "path" the first path segment.
BOARD_LINKS = [
    ("greenhouse", "boards.greenhouse.io", "path"), ("greenhouse", "job-boards.greenhouse.io", "path"),
    ("lever", "jobs.lever.co", "path"), ("ashby", "jobs.ashbyhq.com", "path"),
    ("smartrecruiters", "jobs.smartrecruiters.com", "path"), ("workable", "apply.workable.com", "path"),
    ("jobvite", "jobs.jobvite.com", "path"), ("rippling", "ats.rippling.com", "path"),
    ("teamtailor", "teamtailor.com", "sub"), ("recruitee", "recruitee.com", "sub"),
    ("breezy", "breezy.hr", "sub"), ("bamboohr", "bamboohr.com", "sub"), ("hailey", "haileyhr.app", "sub"),
    ("personio", "personio.de", "sub"), ("personio", "personio.com", "sub"), ("jazzhr", "applytojob.com", "sub"),
    ("huntflow", "huntflow.io", "sub"), ("workday", "myworkdayjobs.com", "sub"),
    ("zohorecruit", "zohorecruit.com", "sub"), ("zohorecruit", "zohorecruit.eu", "sub"),
    ("avature", "avature.net", "sub"), ("hibob", "careers.hibob.com", "sub"),
]
# Platforms and job boards by host ending, for reports on links nobody mines.
PLATFORM_HOSTS = {
    "greenhouse": ["greenhouse.io"], "lever": ["lever.co"], "ashby": ["ashbyhq.com"], "teamtailor": ["teamtailor.com"],
    "recruitee": ["recruitee.com"], "smartrecruiters": ["smartrecruiters.com"], "workable": ["workable.com"],
    "jobylon": ["jobylon.com"], "workday": ["myworkdayjobs.com", "workday.com"], "icims": ["icims.com"],
    "jobvite": ["jobvite.com"], "bamboohr": ["bamboohr.com"], "breezy": ["breezy.hr"],
    "personio": ["personio.de", "personio.com"], "hailey": ["haileyhr.app"], "50skills": ["50skills.com", "50skills.app"],
    "pinpoint": ["pinpointhq.com", "pinpoint.dev"], "avature": ["avature.net"], "workday-site": ["myworkdaysite.com"],
    "sap-successfactors": ["successfactors.com", "successfactors.eu"], "taleo": ["taleo.net"],
    "oracle-cloud": ["oraclecloud.com"], "jazzhr": ["applytojob.com"], "comeet": ["comeet.com"], "join": ["join.com"],
    "adp": ["workforcenow.adp.com"], "eightfold": ["eightfold.ai"], "gem": ["gem.com"],
    "zoho-recruit": ["zohorecruit.com", "zohorecruit.eu"], "freshteam": ["freshteam.com"],
    "factorial": ["factorialhr.com"], "rippling": ["rippling.com"], "paylocity": ["paylocity.com"],
    "ukg": ["ukg.com", "ukg.net"], "hibob": ["hibob.com"], "careerpuck": ["careerpuck.com"], "hrmos": ["hrmos.co"],
    "huntflow": ["huntflow.io", "huntflow.ru"],
}
JOB_BOARDS = [
    "linkedin.com", "indeed.com", "ziprecruiter.com", "hitmarker.net", "workwithindies.com", "remotegamejobs.com",
    "builtin.com", "wellfound.com", "angel.co", "otta.com", "dice.com", "monster.com", "themuse.com", "remotive.com",
    "gracklehq.com", "gamesjobsdirect.com", "wayup.com", "remoterocketship.com", "gamejobs.co", "ingamejob.com",
    "remoteok.com", "skillshot.pl",
]


def _on(host: Column, suffix: str) -> Column:
    return (host == suffix) | F.endswith(host, F.lit("." + suffix))


def link_identity(url: Column, table=BOARD_LINKS) -> Column:
    """struct(provider, slug, careers_url) of a hosted job link; NULL when no pattern claims it."""
    def identify(at: Column) -> Column:
        host, segment = at["host"], at["segment"]
        out = F.lit(None).cast("struct<provider:string,slug:string,careers_url:string>")
        for provider, suffix, where in reversed(table):
            if where == "sub":
                slug = F.split_part(host, F.lit("."), F.lit(1))
                page, fits = F.concat(F.lit("https://"), host), F.endswith(host, F.lit("." + suffix)) & (slug != "www")
            else:
                slug, fits = segment, (host == suffix) & (segment != "")
                page = F.concat(F.lit(f"https://{suffix}/"), segment)
            out = F.when(fits, F.struct(F.lit(provider).alias("provider"), slug.alias("slug"), page.alias("careers_url"))).otherwise(out)
        return out

    return let(F.struct(urls.hostname(url).alias("host"),
                        F.regexp_extract(urls.path(url), r"^/([^/]+)", 1).alias("segment")), identify)


def route_provider(provider: Column, parser: Column, url: Column, known: list[str], table=BOARD_LINKS) -> Column:
    """struct(provider, error): explicit entry, then a parser, then the first link pattern in order."""
    def first_pattern(host: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, suffix, _ in reversed(table):
            found = F.when(_on(host, suffix), F.lit(name)).otherwise(found)
        return found

    given = F.coalesce(provider, F.lit("")) != ""
    routed = F.when(F.coalesce(parser, F.lit("")) != "", F.lit("local-parser")).otherwise(let(urls.hostname(url), first_pattern))
    return F.struct(
        F.when(given, F.when(provider.isin(known), provider)).otherwise(routed).alias("provider"),
        F.when(given & ~provider.isin(known), F.concat(F.lit("unknown provider: "), provider)).alias("error"))


def host_class(url: Column) -> Column:
    """struct(class, label): aggregator, known platform, own site, or no readable host."""
    def classed(host: Column) -> Column:
        platform = F.lit(None).cast("string")
        for label, suffixes in reversed(PLATFORM_HOSTS.items()):
            platform = F.when(urls.on_hosts(host, suffixes), F.lit(label)).otherwise(platform)
        board = urls.on_hosts(host, JOB_BOARDS) | F.rlike(host, F.lit(r"(^|\.)glassdoor\."))

        def row(kind: str, label: Column) -> Column:
            return F.struct(F.lit(kind).alias("class"), label.alias("label"))

        return (F.when(host == "", row("custom", F.lit("(unparseable)")))
                .when(board, row("aggregator", urls.registrable_domain(host)))
                .otherwise(let(platform, lambda p: F.when(p.isNotNull(), row("platform", p)).otherwise(
                    row("custom", urls.registrable_domain(host))))))

    return let(urls.host(url), classed)


def unknown_hosts(links: DataFrame) -> DataFrame:
    """Distinct companies and rows per class and label of links that no pattern claims."""
    left = links.filter(link_identity(F.col("url")).isNull()).select("company", host_class(F.col("url")).alias("h"))
    # distinct companies first, so that a hot label combines before it is counted
    return (left.groupBy("h.class", "h.label", "company").agg(F.count("*").alias("n"))
            .groupBy("class", "label").agg(F.count("*").alias("companies"), F.sum("n").alias("jobs")))


def shared_domains(report: DataFrame) -> DataFrame:
    return report.filter((F.col("class") == "custom") & (F.col("companies") >= 2) & (F.col("label") != "(unparseable)"))


# --- board mining -------------------------------------------------------------------------------

def mine_boards(rows: DataFrame, category: str = "Gaming Company", strong: str = classify.STRONG_TITLES,
                weak: str = classify.WEAK_TITLES) -> DataFrame:
    """Postings per provider and slug with title signals, identities and the best display name.

    ``rows`` has provider, slug, company, title, category. Counting runs per spelling of the company
    first; only the spellings of one board meet afterwards.
    """
    c = F.col
    signal = classify.title_signal(c("title"), strong, weak)
    per_name = rows.groupBy("provider", F.lower("slug").alias("slug"), "company").agg(
        F.count("*").alias("n"), F.count_if(signal == "strong").alias("s"), F.count_if(signal == "weak").alias("w"),
        F.count_if(c("category") == category).alias("t"))
    best = F.min_by("company", F.struct((~F.rlike("company", F.lit(r"\s"))).alias("a"), (-F.length("company")).alias("b"), c("company")))
    return (per_name.groupBy("provider", "slug").agg(
        F.sum("n").alias("jobs"), F.sum("s").alias("strong"), F.sum("w").alias("weak"), F.sum("t").alias("tagged"),
        F.count("*").alias("spellings"), F.count_distinct(names.mine_key(c("company"))).alias("identities"),
        best.alias("name")).withColumn("hits", c("strong") + c("weak")))


def is_candidate(min_share: float = 0.34, small_board: bool = True) -> Column:
    c = F.col
    test = (c("strong") >= 1) | (c("hits") / c("jobs") >= min_share)
    if small_board:
        test = test | ((c("jobs") <= 30) & (c("tagged") / c("jobs") >= 0.5))
    return (c("hits") >= 1) & test


def is_confident() -> Column:
    return (F.col("strong") >= 1) | (F.col("hits") / F.col("jobs") >= 0.5)


def add_decision(boards: DataFrame, live: DataFrame, known: list[str], blocked: list[str],
                 need_tag: bool = True) -> DataFrame:
    """``reason`` why a mined board is not added, NULL when it is; the first test that fails counts.

    Of boards with the same name key only the best (share of signals, then size) is added; that is a
    minimum per key, not a pass in order.
    """
    c = F.col
    joined = boards.join(live.select("provider", "slug", "live_jobs"), ["provider", "slug"], "left").withColumns({
        "share": c("hits") / c("jobs"), "name_key": names.mine_key(c("name"))})
    tagged = c("tagged") / c("jobs")
    reason = (F.when(~c("provider").isin(known), F.lit("unknown provider"))
              .when(F.coalesce("live_jobs", F.lit(0)) <= 0, F.lit("feed not live"))
              .when(predicates.blocked_employer(c("name"), blocked), F.lit("blocklisted"))
              .when(predicates.off_theme(c("name")), F.lit("off-theme")))
    if need_tag:
        reason = F.coalesce(reason, F.when(tagged < 0.5, F.lit("not tagged")))
    reason = F.coalesce(reason, F.when(~is_confident(), F.lit("low confidence")),
                        F.when(c("identities") > 1, F.lit("ambiguous board")))
    judged = joined.withColumn("reason", reason)
    order = F.struct((-c("share")).alias("a"), (-c("jobs")).alias("b"), c("provider"), c("slug"))
    first = (judged.filter("reason is null").groupBy("name_key")
             .agg(F.min_by(F.struct("provider", "slug"), order).alias("w"))
             .select("w.provider", "w.slug", F.lit(True).alias("_first")))
    return (judged.join(first, ["provider", "slug"], "left")
            .withColumn("reason", F.coalesce("reason", F.when(c("_first").isNull(), F.lit("duplicate within this run"))))
            .drop("_first", "name_key"))


# --- tracked lookup -----------------------------------------------------------------------------

def not_tracked(candidates: DataFrame, tracked: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Candidates that share none of the keys with a tracked company: one anti join per key."""
    out = candidates
    for name, (mine, theirs) in keys.items():
        known = tracked.select(theirs.alias(f"_{name}")).filter(F.coalesce(f"_{name}", F.lit("")) != "").distinct()
        out = out.withColumn(f"_{name}", mine).join(known, f"_{name}", "left_anti").drop(f"_{name}")
    return out


ADDRESSES = ("careers_url", "api", "endpoint", "feed_url")


def tracked_lookup(queries: DataFrame, companies: DataFrame, backlog_names: DataFrame) -> DataFrame:
    """(query, status, matches) with status tracked, backlog or unknown.

    An entry matches by name or by the domain of any of its addresses (``ADDRESSES``, as far as the table has them). Matches are counted without pairs: entries of
    the name, plus entries of the domain, less those that are both. The research backlog answers only names that no entry matched.
    """
    c = F.col
    asked = queries.select("query", names.track_key(c("query")).alias("qn"), urls.last_two_labels(c("url")).alias("qd"))
    there = [a for a in ADDRESSES if a in companies.columns]
    api = c("api") if "api" in there else F.lit(None).cast("string")
    entry = classify.entry_kind(c("recipe"), c("parser"), c("provider"), c("careers_url"), c("status"), api)
    domains = F.array_distinct(F.filter(F.array(*[F.coalesce(urls.last_two_labels(c(a)), F.lit("")) for a in there]), lambda d: d != ""))
    known = companies.select(names.track_key(c("name")).alias("qn"), domains.alias("domains"), entry["scannable"].alias("scannable"))
    hosted = known.select("qn", "scannable", F.explode("domains").alias("qd"))

    def counted(entries: DataFrame, keys: list[str], name: str) -> DataFrame:
        return entries.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.bool_or("scannable").alias(f"s_{name}"))
    by_name = counted(known.filter("qn != ''"), ["qn"], "name")
    by_domain = counted(hosted, ["qd"], "domain")
    both = counted(hosted.filter("qn != ''"), ["qn", "qd"], "both").drop("s_both")
    research = backlog_names.select(names.track_key(c("name")).alias("qn"), F.lit(True).alias("listed")).distinct()
    joined = asked.join(by_name, "qn", "left").join(by_domain, "qd", "left").join(both, ["qn", "qd"], "left").join(research, "qn", "left")
    matches = F.coalesce("n_name", F.lit(0)) + F.coalesce("n_domain", F.lit(0)) - F.coalesce("n_both", F.lit(0))
    scannable = F.coalesce("s_name", F.lit(False)) | F.coalesce("s_domain", F.lit(False))
    listed = (matches == 0) & (c("qn") != "") & F.coalesce("listed", F.lit(False))
    return joined.select("query", F.when(scannable, "tracked").when((matches > 0) | listed, "backlog").otherwise("unknown").alias("status"),
                         F.when(listed, 1).otherwise(matches).cast("long").alias("matches"))


def import_new(leads: DataFrame, tracked: DataFrame, key) -> DataFrame:
    """First lead per name key that no tracked company has; blank keys are dropped."""
    c = F.col
    keyed = leads.withColumn("name_key", key(c("name"))).filter("name_key != ''")
    fresh = keyed.join(tracked.select(key(c("name")).alias("name_key")).distinct(), "name_key", "left_anti")
    rest = [x for x in fresh.columns if x != "name_key"]
    return fresh.groupBy("name_key").agg(F.min_by(F.struct(*rest), "seq").alias("f")).select("f.*", "name_key")


# --- country hints and candidate matching -------------------------------------------------------

def company_hints(postings: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Most frequent country (first seen on ties) and first careers page per company."""
    c = F.col
    keyed = postings.withColumns({"company_key": names.lookup_key(c("company")),
                                  "_country": classify.country_of_location(c("location"), aliases)}).filter("company_key != ''")
    # first seen counts among rows that name the country
    country = (keyed.filter("_country is not null").groupBy("company_key", "_country")
               .agg(F.count("*").alias("n"), F.min("seq").alias("first"))
               .groupBy("company_key").agg(F.min_by("_country", F.struct((-c("n")).alias("a"), c("first"))).alias("country")))
    page = keyed.groupBy("company_key").agg(
        F.min_by("company", "seq").alias("name"),
        F.min_by("companyUrl", F.when(F.coalesce("companyUrl", F.lit("")) != "", c("seq"))).alias("companyUrl"))
    return page.join(country, "company_key", "left")


def candidate_pairs(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Company and candidate pairs worth scoring: equal key, equal core, or key contained in the name.

    Containment is blocked on the longest word of the key, which the longer name must carry.
    """
    c = F.col
    left = companies.withColumns({"want": names.lookup_key(c("name")), "core": names.core_name(c("name"))})
    right = candidates.withColumns({"key": names.lookup_key(c("cand_name")), "ccore": names.core_name(c("cand_name"))})
    words = F.filter(F.split(c("want"), " "), lambda w: w != "")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    left = left.withColumn("k", F.explode(F.array_distinct(F.array(
        F.concat(F.lit("="), c("want")), F.concat(F.lit("~"), c("core")), F.concat(F.lit("+"), longest)))))
    tokens = F.transform(F.array_distinct(F.filter(F.split(c("key"), " "), lambda w: w != "")), lambda w: F.concat(F.lit("+"), w))
    right = right.withColumn("k", F.explode(F.concat(
        F.array(F.concat(F.lit("="), c("key")), F.concat(F.lit("~"), c("ccore"))), tokens)))
    fits = F.when(F.startswith("k", F.lit("+")), F.contains("key", c("want"))).otherwise(F.lit(True))
    cols = ["company_key", "want", "core", "country", "slug_key", "cand_id", "cand_name", "key", "ccore", "cand_country",
            "games", "logo", "start_date"]
    return left.join(right, "k").filter(fits).select(*cols).distinct()


def match_companies(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate per company (company_key, cand_id, via) or none when the evidence is thin.

    A candidate named inside the company's own handle wins first, the longest such name; then the best
    score, refused when only contained and not backed by country and catalogue; then a brand's largest
    branch in the hinted country. All three are minima over one set of scored pairs.
    """
    c = F.col
    pairs = candidate_pairs(companies, candidates)
    hinted, agrees = c("country").isNotNull(), c("cand_country") == c("country")
    bare = F.regexp_replace("key", "[^a-z0-9]", "")
    tie = (c("key") == c("want")) | (c("ccore") == c("core"))
    score = (F.when(c("key") == c("want"), 100).when((c("core") != "") & (c("ccore") == c("core")), 55).otherwise(5)
             + F.when(c("games") > 0, F.least(F.lit(30), 8 + c("games") * 3)).otherwise(0)
             + F.when(F.coalesce("logo", F.lit("")) != "", 12).otherwise(0) + F.when(c("start_date").isNotNull(), 4).otherwise(0)
             + F.when(hinted & agrees, 50).when(hinted & c("cand_country").isNotNull(), -12).otherwise(0))
    by_slug = (F.length(bare) >= 5) & F.contains("slug_key", bare) & (c("games") > 0)
    branch = hinted & agrees & (c("games") > 0) & F.startswith("key", F.concat(c("want"), F.lit(" ")))
    pick = F.struct("cand_id", "cand_name")
    scored = pairs.withColumns({"score": score, "tie": tie, "sound": tie | (hinted & F.coalesce(agrees, F.lit(False)) & (c("games") > 0))})
    best = scored.groupBy("company_key").agg(
        F.min_by(pick, F.when(by_slug, F.struct((-F.length(bare)).alias("a"), (-c("games")).alias("b"), c("cand_id")))).alias("slug"),
        F.min_by(F.struct("cand_id", "cand_name", "sound"), F.struct((-c("score")).alias("a"), c("cand_id"))).alias("top"),
        F.min_by(pick, F.when(branch, F.struct((-c("games")).alias("a"), c("cand_id")))).alias("branch"))
    via = F.when(c("slug").isNotNull(), "slug").when(c("top.sound"), "score").when(c("branch").isNotNull(), "brand")
    return best.select("company_key", via.alias("via"), F.coalesce(
        c("slug.cand_id"), F.when(c("top.sound"), c("top.cand_id")), c("branch.cand_id")).alias("cand_id")).filter("via is not null")


def merge_candidates(exact: DataFrame, widened: DataFrame, key: str = "cand_id") -> DataFrame:
    """Both candidate sets by id; the widened row replaces the exact one."""
    rest = [x for x in exact.columns if x != key]
    tagged = exact.withColumn("_o", F.lit(0)).unionByName(widened.withColumn("_o", F.lit(1)))
    return tagged.groupBy(key).agg(F.max_by(F.struct(*rest), "_o").alias("r")).select(key, "r.*")


def merge_shelf(titles: DataFrame) -> DataFrame:
    """Titles of one company by lower-case name: best figures, developer outranks publisher."""
    c = F.col
    return titles.groupBy("company_id", F.lower("name").alias("title_key")).agg(
        F.min_by("name", "seq").alias("name"), F.max("pop").alias("pop"), F.max("rating").alias("rating"),
        F.max("year").alias("year"),
        F.when(F.bool_or(c("role") == "developer"), "developer").otherwise(F.min_by("role", "seq")).alias("role"))


def top_shelf(shelf: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most popular titles per company. The rank window carries a group limit, so each task
    keeps at most ``n`` rows of a company before the shuffle."""
    from pyspark.sql import Window
    order = Window.partitionBy("company_id").orderBy(F.desc("pop"), F.desc("rating"), F.desc("year"), "title_key")
    return shelf.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


# --- coverage ledger ----------------------------------------------------------------------------

def ledger_open(hit: Column, conf: Column, missed: Column, rejected: Column, version: Column, current: int, all_ids: Column) -> Column:
    """Providers still to probe. An outdated record counts only its rejections; a trusted hit closes all."""
    none = F.array().cast("array<string>")
    rej = F.coalesce(rejected, none)
    return (F.when(version.isNull(), all_ids).when(version < current, F.array_except(all_ids, rej))
            .when((F.coalesce(hit, F.lit("")) != "") & classify.tier_trusted(F.coalesce(conf, F.lit(""))), none)
            .otherwise(F.array_except(F.array_except(all_ids, F.coalesce(missed, none)), rej)))


def merge_ledger(ledger: DataFrame, results: DataFrame, current: int, today: Column) -> DataFrame:
    """Fold one result per key into the ledger: misses add up unless the record is outdated, a fresh hit
    brings its confidence, an empty one keeps the old."""
    c = F.col
    none = F.array().cast("array<string>")
    new = results.select("key", c("name").alias("_name"), c("hit").alias("_hit"), c("hit_conf").alias("_conf"),
                         c("missed").alias("_missed"), F.lit(True).alias("_new"))
    both = ledger.join(new, "key", "full_outer")
    fresh = F.coalesce("_hit", F.lit("")) != ""
    base = F.when(c("version") >= current, F.coalesce("missed", none)).otherwise(none)
    changed = c("_new").isNotNull()
    return both.select(
        "key", F.coalesce("_name", "name").alias("name"),
        F.when(changed, F.lit(current)).otherwise(c("version")).alias("version"),
        F.when(fresh, c("_hit")).otherwise(F.coalesce("hit", F.lit(""))).alias("hit"),
        F.when(fresh, F.coalesce("_conf", F.lit(""))).otherwise(F.coalesce("hit_conf", F.lit(""))).alias("hit_conf"),
        F.when(changed, F.array_sort(F.array_union(base, F.coalesce("_missed", none)))).otherwise(c("missed")).alias("missed"),
        F.coalesce("rejected", none).alias("rejected"),
        F.when(changed, today.cast("string")).otherwise(c("last")).alias("last"))


def reject_hits(ledger: DataFrame, rejections: DataFrame, current: int, today: Column) -> DataFrame:
    """File a provider under rejected for its key and clear the hit when it was that provider."""
    c = F.col
    none = F.array().cast("array<string>")
    new = rejections.select("key", c("name").alias("_name"), c("provider").alias("_p"))
    both = ledger.join(new, "key", "full_outer")
    changed, clears = c("_p").isNotNull(), c("hit") == c("_p")
    return both.select(
        "key", F.coalesce(F.nullif("name", F.lit("")), c("_name")).alias("name"),
        F.when(changed, F.lit(current)).otherwise(c("version")).alias("version"),
        F.when(F.coalesce(clears, F.lit(False)), F.lit("")).otherwise(F.coalesce("hit", F.lit(""))).alias("hit"),
        F.when(F.coalesce(clears, F.lit(False)), F.lit("")).otherwise(F.coalesce("hit_conf", F.lit(""))).alias("hit_conf"),
        F.when(changed & (F.coalesce("version", F.lit(0)) < current), none).otherwise(F.coalesce("missed", none)).alias("missed"),
        F.when(changed, F.array_union(F.coalesce("rejected", none), F.array("_p"))).otherwise(F.coalesce("rejected", none)).alias("rejected"),
        F.when(changed, today.cast("string")).otherwise(c("last")).alias("last"))


def ledger_coverage(ledger: DataFrame, providers: list[str]) -> DataFrame:
    """Hits, cleared companies, total and last probe date per provider."""
    c = F.col
    cells = ledger.select("last", F.explode(F.array_union(
        F.transform(F.filter(F.array(c("hit")), lambda h: h != ""), lambda h: F.struct(h.alias("p"), F.lit(True).alias("h"))),
        F.transform(F.array_except(F.coalesce("missed", F.array().cast("array<string>")), F.array(c("hit"))),
                    lambda m: F.struct(m.alias("p"), F.lit(False).alias("h"))))).alias("x"))
    seen = cells.groupBy(c("x.p").alias("provider")).agg(
        F.count_if("x.h").alias("hit"), F.count_if(~c("x.h")).alias("cleared"),
        F.max(F.nullif("last", F.lit(""))).alias("last_probe"))
    wanted = ledger.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in providers])).alias("provider"))
    total = ledger.agg(F.count("*").alias("total"))
    return wanted.join(seen, "provider", "left").join(F.broadcast(total)).select(
        "provider", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("cleared", F.lit(0)).alias("cleared"), "total", "last_probe")


def merge_shards(shards: DataFrame) -> DataFrame:
    """Ledger shards of parallel runs folded by key. Sets are exploded and combined before they are
    listed, so a hot key lists its distinct providers only."""
    c = F.col
    has_hit = F.coalesce("hit", F.lit("")) != ""
    heads = shards.groupBy("key").agg(
        F.coalesce(F.min_by("name", F.when(c("name") != "", c("shard"))), F.lit("")).alias("name"),
        F.max("version").alias("version"), F.coalesce(F.min_by("hit", F.when(has_hit, c("shard"))), F.lit("")).alias("hit"),
        F.coalesce(F.min_by("hit_conf", F.when(has_hit, c("shard"))), F.lit("")).alias("hit_conf"), F.max("last").alias("last"))

    def listed(column: str) -> DataFrame:
        return (shards.select("key", F.explode(column).alias("v")).distinct()
                .groupBy("key").agg(F.array_sort(F.collect_list("v")).alias(column)))

    none = F.array().cast("array<string>")
    out = reduce(lambda d, s: d.join(listed(s), "key", "left"), ["missed", "rejected"], heads)
    return out.withColumns({s: F.coalesce(s, none) for s in ("missed", "rejected")})


def merge_hit_store(store: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Pending hits by name and page: first sighting kept, last sighting and details refreshed."""
    key = F.concat(F.lower(F.trim("name")), F.lit("|"), F.coalesce("careers_url", F.lit("")))
    fresh = hits.filter((F.coalesce("careers_url", F.lit("")) != "") & (F.coalesce("provider", F.lit("")) != "")).select(
        "name", "careers_url", "provider", now.alias("first_seen"), now.alias("last_seen"), F.lit(1).alias("_o"))
    both = store.select("name", "careers_url", "provider", "first_seen", "last_seen").withColumn("_o", F.lit(0)).unionByName(fresh)
    return both.groupBy(key.alias("key")).agg(
        F.max_by(F.struct("name", "careers_url", "provider"), F.struct("_o", "name", "provider")).alias("m"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).select("key", "m.*", "first_seen", "last_seen")


def remaining(companies: DataFrame, known: DataFrame, misses: DataFrame, key: str = "key") -> DataFrame:
    """Companies neither known nor recorded as a miss."""
    return companies.join(known.select(key).distinct(), key, "left_anti").join(misses.select(key).distinct(), key, "left_anti")


def vet_hits(hits: DataFrame, tracked_hosts: DataFrame, signals=classify.COUNTRY_SIGNALS,
             content: str = classify.CONTENT_SIGNAL) -> DataFrame:
    """Hits on untracked hosts; a medium one becomes 'verify' when country or titles speak against it."""
    c = F.col
    host = F.regexp_replace(F.lower("where"), r"^www\.", "")
    open_hits = hits.withColumn("_h", F.split_part(host, F.lit("/"), F.lit(1))).join(
        tracked_hosts.select(c("host").alias("_h")).distinct(), "_h", "left_anti")
    medium = c("confidence") == "medium"
    wrong_place = medium & classify.country_contradicts(c("country"), c("loc"), signals)
    any_signal = F.exists("titles", lambda t: F.rlike(t, F.lit(java_pattern(content))))
    off_topic = medium & ~wrong_place & (F.coalesce(F.size("titles"), F.lit(0)) > 0) & ~any_signal
    place = F.when(wrong_place, F.concat(F.lit("loc '"), c("loc"), F.lit("' ≠ "), c("country")))
    topic = F.when(off_topic, F.concat(F.lit("no domain signal in "), F.size("titles").cast("string"), F.lit(" title(s)")))
    return open_hits.select("name", "where", F.when(wrong_place | off_topic, "verify").otherwise(c("confidence")).alias("confidence"),
                            F.nullif(F.concat_ws("; ", place, topic), F.lit("")).alias("flag"))
