"""From collected postings to one de-duplicated snapshot and the list of new postings.

``seq`` is the order in which postings were found, a value of its own for each (of rows that share one and all a rule looks at, one stays); every "first wins" rule is a minimum over it. Groups
can be hot (one link, title or employer may hold a third of all rows), so winners come from partial
aggregates, and no group is ever gathered into one task. The rules run on narrow rows of ids and keys; whole rows are joined to the survivors once.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import names, urls
from ..functions.text import first_segment_fold, fold
from ..session import stored
from . import classify

# Boards that list many employers, and those without a usable link to the source.
AGGREGATORS = ["hitmarker.net", "workwithindies.com", "remotegamejobs.com", "gamesjobsdirect.com",
               "ingamejob.com", "gamejobs.co", "gamedevjobs.com"]
LAST_RESORT = ["gamedevjobs.com"]


def on_aggregator(url: Column, aggregators=AGGREGATORS, last_resort=LAST_RESORT) -> Column:
    return urls.on_hosts(urls.host(url), [*aggregators, *last_resort])


def on_last_resort(url: Column, last_resort=LAST_RESORT) -> Column:
    return urls.on_hosts(urls.host(url), list(last_resort))


def _is_number(narrow: DataFrame) -> bool:
    """Whether the order ``_at`` is its own id; a frame that has left it out has such an order."""
    return "_at" not in narrow.columns or isinstance(narrow.schema["_at"].dataType, (T.IntegralType, T.DecimalType))


def numbered(df: DataFrame, order: Column, **columns: Column) -> DataFrame:
    """The narrow side of a first-wins rule: ``columns``, ``_at`` (the order) and ``id``, a number that ascends with it.

    Minima over a number are hash aggregates. An order that is a number already is its own id; any other is sorted over ranges once, before anything is derived.
    """
    rows = df.withColumn("_at", order)
    derived = [v.alias(k) for k, v in columns.items()]
    if _is_number(rows):
        return rows.select("_at", F.col("_at").alias("id"), *derived)
    ranged = rows.repartitionByRange("_at").sortWithinPartitions("_at")
    return stored(ranged.select("_at", F.monotonically_increasing_id().alias("id"), *derived))


def _located(narrow: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``seq``, the order, in place of ``id``."""
    if _is_number(narrow):
        return found.withColumnRenamed("id", "seq")
    return found.join(narrow.select("id", F.col("_at").alias("seq")), "id").drop("id")


def _identified(df: DataFrame, order: Column) -> DataFrame:
    """``df`` with ``_id``, a number that ascends with ``order``. Rows whose order is no number are sorted and stored once, so that they are neither made nor numbered again."""
    rows = df.withColumn("_at", order)
    if _is_number(rows):
        return rows.withColumnRenamed("_at", "_id")
    return stored(rows.repartitionByRange("_at").sortWithinPartitions("_at").withColumn("_id", F.monotonically_increasing_id()).drop("_at"))


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One of the rows that share ``keys``, where an order is not a value of its own. The join before it has dealt and sorted the rows by these keys already."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))).filter("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First row of each key by ``order``. Keys and ids are aggregated, and the rows follow by one semi join."""
    narrow = numbered(df, order, **{k: F.col(k) for k in keys})
    first = _located(narrow, narrow.groupBy(*keys).agg(F.min("id").alias("id"))).select(F.col("seq").alias("_first"), *[F.col(k).alias(f"_key_{k}") for k in keys])
    mine = df.withColumn("_at", order)
    same = reduce(lambda a, b: a & b, [mine[k].eqNullSafe(first[f"_key_{k}"]) for k in keys], mine["_at"] == first["_first"])
    return _one_each(mine.join(first, same, "left_semi"), ["_at", *keys]).select(*df.columns)


def digest(*parts: Column) -> Column:
    """128 bits that stand for a tuple of strings as a join or group key."""
    return F.unhex(F.md5(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("\u0001")) for p in parts])))


# --- collection and overlay ---------------------------------------------------------------------

def union_postings(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def overlay_detail(postings: DataFrame, detail: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Non-empty detail values replace the posting's; rows proved dead go, a missing detail never drops."""
    patch = detail.select(key, F.coalesce("drop", F.lit(False)).alias("_drop"),
                          *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = postings.join(patch, key, "left").filter(~F.coalesce("_drop", F.lit(False)))
    return joined.withColumns(
        {f: F.coalesce(F.when(F.col(f"_new_{f}").cast("string") != "", F.col(f"_new_{f}")), F.col(f)) for f in fields}
    ).select(*postings.columns)


def merge_same_url(postings: DataFrame) -> DataFrame:
    """One row per url: the first, flagged only when every copy was flagged."""
    given = postings.filter(F.coalesce("url", F.lit("")) != "")
    narrow = numbered(given, F.col("seq"), url=F.col("url"), filtered=F.coalesce("filtered", F.lit(False)))
    merged = narrow.groupBy("url").agg(F.min("id").alias("id"), F.bool_and("filtered").alias("_all"))
    return _one_each(given.join(_located(narrow, merged), ["seq", "url"]), ["seq", "url"]).withColumn("filtered", F.col("_all")).select(*postings.columns)


def merge_offices(postings: DataFrame) -> DataFrame:
    """Same employer and title: offices joined by ' / ' in order found, freshest date, first row's rest.

    Only the distinct offices of a role meet in one row.
    """
    c = F.col
    company = F.lower(F.trim(F.coalesce("company", F.lit(""))))
    named = postings.filter(company != "")
    role = digest(company, fold(c("title")))
    named = _identified(named, c("seq"))
    narrow = named.select(c("_id").alias("id"), role.alias("role"), "location", "postedDate")
    offices = F.filter(F.transform(F.split(F.coalesce("location", F.lit("")), " / "), lambda x: F.trim(x)), lambda x: x != "")
    # in a row only the first spelling of an office counts; a row without offices has one line, and lines are read three times but made once
    lines = stored(narrow.withColumn("_o", offices).select("role", "id", "postedDate", F.posexplode_outer(
        F.filter("_o", lambda x, i: F.array_position(F.transform("_o", lambda y: F.lower(y)), F.lower(x)) == i + 1)).alias("p", "o")))
    # orders may repeat between roles, so rows are found by both
    heads = lines.groupBy("role").agg(F.min("id").alias("id"), F.max("postedDate").alias("_date"), F.count_if(F.coalesce("p", F.lit(0)) == 0).alias("_n"))
    once = lines.filter("o is not null and id is not null").select("role", "id", "p", "o")
    # a task passes on one spelling per office and role
    first = once.withColumn("_rank", F.rank().over(Window.partitionBy("role", F.lower("o")).orderBy("id", "p"))).filter("_rank = 1")
    listed = (first.groupBy("role")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "p", "o"))), lambda x: x["o"]), " / ").alias("_locs")))
    # beside its order, 64 bits tell a role
    kept = heads.join(listed, "role", "left").select(c("id").alias("_id"), F.xxhash64("role").alias("_role"), "_date", "_n", F.when(c("_n") != 1, F.coalesce("_locs", F.lit(""))).alias("_locs"))
    merged = (_one_each(named.withColumn("_role", F.xxhash64(role)).join(kept, ["_id", "_role"]), ["_id", "_role"])
              .withColumn("location", F.when(c("_n") == 1, c("location")).otherwise(c("_locs")))
              .withColumn("postedDate", c("_date")).select(*postings.columns))
    return merged.unionByName(postings.filter(company == ""))


# --- de-duplication passes ----------------------------------------------------------------------

def _apply_link(df: DataFrame) -> Column:
    apply_url = F.trim(F.coalesce("applyUrl", F.lit("")))
    return urls.link_key(F.when(apply_url != "", apply_url).otherwise(F.col("url")))


def posting_facts(postings: DataFrame, aggregators=AGGREGATORS, last_resort=LAST_RESORT, aliases=None,
                  codes: dict[str, str] | None = None) -> DataFrame:
    """What the passes compare, one narrow row per posting: id, link, number, employer, title, city, countries and kind of host.

    Later passes only move ids and 128-bit keys; postings are read again when the survivors are known.
    """
    c = F.col
    host = urls.host(c("url"))
    agg, last = urls.on_hosts(c("host"), [*aggregators, *last_resort]), urls.on_hosts(c("host"), list(last_resort))
    raw = numbered(postings, c("seq"), host=host, url=c("url"), company=c("company"), title=c("title"), location=c("location"), link=_apply_link(postings))
    # countries are appended behind a place, so its city may only change where no comma ends it
    bare = F.when(~F.contains("location", F.lit(",")) & (F.size("codes") > 0), c("location"))
    return stored(raw.withColumns({"agg": agg, "last": last, "alias": names.alias_fold(c("company"), aliases), "company_key": fold(c("company")),
                                   "title_key": digest(fold(c("title"))), "codes": classify.countries_named(c("location"), codes)}).select(
        "id", *([] if _is_number(raw) else ["_at"]), "agg", "last", "alias", "company_key", "title_key", first_segment_fold(c("location")).alias("city"),
        bare.alias("bare"), "codes", F.when(c("link").isNotNull(), digest(c("link"))).alias("link"), F.when(~c("agg"), urls.posting_id(c("url"))).alias("number")))


def _mentions(linked: DataFrame) -> DataFrame:
    """(link, named): the countries of a link's rows as they were found, where there are several."""
    c = F.col
    return (linked.select("link", "id", F.posexplode("codes").alias("pos", "code")).groupBy("link", "code")
            .agg(F.min("id").alias("first"), F.min_by("pos", "id").alias("pos")).groupBy("link")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "pos", "code"))), lambda x: x["code"]).alias("named")).filter(F.size("named") > 1))


def _link_winners(facts: DataFrame) -> DataFrame:
    """(id, named): one row per application link, a direct one before others, then the first; ``named`` lists the link's countries as they were found."""
    c = F.col
    linked = facts.filter(c("link").isNotNull())
    wins = linked.groupBy("link").agg(F.min(F.when(~c("agg"), c("id"))).alias("direct"), F.min("id").alias("first"))
    own = wins.join(_mentions(linked), "link", "left").select(F.coalesce("direct", "first").alias("id"), "named")
    return own.unionByName(facts.filter(c("link").isNull()).select("id", F.lit(None).cast("array<string>").alias("named")))


def _widened(location: Column, own: Column, named: Column, codes: dict[str, str]) -> Column:
    """A place with the countries of the dropped rows, only where its own country is known."""
    shown = F.create_map(*[F.lit(x) for pair in classify.display_names(codes).items() for x in pair])
    extra = F.array_except(F.coalesce(named, F.array().cast("array<string>")), own)
    return F.when((F.size(own) > 0) & (F.size(extra) > 0), F.concat(
        location, F.lit(" / "), F.array_join(F.transform(extra, lambda x: F.try_element_at(shown, x)), " / "))).otherwise(location)


def collapse_links(postings: DataFrame, aggregators=AGGREGATORS, last_resort=LAST_RESORT,
                   codes: dict[str, str] | None = None) -> DataFrame:
    """Rows that lead to one application link become one; countries of the dropped ones are kept.

    A direct row is preferred as survivor, then the first found. Countries are appended only when the survivor's own country is known.
    """
    c = F.col
    narrow = numbered(postings, c("seq"), agg=on_aggregator(c("url"), aggregators, last_resort), codes=classify.countries_named(c("location"), codes), link=_apply_link(postings))
    kept = _located(narrow, _link_winners(narrow))
    place = _widened(c("location"), classify.countries_named(c("location"), codes), c("_named"), codes)
    return (postings.join(kept.withColumnRenamed("named", "_named"), "seq")
            .withColumn("location", F.when(c("_named").isNull(), c("location")).otherwise(place)).select(*postings.columns))


def _number_losers(facts: DataFrame) -> DataFrame:
    """Ids of direct rows whose employer has an earlier one with the same requisition number."""
    wanted = facts.filter("number is not null").select("id", digest(F.col("alias"), F.col("number")).alias("key"))
    shared = wanted.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return wanted.join(shared, "key").filter("id <> first").select("id")


def collapse_ids(postings: DataFrame, aggregators=AGGREGATORS, last_resort=LAST_RESORT, aliases=None) -> DataFrame:
    """Direct rows of one employer with one requisition number: the first stays."""
    c = F.col
    number = F.when(~on_aggregator(c("url"), aggregators, last_resort), urls.posting_id(c("url")))
    facts = numbered(postings, c("seq"), number=number, alias=names.alias_fold(c("company"), aliases))
    return postings.join(_located(facts, _number_losers(facts)), "seq", "left_anti")


# --- mirrors ------------------------------------------------------------------------------------

EMPLOYER = ["company_key", "alias"]


def _employer_keys(employers: DataFrame, inner: str, outer: str, word: str, letters: str) -> DataFrame:
    """(company_key, alias, roles, kind, key, core): the ways in which an employer may be found under another spelling. ``core`` is the set of words that ``_words_fit`` asks for."""
    c = F.col

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    longest = F.array_max(F.transform(c("core"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    by_core = F.when(F.size("core") > 0, F.concat(
        F.array(key(inner, longest)), F.transform(F.array_distinct(c("core")), lambda t: key(outer, t)),
        F.array(key(letters, names.initials(c("core"))), F.when(F.size("core") == 1, key(word, F.get(c("core"), F.lit(0)))))))
    # one name in two spellings of an alias; names without words of their own have no other way
    own = key("fold", c("alias"))
    found = employers.select(*EMPLOYER, "roles", "core", F.explode(F.concat(F.array(own), F.coalesce(by_core, F.array().cast("array<struct<kind:string,key:string>>")))).alias("k"))
    # only where one word set must lie inside the other, or names must differ, are the words needed once more
    needed = F.when(c("k.kind").isin("inside", "around", "fold"), F.array_distinct("core"))
    return found.filter("k is not null").select(*EMPLOYER, "roles", "k.kind", "k.key", needed.alias("core")).distinct()


def _words_fit(one: str, two: str) -> Column:
    """Whether the words of an employer lie inside another's, where the way asks for it. Equal sets are found from inside."""
    c = F.col
    return (F.when(c(f"{one}.kind") == "inside", F.size(F.array_except(f"{one}.core", f"{two}.core")) == 0)
            .when(c(f"{one}.kind") == "around", (F.size(f"{two}.core") < F.size(f"{one}.core")) & (F.size(F.array_except(f"{two}.core", f"{one}.core")) == 0)).otherwise(F.lit(True)))


def _ways(probes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ways of either side that lead to an employer of the other; all others are left out before they are multiplied by titles."""
    c = F.col
    p, t = probes.alias("p"), targets.alias("t")
    # one name found by its own words needs no second way to itself
    apart = (c("p.kind") != "fold") | (c("p.company_key") != c("t.company_key")) | (F.size("p.core") == 0)
    meet = (c("p.kind") == c("t.kind")) & (c("p.key") == c("t.key")) & apart & _words_fit("p", "t")
    return tuple(side.withColumn("core", F.when(c("kind") != "fold", c("core"))).drop("roles") for side in (p.join(t, meet, "left_semi"), t.join(p, meet, "left_semi")))


def _covered(mirrors: DataFrame, sources: DataFrame, probes: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids of the shapes among ``mirrors`` that a shape of ``sources`` covers: same title, fitting employer and city.

    Each way to fit is an equi key (same fold, one word set inside the other by its longest word, initials), and a blank city meets any city through a
    wild key, so that no title group is compared pair by pair. Title, way and city are one key of 128 bits.
    """
    c = F.col
    key = digest(F.hex("title_key"), c("kind"), c("key"), c("at"))
    asked = (mirrors.join(probes, EMPLOYER).withColumn("at", F.explode(F.when(c("city") == "", F.array(F.lit("*"))).otherwise(F.array(c("city"), F.lit("")))))
             .select(_shape().alias("shape"), key.alias("k"), "kind", "core"))
    there = sources.join(targets, EMPLOYER).withColumn("at", F.explode(F.array(c("city"), F.lit("*")))).select(key.alias("k"), "kind", "core")
    return asked.alias("m").join(there.alias("s"), (c("m.k") == c("s.k")) & _words_fit("m", "s"), "left_semi").select("shape").distinct()


def _shape() -> Column:
    """A key for title, employer and city."""
    return digest(F.hex("title_key"), F.col("company_key"), F.col("alias"), F.col("city"))


DIRECT, NORMAL, LOWEST = 1, 2, 4


def _mirror_tiers(rows: DataFrame) -> DataFrame:
    """(shape, t1, t2): whether a direct shape, or one of a better board, covers the shape. ``rows`` has agg, last, alias, company_key, title_key, city."""
    c = F.col

    def having(df: DataFrame, roles: int) -> DataFrame:
        return df.filter(c("roles").bitwiseAND(F.lit(roles)) != 0)
    role = F.when(~c("agg"), DIRECT).when(c("last"), LOWEST).otherwise(NORMAL)
    shapes = stored(rows.filter(c("company_key") != "").groupBy("title_key", *EMPLOYER, "city").agg(F.bit_or(role).alias("roles")))
    employers = shapes.groupBy(*EMPLOYER).agg(F.bit_or("roles").alias("roles")).withColumn("core", names.core_tokens(c("company_key")))
    probes = stored(_employer_keys(employers, "inside", "around", "word", "letters"))
    targets = stored(_employer_keys(employers, "around", "inside", "letters", "word"))

    def tier(mirrors: int, sources: int) -> DataFrame:
        return _covered(having(shapes, mirrors), having(shapes, sources), *_ways(having(probes, mirrors), having(targets, sources)))
    tier1 = tier(NORMAL | LOWEST, DIRECT).withColumn("t1", F.lit(True))
    tier2 = tier(LOWEST, NORMAL).withColumn("t2", F.lit(True))
    return stored(tier1.join(tier2, "shape", "full_outer"))


def _tier() -> Column:
    return F.when(F.col("agg") & F.col("t1"), 1).when(F.col("last") & F.col("t2"), 2)


def mark_mirrors(postings: DataFrame, aggregators=AGGREGATORS, last_resort=LAST_RESORT, aliases=None) -> DataFrame:
    """Add ``mirror_tier``: 1 when a direct row covers an aggregator row, 2 when a better aggregator covers a last-resort row, NULL when the row stays."""
    c = F.col
    agg, last = on_aggregator(c("url"), aggregators, last_resort), on_last_resort(c("url"), last_resort)
    facts = {"agg": agg, "last": last, "alias": names.alias_fold(c("company"), aliases), "company_key": fold(c("company")),
             "title_key": digest(fold(c("title"))), "city": first_segment_fold(c("location"))}
    tiers = _mirror_tiers(postings.select(*[v.alias(k) for k, v in facts.items()]))
    rows = postings.select(F.struct(*postings.columns).alias("row"), *[v.alias(k) for k, v in facts.items()])
    return rows.withColumn("shape", _shape()).join(tiers, "shape", "left").select("row.*", _tier().alias("mirror_tier"))


def drop_mirrors(postings: DataFrame, **config) -> DataFrame:
    return mark_mirrors(postings, **config).filter(F.col("mirror_tier").isNull()).drop("mirror_tier")


def _held(facts: DataFrame, codes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """What is left of ``facts`` after the first pass, and (id, seq, named, gone, times) of these rows: the later pass that removes each (id, title) or NULL.

    The first row of a link takes its narrow row along, and a task passes on one row per link, so that no group is gathered and nothing is joined by id. ``times`` is
    how often a mark is listed: once, but for orders that repeat once per pairing of their copies.
    """
    c = F.col
    given = facts.filter("id is not null").withColumn("link", F.coalesce("link", digest(c("id"))))
    # a direct row before others, then the first
    firsts = given.withColumn("_rank", F.rank().over(Window.partitionBy("link").orderBy("agg", "id"))).filter("_rank = 1")
    counted = firsts.withColumn("copies", F.count("*").over(Window.partitionBy("link")))
    city = F.when(c("named").isNotNull() & c("bare").isNotNull(), first_segment_fold(_widened(c("bare"), c("codes"), c("named"), codes))).otherwise(c("city"))
    seq = c("id") if _is_number(facts) else c("_at")
    linked = stored(counted.join(_mentions(given), "link", "left").select(
        "id", *([] if _is_number(facts) else ["_at"]), "agg", "last", "alias", "company_key", "title_key", city.alias("city"), "number", "named", "copies"))
    doubles = stored(_number_losers(linked).distinct())
    rest = linked.join(doubles, "id", "left_anti")
    boards = rest.filter("agg").withColumn("shape", _shape()).join(_mirror_tiers(rest), "shape", "left").withColumn("gone", F.when(_tier().isNotNull(), "title"))
    parts = [boards, rest.filter("not agg").withColumn("gone", F.lit(None).cast("string")), linked.join(doubles, "id", "left_semi").withColumn("gone", F.lit("id"))]
    times = F.when(c("gone").isNull(), c("copies")).otherwise(c("copies") * c("copies"))
    return linked, union_postings([p.select("id", seq.alias("seq"), "named", "gone", times.alias("times")) for p in parts])


def _listed(held: DataFrame) -> DataFrame:
    return held.withColumn("_time", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).drop("_time")


def snapshot_marks(postings: DataFrame, aggregators=AGGREGATORS, last_resort=LAST_RESORT, aliases=None,
                   codes: dict[str, str] | None = None) -> DataFrame:
    """(seq, named, gone): the pass that removes each posting (link, id, title) or NULL, and the countries of its link's rows for those that stay.

    Links, then requisition numbers, then mirrors, all on one narrow table.
    """
    facts = posting_facts(postings, aggregators, last_resort, aliases, codes)
    _, held = _held(facts, codes)
    every = facts.select("id", F.col("id" if _is_number(facts) else "_at").alias("seq"))
    late = every.join(held.select("id"), "id", "left_anti").select("seq", F.lit(None).cast("array<string>").alias("named"), F.lit("link").alias("gone"))
    return _listed(held).select("seq", "named", "gone").unionByName(late)


def dedupe_snapshot(postings: DataFrame, aggregators=AGGREGATORS, last_resort=LAST_RESORT, aliases=None, codes: dict[str, str] | None = None) -> DataFrame:
    """The postings that no pass removes; survivors of a link name the countries of the others."""
    c = F.col
    codes = classify.country_codes() if codes is None else codes
    _, held = _held(posting_facts(postings, aggregators, last_resort, aliases, codes), codes)
    kept = _listed(held.filter("gone is null")).select("seq", c("named").alias("_named"))
    place = _widened(c("location"), classify.countries_named(c("location"), codes), c("_named"), codes)
    return postings.join(kept, "seq").withColumn("location", F.when(c("_named").isNull(), c("location")).otherwise(place)).select(*postings.columns)


def dedupe_counts(postings: DataFrame, aggregators=AGGREGATORS, last_resort=LAST_RESORT, aliases=None, codes: dict[str, str] | None = None) -> DataFrame:
    """One row with the rows each pass removed."""
    gone = F.col("gone")
    facts = posting_facts(postings, aggregators, last_resort, aliases, codes)
    linked, held = _held(facts, codes)
    times = [F.coalesce(F.sum(F.when(when, F.col("times"))), F.lit(0)).alias(name) for name, when in (("by_id", gone == "id"), ("by_title", gone == "title"), ("kept", gone.isNull()))]
    by_link = facts.agg(F.count("*").alias("all")).crossJoin(linked.agg(F.count("*").alias("left"))).select((F.col("all") - F.col("left")).alias("by_link"))
    return by_link.crossJoin(held.agg(*times))


# --- history ------------------------------------------------------------------------------------

TOMBSTONE = "skipped_expired"


def seen_urls(history: DataFrame, *others: DataFrame) -> DataFrame:
    """Every url known from the history (expired rows may come back) and other url tables."""
    known = history.filter(F.coalesce("status", F.lit("")) != TOMBSTONE).select("url")
    return union_postings([known, *[o.select("url") for o in others]]).filter(F.coalesce("url", F.lit("")) != "").distinct()


def unseen(postings: DataFrame, seen: DataFrame) -> DataFrame:
    return postings.join(seen.select("url").distinct(), "url", "left_anti")


def pair_key(company: Column, title: Column) -> Column:
    return F.concat(F.lower(F.coalesce(company, F.lit(""))), F.lit("::"), F.lower(F.coalesce(title, F.lit(""))))


def untracked(postings: DataFrame, tracked: DataFrame) -> DataFrame:
    """Postings whose employer and title are not in the tracker (columns company, role)."""
    pairs = tracked.select(pair_key(F.trim("company"), F.trim("role")).alias("_pair")).distinct()
    return (postings.withColumn("_pair", pair_key(F.col("company"), F.col("title")))
            .join(pairs, "_pair", "left_anti").drop("_pair"))


def first_wins(postings: DataFrame) -> DataFrame:
    """Keep a row iff no kept earlier row shares its url or its employer and title.

    The row-by-row rule equals a greedy matching between urls and titles in ``seq`` order. Each round
    keeps the rows that are first both among the open rows of their url and of their title, then removes
    what they block; rows of equal url and title are reduced to the first one beforehand.
    """
    c = F.col
    # urls and titles as keys of 128 bits: every round moves them several times
    pairs = (postings.select(digest(c("url")).alias("url"), digest(pair_key(c("company"), c("title"))).alias("_pair"), "seq")
             .filter("seq is not null").groupBy("url", "_pair").agg(F.min("seq").alias("seq")))
    open_rows, kept = stored(pairs), []
    while not open_rows.isEmpty():
        by_url = open_rows.groupBy("url").agg(F.min("seq").alias("_u"), F.count("*").alias("_nu"))
        by_pair = open_rows.groupBy("_pair").agg(F.min("seq").alias("_p"), F.count("*").alias("_np"))
        won = (c("seq") == c("_u")) & (c("seq") == c("_p"))
        # of the rows that win, only keys that others share can block any
        judged = stored(open_rows.join(by_url, "url").join(by_pair, "_pair").withColumn("won", won).select(
            F.when(~c("won") | (c("_nu") > 1), c("url")).alias("url"), F.when(~c("won") | (c("_np") > 1), c("_pair")).alias("_pair"), "seq", "won"))
        wins = judged.filter("won")
        kept.append(wins)
        open_rows = stored(judged.filter("not won").drop("won").join(wins.filter("url is not null").select("url"), "url", "left_anti")
                                .join(wins.filter("_pair is not null").select("_pair"), "_pair", "left_anti"))
    winners = union_postings(kept).select("seq") if kept else pairs.select("seq").limit(0)
    return postings.join(winners, "seq", "left_semi")


# --- company pages ------------------------------------------------------------------------------

def company_pages(companies: DataFrame, aggregators=AGGREGATORS) -> DataFrame:
    """Landing page per employer name, plus names without a bracketed part where that is unambiguous."""
    c = F.col
    landing = F.when(F.trim(F.coalesce("job_url_template", F.lit(""))) != "",
                     urls.template_prefix(c("job_url_template"))).otherwise(c("careers_url"))
    usable = companies.filter((F.coalesce("name", F.lit("")) != "") & (urls.host(c("careers_url")) != "")
                              & ~urls.on_hosts(urls.host(c("careers_url")), aggregators)).select(
        F.lower(F.trim("name")).alias("key"), landing.alias("page"), "seq")
    exact = usable.groupBy("key").agg(F.min_by("page", "seq").alias("page"))
    alias = (usable.withColumn("alias", F.trim(F.regexp_replace("key", r"\s*\([^)]*\)\s*", " ")))
             .filter((c("alias") != "") & (c("alias") != c("key")))
             .groupBy(c("alias").alias("key")).agg(F.count("*").alias("n"), F.min_by("page", "seq").alias("page"))
             .filter("n = 1").drop("n"))
    return exact.unionByName(alias.join(exact, "key", "left_anti"))


def with_company_page(postings: DataFrame, companies: DataFrame) -> DataFrame:
    pages = company_pages(companies).withColumnRenamed("page", "companyUrl")
    return (postings.withColumn("key", F.lower(F.trim(F.coalesce("company", F.lit("")))))
            .join(pages, "key", "left").drop("key"))


def twin_slugs(rows: DataFrame, slug: str = "slug") -> DataFrame:
    """Drop 'slug-2' style rows only where the bare slug is present too."""
    bare = F.regexp_extract(F.col(slug), r"^(.*)-\d+$", 1)
    present = rows.select(F.col(slug).alias("_bare")).distinct()
    return (rows.withColumn("_bare", F.when(bare != "", bare))
            .join(present, "_bare", "left_anti").select(*rows.columns))


# --- reposts ------------------------------------------------------------------------------------

def repost_counts(postings: DataFrame, days: int = 90) -> DataFrame:
    """Per employer, folded title, url and day: earlier postings under another url within ``days``.

    Rows are first counted per day, so a window never holds more rows than there are days, whatever the
    size of the employer.
    """
    c = F.col
    role = ["company", "role_key"]
    daily = (postings.withColumns({"role_key": fold(c("title")), "day": c("postedDate").cast("date")})
             .groupBy(*role, "url", "day").agg(F.count("*").alias("n")))
    number = F.unix_date("day")

    def before(keys: list[str]):
        return Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, -1)

    total = (daily.groupBy(*role, "day").agg(F.sum("n").alias("day_n"))
             .withColumn("_all", F.coalesce(F.sum("day_n").over(before(role)), F.lit(0))).drop("day_n"))
    own = daily.withColumn("_own", F.coalesce(F.sum("n").over(before([*role, "url"])), F.lit(0)))
    return (own.join(total, [*role, "day"]).select(
        *role, "url", "day", "n", (c("_all") - c("_own")).alias("reposts")))
