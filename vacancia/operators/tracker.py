"""Application tracker: merging additions, clustering repeats, matching reports, urls and follow-ups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import names
from ..functions.dates import strict_date
from ..functions.numbers import first_number
from ..functions.patterns import let
from ..session import cut_lineage, stored
from . import classify

REPORT_NUMBER = r"\[(\d+)\]"
LINK_TARGET = r"\]\(([^)]+)\)"


def report_number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), REPORT_NUMBER, 1).try_cast("long")


def link_target(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), LINK_TARGET, 1), F.lit(""))


def rewrite_links(c: Column, prefix: str) -> Column:
    """Report links made relative to the tracker's folder: ``prefix`` is '' or '../' as it sits."""
    return F.regexp_replace(c, r"\]\((?:\.\./)*(reports/[^)]+)\)", f"](" + prefix + "$1)")


# --- merge of additions -------------------------------------------------------------------------

def _word_pairs(words: Column, leading: bool) -> Column:
    """Pairs of words as join keys. A word counts twice only where the leading side repeats it."""
    def pairs(distinct: Column) -> Column:
        crossed = F.flatten(F.transform(distinct, lambda a, i: F.transform(
            F.slice(distinct, i + 2, F.size(distinct)), lambda b: F.concat(a, F.lit(" "), b))))
        twice = F.filter(distinct, lambda a: F.size(F.filter(words, lambda w: w == a)) > 1) if leading else distinct
        return F.concat(crossed, F.transform(twice, lambda a: F.concat(a, F.lit(" "), a)))

    return let(F.array_sort(F.array_distinct(words)), pairs)


def match_additions(additions: DataFrame, existing: DataFrame) -> DataFrame:
    """``additions`` with ``match``: the existing row each refers to, NULL for a new entry.

    Report number, then entry number, then employer with a similar role; within a tier the first row in
    tracker order. Roles are compared once per distinct wording, blocked on the employer and two words
    they must share, and reduced to the first match while they are joined.
    """
    c = F.col
    app = F.struct(*[c(x) for x in existing.columns])
    by_report = (existing.withColumn("_rep", report_number(c("report"))).filter("_rep is not null")
                 .groupBy("_rep").agg(F.min_by(app, "pos").alias("_m1")))
    by_num = existing.groupBy(c("num").alias("_num")).agg(F.min_by(app, "pos").alias("_m2"))

    def worded(df: DataFrame) -> DataFrame:
        return df.withColumns({"_co": names.alnum_key(c("company")), "_words": names.merge_role_words(c("role"))})

    adds = worded(additions).withColumn("_rep", report_number(c("report")))
    shapes_a = adds.filter(F.size("_words") > 1).select("_co", "_words").distinct()
    shapes_e = (worded(existing).filter(F.size("_words") > 0)
                .groupBy("_co", c("_words").alias("_their")).agg(F.min("pos").alias("_pos")))
    similar = (shapes_a.withColumn("_pair", F.explode(_word_pairs(c("_words"), True)))
               .join(shapes_e.withColumn("_pair", F.explode(_word_pairs(c("_their"), False))), ["_co", "_pair"])
               .filter(names.role_words_match(c("_words"), c("_their"), names.BASELINE))
               .groupBy("_co", "_words").agg(F.min("_pos").alias("_pos")))
    by_role = similar.join(existing.select(c("pos").alias("_pos"), app.alias("_m3")), "_pos")
    return (adds.join(by_report, "_rep", "left").join(by_num, adds["num"] == c("_num"), "left")
            .join(by_role, ["_co", "_words"], "left")
            .select(*additions.columns, F.coalesce("_m1", "_m2", "_m3").alias("match")))


def updates(matched: DataFrame) -> DataFrame:
    """First strictly better addition per existing row; later ones change nothing."""
    c = F.col
    better = matched.filter(c("match").isNotNull()).withColumns({
        "new_score": first_number(c("score")), "old_score": first_number(c("match.score"))}).filter("new_score > old_score")
    rows = [x for x in better.columns if x != "match"]
    return (better.groupBy(c("match.pos").alias("pos"))
            .agg(F.min_by(F.struct(*rows, "match"), "file_seq").alias("a"))
            .select("pos", c("a.match.num").alias("num"), c("a.date").alias("date"), c("a.company").alias("company"),
                    c("a.role").alias("role"), c("a.score").alias("score"), c("a.match.status").alias("status"),
                    c("a.match.pdf").alias("pdf"), c("a.report").alias("report"),
                    F.concat(F.lit("Re-eval "), c("a.date"), F.lit(" ("), number_text(c("a.old_score")), F.lit("→"),
                             number_text(c("a.new_score")), F.lit("). "), c("a.notes")).alias("notes")))


def number_text(n: Column) -> Column:
    """Shortest decimal text: 4 rather than 4.0."""
    return F.regexp_replace(n.cast("string"), r"\.0$", "")


def assign_numbers(new: DataFrame, highest: DataFrame, order: str = "file_seq") -> DataFrame:
    """Entry numbers of new rows in order: the wanted number, or one more than the highest so far.

    The running rule ``n = max(num, previous + 1)`` is a running maximum of ``num - i``. Rows are split by
    ranges of the order key; each range keeps a local running maximum and gets the totals of the ranges
    before it, so no task sees all rows. ``highest`` is one row with the column ``m0``.
    """
    c = F.col
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(new.repartitionByRange(parts, order).withColumn("_r", F.spark_partition_id()))
    local = Window.partitionBy("_r").orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.withColumn("_i", F.row_number().over(local))
    numbered = numbered.withColumn("_top", F.max(c("num") - c("_i")).over(upto))
    # one row per range: as many rows as shuffle partitions
    totals = numbered.groupBy("_r").agg(F.count("*").alias("_n"), F.max("_top").alias("_t"))
    earlier = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shifted = totals.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    prefix = shifted.withColumn("_best", F.max(c("_t") - c("_off")).over(earlier)).select("_r", "_off", "_best")
    return (numbered.join(F.broadcast(prefix), "_r").join(F.broadcast(highest.select("m0")))
            .withColumn("num", c("_off") + c("_i") + F.greatest(c("m0"), c("_best"), c("_top") - c("_off")))
            .select(*new.columns))


def merge_tracker(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """The tracker after a merge: untouched, updated and new rows with an ``action`` column."""
    c = F.col
    matched = cut_lineage(match_additions(additions, existing))
    changed = updates(matched)
    cols = ["num", "date", "company", "role", "score", "status", "pdf", "report", "notes"]
    stay = existing.join(changed.select("pos"), "pos", "left_anti").select(*cols, F.lit("kept").alias("action"))
    highest = existing.agg(F.coalesce(F.max("num"), F.lit(0)).cast("long").alias("m0"))
    new = assign_numbers(matched.filter(c("match").isNull()).select("file_seq", *cols), highest)
    return (stay.unionByName(changed.select(*cols, F.lit("updated").alias("action")))
            .unionByName(new.select(*cols, F.lit("added").alias("action"))))


def file_order(name: Column) -> Column:
    """Sort key of addition files: the digits of the name as a number, then the name."""
    return F.struct(F.coalesce(F.regexp_replace(name, r"\D", "").try_cast("decimal(38,0)"), F.lit(0)), name)


# --- clusters of repeated applications ----------------------------------------------------------

def _round_leaders(shapes: DataFrame) -> DataFrame:
    """Leaders among the distinct wordings of each employer, found in rounds without gathering an employer.

    A wording leads once no earlier open wording shares two words with it. At most one new leader then
    exists per pair of words, so absorbing the others is a many-to-one join.
    """
    c = F.col
    state = cut_lineage(shapes.withColumns({"leader": F.lit(None).cast("long"), "done": F.lit(False)}))
    while not state.filter(~c("done")).isEmpty():
        waiting = state.filter(~c("done"))
        lead = waiting.select("co", "pos", F.explode(_word_pairs(c("words"), True)).alias("pair"))
        probe = state.select("co", "pos", "words", "done", F.explode(_word_pairs(c("words"), False)).alias("pair"))
        first = lead.groupBy("co", "pair").agg(F.min("pos").alias("first"))
        blocked = (probe.filter(~c("done")).join(first, ["co", "pair"]).filter(c("first") < c("pos"))
                   .select("co", "pos").distinct())
        leaders = cut_lineage(waiting.join(blocked, ["co", "pos"], "left_anti").select("co", "pos", "words"))
        entry = leaders.select("co", c("pos").alias("lpos"), c("words").alias("lwords"),
                               F.explode(_word_pairs(c("words"), True)).alias("pair"))
        absorbed = (probe.join(entry, ["co", "pair"]).filter(
            (c("lpos") < c("pos")) & names.role_words_match(c("lwords"), c("words")))
            .groupBy("co", "pos").agg(F.min("lpos").alias("hit")))
        state = cut_lineage(
            state.join(absorbed, ["co", "pos"], "left")
            .join(leaders.select("co", "pos", F.lit(True).alias("leads")), ["co", "pos"], "left")
            .withColumn("leader", F.when(c("leads"), c("pos")).when(c("leader") == c("pos"), c("leader"))
                        .otherwise(F.least("leader", "hit")))
            .withColumn("done", c("leader").isNotNull()).select("co", "pos", "words", "leader", "done"))
    return state.select("co", "words", "leader")


def cluster_applications(apps: DataFrame) -> DataFrame:
    """Add ``cluster``: position of the first application of the same employer whose role is alike.

    Clusters are greedy: a row joins the earliest leader it resembles, and only leaders are compared.
    Equal wordings always share a leader, so leaders are sought per distinct wording.
    """
    c = F.col
    rows = apps.withColumns({"co": names.spaced_key(c("company")), "words": names.cluster_role_words(c("role"))})
    comparable = rows.filter(F.size("words") > 1)
    shapes = comparable.groupBy("co", "words").agg(F.min("pos").alias("pos"))
    led = _round_leaders(shapes)
    clustered = comparable.join(led, ["co", "words"]).select(*apps.columns, "co", c("leader").alias("cluster"))
    # a single word never leads and never resembles itself, but meets a leader that repeats it
    repeated = let(c("words"), lambda ws: F.filter(F.array_distinct(ws), lambda a: F.size(F.filter(ws, lambda w: w == a)) > 1))
    heads = (shapes.join(led, ["co", "words"]).filter(c("pos") == c("leader")).select("co", "pos", F.explode(repeated).alias("word"))
             .groupBy("co", "word").agg(F.min("pos").alias("head")))
    short = rows.filter(F.size("words") < 2).withColumn("word", F.get("words", F.lit(0))).join(heads, ["co", "word"], "left")
    own = F.when(c("head") < c("pos"), c("head")).otherwise(c("pos"))
    return clustered.unionByName(short.select(*apps.columns, "co", own.alias("cluster")))


def dedupe_applications(apps: DataFrame) -> DataFrame:
    """One row per cluster: the best score, with the most advanced status of the cluster."""
    c = F.col
    score = first_number(c("score"))
    order = F.struct((-score).alias("s"), c("pos"))
    rest = [x for x in apps.columns if x != "status"]
    return (cluster_applications(apps.filter(c("num") > 0)).groupBy("co", "cluster").agg(
        F.min_by(F.struct(*rest), order).alias("k"),
        F.min_by("status", F.struct((-classify.promotion_rank(c("status"))).alias("r"), (-score).alias("s"), c("pos"))).alias("status"),
        F.count("*").alias("members"))
        .select("k.*", "status", "members"))


def exact_repeats(apps: DataFrame) -> DataFrame:
    """Employer and role keys that occur more than once, with count and first number."""
    role = F.regexp_replace(F.lower(F.coalesce("role", F.lit(""))), "[^a-z0-9 ]", "")
    return (apps.groupBy(names.alnum_key(F.col("company")).alias("company_key"), role.alias("role_key"))
            .agg(F.count("*").alias("n"), F.min("num").alias("first_num"), F.max("num").alias("last_num"))
            .filter("n > 1"))


# --- reports, links, follow-ups -----------------------------------------------------------------

def with_report(apps: DataFrame, reports: DataFrame) -> DataFrame:
    keyed = apps.withColumn("path", link_target(F.col("report")))
    return keyed.join(reports, "path", "left")


def broken_links(apps: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Applications whose report exists neither below ``folder`` nor below the root."""
    c = F.col
    known = files.select("path").distinct()
    linked = apps.withColumn("link", link_target(c("report"))).filter("link is not null")
    return (linked.join(known.select(c("path").alias("_a")), F.concat(F.lit(folder), c("link")) == c("_a"), "left_anti")
            .join(known.select(c("path").alias("_b")), c("link") == c("_b"), "left_anti"))


def with_follow_ups(apps: DataFrame, follow_ups: DataFrame) -> DataFrame:
    latest = follow_ups.groupBy(F.col("appNum").alias("num")).agg(
        F.count("*").alias("follow_ups"), F.max("date").alias("last_follow_up"))
    return apps.join(latest, "num", "left").withColumn("follow_ups", F.coalesce("follow_ups", F.lit(0)))


def actionable(apps: DataFrame) -> DataFrame:
    """Applications that wait for a follow-up and carry a readable date."""
    return apps.withColumns({"state": classify.report_status(F.col("status")), "applied_on": strict_date(F.col("date"))}
                            ).filter(F.col("state").isin("applied", "responded", "interview") & F.col("applied_on").isNotNull())


def cadence(apps: DataFrame, follow_ups: DataFrame, today: Column, rule: dict = classify.CADENCE) -> DataFrame:
    """Urgency and next date of every actionable application."""
    c = F.col
    joined = with_follow_ups(actionable(apps), follow_ups)
    last = strict_date(c("last_follow_up"))
    since_app, since_last = F.datediff(today, c("applied_on")), F.datediff(today, last)
    due = classify.next_follow_up(c("state"), c("applied_on"), last, c("follow_ups"), rule)
    return joined.select(
        "num", "company", "role", "state", "applied_on", since_app.alias("days_since_app"),
        since_last.alias("days_since_last"), "follow_ups",
        classify.urgency(c("state"), since_app, since_last, c("follow_ups"), rule).alias("urgency"),
        due.alias("next_date"), F.datediff(due, today).alias("days_until"))


def apply_status_updates(apps: DataFrame, changes: DataFrame) -> DataFrame:
    """New status for the first row that carries the report number; others keep theirs."""
    c = F.col
    target = (apps.withColumn("_rep", report_number(c("report"))).filter("_rep is not null")
              .groupBy("_rep").agg(F.min("pos").alias("pos")))
    wanted = (target.join(changes.select(c("report_number").alias("_rep"), "new_status"), "_rep")
              .select("pos", "new_status"))
    return (apps.join(wanted, "pos", "left")
            .withColumn("status", F.coalesce("new_status", "status")).select(*apps.columns))


# --- job urls -----------------------------------------------------------------------------------

def _role_words(role: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(role)), r"\s+"), lambda w: F.length(w) > 2)


def best_role_url(apps: DataFrame, listed: DataFrame) -> DataFrame:
    """(pos, url): the listed row of the same employer whose title holds most words of the role.

    ``listed`` has company, title, url and ``lpos``; the first listed row wins ties and when no word hits.
    Each distinct title is read once against the words that its employer's roles ask for. Titles that hold the same of them are one, and only these few sets of words
    meet the roles, through the words themselves.
    """
    c = F.col
    rows = listed.select(names.board_key(c("company")).alias("co"), F.lower("title").alias("title"), "url", "lpos")
    at, counts = F.struct("lpos", "url"), F.when(c("lpos").isNotNull(), F.struct("lpos", "url"))
    titles = rows.groupBy("co", "title").agg(F.min(at).alias("at"), F.min(counts).alias("first"))
    wanted = apps.select("pos", names.board_key(c("company")).alias("co"), _role_words(c("role")).alias("words"))
    shapes = wanted.select("co", "words").distinct()
    counted = (shapes.select("co", "words", F.explode("words").alias("w"))
               .groupBy("co", "words", "w").agg(F.count("*").alias("times")))
    asked = shapes.select("co", F.explode_outer("words").alias("w")).groupBy("co").agg(F.array_sort(F.collect_set("w")).alias("asked"))
    # the listed rows are read once: titles that hold the same wanted words are one, those that hold none included, for the first listed row
    held = stored(titles.join(asked, "co").select("co", "at", "first", F.filter("asked", lambda w: F.contains(c("title"), w)).alias("held"))
                  .groupBy("co", "held").agg(F.min("at").alias("at"), F.min("first").alias("first")))
    first = held.groupBy("co").agg(F.min("first")["url"].alias("url"))
    scored = (held.select("co", "at", F.explode("held").alias("w")).join(counted, ["co", "w"])
              .groupBy("co", "words", "at").agg(F.sum("times").alias("hits"))
              .groupBy("co", "words").agg(F.min_by("at.url", F.struct((-c("hits")).alias("h"), c("at.lpos"))).alias("best")))
    return (wanted.join(first, "co").join(scored, ["co", "words"], "left")
            .select("pos", F.coalesce("best", "url").alias("url")))


def parse_batch_notes(batch: DataFrame) -> DataFrame:
    """Role, company and real url of batch rows from 'Role @ Company | Match% | url'."""
    c = F.col
    notes = F.coalesce("notes", F.lit(""))
    tail = F.when(F.contains(notes, F.lit("| ")), F.trim(F.substring_index(notes, "| ", -1)))
    head = F.substring_index(notes, " | ", 1)
    named = F.contains(head, F.lit(" @ "))
    company = F.when(named, F.trim(F.substring_index(head, " @ ", -1)))
    role = F.when(named, F.trim(F.regexp_extract(head, r"^(.*) @ ", 1)))
    job = F.when(F.startswith(tail, F.lit("http")), tail).when(F.startswith("url", F.lit("http")), c("url"))
    return batch.select("id", job.alias("job_url"), company.alias("company"), role.alias("role"))


def job_urls(apps: DataFrame, headers: DataFrame, batch: DataFrame, state: DataFrame, history: DataFrame) -> DataFrame:
    """(pos, job_url, tier) by report header, batch id, completed report number, history, batch notes."""
    c = F.col
    jobs = parse_batch_notes(batch).filter("job_url is not null")
    by_id = jobs.select(c("id").alias("batch_id"), c("job_url").alias("u2"))
    finished = (state.filter((c("status") == "completed") & ~F.coalesce("report_num", F.lit("")).isin("", "-"))
                .join(jobs.select("id", "job_url"), "id"))
    numbers = F.array_distinct(F.array(c("report_num"), F.when(F.length("report_num") < 3, F.lpad("report_num", 3, "0")).otherwise(c("report_num"))))
    by_report = (finished.select("id", "job_url", F.explode(numbers).alias("report_no"))
                 .groupBy("report_no").agg(F.max_by("job_url", "id").alias("u3")))
    base = (apps.withColumns({"path": link_target(c("report")),
                              "report_no": F.nullif(F.regexp_extract(F.coalesce("report", F.lit("")), REPORT_NUMBER, 1), F.lit(""))})
            .join(headers.select("path", c("url").alias("u1"), "batch_id", F.lit(True).alias("read")), "path", "left")
            .join(by_id, "batch_id", "left").join(by_report, "report_no", "left")
            .withColumn("u3", F.when(c("read"), c("u3"))))
    listed = history.filter(F.startswith("url", F.lit("http"))).select("company", "title", "url", "lpos")
    noted = jobs.filter("company is not null").select("company", c("role").alias("title"), c("job_url").alias("url"),
                                                      c("id").alias("lpos"))
    found = (base.join(best_role_url(apps, listed).withColumnRenamed("url", "u4"), "pos", "left")
             .join(best_role_url(apps, noted).withColumnRenamed("url", "u5"), "pos", "left"))
    tier = F.when(c("u1").isNotNull(), 1).when(c("u2").isNotNull(), 2).when(c("u3").isNotNull(), 3).when(
        c("u4").isNotNull(), 4).when(c("u5").isNotNull(), 5)
    return found.select("pos", F.coalesce("u1", "u2", "u3", "u4", "u5").alias("job_url"), tier.alias("tier"))
