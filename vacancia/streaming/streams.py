"""Incremental operators on Structured Streaming, each equal to its batch twin once the input is read.

State is kept by Spark per key, checkpointed in the session's checkpoint folder, and survives lost
executors. Sinks write folders; nothing passes the driver.
"""
from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import fold
from ..session import checkpoint_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all available input into a folder and read the result back.

    Update results go through ``foreachBatch``: each batch is written to its own folder, so a repeated
    batch replaces itself; the batch number is kept as ``batch``.
    """
    spark = stream.sparkSession
    out, state = fresh_folder(spark, "out"), fresh_folder(spark, "state")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).outputMode(mode)
    if mode == "append" and each is None:
        query = writer.format("parquet").option("path", out).start()
    else:
        def save(df: DataFrame, batch: int) -> None:
            if each:
                each(df, batch)
            # a complete result replaces the one before
            df.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else batch}")
        query = writer.foreachBatch(save).start()
    query.awaitTermination()
    batched = mode != "append" or each is not None
    schema = T.StructType([*stream.schema.fields, *([T.StructField("batch", T.IntegerType())] if batched else [])])
    return spark.read.schema(schema).parquet(out)


def new_postings(postings: DataFrame, seen: DataFrame, watermark: str | None = None, at: str = "postedDate") -> DataFrame:
    """Postings whose url is neither in the history nor earlier in the stream.

    With a watermark the urls remembered are bounded by time; without one, by their number.
    """
    fresh = postings.join(seen.select("url").distinct(), "url", "left_anti")
    if watermark:
        return fresh.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["url"])
    return fresh.dropDuplicates(["url"])


def append_outcomes(stream: DataFrame, folder: str) -> None:
    """Append every micro-batch to the history, one folder per batch so that a retry does not repeat rows."""
    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", fresh_folder(stream.sparkSession, "state"))
     .foreachBatch(save).start().awaitTermination())


class _Streak(StatefulProcessor):
    """Failure streak per company. Every run's outcome is kept, so that runs may come late, out of order or in parts."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run string", "ok boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for run, ok in batch.groupby("run")["ok"].all().items():
                known = self.runs.getValue((run,))[0] if self.runs.containsKey((run,)) else True
                self.runs.updateValue((run,), (bool(known and ok),))
        fails, since, last = 0, None, None
        for (run,), (ok,) in sorted(self.runs.iterator()):
            fails, since = (0, None) if ok else (fails + 1, since or run)
            last = run
        yield pd.DataFrame({"company": [key[0]], "fails": [fails], "since": [since], "last": [last], "alert": [fails >= self.threshold]})

    def close(self) -> None:
        pass


def failure_streaks(outcomes: DataFrame, threshold: int = 10) -> DataFrame:
    """Current streak per company (company, fails, since, last, alert); outcomes are company, run, ok.

    Runs and their attempts may come in any order and any split over micro-batches; state holds one entry per company and run.
    """
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return outcomes.groupBy("company").transformWithStateInPandas(
        _Streak(threshold), "company string, fails long, since string, last string, alert boolean", "Update", "None")


class _Ledger(StatefulProcessor):
    """Coverage of one company: misses add up under the current version, rejections stay for good.

    The last hit by ``seq`` counts unless its provider was rejected after it; the order of arrival is of no account.
    """

    def __init__(self, version: int):
        self.version = version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hit = handle.getValueState("hit", "seq long, provider string, conf string")
        self.rejects = handle.getMapState("rejects", "provider string", "seq long")
        self.misses = handle.getMapState("misses", "provider string", "version int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        hit = tuple(self.hit.get()) if self.hit.exists() else None
        for batch in rows:
            for provider in set(batch.loc[batch["kind"] == "miss", "provider"]):
                self.misses.updateValue((provider,), (self.version,))
            for provider, seq in batch[batch["kind"] == "reject"].groupby("provider")["seq"].max().items():
                known = self.rejects.getValue((provider,))[0] if self.rejects.containsKey((provider,)) else seq
                self.rejects.updateValue((provider,), (max(int(known), int(seq)),))
            for seq, provider, conf in batch.loc[batch["kind"] == "hit", ["seq", "provider", "conf"]].itertuples(index=False):
                if hit is None or seq > hit[0]:
                    hit = (int(seq), provider, conf or "")
        if hit is not None:
            self.hit.update(hit)
        standing = hit is not None and not (self.rejects.containsKey((hit[1],)) and self.rejects.getValue((hit[1],))[0] > hit[0])
        missed = ",".join(sorted(k[0] for k, v in self.misses.iterator() if v[0] >= self.version))
        rejected = ",".join(sorted(k[0] for k, _ in self.rejects.iterator()))
        yield pd.DataFrame({"key": [key[0]], "hit": [hit[1] if standing else ""], "conf": [hit[2] if standing else ""],
                            "missed": [missed], "rejected": [rejected]})

    def close(self) -> None:
        pass


def coverage_ledger(events: DataFrame, version: int) -> DataFrame:
    """Ledger rows from probe events (key, seq, kind hit/miss/reject, provider, conf) in ``seq`` order."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy("key").transformWithStateInPandas(
        _Ledger(version), "key string, hit string, conf string, missed string, rejected string", "Update", "None")


# weeks start on Monday; windows count from Thursday 1970-01-01
MONDAY = "4 days"


def weekly_activity(stream: DataFrame, at: str, watermark: str = "7 days") -> DataFrame:
    return (stream.withWatermark(at, watermark).groupBy(F.window(at, "7 days", "7 days", MONDAY).alias("week"))
            .agg(F.count("*").alias("n")))


def repost_windows(stream: DataFrame, at: str = "postedDate", days: int = 90, slide: int = 30, watermark: str = "1 day") -> DataFrame:
    """Postings per employer, folded title and sliding window of ``days``. All postings count, and windows start every ``slide`` days; for reposts see :func:`reposts`.

    Counts lie in RocksDB, not in the executors' heap: three windows of every role are more than it holds."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return (stream.withColumn("role_key", fold(F.col("title"))).withWatermark(at, watermark)
            .groupBy("company", "role_key", F.window(at, f"{days} days", f"{slide} days").alias("span")).agg(F.count("*").alias("n")))


class _Reposts(StatefulProcessor):
    """Postings of the roles of one bucket per url and day. Every day is kept, so that rows may come late, out of order or in parts.

    State is one entry per role, read and written in one call each, and only for the roles that a micro-batch names; a bucket of
    roles goes through one call of Python.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "company string, role_key string", "days array<long>, marks array<string>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # an empty mark stands for no company or no url: keys of the state are never null
        roles: dict = {}
        for batch in rows:
            for company, role, day, url in zip(batch["company"], batch["role_key"], batch["number"], batch["mark"]):
                role, at = roles.setdefault((company, role), {}), (int(day), url)
                role[at] = role.get(at, 0) + 1
        out: list = []
        while roles:
            role, fresh = roles.popitem()
            held = self.seen.getValue(role)
            known = {(day, url): n for day, url, n in zip(*held)} if held else {}
            for at, n in fresh.items():
                known[at] = known.get(at, 0) + n
            self.seen.updateValue(role, ([day for day, _ in known], [url for _, url in known], list(known.values())))
            for row in self.counted((role[0][1:] if role[0] else None, role[1]), known, fresh):
                out.append(row)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=_REPOST)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=_REPOST)

    def counted(self, key, known, fresh) -> Iterator[tuple]:
        """The entries that ``fresh`` ones change, themselves included; urls that stand for none meet no other."""
        order, held = sorted(known), {}
        changed = sorted({day for day, _ in fresh})
        first = last = total = 0
        for day, url in order:
            while order[last][0] < day:  # enters
                d, u = order[last]
                if u:
                    held.setdefault(u, {})[d] = known[d, u]
                    total += known[d, u]
                last += 1
            while order[first][0] < day - self.days:  # leaves
                d, u = order[first]
                if u:
                    total -= held[u].pop(d)
                    if not held[u]:
                        del held[u]
                first += 1
            near = bisect.bisect_left(changed, day - self.days)
            if (day, url) in fresh or near < len(changed) and changed[near] < day:
                whole = url and None not in key
                yield (*key, url[1:] if url else None, day, known[day, url], total - sum(held.get(url, {}).values()) if whole else 0,
                       len(held) - (url in held) if whole else 0)

    def close(self) -> None:
        pass


_REPOST = ["company", "role_key", "url", "number", "n", "reposts", "urls"]
_NO_DAY = -(1 << 40)  # before every window
BUCKETS = 16_384       # of roles; a bucket's rows of one micro-batch are held by one task


def reposts(stream: DataFrame, at: str = "postedDate", days: int = 90) -> DataFrame:
    """Per employer, folded title, url and day: postings and distinct urls of the same role under another url in the ``days`` days before.

    The twin is ``snapshot.repost_counts``. An update holds the rows that a micro-batch changes; read the last one per
    company, role_key, url and day. State holds every url and day of a role and is not bounded by a watermark, which would lose late rows.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    role = fold(F.col("title"))
    marked = stream.select(F.pmod(F.xxhash64("company", role), F.lit(BUCKETS)).alias("bucket"), F.coalesce(F.concat(F.lit("c"), "company"), F.lit("")).alias("company"),
                           role.alias("role_key"), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("")).alias("mark"),
                           F.coalesce(F.unix_date(F.col(at).cast("date")).cast("long"), F.lit(_NO_DAY)).alias("number"))
    out = marked.groupBy("bucket").transformWithStateInPandas(
        _Reposts(days), "company string, role_key string, url string, number long, n long, reposts long, urls long", "Update", "None")
    day = F.when(F.col("number") > _NO_DAY, F.date_from_unix_date(F.col("number").cast("int")))
    return out.select("company", "role_key", "url", day.alias("day"), "n", "reposts", "urls")


def latest(updates: DataFrame, *key: str) -> DataFrame:
    """Last state per key of an update stream read back."""
    rest = [c for c in updates.columns if c not in (*key, "batch")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")
