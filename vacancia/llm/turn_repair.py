"""Repair of conversation structure by Wagner-Fischer alignment with target strings.

A repaired conversation reads, in role initials, ``(s?(ua)+)?``. Edits: Keep 0 (the initial must fit), Rerole to user or assistant 2, Delete 3 (a must
for blank and repeated turns), Insert an empty user or assistant turn 2; a truncated turn that stays adds 1. The cheapest edits are taken, and of equal cost the ASCII-least
string of their initials (the audit).

Targets alternate, so the target of one length is the end of any longer one: one table of costs, turn by letters still to be written, aligns the turns with every
feasible length at once. It is filled within Ukkonen's band: a cell at which the letters and turns still open differ too much costs more than the incumbent, a
repair that goes turn by turn and never looks ahead. Each length of least cost is traced, least letter first, and the audits are compared.

Turns are put in order by a sort over ranges and cut into chunks of ``2 ** bits`` turns. A conversation inside one chunk is aligned there. Of one that reaches over chunks, each part is
aligned from every state of the grammar to every state (nothing yet, after s, after u, after a), inserted turns before a turn of the part only; so audits of one state are never
prefixes of each other, and their rank says which of two longer audits is less. Parts are joined by groups of about a thousand, groups of groups, and so on, and the states chosen go back the same way.
No task sees more than a chunk or a group, whatever the length of a conversation.

Turns go by turn (nulls first), role, a digest of the text. Null roles and texts are read as one space; a null conv_id is a conversation of its own. Repeated rows are turns, the
second of them a repeat. Other columns are left out. An empty table gives no rows. A conversation whose turns all go has an empty audit of Deletes and an empty repair.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import same

BLANKS = " \t\n\x0b\f\r"
START, LED, USER, ANSWERED = range(4)       # nothing yet, after s, after u, after a
INF = 1 << 40
BEHIND = 1 << 20        # sub of what is inserted behind the last turn
#: What a turn may be, in one letter: ``d`` must go; else its initial (x: none of the grammar's), upper case if truncated.
ROLE = {"u": "user", "a": "assistant"}


# ---- one part of a conversation -----------------------------------------------------------------

def incumbent(turns: str, state: int) -> int:
    """Cost of taking turns as they come, from ``state``, with what any end may add."""
    cost = 4
    for t in turns:
        if t == "d":
            cost += 3
            continue
        want = "a" if state == USER else "u"
        cost += t.isupper() + 2 * (t.lower() != want)
        state = USER if want == "u" else ANSWERED
    return cost


class Table:
    """Costs to align the turns from i on with the last r letters of an alternating string that ends in ``end``; cells dearer than ``bound`` are left out."""

    def __init__(self, turns: str, end: str, bound: int, closing: bool):
        self.turns, self.end, self.closing, n = turns, end, closing, len(turns)
        self.low = [max(0, n - i - bound // 3) for i in range(n + 1)]
        high = [n - i + bound // 2 for i in range(n + 1)]
        last = np.full(high[n] + 1, INF, np.int64)
        last[0] = 0
        if closing:
            last[:] = 2 * np.arange(len(last))
        self.rows = [last]
        for i in range(n - 1, -1, -1):
            low, size = self.low[i], high[i] - self.low[i] + 1
            r = np.arange(low, low + size)
            after = self._shifted(self.rows[-1], self.low[i + 1], low, size)
            cost = after + 3
            if turns[i] != "d":
                taken = self._shifted(self.rows[-1], self.low[i + 1], low - 1, size) + self._fit(turns[i], r)
                cost = np.minimum(cost, np.where(r > 0, taken, INF))
            self.rows.append(np.minimum.accumulate(cost - 2 * r) + 2 * r)
        self.rows.reverse()

    @staticmethod
    def _shifted(row: np.ndarray, has: int, low: int, size: int) -> np.ndarray:
        """``row``, which starts at ``has``, from ``low`` on."""
        out = np.full(size, INF, np.int64)
        a, b = max(low, has), min(low + size, has + len(row))
        if a < b:
            out[a - low:b - low] = row[a - has:b - has]
        return out

    def _letter(self, r):
        """1 where the next of ``r`` letters is a u."""
        return (np.asarray(r) + (self.end == "a")) % 2

    def _fit(self, turn: str, r):
        kept = turn.lower()
        fits = self._letter(r) if kept == "u" else 1 - self._letter(r) if kept == "a" else 0 * np.asarray(r)
        return 2 * (1 - fits) + int(turn.isupper())

    def cost(self, i: int, r: int) -> int:
        at = r - self.low[i]
        return int(self.rows[i][at]) if 0 <= at < len(self.rows[i]) else INF

    def best(self, i: int, wants_u: bool) -> tuple[int, list[int]]:
        """Least cost from turn i on over strings of one letter or more that start as wanted, and their lengths."""
        r = np.arange(self.low[i], self.low[i] + len(self.rows[i]))
        ok = (r > 0) & (self._letter(r) == int(wants_u))
        cost = np.where(ok, self.rows[i], INF)
        least = int(cost.min(initial=INF))
        return least, (r[cost == least].tolist() if least < INF else [])

    def traced(self, i: int, r: int) -> str:
        """The ASCII-least audit of the cell's cost."""
        out, n = [], len(self.turns)
        while i < n or r:
            now = self.cost(i, r)
            if i < n and self.cost(i + 1, r) + 3 == now:
                out.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + 2 == now:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self._fit(self.turns[i], r) < 2 else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def ends_of(turns: str, states: tuple[int, ...], ends: str, closing: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (least cost, ASCII-least audit), for strings that end in one of ``ends`` or are empty."""
    n, found = len(turns), {}

    def offer(key, cost, audit):
        if cost < INF and (key not in found or (cost, audit) < found[key]):
            found[key] = (cost, audit)
    bound = max(incumbent(turns, s) for s in states)
    for end in ends:
        table, after = Table(turns, end, bound, closing), USER if end == "u" else ANSWERED
        for before in states:
            cost, lengths = table.best(0, before != USER)
            for r in lengths:
                offer((before, after), cost, table.traced(0, r))
            if before == START:
                # a system turn may lead if all before it go; what costs more than the incumbent needs no look
                for k in range(min(n, bound // 3 + 1)):
                    if turns[k] in "sS":
                        cost, lengths = table.best(k + 1, True)
                        lead = 3 * k + (turns[k] == "S")
                        if (before, after) not in found or lead + cost <= found[before, after][0]:
                            for r in lengths:
                                offer((before, after), lead + cost, "D" * k + "K" + table.traced(k + 1, r))
    for before in states:
        offer((before, before), 3 * n, "D" * n)
    if START in states and not closing:
        for k in range(n):
            if turns[k] in "sS":
                offer((START, LED), 3 * (n - 1) + (turns[k] == "S"), "D" * k + "K" + "D" * (n - 1 - k))
    return found


def whole(turns: str) -> tuple[int, str]:
    """Least cost and audit of a conversation."""
    return min(ends_of(turns, (START,), "a", True).values())


def part(turns: str) -> dict[tuple[int, int], tuple[int, str]]:
    return ends_of(turns, (START, LED, USER, ANSWERED), "ua", False)


def written(audit: str, turns: str, state: int) -> tuple[list[tuple[str, str, str | None]], str]:
    """For each turn: initials inserted before it, its edit, its new role if it gets one; and the initials inserted behind all."""
    out, before, at = [], "", 0
    for letter in audit:
        want = "a" if state == USER else "u"
        if letter == "I":
            before += want
        else:
            out.append((before, letter, ROLE[want] if letter == "R" else None))
            before = ""
            leads = letter == "K" and state == START and turns[at] in "sS"
            at += 1
            if letter == "D":
                continue
            if leads:
                state = LED
                continue
        state = USER if want == "u" else ANSWERED
    return out, before


def joined(parts: list[tuple[list, list]]) -> dict[tuple[int, int], tuple[int, tuple, list[int]]]:
    """Parts in order, each (costs, ranks) by 4 * state before + state after -> per pair of states the least cost, the ranks on its way and its states."""
    out = {}
    for start in range(4):
        ways = {start: (0, (), [start])}
        for costs, ranks in parts:
            step = {}
            for state, (cost, key, path) in ways.items():
                for after in range(4):
                    one = costs[4 * state + after]
                    if one is not None:
                        way = (cost + one, (*key, ranks[4 * state + after]), [*path, after])
                        if after not in step or way < step[after]:
                            step[after] = way
            ways = step
        out |= {(start, after): way for after, way in ways.items()}
    return out


def ranked(found: dict) -> tuple[list, list]:
    """Costs and ranks of audits (or what orders them) by 4 * state before + state after, ranks among those of one state before."""
    costs, ranks = [None] * 16, [None] * 16
    for before in range(4):
        keys = sorted((found[k][1], k[1]) for k in found if k[0] == before)
        for place, (_, after) in enumerate(keys):
            costs[4 * before + after], ranks[4 * before + after] = found[before, after][0], place
    return costs, ranks


#: What closes a conversation from each state.
CLOSING = {START: "", LED: "II", USER: "I", ANSWERED: ""}


# ---- tables -------------------------------------------------------------------------------------

def facts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, truncated): what the alignment needs of each turn."""
    text = F.coalesce("text", F.lit(" "))
    tail = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.md5(text)).alias("digest"),
                       (tail == "").alias("blank"), (~tail.isin(".", "!", "?")).alias("truncated"))


def in_order(rows: DataFrame) -> DataFrame:
    """:func:`facts` with ``at``, which ascends with conv_id and the order of turns. Equal rows are told apart by place, so that many of them are spread as well."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "tie"]
    got = facts(rows).withColumn("tie", F.monotonically_increasing_id())
    return cut_lineage(got.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id()))


PART = ("first long, edge boolean, turns string, n_blank long, n_duplicate long, n_truncated long, n_illegal long, lead string, tail string, "
        "costs array<long>, ranks array<int>, audits array<string>")


def aligned(where: str):
    """A chunk's conversations; one that reaches its edge is a part."""
    names = [f.strip().split(" ")[0] for f in f"conv_id {where}, {PART}".split(", ")]

    known: dict[str, tuple[int, str]] = {}      # short conversations look alike

    def run(chunk: pa.Table) -> pa.Table:
        if len(known) > 20_000:
            known.clear()
        rows = sorted((r for r in chunk.to_pylist() if not r["mark"]), key=lambda r: r["at"])
        fresh = set(r["at"] for r in chunk.select(["at", "mark"]).to_pylist() if r["mark"])
        out, start = [], 0
        for end in range(1, len(rows) + 1):
            if end < len(rows) and rows[end]["conv_id"] == rows[start]["conv_id"]:
                continue
            some = rows[start:end]
            initials = [r["role"][:1] for r in some]
            repeated = [not r["blank"] and r["at"] not in fresh for r in some]
            cut = [r["truncated"] and not r["blank"] and not d for r, d in zip(some, repeated)]
            codes = [i if i in ("s", "u", "a") else "x" for i in initials]
            turns = "".join("d" if r["blank"] or d else c.upper() if t else c for r, d, t, c in zip(some, repeated, cut, codes))
            edge = start == 0 or end == len(rows)
            if edge:
                found = part(turns)
                costs, ranks = ranked(found)
                audits = [found[k // 4, k % 4][1] if (k // 4, k % 4) in found else None for k in range(16)]
            else:
                if turns not in known:
                    known[turns] = whole(turns)
                cost, audit = known[turns]
                costs, ranks, audits = [cost], [], [audit]
            out.append([some[0]["conv_id"], some[0]["at"], edge, turns, sum(r["blank"] for r in some), sum(repeated), sum(cut),
                        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), initials[0], initials[-1], costs, ranks, audits])
            start = end
        types = [chunk.schema.field("conv_id").type, pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(),
                 pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
    return run


def parts_of(rows: DataFrame, bits: int) -> DataFrame:
    """Conversations of :func:`in_order`, whole or in parts, one row each."""
    where = rows.schema["conv_id"].dataType.simpleString()
    # the earliest turn of each role and text is marked in its chunk; equal turns meet only as counts
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"))
    columns = ["at", "conv_id", "role", "blank", "truncated"]
    both = rows.select(*columns, F.lit(False).alias("mark")).unionByName(first.select("at", F.lit(True).alias("mark")), allowMissingColumns=True)
    return both.withColumn("chunk", F.shiftright("at", bits)).groupBy("chunk").applyInArrow(aligned(where), f"conv_id {where}, {PART}")


def up(where):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["first"])
        costs, ranks = ranked(joined([(r["costs"], r["ranks"]) for r in rows]))
        return pa.table([pa.array([rows[0]["conv_id"]], group.schema.field("conv_id").type), pa.array([rows[0]["first"]], pa.int64()),
                         pa.array([costs], pa.list_(pa.int64())), pa.array([ranks], pa.list_(pa.int32()))], names=["conv_id", "first", "costs", "ranks"])
    return run


def down(group: pa.Table) -> pa.Table:
    """The states chosen for a group, handed to its members."""
    rows = sorted(group.to_pylist(), key=lambda r: r["first"])
    path = joined([(r["costs"], r["ranks"]) for r in rows])[rows[0]["before"], rows[0]["after"]][2]
    kind = group.schema.field("conv_id").type
    return pa.table([pa.array([r["conv_id"] for r in rows], kind), pa.array([r["first"] for r in rows], pa.int64()), pa.array(path[:-1], pa.int32()), pa.array(path[1:], pa.int32())],
                    names=["conv_id", "first", "before", "after"])


def chosen(parts: DataFrame, bits: int) -> DataFrame:
    """(conv_id, first, before, after): the states between the parts of each conversation that is in parts."""
    where = parts.schema["conv_id"].dataType.simpleString()
    levels = [cut_lineage(parts.filter("edge").select("conv_id", "first", "costs", "ranks"))]
    shifts = [s for s in (bits + 10, 33, 43, 53) if s > bits] + [63]
    used = []
    while (levels[-1].groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        used.append(shifts[len(used)])
        levels.append(cut_lineage(levels[-1].groupBy("conv_id", F.shiftright("first", used[-1]).alias("grp")).applyInArrow(
            up(where), f"conv_id {where}, first long, costs array<long>, ranks array<int>")))
    ends = [F.struct((F.col("costs")[s] + 2 * len(CLOSING[s])).alias("cost"), F.col("ranks")[s].alias("rank"), F.lit(s).alias("after")) for s in CLOSING]
    ends = [F.when(F.col("costs")[s].isNotNull(), e) for s, e in zip(CLOSING, ends)]
    out = levels[-1].select("conv_id", "first", F.lit(START).alias("before"), F.least(*ends)["after"].alias("after"))
    for shift, members in zip(reversed(used), reversed(levels[:-1])):
        group = F.shiftright("first", shift)
        states = out.select("conv_id", group.alias("grp"), "before", "after")
        met = same(members.withColumn("grp", group), states, ["conv_id", "grp"], "inner")
        out = met.groupBy("conv_id", "grp").applyInArrow(down, f"conv_id {where}, first long, before int, after int")
    return out


def settled(rows: DataFrame, bits: int) -> DataFrame:
    """:func:`parts_of` with before and after, the audit of each row, and what is inserted behind the conversation's last one (``closing``)."""
    parts = cut_lineage(parts_of(rows, bits))
    # a conversation that only touches the edge of its chunk is a part as well: the last part closes
    met = same(parts, chosen(parts, bits), ["conv_id", "first"], "left")
    by = Window.partitionBy("conv_id").orderBy("first")
    last = F.lead("first").over(by).isNull() & F.col("edge")
    index = F.col("before") * 4 + F.col("after")
    closing = F.element_at(F.array(*[F.lit(CLOSING[s]) for s in range(4)]), F.col("after") + 1)
    met = met.withColumn("closing", F.when(last, closing).otherwise(F.lit(""))).withColumn("previous", F.lag("tail").over(by))
    return cut_lineage(met.select("conv_id", "first", "turns", F.coalesce("before", F.lit(START)).alias("before"), "n_blank", "n_duplicate", "n_truncated",
                                  (F.col("n_illegal") + (~F.concat("previous", "lead").isin("su", "ua", "au") & F.col("previous").isNotNull()).cast("long")).alias("n_illegal"),
                                  "closing", (F.when(F.col("edge"), F.col("costs")[index]).otherwise(F.col("costs")[0]) + 2 * F.length("closing")).alias("cost"),
                                  F.when(F.col("edge"), F.col("audits")[index]).otherwise(F.col("audits")[0]).alias("audit")))


def audits(done: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations of ``rows``."""
    per = done.groupBy("conv_id").agg(*[F.sum(f"n_{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.sum("cost").alias("cost"),
                                      F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "audit", "closing"))),
                                                               lambda x: F.concat(x["audit"], x["closing"])), "").alias("audit"))
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return same(gaps, per, ["conv_id"], "left")


def edits(batches):
    """One row for each turn that stays and each that is inserted: (conv_id, at, sub, edit, role); a kept turn's role stays null."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            lines, behind = written(r["audit"] + r["closing"], r["turns"], r["before"])
            for i, (inserted, edit, role) in enumerate(lines):
                at = r["first"] + i
                out += [(r["conv_id"], at, k, "I", ROLE[w]) for k, w in enumerate(inserted)]
                if edit != "D":
                    out.append((r["conv_id"], at, len(inserted), edit, role))
            out += [(r["conv_id"], r["first"] + len(lines) - 1, BEHIND + k, "I", ROLE[w]) for k, w in enumerate(behind)]
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["conv_id", "at", "sub", "edit", "role"])


def repair(turns: DataFrame, bits: int = 10) -> tuple[DataFrame, DataFrame]:
    """The audits of all conversations, and the repaired turns (conv_id, at, sub, edit, role, text), to be read by at, then sub."""
    rows = in_order(turns)
    where = rows.schema["conv_id"].dataType.simpleString()
    done = settled(rows, bits)
    lines = done.select("conv_id", "first", "before", "turns", "audit", "closing").mapInArrow(edits, f"conv_id {where}, at long, sub int, edit string, role string")
    new = lines.filter("edit = 'I'").select("conv_id", "at", "sub", "edit", "role", F.lit("").alias("text"))
    # of equal turns only one stays, so conversation, role and digest name a turn's text
    named = rows.select("at", F.col("role").alias("had"), "digest")
    stays = lines.filter("edit <> 'I'").join(named, "at")
    text = F.coalesce("text", F.lit(" "))
    texts = turns.select("conv_id", F.coalesce("role", F.lit(" ")).alias("had"), F.unhex(F.md5(text)).alias("digest"), text.alias("text")).groupBy(
        "conv_id", "had", "digest").agg(F.first("text").alias("text"))
    old = same(stays, texts, ["conv_id", "had", "digest"], "inner").select("conv_id", "at", "sub", "edit", F.coalesce("role", "had").alias("role"), "text")
    return audits(done, rows), old.unionByName(new)


def digests(batches):
    """(conv_id, sha256) of the lines of each conversation, joined by newlines; lines come in order, and none is held."""
    import hashlib
    now, whole_text, kind = None, None, None
    out: list = []
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if whole_text is None or conv != now:
                if whole_text is not None:
                    out.append((now, whole_text.hexdigest()))
                now, whole_text = conv, hashlib.sha256(line.encode())
            else:
                whole_text.update(b"\n" + line.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string())], names=["conv_id", "repaired_sha256"])
            out = []
    if whole_text is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([whole_text.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def damaged(turns: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given to the user by the CRC of conv_id and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    got = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return got.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def digest(turns: DataFrame, bits: int = 10) -> DataFrame:
    """Audits of the damaged conversations with the digest of each repaired one; every conv_id of ``turns``."""
    found, lines = repair(damaged(turns), bits)
    where = turns.schema["conv_id"].dataType.simpleString()
    texts = lines.select("conv_id", "at", "sub", F.concat_ws(":", "role", "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "at", "sub")
    hashed = texts.select("conv_id", "line").mapInArrow(digests, f"conv_id {where}, repaired_sha256 string")
    out = same(same(turns.select("conv_id").distinct(), found, ["conv_id"], "left"), hashed, ["conv_id"], "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
