"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window entropy over candidate strings.

Base kinds are leftmost non-overlapping matches of a pattern, some of which are then dropped. The kind ``entropy`` takes
candidate strings (runs of an alphabet, at least ``WINDOW`` long), classes each by its characters, moves a window over it
while keeping the count of every character, and updates the Shannon entropy from the two counts that change. A candidate
whose best window passes the threshold of its class is a span, unless an allow-listed form explains it.

Null texts are empty; positions are code points, end exclusive. Rows are scanned one by one: repeated rows, missing doc_ids and other columns
change nothing. Columns of the operator start with an underscore and are dropped by :func:`redacted`.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import let
from .common import aside

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
KINDS = ["assign", "access", "hex", "entropy"]
WINDOW = 20
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
#: Least bits per character of a window, by class: of 20 characters hex can reach 3.7, others 4.3.
LEAST_BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Forms that look random and are none: UUIDs, runs of the alphabet or of digits, placeholders, paths of plain words, dates.
ALLOWED = (r"(?i)(^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|0123456789|1234567890|abcdefghij|example|placeholder|changeme|"
           r"your[_-]|xxxxx|00000000|^[a-z]+([/_-][a-z]+)+$|^[0-9/_=+-]+$)")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_TERM = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def running(lengths: Column) -> Column:
    """Sums of all elements before each, in blocks of 256, so that long arrays stay near linear."""
    zero = F.array().cast("array<int>")

    def before(xs):
        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), zero.alias("out")),
                           lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def placed(xs):
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / 256).cast("int"))
        return let(F.transform(starts, lambda b: before(F.slice(xs, b * 256 + 1, 256))), shifted)

    def shifted(blocks):
        return F.flatten(F.zip_with(blocks, before(F.transform(blocks, lambda b: b["at"]))["out"], lambda b, o: F.transform(b["out"], lambda x: x + o)))
    return let(lengths, lambda xs: F.when(F.size(xs) > 0, placed(xs)).otherwise(zero))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, end, kind, text>> of all non-overlapping matches; ``pattern`` has the whole match as group 1."""
    number = KINDS.index(kind) + 1

    def located(found):
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        # a match starts after all gaps and matches before it, and its own gap
        ends = running(F.zip_with(gaps, found, lambda g, m: g + F.coalesce(F.length(m), F.lit(0))))
        starts = F.zip_with(ends, gaps, lambda a, g: a + g)
        return F.zip_with(F.slice(starts, 1, F.size(found)), found, lambda s, m: F.struct(
            s.alias("start"), F.lit(number).alias("kind"), (s + F.length(m)).alias("end"), m.alias("text")))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda found: F.when(F.size(found) > 0, located(found)))


def best_bits(value: Column) -> Column:
    """Highest entropy of any window of WINDOW characters, from incremental counts.

    The state holds the counts of the alphabet and the sum of n log n over them; each step changes one count up, one down.
    """
    slot = lambda at: F.position(F.substring(value, at, F.lit(1)), F.lit(ALPHABET)) - 1
    term = F.array(*map(F.lit, _TERM))
    zero = F.array_repeat(F.lit(0), len(ALPHABET))
    state = F.struct(zero.alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def moved(s, i):
        out = F.when(i > WINDOW, slot(i - WINDOW)).otherwise(F.lit(-1))
        return let(F.struct(slot(i).alias("into"), out.alias("out")), lambda c: stepped(s, i, c["into"], c["out"]))

    def stepped(s, i, into, out):
        up, down = F.get(s["n"], into), F.get(s["n"], out)
        total = F.when(into == out, s["s"]).otherwise(
            s["s"] + F.get(term, up + 1) - F.get(term, up) + F.coalesce(F.get(term, down - 1) - F.get(term, down), F.lit(0.0)))
        counts = F.when(into == out, s["n"]).otherwise(F.transform(s["n"], lambda n, k: n + F.when(k == into, 1).when(k == out, -1).otherwise(0)))
        return let(total, lambda t: F.struct(counts.alias("n"), t.alias("s"), F.when(
            i >= WINDOW, F.greatest(s["best"], math.log2(WINDOW) - t / WINDOW)).otherwise(s["best"]).alias("best")))
    return F.aggregate(F.sequence(F.lit(1), F.length(value)), state, moved, lambda s: s["best"])


def least_bits(value: Column) -> Column:
    return (F.when(value.rlike("^[0-9a-fA-F]+$"), LEAST_BITS["hex"]).when(value.rlike("^[A-Za-z0-9]+$"), LEAST_BITS["alnum"])
            .otherwise(LEAST_BITS["base64"]))


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: arrays of (start, kind number, end, text) in order of start, then kind."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,text:string>>")
    # the length in characters of a match's value: the match less keyword, separators and quotes
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    part = {
        "assign": F.filter(matches(text, ASSIGN, "assign"), lambda m: F.length(value(m["text"])) >= 6),
        "access": F.filter(matches(text, ACCESS, "access"), lambda m: F.length(m["text"]) >= 20),
        # runs are maximal, so that shorter ones need not be matched
        "hex": matches(text, HEX.replace("+", "{24,}"), "hex"),
        "entropy": F.filter(matches(text, CANDIDATE, "entropy"), lambda m: suspicious(m["text"])),
    }
    hint = {"assign": r"[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}", "entropy": CANDIDATE}
    guarded = [F.coalesce(F.when(text.rlike(hint[k]), part[k]), none) for k in KINDS]
    return (docs.withColumn("_base", F.sort_array(F.concat(*guarded[:3])))
            .withColumn("_spans", F.sort_array(F.concat("_base", guarded[3]))))


def suspicious(value: Column) -> Column:
    # a secret mixes letters and digits, or upper and lower case inside
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.when(mixed & ~value.rlike(ALLOWED), best_bits(value) >= least_bits(value)).otherwise(False)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"] - 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask``, overlapping spans by one; null texts stay null. Other columns stay, whatever their names."""
    return aside(docs, {"text"}, lambda d: _masked(scanned(d), mask))


def _masked(found: DataFrame, mask: str) -> DataFrame:
    cut = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mask)))).otherwise(a["out"]).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("_spans") > 0, cut).otherwise(F.col("text")))
