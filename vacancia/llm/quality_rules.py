"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes and of words is compared with language references by
Jensen-Shannon distance (base 2, 0 to 1). The words' histogram has a place for each common word and one for all other words, so that a
text without common words has a distance as well. References are the pooled histograms of the given documents per language of
``COMMON``, over all rows; a language without rows has none. The distance is the least over the references.

``far_words`` is 0.25 since the place of the other words bounds the distance: of the references of sf0.1, where 17 to 18 % of the words are
common, a text with all common words thinned to a tenth lies 0.24 away, to a twentieth 0.27, without any 0.31. Texts drawn at random from a
reference lie nearer the longer they are: 99 % of them below 0.29 at 50 words, 0.25 at 70, 0.22 at 100 (99.9 %: 0.24). So texts under
``min_judged`` = 70 words are not judged by their words. A text in a language without reference is judged like any other.

Null texts are empty. Empty and short texts fail the base rule (fewer than ``min_words`` words). A null or unknown language only keeps a row
out of the references. Rows are judged one by one, so repeated rows and missing doc_ids change nothing; other columns are kept by :func:`keep`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import let
from .common import WORD, aside

# Frequent function words per language.
COMMON = {
    "en": "the of and to in a is that for it".split(),
    "fr": "de la le et les des un du que pour".split(),
    "de": "der die und in den von zu das mit auf".split(),
    "es": "de la que el en y los se del las".split(),
}
GAP = r"[\x20\x09-\x0D]+"
WORDS = sorted({w for words in COMMON.values() for w in words})
#: Character classes as patterns, each taken from what the ones before it leave; the last takes the rest.
CLASSES = {"lower": "[a-z]+", "space": r"[\x20\t\x0B\f\r]+", "beyond": r"[^\x00-\x7F]+", "punctuation": r"[.,;:!?'\"()-]+", "upper": "[A-Z]+",
           "symbol": "[#*$%&|<>]+", "line": r"\n+", "digit": "[0-9]+", "other": r"(?s).+"}


def class_counts(text: Column) -> Column:
    """Code points per class, in the order of CLASSES. Every class is cut out of a shorter text than the one before."""
    def peeled(rest: Column, patterns: list[str]) -> Column:
        def cut(after: Column) -> Column:
            n = F.array((F.length(rest) - F.length(after)).cast("double"))
            return F.concat(n, peeled(after, patterns[1:])) if patterns[1:] else n
        return let(F.regexp_replace(rest, F.lit(patterns[0]), F.lit("")), cut)
    return peeled(text, list(CLASSES.values()))


def word_counts(words: Column) -> Column:
    """How often each of WORDS occurs, in any case, as a word without punctuation, and last how many other words there are."""
    common = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(WORDS))
    start = F.struct(common.alias("rest"), F.array().cast("array<double>").alias("n"))

    def cut(acc, w):
        # each word is taken out of what the ones before it left
        return let(F.array_remove(acc["rest"], w), lambda rest: F.struct(
            rest.alias("rest"), F.concat(acc["n"], F.array((F.size(acc["rest"]) - F.size(rest)).cast("double"))).alias("n")))
    found = F.aggregate(F.array(*map(F.lit, WORDS)), start, cut, lambda acc: acc["n"])
    return let(found, lambda n: F.concat(n, F.array(F.size(words) - F.aggregate(n, F.lit(0.0), lambda a, v: a + v))))


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more, the first included."""
    n = F.size(words)
    # a window is its 64-bit hash; two windows of one text share it by chance about once in 2**64 / n**2
    windows = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))

    def covered(placed):
        # equal windows are neighbours in order; before the first and after the last get() is null, and null is no match
        twice = F.filter(placed, lambda x, k: (F.get(placed, k - 1)["w"] == x["w"]) | (F.get(placed, k + 1)["w"] == x["w"]))
        return let(F.transform(twice, lambda x: x["i"]), lambda starts: F.size(F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.transform(starts, lambda i: i + j))))))

    def counted(w):
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(placed, covered))
    return F.when(n <= size, 0).otherwise(let(windows, counted)).cast("long")


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; null if all are zero."""
    return let(F.aggregate(counts, F.lit(0.0), lambda a, v: a + v), lambda total: F.when(total > 0, F.transform(counts, lambda v: v / total)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null where either is null."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    # greatest() would make 0 of null
    return let(F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v), lambda total: F.sqrt(F.when(total < 0, 0.0).otherwise(total / 2)))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``_q`` of counts and histograms."""
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumns({"_words": F.array_remove(F.split(text, GAP), ""), "_classes": class_counts(text)})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    words, number = F.col("_words"), {name: F.get("_classes", F.lit(i)) for i, name in enumerate(CLASSES)}
    return split.withColumn("_q", F.struct(
        F.size(words).cast("long").alias("n_words"),
        (F.length(text) - number["space"] - number["line"]).cast("long").alias("word_chars"),
        number["symbol"].cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        shares(F.col("_classes")).alias("classes"),
        word_counts(words).alias("words"),
    )).drop("_words", "_classes")


def references(docs: DataFrame) -> DataFrame:
    """One row: array of (lang, classes, words), pooled over all documents of each known language."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.filter(F.col("lang").isin(*COMMON)).select(
        "lang", class_counts(text).alias("classes"), let(F.array_remove(F.split(text, GAP), ""), word_counts).alias("words"))
    sums = rows.groupBy("lang").agg(
        shares(F.array(*[F.sum(F.col("classes")[i]) for i in range(len(CLASSES))])).alias("classes"),
        shares(F.array(*[F.sum(F.col("words")[i]) for i in range(len(WORDS) + 1)])).alias("words"))
    return sums.agg(F.collect_list(F.struct("lang", "classes", "words")).alias("_refs"))


def judged(docs: DataFrame, refs: DataFrame | None = None, min_words: int = 50, most_repeated: int = 50, far_classes: float = 0.3,
           far_words: float = 0.25, min_judged: int = 70) -> DataFrame:
    """``docs`` with ``_q``: counts, class_distance, word_distance, base_failed, kept.

    A text is rejected when its classes lie farther than ``far_classes``, or its words (``min_judged`` or more of them) farther
    than ``far_words``, from every reference. ``refs`` has one row, at most one entry per language of COMMON.
    """
    refs = references(docs) if refs is None else refs
    both = measured(docs).crossJoin(F.broadcast(refs))  # one row of four histograms
    q = F.col("_q")
    both = both.withColumn("_shares", shares(q["words"]))
    near = lambda mine, field: F.array_min(F.transform("_refs", lambda r: divergence(mine, r[field])))
    failed = (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > most_repeated * q["n_words"])
    out = both.withColumn("_class_distance", near(q["classes"], "classes")).withColumn("_word_distance", near(F.col("_shares"), "words"))
    far = F.coalesce(F.col("_class_distance") > far_classes, F.lit(False)) | F.coalesce((q["n_words"] >= min_judged) & (F.col("_word_distance") > far_words), F.lit(False))
    verdict = ~failed & ~far
    return out.withColumn("_q", F.struct(
        q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), verdict.alias("kept"),
        F.col("_class_distance").alias("class_distance"), F.col("_word_distance").alias("word_distance"))).drop("_refs", "_shares", "_class_distance", "_word_distance")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with the columns of ``docs``, whatever their names."""
    # exploding a list of the kept verdict, in place of a filter: a filter would be pushed below the projection and each of its
    # conditions would compute the histograms again
    kept = F.explode(F.filter(F.array("_q"), lambda q: q["kept"]))
    return aside(docs, {"text", "lang"}, lambda d: judged(d, **options).withColumn("_one", kept))
