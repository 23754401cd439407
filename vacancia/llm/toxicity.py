"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton after folding look-alikes.

Texts are lower-cased, homoglyphs and digits standing for letters are folded, and words are set apart by single spaces. The
lexicon holds words whose document frequency among toxic rows is far above that among others, weighted by the log of the ratio;
exception phrases are two-word phrases around such a word that mark harmless rows. The weights found in a text, less those
of exceptions, are divided by the square root of its number of words, and a logistic curve turns that into 0 to 1.

Learned from at most ``sample`` labelled rows (those with the least hash of doc_id), at most ``entries`` words and as many phrases, so that what
reaches the driver is bounded. Null texts are empty and score as texts without hits. Rows are scored one by one; repeated rows score alike.
Labels of one doc_id that differ count as toxic. Rows without doc_id are scored and are not learned from.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches

# Letters that look alike, and digits and signs used for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏνκτικαοε", "aeopcyxijsdhlvktikaoe"))
SUBSTITUTES = dict(zip("013457@$!", "oieastasi"))
_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES)
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> list[str]:
    """Words of the folded text. Signs count as letters only inside a word."""
    text = text.lower()
    if re.search(r"[@$!]", text):
        text = re.sub(r"[@$!]+(?=\W|$)", " ", text)
    return _WORD.findall(text.translate(_FOLD))


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]      # a word, or a phrase of two words with what it takes back
    slope: float
    offset: float


def word_rows(vocabulary=None):
    """(doc_id, toxic, term): distinct words of each text, or phrases around words of the vocabulary."""
    def run(iterator):
        for batch in batches(iterator):
            made = []
            for doc, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))):
                words = folded(text)
                terms = set(words) if vocabulary is None else {f"{a} {b}" for a, b in zip(words, words[1:]) if a in vocabulary or b in vocabulary}
                made += [(toxic, t) for t in terms]
            if made:
                toxic, term = zip(*made)
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(term)], names=["toxic", "term"])
    return run


def automaton(weights: dict[str, float]):
    import ahocorasick
    found = ahocorasick.Automaton()
    for term, weight in weights.items():
        found.add_word(f" {term} ", weight)
    if weights:
        found.make_automaton()
    return found


def raw_score(text: str, found, known: bool) -> float:
    words = folded(text)
    if not known or not words:
        return 0.0
    return max(0.0, sum(w for _, w in found.iter(f" {' '.join(words)} "))) / math.sqrt(len(words))


def scorer(lexicon: Lexicon):
    def run(iterator):
        found, known = automaton(lexicon.weights), bool(lexicon.weights)
        for batch in batches(iterator):
            raw = np.array([raw_score(t.as_py(), found, known) for t in batch.column("text")])
            score = 1 / (1 + np.exp(-np.clip(lexicon.slope * raw + lexicon.offset, -30, 30)))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(score)], names=[*rest, "score"])
    return run


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps on the log-likelihood, with a small ridge."""
    w = np.zeros(2)
    a = np.c_[x, np.ones(len(x))]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, entries: int = 400, least_docs: int = 5) -> Lexicon:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id"))  # at most ``sample`` rows

    def counted(vocabulary=None) -> DataFrame:
        terms = rows.mapInArrow(word_rows(vocabulary), "toxic int, term string")
        return terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).filter(F.col("bad") + F.col("good") >= least_docs)

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Lexicon({}, 0.0, -1.0 if good >= bad else 1.0)
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    # difference of the two shares in standard errors of their pooled share: guards against chance among many words
    pooled = (F.col("bad") + F.col("good")) / (bad + good)
    sure = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / bad + 1 / good))
    words = (counted().withColumn("weight", ratio).withColumn("sure", sure).filter("weight >= 1.2 and sure >= 5")
             .orderBy(F.desc("sure"), "term").limit(entries).select("term", "weight").collect())
    weights = {r["term"]: float(r["weight"]) for r in words}
    phrases = (counted(frozenset(weights)).withColumn("weight", ratio).withColumn("sure", sure).filter("weight < 0 and sure <= -1 and bad = 0")
               .orderBy("sure", "term").limit(entries).select("term").collect()) if weights else []
    taken_back = {r["term"]: -sum(weights.get(w, 0.0) for w in r["term"].split()) for r in phrases}
    lexicon = Lexicon(weights | taken_back, 1.0, 0.0)
    points = rows.mapInArrow(raw_points(lexicon), "toxic int, raw double").toPandas()
    slope, offset = logistic(points["raw"].to_numpy(), points["toxic"].to_numpy())
    return Lexicon(lexicon.weights, slope, offset)


def raw_points(lexicon: Lexicon):
    def run(iterator):
        found, known = automaton(lexicon.weights), bool(lexicon.weights)
        for batch in batches(iterator):
            raw = [raw_score(t.as_py(), found, known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(raw, pa.float64())], names=["toxic", "raw"])
    return run


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for every row."""
    where = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scorer(lexicon), f"doc_id {where}, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
