"""Toxicity by multiple-instance learning: labels are known of documents, scores are learned for sentences.

A document is a bag of sentences. A sentence's score is a logistic sum of weights of the words and word beginnings in it; the sentences of a document are combined by noisy-or: the document
is clean if each of its sentences is, so its score is ``1 - (1 - leak) * product(1 - sentence score)``. The leak is the share of toxic documents without any evidence in
their words. Weights are fitted to the labels of documents through this product, by gradient steps with an L1 penalty, so the blame falls on those sentences
that clean documents do not have; :func:`offending` then lists them.

Evidence are the ``VOCABULARY`` words and beginnings of words (``low-``) whose presence depends most on the label (chi-square over documents, counted by Spark). A sentence without evidence scores 0, so
length alone makes no document toxic. Fitting looks at ``MAX_LABELLED`` labelled texts of ``LONGEST`` characters at most, in the order of a hash of id and
text; the driver gets, for each, the numbers of the evidence in its distinct sentences. Scoring is a scan over whole texts.

Defined results: null and empty texts have no sentence and score like any text without evidence; labels of null, or other than 0 and 1, are not learned from;
equal texts of equal label are learned from once; with fewer than ``MIN_CLASS`` texts of either label the score is the share of label 1 (0.5 without any);
a null id is never held out by its label, since no label has one; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import common

MAX_LABELLED = 8_000
LONGEST = 20_000
VOCABULARY = 1024
#: Letters of a word's beginning.
BEGINNINGS = range(3, 9)
#: Documents that a piece of evidence occurs in, and its chi-square statistic, at least.
MIN_DOCS, MIN_CHI = 5, 30.0
#: Words whose evidence a task remembers.
REMEMBERED = 200_000
MIN_CLASS = 5
PENALTY = 0.0005
STEPS, RATE = 400, 0.1
THRESHOLD = 0.5

#: A sentence ends at a line's end, or after a mark before white space.
SENTENCE = re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|$)", re.MULTILINE)
WORD = re.compile(r"[^\W\d_]+")


def words_of(sentence: str) -> list[str]:
    """The distinct words of a sentence: runs of letters in lower case."""
    return sorted(set(WORD.findall(sentence.lower())))


def evidence_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if k <= len(word))]


@dataclass
class Model:
    """Weights of evidence, the offset of a sentence with evidence, and the score of a document without any."""

    weights: dict[str, float]
    offset: float
    leak: float
    seen: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def known(self, word: str) -> tuple[str, ...]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = tuple(e for e in evidence_of(word) if e in self.weights)
            if len(word) <= 64:
                self.seen[word] = found
        return found

    def sentence(self, words: list[str]) -> float:
        known = sorted({e for w in words for e in self.known(w)})
        return float(1 / (1 + np.exp(-np.clip(self.offset + sum(self.weights[e] for e in known), -30, 30)))) if known else 0.0

    def scored(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """``(start, end, score)`` of each sentence with evidence."""
        for match in SENTENCE.finditer(text or ""):
            score = self.sentence(words_of(match.group()))
            if score > 0:
                yield match.start(), match.end(), score

    def document(self, text: str | None) -> float:
        """The noisy-or of the sentences. A text is searched sentence by sentence only if a word of the evidence is in it."""
        if not text or not any(map(self.known, set(WORD.findall(text.lower())))):
            return self.leak
        clean = 1 - self.leak
        for _, _, score in self.scored(text):
            clean *= 1 - score
        return float(1 - clean)


def noisy_or(bags: list[list[list[int]]], labels: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    """Weights, offset and leak for documents given as the evidence (numbers below ``size``) of their sentences."""
    sentences = [(d, s) for d, bag in enumerate(bags) for s in bag if s]
    of = np.array([d for d, _ in sentences], np.int64)
    row = np.repeat(np.arange(len(sentences)), [len(s) for _, s in sentences]).astype(np.int64)
    word = np.array([w for _, s in sentences for w in s], np.int64)
    n, weights = len(bags), np.zeros(size + 2)  # and the offset and the leak's logit
    weights[-2:] = -2.0, -4.0
    mean, square = np.zeros(size + 2), np.zeros(size + 2)
    for step in range(1, STEPS + 1):
        logit = weights[-2] + np.bincount(row, weights[word], len(sentences))
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        leak = 1 / (1 + np.exp(-weights[-1]))
        clean = np.bincount(of, np.log1p(-np.minimum(score, 1 - 1e-12)), n) + np.log1p(-leak)
        kept = np.minimum(np.exp(clean), 1 - 1e-9)
        pull = np.where(labels == 1, -kept / (1 - kept), 1.0) / n  # of the loss, for each sentence's share in the document
        moved = pull[of] * score
        slope = np.append(np.bincount(word, moved[row], size), [moved.sum(), pull.sum() * leak])
        slope[:size] += PENALTY * np.sign(weights[:size])
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights = weights - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights[:size], float(weights[-2]), float(1 / (1 + np.exp(-weights[-1])))


def fit(bags: list[list[list[int]]], labels: np.ndarray, names: list[str]) -> Model:
    """The model for documents with labels 0 and 1; a word of no weight is no evidence."""
    ones = int(labels.sum())
    if min(ones, len(labels) - ones) < MIN_CLASS or not names:
        return Model({}, 0.0, (ones + 1) / (len(labels) + 2))
    weights, offset, leak = noisy_or(bags, labels, len(names))
    return Model({w: float(x) for w, x in zip(names, weights, strict=True) if abs(x) > 0.1}, offset, leak)


def fold(key: Column) -> Column:
    """crc32 of an id as text, modulo 5: 0 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED) -> Model:
    """Fit on the texts of at most ``limit`` labelled rows outside the held-out fold."""
    usable = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    chosen = usable.filter(fold(F.col("id")) != 0).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(limit)
    slim = docs.select(docs[key].alias("id"), common.whole(docs[text]).alias("body")).filter(F.char_length("body") <= LONGEST)
    joined = slim.join(F.broadcast(chosen), "id")  # ``limit`` rows
    h1, h2 = common.text_key(F.col("body"))
    distinct = joined.select(h1.alias("h1"), h2.alias("h2"), "label", "body").dropDuplicates(["h1", "h2", "label"])
    first = distinct.orderBy("h1", "h2", "label").limit(limit)  # repeated ids do not add rows

    @F.udf("array<array<string>>", useArrow=True)
    def bag(body: str) -> list[list[str]]:
        return [words_of(s) for s in SENTENCE.findall(body)]

    bags = common.written(first.select("h1", "h2", "label", bag("body").alias("bag")), "bags")
    n, ones = bags.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if min(ones, n - ones) < MIN_CLASS:
        return fit([], np.append(np.ones(ones), np.zeros(n - ones)), [])

    @F.udf("array<string>", useArrow=True)
    def evidence(bag: list[list[str]]) -> list[str]:
        return sorted({e for s in bag for w in s for e in evidence_of(w)})

    words = bags.select("label", F.explode(evidence("bag")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("docs"), F.sum("label").alias("hits"))
    expected = F.col("docs") * (ones / n)
    chi = F.pow(F.col("hits") - expected, 2) / expected * (n / (n - ones)) * (n / (n - F.col("docs") + 1))
    best = counted.filter(F.col("docs") >= MIN_DOCS).withColumn("chi", chi).filter(F.col("chi") >= MIN_CHI)
    names = sorted(r["word"] for r in best.orderBy(F.desc("chi"), "word").limit(VOCABULARY).select("word").collect())
    place = {w: i for i, w in enumerate(names)}

    @F.udf("array<array<int>>", useArrow=True)
    def numbered(bag: list[list[str]]) -> list[list[int]]:
        found = {tuple(sorted({place[e] for w in s for e in evidence_of(w) if e in place})) for s in bag}
        return [list(s) for s in sorted(found) if s]

    rows = bags.select("h1", "h2", "label", numbered("bag").alias("bag")).toPandas().sort_values(["h1", "h2", "label"])
    return fit([[list(s) for s in b] for b in rows["bag"]], rows["label"].to_numpy(float), names)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    plain, old = common.guarded(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``VOCABULARY`` weights

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.document(t) for t in texts], dtype=float)

    scored = plain.withColumn("_score", of(old[text]))
    predicted = F.when(F.col("_score") >= threshold, 1).otherwise(0)
    return scored.select(*common.restored(old, {"score": F.col("_score"), "predicted": predicted}))


def offending(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The sentences that score ``threshold`` or more: the document's key, ``start`` and ``end`` in code points, ``sentence`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.udf("array<struct<start: bigint, end: bigint, sentence: string, score: double>>", useArrow=True)
    def of(body: str) -> list[tuple[int, int, str, float]]:
        return [(s, e, body[s:e], x) for s, e, x in shared.value.scored(body) if x >= threshold]

    found = docs.select(docs[key].alias("_key"), F.explode(of(docs[text])).alias("_found"))
    return found.select(F.col("_key").alias(key), *(F.col(f"_found.{c}").alias(c) for c in ("start", "end", "sentence", "score")))


def op12_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = common.documents(spark, directory).select("doc_id", "text")
    model = learn(docs, common.table(spark, directory, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
