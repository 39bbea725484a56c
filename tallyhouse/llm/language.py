"""Language identification with a linear-chain conditional random field over words.

Each word (a run of letters, in lower case) is labelled with a language, so that code-switched text gets a language for each of its words. A word's
score for a language sums weights of its byte trigrams, including its borders, its affixes of up to four bytes and its entry in a lexicon
of frequent words; a matrix of transitions scores neighbouring labels. The forward-backward algorithm gives each word's probabilities in the context of the
whole text; a text's language is that with the largest sum, its score the mean probability of it.

Weights and transitions are learned by maximum likelihood on ``PER_LANGUAGE`` labelled texts of each language at most, taken in the order of a hash; texts are
joined to sequences that switch language, so that switches are learned too. A sequence is computed in pieces of ``PIECE`` words whose
transfer matrices link them exactly, which vectorizes the recursion over all pieces of a batch.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no labelled text every text is ``und``; a text with letters always
gets one of the learned languages; equal sums go to the first language in order; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhouse.llm import common
from tallyhouse.llm.quality import fold

PER_LANGUAGE = 150
PIECE = 64
BITS = 16
LEXICON = 8192
AFFIX = 4
ROUNDS = 30
RATE = 0.15
DECAY = 1e-5
SEED = 10
#: Words of texts that are computed together.
TOGETHER = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123)) + list(range(128, 256))] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts: feature numbers per letter and per word, and how many words each text has."""

    trigrams: np.ndarray  # of each letter
    first: np.ndarray  # number of the first letter of each word
    affixes: np.ndarray  # (words, 2)
    names: np.ndarray  # a hash of each word
    counts: np.ndarray  # words of each text

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        raw = np.frombuffer(b" ".join(t.lower().encode() for t in texts) + b" ", np.uint8)
        ends_of_texts = np.cumsum([len(t.lower().encode()) + 1 for t in texts])
        letter = _LETTER[raw]
        value = np.where(letter, raw, 0).astype(np.uint64)
        padded = np.concatenate([[0], value, np.zeros(AFFIX, np.uint64)]).astype(np.uint64)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        at = np.flatnonzero(letter)
        grams = (padded[at] << np.uint64(16)) | (padded[at + 1] << np.uint64(8)) | padded[at + 2]
        before = np.cumsum(letter) - letter
        size = ends - starts
        name = np.zeros(len(starts), np.uint64)
        front, back = np.full(len(starts), 1, np.uint64), np.full(len(starts), 2, np.uint64)
        for i in range(AFFIX):
            front = (front << np.uint64(8)) | np.where(i < size, padded[starts + 1 + i], 0).astype(np.uint64)
            back = (back << np.uint64(8)) | np.where(i < size, padded[np.maximum(ends - i, 0)], 0).astype(np.uint64)
        if len(at):
            powers = np.cumprod(np.full(int(size.max()), _MIX, np.uint64))
            inside = np.arange(len(at)) - np.repeat(before[starts], size)
            name = np.add.reduceat(padded[at + 1] * powers[inside], before[starts])
        slot = lambda x: ((x * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)
        counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends_of_texts)]))
        return cls(slot(grams + np.uint64(1)), before[starts], np.stack([slot(front), slot(back)], 1), name, counts)


@dataclass
class Field:
    """A trained field; its size depends on the numbers of languages and features only."""

    languages: list[str]
    trigrams: np.ndarray
    affixes: np.ndarray
    lexicon: np.ndarray  # sorted hashes
    entries: np.ndarray  # weights of the lexicon's words, and of all others in the last row
    transitions: np.ndarray

    def entry(self, names: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.lexicon, names), max(0, len(self.lexicon) - 1))
        known = self.lexicon[at] == names if len(self.lexicon) else np.zeros(len(names), bool)
        return np.where(known, at, len(self.lexicon))

    def scores(self, words: Words) -> np.ndarray:
        """The score of each word for each language."""
        if not len(words.first):
            return np.zeros((0, len(self.languages)))
        grams = np.add.reduceat(self.trigrams[words.trigrams], words.first, axis=0)
        return grams + self.affixes[words.affixes].sum(1) + self.entries[self.entry(words.names)]


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(values.sum(-1, keepdims=True), 1e-300)


def forward_backward(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's label probabilities, and the expected numbers of transitions, over sequences of ``counts`` words.

    A sequence begins after a state of equally likely labels. All sequences are cut into pieces of ``PIECE`` words; the products of the pieces' matrices
    carry the messages over their borders, the messages inside are computed for all pieces at once.
    """
    n, labels = len(scores), scores.shape[1]
    if not n:
        return np.zeros((0, labels)), np.zeros((labels, labels))
    moves = np.exp(transitions - transitions.max())
    pieces = -(-counts // PIECE)
    total = int(pieces.sum())
    piece_start = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    word_start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    inside = np.arange(n) - np.repeat(word_start, counts)
    cell = np.repeat(piece_start, counts) * PIECE + inside
    weight = np.zeros((total * PIECE, labels))
    weight[cell] = np.exp(scores - scores.max(1, keepdims=True))
    real = np.zeros(total * PIECE, bool)
    real[cell] = True
    weight, real = weight.reshape(total, PIECE, labels), real.reshape(total, PIECE)
    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(PIECE):
        stepped = (product @ moves) * weight[:, t, None, :]
        stepped /= np.maximum(stepped.max((1, 2), keepdims=True), 1e-300)
        product = np.where(real[:, t, None, None], stepped, product)
    entering, leaving = np.full((total, labels), 1.0 / labels), np.full((total, labels), 1.0 / labels)
    for step in range(1, int(pieces.max())):
        longer = np.flatnonzero(pieces > step)
        at = piece_start[longer] + step
        entering[at] = _unit(np.einsum("ni,nij->nj", entering[at - 1], product[at - 1]))
        back = piece_start[longer] + pieces[longer] - 1 - step
        leaving[back] = _unit(np.einsum("nij,nj->ni", product[back + 1], leaving[back + 1]))
    ahead = np.zeros((total, PIECE + 1, labels))
    ahead[:, 0] = entering
    for t in range(PIECE):
        ahead[:, t + 1] = np.where(real[:, t, None], _unit((ahead[:, t] @ moves) * weight[:, t]), ahead[:, t])
    behind = np.zeros((total, PIECE, labels))
    message = leaving
    for t in range(PIECE - 1, -1, -1):
        behind[:, t] = message
        message = np.where(real[:, t, None], _unit((weight[:, t] * message) @ moves.T), message)
    here = _unit(ahead[:, 1:] * behind).reshape(-1, labels)[cell]
    before, after = ahead[:, :-1].reshape(-1, labels)[cell], (weight * behind).reshape(-1, labels)[cell]
    mass = np.einsum("ni,ij,nj->n", before, moves, after)
    pairs = moves * (before.T @ (after / np.maximum(mass, 1e-300)[:, None]))
    return here, pairs


def train(texts: list[str], languages: list[str], seed: int = SEED) -> Field:
    """A field for texts whose words are all of the text's language."""
    names = sorted(set(languages))
    random = np.random.default_rng(seed)
    order = random.permutation(len(texts))
    words = Words.of([texts[i] for i in order])
    label = np.array([names.index(languages[i]) for i in order])
    gold = np.repeat(label, words.counts)
    counts = np.array([words.counts[i : i + 3].sum() for i in range(0, len(order), 3)])
    kinds, often = np.unique(words.names, return_counts=True)
    lexicon = np.sort(kinds[np.argsort(-often, kind="stable")[:LEXICON]])
    size = len(names)
    field = Field(names, np.zeros((1 << BITS, size)), np.zeros((1 << BITS, size)), lexicon, np.zeros((len(lexicon) + 1, size)), np.zeros((size, size)))
    if not len(gold):
        return field
    letters = np.diff(np.concatenate([words.first, [len(words.trigrams)]]))
    entry, wanted = field.entry(words.names), np.eye(size)[gold]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    previous = np.concatenate([[0], gold[:-1]])
    follows = np.ones(len(gold), bool)
    follows[first[first < len(gold)]] = False
    seen = np.zeros((size, size))
    np.add.at(seen, (previous[follows], gold[follows]), 1)
    seen += np.bincount(gold[~follows], minlength=size)[None, :] / size  # a start comes after equally likely labels
    parts = [field.trigrams, field.affixes, field.entries, field.transitions]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]

    def gathered(numbers: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
        return np.stack([np.bincount(numbers, weights=column, minlength=rows) for column in values.T], 1)

    for step in range(1, ROUNDS + 1):
        here, pairs = forward_backward(field.scores(words), counts, field.transitions)
        miss = wanted - here
        gradients = [
            gathered(words.trigrams, np.repeat(miss, letters, 0), 1 << BITS),
            sum(gathered(words.affixes[:, i], miss, 1 << BITS) for i in range(2)),
            gathered(entry, miss, len(lexicon) + 1),
            seen - pairs,
        ]
        for part, gradient, (mean, square) in zip(parts, gradients, moments, strict=True):
            gradient = gradient / len(gold) - DECAY * part
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            part += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return field


def label_words(field: Field, texts: list[str]) -> list[np.ndarray]:
    """The probabilities of the languages for each word of each text, computed for about ``TOGETHER`` words at a time."""
    found, batch, held = [], [], 0
    for i, text in enumerate(texts):
        batch.append(text)
        held += len(text) // 6 + 1
        if held >= TOGETHER or i + 1 == len(texts):
            words = Words.of(batch)
            here, _ = forward_backward(field.scores(words), words.counts, field.transitions)
            found.extend(np.split(here, np.cumsum(words.counts)[:-1]))
            batch, held = [], 0
    return found


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", limit: int = PER_LANGUAGE) -> Field | None:
    """Train on ``limit`` texts of each language at most, outside the held-out fold; None without any."""
    usable = docs.filter(F.col(language).isNotNull() & F.col(text).isNotNull() & (fold(F.col(key)) != 2))
    order = W.partitionBy("_language").orderBy("_hash", "_id")
    slim = usable.select(F.col(key).alias("_id"), F.col(language).alias("_language"), F.xxhash64(key).alias("_hash"))
    chosen = slim.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).select("_id").distinct()
    rows = usable.join(F.broadcast(chosen), usable[key] == F.col("_id"))  # ``limit`` ids a language at most
    rows = rows.select(F.col(text).alias("t"), F.col(language).alias("l"), F.xxhash64(key, text).alias("h")).toPandas().sort_values(["h", "l"])
    return train(rows["t"].tolist(), rows["l"].tolist()) if len(rows) else None


def identify(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    plain, old = common.guarded(docs)
    lettered = F.coalesce(old[text].rlike(r"\p{L}"), F.lit(False))
    if field is None:
        found: Column = F.struct(F.lit("und").alias("language"), F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(field)

        @F.pandas_udf("language string, score double")
        def of(texts: pd.Series) -> pd.DataFrame:
            names, out = shared.value.languages, []
            for here in label_words(shared.value, texts.fillna("").tolist()):
                mean = here.mean(0) if len(here) else np.zeros(len(names))
                best = int(mean.argmax())
                out.append((names[best], float(min(1.0, mean[best]))))
            return pd.DataFrame(out, columns=["language", "score"])

        found = of(old[text])
    marked = plain.select("*", lettered.alias("_lettered"), found.alias("_found"))
    return marked.select(
        *common.restored(
            old,
            {
                "lang_pred": F.when(F.col("_lettered"), F.col("_found.language")).otherwise("und"),
                "score": F.when(F.col("_lettered"), F.col("_found.score")).otherwise(0.0),
            },
        )
    )


def op10_language_id(spark: SparkSession, directory: str) -> DataFrame:
    docs = common.documents(spark, directory)
    field = learn(docs)
    return identify(docs.select("doc_id", "text"), field).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
