"""A quality classifier: a sparse ensemble of rules over text statistics.

Small regression trees, each grown on a random part of the labelled texts, give candidate rules: every path from a root to a node is a
conjunction of conditions such as ``symbol_share > 0.11 AND pipe_share <= 0.02``. A logistic regression with an L1 penalty over all rules keeps few of them.
The fitted ensemble is a list of rules with weights, which :meth:`RuleEnsemble.score` compiles into a column expression of the statistics: scoring
is a scan without a shuffle, and statistics are expressions over the whole text.

Fitting looks at ``MAX_LABELLED`` labelled texts at most, taken in the order of a hash of their ids; their statistics, a few numbers a text, are
fitted on the driver. With fewer than ``MIN_CLASS`` texts of either label the ensemble has no rules and scores the share of label 1.

Defined results: null and empty texts have statistics 0 and a score like any other; labels of null, or other than 0 and 1, are not learned from;
several labels of one id are all learned from; without any labels the score is 0.5; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import common

MAX_LABELLED = 20_000
MIN_CLASS = 5
TREES = 24
DEPTH = 3
PENALTY = 0.002
THRESHOLD = 0.7
SEED = 7


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a whole text, each computed by SQL functions."""
    whole = common.whole(text)

    def hits(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern)).cast("double")

    chars = F.char_length(whole).cast("double")
    words = common.n_words(text).cast("double")
    lines = F.filter(F.split(whole, "\n"), lambda line: line != "")
    n_lines = F.size(lines).cast("double")

    def share(part: Column, total: Column) -> Column:
        return F.coalesce(F.try_divide(part, total), F.lit(0.0))

    return {
        "n_words": words,
        "word_length": share(chars, words),
        "line_length": share(chars, n_lines),
        "upper_share": share(hits(r"\p{Lu}"), chars),
        "letter_share": share(hits(r"\p{L}"), chars),
        "digit_share": share(hits(r"[0-9]"), chars),
        "symbol_share": share(hits(r"[#$%&*+/<=>@^_~|\\]"), chars),
        "pipe_share": share(hits(r"[|]"), words),
        "mark_share": share(hits(r"[!?]"), words),
        "stop_share": share(hits(r"[.,;:]"), words),
        "symbol_run_share": share(hits(r"[#$%&*!?|]{2,}"), words),
        "repeated_lines": share(n_lines - F.size(F.array_distinct(lines)).cast("double"), n_lines),
    }


@dataclass(frozen=True)
class Rule:
    """Conditions ``(statistic, above, threshold)`` that hold together, with the weight of the rule."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, of: dict[str, Column]) -> Column:
        holds = F.lit(True)
        for name, above, threshold in self.conditions:
            holds = holds & (of[name] > threshold if above else of[name] <= threshold)
        return F.when(holds, F.lit(self.weight)).otherwise(F.lit(0.0))

    def holds(self, values: np.ndarray, names: list[str]) -> np.ndarray:
        held = np.ones(len(values), bool)
        for name, above, threshold in self.conditions:
            column = values[:, names.index(name)]
            held &= column > threshold if above else column <= threshold
        return held


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and an intercept; the score is their logistic sum."""

    rules: tuple[Rule, ...]
    intercept: float

    def score(self, of: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + rule.column(of)
        return 1.0 / (1.0 + F.exp(-total))


def _best_split(values: np.ndarray, labels: np.ndarray, columns: np.ndarray, leaf: int) -> tuple[int, float] | None:
    """The column and threshold that leave the least squared error, with ``leaf`` rows or more on either side."""
    best, found, n, total = 1e-9, None, len(labels), labels.sum()
    for c in columns:
        order = np.argsort(values[:, c], kind="stable")
        x, left = values[order, c], np.cumsum(labels[order])[:-1]
        k = np.arange(1, n)
        gain = left**2 / k + (total - left) ** 2 / (n - k) - total**2 / n
        gain[(x[1:] <= x[:-1]) | (k < leaf) | (n - k < leaf)] = -1
        if n > 1 and gain.max() > best:
            best, at = gain.max(), int(gain.argmax())
            found = int(c), float((x[at] + x[at + 1]) / 2)
    return found


def tree_rules(values: np.ndarray, labels: np.ndarray, names: list[str], seed: int = SEED) -> list[Rule]:
    """The distinct paths of ``TREES`` trees."""
    random, rules = np.random.default_rng(seed), {}

    def grow(rows: np.ndarray, path: tuple) -> None:
        if path:
            rules[path] = Rule(path)
        if len(path) < DEPTH and len(rows) >= 2 and 0 < labels[rows].mean() < 1:
            columns = np.sort(random.choice(len(names), max(1, len(names) // 2), replace=False))
            if split := _best_split(values[rows], labels[rows], columns, max(2, len(rows) // 200)):
                c, threshold = split
                above = values[rows, c] > threshold
                grow(rows[~above], (*path, (names[c], False, threshold)))
                grow(rows[above], (*path, (names[c], True, threshold)))

    for _ in range(TREES):
        grow(random.choice(len(labels), max(2, len(labels) // 2), replace=False), ())
    return list(rules.values())


def lasso_logistic(design: np.ndarray, labels: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = design.shape
    step = 4.0 / (np.linalg.norm(design, 2) ** 2 / n + 1.0)
    weights, base = np.zeros(m), float(np.log(labels.mean() / (1 - labels.mean())))
    ahead, ahead_base, speed = weights.copy(), base, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(design @ ahead + ahead_base, -30, 30))) - labels
        moved = ahead - step * (design.T @ error) / n
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        moved_base = ahead_base - step * error.mean()
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead = moved + (speed - 1) / faster * (moved - weights)
        ahead_base = moved_base + (speed - 1) / faster * (moved_base - base)
        weights, base, speed = moved, moved_base, faster
    return weights, base


def fit(values: np.ndarray, labels: np.ndarray, names: list[str]) -> RuleEnsemble:
    """The ensemble for rows of statistics with labels 0 and 1."""
    ones = int(labels.sum())
    if min(ones, len(labels) - ones) < MIN_CLASS:
        share = (ones + 1) / (len(labels) + 2)
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    rules = tree_rules(values, labels, names)
    design = np.stack([rule.holds(values, names) for rule in rules], axis=1).astype(float)
    weights, base = lasso_logistic(design, labels)
    kept = tuple(Rule(rule.conditions, float(w)) for rule, w in zip(rules, weights, strict=True) if abs(w) > 1e-6)
    return RuleEnsemble(kept, base)


def fold(key: Column) -> Column:
    """crc32 of an id as text, modulo 4: 2 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_LABELLED) -> RuleEnsemble:
    """Fit on the texts of at most ``limit`` rows of ``labels`` outside the held-out fold."""
    usable = labels.select(F.col(key).alias("_id"), F.col(label).alias("_label")).filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    chosen = usable.filter(fold(F.col("_id")) != 2).orderBy(F.xxhash64("_id"), "_id", "_label").limit(limit)
    joined = docs.select(docs[key].alias("_id"), docs[text]).join(F.broadcast(chosen), "_id")  # at most ``limit`` ids
    rows = joined.select(*(c.alias(n) for n, c in statistics(F.col(text)).items()), "_label").toPandas()
    rows = rows.sort_values(list(rows.columns))
    names = [c for c in rows.columns if c != "_label"]
    return fit(rows[names].to_numpy(float), rows["_label"].to_numpy(float), names)


def score(docs: DataFrame, ensemble: RuleEnsemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    plain, old = common.guarded(docs)
    of = statistics(old[text])
    named = plain.select("*", *(c.alias(n) for n, c in of.items()))
    scored = named.withColumn("score", ensemble.score({n: F.col(n) for n in of}))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scored.select(*common.restored(old, {"score": F.col("score"), "predicted": predicted}))


def op7_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    docs = common.documents(spark, directory).select("doc_id", "text")
    ensemble = learn(docs, common.table(spark, directory, "labels"))
    return score(docs, ensemble).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")
