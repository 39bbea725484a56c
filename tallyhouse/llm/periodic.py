"""Stretches of words that repeat with a period ("runs"), found by recompression.

The words of some texts, as numbers, are one sequence, with a number of its own between two texts, so that nothing matches across them. The sequence is
compressed in turns: block compression replaces each stretch of one symbol by a symbol for (symbol, length), pair compression splits the symbols in two
halves and replaces every pair of one of the first and one of the second half. The levels are a run-length grammar. Where a symbol ends depends on its neighbours
alone, so equal stretches are compressed alike but for their ends, and :meth:`Grammar.extension` finds how far two places agree by climbing the
levels while the symbols at both agree and descending once they differ, with a few steps a level.

A run of period ``q`` has ``max(24, 3 * q)`` words or more, so of any ``max(24, 3 * q) - q`` places in a row one lies in it with the place ``q`` on. These grids
(a harmonic sum of places) give the candidates; extensions to the right, and to the left on the grammar of the reversed sequence, give the exact run. A stretch that is
found with several periods has the smallest one.

How it is spread: a scan. A task takes texts together up to ``TOGETHER`` words; a longer text is alone. Memory grows with the longest text; candidates are extended
``CANDIDATES`` at a time.

Defined results: a null or empty text has no words and no runs, and collapses to an empty text; a document is judged by itself, so repeated rows have the same
result; a null id counts as an empty one where an id is hashed; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import common

#: A run has at least so many words, and at least so many periods.
SHORTEST, PERIODS = 24, 3
TOGETHER = 1 << 17
CANDIDATES = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """Symbols and a last one that equals none; the symbol of the next level that each belongs to, and the first symbol of each of those."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    blocks: bool

    def begins(self, at: np.ndarray) -> np.ndarray:
        return self.first[self.parent[at]] == at

    def step(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols to move on from equal ones: within blocks, to the end of the nearer one."""
        if not self.blocks:
            return np.ones(len(a), np.int64)
        return np.minimum(self.first[self.parent[a] + 1] - a, self.first[self.parent[b] + 1] - b)


class Grammar:
    """The levels of a sequence of numbers from 0 on."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.levels: list[Level] = []
        symbols = np.asarray(sequence, np.int64)
        fresh, idle = int(symbols.max(initial=-1)) + 1, 0
        while len(symbols) > 1 and idle < 4:
            before = len(symbols)
            for blocks in (True, False):
                starts = self._blocks(symbols) if blocks else self._pairs(symbols, len(self.levels))
                if starts.all():
                    continue
                first = np.flatnonzero(starts)
                sizes = np.diff(np.append(first, len(symbols)))
                joined, above = sizes > 1, symbols[first]
                other = sizes if blocks else symbols[np.minimum(first + 1, len(symbols) - 1)]
                named, number = np.unique(above[joined] * (int(other.max()) + 1) + other[joined], return_inverse=True)
                above[joined] = fresh + number
                fresh += len(named)
                parent = np.append(np.cumsum(starts) - 1, len(first))
                self.levels.append(Level(np.append(symbols, -1), parent, np.append(first, [len(symbols)] * 2), blocks))
                symbols = above
            idle = idle + 1 if len(symbols) == before else 0
        own = np.arange(len(symbols) + 1)  # the top: each symbol is its own parent, and nothing climbs on
        self.levels.append(Level(np.append(symbols, -1), own, np.append(own, len(symbols)), False))

    @staticmethod
    def _blocks(symbols: np.ndarray) -> np.ndarray:
        return np.append(True, symbols[1:] != symbols[:-1])

    @staticmethod
    def _pairs(symbols: np.ndarray, seed: int) -> np.ndarray:
        """Where symbols of the next level begin; of the two ways to order the halves the one with more pairs is taken."""
        half = ((symbols.astype(np.uint64) + np.uint64(2 * seed + 1)) * _MIX >> np.uint64(40 + seed % 16)) & np.uint64(1)
        up, down = (half[:-1] == 0) & (half[1:] == 1), (half[:-1] == 1) & (half[1:] == 0)
        return np.append(True, ~(up if up.sum() >= down.sum() else down))

    def extension(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For places ``left < right``: how many symbols from there on are equal."""
        a, b = left.astype(np.int64), right.astype(np.int64)
        turned = np.full(len(a), -1)  # the level at which the symbols first differ
        climbing = np.arange(len(a))
        top = len(self.levels) - 1
        for height, level in enumerate(self.levels):
            going, risen = climbing, []
            while len(going):
                here, there = a[going], b[going]
                same = level.symbols[here] == level.symbols[there]
                turned[going[~same]] = height
                going, here, there = going[same], here[same], there[same]
                if height < top:
                    up = level.begins(here) & level.begins(there)
                    risen.append(going[up])
                    going, here, there = going[~up], here[~up], there[~up]
                step = level.step(here, there)
                a[going], b[going] = here + step, there + step
            climbing = np.concatenate(risen) if risen else climbing[:0]
            if not len(climbing):
                break
            a[climbing], b[climbing] = level.parent[a[climbing]], level.parent[b[climbing]]
        for height in range(int(turned.max(initial=0)) - 1, -1, -1):
            level, going = self.levels[height], np.flatnonzero(turned > height)
            a[going], b[going] = level.first[a[going]], level.first[b[going]]
            while len(going):
                here, there = a[going], b[going]
                same = level.symbols[here] == level.symbols[there]
                going, here, there = going[same], here[same], there[same]
                step = level.step(here, there)
                a[going], b[going] = here + step, there + step
        return a - left


def _candidates(numbers: np.ndarray, longest: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, periods)`` whose words agree, some at a time. Texts come longest first: those long enough for a period are a prefix of the sequence."""
    places, periods, held = [], [], 0
    q = 1
    while len(longest) and max(SHORTEST, PERIODS * q) <= longest[0]:
        least = max(SHORTEST, PERIODS * q)
        end = int(ends[np.searchsorted(-longest, -least, side="right") - 1])
        step = least - q
        at = np.flatnonzero(numbers[: end - q : step] == numbers[q:end:step]) * step
        places.append(at)
        periods.append(np.full(len(at), q))
        held += len(at)
        if held >= CANDIDATES:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
        q += 1
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each list of words, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, words in enumerate(texts) if len(words) >= SHORTEST), key=lambda i: -len(texts[i]))
    if not order:
        return found
    ids: dict[bytes, int] = {}
    parts, gap = [], sum(len(texts[i]) for i in order)
    for i in order:
        parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in texts[i]), np.int64, len(texts[i])))
        parts.append(np.array([gap]))  # above all numbers of words, another for each text
        gap += 1
    numbers = np.concatenate(parts)
    sizes = np.array([len(texts[i]) for i in order])
    ends = np.cumsum(sizes + 1) - 1
    n, smallest = len(numbers), {}
    forward = backward = None
    for at, q in _candidates(numbers, sizes, ends):
        if forward is None:
            forward, backward = Grammar(numbers), Grammar(numbers[::-1])
        for s in range(0, len(at), CANDIDATES):
            i, p = at[s : s + CANDIDATES], q[s : s + CANDIDATES]
            after = forward.extension(i, i + p)
            before = backward.extension(n - i - p, n - i)
            begin, size = i - before, before + after + p
            good = size >= np.maximum(SHORTEST, PERIODS * p)
            for run in np.unique(np.stack([begin[good], size[good], p[good]], 1), axis=0).tolist():
                spot = (run[0], run[1])
                smallest[spot] = min(run[2], smallest.get(spot, run[2]))
    starts = ends - sizes
    for begin, size in sorted(smallest):
        text = int(np.searchsorted(ends, begin))
        found[order[text]].append((begin - int(starts[text]), size, smallest[begin, size]))
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of all repetitions (a run after its first period), joined by one space."""
    keep = np.ones(len(words), bool)
    for start, size, period in runs:
        keep[start + period : start + size] = False
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(batch: pa.RecordBatch, first: int, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(texts)
        table = np.array([r for of in runs for r in of], np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(of) for of in runs])]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(table[:, c]) for c in range(3)], fields=list(kind))
        short = pa.array([collapsed(w, r).decode() for w, r in zip(texts, runs, strict=True)], pa.string())
        rows = batch.slice(first, len(texts))
        columns = [pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), short]
        return pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, "_n", "_runs", "_short"])

    for batch in batches:
        texts, first, held = [], 0, 0
        for i, text in enumerate(batch.column("_text")):
            words = (text.as_py() or "").encode().split()  # bytes split at ASCII white space only
            if texts and held + len(words) > TOGETHER:
                yield searched(batch, first, texts).drop_columns("_text")
                texts, first, held = [], i, 0
            texts.append(words)
            held += len(words)
        if texts:
            yield searched(batch, first, texts).drop_columns("_text")


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start and length in words, period; by start, then period) and ``collapsed``, the text without repetitions."""
    plain, old = common.guarded(docs)
    schema = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in plain.columns)
    schema += ", _n long, _runs array<struct<start: bigint, length: bigint, period: bigint>>, _short string"
    searched = plain.withColumn("_text", old[text]).mapInArrow(_found, schema)
    added = {"n_words": F.col("_n"), "runs": F.col("_runs"), "collapsed": F.col("_short")}
    return searched.select(*common.restored(old, added))


def planted(key: Column, text: Column) -> Column:
    """The text; of one in ten, picked by a hash of its id, the words from some place on repeat with some period."""
    hashed = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(hashed / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))

    words = F.regexp_extract_all(common.whole(text), F.lit(common.WORD), F.lit(0))
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise(""))  # the words once a row
    return F.when(hashed % 10 == 0, F.get(changed, F.lit(0))).otherwise(common.whole(text))


def op11_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    docs = common.documents(spark, directory).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = found.withColumn("best", F.reduce("runs", nothing, better))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
