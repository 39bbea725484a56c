"""Substring deduplication by suffix automata: removes every word covered by a window of 20 words whose sequence also starts earlier.

Earlier means in a document of smaller id, or before in the same document; the first occurrence of a passage stays. The reference of a
document is thus the whole corpus before it, which no broadcast can hold. So the reference is cut into shards, one for each anchor gram of
:mod:`tallyhouse.llm.windows` that different surroundings share, and a task holds the automaton of one shard at a time: surroundings stream through
it in the order of their first occurrence, the matching statistic at each word (the longest suffix read so far that the shard contains) shows
where 20 words or more recur, and the surroundings are then added to the automaton.

Grams that occur once, and surroundings that recur as a whole, need no automaton. A gram with over ``CROWD`` different surroundings is no
shard: its windows meet by their whole sequence in a grouped minimum.

Defined results: null and empty texts have no words; fewer than ``length`` words keep everything; a null id comes after all others; rows of one id
with different texts follow each other in the order of a hash of their text; identical rows of one id are one document, neither earlier; an empty table
gives an empty table; extra columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import common, windows

LENGTH = 20
GRAM = 7
CROWD = 2048


class SuffixAutomaton:
    """The substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The state for exactly the longest string of ``state`` followed by ``symbol``."""
        after = self.next[state][symbol]
        if self.length[after] == self.length[state] + 1:
            return after
        clone = self._state(self.length[state] + 1, dict(self.next[after]), self.link[after])
        self.link[after] = clone
        while state >= 0 and self.next[state].get(symbol) == after:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            if symbol in self.next[last]:
                last = self._split(last, symbol)
                continue
            state = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = state
                at = self.link[at]
            if at >= 0:
                self.link[state] = self._split(at, symbol)
            last = state

    def matching(self, sequence: list[int]) -> list[int]:
        """For each place of a sequence the length of the longest string ending there that the automaton contains."""
        state, size, found = 0, 0, []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                size += 1
            found.append(size)
        return found


def later_windows(sequences: list[list[int]], length: int) -> list[np.ndarray]:
    """For each of the sequences, in order, which of its windows of ``length`` an earlier sequence contains."""
    automaton, found = SuffixAutomaton(), []
    for i, sequence in enumerate(sequences):
        found.append(np.array(automaton.matching(sequence))[length - 1 :] >= length)
        if i + 1 < len(sequences):
            automaton.add(sequence)
    return found


def _shards(length: int):
    """Streams the surroundings of each shard through its automaton; rows of crowds pass through with their content."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "lo", "n", "content"]
        for rows, crowded in common.shards(batches, CROWD):
            if crowded:
                yield from rows.select(names).to_batches()
                continue
            k1, k2, lo, off = (rows[c].to_pylist() for c in ("k1", "k2", "lo", "off"))
            once = {(k1[i], k2[i], lo[i]): i for i in range(len(k1))}  # identical rows are one document
            order = sorted(once.values(), key=lambda i: (k1[i], k2[i], lo[i] + off[i]))
            contents = rows["content"].to_pylist()
            found = later_windows([np.frombuffer(contents[i], np.int64).tolist() for i in order], length)
            out = [], [], [], []
            for i, flags in zip(order, found, strict=True):
                for at, size in zip(*windows.runs(flags), strict=True):
                    for values, value in zip(out, (k1[i], k2[i], lo[i] + at, size), strict=True):
                        values.append(value)
            if out[0]:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(v, t) for v, t in zip(out, types, strict=True)), pa.nulls(len(out[0]), pa.binary())], names=names
                )

    return search


def later_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Ranges ``(k1, k2, lo, n)`` of window starts in documents of :func:`windows.keyed` whose window also starts earlier."""
    looked = windows.Windows(length, gram, windows.word_symbols)
    found = windows.repeated(documents, looked)
    first = F.min(F.struct(*windows.KEY, "lo", "n", "off")).alias("first")
    grouped = found.groupBy("gram", "context").agg(F.count("*").alias("copies"), first, F.first("mixed").alias("mixed"))
    distinct = common.written(grouped, "contexts")
    recurring = found.join(distinct.filter("copies > 1").select("gram", "context", "first"), ["gram", "context"])
    recurring = recurring.filter(F.struct(*windows.KEY, "lo") > F.struct("first.k1", "first.k2", "first.lo")).select(*windows.KEY, "lo", "n")
    cut = windows.contexts(documents, distinct.filter("mixed"), looked, lambda text: windows.word_symbols(text).tobytes(), 8)
    sharded = cut.repartition("key").sortWithinPartitions("key")
    compared = common.written(sharded.mapInArrow(_shards(length), "k1 long, k2 long, lo int, n int, content binary"), "automata")
    single = compared.filter("content IS NULL").drop("content")
    crowd = windows.exploded(compared.filter("content IS NOT NULL"), looked, 8).withColumn("lo", F.col("lo") + F.col("i"))
    first = crowd.groupBy("window").agg(F.min(F.struct(*windows.KEY, "lo")).alias("first"))
    later = crowd.join(first, "window").filter(F.struct(*windows.KEY, "lo") > F.col("first"))
    return recurring.unionByName(single).unionByName(later.select(*windows.KEY, "lo", F.lit(1).alias("n")))


RESULT = "n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(length: int, columns: list[str]):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], []
            for body, starts, sizes in zip(batch["body"], batch["starts"], batch["sizes"], strict=True):
                words = (body.as_py() or "").encode().split()
                empty = not starts.is_valid
                begin, end = windows.covered(*(np.zeros(0, np.int64) if empty else v.values.to_numpy() for v in (starts, sizes)), length)
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(words)]
                kept = [word for a, b in zip(edges[::2], edges[1::2], strict=True) for word in words[a:b]]
                text = b" ".join(kept)
                for values, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()), strict=True):
                    values.append(value)
            types = [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in columns), *(pa.array(v, t) for v, t in zip(out, types, strict=True))],
                names=[*columns, "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return remove


def remove_later(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with recurring passages taken out of ``text`` (the kept words joined by one space), and ``n_words``, ``n_removed``, ``kept_sha256``."""
    documents, old = windows.keyed(docs, key, text)
    joined = windows.with_spans(documents, later_spans(documents, length, gram))
    columns = [c for c in joined.columns if c not in ("body", "starts", "sizes", "k1", "k2")]
    schema = ", ".join([*(f"{c} {joined.schema[c].dataType.simpleString()}" for c in columns), RESULT])
    done = joined.mapInArrow(_cut(length, columns), schema)
    kept = {name: F.col("kept") if name == text else c for name, c in old.items()}
    return done.select(*common.restored(kept, {n: F.col(n) for n in ("n_words", "n_removed", "kept_sha256")}))


def op9_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return remove_later(common.documents(spark, directory).select("doc_id", "text")).drop("text")
