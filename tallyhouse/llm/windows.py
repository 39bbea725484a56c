"""Repeated windows of a corpus: which runs of ``length`` consecutive symbols (bytes or words) of a document occur elsewhere.

Sorting every suffix of a corpus would move hundreds of bytes for each byte of text. Here only *anchors* are compared: among the grams that start
in the first ``length - gram + 1`` places of a window, the one with the least hash, leftmost of equals. An anchor depends on the window's content alone, so
equal windows have it at the same place; the windows of one anchor are consecutive, and the text they span together is its *context*.

1. :func:`anchors` lists for each document its anchors with a hash of the gram and one of the context: two rows per ``length - gram + 1`` symbols or so.
2. :func:`repeated` keeps anchors whose gram occurs again, by a count per gram that is combined before its shuffle.
3. Where all contexts of a gram are equal, their windows are all repeats. Where they differ, :func:`contexts` cuts one copy of each distinct context
   out of its document, for an operator to compare inside the shard of their gram.
4. :func:`with_spans` brings the repeated ranges back to the documents.

Grams and contexts are told apart by 64-bit hashes each, windows by their content. Joins are on a gram or on a document; a hot gram is split by adaptive
execution, since each side's other part has one row for it.

Documents are keyed by id and text hash: rows of one id and different texts stay apart, identical rows get identical results. A null id comes after all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import common

#: Window starts handled at once, so that a very long text costs bounded memory.
SEGMENT = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_RANDOM = np.random.default_rng(20)
_SYMBOL = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

KEY = ("k1", "k2")
ANCHOR_SCHEMA = "k1 long, k2 long, gram long, context long, lo int, n int, off int"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 14)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _prefix(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbols times powers of the base: differences, shifted back, are hashes of ranges."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=sums[1:])
    return sums


def byte_symbols(text: str | None) -> np.ndarray:
    return _SYMBOL[np.frombuffer((text or "").encode(), np.uint8)]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(common.SPACES)] = True


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    space = np.concatenate([[True], _IS_SPACE[np.frombuffer(raw, np.uint8)], [True]])
    change = np.flatnonzero(space[1:] != space[:-1])
    return change[::2], change[1::2]


def word_symbols(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw = (text or "").encode()
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = _prefix(_SYMBOL[np.frombuffer(raw, np.uint8)])
    return _mixed((sums[ends] - sums[starts]) * powers(len(raw))[1][starts])


@dataclass(frozen=True)
class Windows:
    """What to look for: windows of ``length`` symbols, compared at anchors of ``gram`` symbols."""

    length: int
    gram: int
    symbols: Callable[[str | None], np.ndarray]

    def anchors(self, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(gram, context, lo, n, off)`` of each anchor: hashes, first window start, number of window starts, place of the anchor after ``lo``."""
        starts, parts = max(0, len(symbols) - self.length + 1), []
        for at in range(0, starts, SEGMENT):
            n = min(SEGMENT, starts - at)
            parts.append(self._segment(symbols[at : at + n + self.length - 1], n, at))
        if not parts:
            return tuple(np.zeros(0, t) for t in ("int64", "int64", "int32", "int32", "int32"))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _segment(self, symbols: np.ndarray, n: int, at: int) -> tuple[np.ndarray, ...]:
        span, sums = self.length - self.gram + 1, _prefix(symbols)
        back = powers(len(symbols))[1]
        grams = _mixed((sums[self.gram :] - sums[: -self.gram]) * back[: len(sums) - self.gram])
        ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        rows = np.concatenate([ranked, np.full(-len(ranked) % span, (1 << 64) - 1, np.uint64)]).reshape(-1, span)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & _PLACE).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.concatenate([lo, [n]]))
        context = _mixed((sums[lo + count - 1 + self.length] - sums[lo]) * back[lo])
        at_lo = place[lo]
        return grams[at_lo].view(np.int64), context.view(np.int64), (lo + at).astype(np.int32), count.astype(np.int32), (at_lo - lo).astype(np.int32)


def keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, dict]:
    """``docs`` under neutral names with the key columns ``k1`` (the id, null last) and ``k2`` (a hash of the text) and ``body``, the text."""
    plain, old = common.guarded(docs)
    body = common.whole(old[text])
    return (
        plain.select(
            *(c for name, c in old.items() if name != text),
            F.coalesce(old[key], F.lit((1 << 63) - 1)).cast("long").alias("k1"),
            F.xxhash64(body).alias("k2"),
            body.alias("body"),
        ),
        old,
    )


def anchors(documents: DataFrame, windows: Windows) -> DataFrame:
    """A row for each anchor of each document of :func:`keyed`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, parts, held = batch["k1"].to_numpy(), batch["k2"].to_numpy(), [], 0
            for i, text in enumerate(batch["body"]):
                found = windows.anchors(windows.symbols(text.as_py()))
                size = len(found[0])
                parts.append((np.full(size, first[i]), np.full(size, second[i]), *found))
                held += size
                if held > 200_000 or i + 1 == batch.num_rows:
                    columns = [np.concatenate(p) for p in zip(*parts, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "gram", "context", "lo", "n", "off"])
                    parts, held = [], 0

    return documents.select("k1", "k2", "body").mapInArrow(scan, ANCHOR_SCHEMA)


def repeated(documents: DataFrame, windows: Windows) -> DataFrame:
    """The anchors whose gram occurs twice or more, with ``mixed``: whether its contexts differ. Written to the shared folder."""
    seen = anchors(documents, windows)
    counts = seen.groupBy("gram").agg(F.count("*").alias("times"), F.min("context").alias("least"), F.max("context").alias("most"))
    again = counts.filter("times > 1").select("gram", (F.col("least") != F.col("most")).alias("mixed"))
    # Read back as a table, both sides of the join are plain shuffles, which adaptive execution may split at a hot gram.
    return common.written(seen.join(common.written(again, "grams"), "gram"), "anchors")


CONTEXT_SCHEMA = "key long, context long, copies long, k1 long, k2 long, lo int, n int, off int, content binary"


def contexts(documents: DataFrame, distinct: DataFrame, windows: Windows, content: Callable[[str | None], bytes], width: int) -> DataFrame:
    """The ``content`` (``width`` bytes a symbol) of each row of ``distinct``, whose struct ``first`` says where it stands.

    The rows of a document travel with it as one list, no longer than the document.
    """
    fields = ("gram", "context", "copies", "lo", "n", "off")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("key", "context", "copies", "k1", "k2", "lo", "n", "off", "content")}
            for k1, k2, body, rows in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "body", "rows")), strict=True):
                whole = content(body)
                for row in rows:
                    out["key"].append(row["gram"])
                    for name in fields[1:]:
                        out[name].append(row[name])
                    out["k1"].append(k1)
                    out["k2"].append(k2)
                    out["content"].append(whole[row["lo"] * width : (row["lo"] + row["n"] - 1 + windows.length) * width])
            types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    rows = distinct.select("gram", "context", "copies", "first.*").groupBy(*KEY).agg(F.collect_list(F.struct(*fields)).alias("rows"))
    one = documents.join(rows, list(KEY))
    return one.mapInArrow(cut, CONTEXT_SCHEMA)


def with_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` with ``starts`` and ``sizes``: the ranges ``(lo, n)`` of repeated window starts, null if there are none."""
    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))
    lists = lists.select(*KEY, F.col("ranges.lo").alias("starts"), F.col("ranges.n").alias("sizes"))
    return documents.join(lists, list(KEY), "left")


def covered(starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs ``(begin, end)`` of symbols that windows with these ranges of starts cover."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    begin = starts[order].astype(np.int64)
    end = np.maximum.accumulate(begin + sizes[order] - 1 + length)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def exploded(crowd: DataFrame, windows: Windows, width: int) -> DataFrame:
    """The single windows of contexts, for grams with too many of them to be compared in one place: ``i`` counts from ``lo``."""
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    rows = crowd.select("*", at)
    return rows.withColumn("window", F.substring("content", F.col("i") * width + 1, F.lit(windows.length * width))).drop("content")
