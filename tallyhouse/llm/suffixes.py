"""Suffix-array deduplication: removes every byte covered by a string of 200 bytes that also starts elsewhere in the corpus.

Suffixes are compared by their first 200 bytes. Those at the anchors of :mod:`tallyhouse.llm.windows` decide the bulk: a suffix whose leading gram occurs
once has no equal, and windows around one whose whole surroundings recur are all repeats. The rest are range-partitioned by the leading bytes of
their anchor, with splitters that Spark samples; each bucket sorts its suffixes locally by multikey quicksort, eight bytes a step and only among suffixes
that are still equal, and compares neighbours. A range never parts suffixes of one gram, so equal suffixes never lie on both sides of a boundary (whole surroundings, which are compared
first by their hash, may be parted: the ends of all buckets are then compared with each other); if a gram alone has over ``CROWD`` different surroundings, its suffixes leave the buckets and meet by their whole 200 bytes in a grouped count instead.

Defined results: null counts as empty; texts of fewer than ``length`` bytes keep everything; a string may repeat within its own document, also
overlapping itself; matches never cross documents; identical rows are documents of their own, so their texts go as a whole; in the output text
a character that loses some of its bytes is dropped; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import common, windows

LENGTH = 200
GRAM = 64
CROWD = 4096
#: Contexts sorted together in a bucket.
TOGETHER = 1500


def equal_classes(rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A number for each row of a matrix of unsigned words, the same for rows that are equal and of one group.

    Multikey quicksort: rows are ordered by group and then word by word, and a word is looked at only for rows that share all before it.
    """
    _, classes = np.unique(groups, return_inverse=True)
    active = np.arange(len(rows))
    top = classes.max(initial=-1) + 1
    for word in range(rows.shape[1]):
        order = np.lexsort((rows[active, word], classes[active]))
        active = active[order]
        lead, value = classes[active], rows[active, word]
        new = np.concatenate([[True], (lead[1:] != lead[:-1]) | (value[1:] != value[:-1])]) if len(active) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        classes[active] = top + number
        top += number[-1] + 1 if len(number) else 0
        size = np.bincount(number) if len(number) else number
        active = active[size[number] > 1] if len(number) else active
    return classes


def repeats(contents: list[bytes], counts: np.ndarray, groups: np.ndarray, copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the flags of its windows: whether the window is also in another context of its group, or in a copy."""
    matrix = []
    for content, n in zip(contents, counts.tolist(), strict=True):
        matrix.append(np.lib.stride_tricks.sliding_window_view(np.frombuffer(content, np.uint8), length)[:n])
    suffixes = np.concatenate(matrix)
    suffixes = np.pad(suffixes, ((0, 0), (0, -length % 8))).view(">u8").astype(np.uint64)
    classes = equal_classes(suffixes, np.repeat(groups, counts))
    total = np.bincount(classes, weights=np.repeat(copies, counts))
    return np.split(total[classes] > 1, np.cumsum(counts)[:-1])


def _bucket(length: int):
    """Sorts and compares the contexts of a bucket; rows of crowds pass through with ``n`` negated."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held
            if waiting:
                table = pa.concat_tables(waiting)
                counts, copies = table["n"].to_numpy().astype(np.int64), table["copies"].to_numpy()
                found = repeats(table["content"].to_pylist(), counts, table["key"].to_numpy(), copies, length)
                out = {"k1": [], "k2": [], "lo": [], "n": []}
                for i, flags in enumerate(found):
                    if copies[i] == 1 and flags.any():
                        at, size = windows.runs(flags)
                        out["k1"].append(np.full(len(at), table["k1"][i].as_py()))
                        out["k2"].append(np.full(len(at), table["k2"][i].as_py()))
                        out["lo"].append(at + table["lo"][i].as_py())
                        out["n"].append(size)
                waiting, held = [], 0
                if out["k1"]:
                    columns = [np.concatenate(v) for v in out.values()]
                    size = len(columns[0])
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, columns[:2]), *(pa.array(c, pa.int32()) for c in columns[2:]), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())],
                        names=["k1", "k2", "lo", "n", "copies", "content"],
                    )

        for rows, crowded in common.shards(batches, CROWD):
            if crowded:
                yield from rows.select(["k1", "k2", "lo", "n", "copies", "content"]).to_batches()
                continue
            waiting.append(rows)
            held += rows.num_rows
            if held >= TOGETHER:
                yield from flush()
        yield from flush()

    return search


NEIGHBOURS = "k1 long, k2 long, lo int, n int, gram long, context long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's sorted rows those that equal a neighbour in gram and context, without these two; and the bucket's first and last row with them,
    as marks to compare across boundaries, whose ``n`` is 0 if they have an equal neighbour inside."""
    names = ["k1", "k2", "lo", "n", "gram", "context"]
    held: dict[str, np.ndarray] = {}
    matched = started = False

    def rows(columns: dict[str, np.ndarray], chosen: np.ndarray) -> pa.RecordBatch:
        picked = [pa.array(columns[c][chosen]) for c in names[:4]]
        nothing = pa.nulls(int(chosen.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([*picked, nothing, nothing], names=names)

    def mark(columns: dict[str, np.ndarray], at: int, done: bool) -> pa.RecordBatch:
        values = {c: columns[c][at : at + 1] for c in names}
        if done:
            values["n"] = np.zeros(1, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(values[c]) for c in names], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch[c].to_numpy() for c in names}
        if held:
            columns = {c: np.concatenate([held[c], v]) for c, v in columns.items()}
        same = (columns["gram"][1:] == columns["gram"][:-1]) & (columns["context"][1:] == columns["context"][:-1])
        before = np.concatenate([[matched], same])
        equal = before[:-1] | same
        if len(equal):
            yield rows(columns, np.concatenate([equal, [False]]))
            if not started:
                yield mark(columns, 0, bool(equal[0]))
                started = True
        held, matched = {c: v[-1:] for c, v in columns.items()}, bool(before[-1])
    if held:
        yield rows(held, np.array([matched]))
        yield mark(held, 0, matched)


def _recurring(mixed: DataFrame) -> DataFrame:
    """The ranges of anchors whose whole context occurs elsewhere: range-partitioned and sorted by gram and context, equal neighbours are such, and a
    bucket's first and last rows are compared with those of the other buckets. Ranges may part a context that is very common."""
    order = ["gram", "context", *windows.KEY, "lo"]
    buckets = mixed.select(*windows.KEY, "lo", "n", "gram", "context").repartitionByRange(*order).sortWithinPartitions(*order)
    found = common.written(buckets.mapInArrow(_neighbours, NEIGHBOURS), "neighbours")
    marks = found.filter("gram IS NOT NULL")
    parted = marks.groupBy("gram", "context").agg(F.count("*").alias("times")).filter("times > 1").select("gram", "context")
    across = marks.filter("n > 0").join(parted, ["gram", "context"]).select(*windows.KEY, "lo", "n")
    return found.filter("gram IS NULL").select(*windows.KEY, "lo", "n").unionByName(across)


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Ranges ``(k1, k2, lo, n)`` of window starts in documents of :func:`windows.keyed` whose window also starts elsewhere."""
    looked = windows.Windows(length, gram, windows.byte_symbols)
    found = windows.repeated(documents, looked)
    alike = found.filter("not mixed").select(*windows.KEY, "lo", "n")
    mixed = found.filter("mixed")
    first = F.min(F.struct(*windows.KEY, "lo", "n", "off")).alias("first")
    distinct = common.written(mixed.groupBy("gram", "context").agg(F.count("*").alias("copies"), first), "contexts")
    recurring = _recurring(mixed)
    cut = windows.contexts(documents, distinct, looked, lambda text: text.encode(), 1)
    lead = F.substring("content", F.col("off") + 1, F.lit(24))
    buckets = cut.withColumn("lead", lead).repartitionByRange("lead", "key").sortWithinPartitions("lead", "key")
    compared = common.written(
        buckets.mapInArrow(_bucket(length), "k1 long, k2 long, lo int, n int, copies long, content binary"), "suffixes"
    )
    single = compared.filter("content IS NULL").select(*windows.KEY, "lo", "n")
    crowd = windows.exploded(compared.filter("content IS NOT NULL"), looked, 1)
    again = crowd.groupBy("window").agg(F.sum("copies").alias("times")).filter("times > 1").select("window")
    met = crowd.filter("copies = 1").join(again, "window").select(*windows.KEY, (F.col("lo") + F.col("i")).alias("lo"), F.lit(1).alias("n"))
    return alike.unionByName(recurring).unionByName(single).unionByName(met)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(length: int, columns: list[str]):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], [], []
            for body, starts, sizes in zip(batch["body"], batch["starts"], batch["sizes"], strict=True):
                raw = (body.as_py() or "").encode()
                empty = not starts.is_valid
                begin, end = windows.covered(*(np.zeros(0, np.int64) if empty else v.values.to_numpy() for v in (starts, sizes)), length)
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for values, value in zip(out, (len(raw), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")), strict=True):
                    values.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in columns), *(pa.array(v, t) for v, t in zip(out, types, strict=True))],
                names=[*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return remove


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated strings taken out of ``text``, and ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    documents, old = windows.keyed(docs, key, text)
    spans = repeated_spans(documents, length, gram)
    joined = windows.with_spans(documents, spans)
    columns = [c for c in joined.columns if c not in ("body", "starts", "sizes", "k1", "k2")]
    schema = ", ".join([*(f"{c} {joined.schema[c].dataType.simpleString()}" for c in columns), RESULT])
    done = joined.mapInArrow(_cut(length, columns), schema)
    kept = {name: F.col("kept") if name == text else c for name, c in old.items()}
    return done.select(*common.restored(kept, {n: F.col(n) for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}))


def op4_suffix_array_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return remove_repeats(common.documents(spark, directory).select("doc_id", "text")).drop("text")
