"""SimHash near-duplicates with BK-trees.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. :func:`links` finds every pair of distinct
fingerprints within ``radius`` 4 bits. The 64 bits form six parts; two fingerprints that differ in four bits at most agree in two parts, so
each goes to the 15 shards named by a pair of its parts (22 or so bits), and the tree of a shard finds its neighbours. The shard trees are built
where the shuffle brings a shard together: the reference is the corpus itself, too large to be broadcast from the driver. A tree's children
hang on edges numbered by their Hamming distance from the parent; a search follows only edges within the radius. A shard emits links that join
two of its groups, never all pairs. Shards of over 8,192 distinct fingerprints are not held: their fingerprints go to :func:`dense_links`,
which meets at midpoints, 2,081 rows for each fingerprint and no pairs; that is exact as well.

:func:`near_duplicates` keeps one row of each component. No similarity of words is asked for beside the bits.

Defined results: null and empty texts have fingerprint zero and link to each other; fewer words than a shingle make one shingle; copies share
a fingerprint, whose group takes part once; null ids are ignored for the smallest id of a group; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tallyhouse.llm import common
from tallyhouse.llm.components import components

SEED = 42
RADIUS = 4
PARTS = (11, 11, 11, 11, 10, 10)
#: Distinct fingerprints of a shard that one tree may hold.
SHARD = 8192

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words (A-Z folded, joined by one space), or of the whole sequence if it is shorter."""
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    spans = zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_280):
        bits = np.unpackbits(hashes[at : at + 65_280].view(np.uint8), bitorder="little").reshape(-1, 64)
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int = 4) -> Column:
    """The SimHash of a text's shingles as a long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, width)) for t in texts], dtype="int64")

    return of(text)


class BKTree:
    """Fingerprints under their distance to a parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the stored values that differ from ``value`` in ``radius`` bits at most."""
        found, values, children = [], self.values, self.children
        waiting = [0] if values else []
        while waiting:
            node = waiting.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            low, high = distance - radius, distance + radius
            for edge, child in children[node].items():
                if low <= edge <= high:
                    waiting.append(child)
        return found

    def add(self, value: int) -> int:
        """Store a value; its number."""
        number = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while number:
            edge = (self.values[node] ^ value).bit_count()
            below = self.children[node].get(edge)
            if below is None:
                self.children[node][edge] = number
                break
            node = below
        return number


class Groups:
    """Disjoint sets of numbers."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Pairs of positions that join the groups of ``values`` linked within ``radius``."""
    tree, groups, found = BKTree(), Groups(len(values)), []
    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            if groups.join(i, j):
                found.append((j, i))
        tree.add(value)
    return found


def part_keys(print_: Column) -> Column:
    """The 15 shard keys of a fingerprint: a pair of parts and its bits."""
    parts, low = [], 0
    for size in PARTS:
        parts.append(F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
        low += size
    pairs = [(i, j) for i in range(len(parts)) for j in range(i)]
    return F.array(*(F.lit(n << 22).cast("long") + F.shiftleft(parts[i], 11) + parts[j] for n, (i, j) in enumerate(pairs)))


def dense_links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect the fingerprints ``a`` of a table exactly as all pairs within 4 bits would.

    Two fingerprints are within 4 bits if and only if some value is within 2 bits of both. Each meets its group at all such values; a value
    has at most 2,081 fingerprints around it.
    """
    one = [1 << i for i in range(64)]
    masks = [0, *one, *(x | y for i, x in enumerate(one) for y in one[:i])]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    around = F.explode(F.transform(F.lit(signed).cast("array<long>"), lambda m: m.bitwiseXOR(F.col("a"))))
    met = prints.select("a", around.alias("centre"))
    first = met.groupBy("centre").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return met.join(first, "centre").filter("a <> b").select("a", "b").distinct()


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``print`` of a table that connect all within ``radius`` bits; 4 at most."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("two parts of six agree up to 4 differing bits only")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, crowded in common.shards(batches, SHARD):
            values = rows["print"].to_numpy()
            if crowded:
                yield pa.RecordBatch.from_pydict({"a": values, "b": values, "crowded": np.ones(len(values), bool)})
            elif found := tree_links([v & 0xFFFFFFFFFFFFFFFF for v in values.tolist()], radius):
                i, j = np.array(found).T
                yield pa.RecordBatch.from_pydict({"a": values[i], "b": values[j], "crowded": np.zeros(len(i), bool)})

    keyed = prints.select("print", F.explode(part_keys(F.col("print"))).alias("key")).repartition("key")
    found = common.written(
        keyed.sortWithinPartitions("key", "print").mapInArrow(search, "a long, b long, crowded boolean"), "links"
    )
    crowd = found.filter("crowded").select("a").distinct()
    return found.filter("not crowded").select("a", "b").unionByName(dense_links(crowd))


def roots(prints: DataFrame, radius: int) -> DataFrame:
    """A table of distinct fingerprints ``print`` with the ``root`` of each one's component."""
    labels = components(links(prints.select("print"), radius)).withColumnRenamed("node", "print")
    return prints.join(labels, "print", "left").withColumn("root", F.coalesce("root", "print"))


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """``docs`` with ``fingerprint`` (long) and ``component_id``: the smallest ``key`` reachable over links within ``radius`` bits."""
    plain, old = common.guarded(docs)
    columns = [c for name, c in old.items() if name != text]
    marked = common.written(plain.select(*columns, fingerprint(old[text], width).alias("print")), "fingerprints")
    rooted = roots(marked.groupBy("print").agg(F.min(old[key]).alias("first")), radius)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("print", "component_id")
    kept = {name: c for name, c in old.items() if name != text}
    return marked.join(of_print, "print").select(
        *common.restored(kept, {"fingerprint": F.col("print"), "component_id": F.col("component_id")})
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component of :func:`clusters`: the row of the smallest ``key`` (nulls last), of equal keys that of the smallest hash of the
    whole row; of rows that are equal in all columns one stays."""
    plain, old = common.guarded(docs)
    hashed = [F.col(f.name) for f in plain.schema.fields if not isinstance(f.dataType, MapType)]
    order = F.struct(old[key].isNull().alias("none"), old[key].alias("key"), F.xxhash64(*hashed).alias("h"), F.xxhash64(F.lit("row"), *hashed).alias("g"))
    ordered = plain.withColumn("order", order)
    marked = common.written(ordered.select("order", fingerprint(old[text], width).alias("print")), "fingerprints")
    rooted = roots(marked.groupBy("print").agg(F.min("order").alias("order")), radius)
    best = rooted.groupBy("root").agg(F.min("order").alias("order")).select("order")
    survivors = ordered.join(best, "order", "left_semi")
    repeated = marked.groupBy("order").agg(F.count("*").alias("n")).filter("n > 1").select("order").join(best, "order", "left_semi")
    if repeated.limit(1).count():
        survivors = survivors.dropDuplicates(["order"])
    return survivors.select(*common.restored(old, {}))


def op6_simhash_components(spark: SparkSession, directory: str) -> DataFrame:
    found = clusters(common.documents(spark, directory).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
