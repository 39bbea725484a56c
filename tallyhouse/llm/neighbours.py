"""Approximate nearest neighbours by largest inner product: inverted lists scanned over dimensions that adapt to each candidate.

Inner products become distances by one more component that gives all vectors the length of the longest. A vector is kept in the list of its nearest coarse
centroid and, for what that leaves, its nearest fine centroid; a query probes the lists whose sums of both centroids are nearest. Lists hold ``LIST`` vectors on
average at every size of the table. The lists of a query are searched in rounds, the nearest
one first, then ``ROUND`` times as many as before in all, so that rounds grow with the logarithm of the probes:

* the first round scores the nearest list in full: its ``k``-th best is a true bound on the distance of what is still to be found;
* each later round takes the bound found so far into its lists and so adds few pairs. Vectors and queries are rotated at random and compared in blocks of
  columns: after ``d`` of ``D`` columns a candidate is abandoned if its partial distance, scaled by ``D / d``, exceeds the bound by more than the test of the
  hypothesis "it is nearer" allows (``1 + SLACK / sqrt(d)``). A block of columns is one matrix product for many queries while many candidates are left, and
  is computed for single pairs after that.

Candidates that survive all columns are scored in double precision on the original vectors.

Centroids, the longest length, and the number of probes are found first: centroids and probes on ``SAMPLE`` vectors at most, taken in the order of a hash
(probes: the fewest that find 98% of the true neighbours within the sample); every vector is indexed. A list is cut into chunks of about ``CHUNK``
vectors and its queries into blocks of as many, so that a crowded list, such as that of a vector with many copies, is many tasks. The driver gets the sizes
of the lists, one number for ``LIST`` vectors, and no rows.

Defined results: vectors that are null, zero, of another length than the most common, or hold a null or non-finite component take no part; each query gets
``k`` rows or as many as there are candidates; equal scores rank by smaller id; rows of the query's own id are no candidates; a repeated query id is
asked once; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhouse.llm import common

K = 20
SAMPLE = 20_000
PROBED_QUERIES = 400
WANTED = 0.98
LIST = 512
ROUND = 4
CHUNK = 4096
COLUMNS = 16
SLACK = 2.1
SEED = 8
#: Queries compared with a chunk at a time, and the share of candidates below which pairs are compared one by one.
QUERIES = 128
FEW = 0.05
#: Pairs scored at a time.
PAIRS = 16_384
FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Index:
    """What tasks need of an index. A list has the number ``coarse * len(fine) + fine``."""

    rotation: np.ndarray
    coarse: np.ndarray
    fine: np.ndarray
    longest: float
    probes: int

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the component that turns inner products into distances (0 for queries)."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(1)))
        return np.concatenate([vectors, rest[:, None]], 1)

    def list_of(self, vectors: np.ndarray) -> np.ndarray:
        lifted = self.lifted(vectors)
        coarse = _nearest(lifted, self.coarse)
        return coarse * len(self.fine) + _nearest(lifted - self.coarse[coarse], self.fine)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """For each query, all lists by the distance of their centroid."""
        lifted = self.lifted(queries, query=True)
        coarse = ((self.coarse**2).sum(1) - 2 * lifted @ self.coarse.T)[:, :, None]
        fine = ((self.fine**2).sum(1) - 2 * lifted @ self.fine.T)[:, None, :]
        return np.argsort((coarse + fine + 2 * (self.coarse @ self.fine.T)).reshape(len(lifted), -1), axis=1)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def _means(points: np.ndarray, n: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = points[random.choice(len(points), n, replace=False)]
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        counts = np.bincount(nearest, minlength=n)
        sums = np.stack([np.bincount(nearest, weights=column, minlength=n) for column in points.T], 1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, longest: float, lists: int, k: int = K, seed: int = SEED) -> Index:
    """An index of about ``lists`` lists from a sample of vectors."""
    random = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    rotation = np.linalg.qr(random.normal(size=(size, size)))[0]
    empty = Index(rotation, np.zeros((1, size)), np.zeros((1, size)), longest, 1)
    points = empty.lifted(sample)
    coarse = _means(points, min(math.ceil(lists**0.5), len(points)), random)
    fine = _means(points - coarse[_nearest(points, coarse)], min(math.ceil(lists / len(coarse)), len(points)), random)
    index = Index(rotation, coarse, fine, longest, 1)
    of = index.list_of(sample)
    asked = random.choice(len(sample), min(PROBED_QUERIES, len(sample)), replace=False)
    needed = []
    for i in asked.tolist():
        products = sample @ sample[i]
        products[i] = -np.inf
        near = np.argsort(-products)[: min(k, max(1, len(sample) - 1))]
        place = np.empty(index.lists, int)
        place[index.order(sample[i : i + 1])[0]] = np.arange(index.lists)
        needed.append(place[of[near]])
    ranked = np.sort(np.concatenate(needed))
    return Index(rotation, coarse, fine, longest, int(ranked[min(len(ranked) - 1, math.ceil(WANTED * len(ranked)))]) + 1)


def survivors(turned: np.ndarray, turned_queries: np.ndarray, bounds: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that the test leaves after all columns; ``bounds`` are the squared distances of each query's ``k``-th best so far."""
    size = turned.shape[1]
    alive, partial = np.ones((len(turned_queries), len(turned)), bool), np.zeros((len(turned_queries), len(turned)))
    i = j = near = None
    for at in range(0, size, COLUMNS):
        to = min(size, at + COLUMNS)
        slack = 1.0 + SLACK / np.sqrt(to) if to < size else 1.0 + 1e-9
        limit = (bounds * slack**2 + 1e-9 * scale) * (to / size)
        a, b = turned_queries[:, at:to], turned[:, at:to]
        if i is None:
            partial += (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T
            alive &= partial <= limit[:, None]
            if to == size or alive.mean() < FEW:
                i, j = np.nonzero(alive)
                near = partial[i, j]
        else:
            near = near + ((a[i] - b[j]) ** 2).sum(1)
            kept = near <= limit[i]
            i, j, near = i[kept], j[kept], near[kept]
    return i, j


def _ranked(i: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each query among pairs."""
    order = np.lexsort((ids, -scores, i))
    starts = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def search_block(base: pd.DataFrame, queries: pd.DataFrame, index: Index, k: int) -> pd.DataFrame:
    """The ``k`` nearest of a chunk for each query of a block, of those that score ``bound`` or more; a null bound asks for all."""
    if base.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    vectors, ids = np.stack(base["vector"].to_numpy()), base["vec_id"].to_numpy()
    asked, query_ids = np.stack(queries["vector"].to_numpy()), queries["query_id"].to_numpy()
    bound = queries["bound"].to_numpy(float)
    scale = index.longest**2
    turned, turned_queries = index.lifted(vectors) @ index.rotation, index.lifted(asked, query=True) @ index.rotation
    limits = np.where(np.isnan(bound), np.inf, np.maximum(0, (asked**2).sum(1) + scale - 2 * bound))
    found = []
    for at in range(0, len(asked), QUERIES):
        part = slice(at, at + QUERIES)
        products = None
        if np.isinf(limits[part]).any():  # the best k by a matrix product, with what may tie them, are such a bound as well
            products = asked[part] @ vectors.T
            products[query_ids[part][:, None] == ids[None, :]] = -np.inf
            kth = np.partition(products, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            own = np.where(np.isfinite(kth), np.maximum(0, (asked[part] ** 2).sum(1) + scale - 2 * kth), np.inf)
            limits[part] = np.minimum(limits[part], own)
        i, j = survivors(turned, turned_queries[part], limits[part], scale)
        other = query_ids[part][i] != ids[j]
        i, j = i[other], j[other]
        pieces = range(0, len(i), PAIRS)
        scores = np.concatenate([np.zeros(0)] + [(vectors[j[p : p + PAIRS]] * asked[part][i[p : p + PAIRS]]).sum(1) for p in pieces])
        best = _ranked(i, ids[j], scores, k)
        found.append((query_ids[part][i[best]], ids[j[best]], scores[best]))
    query_id, vec_id, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers and not all zero."""
    number = vector.cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(number, lambda x: x != 0)


def search(vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, lists: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of ``vectors`` to each of its rows for which ``asked`` holds."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked")
    )
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    length, total = (sizes["size"], sizes["count"]) if sizes else (1, 0)
    rows = rows.filter(F.size("vector") == length)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    longest = rows.agg(F.max(norm)).first()[0] or 1.0
    sample = rows.select("vector", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).toPandas()["vector"]
    if not total:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    index = fit(np.stack(sample.to_numpy()), longest, lists or math.ceil(total / LIST), k)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def list_of(column: pd.Series) -> pd.Series:
        return pd.Series(shared.value.list_of(np.stack(column.to_numpy())) if len(column) else [], dtype="int32")

    listed = common.written(rows.withColumn("list", list_of("vector")), "lists")
    sizes = common.written(listed.groupBy("list").agg(F.count("*").alias("n")), "sizes")
    held = np.zeros(index.lists, np.int64)
    counted = sizes.toPandas()
    held[counted["list"].to_numpy()] = counted["n"].to_numpy()

    @F.pandas_udf("array<int>")
    def probed(column: pd.Series) -> pd.Series:
        chosen = []
        for vector in column:
            order = shared.value.order(vector[None, :])[0]
            order = order[held[order] > 0]
            enough = max(int((np.cumsum(held[order]) < 2 * (k + 1)).sum()) + 1, shared.value.probes)
            chosen.append(order[:enough].astype(np.int32))
        return pd.Series(chosen)

    queries = listed.filter("asked").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "vector")
    queries = common.written(queries.withColumn("probes", probed("vector")), "queries")
    place = ["list", "chunk", "block"]
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def block(base_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        return search_block(base_rows, query_rows, shared.value, k)

    def parts(n: str) -> Column:
        return F.ceil(F.col(n) / CHUNK).cast("int")

    def searched(wanted: DataFrame) -> DataFrame:
        """What the list that each row of ``wanted`` names has for its query: ``k`` rows of a chunk at most."""
        both = sizes.join(wanted.groupBy("list").agg(F.count("*").alias("m")), "list")
        both = both.select("list", parts("n").alias("chunks"), parts("m").alias("blocks"))
        base = listed.select("vec_id", "vector", "list").join(both, "list")
        base = base.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
        base = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("chunks", "blocks")
        blocks = wanted.join(both, "list")
        blocks = blocks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "blocks")
        return base.groupBy(*place).cogroup(blocks.groupBy(*place)).applyInPandas(block, FOUND)

    near = spark.createDataFrame([], FOUND + ", rank int")
    start, stop, most = 0, 1, queries.agg(F.max(F.size("probes"))).first()[0] or 0
    while start < most:
        bounds = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
        lists_now = F.explode(F.slice("probes", start + 1, stop - start)).alias("list")
        wanted = common.written(queries.join(bounds, "query_id", "left").select("query_id", "vector", "bound", lists_now), "probes")
        found = near.drop("rank").unionByName(searched(wanted)).withColumn("rank", F.row_number().over(order))
        near = common.written(found.filter(F.col("rank") <= k), "near")
        start, stop = stop, stop * ROUND
    return near.select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return search(common.table(spark, directory, "embeddings"), F.col("vec_id") % 20 == 0)
