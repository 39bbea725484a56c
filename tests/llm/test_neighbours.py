import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyhouse.llm import neighbours

DATA = "/root/testdata/sf0.01"


def exact(ids, vectors, query, k):
    scores = (vectors * vectors[query]).sum(1)
    order = [i for i in np.lexsort((ids, -scores)) if i != query][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def test_query_finds_nearly_all_true_neighbours(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    got = {}
    for r in neighbours.op8_nearest_neighbours(spark, DATA).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for query in np.flatnonzero(ids % 20 == 0):
        want, found = exact(ids, vectors, query, 20), got[ids[query]]
        assert sorted(found) == list(range(1, 21)) and all(found[i][1] >= found[i + 1][1] for i in range(1, 20))
        hits += len(set(want) & set(found.values()))
    assert hits / (20 * len(got)) >= 0.9 and len(got) == (ids % 20 == 0).sum()


def test_lengths_differ_and_a_vector_has_many_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    random = np.random.default_rng(3)
    vectors = random.normal(size=(900, 12)) * random.uniform(0.2, 3, (900, 1))
    vectors[300:600] = vectors[300]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(frame, F.col("vec_id") % 30 == 0, lists=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for query, found in got.items():
        want = exact(np.arange(900), vectors, query, 20)
        assert len(found) == 20
        hits += len({i for i, _ in want} & {i for _, i, _ in found})
        total += 20
    assert len(got) == 30 and hits / total >= 0.9


def test_the_test_of_partial_distances_keeps_the_nearest():
    random = np.random.default_rng(4)
    base, queries = random.normal(size=(3000, 65)), random.normal(size=(20, 65))
    distances = ((base[None] - queries[:, None]) ** 2).sum(2)
    bounds = np.sort(distances, axis=1)[:, 19]
    i, j = neighbours.survivors(base, queries, bounds, 65.0)
    true = {(q, c) for q in range(20) for c in np.argsort(distances[q])[:20].tolist()}
    assert len(true - set(zip(i.tolist(), j.tolist(), strict=True))) <= 8 and len(i) <= 400


def test_a_block_scores_ties_by_id_and_leaves_out_the_query():
    vectors = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    base = pd.DataFrame({"vec_id": [4, 3, 2, 1], "vector": list(vectors)})
    queries = pd.DataFrame({"query_id": [3, 9], "vector": [vectors[0], vectors[2]], "bound": [np.nan, 0.5]})
    index = neighbours.fit(vectors, 1.0, 1, 2)
    got = neighbours.search_block(base, queries, index, 2)
    assert got.to_numpy().tolist() == [[3, 1, 1.0], [3, 4, 1.0], [9, 2, 1.0]]


def test_few_lists_or_many_find_the_same_nearest(spark):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(400, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    for lists in (1, 40):
        got = neighbours.search(frame, F.col("vec_id") % 50 == 0, lists=lists).collect()
        hits = sum((r["vec_id"], r["score"]) in exact(np.arange(400), vectors, r["query_id"], 20) for r in got)
        assert len(got) == 160 and hits >= (160 if lists == 1 else 144)
