import math

from pyspark.sql import functions as F

from tallyhouse.llm import mixing


def filled(sizes: dict, weights: dict, epochs: int) -> dict:
    """Water-filling in rounds: clamp whoever is above, share the rest again."""
    clamped = {}
    while True:
        rest = sum(sizes.values()) - sum(clamped.values())
        free = [s for s in sizes if s not in clamped]
        total = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / total > epochs * sizes[s]]
        if not over:
            return clamped | {s: rest * weights[s] / total for s in free}
        clamped |= {s: epochs * sizes[s] for s in over}


def test_targets_are_filled_in_rounds(spark):
    sizes = {"a": 1000, "b": 10, "c": 3, "d": 70, "é": 500, "Z": 1}
    docs = spark.createDataFrame([(i, "w " * 1, s) for s, n in sizes.items() for i in range(n)], "doc_id long, text string, source string")
    got = {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    want = filled(sizes, weights, 3)
    for s in sizes:
        assert math.isclose(got[s]["target"], want[s], rel_tol=1e-12)
        assert abs(got[s]["taken"] - want[s]) <= 0.5 + 1e-6


def test_given_weights_and_budget(spark):
    docs = spark.createDataFrame([(i, "a b c d", "xy"[i % 2]) for i in range(100)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 3), ("z", 1)], "source string, weight int")
    mixed = mixing.mix(docs, weights=weights, budget=500, max_epochs=4)
    taken = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert taken == {"x": 500, "y": 0}
    rows = mixing.repeated(mixed, docs.columns).groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in rows) == 125 and {r["count"] for r in rows} == {2, 3}


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 17), "abc"[i % 3] if i % 50 else None) for i in range(600)], "doc_id long, text string, source string")
    first = sorted(map(tuple, mixing.mix(docs).select("doc_id", "repeats").collect()))
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(7)).select("doc_id", "repeats").collect()))
