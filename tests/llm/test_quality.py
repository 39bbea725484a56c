import math

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import quality

DATA = "/root/testdata/sf0.01"


def test_rules_in_spark_score_as_in_plain_python(spark):
    random = np.random.default_rng(1)
    names = ["a", "b", "c"]
    values = random.normal(size=(400, 3))
    labels = ((values[:, 0] > 0.3) & (values[:, 1] < 0.5)).astype(float)
    ensemble = quality.fit(values, labels, names)
    logit = np.full(400, ensemble.intercept)
    for rule in ensemble.rules:
        logit += rule.weight * rule.holds(values, names)
    frame = spark.createDataFrame([tuple(map(float, v)) for v in values], "a double, b double, c double")
    got = [r[0] for r in frame.select(ensemble.score({n: F.col(n) for n in names})).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-logit)))
    assert ((np.array(got) > 0.5) == labels).mean() > 0.95


def test_penalty_drops_rules_that_say_nothing():
    random = np.random.default_rng(2)
    design = random.integers(0, 2, (500, 20)).astype(float)
    weights, _ = quality.lasso_logistic(design, design[:, 3], penalty=0.05)
    assert weights[3] > 0.5 and np.abs(np.delete(weights, 3)).max() < 0.05


def test_statistics_of_a_text(spark):
    text = "One two!\nAB | 12\nOne two!"
    frame = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    rows = frame.select(*(c.alias(n) for n, c in quality.statistics(F.col("text")).items())).collect()
    assert rows[0]["n_words"] == 7 and math.isclose(rows[0]["repeated_lines"], 1 / 3) and math.isclose(rows[0]["mark_share"], 2 / 7)
    assert set(rows[1]) == set(rows[2]) == {0.0}


def test_held_out_texts_are_told_apart(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.op7_quality_rules(spark, DATA).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) / len(good) > 0.97
    assert sum(1 - r["predicted"] for r in bad) / len(bad) > 0.8
