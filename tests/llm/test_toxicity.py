import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_sentences_cover_the_text():
    text = "One two. Three!? four\n\nfive 3.5 six.\n... end"
    assert toxicity.SENTENCE.findall(text) == ["One two.", " Three!?", " four", "five 3.5 six.", "...", " end"]
    assert toxicity.words_of("The Été x2y, the_end") == ["end", "the", "x", "y", "été"]


def test_noisy_or_of_sentences():
    model = toxicity.Model({"bad": 2.0, "awf-": 1.0, "awfu-": 1.0}, -1.0, 0.1)
    one, two = 1 / (1 + math.exp(-1)), 1 / (1 + math.exp(-1))  # bad alone; both beginnings of a word
    assert math.isclose(model.document("All fine. It is BAD! Quite awful, yes.\nGood."), 1 - 0.9 * (1 - one) * (1 - two))
    assert model.document("") == model.document(None) == model.document("nothing here. at all") == 0.1
    assert [(s, e) for s, e, _ in model.scored("Good. Bad bad. fine\nbad")] == [(5, 14), (20, 23)]


def test_slope_learns_the_guilty_sentences():
    pick = random.Random(1)
    bags, labels = [], []
    for d in range(600):
        bag = [[pick.randrange(1, 6)] for _ in range(pick.randrange(1, 8))]
        labels.append(float(d % 4 == 0))
        if labels[-1]:
            bag.insert(pick.randrange(len(bag) + 1), [0, pick.randrange(1, 6)])
        bags.append(bag)
    weights, offset, leak = toxicity.noisy_or(bags, np.array(labels), 6)
    score = lambda s: 1 / (1 + math.exp(-offset - sum(weights[w] for w in s)))
    assert all(score([0, w]) > 0.8 and score([w]) < 0.1 for w in range(1, 6)) and leak < 0.05


def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = toxicity.op12_toxicity(spark, DATA).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.75
    assert sum(1 - r["predicted"] for r in clean) / len(clean) > 0.99
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_query_scores_as_the_model_alone(spark):
    small = DATA.replace("0.1", "0.01")
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    assert model == toxicity.learn(docs.repartition(7), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.op12_toxicity(spark, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    assert all(math.isclose(got[i], model.document(t), abs_tol=1e-12) for i, t in texts.items())
    blamed = toxicity.offending(docs, model).collect()
    assert blamed and all(texts[r["doc_id"]][r["start"] : r["end"]] == r["sentence"] and r["score"] >= 0.5 for r in blamed)
    assert {r["doc_id"] for r in blamed} <= {i for i, s in got.items() if s >= 0.5}


def test_odd_rows(spark):
    good, bad = [f"calm word{chr(97 + i % 26)}{chr(97 + i // 26)} here." for i in range(60)], [f"such a fiend w{chr(97 + i)}." for i in range(20)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (502, " \n"), (None, "a fiend."), (503, "x. " * 60_000), (503, "x. " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(7).alias("label"), F.lit(8).alias("SCORE"), F.lit(9).alias("id"), F.lit(1).alias("_c0"))
    marks = [(i, int(i >= 60)) for i in range(80)] + [(500, None), (None, 1), (3, 5), (501, 0), (7, 0), (7, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn(docs.unionAll(docs.filter("doc_id = 61")), labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "label", "id", "_c0", "score", "predicted"] and got.count() == len(rows)
    by = {r["doc_id"]: r["predicted"] for r in got.collect()}
    assert by[None] == 1 and by[500] == by[501] == by[502] == by[503] == by[1] == 0 and all(by[i] for i in range(60, 80))
    none = docs.filter("doc_id < -5")
    assert toxicity.score(none, model).count() == 0 and toxicity.offending(none, model).count() == 0
    unlearned = toxicity.learn(none, labels)
    assert unlearned.weights == {} and toxicity.score(docs, unlearned).filter("score = 0.5").count() == len(rows)
    assert toxicity.learn(docs, labels.filter("doc_id < 0")).leak == 0.5
