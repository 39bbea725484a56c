import itertools

import numpy as np

from tallyhouse.llm import language

DATA = "/root/testdata/sf0.01"


def test_forward_backward_against_all_paths(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 3)
    random = np.random.default_rng(1)
    for _ in range(10):
        counts = np.array([5, 1, 7, 0, 3])
        scores, moves = random.normal(size=(counts.sum(), 3)), random.normal(size=(3, 3))
        here, pairs = language.forward_backward(scores, counts, moves)
        at, want, wanted = 0, [], np.zeros((3, 3))
        for count in counts.tolist():
            own, total, label, moved = scores[at : at + count], 0.0, np.zeros((count, 3)), np.zeros((3, 3))
            at += count
            if not count:
                continue
            for path in itertools.product(range(3), repeat=count + 1):
                weight = np.exp(sum(own[i, path[i + 1]] + moves[path[i], path[i + 1]] for i in range(count)))
                total += weight
                for i in range(count):
                    label[i, path[i + 1]] += weight
                    moved[path[i], path[i + 1]] += weight
            want.append(label / total)
            wanted += moved / total
        assert np.allclose(here, np.concatenate(want)) and np.allclose(pairs, wanted)


def test_words_of_switched_text_get_their_languages(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").filter("lang is not null").orderBy("doc_id").toPandas()
    texts = {name: group["text"].tolist() for name, group in rows.groupby("lang")}
    train = [(t, name) for name, group in texts.items() for t in group[:50]]
    field = language.train([t for t, _ in train], [n for _, n in train])
    own, other = " ".join(texts["de"][60].split()[:40]), " ".join(texts["es"][60].split()[:40])
    [here] = language.label_words(field, [f"{own} {other}"])
    labels = [field.languages[i] for i in here.argmax(1)]
    assert labels[:30].count("de") >= 27 and labels[-30:].count("es") >= 27


def test_held_out_documents(spark):
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = language.op10_language_id(spark, DATA).join(truth, "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_texts_without_letters_are_undetermined(spark):
    field = language.train(["the cat", "le chat"], ["en", "fr"])
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "12 — !"), (4, "le")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(frame, field).orderBy("doc_id").collect()] == ["und", "und", "und", "fr"]
