"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import automata, html, language, merkle, mixing, neighbours, pieces, quality, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [
    (1, "the cat sat on the mat and the dog sat on the log all day long", "en", "a", 1),
    (2, "the cat sat on the mat and the dog sat on the log all day long", "en", "a", 1),
    (2, "the cat sat on the mat and the dog sat on the log all day long", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "fr", "b", 0),
    (5, " \n\t ", "fr", "b", 4),
    (None, "le chat est sur la table et le chien est dans la maison", "fr", None, 3),
    (7, LONG, "en", "a", 3),
    (8, "日本語 — été ▁ 😀\n!", None, "b", 3),
]
CLASHES = ["size", "SCORE", "gram", "k1", "node", "key", "target", "ids", "fingerprint", "print", "body", "_c0", "list", "random", "bin", "place"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.select("*", *(F.lit(7).alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < -5")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read(pieces.MODEL)


def operators(spark, vocabulary):
    ensemble = quality.RuleEnsemble((quality.Rule((("n_words", True, 3.0),), 1.0),), 0.0)
    field = language.train(["the cat sat on", "le chat est la"], ["en", "fr"])
    return {
        "mix": mixing.mix,
        "fingerprints": merkle.fingerprints,
        "clusters": simhash.clusters,
        "near_duplicates": simhash.near_duplicates,
        "suffixes": suffixes.remove_repeats,
        "automata": automata.remove_later,
        "pieces": lambda d: pieces.decode(pieces.encode(d, vocabulary), vocabulary),
        "quality": lambda d: quality.score(d, ensemble),
        "language": lambda d: language.identify(d, field),
        "html": lambda d: html.extract(d, "text"),
    }


@pytest.mark.parametrize("name", ["mix", "fingerprints", "clusters", "near_duplicates", "suffixes", "automata", "pieces", "quality", "language", "html"])
def test_every_row_gets_a_result(spark, docs, none, vocabulary, name):
    operator = operators(spark, vocabulary)[name]
    got = operator(docs).collect()
    assert len(got) == (5 if name == "near_duplicates" else len(ROWS))  # three cats are one, three texts without words are one
    assert operator(none).count() == 0
    columns = [c.lower() for c in operator(docs).columns]
    assert len(set(columns)) == len(columns)
    assert {c.lower() for c in CLASHES} <= set(columns)


def test_ring_on_odd_rows(spark, docs):
    ringed = merkle.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", F.xxhash64("text")).collect()
    assert len(ringed) == len(ROWS)
    by_id = {r["doc_id"]: r["next"] for r in ringed}
    assert by_id[8] == LONG and by_id[4] == "" and by_id[1] == ROWS[6][1] and by_id[None] == ROWS[8][1]
    assert {r["next"] for r in ringed if r["doc_id"] == 2} == {ROWS[0][1]}


def test_neighbours_leave_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, None), (40, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (60, [1.0, 0.0]), (60, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("rank", F.lit(2))
    got = neighbours.search(vectors, F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == {0: [(1, 1.0), (60, 1.0), (60, 1.0), (2, 0.5)], 60: [(0, 1.0), (1, 1.0), (2, 0.5)]}
    assert neighbours.search(vectors.filter("vec_id < 0"), F.lit(True)).count() == 0


def test_learning_from_nothing(spark, docs, none):
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 5)], "doc_id long, quality int")
    assert quality.score(docs, quality.learn(docs, labels)).filter("score = 0.5").count() == len(ROWS)
    assert language.identify(docs, language.learn(none)).filter("lang_pred = 'und'").count() == len(ROWS)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, docs, none, tmp_path, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame = (none if empty else docs).drop(*CLASHES)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == frame.columns
        frame = after
    assert empty == (frame.count() == 0)
