import hashlib
import random

from pyspark.sql import functions as F

from tallyhouse.llm import merkle

DATA = "/root/testdata/sf0.001"


def test_query_against_plain_python(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in merkle.op5_document_fingerprints(spark, DATA).collect()}
    assert len(got) == len(docs)
    prints = {}
    for i, (doc_id, text) in enumerate(docs):
        following, n = docs[(i + 1) % len(docs)][1], len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        row = got[doc_id]
        assert (row["n_chars"], row["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert (text == edited) == (row["near_edited"] == 1.0 and row["fingerprint"] == row["edited_fingerprint"])
        assert 0 <= row["near_next"] <= 1
    assert len(set(prints.values())) == len(prints)
    assert sum(r["near_edited"] for r in got.values()) / len(got) > 0.5 > 0.1 > sum(r["near_next"] for r in got.values()) / len(got)


def test_next_smaller_number_at_every_distance(spark):
    pick = random.Random(1)
    values = {0, 1, -1, 5, 1 << 40, -(1 << 50)} | {pick.randrange(-(1 << 56), 1 << 56) for _ in range(200)} | {pick.randrange(0, 1 << 17) for _ in range(200)}
    frame = spark.createDataFrame([(v,) for v in values], "value long")
    got = dict(map(tuple, merkle.following(frame).collect()))
    ordered = sorted(values, reverse=True)
    assert got == {v: ordered[(i + 1) % len(ordered)] for i, v in enumerate(ordered)}
    assert merkle.following(spark.createDataFrame([(3,)], "value long")).collect() == [(3, 3)]


def test_differing_branches_locate_an_edit(spark):
    lines = [f"Sentence number {i} of this text.\n" for i in range(200)]
    edited = [*lines]
    edited[120] = "Something else stands here.\n"
    frame = spark.createDataFrame([("".join(lines), "".join(edited))], "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    row = frame.select(merkle.differing(a, b).alias("d"), merkle.differing(a, a).alias("same"), merkle.likeness(a, b).alias("l"), F.size(merkle.sections(a)).alias("s")).first()
    assert row["d"] == [120] and row["same"] == [] and row["l"] == 199 / 200 and row["s"] > 5


def test_leaves_hold_the_whole_text(spark):
    texts = ["", "a", "a.b", "...\n\n x", "y" * 1000, "É. Ü! \n?" * 50, "\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", F.array_join(F.regexp_extract_all("t", F.lit(merkle.LEAF), F.lit(0)), "").alias("all")).collect():
        assert row["all"] == row["t"]
