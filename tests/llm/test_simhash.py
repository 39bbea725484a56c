import random

import xxhash
from pyspark.sql import functions as F

from tallyhouse.llm import simhash
from tallyhouse.llm.components import components

DATA = "/root/testdata/sf0.001"


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def grouped(values, near):
    """The smallest position of each position's group."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def plain_print(text, width):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_against_plain_python(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    prints = [plain_print(t, 4) for _, t in docs]
    roots = grouped(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash_components(spark, DATA).collect()}
    assert got == {d: (f"{p:016x}", docs[r][0]) for (d, _), p, r in zip(docs, prints, roots, strict=True)}


def crowd(n, seed=3):
    """Fingerprints in chains around a few centres."""
    pick, values = random.Random(seed), set()
    centres = [pick.getrandbits(64) for _ in range(4)]
    while len(values) < n:
        value = pick.choice(centres if pick.random() < 0.7 or not values else sorted(values)[:50])
        for _ in range(pick.randrange(6)):
            value ^= 1 << pick.randrange(64)
        values.add(value)
    return sorted(values)


def linked(spark, frame, values):
    found = {r["node"]: r["root"] for r in components(frame).collect()}
    names = [found.get(signed(v), signed(v)) for v in values]
    first = {}
    return [first.setdefault(name, i) for i, name in enumerate(names)]


def test_links_connect_as_all_pairs_do(spark, monkeypatch):
    values = crowd(300)
    want = grouped(values, lambda a, b: (a ^ b).bit_count() <= 4)
    frame = spark.createDataFrame([(signed(v),) for v in values], "print long")
    assert linked(spark, simhash.links(frame), values) == want
    assert linked(spark, simhash.dense_links(frame.toDF("a")), values) == want
    monkeypatch.setattr(simhash, "SHARD", 10)
    assert linked(spark, simhash.links(frame), values) == want


def test_tree_follows_edges_within_the_radius_only():
    values = crowd(400, seed=5)
    tree = simhash.BKTree()
    for value in values:
        tree.add(value)
    for value in values[::7]:
        for radius in (0, 3, 9):
            assert sorted(tree.within(value, radius)) == [i for i, v in enumerate(values) if (v ^ value).bit_count() <= radius]


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(500)] + [(1000, 1000 + i) for i in range(500)] + [(7, 7), (2, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(501)} | {1000 + i: 1000 for i in range(500)}


def prose(pick, n):
    return [f"w{pick.randrange(3000)}" for _ in range(n)]


def test_near_duplicates_keep_the_smallest_id_of_each_group(spark, monkeypatch):
    pick, rows = random.Random(4), []
    for i in range(40):
        text = prose(pick, 400)
        rows.append((100 * i + 5, " ".join(text)))
        for j in range(i % 4):  # a few words changed
            near = [*text]
            for at in range(j + 1):
                near[40 + 90 * at] = f"new{i}x{j}"
            rows.append((100 * i + 6 + j, " ".join(near)))
    prints = [plain_print(t, 4) for _, t in rows]
    first = grouped(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {rows[r][0] for r in first}
    assert 40 <= len(want) < len(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.near_duplicates(frame).collect()} == want
    monkeypatch.setattr(simhash, "SHARD", 1)  # every shard is a crowd
    assert {r["doc_id"] for r in simhash.near_duplicates(frame).collect()} == want


def test_identical_rows_leave_one(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g")] * 2 + [(3, None), (4, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_duplicates(frame).select("doc_id").collect()) == [1, 3]
    assert simhash.clusters(frame).filter(F.col("doc_id") > 2).select("component_id").distinct().collect() == [(3,)]
