import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import periodic

DATA = "/root/testdata/sf0.001"


def brute(words):
    """Every run, by testing each period at each place."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(pick, n):
    out = []
    while len(out) < n:
        kind = pick.random()
        if kind < 0.4 and out:
            back = pick.randrange(1, min(len(out), 60) + 1)
            for _ in range(pick.randrange(1, 5 * back + 30)):
                out.append(out[-back])
        else:
            out += [b"%d" % pick.randrange(pick.choice([2, 5, 300])) for _ in range(pick.randrange(1, 40))]
    return out[:n]


def test_extensions_against_plain_comparison():
    pick = random.Random(1)
    for n in (2, 3, 10, 200, 700):
        for alphabet in (1, 2, 3, 50):
            numbers = np.array([pick.randrange(alphabet) for _ in range(n)])
            if n == 700:
                numbers = np.tile(numbers[:35], 20)
            left = np.array([pick.randrange(n - 1) for _ in range(300)])
            right = np.array([pick.randrange(i + 1, n) for i in left])
            got = periodic.Grammar(numbers).extension(left, right)
            for i, j, e in zip(left, right, got, strict=True):
                assert (numbers[i : i + e] == numbers[j : j + e]).all() and (j + e == n or numbers[i + e] != numbers[j + e])


def test_runs_against_brute_force(monkeypatch):
    pick = random.Random(2)
    texts = [repetitive(pick, n) for n in (0, 1, 23, 24, 25, 72, 100, 300, 300, 900, 900, 900, 900, 900)] + [[b"a"] * 500, [b"a", b"b"] * 12, [b"x"] * 23]
    want = [brute(t) for t in texts]
    assert sum(map(len, want)) > 20
    assert periodic.runs_of(texts) == want
    monkeypatch.setattr(periodic, "CANDIDATES", 7)
    assert periodic.runs_of(texts) == want
    assert [periodic.runs_of([t])[0] for t in texts] == want


def expected(key, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if key is None else str(key)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (key, len(runs), *best, milli, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    docs = [d for d in docs if len((d["text"] or "").split()) < 4000]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in periodic.op11_periodic_runs(spark, DATA).collect()}
    assert len(docs) > 150 and sum(got[d["doc_id"]][1] for d in docs) > 10
    for d in docs:
        assert got[d["doc_id"]] == expected(d["doc_id"], d["text"])


def test_odd_rows(spark, tmp_path):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(i, " ".join(f"w{k % 97}" for k in range(150))) for i in ids]
    rows += [(None, "a b c d " * 20), (None, None), (1, None), (1, ""), (2, " \n\t\x0b"), (2, " \n\t\x0b"), (3, "été x  " * 30), (-4, "\x1c \x1d " * 20), (ids[0], "one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("runs"), F.lit(2).alias("_n"), F.lit(3).alias("Best"), F.lit(4).alias("_c0"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert order(got) == order([expected(*r) for r in rows])
    kept = periodic.periodic_runs(frame)
    assert kept.columns == ["doc_id", "text", "_n", "Best", "_c0", "n_words", "runs", "collapsed"]
    assert kept.count() == len(rows) and periodic.periodic_runs(frame.filter("doc_id > 9999")).count() == 0
