"""Both deduplicators of repeated windows against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import automata, suffixes, windows

DATA = "/root/testdata/sf0.001"


def plain_bytes(docs, length):
    """Per document: bytes, removed, spans and hash of the kept bytes."""
    starts = Counter(raw[i : i + length] for raw in docs for i in range(len(raw) - length + 1))
    out = []
    for raw in docs:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if starts[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:1].sum()) + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def plain_words(docs, length):
    """Per document, in order: words, removed and hash of the kept words."""
    seen, out = set(), []
    for text in docs:
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, n=60):
    """Documents of few different words with shared passages, copies, runs of one letter and nested repeats."""
    pick = random.Random(seed)
    words = ["a", "bb", "ç", "dd", "e" * 9, "f"]
    passages = [" ".join(pick.choice(words) for _ in range(pick.randrange(2, 30))) for _ in range(6)]
    docs = []
    for _ in range(n):
        parts = [pick.choice(passages) if pick.random() < 0.4 else " ".join(str(pick.randrange(10**6)) for _ in range(pick.randrange(8))) for _ in range(pick.randrange(6))]
        docs.append(" ".join(parts))
    return docs + [docs[0], docs[1], docs[1] + " tail", "a " * 60, "aaaa" * 30, "", "x"]


def frame_of(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("limit", [None, 1])
def test_bytes_against_brute_force(spark, monkeypatch, seed, limit):
    docs = made(seed)
    if limit:
        monkeypatch.setattr(suffixes, "CROWD", limit)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(frame_of(spark, docs), length=24, gram=7).collect()}
    assert got == dict(enumerate(plain_bytes([t.encode() for t in docs], 24)))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("limit", [None, 1])
def test_words_against_brute_force(spark, monkeypatch, seed, limit):
    docs = made(seed + 10)
    if limit:
        monkeypatch.setattr(automata, "CROWD", limit)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in automata.remove_later(frame_of(spark, docs), length=6, gram=2).collect()}
    assert got == dict(enumerate(plain_words(docs, 6)))


def test_queries_against_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.op4_suffix_array_dedup(spark, DATA).collect()}
    assert got == {d: want for (d, _), want in zip(docs, plain_bytes([t.encode() for _, t in docs], 200), strict=True)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in automata.op9_substring_dedup(spark, DATA).collect()}
    assert got == {d: want for (d, _), want in zip(docs, plain_words([t for _, t in docs], 20), strict=True)}


def test_segments_of_a_long_text_change_nothing(monkeypatch):
    text = " ".join(str(random.Random(2).randrange(50)) for _ in range(4000))
    looked = windows.Windows(30, 8, windows.byte_symbols)

    def places():
        _, _, lo, n, off = looked.anchors(looked.symbols(text))
        return [(int(a + o), int(a + i)) for a, c, o in zip(lo, n, off, strict=True) for i in range(c)]

    whole = places()
    monkeypatch.setattr(windows, "SEGMENT", 700)
    assert places() == whole and [w for _, w in whole] == list(range(len(text) - 29))


def test_multikey_sort_finds_equal_rows():
    random_rows = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.uint64)
    groups = np.random.default_rng(2).integers(0, 3, 500)
    classes = suffixes.equal_classes(random_rows, groups)
    keys = [(g, *r) for g, r in zip(groups.tolist(), random_rows.tolist(), strict=True)]
    assert len({(k, c) for k, c in zip(keys, classes.tolist(), strict=True)}) == len(set(keys)) == len(set(classes.tolist()))


def test_automaton_matches_like_a_search():
    pick = random.Random(6)
    added = [[pick.randrange(3) for _ in range(pick.randrange(1, 40))] for _ in range(12)]
    automaton = automata.SuffixAutomaton()
    for sequence in added:
        automaton.add(sequence)
    text = "|".join("".join(map(str, s)) for s in added)
    asked = [pick.randrange(4) for _ in range(300)]
    for end, size in enumerate(automaton.matching(asked)):
        found = "".join(map(str, asked[end + 1 - size : end + 1]))
        assert found in text
        assert size == end + 1 or "".join(map(str, asked[end - size : end + 1])) not in text


def test_recurring_contexts_across_buckets(spark):
    """A context that fills several buckets, ones that end where a bucket does, and single ones."""
    pick = random.Random(5)
    rows = [(pick.randrange(3), 7 if pick.random() < 0.5 else pick.randrange(40), i, 0, i, 1) for i in range(300)]
    frame = spark.createDataFrame(rows, "gram long, context long, k1 long, k2 long, lo int, n int")
    times = Counter(r[:2] for r in rows)
    assert sorted(r["k1"] for r in suffixes._recurring(frame).collect()) == [r[2] for r in rows if times[r[:2]] > 1]
