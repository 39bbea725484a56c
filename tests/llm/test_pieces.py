import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import pieces

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read(pieces.MODEL)


@pytest.fixture(scope="module")
def decoder(vocabulary):
    return pieces.Decoder(vocabulary)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return pieces.Encoder(vocabulary)


def best_sum(text, scores, unknown):
    """The largest sum of scores over all segmentations, by plain dynamic programming over all substrings."""
    marked = (" " + text).replace(" ", pieces.MARK)
    best = [0.0] + [float("-inf")] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 50), end):
            part = marked[start:end]
            if part in scores:
                best[end] = max(best[end], best[start] + scores[part])
            elif end - start == 1:
                best[end] = max(best[end], best[start] + unknown)
    return best[-1]


def test_segmentations_have_the_largest_sum(vocabulary, encoder):
    scores = {p: s for p, s, t in zip(vocabulary.pieces, vocabulary.scores, vocabulary.text, strict=True) if t}
    pick = random.Random(1)
    letters = "abcdeorstinéü .,?日\n"
    for _ in range(300):
        text = "".join(pick.choice(letters) for _ in range(pick.randrange(1, 30)))
        ids = encoder.encode(text).tolist()
        total, waiting = 0.0, 0
        for i in ids:
            if vocabulary.byte[i] >= 0:
                total += encoder.unknown if waiting == 0 else 0  # the bytes of one unknown character
                lead = vocabulary.byte[i]
                waiting = waiting - 1 if waiting else (0 if lead < 128 else 1 if lead < 224 else 2 if lead < 240 else 3)
            else:
                total += vocabulary.scores[i]
        assert abs(total - best_sum(text, scores, encoder.unknown)) < 1e-6


def test_round_trip_of_odd_texts(encoder, decoder):
    for text in ["", " ", "  a  b ", "\n\n x\t", "日本語 テスト\t€ 😀", "▁a ▁▁", "a b\x00", "x" * 3000, "     ", "a    b\nc   ", "​", "tail "]:
        assert decoder.decode(encoder.encode(text).tolist()) == text


def test_decoding_agrees_with_the_library(vocabulary, encoder, decoder):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in ["The cat sat on the mat.", "Über été, señor!", "two  spaces"]:
        ids = encoder.encode(text).tolist()
        assert library.decode(ids) == text and decoder.decode(library.encode(text)) == text


def test_query_round_trips(spark):
    got = pieces.op2_sentencepiece(spark, DATA)
    assert got.filter(~F.col("round_trip") | (F.size("ids") != F.col("n_tokens"))).count() == 0
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_a_full_cache_is_emptied(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 2000)
    small = pieces.Encoder(vocabulary)
    text = " ".join(f"word{i}" for i in range(50))
    assert small.encode(text).tolist() == pieces.Encoder(vocabulary).encode(text).tolist() and len(small.recent) <= 5 and len(small.older) <= 5


def test_chunks_end_before_punctuation_that_no_piece_has_there(vocabulary):
    counting = pieces.Encoder(vocabulary)
    searched, best = [], counting.best
    counting.best = lambda chunk: searched.append(chunk) or best(chunk)
    together = {p[i : i + 2] for p, t in zip(vocabulary.pieces, vocabulary.text, strict=True) if t for i in range(len(p) - 1)}
    signs = [c for c in ",;:!?()" if "q" + c not in together]
    assert len(signs) > 1
    counting.encode(" ".join(f"reqreq{c}" for c in signs))
    assert counting.chunks.findall(f" reqreq{signs[0]} a") == [" reqreq", signs[0], " a"]
    assert searched.count(" reqreq") == 1 and not any(f"q{c}" in chunk for c in signs for chunk in counting.recent)


def test_cutting_before_punctuation_changes_no_ids(vocabulary, encoder):
    whole = pieces.Encoder(vocabulary)
    whole.chunks = pieces.re.compile(rf"{pieces.MARK}|\n+| +[^ \n{pieces.MARK}]*|[^ \n{pieces.MARK}]+")
    pick = random.Random(5)
    letters = "aenrt  ,.;:!?$*()[]-_'\"\n\té日▁1290/\\^&#@%+=<>|~`{}"
    for _ in range(3000):
        text = "".join(pick.choice(letters) for _ in range(pick.randrange(1, 40)))
        assert encoder.encode(text).tolist() == whole.encode(text).tolist()


def test_arrays_decode_as_lists(decoder):
    ids = [5, -1, 400, 70_000, 31_999, 300]
    assert decoder.decode(pieces.np.array(ids, pieces.np.int32)) == decoder.decode(ids) == decoder.decode(iter(ids)) != ""


def test_frames_with_nulls_and_empty_texts(spark, vocabulary):
    texts = [None, "", "日本 été", "a, b", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    both = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    got = {row.i: row for row in both.collect()}
    assert [got[i].decoded for i in range(5)] == ["", "", *texts[2:]]
    one = pieces.Encoder(vocabulary)
    assert all(got[i].ids == one.encode(t).tolist() and got[i].n_tokens == len(got[i].ids) for i, t in enumerate(texts))
    lists = spark.createDataFrame([(None,), ([],), (got[3].ids,)], "ids array<int>").coalesce(1)
    assert sorted(r.decoded for r in pieces.decode(lists, vocabulary).collect()) == ["", "", "a, b"]
    assert pieces.decode(pieces.encode(docs.filter("i < 0"), vocabulary), vocabulary).collect() == []
