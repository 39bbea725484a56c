"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces of a vocabulary reads a text once. At each place it reports, over its output links, all pieces that end
there, longest first; each relaxes the best score of a segmentation up to that place (Viterbi). Characters that no piece ends with are written
as byte pieces, so that every text has an encoding and decodes to itself.

Ids are those of a segmentation with the largest sum of scores, as in a unigram model. Of equal sums the longer last piece wins.
A vocabulary that was made by merging pairs stores the ranks of its merges as scores; replaying the merges may give other ids, which decode to the same text.

No piece has a word mark after another character, so a text is a sequence of independent chunks that start at word marks, or at punctuation that in no
piece follows the character before. A task keeps the encodings of the chunks that it meets, in ``CACHE`` bytes at most: those met lately, and those of the time before. Decoding needs the bytes of each piece only,
no automaton.

Defined results: null and empty texts have no ids and decode to an empty text; the word mark U+2581 itself is written in bytes; ids that are no
pieces decode to nothing; an empty table gives an empty table; columns of the input named as an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
import string
import sys
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import common

#: The vocabulary of the registered query; operators take any path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of memory for the encodings that a worker process keeps, over both generations.
CACHE = 100_000_000
#: What an entry of a dictionary takes beside its key and the bytes of its value, with room for growth.
ENTRY = 110 + sys.getsizeof(b"")
WORST = float("-inf")
#: By how much an unknown character scores below the worst piece.
UNKNOWN = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their scores, and which ids are text, which are single bytes."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    text: tuple[bool, ...]
    byte: tuple[int, ...]  # the byte of a byte piece, -1 for others

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a ``.model`` file, read on the driver; tasks get the pieces, not the file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = tuple(model.id_to_piece(i) for i in ids)
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
        byte = tuple(int(pieces[i][1:-1], 16) if model.is_byte(i) else -1 for i in ids)
        return cls(pieces, tuple(model.get_score(i) for i in ids), tuple(not s for s in special), byte)

    def digest(self) -> str:
        return hashlib.sha256(repr((self.pieces, self.scores)).encode()).hexdigest()


class Decoder:
    """Decodes with one vocabulary: a list of bytes by id."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.raw = [
            bytes([b]) if b >= 0 else p.replace(MARK, " ").encode() if t else b""
            for p, b, t in zip(vocabulary.pieces, vocabulary.byte, vocabulary.text, strict=True)
        ]

    def decode(self, ids: Iterable[int] | np.ndarray) -> str:
        size = len(self.raw)
        known = ids[(ids >= 0) & (ids < size)].tolist() if isinstance(ids, np.ndarray) else [i for i in ids if 0 <= i < size]
        return b"".join(map(self.raw.__getitem__, known)).decode(errors="replace").removeprefix(" ")


class Encoder:
    """Encodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.automaton = ahocorasick.Automaton()
        texts = [(p, s, i) for i, (p, s, t) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.text, strict=True)) if t and p]
        for piece, score, i in texts:
            self.automaton.add_word(piece.replace(MARK, " "), (len(piece), score, i))
        self.automaton.make_automaton()
        if any(MARK in p[1:].lstrip(MARK) or (p[0] != MARK and MARK in p) for p, _, _ in texts):
            raise ValueError("a piece with a word mark inside needs whole texts as chunks")
        self.singles = {p.replace(MARK, " ") for p, _, _ in texts if len(p) == 1}
        self.pairs = {p[i : i + 2].replace(MARK, " ") for p, _, _ in texts for i in range(len(p) - 1)}
        self.bytes = {b: i for i, b in enumerate(vocabulary.byte) if b >= 0}
        if len(self.bytes) < 256:
            raise ValueError("a piece for each byte is needed for encodings that decode exactly")
        self.unknown = min(s for _, s, _ in texts) - UNKNOWN
        self.bare = (1, self.unknown, -1)
        alone = r"\n" if not any("\n" in p for p, _, _ in texts) else ""
        signs = re.escape(string.punctuation)
        body = rf"(?:[^ {alone}{MARK}{signs}]++|(?=[{signs}])(?:{self._signs()}))*+"
        self.chunks = re.compile("|".join([MARK, *([rf"{alone}+"] if alone else []), rf" +{body}", rf"[^ {alone}{MARK}]{body}"]))
        self.recent: dict[str, bytes] = {}  # encodings of chunks, and those of the generation before
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the recent ones

    def _signs(self) -> str:
        """A pattern of punctuation after a character that it follows in a piece: before any other a chunk ends."""
        before = {c: "".join(sorted(pair[0] for pair in self.pairs if pair[1] == c)) for c in string.punctuation}
        return "|".join(rf"{re.escape(c)}(?<=[{re.escape(b)}]{re.escape(c)})" for c, b in before.items() if b) or "(?!)"

    def _with_unknown(self, chunk: str, matches) -> Iterator[tuple[int, tuple[int, float, int]]]:
        """Matches and, before those that end later, each character that is no piece by itself."""
        unknown = [i for i, c in enumerate(chunk) if c not in self.singles][::-1]
        for last, found in matches:
            while unknown and unknown[-1] <= last:
                yield unknown.pop(), self.bare
            yield last, found
        while unknown:
            yield unknown.pop(), self.bare

    def best(self, chunk: str) -> list[int]:
        """The ids of the best segmentation of a chunk; spaces are word marks."""
        if chunk == MARK:
            return [self.bytes[b] for b in MARK.encode()]
        n = len(chunk)
        score, entry = [WORST] * n + [0.0], [None] * n  # by last place; the place before the first is -1
        matches = self.automaton.iter(chunk)
        if not self.singles.issuperset(chunk):
            matches = self._with_unknown(chunk, matches)
        for last, found in matches:
            size, value, _ = found
            total = score[last - size] + value
            if total > score[last]:
                score[last] = total
                entry[last] = found
        ids, last = [], n - 1
        while last >= 0:
            size, _, number = entry[last]
            if number >= 0:
                ids.append(number)
            else:
                ids.extend(self.bytes[b] for b in reversed(chunk[last].encode()))
            last -= size
        return ids[::-1]

    def _kept(self, chunk: str, compute) -> bytes:
        """The ids of a chunk as bytes, from those kept or else computed and kept."""
        ids = self.recent.get(chunk) or self.older.get(chunk) or compute(chunk)
        if len(chunk) < 64:
            self.held += sys.getsizeof(chunk) + len(ids) + ENTRY
            if self.held > CACHE // 2:
                self.older, self.recent, self.held = self.recent, {}, 0
            self.recent[chunk] = ids
        return ids

    def _by_parts(self, chunk: str) -> bytes:
        """A chunk falls into independent parts between two characters that are neighbours in no piece, as most words and their punctuation are."""
        together = list(map(self.pairs.__contains__, map(add, chunk, chunk[1:])))
        if all(together):
            return self._best_bytes(chunk)
        cuts = [i for i, pair in enumerate(together, 1) if not pair]
        bounds = zip([0, *cuts], [*cuts, len(chunk)], strict=True)
        return b"".join(self._kept(chunk[a:b], self._best_bytes) for a, b in bounds)

    def _best_bytes(self, chunk: str) -> bytes:
        return array("i", self.best(chunk)).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        chunks = self.chunks.findall(" " + text)
        parts = list(map(self.recent.get, chunks))
        if None in parts:
            parts = [self._kept(chunk, self._by_parts) if part is None else part for chunk, part in zip(chunks, parts, strict=True)]
        return np.frombuffer(b"".join(parts), np.int32)


_made: dict[type, tuple[str, Encoder | Decoder]] = {}


def _of_worker(kind: type, shared, digest: str):
    """The encoder or decoder of a worker process, made once from the broadcast vocabulary."""
    if _made.get(kind, ("",))[0] != digest:
        _made[kind] = (digest, kind(shared.value))
    return _made[kind][1]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens``. The vocabulary is broadcast: its size does not depend on the corpus."""
    shared, digest = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.digest()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encoder = _of_worker(Encoder, shared, digest)
        found, ends = bytearray(), [0]  # one buffer: a batch of long texts is not held twice
        for t in texts:
            found += encoder.encode(t.as_py()).data
            ends.append(len(found) // 4)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(found)]))

    plain, old = common.guarded(docs)
    # Marked as if it were not deterministic, the planner does not run it again inside a function of its result, such as decoding.
    encoded = plain.withColumn("ids", ids.asNondeterministic()(common.whole(old[text])))
    return encoded.select(*common.restored(old, {"ids": F.col("ids"), "n_tokens": F.size("ids").cast("long")}))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """A frame with the text of its ``ids``; null ids give an empty text."""
    shared, digest = encoded.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.digest()

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        decoder = _of_worker(Decoder, shared, digest)
        found, ends = bytearray(), [0]
        for v in lists:
            found += decoder.decode(v.values.to_numpy() if v.is_valid else []).encode()
            ends.append(len(found))
        return pa.Array.from_buffers(pa.string(), len(lists), [None, pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(found)])

    plain, old = common.guarded(encoded)
    return plain.select(*common.restored(old, {name: texts(old[ids])}))


def op2_sentencepiece(spark: SparkSession, directory: str) -> DataFrame:
    vocabulary = Vocabulary.read(MODEL)
    docs = common.documents(spark, directory).select("doc_id", common.whole(F.col("text")).alias("text"))
    both = decode(encode(docs, vocabulary), vocabulary)
    return both.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))
