"""From raw documents to token ids in five stages, each one operator of ``tallyhouse.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``. ``ORACLE_SQL`` is None: SQL expresses neither the classifier nor the near-duplicate search nor the encoding, so the tests
compare the stages with plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import common, mixing, pieces, quality, simhash, suffixes


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labels of the corpus. With too few labels for rules none is rejected."""
    ensemble = quality.learn(docs, common.table(spark, sf_dir, "labels"))
    if not ensemble.rules:
        return docs
    return quality.score(docs, ensemble).filter("predicted = 1").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each component of fingerprints: four-word shingles, links at four or fewer differing bits."""
    return simhash.near_duplicates(docs, width=4, radius=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that occur twice or more out of the texts; ``n_chars`` follows. A text may become empty, its row stays."""
    cut = suffixes.remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources to their target weights: a document leaves, stays, or is repeated as rows."""
    return mixing.repeated(mixing.mix(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    encoded = pieces.encode(docs, pieces.Vocabulary.read(pieces.MODEL))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing to target weights", mix),
    ("SentencePiece encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, all before it written to the shared folder."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
