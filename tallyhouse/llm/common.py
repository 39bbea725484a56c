"""Helpers that several operators share: column guarding, tables written for reuse, word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that end a word.
SPACES = b" \t\n\x0b\x0c\r"

#: Used only when the session names no checkpoint folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or LOCAL_FOLDER).rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a Parquet table in the shared folder, read back: later jobs neither repeat its work nor depend on its executors.

    The table stays until the folder is cleared, since the result that reads it is lazy.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def guarded(frame: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with neutral column names ``_c0``, ``_c1`` ..., and its columns by their old names: nothing can clash with working columns."""
    names = frame.columns
    plain = frame.toDF(*(f"_c{i}" for i in range(len(names))))
    return plain, {name: F.col(f"_c{i}") for i, name in enumerate(names)}


def restored(columns: dict[str, Column], added: dict[str, Column]) -> list[Column]:
    """Old columns under their names, then ``added``; an added column replaces an old one of the same name in any case."""
    taken = {name.lower() for name in added}
    old = [column.alias(name) for name, column in columns.items() if name.lower() not in taken]
    return old + [column.alias(name) for name, column in added.items()]


def whole(text: Column) -> Column:
    """A text with null as empty."""
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text: equal texts share them, different ones do not but by a chance of 2**-128 a pair."""
    return [F.xxhash64(whole(text)), F.xxhash64(F.lit("key"), whole(text))]


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """The rows of each key of batches sorted by their column ``key``, for keys of two rows or more; those of over ``limit`` rows
    come in pieces, marked True, so that no piece holds a crowd."""
    rest, crowd = None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        keys = rest["key"].to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e - s > 1 or keys[s] == crowd:
                yield rest.slice(s, e - s), e - s > limit or keys[s] == crowd
        rest = rest.slice(int(starts[-1])).combine_chunks()
        if rest.num_rows > limit or keys[-1] == crowd:
            yield rest, True
            crowd, rest = keys[-1], rest.slice(0, 0)
    if rest is not None and rest.num_rows > 1:
        yield rest, False
