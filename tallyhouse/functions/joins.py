"""Joins of a fact table with a dimension of a size that is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, without running a job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_limit(df: DataFrame) -> int:
    """Bytes the session allows a broadcast side to have; negative means never."""
    setting = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    units = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    for unit, factor in units.items():
        if setting.endswith(unit):
            return int(setting[: -len(unit)]) * factor
    return int(setting)


def fits_broadcast(dimension: DataFrame, size_bytes: int | None = None) -> bool:
    size = estimated_bytes(dimension) if size_bytes is None else size_bytes
    return size <= broadcast_limit(dimension)


def join_shuffled(fact: DataFrame, other: DataFrame, key: str, size_bytes: int | None) -> DataFrame:
    """Inner join of a fact with another table that is too large to broadcast, both shuffled by a key that is unique in ``other``.

    Where ``other``, of ``size_bytes``, is within the broadcast limit on average of a shuffle partition, each task hashes its part of it and streams the facts
    past, so that none are held to be sorted. Adaptive execution splits a hot key as it does in a sort-merge join, which is what larger
    tables and those of unknown size (None) take: hashed rows cannot spill.
    """
    partitions = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = size_bytes is not None and not fits_broadcast(other, size_bytes) and size_bytes <= broadcast_limit(other) * partitions
    return fact.join(other.hint("shuffle_hash") if hashed else other, key)


def join_dimension(
    fact: DataFrame,
    dimension: DataFrame,
    key: str | list[str],
    spread: list[str] | None = None,
    size_bytes: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join on a key (one column or several) that is unique in ``dimension``.

    A dimension within the session's broadcast limit is broadcast. A larger one is joined on (key, salt): the fact rows
    of one hot key are spread over ``salts`` tasks by a hash of the ``spread`` columns, so the result is not
    partitioned by the key alone and a later ``groupBy`` on it combines before its shuffle.
    The salt is a hash and not random, so a recomputed task yields the same rows.
    Facts already aggregated to one row per key have nothing to spread and need no salt.
    """
    if fits_broadcast(dimension, size_bytes):
        return fact.join(F.broadcast(dimension), key)
    if spread is None:
        return fact.join(dimension, key)
    salted_fact = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_dimension = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = [key] if isinstance(key, str) else key
    return salted_fact.join(salted_dimension, [*keys, "_salt"]).drop("_salt")
