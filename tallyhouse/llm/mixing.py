"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Each source has a weight and a size in words. A budget of words is shared by weight; a source whose share exceeds ``max_epochs`` times
its size is clamped there and its excess is shared among the others by weight, until none is above. Sorted by cap over weight the
clamped sources come first, so that one ordered pass over the sources gives the level at which this ends.

A source that is to be read 1.6 times takes every document once and, for the remaining 0.6, documents in a seeded random order until
the remaining words are reached. The order is cut into 4,096 bins per source by the leading digits of the random key, so that the running
total is a sum over bins and then a sum within one bin: no task holds a source, and a source with a third of all rows is spread evenly.

Defined results: a null text has size 0; null is a source of its own, last in order; a source without words gets target 0 and keeps each
document zero or more times without effect; an empty table gives an empty table; identical rows are separate documents, ordered arbitrarily
among themselves; columns of the input named as an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhouse.llm import common

MAX_EPOCHS = 3
SEED = 17


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` 1, 2, 3, 1, ... to a table of sources, in the order of code points, null last.

    The one ordered pass sees one row per source, never documents.
    """
    ordered = W.orderBy(F.col("source").isNull(), "source")
    return sources.withColumn("weight", ((F.row_number().over(ordered) - 1) % 3 + 1).cast("long"))


def water_level(sources: DataFrame, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """Adds ``target`` to ``(source, source_size long, weight long)``: its share of ``budget`` words (default: all words).

    A budget above what all caps allow gives every source its cap.
    """
    everything = W.partitionBy()
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) if budget is None else F.lit(budget).cast("long")
    return (
        sources.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("_left", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double"))
        .withColumn("_open", (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
        .withColumn("_clamped", F.col("_left") * F.col("weight") >= F.col("cap") * F.col("_open"))
        .withColumn("_level", F.max(F.when(~F.col("_clamped"), F.col("_left") / F.col("_open"))).over(everything))
        .withColumn(
            "target", F.when(F.col("_clamped"), F.col("cap").cast("double")).otherwise(F.col("_level") * F.col("weight"))
        )
        .select("source", "source_size", "weight", "target")
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: DataFrame | None = None,
    max_epochs: int = MAX_EPOCHS,
    budget: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``repeats`` (how often the mix reads the document) and ``taken`` words.

    ``weights`` is a table ``(source, weight)`` of positive whole numbers; sources it lacks weigh 0 and are not read. Without it sources
    weigh 1, 2, 3, repeating. Each source's taken words differ from its target by at most half of one document.
    """
    plain, old = common.guarded(docs)
    random = F.md5(F.concat_ws(":", F.lit(str(seed)), common.whole(old[key].cast("string"))).cast("binary"))
    sized = plain.select(
        "*",
        old[source].alias("source"),
        F.coalesce(F.concat(F.lit("="), old[source]), F.lit("")).alias("place"),
        common.n_words(old[text]).alias("size"),
        random.alias("random"),
        F.substring(random, 1, 3).alias("bin"),
    )
    bins = sized.groupBy("place", "source", "bin").agg(F.sum("size").alias("bin_size"))
    sources = bins.groupBy("place", "source").agg(F.sum("bin_size").alias("source_size"))
    if weights is None:
        weighed = cyclic_weights(sources)
    else:
        given = weights.select(
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("place"), F.col("weight").cast("long").alias("weight")
        ).filter("weight > 0")
        weighed = sources.join(given, "place")
    levels = water_level(weighed.select("source", "source_size", "weight"), max_epochs, budget)
    levels = levels.withColumn("place", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source", "weight")
    earlier = W.partitionBy("place").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        bins.select("place", "bin", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)).alias("bin_start"))
        .join(levels, "place", "left")
        .withColumn("target", F.coalesce("target", F.lit(0.0)))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    )
    in_bin = W.partitionBy("place", "bin").orderBy("random").rowsBetween(W.unboundedPreceding, -1)
    middle = 2 * (F.col("bin_start") + F.col("in_bin")) + F.col("size")
    return (
        sized.join(starts, ["place", "bin"])
        .withColumn("in_bin", F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
        .withColumn("repeats", (F.col("rounds") + F.when(middle < 2 * F.col("rest"), 1).otherwise(0)).cast("int"))
        .select(
            *common.restored(
                old,
                {
                    "size": F.col("size"),
                    "source_size": F.coalesce("source_size", F.lit(0)).cast("long"),
                    "target": F.col("target"),
                    "repeats": F.col("repeats"),
                    "taken": (F.col("size") * F.col("repeats")).cast("long"),
                },
            )
        )
    )


def repeated(mixed: DataFrame, columns: list[str], repeats: Column | None = None) -> DataFrame:
    """Each document of a mix as often as the mix reads it, as rows."""
    times = F.col("repeats") if repeats is None else repeats
    return mixed.filter(times > 0).withColumn("_turn", F.explode(F.sequence(F.lit(1), times))).select(*columns)


def op1_mix_sources(spark: SparkSession, directory: str) -> DataFrame:
    return mix(common.documents(spark, directory)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{common.WORD}')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS random
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, {MAX_EPOCHS} * source_size AS cap FROM sources),
lefts AS (
  SELECT *,
    CAST((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER w, 0) AS DOUBLE) AS words_left,
    CAST((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS weight_left
  FROM weighed
  WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    CASE WHEN words_left * weight >= cap * weight_left THEN CAST(cap AS DOUBLE)
         ELSE weight * (SELECT max(words_left / weight_left) FROM lefts WHERE words_left * weight < cap * weight_left) END AS target
  FROM lefts),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS rounds,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY random ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (rounds + CASE WHEN 2 * before + size < 2 * (target - rounds * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
