"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs: the text cut after line ends and sentence ends, and after 160 characters where neither comes. A section is a run
of leaves that ends with a leaf whose hash ends in 0, so an edit moves no boundary but its own. A section's hash is the hash of its leaves'
hashes, the root that of the sections' hashes. Equal roots mean equal texts; where roots differ, sections and leaves that only one tree
has locate the edit (:func:`differing`).

A fingerprint is ``root:sections:leaves``: 32 hex digits, then 16 for each section, then 8 for each leaf with a dot between sections.
An empty or null text has no leaves.

All of it is built of SQL functions. :func:`with_next` finds each document's successor in descending id without ordering the table in one task:
ids are cut into blocks of 128 consecutive numbers, and the chain of blocks is found level by level, 65,536 numbers at a time.

Defined results: null text counts as empty; rows of one id follow each other in order of their texts; null ids come last; the successor of
the last row is the first row, of a single row the row itself; an empty table gives an empty table; extra columns stay, and are replaced if named
as an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhouse.llm import common

LEAF = r"(?s)(?:[^\n.!?]{1,160}[\n.!?]*|[\n.!?]+)\s?"
BLOCK_BITS = 7
LEVEL_BITS = 16
#: Block numbers have 57 bits; after three levels 512 values at most are left.
LEVELS = 3


def _hash(value: Column) -> Column:
    return F.lpad(F.hex(F.xxhash64(value)), 16, "0")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text."""
    leaves = F.array_join(F.transform(F.regexp_extract_all(common.whole(text), F.lit(LEAF), F.lit(0)), _hash), ",")
    sections = F.split(leaves, "(?<=0),")
    hashes = F.when(leaves == "", F.lit("")).otherwise(F.array_join(F.transform(sections, _hash), ""))
    short = F.regexp_replace(F.array_join(sections, "."), "([0-9A-F]{8})[0-9A-F]{8},?", "$1")
    return F.concat_ws(":", F.md5(hashes.cast("binary")), hashes, short)


def root(tree: Column) -> Column:
    return F.substring(tree, 1, 32)


def sections(tree: Column) -> Column:
    """The section hashes of a fingerprint, in order."""
    return F.regexp_extract_all(F.split_part(tree, F.lit(":"), F.lit(2)), F.lit("[0-9A-F]{16}"), F.lit(0))


def leaves(tree: Column) -> Column:
    """The leaf hashes of a fingerprint, in order."""
    return F.regexp_extract_all(F.split_part(tree, F.lit(":"), F.lit(3)), F.lit("[0-9A-F]{8}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Share of common leaves: twice the distinct leaves that both have over the sum of distinct leaves of each; 1 for equal roots."""
    mine, other = F.array_distinct(leaves(a)), F.array_distinct(leaves(b))
    common_leaves = F.size(F.array_intersect(mine, other))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(2.0 * common_leaves, (F.size(mine) + F.size(other)).cast("double")), F.lit(0.0))
    )


def differing(a: Column, b: Column) -> Column:
    """Where ``a`` differs from ``b``: the 0-based numbers of the leaves of ``a`` in sections that ``b`` lacks and that ``b`` lacks themselves.

    Only the branches whose section hash differs are followed.
    """
    groups = F.split(F.split_part(a, F.lit(":"), F.lit(3)), r"\.")
    theirs, known = sections(b), leaves(b)
    open_groups = F.zip_with(sections(a), groups, lambda h, g: F.when(F.array_contains(theirs, h), F.regexp_replace(g, ".", "-")).otherwise(g))
    flat = F.regexp_extract_all(F.array_join(open_groups, ""), F.lit(".{8}"), F.lit(0))
    numbered = F.transform(flat, lambda leaf, i: F.when((leaf == "--------") | F.array_contains(known, leaf), F.lit(None)).otherwise(i))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.filter(numbered, lambda i: i.isNotNull()))


def following(values: DataFrame, level: int = LEVELS) -> DataFrame:
    """``(value, next)`` for a table of distinct longs ``value``: the next smaller one; for the smallest the largest.

    No window holds more than 2**16 rows: values are compared within their upper bits, then the upper bits with each other.
    """
    if level == 0:
        order = W.partitionBy().orderBy(F.desc("value"))
        return values.select("value", F.coalesce(F.lead("value").over(order), F.max("value").over(W.partitionBy())).alias("next"))
    upper = values.withColumn("upper", F.shiftright("value", LEVEL_BITS))
    within = upper.withColumn("next", F.lead("value").over(W.partitionBy("upper").orderBy(F.desc("value"))))
    groups = upper.groupBy("upper").agg(F.max("value").alias("largest"))
    chain = following(groups.select(F.col("upper").alias("value")), level - 1)
    entered = chain.join(groups.withColumnRenamed("upper", "next"), "next").select(F.col("value").alias("upper"), "largest")
    return within.join(entered, "upper").select("value", F.coalesce("next", "largest").alias("next"))


def with_next(docs: DataFrame, key: str, carried: str, tie: Column) -> DataFrame:
    """``docs`` with ``next``: the column ``carried`` of the row that follows in descending ``key``, rows of one key in order of ``tie``.

    One shuffle of the rows by block. The first row of every block, one in 128, is also handed to the block before it; the table of their keys
    is written, so that Spark knows its size when it chooses the join that picks them.
    """
    blocked = docs.withColumn("_key", F.coalesce(key, F.lit(-(1 << 63)).cast("long"))).withColumn("_tie", tie)
    blocked = blocked.withColumn("_block", F.shiftright("_key", BLOCK_BITS))
    order = W.partitionBy("_block").orderBy(F.desc("_key"), "_tie")
    within = blocked.withColumn("_next", F.lead(F.struct(carried)).over(order))
    blocks = common.written(blocked.groupBy(F.col("_block").alias("value")).agg(F.max("_key").alias("_key")), "blocks")
    heads = blocked.join(blocks.select("_key"), "_key").groupBy("_block").agg(F.min_by(F.struct(carried), "_tie").alias("_head"))
    heads = heads.withColumnRenamed("_block", "next")
    entered = following(blocks.select("value")).join(heads, "next").select(F.col("value").alias("_block"), "_head")
    joined = within.join(entered, "_block")
    return joined.select(*docs.columns, F.coalesce("_next", "_head")[carried].alias("next"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_chars`` (code points) and ``fingerprint``."""
    plain, old = common.guarded(docs)
    return plain.select(
        *common.restored(
            old, {"n_chars": F.char_length(common.whole(old[text])).cast("long"), "fingerprint": fingerprint(old[text])}
        )
    )


def op5_document_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    docs = common.documents(spark, directory).select("doc_id", common.whole(F.col("text")).alias("text"))
    ringed = with_next(docs, "doc_id", "text", F.xxhash64("text"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = ringed.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("next", F.lit(1), cut))
    )
    printed = edited.select(
        "*",
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next")).alias("next_fingerprint"),
    )
    return printed.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
