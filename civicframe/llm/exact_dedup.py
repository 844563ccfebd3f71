"""Exact dedup by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BLANK


def normalised(text: Column) -> Column:
    """Each run of white space as one space; missing text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Rows are combined three times, each time on digest and full content: in the task that read them
    (the part of the aggregate before the shuffle), per digest and salt, and over the salts. A salt
    belongs to an input partition, so a task sends one row per distinct text, however many copies it
    read, and no task receives more than one row per partition of its salt.

    The row with the smallest id stays. Missing text is the empty text. A missing id never stays
    while another row has one. Where all rows of a group miss it, all of them stay, as nothing tells
    them apart. Rows that repeat an id and a text count as copies and share the
    verdict. An empty table gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__text"))
    rows = rows.withColumn("__sha", F.sha2("__text", 256))
    merged = (
        rows.withColumn("__salt", F.spark_partition_id() % salts)
        .groupBy("__sha", "__salt", "__text")
        .agg(F.min("__id").alias("__id"), F.count(F.lit(1)).alias("__n"))
    )
    groups = merged.groupBy("__sha", "__text").agg(F.min("__id").alias("keep_id"), F.sum("__n").alias("group_size"))
    # Texts that differ under one digest are told apart by a second hash of the text.
    groups = groups.select("__sha", F.xxhash64("__text").alias("__x"), "keep_id", "group_size")
    keyed = rows.select("__id", "__sha", F.xxhash64("__text").alias("__x"))
    return keyed.join(groups, ["__sha", "__x"]).select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
