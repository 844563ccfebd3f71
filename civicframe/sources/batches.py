"""Tables that grow by batches, each of which counts once however often it is tried.

A batch is written to a part of its own first and counts from the moment that the manifest names the part.
A run that ends in between leaves a part that nobody reads, and the batch is simply run again. Parts that are
not in the manifest may be removed when no batch is running.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import anti_join

MANIFEST = "batch string, part string, rows bigint"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The batches that count: ``batch, part, rows``, one row each. A batch that two runs have committed counts by one part."""
    try:
        listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    part = F.min(F.struct("part", "rows")).alias("__one")
    return listed.groupBy("batch").agg(part).select("batch", "__one.part", "__one.rows")


def batch_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows of all batches that count, in whatever order; None as long as there is no batch.

    The driver reads one name per batch.
    """
    parts = [r.part for r in manifest(spark, folder).select("part").collect()]
    return spark.read.parquet(*[f"{folder}/parts/{p}" for p in sorted(parts)]) if parts else None


def pending(df: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys no batch has; a missing key counts as a key like others."""
    done = batch_rows(df.sparkSession, folder)
    return df if done is None else anti_join(df, done.select(*keys).distinct(), list(keys))


def stage(df: DataFrame, folder: str) -> tuple[str, int]:
    """Write ``df`` to a new part that nobody reads yet; its name and its number of rows, counted as they are written."""
    part = uuid.uuid4().hex
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/parts/{part}")
    return part, seen.get["rows"]


def commit(spark: SparkSession, folder: str, batch: str, part: str, rows: int) -> None:
    """Make a staged part count: one file that holds one line."""
    line = spark.range(1).select(
        F.lit(batch).alias("batch"), F.lit(part).alias("part"), F.lit(rows).cast("long").alias("rows")
    )
    line.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def append_batch(
    df: DataFrame,
    folder: str,
    batch: str,
    keys: Sequence[str],
    work: Callable[[DataFrame], DataFrame] | None = None,
) -> bool:
    """Add the rows of ``df`` whose keys are new, after ``work``, as one batch; whether there was anything to run.

    ``work`` must keep the ``keys``; it sees only rows that no batch has, so what it asks of others is asked
    once. A batch that counts already is left alone. Batches that may share keys run one after another; the
    same batch run twice at once counts once.
    """
    spark = df.sparkSession
    if manifest(spark, folder).where(F.col("batch") == batch).count():
        return False
    rows = pending(df, folder, keys)
    commit(spark, folder, batch, *stage(work(rows) if work else rows, folder))
    return True
