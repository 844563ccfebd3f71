"""Session helpers: tuning defaults, size estimates, reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning is what sizes shuffles and splits skewed join partitions on a cluster.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are designed for."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; plans only, runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark itself would broadcast ``df`` under the session's threshold."""
    helper = df.sparkSession._jsparkSession.sessionState().conf()
    return estimated_bytes(df) <= int(helper.autoBroadcastJoinThreshold())


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a
    single-machine session without that setting gets a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="civicframe-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
