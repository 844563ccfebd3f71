"""What several operators share: tables in the shared folder and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class.
BLANK = r"[\x20\x09-\x0D]"


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a single-machine session may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="civicframe-")
        folder = _OWN[context.applicationId]
    return folder.rstrip("/")


#: Whether the shuffle files of a query go when it ends.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from what was written.

    Cuts the lineage and fixes what depends on how rows were dealt out. A lost executor costs only
    the tasks that it ran. The shuffle files of the write go with its end; else they would stay until
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/civicframe-llm/{uuid.uuid4().hex}"
    before = spark.conf.get(FILES_GO, None)
    spark.conf.set(FILES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FILES_GO)
        else:
            spark.conf.set(FILES_GO, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Remove what ``stored`` wrote for ``tables``; for tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows ``(id, component_id)`` for every id in ``edges(a, b)``; the smallest id names a component.

    Large-star and small-star take turns until the edges stay the same. Both find a node's smallest
    neighbour by an aggregate that starts before the shuffle. It is written before the join, so that
    both sides of the join are plain shuffles, of which the adaptive planner splits the partition
    of a node with very many neighbours. A round's tables go when the next edges are written.
    ``rounds`` only ends a run that a bug keeps from settling.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        now = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
                edges.select("b", "b").distinct()
            )
        before = now
        both = edges.union(edges.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stored(large)
        dropped(edges, least)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).where("a != b")
        edges = stored(small.distinct())
        dropped(large, least)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
