"""From documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicframe.llm.exact_dedup import exact_dedup, normalised
from civicframe.llm.jaccard_join import jaccard_join
from civicframe.llm.mixing import mix
from civicframe.llm.packing import pack
from civicframe.llm.queries import table
from civicframe.llm.store import stored
from civicframe.llm.toxicity import toxicity

#: A text that scores as much or more goes.
TOXIC_FROM = 0.3
#: Wanted shares of tokens by labelled quality.
TARGETS = {"q0": 0.05, "q1": 0.95}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores under ``TOXIC_FROM``; all labels are learned from."""
    # Names that no column of the documents has.
    room = "_" * max(map(len, docs.columns))
    names = (f"{room}score", f"{room}evidence")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True), carry=docs.columns, named=names)
    return scored.where(F.col(names[0]) < TOXIC_FROM).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id; a row that is repeated as a whole stays once."""
    def keyed(of: str, sha: Column) -> dict[str, Column]:
        # A missing id is a key like others; plain keys let one exchange of the texts serve both steps.
        return {"__none": F.col(of).isNull(), "__id": F.coalesce(F.col(of), F.lit(0)), "__sha": sha}

    keys = ["__none", "__id", "__sha"]
    kept = exact_dedup(docs).where("kept").withColumns(keyed("doc_id", F.col("text_sha256"))).select(keys)
    rows = docs.withColumns(keyed("doc_id", F.sha2(normalised(F.col("text")), 256)))
    return rows.dropDuplicates(keys).join(kept.hint("merge"), keys, "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest id."""
    gone = jaccard_join(docs, words=5, num=4, den=5).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: the whole part always, once more by a hash with the rest as chance."""
    rated = mix(docs, table(spark, sf_dir, "labels"), F.concat(F.lit("q"), "quality"), TARGETS)
    chance = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1_000_000)) / 1_000_000
    times = rated.select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__key"), F.floor(F.col("rate") + chance).cast("int").alias("__times")
    ).where("__times > 0")
    times = times.dropDuplicates(["__id", "__key"])
    rows = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__key"))
    return rows.join(times, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: where they come from and where they lie."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Scores, similarity and rates are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what each returns is written to the shared folder and read from there."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
