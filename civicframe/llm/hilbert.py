"""Sharding along a Hilbert curve."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored, tasks


@cache
def curve(dims: int) -> tuple[list[int], list[int]]:
    """For state ``s`` and cell ``c`` of the next finer grid, at ``s * 2**dims + c``: digit and next state.

    A state is an entry corner and a direction; both follow from the Gray code.
    """
    size = 2**dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return (x << by | x >> (dims - by)) & (size - 1)

    def gray(i: int) -> int:
        return i ^ i >> 1

    def entry(i: int) -> int:
        return gray(2 * ((i - 1) // 2)) if i else 0

    def axis(i: int) -> int:
        ones = i if i % 2 else i - 1
        return 0 if i == 0 else ((ones ^ (ones + 1)).bit_length() - 1) % dims

    place = {gray(i): i for i in range(size)}
    digits, after = [0] * size * size * dims, [0] * size * size * dims
    for corner in range(size):
        for way in range(dims):
            state = corner * dims + way
            for cell in range(size):
                digit = place[turn(cell ^ corner, -(way + 1))]
                digits[state * size + cell] = digit
                after[state * size + cell] = (corner ^ turn(entry(digit), way + 1)) * dims + (way + axis(digit) + 1) % dims
    return digits, after


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the curve of integer ``cells``, each of ``bits`` bits; ``bits`` times their number is under 63."""
    dims = len(cells)
    digits, after = curve(dims)
    size = 2**dims

    def bit(cell: Column, level: Column) -> Column:
        return F.call_function("shiftrightunsigned", cell.cast("long"), level.cast("int")).bitwiseAND(F.lit(1))

    def at(level: Column) -> Column:
        return reduce(lambda a, b: a + b, (bit(c, level) * 2**i for i, c in enumerate(cells)))

    table_d, table_a = (F.array(*(F.lit(x) for x in t)) for t in (digits, after))

    def step(state: Column, level: Column) -> Column:
        slot = (state["s"] * size + at(level)).cast("int")
        return F.struct((state["h"] * size + F.get(table_d, slot)).alias("h"), F.get(table_a, slot).cast("long").alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda x: x["h"])


def hilbert_shards(rows: DataFrame, dims: dict[str, Column], ties: list[str], shards: int, bits: int = 10) -> DataFrame:
    """``rows`` with ``curve long, shard int, slot long``: runs of the curve, sizes at most one row apart.

    ``dims`` maps names to columns in [0, 1]; missing counts as 0. Rows at one place of the curve
    follow the columns ``ties``; rows alike in these too are interchangeable. Ranks come from a
    range partitioning, in which a hot place is split by the ties, and from a count per partition,
    so no task sees more than its range. The numbered rows are written to the shared folder, since
    ranges may differ between two runs. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    top = 2**bits - 1
    cells = [F.least(F.greatest(F.floor(F.coalesce(c, F.lit(0.0)) * (top + 1)), F.lit(0)), F.lit(top)) for c in dims.values()]
    keyed = rows.withColumns(dict(zip([f"__c{i}" for i in range(len(cells))], cells, strict=True)))
    keyed = keyed.withColumn("curve", hilbert_index([F.col(f"__c{i}") for i in range(len(cells))], bits))
    keyed = keyed.drop(*(f"__c{i}" for i in range(len(cells))))
    ordered = keyed.repartitionByRange(tasks(spark), "curve", *ties).sortWithinPartitions("curve", *ties)
    row = F.monotonically_increasing_id()
    numbered = stored(ordered.withColumn("__at", row))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    numbered = numbered.withColumns({"__part": part, "__place": place})
    # One row per partition: bounded by the number of partitions, whatever the input.
    counts = {r["__part"]: r["n"] for r in numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, starts = 0, []
    for part_id in sorted(counts):
        starts.append((part_id, total))
        total += counts[part_id]
    offsets = spark.createDataFrame(starts, "__part long, __start long")
    rank = F.col("__start") + F.col("__place")
    # The first `spare` shards hold one row more.
    least, spare = divmod(total, shards)
    wide = F.lit(spare * (least + 1))
    shard = F.when(rank < wide, F.floor(rank / (least + 1))).otherwise(spare + F.floor((rank - wide) / max(least, 1))).cast("int")
    start = F.col("shard") * F.lit(least) + F.least(F.col("shard"), F.lit(spare))
    return (
        numbered.join(F.broadcast(offsets), "__part")
        .withColumn("shard", shard)
        .withColumn("slot", (rank - start).cast("long"))
        .drop("__at", "__part", "__place", "__start")
    )


def unit(value: Column, top: float) -> Column:
    """A count on a logarithmic scale from 0 to 1 at ``top`` and above."""
    return F.least(F.log2(F.greatest(value, F.lit(0)) + 1) / F.lit(float(top)), F.lit(1.0))


def document_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents in ``shards`` runs of the curve over size, language and line length.

    Returns ``id_col, size, text_crc32, curve, shard, slot``. Equal texts of one language lie side
    by side, apart at most where a run ends. Missing text has no bytes and a missing language is one of its own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("__digest"),
        (F.pmod(F.xxhash64(F.coalesce(F.col(lang_col), F.lit(""))), F.lit(1024)) / 1024).alias("__lang"),
        (F.length(text) / (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).alias("__line"),
    )
    dims = {"size": unit(F.col("size"), 24), "lang": F.col("__lang"), "line": unit(F.col("__line"), 16)}
    return hilbert_shards(rows, dims, ["__digest", id_col], shards).drop("__digest", "__lang", "__line")
