"""Aggregations, group attributes, row picking per key, and ordering by position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.missing import sum_present
from ..session import reliable_checkpoint
from .joins import spread_join
from .position import in_order


def aggregate_by(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group and aggregate, leaving out rows with a missing key."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def group_total(
    df: DataFrame, keys: Sequence[str], drop_missing: bool = False, **aggs: Column
) -> DataFrame:
    """Attach aggregates of each row's group.

    Rows with a missing key form a group, or with ``drop_missing`` stay without an aggregate.
    """
    grouped = df.dropna(subset=list(keys)) if drop_missing else df
    totals = grouped.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return spread_join(df, totals, list(keys), "left")


def grand_total(df: DataFrame, **aggs: Column) -> DataFrame:
    """Attach aggregates over the whole table, read as one scalar row."""
    one = df.agg(F.struct(*[a.alias(n) for n, a in aggs.items()])).scalar()
    out = df.withColumn("__total", one)
    return out.withColumns({n: F.col(f"__total.{n}") for n in aggs}).drop("__total")


def _picked(df: DataFrame, keys: Sequence[str], order_by: Sequence | None, k: int) -> DataFrame:
    order_by = in_order(df, order_by)
    ranked = df.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    )
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence | None = None) -> DataFrame:
    """First row of each key, in input order if none is given. Each task keeps one row per key before anything is shuffled."""
    return _picked(df, keys, order_by, 1)


def top_k_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence | None, k: int) -> DataFrame:
    """First ``k`` rows of each key, reduced the same way before the shuffle."""
    return _picked(df, keys, order_by, k)


def later_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """Rows of each key after its first; ``order_by`` must tell the rows of a key apart, as the input position does."""
    order_by = in_order(df, order_by)
    order = F.struct(*order_by)
    firsts = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    return (
        spread_join(df, firsts, list(keys), "inner").filter(order > F.col("__first")).drop("__first")
    )


def repeated_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the keys that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return spread_join(df, repeated, list(keys), "semi")


def largest_per_key(
    df: DataFrame, keys: Sequence[str], measure: str, tie: Sequence[str]
) -> DataFrame:
    """Row with the largest measure of each key; equal measures go by ``tie``."""
    return keep_first(df, keys, [F.desc(measure), *tie])


def first_per_group(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """First value of ``cols`` in each group; rows with a missing key form a group."""
    order_by = in_order(df, order_by)
    first = F.min_by(F.struct(*cols), F.struct(*order_by)).alias("__first")
    picked = df.groupBy(*keys).agg(first)
    return picked.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in cols])


def repeat_count(df: DataFrame, col: str, out: str) -> DataFrame:
    """Attach how often the value occurs; -1 where it is missing or empty."""
    counted = group_total(df, [col], **{out: F.count(F.lit(1))})
    blank = F.col(col).isNull() | (F.col(col).cast("string") == "")
    return counted.withColumn(out, F.when(blank, F.lit(-1)).otherwise(F.col(out)))


def frequency(df: DataFrame, col: str, out: str = "freq", ordered: bool = False) -> DataFrame:
    """Rows per value, missing values left out; ``ordered`` puts the most frequent first."""
    counts = aggregate_by(df, [col], **{out: F.count(F.lit(1))})
    return counts.orderBy(F.desc(out), F.asc(col)) if ordered else counts


def consolidate(
    df: DataFrame, label: str, residual: Sequence[str], to: str, keys: Sequence[str], measure: str
) -> DataFrame:
    """Fold the labels in ``residual`` into ``to`` and add up their measure; other rows pass.

    ``keys`` are the other key columns. Rows of the folded label with a missing key drop out,
    and rows with a missing label drop out.
    """
    folded = df.withColumn(
        label, F.when(F.col(label).isin(list(residual)), F.lit(to)).otherwise(F.col(label))
    )
    into = F.col(label) == to
    whole = reduce(and_, (F.col(k).isNotNull() for k in keys))
    # One pass: the other rows group by their own value too, which makes them distinct.
    grouped = (
        folded.filter(~into | (into & whole))
        .groupBy(*keys, label, F.when(~into, F.col(measure)).alias("__value"))
        .agg(sum_present(measure).alias("__sum"))
    )
    value = F.when(into, F.col("__sum")).otherwise(F.col("__value"))
    return grouped.select(*keys, label, value.alias(measure))


def histogram(df: DataFrame, x: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal steps over the range of ``x``, per value of ``by``."""
    value = F.col(x).cast("double")
    present = df.filter(value.isNotNull()).select(*by, value.alias("__x"))
    ranged = grand_total(present, __lo=F.min("__x"), __hi=F.max("__x"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    step = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    return (
        ranged.select(
            *by, step.cast("int").alias("bin"), (F.col("__lo") + step * width).alias("bin_start")
        )
        .groupBy(*by, "bin", "bin_start")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def with_row_id(df: DataFrame, order_by: Sequence[str] | None = None, out: str = "row_id") -> DataFrame:
    """Number the rows from 1 in the order given, or that of the input, without bringing them into one task.

    Rows are range-partitioned, with a row digest and the input position behind the sort
    columns so that equal rows spread too, and written to the checkpoint folder: numbering
    reads them twice and must find the same partitions. The table of partition sizes that is
    broadcast has one row per partition.
    """
    order_by = in_order(df, order_by)
    ties = {
        "__digest": F.xxhash64(*df.columns),
        "__place": F.monotonically_increasing_id(),
    }
    order = [*order_by, *ties]
    ranged = df.withColumns(ties).repartitionByRange(*order).sortWithinPartitions(*order)
    stored = reliable_checkpoint(ranged.drop(*ties))
    placed = stored.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(out, F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1)
        .drop("__id", "__part", "__start")
    )


def slice_rows(
    df: DataFrame, order_by: Sequence[str] | None, first: int, last: int | None = None
) -> DataFrame:
    """Rows ``first`` to ``last`` by position, counted from 1; to the end without ``last``."""
    numbered = with_row_id(df, order_by, "__row")
    wanted = F.col("__row") >= first
    if last is not None:
        wanted = wanted & (F.col("__row") <= last)
    return numbered.filter(wanted).drop("__row")


def six_number_summary(df: DataFrame, x: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of missing values, exactly.

    Quartiles interpolate between neighbouring values. Equal values are counted first; the
    counts are range-partitioned by value, so no task sees the whole column.
    """
    value = F.col(x).cast("double")
    basic = df.agg(
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.count(value).alias("__n"),
        F.count_if(value.isNull()).alias("missing"),
    )
    counted = (
        df.select(value.alias("v")).dropna().groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    )
    stored = reliable_checkpoint(
        counted.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    )
    sizes = stored.groupBy("p").agg(F.sum("c").alias("size"))
    before = F.sum("size").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("p", F.coalesce(before, F.lit(0)).alias("start"))
    upto = F.sum("c").over(
        Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = (
        stored.withColumn("upto", upto)
        .join(F.broadcast(starts), "p")
        .select("v", (F.col("start") + F.col("upto")).alias("hi"), "c")
        .withColumn("lo", F.col("hi") - F.col("c"))
    )
    ranked = grand_total(ranked, n=F.max("hi"))
    aggs = []
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        position = (F.col("n") - 1) * q
        low, high = F.floor(position), F.ceil(position)

        def at(index):
            return F.max(F.when((F.col("lo") <= index) & (index < F.col("hi")), F.col("v")))

        share = F.max(position - low)
        aggs.append((at(low) * (1 - share) + at(high) * share).alias(name))
    quartiles = ranked.agg(F.struct(*aggs)).scalar()
    return (
        basic.withColumn("__q", quartiles)
        .select("min", "__q.q1", "__q.median", "mean", "__q.q3", "max", "missing")
    )
