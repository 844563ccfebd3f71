"""The place of a row in its input, carried as a column that sorts.

A DataFrame has no order, but a file has. ``with_position`` gives what a file reader returned a
column that tells file, block and row. It sorts like the files' rows do, however the files were
split and the rows dealt out since. Operators that need an order use it when none is given.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of the column: a struct of part (which table of a stack), file, start of the block, row, item (of an array in a row).
POSITION = "input_position"


def with_position(df: DataFrame) -> DataFrame:
    """Add the position to rows as a file reader returns them, before anything else is done to them.

    Rows of a block are read by one task in their order, so ids that grow within a task put them in
    order; the ids are compared within a block only, as its start comes first.
    """
    where = F.col("_metadata")
    parts = [
        F.lit("").alias("part"),
        where.file_path.alias("file"),
        where.file_block_start.alias("start"),
        F.monotonically_increasing_id().alias("row"),
        F.lit(0).alias("item"),
    ]
    return df.select("*", F.struct(*parts).alias(POSITION))


def with_item(item: Column) -> Column:
    """The position of one item of an array that a positioned row holds."""
    return F.col(POSITION).withField("item", item.cast("int"))


def stacked(*frames: DataFrame) -> DataFrame:
    """Union by name, in which the rows of a table come after those of the tables before it; stacks may be stacked again."""
    marked = [
        f.withColumn(POSITION, F.col(POSITION).withField("part", F.concat(F.lit(f"{i:06d}/"), F.col(POSITION).part)))
        for i, f in enumerate(frames)
    ]
    return reduce(DataFrame.unionByName, marked)


def in_order(df: DataFrame, order_by: Sequence | None) -> Sequence:
    """The order given, else that of the input; without either there is none."""
    if order_by:
        return order_by
    if POSITION in df.columns:
        return [POSITION]
    raise ValueError("order_by is required: rows have no order of their own, and no input position")
