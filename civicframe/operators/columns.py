"""Projection and schema operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import lenient
from .position import POSITION, stacked


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
}


def schema(**types: str) -> T.StructType:
    """Schema from column names and type names; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in types.items()])


def repair_names(df: DataFrame) -> DataFrame:
    """Make every header a legal, unique name.

    Unnamed columns become ``...n`` by position, other characters become dots, and a name
    that does not start with a letter gets ``X`` in front.
    """
    seen: set[str] = set()
    names = []
    for i, name in enumerate(df.columns, start=1):
        unnamed = name.strip() == "" or re.fullmatch(r"_c\d+", name) is not None
        legal = f"...{i}" if unnamed else re.sub(r"[^A-Za-z0-9_.]", ".", name)
        if not unnamed and not re.match(r"[A-Za-z]", legal):
            legal = "X" + legal
        base, n = legal, 1
        while legal in seen:
            legal, n = f"{base}.{n}", n + 1
        seen.add(legal)
        names.append(legal)
    return df.toDF(*names)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and types; absent ones are missing.

    Text that does not fit its type becomes missing.
    """
    have = dict(df.dtypes)

    def as_type(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType)
        value, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        return lenient(value, kind) if have[f.name] == "string" and kind != "string" else value.cast(f.dataType)

    return df.select([as_type(f).alias(f.name) for f in schema.fields])


def map_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[str], Column]) -> DataFrame:
    """Apply one function to several columns in one projection."""
    return df.withColumns({c: fn(c) for c in cols})


def pick(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep and rename in one step; ``names`` maps new to old."""
    return df.select([F.col(f"`{old}`").alias(new) for new, old in names.items()])


def drop_by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def lenient_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: lenient(c, t) for c, t in types.items()})


def empty_table(spark, schema: T.StructType) -> DataFrame:
    """A typed table without rows, the neutral element of ``union_all``."""
    return spark.createDataFrame([], schema)


def split_on(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows where the predicate is true, false, and missing; every row is in exactly one part."""
    return df.filter(predicate), df.filter(~predicate), df.filter(predicate.isNull())


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; columns absent from one are missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Set union by column name, with a single duplicate removal at the end.

    Tables that carry their input position are stacked in the order given, and of rows that agree in
    all else the first position stays.
    """
    if all(POSITION in f.columns for f in frames):
        rows = stacked(*frames)
        others = [c for c in rows.columns if c != POSITION]
        return rows.groupBy(*others).agg(F.min(POSITION).alias(POSITION)).select(rows.columns)
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()
