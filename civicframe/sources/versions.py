"""Yearly datasets whose layout changes from version to version."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import conform, union_all


@dataclass(frozen=True)
class SourceVersion:
    """One version: how to get its table, which columns are called differently, its constants."""

    year: int
    load: Callable[[], DataFrame]
    renames: Mapping[str, str] = field(default_factory=dict)
    constants: Mapping[str, object] = field(default_factory=dict)


def load_versions(
    versions: Sequence[SourceVersion], schema: T.StructType, year_col: str = "year"
) -> DataFrame:
    """All versions as one table of ``schema``, each read with its own names, tagged by year."""
    frames = []
    for v in versions:
        df = v.load().withColumnsRenamed(dict(v.renames))
        df = df.withColumns({n: F.lit(c) for n, c in v.constants.items()})
        frames.append(conform(df.withColumn(year_col, F.lit(v.year)), schema))
    return union_all(*frames)
