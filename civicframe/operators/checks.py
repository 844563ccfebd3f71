"""Data checks that return the offending rows or one row of findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Values that occur more than once, with how often; whole rows without ``keys``."""
    cols = list(keys or df.columns)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def unmatched(df: DataFrame, col: str) -> DataFrame:
    """Rows a left join found no partner for, told by a column of the partner."""
    return df.filter(F.col(col).isNull())


def without_area(df: DataFrame, area: str, city: str, value: str) -> DataFrame:
    """Rows of a city that lie in no area."""
    return df.filter(F.col(area).isNull() & (F.col(city) == value))


def conflicts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two texts are both there and differ, upper case aside in ``a``."""
    return df.filter(F.upper(a) != F.col(b))


def filled_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the number of present values of each column."""
    return df.agg(*[F.count(c).alias(c) for c in cols])


def all_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row, ``all_missing``: whether every one of the columns is empty."""
    return df.agg(reduce(and_, (F.count(c) == 0 for c in cols)).alias("all_missing"))


def row_counts(**frames: DataFrame) -> DataFrame:
    """Rows of several tables, one row per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def check_measures(
    filled: Sequence[str] = (),
    found: Mapping[str, Column] | None = None,
    typed: Mapping[str, tuple[str, str]] | None = None,
) -> dict[str, Column]:
    """Counts that one pass over a table can take together, by name.

    ``rows``; ``filled_<column>``, present values; ``<name>`` for each condition in ``found``, rows where it
    holds; ``lost_<name>`` for each pair of a column and what it was turned into, present values that became missing.
    """
    counts = {"rows": F.count(F.lit(1))}
    counts |= {f"filled_{c}": F.count(c) for c in filled}
    counts |= {name: F.count_if(F.coalesce(where, F.lit(False))) for name, where in (found or {}).items()}
    for name, (before, after) in (typed or {}).items():
        counts[f"lost_{name}"] = F.count_if(F.col(before).isNotNull() & F.col(after).isNull())
    return counts


def checks_report(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """One row per measure, ``check, count``, from a single scan; an empty table counts 0 everywhere."""
    one = df.agg(F.array(*[F.struct(F.lit(n).alias("check"), m.alias("count")) for n, m in measures.items()]).alias("__all"))
    return one.select(F.inline("__all"))


def observed(df: DataFrame, measures: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with the measures counted while its first action runs, such as the write that follows at once.

    The counts are in ``.get`` of the second result afterwards, so checking a table costs no scan of its own. Nothing that
    shuffles should come between this and the write: a shuffle whose tasks run again would count them again.
    """
    seen = Observation()
    return df.observe(seen, *[m.alias(n) for n, m in measures.items()]), seen
