"""Wide to long, splitting labels, filling years, flattening nested candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(
    df: DataFrame,
    cols: Sequence[str],
    names_to: str,
    values_to: str,
    strip_prefix: str = "",
) -> DataFrame:
    """Turn value columns into rows; the label loses ``strip_prefix``. Missing values stay."""
    ids = [c for c in df.columns if c not in set(cols)]
    long = df.unpivot(ids, list(cols), names_to, values_to)
    if strip_prefix:
        long = long.withColumn(
            names_to,
            F.when(
                F.startswith(F.col(names_to), F.lit(strip_prefix)),
                F.substring(names_to, len(strip_prefix) + 1, 1 << 30),
            ).otherwise(F.col(names_to)),
        )
    return long


def melt_rest(
    df: DataFrame, ids: Sequence[str], names_to: str, values_to: str, strip_prefix: str = ""
) -> DataFrame:
    """Turn all columns but ``ids`` into rows."""
    rest = [c for c in df.columns if c not in set(ids)]
    return melt(df, rest, names_to, values_to, strip_prefix)


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str) -> DataFrame:
    """Split a label column into several; absent pieces are missing, further ones are dropped."""
    pieces = F.split(col, f"\\Q{sep}\\E", -1)
    return df.withColumns({n: F.get(pieces, i) for i, n in enumerate(into)}).drop(
        *([col] if col not in into else [])
    )


def side_by_side(
    df: DataFrame, keys: Sequence[str], label: str, values: Sequence[str], agg: Column
) -> DataFrame:
    """Long to wide: one column per value of ``label``, which must be listed."""
    return df.groupBy(*keys).pivot(label, list(values)).agg(agg)


def expand_years(
    df: DataFrame, year_col: str, spans: Mapping[int, tuple[int, int]], out: str
) -> DataFrame:
    """Repeat each row for every year its ``year_col`` stands for; other rows drop out."""
    years = F
    for year, (low, high) in spans.items():
        years = years.when(F.col(year_col) == year, F.sequence(F.lit(low), F.lit(high)))
    return df.withColumn(out, F.explode(years))


def spans_overlap(spans: Mapping[int, tuple[int, int]]) -> bool:
    """Whether some year is stood for by two source years."""
    ordered = sorted(spans.values())
    return any(a[1] >= b[0] for a, b in zip(ordered, ordered[1:], strict=False))


def copy_year(df: DataFrame, year_col: str, source: int, target: int) -> DataFrame:
    """Let the rows of one year stand for another year too."""
    kind = df.schema[year_col].dataType
    both = F.array(F.lit(source).cast(kind), F.lit(target).cast(kind))
    years = F.when(F.col(year_col) == source, both).otherwise(F.array(year_col))
    return df.withColumn(year_col, F.explode(years)).distinct()


def flatten_candidates(
    df: DataFrame, candidates: str, fields: Mapping[str, str], k: int = 3
) -> DataFrame:
    """Spread the first ``k`` entries of an array over columns ``NAME``, ``NAME_2``, ... .

    ``fields`` maps column names to (possibly nested) fields of an entry.
    """
    flat = {}
    for i in range(k):
        suffix = "" if i == 0 else f"_{i + 1}"
        for name, path in fields.items():
            value = F.get(candidates, i)
            for part in path.split("."):
                value = value.getField(part)
            flat[name + suffix] = value
    return df.withColumns(flat).drop(candidates)


def melt_groups(
    df: DataFrame, names_to: str, measures: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """Wide to long for several measures at once, without a join.

    ``measures`` maps each new value column to its ``label -> source column``; all have the same
    labels. The source columns stay.
    """
    labels = list(next(iter(measures.values())))
    rows = [
        F.struct(
            F.lit(label).alias(names_to),
            *[F.col(cols[label]).alias(value) for value, cols in measures.items()],
        )
        for label in labels
    ]
    exploded = df.withColumn("__row", F.explode(F.array(*rows)))
    return exploded.withColumns(
        {n: F.col(f"__row.{n}") for n in [names_to, *measures]}
    ).drop("__row")
