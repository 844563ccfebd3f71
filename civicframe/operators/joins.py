"""Joins in which a missing key matches a missing key, with hot keys spread over tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import address_key
from ..session import fits_broadcast

Key = str | tuple[str, str]

# A key with more left rows than this is hot: it gets a salt per so many rows. The table of hot keys
# that is broadcast has one row for so many left rows at most.
ROWS_PER_TASK = 2_000_000


def _pairs(on: str | Sequence[Key]) -> list[tuple[str, str]]:
    on = [on] if isinstance(on, str) else list(on)
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in on]


def _same(pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs))


def _other_names(cols: Sequence[str], tag: str) -> dict[str, str]:
    return {c: f"__{tag}_{c}" for c in cols}


def rename_clashes(
    left: DataFrame, right: DataFrame, keys: Sequence[Key], suffixes: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Give non-key columns that both sides have a suffix on each side."""
    pairs = _pairs(keys)
    left_keys, right_keys = {a for a, _ in pairs}, {b for _, b in pairs}
    clash = (set(left.columns) - left_keys) & (set(right.columns) - right_keys)
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}),
    )


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[Key],
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join on equal keys, where missing equals missing.

    ``on`` holds column names or ``(left, right)`` pairs; the key keeps its left name.
    Spark decides by size whether a side is broadcast; a skewed shuffle join is split at run
    time. ``how`` is inner, left, right, full, semi or anti.
    """
    pairs = _pairs(on)
    if how in ("semi", "anti"):
        right = right.select([b for _, b in pairs])
    else:
        left, right = rename_clashes(left, right, pairs, suffixes)
    names = _other_names([b for _, b in pairs], "r")
    joined = left.join(
        right.withColumnsRenamed(names), _same([(a, names[b]) for a, b in pairs]), how
    )
    if how in ("semi", "anti"):
        return joined
    if how in ("right", "full"):
        joined = joined.withColumns({a: F.coalesce(F.col(a), F.col(names[b])) for a, b in pairs})
    return joined.drop(*names.values())


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """Key values, a missing one included, with more than ``rows_per_task`` rows, and ``__salts`` for each."""
    return keys_to_salt(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys, rows_per_task)


def keys_to_salt(counted: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """``hot_keys`` from keys whose rows are counted already, as ``__n``."""
    most = rows_per_task or ROWS_PER_TASK
    return counted.where(F.col("__n") > most).select(*keys, F.ceil(F.col("__n") / most).alias("__salts"))


def _row_hash(df: DataFrame) -> Column:
    """A hash of the row's values and its partition: the same on a retry, however rows were dealt."""
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in hashable])


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[Key],
    how: str = "left",
    residual: Column | None = None,
    small: bool | None = None,
    hot_source: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join whose left side may hold a large share of its rows under one key.

    A right side that Spark would broadcast is joined as it is, since then nothing is shuffled;
    ``small`` says so from a bound the caller has computed, where Spark's estimate would not do.
    Otherwise the rows of a left key that has more than ``ROWS_PER_TASK`` are spread by a hash of
    the row over as many tasks as its count asks for, and the right rows of these keys, and only
    these, are repeated once per task; a missing key is a key like others. All rows take part, so
    the result is that of the plain join, whichever form the size asks for. ``hot_source`` is a
    table with the left keys that is cheaper to count than ``left``, such as what it was joined from;
    ``hot`` gives the hot keys themselves, as ``hot_keys`` does.
    ``residual`` may add a condition on both sides. ``how`` is inner, left, semi or anti; right and
    full are those of ``outer_join_all``, without a residual.
    """
    pairs = _pairs(on)
    if how == "full" and residual is None:
        return outer_join_all([left, right.withColumnsRenamed({b: a for a, b in pairs})], [a for a, _ in pairs])
    if how == "right" and residual is None:
        left, right = rename_clashes(left, right, pairs, ("_x", "_y"))
        back = spread_join(right.withColumnsRenamed({b: a for a, b in pairs}), left, [a for a, _ in pairs], "left", small=small)
        return back.select(*left.columns, *(c for c in back.columns if c not in left.columns))
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"spread_join cannot do {how!r}")
    left_keys, right_keys = [a for a, _ in pairs], [b for _, b in pairs]
    names = _other_names(right_keys, "r")
    right = right.withColumnsRenamed(names)
    condition = _same([(a, names[b]) for a, b in pairs])
    if small is None:
        small = fits_broadcast(right)
    elif small:
        right = F.broadcast(right)
    if not small:
        hot_names = _other_names(left_keys, "h")
        if hot is None:
            hot = hot_keys(left if hot_source is None else hot_source, left_keys)
        hot = F.broadcast(hot.withColumnsRenamed(hot_names))
        salts = F.coalesce("__salts", F.lit(1))
        place = _row_hash(left)
        marked = left.join(hot, _same([(a, hot_names[a]) for a in left_keys]), "left")
        left = marked.withColumn("__salt", F.when(salts > 1, F.pmod(place, salts)).otherwise(F.lit(0)))
        left = left.drop("__salts", *hot_names.values())
        right = (
            right.join(hot, _same([(names[b], hot_names[a]) for a, b in pairs]), "left")
            .withColumn("__place", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
            .drop("__salts", *hot_names.values())
        )
        # Keeps a side that only looks small, such as an exploded one, from being broadcast.
        right = right.hint("merge")
        condition = condition & (F.col("__salt") == F.col("__place"))
    if residual is not None:
        condition = condition & residual
    return left.join(right, condition, how).drop("__salt", "__place", *names.values())


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on all column names the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the two sides share no column")
    return spread_join(left, right, shared, how)


def outer_join_all(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Chain of full outer joins on the same keys, whose tables may hold many rows under one key.

    Keys with more than ``ROWS_PER_TASK`` rows in some table are hot, a missing key like others. Rows of all
    other keys go through plain full outer joins. Rows of hot keys are joined from the left, spread
    by salts, and each table adds its rows whose key no earlier table has, found by one anti join
    with the distinct keys. The hot keys that are broadcast have a row for so many rows at most.
    """
    on, frames = list(on), list(frames)
    if len(frames) < 2 or all(fits_broadcast(f) for f in frames):
        return reduce(lambda a, b: null_safe_join(a, b, on, "full"), frames)
    counted = reduce(DataFrame.unionByName, [hot_keys(f, on) for f in frames])
    hot = counted.groupBy(*on).agg(F.max("__salts").alias("__salts"))
    names = _other_names(on, "h")
    marks = F.broadcast(hot.select(*(F.col(k).alias(n) for k, n in names.items())))
    same = _same(list(names.items()))
    cold = reduce(lambda a, b: null_safe_join(a, b, on, "full"), [f.join(marks, same, "left_anti") for f in frames])
    warm = [f.join(marks, same, "left_semi") for f in frames]
    joined, seen = warm[0], warm[0].select(*on).distinct()
    for f in warm[1:]:
        joined, f = rename_clashes(joined, f, on, ("_x", "_y"))
        alone = spread_join(f, seen, on, "anti", small=False, hot=hot)
        joined = spread_join(joined, f, on, "left", small=False, hot=hot).unionByName(alone, allowMissingColumns=True)
        seen = seen.union(f.select(*on)).distinct()
    return cold.unionByName(joined)


def semi_join(left: DataFrame, right: DataFrame, on: str | Sequence[Key]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    pairs = _pairs(on)
    keys = right.select([b for _, b in pairs]).distinct()
    return spread_join(left, keys, on, "semi")


def anti_join(left: DataFrame, right: DataFrame, on: str | Sequence[Key]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    pairs = _pairs(on)
    keys = right.select([b for _, b in pairs]).distinct()
    return spread_join(left, keys, on, "anti")


def join_on_address(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str, how: str = "left"
) -> DataFrame:
    """Join two tables on their normalized address text."""
    left = left.withColumn("join_field", address_key(left_col))
    right = right.withColumn("join_field", address_key(right_col))
    left, right = rename_clashes(left, right, ["join_field"], ("_x", "_y"))
    return spread_join(left, right, "join_field", how)


def apply_overrides(
    df: DataFrame, overrides: DataFrame, key: str, target: str, value: str = "value"
) -> DataFrame:
    """Put the override's value, where there is one for the row's key, in place of ``target``.

    ``overrides`` holds one row per key.
    """
    picked = overrides.select(F.col(key), F.col(value).alias("__override"))
    joined = spread_join(df, picked, key, "left")
    return joined.withColumn(target, F.coalesce("__override", target)).drop("__override")


def look_up(df: DataFrame, mapping: DataFrame, on: str | Sequence[Key]) -> DataFrame:
    """Attach a mapping table's columns; rows without a mapping drop out.

    A mapping that Spark would broadcast is, so ``df`` is then not shuffled; beside a larger one
    the hot keys of ``df`` are spread.
    """
    df, mapping = rename_clashes(df, mapping, _pairs(on), ("_x", "_y"))
    return spread_join(df, mapping, on, "inner")
