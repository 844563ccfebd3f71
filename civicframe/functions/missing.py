"""Column functions whose treatment of missing values differs from plain SQL.

Each function names the rule it keeps. Predicates are three-valued as in SQL unless
stated otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def if_else(test: Column, yes, no) -> Column:
    """``yes`` or ``no`` by ``test``; missing when the test is missing."""
    return F.when(test, _value(yes)).when(~test, _value(no))


def recode(c: Column | str, mapping: Mapping[str, str], keep: Sequence[str], default: str) -> Column:
    """Replace the keys of ``mapping``, keep the values in ``keep``, send the rest to ``default``.

    A missing input stays missing.
    """
    c = _col(c)
    renamed = reduce(
        lambda chain, item: chain.when(c == item[0], F.lit(item[1])), mapping.items(), F
    )
    kept = sorted(set(keep) | set(mapping.values()))
    return renamed.when(c.isin(kept), c).when(c.isNotNull(), F.lit(default))


def classify(rules: Sequence[tuple[object, Column]], default) -> Column:
    """First matching ``(category, predicate)`` wins; a missing predicate on the way gives missing."""
    return reduce(
        lambda rest, rule: if_else(rule[1], rule[0], rest), reversed(rules), _value(default)
    )


def matches(c: Column | str, pattern: str) -> Column:
    """Regex search that is false, not missing, on missing text."""
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


def contains_any(cols: Sequence[Column | str], word: str) -> Column:
    """``word`` occurs in at least one of ``cols``; missing text counts as no occurrence."""
    return reduce(or_, (F.coalesce(F.contains(_col(c), F.lit(word)), F.lit(False)) for c in cols))


def matches_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """At least one of the patterns is found; false on missing text."""
    return reduce(or_, (matches(c, p) for p in patterns))


def is_in(c: Column | str, values: Sequence) -> Column:
    """Membership that is never missing."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def paste(cols: Sequence[Column | str], sep: str = " ") -> Column:
    """Join as text, writing ``NA`` for missing values."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def paste_present(cols: Sequence[Column | str], sep: str = "") -> Column:
    """Join as text, leaving missing values out."""
    return F.concat_ws(sep, *[_col(c).cast("string") for c in cols])


def lenient(c: Column | str, to: str) -> Column:
    """Cast that turns bad text into missing; integers are read as numbers and cut off."""
    c = _col(c)
    if to in ("int", "integer", "bigint", "long"):
        number = c.cast("string").try_cast("double")
        return number.try_cast(to)
    return c.cast("string").try_cast(to)


def sentinel_to_missing(c: Column | str, sentinel) -> Column:
    return F.nullif(_col(c), F.lit(sentinel))


def first_present(*cols: Column | str) -> Column:
    return F.coalesce(*[_col(c) for c in cols])


def first_nonempty(*cols: Column | str) -> Column:
    """First value that is neither missing nor empty; the last argument is taken as it is."""
    *head, last = [_col(c) for c in cols]
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in head], last)


def sum_present(c: Column | str) -> Column:
    """Sum of the values that are there; 0 when there are none."""
    c = _col(c)
    return F.coalesce(F.sum(c), F.lit(0))


def sum_strict(c: Column | str) -> Column:
    """Sum that is missing when any value is missing."""
    c = _col(c)
    return F.when(F.count_if(c.isNull()) == 0, F.coalesce(F.sum(c), F.lit(0)))


def money(c: Column | str, scale: int = 2) -> Column:
    """Amount as an exact decimal, so that sums do not depend on row order; rounded to ``scale`` places."""
    return lenient(c, f"decimal(38,{scale})")
