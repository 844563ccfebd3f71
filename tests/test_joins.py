"""Full and right outer joins with hot keys, against plain ones."""

import pytest

from civicframe.operators import joins
from civicframe.operators.joins import null_safe_join, outer_join_all, spread_join


@pytest.fixture
def tables(spark):
    """Hot keys in the first, in the second, in both, in none, and a missing one; keys that only one table has."""
    a = [(k, f"a{i}") for k, n in (("x", 9), ("y", 1), (None, 7), ("both", 5), ("a only", 8), ("one", 1)) for i in range(n)]
    b = [(k, f"b{i}") for k, n in (("x", 1), ("y", 11), (None, 1), ("both", 4), ("b only", 6), ("two", 1)) for i in range(n)]
    c = [(k, f"c{i}") for k, n in (("x", 1), (None, 2), ("two", 1), ("c only", 5)) for i in range(n)]
    return [spark.createDataFrame(rows, "k string, v string") for rows in (a, b, c)]


def chained(frames):
    out = frames[0]
    for f in frames[1:]:
        out = null_safe_join(out, f, "k", "full")
    return out


@pytest.mark.parametrize("most", [1, 3, 100])
def test_full_outer_chain(tables, rows, no_broadcast, monkeypatch, most):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", most)
    for frames in (tables, tables[:2], tables[1:], tables[:1]):
        found, plain = outer_join_all(frames, ["k"]), chained(frames)
        assert sorted(found.columns) == sorted(plain.columns)
        assert rows(found.select(plain.columns)) == rows(plain)


def test_hot_rows_are_salted(tables, no_broadcast):
    text = outer_join_all(tables, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in text and "FullOuter" in text


def test_right_and_full_by_name(tables, rows, no_broadcast):
    a, b, _ = tables
    b = b.withColumnRenamed("k", "key")
    for how in ("right", "full"):
        plain = null_safe_join(a, b, [("k", "key")], how)
        assert rows(spread_join(a, b, [("k", "key")], how).select(plain.columns)) == rows(plain)


def test_empty_sides(tables, rows, no_broadcast):
    a, b, _ = tables
    for left, right in ((a.where("false"), b), (a, b.where("false")), (a.where("false"), b.where("false"))):
        plain = null_safe_join(left, right, "k", "full")
        assert rows(outer_join_all([left, right], ["k"]).select(plain.columns)) == rows(plain)
