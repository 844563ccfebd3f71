"""Joins, unions, grouping, picking, numbering, reshaping, checks."""

import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicframe.functions.missing import sum_present
from civicframe.operators import checks, columns, groups, joins, reshape


def skewed(spark, n=600):
    """A third of the rows under one key, another share with a missing key, many copies."""
    keys = ["hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}" for i in range(n)]
    return spark.createDataFrame([(k, i % 5) for i, k in enumerate(keys)], "k string, v int").repartition(4)


def test_missing_keys_match(spark, rows):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20), ("z", 30)], "k string, b int")
    assert rows(joins.null_safe_join(a, b, "k")) == rows(
        spark.createDataFrame([(None, 1, 10), ("x", 2, 20)], "k string, a int, b int")
    )
    full = joins.null_safe_join(a, b, "k", "full")
    assert {tuple(r) for r in full.collect()} == {
        (None, 1, 10), ("x", 2, 20), ("y", 3, None), ("z", None, 30),
    }
    assert [r.a for r in joins.anti_join(a, b, "k").collect()] == [3]
    assert sorted(r.a for r in joins.semi_join(a, b, "k").collect()) == [1, 2]


def test_suffixes_and_pairs(spark):
    a = spark.createDataFrame([(1, "p")], "id int, city string")
    b = spark.createDataFrame([(1, "q")], "ref int, city string")
    out = joins.null_safe_join(a, b, [("id", "ref")], "left")
    assert out.columns == ["id", "city_x", "city_y"] and tuple(out.first()) == (1, "p", "q")


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_spread_join_equals_plain_join(spark, rows, no_broadcast, how):
    left = skewed(spark)
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), (None, 3), ("k1", 4), ("none", 5)], "k string, w int"
    )
    spread = joins.spread_join(left, right, "k", how)
    assert "__salt" not in spread.columns
    assert rows(spread) == rows(joins.null_safe_join(left, right, "k", how))


def test_spread_join_salts_only_without_broadcast(spark, no_broadcast):
    left = skewed(spark)
    right = left.groupBy("k").agg(F.sum("v").alias("s"))
    plan = joins.spread_join(left, right, "k")._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan
    with pytest.raises(ValueError):
        joins.spread_join(left, right, "k", "cross")


def test_natural_join_needs_shared_names(spark):
    with pytest.raises(ValueError):
        joins.natural_join(spark.range(1), spark.range(1).toDF("x"))


def test_overrides(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    fix = spark.createDataFrame([(1, "A"), (2, "B")], "k int, value string")
    assert rows(joins.apply_overrides(df, fix, "k", "v")) == [(1, "A"), (2, "B"), (3, "c")]


def test_union_by_name_and_distinct(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "n int, s string")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "s string, n int")
    assert rows(columns.union_distinct(a, b)) == [(1, "x"), (2, "y")]
    assert rows(columns.union_distinct(a, a)) == rows(a.distinct())
    assert columns.union_all(a, b).count() == 4


def test_aggregate_drops_missing_keys_group_by_keeps(spark, rows):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", None)], "k string, v int")
    assert rows(groups.aggregate_by(df, ["k"], s=sum_present("v"))) == [("a", 1)]
    assert groups.first_per_group(df, ["k"], ["v"], ["v"]).count() == 2


def test_split_parts_are_disjoint_and_complete(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    yes, no, unknown = columns.split_on(df, F.col("x") > 1)
    assert [p.count() for p in (yes, no, unknown)] == [1, 1, 1]


def test_group_total_on_hot_key(spark, no_broadcast):
    df = skewed(spark)
    got = groups.group_total(df, ["k"], n=F.count(F.lit(1)))
    expected = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert got.count() == 600
    assert {(r.k, r.n) for r in got.collect()} == set(expected.items())


def test_order_is_required(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    for call in (
        lambda: groups.keep_first(df, ["k"], []),
        lambda: groups.with_row_id(df, []),
        lambda: groups.later_rows(df, ["k"], []),
    ):
        with pytest.raises(ValueError):
            call()


def test_first_later_repeated(spark, rows, no_broadcast):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4), ("b", 9)], "k string, o int")
    firsts, later = groups.keep_first(df, ["k"], ["o"]), groups.later_rows(df, ["k"], ["o"])
    assert {tuple(r) for r in firsts.collect()} == {("a", 1), (None, 4), ("b", 9)}
    assert {tuple(r) for r in later.collect()} == {("a", 2), (None, 5)}
    assert groups.repeated_rows(df, ["k"]).count() == 4


def test_rows_are_cut_per_key_before_the_shuffle(spark):
    df = skewed(spark)
    plan = groups.keep_first(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_row_ids_with_many_copies(spark):
    df = spark.createDataFrame([(1 if i % 3 else 7, "x") for i in range(999)], "v int, s string").repartition(5)
    got = groups.with_row_id(df, ["v"]).collect()
    assert sorted(r.row_id for r in got) == list(range(1, 1000))
    by_id = [r.v for r in sorted(got, key=lambda r: r.row_id)]
    assert by_id == sorted(by_id)
    assert groups.slice_rows(df, ["v"], 2).count() == 998
    assert groups.slice_rows(df, ["v"], 10, 19).count() == 10


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=2, max_size=60))
def test_quartiles_are_exact(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    row = groups.six_number_summary(df, "x").first()
    q1, q2, q3 = statistics.quantiles(xs, n=4, method="inclusive")
    assert (row.q1, row["median"], row.q3) == pytest.approx((q1, q2, q3))
    assert (row["min"], row["max"], row.missing) == (min(xs), max(xs), 1)


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(101)], "x double, g string")
    got = groups.histogram(df, "x", 10, ["g"]).collect()
    assert sum(r["count"] for r in got) == 101 and max(r.bin for r in got) == 9
    one = spark.createDataFrame([(5.0,)] * 3, "x double")
    assert [(r.bin, r["count"]) for r in groups.histogram(one, "x", 4).collect()] == [(0, 3)]


def test_frequency_and_repeat_count(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "s string")
    assert [tuple(r) for r in groups.frequency(df, "s", ordered=True).collect()] == [("a", 2), ("", 1)]
    assert rows(groups.repeat_count(df, "s", "n")) == rows(
        spark.createDataFrame([("a", 2), ("a", 2), ("", -1), (None, -1)], "s string, n long")
    )


def test_consolidate(spark, rows):
    df = spark.createDataFrame(
        [("z", "white", 1), ("z", "mult", 2), ("z", "other", 3), (None, "mult", 9)],
        "zip string, race string, n long",
    )
    out = groups.consolidate(df, "race", ["mult"], "other", ["zip"], "n")
    assert rows(out) == [("z", "other", 5), ("z", "white", 1)]


def test_reshape(spark, rows):
    df = spark.createDataFrame([("f", "1", None)], "fund string, exp_1995 string, app_1996 string")
    long = reshape.separate(reshape.melt_rest(df, ["fund"], "ty", "v"), "ty", ["type", "year"], "_")
    assert {(r.type, r.year, r.v) for r in long.collect()} == {("exp", "1995", "1"), ("app", "1996", None)}
    one = reshape.separate(spark.createDataFrame([("x",)], "s string"), "s", ["a", "b"], "_").first()
    assert (one.a, one.b) == ("x", None)
    melted = reshape.melt(spark.createDataFrame([(1, 2, 3)], "id int, p_a int, p_b int"), ["p_a", "p_b"], "l", "v", "p_")
    assert rows(melted) == [(1, "a", 2), (1, "b", 3)]


def test_years(spark):
    df = spark.createDataFrame([(1990,), (2000,), (1950,)], "y int")
    out = reshape.expand_years(df, "y", {1990: (1984, 1999), 2000: (2000, 2009)}, "j")
    assert out.count() == 26 and out.filter("y = 1990").agg(F.min("j"), F.max("j")).first() == (1984, 1999)
    assert reshape.copy_year(df, "y", 2000, 2001).count() == 4


def test_flatten_candidates(spark):
    schema = "k string, c array<struct<a:string,p:struct<q:int>>>"
    df = spark.createDataFrame([("x", [("one", (1,)), ("two", (2,))])], schema)
    row = reshape.flatten_candidates(df, "c", {"A": "a", "Q": "p.q"}, 3).first()
    assert row.asDict() == {"k": "x", "A": "one", "Q": 1, "A_2": "two", "Q_2": 2, "A_3": None, "Q_3": None}


def test_names_and_conform(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["_1_area", "CASE NO", "_c2", "CASE.NO"])
    assert columns.repair_names(df).columns == ["X_1_area", "CASE.NO", "...3", "CASE.NO.1"]
    schema = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.StringType())])
    out = columns.conform(spark.createDataFrame([(1,)], "a int"), schema)
    assert out.schema == schema and tuple(out.first()) == (None, "1")
    assert columns.empty_table(spark, schema).count() == 0


def test_checks(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 1), ("B", None, 2)], "s string, e string, n int")
    assert checks.duplicate_rows(df).first().copies == 2
    assert checks.all_missing(df, ["e"]).first()[0] is True
    assert checks.all_missing(df, ["e", "s"]).first()[0] is False
    assert tuple(checks.filled_counts(df, ["s", "e"]).first()) == (3, 0)
    assert checks.conflicts(df.withColumn("t", F.lit("A")), "s", "t").count() == 1
    assert checks.unmatched(df, "e").count() == 3
    assert {tuple(r) for r in checks.row_counts(x=df, y=df.limit(0)).collect()} == {("x", 3), ("y", 0)}


def test_no_rows_lost_with_random_keys(spark, no_broadcast):
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice([None, "a", "b"]), i) for i in range(200)], "k string, i int")
    right = spark.createDataFrame([("a", "A"), (None, "N")], "k string, w string")
    out = joins.spread_join(left, right, "k", "left")
    assert out.count() == 200 and out.filter("w IS NULL").count() == left.filter("k = 'b'").count()


def test_a_hot_key_is_spread_after_a_shuffle_by_it(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 1000)
    left = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("k"), "id").repartition(4, "k")
    hot = joins.hot_keys(left, ["k"]).collect()
    assert [(r["k"], r["__salts"]) for r in hot] == [(1, 18)]
    salts = left.where("k = 1").select(F.pmod(joins._row_hash(left), F.lit(18)).alias("s")).groupBy("s").count().collect()
    assert len(salts) == 18 and max(r["count"] for r in salts) < 1500
    right = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert joins.spread_join(left, right, "k", "inner").count() == 20_000


def test_missing_right_keys_are_copied_only_when_hot_on_the_left(spark, no_broadcast):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), *[(None, "b")] * 50], "k int, v string")
    assert joins.hot_keys(left, ["k"]).count() == 0
    assert joins.spread_join(left, right, "k", "left").count() == 2
