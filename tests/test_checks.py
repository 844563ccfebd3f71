"""Checks counted in one pass, on their own and beside a write."""

from pyspark.sql import functions as F

from civicframe.functions.missing import lenient
from civicframe.operators import checks

ROWS = [("A", "1"), ("B", "x"), (None, None), ("a", "7"), ("B", "")]
WANT = {"rows": 5, "filled_k": 4, "large": 1, "same": 2, "lost_n": 2}


def measures():
    return checks.check_measures(["k"], {"large": F.col("n") > 5, "same": F.upper("k") == "A"}, {"n": ("v", "n")})


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v string").withColumn("n", lenient("v", "int"))


def test_report_is_one_scan(spark, tmp_path):
    path = str(tmp_path / "in")
    table(spark, ROWS).drop("n").write.parquet(path)
    report = checks.checks_report(spark.read.parquet(path).withColumn("n", lenient("v", "int")), measures())
    # Asked before it runs: afterwards the plan shows both what was planned and what ran.
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r.check: r["count"] for r in report.collect()} == WANT
    assert {r["count"] for r in checks.checks_report(table(spark, []), measures()).collect()} == {0}


def test_counts_taken_while_writing_equal_the_report(spark, tmp_path):
    watched, seen = checks.observed(table(spark, ROWS).repartition(3), measures())
    watched.write.parquet(str(tmp_path / "out"))
    assert seen.get == WANT
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
