"""Tables that grow by batches: repeats, failures and overlaps."""

import pytest
from pyspark.sql import functions as F

from civicframe.operators import geocoding
from civicframe.plans import locating
from civicframe.sources import batches


def test_a_batch_counts_once(spark, tmp_path, rows):
    folder = str(tmp_path / "t")
    assert batches.batch_rows(spark, folder) is None and batches.manifest(spark, folder).count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert batches.append_batch(df, folder, "one", ["k"])
    assert not batches.append_batch(df, folder, "one", ["k"])
    more = spark.createDataFrame([(2, "z"), (3, "d"), (3, "e"), (None, "y")], "k int, v string")
    assert batches.append_batch(more, folder, "two", ["k"])
    assert rows(batches.batch_rows(spark, folder)) == rows(
        spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (3, "e")], "k int, v string")
    )
    assert rows(batches.manifest(spark, folder).select("batch", "rows")) == [("one", 3), ("two", 2)]


def test_a_run_that_ends_before_the_commit_leaves_no_rows(spark, tmp_path, rows, monkeypatch):
    folder = str(tmp_path / "t")
    df = spark.createDataFrame([(1,), (2,)], "k int")
    batches.append_batch(df, folder, "one", ["k"])
    more = spark.createDataFrame([(2,), (3,)], "k int")

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(batches, "commit", lost)
        with pytest.raises(OSError):
            batches.append_batch(more, folder, "two", ["k"])
    assert len(list((tmp_path / "t" / "parts").iterdir())) == 2
    assert rows(batches.batch_rows(spark, folder)) == [(1,), (2,)]
    assert batches.append_batch(more, folder, "two", ["k"])
    assert rows(batches.batch_rows(spark, folder)) == [(1,), (2,), (3,)]


def test_work_that_fails_in_a_task_leaves_no_rows(spark, tmp_path, rows):
    folder = str(tmp_path / "t")
    df = spark.range(10).withColumn("k", F.col("id"))
    with pytest.raises(Exception, match="seven"):
        batches.append_batch(df, folder, "one", ["k"], lambda r: r.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("seven"))).otherwise(F.lit("x"))))
    assert batches.batch_rows(spark, folder) is None
    assert batches.append_batch(df, folder, "one", ["k"]) and batches.batch_rows(spark, folder).count() == 10


def test_two_commits_of_a_batch_count_as_one(spark, tmp_path):
    folder = str(tmp_path / "t")
    df = spark.range(5)
    for _ in range(2):
        batches.commit(spark, folder, "one", *batches.stage(df, folder))
    assert batches.batch_rows(spark, folder).count() == 5


def test_empty_batch(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert batches.append_batch(spark.range(0), folder, "none", ["id"])
    assert batches.batch_rows(spark, folder).count() == 0
    assert batches.append_batch(spark.range(3), folder, "some", ["id"])
    assert batches.batch_rows(spark, folder).count() == 3


def test_addresses_located_in_batches_equal_those_located_at_once(spark, tmp_path, rows):
    folder = str(tmp_path / "t")
    todo = spark.createDataFrame(
        [(f"ME{i:02}", f"{i % 9 + 1} OAK ST", None) for i in range(23)], "case_no string, incident_address string, incident_city string"
    )
    book = spark.createDataFrame(
        [(i, f"{i} OAK ST CHICAGO", f"{i} Oak St, Chicago, IL 60601", 41.8, -87.6) for i in range(1, 7)],
        "place_id int, address string, formatted string, lat double, lon double",
    )
    rounds = [geocoding.Round("raw", F.col("full_address"), book, "address")]
    for first, last in ((1, 5), (6, 15), (10, 18), (6, 15), (19, None)):
        locating.locate_batch(todo, rounds, folder, first, last)
    assert rows(batches.batch_rows(spark, folder)) == rows(locating.locate_addresses(todo, rounds))
    assert batches.manifest(spark, folder).count() == 4
