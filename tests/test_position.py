"""Order by input position over files that are split."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicframe.operators import groups
from civicframe.operators.columns import union_distinct
from civicframe.operators.position import POSITION, stacked
from civicframe.sources import readers

KIND = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
FILES, ROWS = 3, 400


def lines(n):
    """Keys that repeat in each file and between files; a value tells the place."""
    return [(f"k{(7 * i + n) % 90}", n * ROWS + i) for i in range(ROWS)]


@pytest.fixture
def split(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture(params=["delimited", "lines", "array", "report", "columns"])
def table(request, spark, split, tmp_path):
    for n in range(FILES):
        rows, path = lines(n), tmp_path / f"part{n}"
        if request.param == "delimited":
            path.write_text("k,v\n" + "\n".join(f"{k},{v}" for k, v in rows))
        elif request.param == "report":
            path.write_text("about\nmore\nk,v\n" + "\n".join(f"{k},{v}" for k, v in rows))
        elif request.param == "lines":
            path.write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))
        elif request.param == "array":
            path.write_text(json.dumps([{"k": k, "v": v} for k, v in rows]))
        else:
            path.write_text(json.dumps({"k": [k for k, _ in rows], "v": [v for _, v in rows]}))
    folder = str(tmp_path)
    return {
        "delimited": lambda: readers.read_delimited(spark, folder, KIND, position=True),
        "lines": lambda: readers.read_records_json(spark, folder, KIND, multiline=False, position=True),
        "array": lambda: readers.read_records_json(spark, folder, KIND, position=True),
        "report": lambda: readers.read_report(spark, folder, KIND, 2, position=True),
        "columns": lambda: readers.read_columnar_json(spark, folder, KIND, position=True),
    }[request.param]()


def test_first_rows_are_those_of_the_files(table):
    everything = [r for n in range(FILES) for r in lines(n)]
    firsts = {}
    for k, v in everything:
        firsts.setdefault(k, v)
    dealt = table.repartition(5, F.xxhash64("v"))
    assert {(r.k, r.v) for r in groups.keep_first(dealt, ["k"]).collect()} == set(firsts.items())
    assert {r.v for r in groups.later_rows(dealt, ["k"]).collect()} == {v for k, v in everything if firsts[k] != v}
    assert {(r.k, r.v) for r in groups.first_per_group(dealt, ["k"], ["v"]).collect()} == set(firsts.items())
    numbered = groups.with_row_id(dealt).collect()
    assert [r.v for r in sorted(numbered, key=lambda r: r.row_id)] == list(range(FILES * ROWS))
    assert [r.v for r in groups.slice_rows(dealt, None, 5, 7).orderBy("v").collect()] == [4, 5, 6]
    assert POSITION in table.columns and [r.v for r in table.orderBy(POSITION).collect()] == list(range(FILES * ROWS))


def test_stacks_keep_the_order_of_their_tables(spark, split, tmp_path):
    for n in range(2):
        (tmp_path / f"t{n}.csv").write_text("k,v\n" + "\n".join(f"{k},{v}" for k, v in lines(n)))
    first, second = (readers.read_delimited(spark, str(tmp_path / f"t{n}.csv"), KIND, position=True) for n in (0, 1))
    both = stacked(second, first)
    expected = [v for _, v in lines(1) + lines(0)]
    assert [r.v for r in both.orderBy(POSITION).collect()] == expected
    assert [r.v for r in stacked(first, both).orderBy(POSITION).collect()] == [v for _, v in lines(0)] + expected
    once = union_distinct(second, first, second)
    assert [r.v for r in once.orderBy(POSITION).collect()] == expected


def test_no_order_and_no_position(spark):
    df = spark.createDataFrame([("a", 1)], KIND)
    for call in (lambda: groups.keep_first(df, ["k"]), lambda: groups.with_row_id(df), lambda: groups.later_rows(df, ["k"], [])):
        with pytest.raises(ValueError):
            call()
