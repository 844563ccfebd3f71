"""Readers and writers on files in temporary folders."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicframe.functions import geometry as G
from civicframe.operators.columns import all_text
from civicframe.sources import readers, writers
from civicframe.sources.versions import SourceVersion, load_versions

TEXT = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])


def test_delimited_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("x,\"y\"", 1), (None, None), ("z", 3)], TEXT)
    path = str(tmp_path / "csv")
    writers.write_delimited(df, path)
    assert rows(readers.read_delimited(spark, path, TEXT)) == rows(df)
    assert "NA,NA" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert readers.read_mapping(spark, path, TEXT, ["b"]).columns == ["b"]


def test_records_json(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text(json.dumps([{"a": "x", "b": 1}, {"a": None}]))
    df = readers.read_records_json(spark, str(tmp_path / "a.json"), TEXT)
    assert rows(df) == [("x", 1), (None, None)] or rows(df) == [(None, None), ("x", 1)]
    out = str(tmp_path / "out")
    writers.write_records_json(df, out)
    assert rows(readers.read_records_json(spark, out, TEXT, multiline=False)) == rows(df)


def test_columnar_json(spark, tmp_path, rows):
    (tmp_path / "c.json").write_text(json.dumps({"a": ["x", "y"], "b": [1, 2]}))
    assert rows(readers.read_columnar_json(spark, str(tmp_path / "c.json"), TEXT)) == [("x", 1), ("y", 2)]


def test_report_over_many_blocks(spark, tmp_path, rows):
    for n in range(2):
        lines = [f"preamble {i}" for i in range(11)] + ["a,b"]
        lines += [f"\"f{n}, {i}\",{i}" for i in range(500)] + [""]
        (tmp_path / f"r{n}.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.read_report(spark, str(tmp_path), TEXT, 11)
        assert df.count() == 1000
        assert {(r.a, r.b) for r in df.collect()} == {(f"f{n}, {i}", i) for n in range(2) for i in range(500)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


SQUARE = [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]
HOLE = [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]


def collection():
    far = [[[x + 10, y] for x, y in SQUARE]]
    return {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"zip": "1", "x": 5}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}},
            {"type": "Feature", "properties": {"zip": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], far]}},
            {"type": "Feature", "properties": {"zip": "3"}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
        ],
    }


def test_boundaries_round_trip(spark, tmp_path):
    (tmp_path / "b.geojson").write_text(json.dumps(collection()))
    df = readers.read_boundaries(spark, str(tmp_path / "b.geojson"), {"code": "zip"})
    area = G.polygon_area("rings")
    got = {r.code: r.a for r in df.select("code", area.alias("a")).collect()}
    assert got == {"1": pytest.approx(12), "2": pytest.approx(32), "3": None}
    out = str(tmp_path / "out")
    writers.write_geojson_features(df.filter("rings IS NOT NULL"), out)
    again = readers.read_boundaries(spark, out, ["code"], multiline=False)
    assert {r.code: r.a for r in again.select("code", area.alias("a")).collect()} == {"1": pytest.approx(12), "2": pytest.approx(32)}
    line = json.loads(next(x for p in (tmp_path / "out").glob("*.txt") for x in p.read_text().splitlines() if '"1"' in x))
    assert [len(p) for p in line["geometry"]["coordinates"]] == [2]


def test_geometry_column(spark):
    df = spark.createDataFrame([("a", json.dumps({"type": "Polygon", "coordinates": [SQUARE]})), ("b", "broken")], "n string, the_geom string")
    out = readers.geometry_column(df, "the_geom")
    assert out.columns == ["n", "rings"]
    assert [r.a for r in out.orderBy("n").select(G.polygon_area("rings").alias("a")).collect()] == [16.0, None]


def test_geocode_responses(spark, tmp_path):
    one = {"street": "s", "adminArea5": "Chicago", "adminArea4": "Cook", "adminArea3": "IL", "latLng": {"lat": 1.5, "lng": 2.5}}
    doc = {"k1": {"results": [{"providedLocation": {"street": "raw"}, "locations": [one, one]}]}, "k2": {"results": []}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    got = {r.HASH_KEY: (r.RAW, None if r.candidates is None else len(r.candidates)) for r in readers.read_geocode_responses(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"k1": ("raw", 2), "k2": (None, None)}


def test_keyed_json(spark, tmp_path):
    df = spark.createDataFrame([("h", ("x", 1))], "hash string, response struct<a:string,b:int>")
    writers.write_keyed_json(df, str(tmp_path / "k"), "hash")
    text = "".join(p.read_text() for p in (tmp_path / "k").glob("*.json"))
    assert json.loads(text) == {"key": "h", "response": {"a": "x", "b": 1}}


def test_versions(spark, rows):
    schema = T.StructType([T.StructField("amount", T.StringType()), T.StructField("note", T.StringType()), T.StructField("year", T.IntegerType())])
    versions = [
        SourceVersion(2011, lambda: spark.createDataFrame([("1",)], "amount string")),
        SourceVersion(2012, lambda: spark.createDataFrame([("2",)], "old string"), {"old": "amount"}, {"note": "n"}),
    ]
    assert rows(load_versions(versions, schema)) == [("1", None, 2011), ("2", "n", 2012)]


def test_all_text(spark):
    assert all_text(spark.createDataFrame([(1, 2.5)], "`a.b` int, c double")).dtypes == [("a.b", "string"), ("c", "string")]


def test_missing_stays_distinct_from_empty(spark, tmp_path):
    df = spark.createDataFrame([("NA", 1)], TEXT).withColumn("a", F.lit(None).cast("string"))
    path = str(tmp_path / "m")
    writers.write_delimited(df, path, missing="<none>")
    assert readers.read_delimited(spark, path, TEXT, "<none>").first().a is None
