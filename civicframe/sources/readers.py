"""Readers. Every one takes an explicit schema; nothing is inferred.

With ``position=True`` rows carry their place in the input, see ``operators.position``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geometry import orient_polygon, point
from ..operators.position import POSITION, with_item, with_position

Schema = str | T.StructType


def read_delimited(
    spark: SparkSession, path: str, schema: Schema, missing: str = "NA", sep: str = ",", position: bool = False
) -> DataFrame:
    """Delimited text with a header line; the text ``missing`` stands for a missing value."""
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("nullValue", missing)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return with_position(rows) if position else rows


def read_records_json(
    spark: SparkSession, path: str, schema: Schema, multiline: bool = True, position: bool = False
) -> DataFrame:
    """Flat records, as one JSON array per file or (``multiline=False``) one record per line.

    One array is one value to the parser: a large export should be landed as lines or as many
    files, which are read in parallel.
    """
    rows = spark.read.schema(schema).option("multiLine", multiline).json(path)
    return with_position(rows) if position else rows


def read_report(
    spark: SparkSession, path: str, schema: T.StructType, skip: int, missing: str = "", position: bool = False
) -> DataFrame:
    """Delimited report with ``skip`` lines before the header line in every file.

    Files are split as usual. Only the first block of a file is put in line order, to cut its
    first ``skip + 1`` lines. A field must not contain a line break.
    """
    lines = with_position(spark.read.text(path))
    start = F.col(POSITION).start
    order = F.row_number().over(Window.partitionBy(F.col(POSITION).file).orderBy(F.col(POSITION).row))
    head = lines.filter(start == 0).withColumn("line", order).filter(F.col("line") > skip + 1).drop("line")
    body = head.unionByName(lines.filter(start > 0))
    parsed = F.from_csv(
        "value", _ddl(schema), {"nullValue": missing, "quote": '"', "escape": '"'}
    )
    kept = [POSITION] if position else []
    return body.filter(F.trim("value") != "").select(parsed.alias("r"), *kept).select("r.*", *kept)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_mapping(
    spark: SparkSession, path: str, schema: Schema, cols: Sequence[str], missing: str = "NA"
) -> DataFrame:
    """A hand-kept mapping sheet landed as delimited text, cut to ``cols``."""
    return read_delimited(spark, path, schema, missing).select(*cols)


_GEOMETRY = "struct<type:string,coordinates:string>"
_RING = "array<array<double>>"


def _as_points(ring: Column) -> Column:
    return F.transform(ring, lambda p: point(p[0], p[1]))


def parse_geometry(c: Column | str) -> Column:
    """Rings of a GeoJSON Polygon or MultiPolygon given as text; outer rings counter-clockwise.

    Anything else gives missing.
    """
    shape = F.from_json(F.col(c) if isinstance(c, str) else c, _GEOMETRY)
    text = shape.coordinates
    one = F.from_json(text, f"array<{_RING}>")
    many = F.from_json(text, f"array<array<{_RING}>>")

    def polygon(rings: Column) -> Column:
        return orient_polygon(F.transform(rings, _as_points))

    return F.when(shape.type == "Polygon", polygon(one)).when(
        shape.type == "MultiPolygon", F.flatten(F.transform(many, polygon))
    )


def read_boundaries(
    spark: SparkSession,
    path: str,
    attrs: Mapping[str, str] | Sequence[str],
    multiline: bool = True,
    position: bool = False,
) -> DataFrame:
    """Polygons of a GeoJSON feature collection with the wanted properties, and ``rings``.

    ``attrs`` are property names, or a map of new name to property name. With
    ``multiline=False`` the input has one feature per line.
    """
    names = dict(attrs) if isinstance(attrs, Mapping) else {a: a for a in attrs}
    props = T.StructType([T.StructField(p, T.StringType()) for p in set(names.values())])
    feature = T.StructType(
        [T.StructField("properties", props), T.StructField("geometry", T.StringType())]
    )
    if multiline:
        schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
        rows = with_position(spark.read.schema(schema).option("multiLine", True).json(path))
        rows = rows.select(F.posexplode("features").alias("item", "f"), POSITION)
        rows = rows.select("f.*", with_item(F.col("item")).alias(POSITION))
    else:
        rows = with_position(spark.read.schema(feature).json(path))
    return rows.select(
        *[F.col("properties").getField(p).alias(n) for n, p in names.items()],
        parse_geometry("geometry").alias("rings"),
        *([POSITION] if position else []),
    )


def geometry_column(df: DataFrame, source: str, out: str = "rings") -> DataFrame:
    """Turn a GeoJSON text column into rings and drop it."""
    return df.withColumn(out, parse_geometry(source)).drop(source)


def read_columnar_json(spark: SparkSession, path: str, schema: T.StructType, position: bool = False) -> DataFrame:
    """Rows of a JSON document that holds one array per column."""
    arrays = T.StructType(
        [T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields]
    )
    doc = with_position(spark.read.schema(arrays).option("multiLine", True).json(path))
    rows = doc.select(F.posexplode(F.arrays_zip(*[f.name for f in schema.fields])).alias("item", "f"), POSITION)
    kept = [with_item(F.col("item")).alias(POSITION)] if position else []
    return rows.select("f.*", *kept)


# Field names of a geocoder response.
CANDIDATE_TYPE = (
    "struct<street:string,adminArea5:string,adminArea4:string,adminArea3:string,"
    "postalCode:string,geocodeQuality:string,geocodeQualityCode:string,"
    "latLng:struct<lat:double,lng:double>>"
)
RESPONSE_TYPE = (
    "struct<results:array<struct<providedLocation:struct<street:string>,"
    f"locations:array<{CANDIDATE_TYPE}>>>>"
)


def response_rows(df: DataFrame, key: str, response: Column) -> DataFrame:
    """``HASH_KEY``, ``RAW`` and the candidate array of each parsed response."""
    first = F.get(response.results, 0)
    return df.select(
        F.col(key).alias("HASH_KEY"),
        first.providedLocation.street.alias("RAW"),
        first.locations.alias("candidates"),
    )


def response_entries(df: DataFrame, text: str) -> DataFrame:
    """The responses of JSON maps of key to response, one row each."""
    entries = F.explode(F.from_json(text, f"map<string,{RESPONSE_TYPE}>"))
    return response_rows(df.select(entries.alias("key", "response")), "key", F.col("response"))


def read_geocode_responses(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Responses kept as JSON maps of key to response: one per file, or one per line.

    A file that is one map is one value and one task, of 2 GB at most. Land large collections as
    lines, one map of any size each, and read them with ``by_line``: their files are split.
    """
    return response_entries(spark.read.text(path, wholetext=not by_line), "value")
