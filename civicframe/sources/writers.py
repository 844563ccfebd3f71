"""Writers. All write one file per task into a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_delimited(df: DataFrame, path: str, missing: str = "NA", mode: str = "error") -> None:
    """Delimited text with header, missing values written as ``missing``."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("nullValue", missing)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_records_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One record per line, missing fields written out as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_keyed_json(df: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """Nested records with their key in the field ``key``."""
    write_records_json(df.withColumnRenamed(key, "key"), path, mode)


def geojson_geometry(rings: Column | str) -> Column:
    """Rings as a GeoJSON text: outer rings (counter-clockwise) open a polygon, holes join it."""
    from ..functions.geometry import _ring_edges, _twice_signed_area

    rings = F.col(rings) if isinstance(rings, str) else rings

    def is_outer(ring: Column) -> Column:
        first = F.get(ring, 0)
        return _twice_signed_area(_ring_edges(ring), first.x, first.y) > 0

    def coordinates(ring: Column) -> Column:
        last = F.element_at(ring, -1)
        closed = F.when(F.get(ring, 0) == last, ring).otherwise(
            F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))
        )
        return F.transform(closed, lambda v: F.array(v.x, v.y))

    empty = F.array().cast("array<array<array<array<double>>>>")
    polygons = F.aggregate(
        rings,
        empty,
        lambda acc, ring: F.when(
            is_outer(ring) | (F.size(acc) == 0), F.concat(acc, F.array(F.array(coordinates(ring))))
        ).otherwise(
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.concat(F.element_at(acc, -1), F.array(coordinates(ring)))),
            )
        ),
    )
    return F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))


def geojson_features(
    df: DataFrame, rings: str = "rings", attrs: Sequence[str] | None = None
) -> DataFrame:
    """One GeoJSON feature per row, as the column ``value``."""
    attrs = list(attrs) if attrs is not None else [c for c in df.columns if c != rings]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*attrs).alias("properties"),
        geojson_geometry(rings).alias("geometry"),
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson_features(
    df: DataFrame, path: str, rings: str = "rings", mode: str = "error"
) -> None:
    """One GeoJSON feature per line."""
    geojson_features(df, rings).write.mode(mode).text(path)
