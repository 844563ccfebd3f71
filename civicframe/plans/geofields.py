"""Block groups with zip code, neighborhood and centroid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import centroid
from ..operators.spatial import assign_areas


def blockgroup_fields(
    blockgroups: DataFrame,
    neighborhoods: DataFrame,
    zips: DataFrame,
    cell: float | None = None,
) -> DataFrame:
    """``zip, block_group, latitude, longitude, country, neighborhood`` per block group.

    ``neighborhoods`` carries ``neighborhood``, ``zips`` carries ``zip``; one row per name.
    """
    centre = centroid("rings")
    layers = {"zip": (zips, []), "neighborhood": (neighborhoods, [])}
    return assign_areas(blockgroups, "block_group", layers, cell=cell).select(
        "block_group",
        "zip",
        "neighborhood",
        centre.y.alias("latitude"),
        centre.x.alias("longitude"),
        F.lit("U.S.A.").alias("country"),
    )
