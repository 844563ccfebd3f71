"""Monthly crime counts by category, arrest, community area and zip code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_floor
from ..operators.groups import aggregate_by
from ..operators.joins import look_up, spread_join
from ..operators.spatial import point_in_polygon_join

KEYS = ["month", "crime_category", "arrest", "community_area", "zip", "year"]


def monthly_counts(
    crimes: DataFrame,
    categories: DataFrame,
    zips: DataFrame | None,
    community_names: DataFrame,
    cell: float | None = None,
) -> DataFrame:
    """Crimes per month and group, with the community area's name.

    Crimes are a set: one that is delivered twice counts once. Types without a category drop out,
    and so do crimes with a missing key: those without a community area, and, when ``zips`` is
    given, those within no zip polygon. Without ``zips`` the zip key is left out.
    ``community_names``: community_area, community.
    """
    keys = KEYS if zips is not None else [k for k in KEYS if k != "zip"]
    found = crimes.dropna(subset=["date", "arrest", "community_area", "year"])
    # Types without a category go before rows are moved.
    found = look_up(found, categories, "primary_type").distinct().withColumn("month", month_floor("date"))
    if zips is not None:
        found = point_in_polygon_join(found, zips, ["zip"], "longitude", "latitude", cell=cell, how="inner", origin=crimes)
    counts = aggregate_by(found, keys, count_of_crimes=F.count(F.lit(1)))
    return spread_join(counts, community_names, "community_area", "left")
