"""Opioid cases from the case archive, with community areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import if_else, recode
from ..operators.spatial import point_in_polygon_join

# Race labels of the archive.
RACE_NAMES = {"Am. Indian": "Native American"}
RACES_KEPT = ["Black", "White", "Asian", "Native American"]
DROPPED = [
    "primary_cause_line_a",
    "primary_cause_line_b",
    "primary_cause_line_c",
    "gun_related",
    "opioid_related",
    "commissioner_district",
    "objectid",
]


def opioid_cases(
    archive: DataFrame, community_areas: DataFrame, cell: float | None = None
) -> DataFrame:
    """Archive cases with race label and community area; unlocated cases stay.

    ``community_areas`` carries ``area_numbe, community``. Rows that are equal after the join
    count once.
    """
    race = recode("race", RACE_NAMES, RACES_KEPT, "Other")
    cases = (
        archive.withColumn("race", race)
        .drop(*DROPPED)
        .withColumn("race", if_else(F.col("latino"), "Latino", F.col("race")))
        .filter(F.col("case_number") != "")
    )
    placed = point_in_polygon_join(
        cases, community_areas, ["area_numbe", "community"], "longitude", "latitude", cell=cell
    )
    return placed.distinct().withColumnsRenamed(
        {"area_numbe": "community_area_id", "community": "community_area"}
    )
