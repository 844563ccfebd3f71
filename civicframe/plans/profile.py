"""Profiles of the case table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import matches
from ..operators.groups import frequency, histogram, with_row_id


def address_frequency(cases: DataFrame) -> DataFrame:
    """Addresses by how often they occur, the most frequent first."""
    return frequency(cases, "incident_address", "freq", ordered=True)


def numbered_addresses(cases: DataFrame) -> DataFrame:
    """Distinct addresses that start with a digit from 1 to 9, numbered in text order."""
    found = cases.filter(matches("incident_address", "^[123456789]+"))
    distinct = found.select(
        F.col("incident_address").alias("raw"),
        F.col("incident_address").alias("address"),
        F.lit("").alias("city"),
        F.lit("IL").alias("state"),
        F.lit("").alias("zip"),
    ).distinct()
    return with_row_id(distinct, ["raw"], "id")


def city_frequency(cases: DataFrame, without: str | None = None) -> DataFrame:
    """Cases per city, optionally without one city."""
    kept = cases.filter(F.col("incident_city") != without) if without else cases
    return frequency(kept, "incident_city", "freq")


def deaths_over_time(cases: DataFrame, bins: int = 30) -> DataFrame:
    """Counts in equal steps of the date of death, by sex."""
    days = F.unix_date("date_of_death")
    return histogram(cases.select("sex", days.alias("day")), "day", bins, ["sex"])
