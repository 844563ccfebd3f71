"""Gunshot cases: extract, locations from several sources, areas and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_day_year
from ..functions.missing import contains_any, first_present, if_else, paste, recode
from ..functions.text import address_key, title_case, trim_right_to_letter
from ..operators.columns import map_columns, pick, union_distinct
from ..operators.geocoding import prefer_sources
from ..operators.groups import keep_first
from ..operators.joins import apply_overrides, null_safe_join, spread_join
from ..operators.spatial import enrich_areas

# Headers of the case report, as they read after name repair, and their names here.
REPORT_NAMES = {
    "CASE NO": "case_no",
    "NAME": "name",
    "MANNER": "manner",
    "AGE": "age",
    "SEX": "sex",
    "RACE": "race",
    "...9": "latino",
    "PRIMARY CAUSE": "primary_cause_a",
    "b": "primary_cause_b",
    "...12": "primary_cause_c",
    "...13": "secondary_cause",
    "DATE OF DEATH": "date_of_death",
    "...19": "incident_address",
    "INCIDENT CITY": "incident_city",
}
# Report columns that hold nothing.
EMPTY_COLUMNS = ["...2", "...3", "...14", "...16", "...17", "...18"]
# Race labels of the reports and their replacements.
RACE_NAMES = {"AM. INDIAN": "NATIVE AMERICAN", "ORIENTAL": "ASIAN"}
RACES_KEPT = ["BLACK", "WHITE", "ASIAN", "NATIVE AMERICAN"]
CAUSES = ["primary_cause_a", "primary_cause_b", "primary_cause_c", "secondary_cause"]
UPPER_COLUMNS = [*CAUSES, "sex", "race", "latino", "incident_address", "incident_city"]
TITLE_COLUMNS = [
    "city",
    "address",
    "pri_neighborhood",
    "sec_neighborhood",
    "name",
    "race",
    "sex",
    "latino",
    "primary_cause",
    "secondary_cause",
]
LOCATION_COLUMNS = ["case_no", "full_address", "city", "zip", "lat", "lon"]


def combine_reports(*reports: DataFrame) -> DataFrame:
    """Set union of report extracts, renamed, empty columns dropped, dates parsed, texts upper-cased."""
    cases = union_distinct(*reports).withColumnsRenamed(REPORT_NAMES).drop(*EMPTY_COLUMNS)
    cases = cases.withColumn("date_of_death", month_day_year("date_of_death"))
    return map_columns(cases, UPPER_COLUMNS, F.upper)


def race_label(race: Column | str, latino: Column) -> Column:
    """Race with old names replaced; being Latino beats it, and missing Latino makes it missing."""
    return if_else(latino, "LATINO", recode(race, RACE_NAMES, RACES_KEPT, "OTHER"))


def gunshot_cases(cases: DataFrame, word: str = "GUNSHOT") -> DataFrame:
    """Cases with the word in any cause, with race label and one text of the further causes."""
    further = paste([F.coalesce(F.col(c), F.lit("-")) for c in CAUSES[1:]], " ")
    return (
        cases.filter(contains_any(CAUSES, word))
        .withColumns(
            {
                "race": race_label("race", F.col("latino") == "YES"),
                "primary_cause": F.col("primary_cause_a"),
                "secondary_cause": trim_right_to_letter(further),
            }
        )
        .drop("primary_cause_a", "primary_cause_b", "primary_cause_c")
    )


def named_locations(address_map: DataFrame, geocoded: DataFrame, cases: DataFrame) -> DataFrame:
    """Locations of cases whose address is a place name, through a map of names to addresses.

    ``address_map``: id, raw, address, city, zip. ``geocoded``: id, lat, lon. Names without a
    case stay, with a missing case number.
    """
    mapped = null_safe_join(
        address_map.filter("zip IS NOT NULL"), geocoded.select("id", "lat", "lon"), "id", "left"
    ).withColumn("join_field", address_key("raw"))
    keyed = cases.select("case_no", address_key("incident_address").alias("join_field"))
    matched = spread_join(keyed, mapped, "join_field", "inner")
    names = {
        "case_no": "case_no",
        "full_address": "address",
        "city": "city",
        "zip": "zip",
        "lat": "lat",
        "lon": "lon",
    }
    alone = null_safe_join(mapped, keyed.select("join_field").distinct(), "join_field", "anti")
    alone = alone.withColumn("case_no", F.lit(None).cast("string"))
    return (
        pick(matched, names)
        .unionByName(pick(alone, names))
        .withColumn("zip", F.col("zip").cast("string"))
    )


def manual_locations(
    manual: DataFrame,
    cases: DataFrame,
    key_overrides: DataFrame,
    case_overrides: DataFrame,
    order_by: Sequence[str],
) -> DataFrame:
    """Hand-made locations joined to cases by normalized address, first row per key and per case.

    ``manual``: raw, street, city, state, zip, lat, lon and the ``order_by`` columns.
    ``key_overrides`` and ``case_overrides`` map a full address to the join key, or the case
    number, to use in place of the derived one.
    """
    full = manual.withColumns(
        {
            "full_address": paste(["street", "city", "state", "zip"], ", "),
            "join_field": address_key("raw"),
            "city": F.upper("city"),
            "zip": F.col("zip").cast("string"),
        }
    )
    keyed = keep_first(
        apply_overrides(full, key_overrides, "full_address", "join_field"), ["join_field"], order_by
    )
    by_key = cases.select("case_no", address_key("incident_address").alias("join_field"))
    matched = spread_join(by_key, keyed, "join_field", "inner")
    alone = null_safe_join(keyed, by_key.select("join_field").distinct(), "join_field", "anti")
    joined = matched.unionByName(alone.withColumn("case_no", F.lit(None).cast("string")))
    joined = apply_overrides(joined, case_overrides, "full_address", "case_no")
    return keep_first(
        joined.filter("case_no IS NOT NULL"), ["case_no"], [*order_by, "join_field"]
    ).select(LOCATION_COLUMNS)


def consolidated_locations(
    named: DataFrame, manual: Sequence[DataFrame], api: DataFrame
) -> DataFrame:
    """Named and manual locations win over those of a geocoder."""
    return prefer_sources([named, *manual], api, "case_no", "lat")


def attach_locations(cases: DataFrame, locations: DataFrame) -> DataFrame:
    return spread_join(cases, locations, "case_no", "left")


def looks_locatable(address: Column, date: Column, cutoff: str = "2015-01-01") -> Column:
    """Address that is no scene, street corner or unknown; up to the cutoff it must start with a digit."""
    old = if_else(date <= F.lit(cutoff).cast("date"), address.rlike(r"^\d"), True)
    return (
        address.isNotNull()
        & (F.substring(address, 1, 4) != "SCEN")
        & (F.substring(address, 1, 1) != "S")
        & (F.substring(address, 1, 3) != "UNK")
        & old
    )


def location_worklist(located: DataFrame, cutoff: str = "2015-01-01") -> DataFrame:
    """Cases without a location whose address looks locatable."""
    return located.filter(F.col("lat").isNull()).filter(
        looks_locatable(F.col("incident_address"), F.col("date_of_death"), cutoff)
    )


def labelled_cases(
    located: DataFrame,
    blockgroups: DataFrame,
    community_areas: DataFrame,
    neighborhoods: DataFrame,
    cells: tuple[float | None, float | None, float | None] = (None, None, None),
) -> DataFrame:
    """Attach block group, community area and neighborhood, then write labels in title case.

    Polygon tables carry ``block_group``; ``comarea_id, community_area``;
    ``pri_neighborhood, sec_neighborhood``. A row gets the areas of its own point.
    """
    areas = {
        "blockgroups": (blockgroups, ["block_group"], cells[0]),
        "community_areas": (community_areas, ["comarea_id", "community_area"], cells[1]),
        "neighborhoods": (neighborhoods, ["pri_neighborhood", "sec_neighborhood"], cells[2]),
    }
    placed = enrich_areas(located, areas)
    placed = placed.withColumn("city", first_present("city", "incident_city")).withColumns(
        {
            "address": F.col("full_address"),
            "pri_neighborhood": first_present("pri_neighborhood", "city"),
        }
    )
    titled = map_columns(placed.drop("full_address"), TITLE_COLUMNS, title_case)
    return titled.withColumn("race", first_present("race", F.lit("Other")))
