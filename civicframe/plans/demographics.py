"""Census counts by zip code and survey counts by tract, as long tables by year, race and sex."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import classify, if_else, sentinel_to_missing
from ..functions.text import remove_first
from ..operators.columns import map_columns
from ..operators.groups import consolidate
from ..operators.joins import null_safe_join, outer_join_all, semi_join
from ..operators.reshape import copy_year, expand_years, melt, melt_groups, spans_overlap
from ..operators.spatial import assign_areas, largest_overlap
from ..sources.versions import SourceVersion, load_versions

# Coded census counts and their names.
CENSUS_NAMES = {
    "CL8AA": "total_pop",
    "CM0AA": "total_males",
    "CM0AB": "total_females",
    "CM1AA": "pop_race_white",
    "CM1AB": "pop_race_black",
    "CM1AC": "pop_race_native_am",
    "CM1AD": "pop_race_asian",
    "CM1AE": "pop_race_pacific_island",
    "CM1AF": "pop_race_other",
    "CM1AG": "pop_race_mult",
    "CM9AA": "occupied_units",
    "CM9AB": "vacant_units",
    "CN1AA": "owner_occupied",
    "CN1AB": "renter_occupied",
    "CY5AA": "own_white_occupied",
    "CY5AB": "own_black_occupied",
    "CY5AC": "own_native_am_occupied",
    "CY5AD": "own_asian_occupied",
    "CY5AE": "own_other_occupied",
    "CY5AF": "own_mult_race_occupied",
    "CY5AG": "rent_white_occupied",
    "CY5AH": "rent_black_occupied",
    "CY5AI": "rent_native_am_occupied",
    "CY5AJ": "rent_asian_occupied",
    "CY5AK": "rent_other_occupied",
    "CY5AL": "rent_mult_race_occupied",
}
# Years each census stands for.
CENSUS_SPANS = {1990: (1984, 1999), 2000: (2000, 2009), 2010: (2010, 2020)}
# Survey codes and their names.
SURVEY_NAMES = {
    "B01003_001E": "Total_Population",
    "B01001_002E": "Population_Male",
    "B01001_026E": "Population_Female",
    "B01001H_001E": "Population_White",
    "B01001B_001E": "Population_Black",
    "B01001C_001E": "Population_Native_American",
    "B01001D_001E": "Population_Asian",
    "B01001I_001E": "Population_Latino",
    "B19013_001E": "Median_Income_All",
    "B19013H_001E": "Median_Income_White",
    "B19013B_001E": "Median_Income_Black",
    "B19013C_001E": "Median_Income_Native_American",
    "B19013D_001E": "Median_Income_Asian",
}
# Fixed value: the survey's mark for no value.
NO_INCOME = -666666666
SURVEY_RACES = ["White", "Black", "Native_American", "Asian"]
SURVEY_SEXES = ["Female", "Male"]
SURVEY_SCHEMA = T.StructType(
    [T.StructField("GEO_ID", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in SURVEY_NAMES.values()]
    + [T.StructField("acs_year", T.IntegerType())]
)
# Output labels.
RACE_LABELS = {"black": "Black", "white": "White", "asian": "Asian", "native_am": "Native American"}
SEX_LABELS = {"males": "Male", "females": "Female"}
UNITS = ["occupied_units", "vacant_units", "owner_occupied", "renter_occupied"]


def named_counts(coded: DataFrame) -> DataFrame:
    """Census counts under their names instead of their codes; other columns stay."""
    return coded.withColumnsRenamed(CENSUS_NAMES)


def census_long(
    census: DataFrame, zips: DataFrame, spans: Mapping[int, tuple[int, int]] = CENSUS_SPANS
) -> DataFrame:
    """Decennial counts of the wanted zips by zip, year, race and sex.

    ``census``: geogyear, datayear, zcta and the counts under their names; ``zips``: zip.
    """
    if spans_overlap(spans):
        raise ValueError("a year must not be stood for by two censuses")
    # A year stands for one census, so all sums and joins are done per census and repeated last.
    keys = ["zcta", "datayear", "race", "sex"]
    wanted = zips.filter("zip IS NOT NULL").select(F.col("zip").cast("string").alias("zcta"))
    counts = semi_join(census.withColumn("zcta", F.col("zcta").cast("string")), wanted, "zcta")
    kept = counts.filter(F.col("datayear").isin(list(spans))).distinct()
    by_sex = melt(kept, ["total_males", "total_females"], "sex", "pop_sex", "total_")

    races = [c for c in census.columns if c.startswith("pop_race_")]
    race = melt(by_sex, races, "race", "pop_race", "pop_race_")
    folded = if_else(F.col("race").isin("mult", "pacific_island"), "other", F.col("race"))
    race = race.withColumn("race", folded).filter("pop_race IS NOT NULL")
    main = race.select(
        *keys, "geogyear", F.col("datayear").alias("known"), "total_pop", *UNITS, "pop_sex"
    ).distinct()
    others = [k for k in keys if k != "race"]
    parts = [main, consolidate(race, "race", ["other"], "other", others, "pop_race")]
    for prefix, measure in (("own_", "pop_own_race"), ("rent_", "pop_rent_race")):
        cols = [c for c in census.columns if c.startswith(prefix)]
        held = melt(by_sex, cols, "race", measure, prefix)
        held = held.withColumn("race", remove_first("race", "_occupied"))
        held = held.select(*keys, measure).dropna("any")
        parts.append(consolidate(held, "race", ["mult_race"], "other", others, measure))
    joined = expand_years(outer_join_all(parts, keys), "datayear", spans, "join_year")
    sex = classify([(name, F.col("sex") == v) for v, name in SEX_LABELS.items()], F.col("sex"))
    label = classify([(name, F.col("race") == v) for v, name in RACE_LABELS.items()], "Other")
    return joined.withColumns({"sex": sex, "race": label}).select(
        "zcta", "join_year", "race", "sex", "geogyear", F.col("known").alias("datayear"),
        "total_pop", *UNITS, "pop_sex", "pop_race", "pop_own_race", "pop_rent_race",
    )


def load_survey(versions: Sequence[SourceVersion], boundaries: DataFrame) -> DataFrame:
    """Survey counts of all years for the tracts that have a boundary.

    ``boundaries``: geoid10, rings. The tract id is the last eleven characters of ``GEO_ID``.
    """
    counts = load_versions(versions, SURVEY_SCHEMA, "acs_year")
    counts = counts.withColumn("geoid10", F.right("GEO_ID", F.lit(11))).drop("GEO_ID").distinct()
    return null_safe_join(
        counts, boundaries.select("geoid10", "rings").distinct(), "geoid10", "inner"
    )


def survey_with_areas(
    survey: DataFrame,
    tracts: DataFrame,
    neighborhoods: DataFrame,
    zips: DataFrame,
    community_areas: DataFrame,
    cell: float | None = None,
) -> DataFrame:
    """Counts with the neighborhood, zip and community area each tract shares most area with.

    Overlaps are worked out once per tract, not once per year. ``tracts``: geoid10, rings.
    ``neighborhoods``: pri_neigh, sec_neigh; ``zips``: zip; ``community_areas``: area_numbe,
    community; all with rings.
    """
    layers = {
        "pri_neigh": (neighborhoods, ["sec_neigh"]),
        "zip": (zips, []),
        "area_numbe": (community_areas, ["community"]),
    }
    placed = assign_areas(tracts.select("geoid10", "rings"), "geoid10", layers, cell=cell)
    placed = placed.drop("rings").withColumnsRenamed(
        {"area_numbe": "community_area_id", "community": "community_area"}
    )
    wide = null_safe_join(survey.drop("rings"), placed, "geoid10", "left")
    incomes = [c for c in wide.columns if c.startswith("Median_Income_")]
    return map_columns(wide, incomes, lambda c: sentinel_to_missing(c, NO_INCOME))


def survey_long(wide: DataFrame, copied: tuple[int, int] = (2019, 2020)) -> DataFrame:
    """One row per tract, year, race and sex; the last year also stands for the next.

    Income and population of a race are taken from the row together, so nothing is joined.
    """
    long = melt_groups(
        wide,
        "race",
        {
            "median_income_race": {r: f"Median_Income_{r}" for r in SURVEY_RACES},
            "population_race": {r: f"Population_{r}" for r in SURVEY_RACES},
        },
    )
    long = melt_groups(
        long, "sex", {"population_sex": {s: f"Population_{s}" for s in SURVEY_SEXES}}
    )
    long = long.drop(*[f"Median_Income_{r}" for r in SURVEY_RACES])
    return copy_year(long, "acs_year", *copied)


def tract_neighborhood(
    tracts: DataFrame, neighborhoods: DataFrame, cell: float | None = None
) -> DataFrame:
    """Neighborhood that each tract shares most area with, and that area."""
    return largest_overlap(tracts, neighborhoods, "geoid10", "pri_neigh", cell=cell)
