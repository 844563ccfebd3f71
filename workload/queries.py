"""One query per operator and per end-to-end table, over whole input tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicframe.functions import dates, geometry, missing, text
from civicframe.operators import (
    checks,
    columns,
    geocoding,
    groups,
    joins,
    reshape,
    spatial,
)
from civicframe.plans import (
    budgets,
    cases,
    crimes,
    demographics,
    geofields,
    locating,
    opioid,
    profile,
)
from civicframe.sources import readers, writers
from civicframe.sources.readers import RESPONSE_TYPE, response_rows
from civicframe.sources.versions import SourceVersion

from .inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

AREA_CELL, ZIP_CELL, TRACT_CELL, PAIR_CELL = 0.01, 0.0125, 0.0045, 0.05
C = F.col


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Inputs(spark, folder))

    QUERIES[fn.__name__] = run
    return fn


def _double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# Crimes


@query
def crimes_monthly(i: Inputs) -> DataFrame:
    out = crimes.monthly_counts(
        i.view("crimes"), i.view("crime_categories"), None, i.view("community_names")
    )
    return out.withColumn("month", C("month").cast("date"))


@query
def crimes_monthly_by_area(i: Inputs) -> DataFrame:
    out = crimes.monthly_counts(
        i.view("crimes"),
        i.view("crime_categories"),
        i.polygons("zips"),
        i.view("community_names"),
        ZIP_CELL,
    )
    return out.withColumn("month", C("month").cast("date"))


@query
def epoch_roundtrip(i: Inputs) -> DataFrame:
    months = i.view("crimes").select(dates.month_floor("date").alias("month")).distinct()
    seconds = months.select(dates.epoch_seconds("month").alias("seconds"))
    return seconds.withColumn("month", dates.from_epoch_seconds("seconds").cast("date"))


# Budgets


def _money_lines(i: Inputs) -> DataFrame:
    return i.view("budget_lines").withColumn("amount", missing.money("amount"))


@query
def budget_sum_present(i: Inputs) -> DataFrame:
    keys = ["year", "funds", "general_fund_type", "department"]
    out = groups.aggregate_by(_money_lines(i), keys, amount=missing.sum_present("amount"))
    return _double(out, "amount")


@query
def budget_sum_strict(i: Inputs) -> DataFrame:
    keys = ["year", "funds", "general_fund_type", "department"]
    out = groups.aggregate_by(_money_lines(i), keys, amount=missing.sum_strict("amount"))
    return _double(out, "amount")


@query
def budget_year_total(i: Inputs) -> DataFrame:
    sums = groups.aggregate_by(
        _money_lines(i), ["year", "funds"], amount=missing.sum_present("amount")
    )
    out = groups.group_total(sums, ["year"], year_total=missing.sum_present("amount"))
    return _double(out, "amount", "year_total")


@query
def budget_grand_total(i: Inputs) -> DataFrame:
    sums = groups.aggregate_by(
        _money_lines(i), ["year", "funds"], amount=missing.sum_present("amount")
    )
    return _double(groups.grand_total(sums, total=F.sum("amount")), "amount", "total")


def _city_versions(i: Inputs) -> list[SourceVersion]:
    names = {1995: "amount", 1997: "appropriation_ordinance"}

    def load(year: int, amount: str) -> Callable[[], DataFrame]:
        return lambda: i.view("budget_lines").filter(C("year") == year).select(
            C("funds").alias("fund_type"),
            C("general_fund_type").alias("fund_description"),
            C("department").alias("department_description"),
            C("amount").alias(amount),
        )

    versions = []
    for year in range(1995, 2002):
        amount = names.get(year, "X_ordinance_amount_")
        versions.append(SourceVersion(year, load(year, amount), {amount: "amount"}))
    return versions


def _departments(i: Inputs) -> DataFrame:
    kinds = ["Sheriff ", "Security ", "Lead Poisoning ", "Medical Examiner ", "County Hospital "]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), C("n_nationkey") % 6)
    named = i.table("nation").select(F.concat(kind, "n_name").alias("name")).filter("name IS NOT NULL")
    return named.select(
        C("name").alias("department_description"),
        F.upper("name").alias("department_clean_orig"),
        F.lower("name").alias("department_clean_current"),
        F.when(C("name").contains("Sheriff"), "Public Safety").otherwise("Other").alias("category"),
    )


@query
def budget_versions_union(i: Inputs) -> DataFrame:
    return budgets.city_budget(_city_versions(i), _departments(i))


def _county_inputs(i: Inputs):
    lines = i.view("budget_lines")
    by_function = lines.filter("year >= 1999").select(
        "funds", "function_area", "department", C("year").cast("string").alias("year"), "amount"
    )

    def tab(year: int) -> DataFrame:
        return lines.filter(C("year") == year).select(
            "fund",
            "tab",
            C("funds").alias("fund_type"),
            C("department").alias("department_name"),
            "general_fund_type",
            "amount",
            C("clean_amount").alias("expenditures"),
        )

    def summary(year: int) -> DataFrame:
        return lines.filter(C("year") == year).select(
            C("general_fund_type").alias("genfundtype"),
            C("tab").alias("sort_for_summary"),
            F.concat(C("department"), F.lit(" ")).alias("depttitle"),
            C("funds").alias("fundtype"),
            C("clean_amount").alias("amount"),
        )

    # Lines of a third status stand in a column whose label has no year.
    year = F.when(C("status") == "P", "prior").otherwise(C("year").cast("string"))
    typed = F.when(C("status") == "O", "appropriations").otherwise("expenditures")
    cells = lines.withColumns({"type_year": F.concat_ws("_", typed, year), "fund": C("funds")})
    labels = [f"{t}_{y}" for t in ("expenditures", "appropriations") for y in (*range(1995, 2002), "prior")]
    wide = reshape.side_by_side(
        cells,
        ["fund", "department"],
        "type_year",
        labels,
        F.sum(C("clean_amount").cast("long")).cast("string"),
    )
    return by_function, {2015: tab(1998), 2014: tab(1997)}, {2012: summary(1995), 2013: summary(1996)}, wide


def _category(c) -> F.Column:
    return (
        F.when(c.contains("Hospital"), "Public Health")
        .when(c.contains("Sheriff"), "Public Safety")
        .otherwise("Other")
    )


@query
def budget_category_mapping(i: Inputs) -> DataFrame:
    by_function, by_tab, by_summary, wide = _county_inputs(i)
    lines = i.view("budget_lines").filter(~C("department").contains("Finance"))
    category = _category(C("department")).alias("category")
    tab_category = F.when(C("tab").isNull(), "Other").otherwise("Public Safety").alias("category")
    maps = {
        "function": lines.select("funds", "function_area", "department", category).distinct(),
        "wide": lines.select(C("funds").alias("fund"), "department", category).distinct(),
    }
    for year in by_tab:
        key = F.trim("fund") if year in budgets.PADDED_YEARS else C("fund")
        maps[year] = lines.select(key.alias("fund"), "tab", tab_category).distinct()
    for year in by_summary:
        maps[year] = lines.select(
            C("general_fund_type").alias("genfundtype"),
            C("tab").alias("sort_for_summary"),
            (C("department") if year in budgets.PADDED_YEARS else F.concat("department", F.lit(" "))).alias("depttitle"),
            category,
        ).distinct()
    return budgets.county_budget_mapped(by_function, by_tab, by_summary, wide, maps)


@query
def budget_category_rules(i: Inputs) -> DataFrame:
    return budgets.county_budget_by_rules(*_county_inputs(i))


@query
def budget_expenditures(i: Inputs) -> DataFrame:
    _, by_tab, _, wide = _county_inputs(i)
    typed = i.view("budget_lines").select(
        C("funds").alias("fund_type"), "department", C("clean_amount").alias("amount")
    )
    return columns.union_all(
        budgets.tab_expenditures(by_tab[2015], 2015),
        budgets.tab_expenditures(by_tab[2014], 2014),
        budgets.wide_expenditures(wide),
        budgets.typed_budget(typed, 2020),
    )


@query
def budget_melt_separate(i: Inputs) -> DataFrame:
    return budgets.wide_to_lines(_county_inputs(i)[3])


# Cases


def _reports(i: Inputs) -> DataFrame:
    """Case view in the layout of a consolidated report extract."""
    return i.view("cases").select(
        "case_no", "name", "manner", "age", C("date_text").alias("date_of_death"), "sex", "race",
        "latino", "primary_cause_a", "primary_cause_b", "primary_cause_c", "secondary_cause",
        "incident_address", "incident_city",
    )


def _gunshot(i: Inputs) -> DataFrame:
    return cases.gunshot_cases(cases.combine_reports(_reports(i)))


@query
def cases_gunshot(i: Inputs) -> DataFrame:
    return _gunshot(i)


@query
def cases_title(i: Inputs) -> DataFrame:
    source = i.view("cases")
    return source.select(
        "case_no", *[text.title_case(c).alias(c) for c in ("name", "primary_cause_a", "incident_address")]
    )


def _address_map(i: Inputs) -> tuple[DataFrame, DataFrame]:
    places = i.view("gazetteer")
    mapped = places.select(
        C("place_id").alias("id"),
        F.replace("short_address", F.lit(" "), F.lit(", ")).alias("raw"),
        C("formatted").alias("address"),
        F.lit("CHICAGO").alias("city"),
        F.when(~C("formatted").contains("RED"), 60600 + C("place_id")).alias("zip"),
    )
    return mapped, places.select(C("place_id").alias("id"), "lat", "lon")


@query
def named_locations(i: Inputs) -> DataFrame:
    mapped, geocoded = _address_map(i)
    return cases.named_locations(mapped, geocoded, _gunshot(i))


@query
def cases_address_key_join(i: Inputs) -> DataFrame:
    joined = joins.join_on_address(
        i.view("cases").select("case_no", "incident_address"),
        i.view("gazetteer").select("place_id", "short_address"),
        "incident_address",
        "short_address",
        "left",
    )
    return joined.select("case_no", "join_field", "place_id")


@query
def cases_overrides(i: Inputs) -> DataFrame:
    source = i.view("cases").select("case_no", "incident_city")
    fixes = i.view("manual_places").select("case_no", F.lit("EVANSTON").alias("value"))
    return joins.apply_overrides(source, fixes, "case_no", "incident_city")


@query
def manual_locations(i: Inputs) -> DataFrame:
    source = i.view("cases")
    manual = source.select(
        C("case_id").alias("entry"),
        F.replace("incident_address", F.lit("#"), F.lit(" - ")).alias("raw"),
        C("incident_address").alias("street"),
        C("incident_city").alias("city"),
        F.lit("IL").alias("state"),
        (C("age") + 60600).alias("zip"),
        "lat",
        "lon",
    )
    full = F.concat_ws(
        ", ",
        *[F.coalesce(C(c).cast("string"), F.lit("NA")) for c in ("street", "city", "state", "zip")],
    )
    moved = manual.filter("street = 'SCENE'")
    keys = moved.select(full.alias("full_address"), F.lit("UNK LOCATION").alias("value")).distinct()
    numbers = (
        manual.filter("street = 'CORNER OF MAIN'")
        .groupBy(full.alias("full_address"))
        .agg(F.concat(F.lit("ME-"), F.min("entry").cast("string")).alias("value"))
    )
    return cases.manual_locations(
        manual, source.select("case_no", "incident_address"), keys, numbers, ["entry"]
    )


def _locations(i: Inputs) -> DataFrame:
    return cases.consolidated_locations(
        i.view("named_places"), [i.view("manual_places")], i.view("api_places")
    )


@query
def cases_prefer_sources(i: Inputs) -> DataFrame:
    return _locations(i)


def _located(i: Inputs) -> DataFrame:
    return cases.attach_locations(_gunshot(i), _locations(i))


@query
def cases_located(i: Inputs) -> DataFrame:
    return _located(i).select("case_no", "incident_address", "lat", "lon")


@query
def cases_worklist(i: Inputs) -> DataFrame:
    source = i.view("cases").withColumn("incident_address", F.upper("incident_address"))
    return cases.location_worklist(source, "1998-01-01").select(
        "case_no", "incident_address", "date_of_death"
    )


@query
def cases_labelled(i: Inputs) -> DataFrame:
    located = _located(i).withColumns(
        {"city": F.lit(None).cast("string"), "full_address": C("incident_address")}
    )
    areas = i.polygons("areas")
    return cases.labelled_cases(
        located,
        i.polygons("tracts").withColumnRenamed("geoid10", "block_group"),
        areas.withColumnsRenamed({"area_id": "comarea_id", "community": "community_area"}),
        i.polygons("zips").select(
            C("zip").alias("pri_neighborhood"), F.concat(F.lit("near "), "zip").alias("sec_neighborhood"), "rings"
        ),
        (TRACT_CELL, AREA_CELL, ZIP_CELL),
    )


@query
def cases_keep_first(i: Inputs) -> DataFrame:
    source = i.view("cases").select("incident_address", "case_id", "case_no")
    return groups.keep_first(source, ["incident_address"], ["case_id"])


@query
def cases_later_rows(i: Inputs) -> DataFrame:
    source = i.view("cases").select("incident_address", "case_id")
    return groups.later_rows(source, ["incident_address"], ["case_id"])


@query
def cases_repeated_rows(i: Inputs) -> DataFrame:
    source = i.view("cases").select("incident_address", "case_id")
    return groups.repeated_rows(source, ["incident_address"])


@query
def cases_duplicates(i: Inputs) -> DataFrame:
    return checks.duplicate_rows(i.view("cases").select("race", "latino", "age", "incident_city"))


@query
def largest_per_key(i: Inputs) -> DataFrame:
    source = i.view("cases").select("incident_address", "measure", "case_id")
    return groups.largest_per_key(source, ["incident_address"], "measure", ["case_id"])


@query
def candidates_top_k(i: Inputs) -> DataFrame:
    source = i.view("cases").select("incident_address", "case_id", "measure")
    return groups.top_k_per_key(source, ["incident_address"], [F.desc("measure"), "case_id"], 3)


@query
def natural_and_null_join(i: Inputs) -> DataFrame:
    left = i.view("cases").select("case_id", "race", "latino")
    right = (
        i.view("cases").groupBy("race", "latino").agg(F.count(F.lit(1)).alias("n"))
    )
    return joins.natural_join(left, right, "left")


@query
def outer_join_chain(i: Inputs) -> DataFrame:
    parts = [
        groups.aggregate_by(i.view(v), ["case_no"], **{n: F.count(F.lit(1))})
        for v, n in (("named_places", "named"), ("manual_places", "manual"), ("api_places", "api"))
    ]
    census = i.view("case_zips").select(C("zip").alias("case_no")).distinct()
    return joins.outer_join_all([*parts, census.withColumn("zips", F.lit(1))], ["case_no"])


@query
def join_suffixes(i: Inputs) -> DataFrame:
    mapped, _ = _address_map(i)
    places = i.view("gazetteer").select(
        C("place_id").alias("id"), C("formatted").alias("address"), F.lit("Chicago").alias("city")
    )
    return joins.null_safe_join(mapped, places, "id", "left")


@query
def join_on_id(i: Inputs) -> DataFrame:
    left = i.view("cases").select("case_no", "lat", "lon")
    right = i.view("manual_places").select("case_no", C("lat").alias("manual_lat"))
    return joins.null_safe_join(left, right, "case_no", "inner")


@query
def anti_null_safe(i: Inputs) -> DataFrame:
    source = i.view("cases").select("case_no", "race")
    return joins.anti_join(source, i.view("named_places"), "case_no")


@query
def semi_null_safe(i: Inputs) -> DataFrame:
    own = C("manner") == "Suicide"
    right = i.view("cases").select(*[F.when(own, C(c)).alias(c) for c in ("incident_city", "latino")])
    source = i.view("cases").select("case_no", "incident_city", "latino")
    return joins.semi_join(source, right, ["incident_city", "latino"])


@query
def union_distinct(i: Inputs) -> DataFrame:
    a = i.view("cases").select("race", "sex", "incident_city")
    b = i.view("cases").select("incident_city", "sex", F.when(C("latino") == "YES", "other").otherwise(C("race")).alias("race"))
    return columns.union_distinct(a, b)


@query
def union_all(i: Inputs) -> DataFrame:
    a = i.view("named_places")
    b = i.view("manual_places").drop("lon")
    return columns.union_all(a, b)


@query
def cases_projected(i: Inputs) -> DataFrame:
    source = i.view("cases")
    kept = columns.pick(source, {"CASE": "case_no", "LAT": "lat", "LON": "lon", "v_a": "age", "SEX": "sex", "RACE": "race"})
    kept = kept.withColumns({"state": F.lit("IL"), "zip": F.lit(None).cast("string"), "LATITUDE": C("LAT")})
    kept = columns.map_columns(kept, ["SEX", "RACE"], F.upper)
    return columns.all_text(columns.drop_by_prefix(kept, "v_").drop("LON", "LAT", "LATITUDE"))


@query
def conform_schema(i: Inputs) -> DataFrame:
    schema = T.StructType.fromDDL("year int, fund string, genfundtype string, amount double, note string")
    lines = columns.lenient_columns(i.view("budget_lines"), {"amount": "double"})
    return columns.conform(lines, schema)


@query
def cases_predicates(i: Inputs) -> DataFrame:
    source = i.view("cases")
    address = F.upper("incident_address")
    return source.select(
        "case_no",
        missing.contains_any(["primary_cause_a", "primary_cause_b"], "unshot").alias("any_word"),
        missing.matches("incident_address", "^[0-9]+ [SN]").alias("numbered"),
        missing.is_in("race", ["White", "Black"]).alias("in_list"),
        missing.if_else(C("latino") == "YES", "y", "n").alias("latino_flag"),
        cases.looks_locatable(address, C("date_of_death"), "1998-01-01").alias("locatable"),
        geocoding.usable_address(C("case_no"), address).alias("usable"),
        missing.first_nonempty(F.when(C("sex") == "Male", "").otherwise(C("race")), C("latino")).alias("filled"),
        missing.lenient(F.substring("case_no", 3, 4), "int").alias("case_year"),
        missing.paste(["race", "latino", "age"], "/").alias("pasted"),
        missing.recode("race", {"Am. Indian": "Native American"}, ["Black", "White"], "Other").alias("race"),
    )


@query
def split_three_ways(i: Inputs) -> DataFrame:
    parts = columns.split_on(
        i.view("cases").select("case_id", "latino"), C("latino") == "YES"
    )
    named = zip(parts, ("yes", "no", "unknown"), strict=True)
    return columns.union_all(*[p.withColumn("part", F.lit(n)) for p, n in named])


@query
def opioid_cases(i: Inputs) -> DataFrame:
    flags = {c: F.lit("x") for c in opioid.DROPPED}
    archive = i.view("cases").select(
        F.when(C("case_id") % 19 == 0, "").otherwise(C("case_no")).alias("case_number"),
        "race",
        (C("latino") == "YES").alias("latino"),
        C("lat").alias("latitude"),
        C("lon").alias("longitude"),
    )
    areas = i.polygons("areas").withColumnRenamed("area_id", "area_numbe")
    return opioid.opioid_cases(archive.withColumns(flags), areas, AREA_CELL)


# Areas


@query
def point_in_area(i: Inputs) -> DataFrame:
    points = i.view("cases").select("case_no", "lat", "lon")
    return spatial.point_in_polygon_join(
        points, i.polygons("areas"), ["area_id", "community"], cell=AREA_CELL
    )


@query
def enrich_areas(i: Inputs) -> DataFrame:
    points = i.view("crimes").select("id", C("latitude").alias("lat"), C("longitude").alias("lon"))
    placed = spatial.enrich_areas(
        points,
        {
            "areas": (i.polygons("areas"), ["area_id"], AREA_CELL),
            "zips": (i.polygons("zips"), ["zip"], ZIP_CELL),
        },
    )
    return placed.groupBy("area_id", "zip").agg(F.count(F.lit(1)).alias("n"))


@query
def polygon_overlap(i: Inputs) -> DataFrame:
    pairs = spatial.polygon_overlap_join(
        i.polygons("zips"), i.polygons("areas"), "zip", "area_id", ["community"], cell=PAIR_CELL
    )
    return pairs.select("zip", "area_id", "community", F.round("overlap", 8).alias("overlap"))


@query
def overlap_with_one(i: Inputs) -> DataFrame:
    one = i.polygons("areas").filter("community = 'AREA NATION_7'")
    pairs = spatial.polygon_overlap_join(
        i.polygons("tracts"), one, "geoid10", "area_id", how="inner", cell=PAIR_CELL
    )
    return pairs.select("geoid10", "area_id", F.round("overlap", 8).alias("overlap"))


@query
def largest_overlap(i: Inputs) -> DataFrame:
    best = demographics.tract_neighborhood(
        i.polygons("tracts"), i.polygons("areas").withColumnRenamed("area_id", "pri_neigh"), PAIR_CELL
    )
    return best.withColumn("overlap", F.round("overlap", 8))


@query
def area_centroid(i: Inputs) -> DataFrame:
    centre = geometry.centroid("rings")
    return i.polygons("tracts").select(
        "geoid10",
        F.round(geometry.polygon_area("rings"), 8).alias("area"),
        F.round(centre.x, 7).alias("x"),
        F.round(centre.y, 7).alias("y"),
    )


@query
def web_mercator(i: Inputs) -> DataFrame:
    there = geometry.to_web_mercator("lon", "lat")
    moved = i.view("cases").select("case_no", there.alias("m"))
    back = geometry.to_lonlat(C("m.x"), C("m.y"))
    return moved.select(
        "case_no",
        F.round("m.x", 3).alias("x"),
        F.round("m.y", 3).alias("y"),
        F.round(back.x, 6).alias("lon"),
        F.round(back.y, 6).alias("lat"),
    )


@query
def blockgroup_fields(i: Inputs) -> DataFrame:
    out = geofields.blockgroup_fields(
        i.polygons("tracts").withColumnRenamed("geoid10", "block_group"),
        i.polygons("areas").withColumnRenamed("community", "neighborhood"),
        i.polygons("zips"),
        PAIR_CELL,
    )
    return out.withColumns({c: F.round(c, 7) for c in ("latitude", "longitude")})


# Census and survey


@query
def census_long(i: Inputs) -> DataFrame:
    return demographics.census_long(i.view("census"), i.view("case_zips"))


@query
def census_expand(i: Inputs) -> DataFrame:
    source = i.view("census").select("zcta", "datayear", "total_pop")
    return reshape.expand_years(source, "datayear", demographics.CENSUS_SPANS, "join_year")


@query
def census_melt(i: Inputs) -> DataFrame:
    source = i.view("census")
    races = [c for c in source.columns if c.startswith("pop_race_")]
    kept = source.select("zcta", "datayear", *races)
    return reshape.melt(kept, races, "race", "pop_race", "pop_race_")


@query
def census_other(i: Inputs) -> DataFrame:
    source = i.view("census")
    races = [c for c in source.columns if c.startswith("pop_race_")]
    long = reshape.melt(
        source.select("zcta", "datayear", *races), races, "race", "pop_race", "pop_race_"
    )
    return groups.consolidate(
        long, "race", ["mult", "pacific_island"], "other", ["zcta", "datayear"], "pop_race"
    )


def _survey_versions(i: Inputs) -> list[SourceVersion]:
    """Survey view split by year, its columns under the survey's own codes."""
    codes = {name.lower(): code for code, name in demographics.SURVEY_NAMES.items()}

    def load(year: int) -> Callable[[], DataFrame]:
        def read() -> DataFrame:
            one = i.view("survey").filter(C("acs_year") == year).drop("acs_year")
            return one.withColumnsRenamed({n: codes.get(n, "GEO_ID") for n in one.columns})

        return read

    return [SourceVersion(y, load(y), demographics.SURVEY_NAMES) for y in (2018, 2019)]


def _survey(i: Inputs) -> DataFrame:
    return demographics.load_survey(_survey_versions(i), i.polygons("tracts"))


@query
def survey_loaded(i: Inputs) -> DataFrame:
    return _survey(i).select(
        "geoid10", "acs_year", "Total_Population", "Population_Asian", "Median_Income_White",
        F.size(F.flatten("rings")).alias("vertices"),
    )


def _survey_wide(i: Inputs) -> DataFrame:
    areas = i.polygons("areas")
    return demographics.survey_with_areas(
        _survey(i),
        i.polygons("tracts"),
        areas.select(C("community").alias("pri_neigh"), C("area_id").alias("sec_neigh"), "rings"),
        i.polygons("zips"),
        areas.withColumnRenamed("area_id", "area_numbe"),
        PAIR_CELL,
    )


@query
def survey_areas(i: Inputs) -> DataFrame:
    return _survey_wide(i).select(
        "geoid10", "acs_year", "pri_neigh", "sec_neigh", "zip", "community_area_id",
        "community_area", "Median_Income_White", "Median_Income_Black",
    )


@query
def survey_long(i: Inputs) -> DataFrame:
    return demographics.survey_long(_survey_wide(i)).select(
        "geoid10", "acs_year", "zip", "race", "sex", "median_income_race", "population_race",
        "population_sex",
    )


# Geocoding


@query
def prepared_addresses(i: Inputs) -> DataFrame:
    source = i.view("cases").withColumn("incident_address", F.upper("incident_address"))
    return geocoding.prepare_addresses(source, from_row=2)


@query
def geocode_join(i: Inputs) -> DataFrame:
    out = geocoding.geocode_join(
        i.view("cases").select("case_no", "incident_address"),
        i.view("gazetteer").select("place_id", "short_address", "lat", "lon"),
        "incident_address",
        "short_address",
        3,
        locating.NARROW_BOX,
        locating.NEAR,
    )
    return out.select("case_no", "place_id", "rank")


def _misspelled(i: Inputs) -> DataFrame:
    """Addresses as someone might have typed them: a letter left out, two swapped, one too many, or none."""
    a, n = C("incident_address"), C("case_id") % 5
    typed = (
        F.when(n == 0, F.replace(a, F.lit("Street"), F.lit("Stret")))
        .when(n == 1, F.replace(a, F.lit("Street"), F.lit("Steret")))
        .when(n == 2, F.replace(a, F.lit("Street#"), F.lit("Streett ")))
        .otherwise(a)
    )
    return i.view("cases").select("case_no", typed.alias("typed_address"))


@query
def geocode_fuzzy(i: Inputs) -> DataFrame:
    out = geocoding.fuzzy_geocode_join(
        _misspelled(i),
        i.view("gazetteer").select("place_id", "short_address", "lat", "lon"),
        "typed_address",
        "short_address",
        k=2,
        edits=2,
        share=70,
        box=locating.NARROW_BOX,
        near=locating.NEAR,
    )
    return out.select("case_no", "place_id", "rank", "edits")


@query
def house_number(i: Inputs) -> DataFrame:
    matched = joins.join_on_address(
        i.view("cases").select("case_no", "incident_address"),
        i.view("gazetteer").select("place_id", "short_address", "formatted"),
        "incident_address",
        "short_address",
        "left",
    )
    shifted = F.coalesce(C("formatted"), F.concat(F.lit("RURAL ROUTE "), C("case_no")))
    return matched.select(
        "case_no",
        "place_id",
        geocoding.house_number_agrees("incident_address", shifted).alias("agrees"),
        geocoding.house_number_agrees("incident_address", shifted, True).alias("agrees_strict"),
    )


def _upper_cases(i: Inputs) -> DataFrame:
    return i.view("cases").withColumn("incident_address", F.upper("incident_address"))


def _book(i: Inputs, col: str) -> DataFrame:
    return i.view("gazetteer").select(
        "place_id", "formatted", "lat", "lon", F.upper(col).alias("address")
    )


def _first_book(i: Inputs) -> DataFrame:
    # What this provider does not know has no address, and so no key.
    known = F.when(C("formatted").contains("Cook County"), C("address"))
    return _book(i, "city_address").withColumn("address", known)


def _rounds(i: Inputs) -> DataFrame:
    rounds = locating.standard_rounds(
        _first_book(i), _book(i, "long_address"), _book(i, "city_address")
    )
    return locating.locate_addresses(_upper_cases(i), rounds)


def _cleaned(i: Inputs) -> DataFrame:
    # Rows that nobody has looked at have neither a cleaned address nor a place.
    seen = F.expr("incident_city = 'OAK PARK' OR primary_cause_c IS NOT NULL")
    by_hand = seen & (C("manner") == "Suicide")
    plain = F.replace(F.replace("incident_address", F.lit("."), F.lit("")), F.lit("#"), F.lit(" "))
    cleaned = F.upper(plain)
    worklist = i.view("cases").select(
        "case_no",
        "case_id",
        C("incident_address").alias("full_address_new"),
        F.when(seen, F.when(C("latino") == "YES", "").otherwise(cleaned)).alias("cleaned_address"),
        F.when(by_hand, C("lat")).alias("lat"),
        F.when(by_hand, C("lon")).alias("lon"),
        F.when(by_hand, F.concat(C("name"), F.lit(", Oak Park, IL 60301, USA"))).alias("formatted"),
    )
    return locating.cleaned_locations(worklist, _book(i, "short_address"), ["case_id"])


@query
def cleaned_locations(i: Inputs) -> DataFrame:
    return _cleaned(i)


@query
def confirmed_locations(i: Inputs) -> DataFrame:
    rounds = locating.standard_rounds(_first_book(i), _book(i, "long_address"))
    fallback = geocoding.Round("fallback", C("full_address"), _book(i, "city_address"), "address")
    return locating.confirmed_locations(_upper_cases(i), rounds, _cleaned(i), fallback)


@query
def geocode_rounds(i: Inputs) -> DataFrame:
    return geocoding.accepted_locations(_rounds(i))


@query
def geocode_unplaced(i: Inputs) -> DataFrame:
    return geocoding.unplaced(_rounds(i))


def _rejected(i: Inputs) -> DataFrame:
    """Keys whose answers a look by hand has refused."""
    return i.view("cases").filter("case_id % 6 = 1").select("case_no")


@query
def geocode_to_check(i: Inputs) -> DataFrame:
    return geocoding.settle(_rounds(i), _rejected(i))[1]


@query
def geocode_settled(i: Inputs) -> DataFrame:
    return geocoding.accepted_locations(geocoding.settle(_rounds(i), _rejected(i))[0])


@query
def parse_zip_city(i: Inputs) -> DataFrame:
    return i.view("gazetteer").select(
        "place_id", text.parse_zip("formatted").alias("zip"), text.parse_city("formatted").alias("city")
    )


@query
def text_replace(i: Inputs) -> DataFrame:
    return i.view("gazetteer").select(
        "place_id",
        text.expand_directions("short_address").alias("expanded"),
        text.remove_first("formatted", " STREET").alias("shorter"),
        F.regexp_replace("formatted", "[AEIOU]", "_").alias("masked"),
        text.trim_right_to_letter("short_address").alias("trimmed"),
        text.address_key("formatted").alias("key"),
        text.extract_first("formatted", "[0-9]+").alias("number"),
    )


def _flat(i: Inputs) -> DataFrame:
    # Exploding keeps filters on the fields from being moved below the parser and repeating it.
    parsed = i.view("responses").select(
        "hash_key", F.explode(F.array(F.from_json("response", RESPONSE_TYPE))).alias("response")
    )
    return locating.flat_responses(response_rows(parsed, "hash_key", C("response")))


@query
def candidates_flat(i: Inputs) -> DataFrame:
    return _flat(i)


@query
def candidates_choose(i: Inputs) -> DataFrame:
    return locating.chosen_locations(_flat(i))[0]


@query
def candidates_manual(i: Inputs) -> DataFrame:
    return locating.chosen_locations(_flat(i))[1].select("HASH_KEY", "RAW", "STREET_FIN", "LAT_FIN")


@query
def address_requests(i: Inputs) -> DataFrame:
    source = i.view("cases").select(
        C("incident_address").alias("address"), F.lit("Cook").alias("county"),
        F.lit("IL").alias("state"), C("incident_city").alias("city"),
    )
    out = locating.address_requests(
        source.distinct(), "?street={street}&county={county}&state={state}&city={city}&maxResults=3"
    )
    return out.select("hash_key", "request")


@query
def location_fields_merged(i: Inputs) -> DataFrame:
    source = i.view("cases").select(
        "incident_address",
        "case_no",
        F.lit(None).cast("string").alias("street"),
        C("incident_city").alias("city"),
        F.lit("IL").alias("state"),
        (C("age") + 60600).alias("zip"),
        "lat",
        "lon",
        F.when(C("manner") == "Suicide", "").when(C("sex") == "Male", "HOSPITAL").alias("loc_type"),
        F.when(C("latino") == "YES", "CLOSED").otherwise("UNKNOWN").alias("status"),
    )
    chosen = i.view("gazetteer").select(
        F.replace(F.replace("short_address", F.lit(" S "), F.lit(" S. ")), F.lit("Street "), F.lit("Street#")).alias("raw"),
        C("short_address").alias("street_fin"),
        F.lit("Evanston").alias("city_fin"),
        F.lit("il").alias("state_fin"),
        F.when(~C("formatted").contains("RED"), F.lit("60601-12")).alias("zip_fin"),
        C("lat").alias("lat_fin"),
        C("lon").alias("lon_fin"),
    )
    return locating.merge_location_fields(source, chosen)


@query
def response_maps(i: Inputs) -> DataFrame:
    texts = i.view("responses").select(
        F.concat(F.lit('{"'), "hash_key", F.lit('":'), "response", F.lit("}")).alias("value")
    )
    rows = readers.response_entries(texts, "value")
    return rows.withColumn("candidates", F.size("candidates"))


@query
def headers_repaired(i: Inputs) -> DataFrame:
    source = i.view("cases").select("case_id", "age", "sex", "lat", "lon")
    return columns.repair_names(source.toDF("_id", "Age (years)", "_c2", "lat", "lat"))


@query
def geojson_rings(i: Inputs) -> DataFrame:
    texts = i.polygons("tracts").select("geoid10", F.to_json(writers.geojson_geometry("rings")).alias("shape"))
    shapes = readers.geometry_column(texts, "shape")
    return shapes.select("geoid10", F.round(geometry.polygon_area("rings"), 8).alias("area"), F.size("rings").alias("rings"))


@query
def census_named(i: Inputs) -> DataFrame:
    coded = i.view("census").select("zcta", "datayear", C("total_pop").alias("CL8AA"), C("pop_race_white").alias("CM1AA"))
    return demographics.named_counts(coded)


@query
def location_fields_manual(i: Inputs) -> DataFrame:
    source = i.view("cases").select(
        "incident_address",
        "case_no",
        F.lit("old street").alias("street"),
        C("incident_city").alias("city"),
        F.lit("IL").alias("state"),
        (C("age") + 60600).alias("zip"),
        "lat",
        "lon",
    )
    odd = C("place_id") % 3 == 0
    manual = i.view("gazetteer").select(
        F.replace(F.replace("short_address", F.lit(" S "), F.lit(" S. ")), F.lit("Street "), F.lit("Street#")).alias("raw"),
        F.when(odd, "").otherwise(C("short_address")).alias("street_fin"),
        F.when(C("place_id") % 2 == 0, "Evanston").alias("city_fin"),
        F.lit("").alias("state_fin"),
        F.when(odd, "").otherwise(F.lit("60601")).alias("zip_fin"),
        F.when(odd, "").otherwise(C("lat").cast("string")).alias("lat_fin"),
        F.when(~odd, C("lon").cast("string")).alias("lon_fin"),
    )
    return locating.merge_manual_fields(source, manual)


# Profiles, positions, checks


@query
def freq_sorted(i: Inputs) -> DataFrame:
    return profile.address_frequency(i.view("cases"))


@query
def city_frequency(i: Inputs) -> DataFrame:
    return profile.city_frequency(i.view("cases"), "CHICAGO")


@query
def numbered_addresses(i: Inputs) -> DataFrame:
    return profile.numbered_addresses(i.view("cases"))


@query
def histogram(i: Inputs) -> DataFrame:
    out = profile.deaths_over_time(i.view("cases"))
    return out.withColumn("bin_start", F.round("bin_start", 6))


@query
def summary_stats(i: Inputs) -> DataFrame:
    source = i.view("cases").select(F.when(C("race").isNotNull(), C("measure")).alias("measure"))
    out = groups.six_number_summary(source, "measure")
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c != "missing"})


@query
def repeat_count(i: Inputs) -> DataFrame:
    source = i.view("cases").select(
        "case_id", F.when(C("sex") == "Male", C("incident_address")).otherwise("").alias("address")
    )
    return groups.repeat_count(source, "address", "at_location")


@query
def row_slice(i: Inputs) -> DataFrame:
    source = i.view("cases").select("case_no", "date_of_death", "case_id")
    return groups.slice_rows(source, ["date_of_death", "case_id"], 51, 500)


@query
def row_ids(i: Inputs) -> DataFrame:
    source = i.view("cases").select("case_id", "measure")
    return groups.with_row_id(source, ["measure", "case_id"])


@query
def first_per_group(i: Inputs) -> DataFrame:
    source = i.view("cases")
    return groups.first_per_group(source, ["race", "latino", "age"], ["case_no", "lat"], ["case_id"])


@query
def distinct_rows(i: Inputs) -> DataFrame:
    return i.view("cases").select("race", "latino", "incident_address").distinct()


@query
def max_per_group(i: Inputs) -> DataFrame:
    return groups.aggregate_by(
        i.view("cases"), ["race", "latino"], largest=F.max("measure"), rows=F.count(F.lit(1))
    )


@query
def ordered_limited(i: Inputs) -> DataFrame:
    return i.view("cases").select("case_id", "measure").orderBy(F.desc("measure"), "case_id").limit(200)


@query
def checks_report(i: Inputs) -> DataFrame:
    source = i.view("cases")
    placed = spatial.point_in_polygon_join(
        source, i.polygons("areas"), ["area_id"], cell=AREA_CELL
    )
    labelled = source.select(F.lower("incident_city").alias("city"), F.when(C("sex") == "Male", "CHICAGO").alias("expected"))
    return checks.row_counts(
        cases=source,
        outside=checks.without_area(placed, "area_id", "incident_city", "CHICAGO"),
        unmatched=checks.unmatched(placed, "area_id"),
        conflicts=checks.conflicts(labelled, "city", "expected"),
        duplicates=checks.duplicate_rows(source, ["incident_address"]),
    )


@query
def checks_filled(i: Inputs) -> DataFrame:
    source = i.view("cases").withColumn("nothing", F.lit(None).cast("string"))
    filled = checks.filled_counts(source, ["race", "latino", "incident_address", "lat"])
    empty = checks.all_missing(source, ["nothing"]).scalar()
    return filled.withColumn("nothing_empty", empty)


def _checked_lines(i: Inputs) -> tuple[DataFrame, dict]:
    lines = i.view("budget_lines").withColumns(
        {"amount_read": missing.lenient("amount", "double"), "fund_name": F.trim(F.upper("fund"))}
    )
    return lines, checks.check_measures(
        ["function_area", "tab", "general_fund_type", "amount"],
        {
            "health_without_tab": C("department").contains("Hospital") & C("tab").isNull(),
            "fund_differs": C("fund_name") != F.upper("general_fund_type"),
            "above_300000": C("amount_read") > 300000,
        },
        {"amount": ("amount", "amount_read")},
    )


@query
def checks_report(i: Inputs) -> DataFrame:
    return checks.checks_report(*_checked_lines(i))


@query
def dates_mdy(i: Inputs) -> DataFrame:
    """Dates written in several ways; in one of them the day comes first, so some are no dates and some are others."""
    d = C("o_orderdate").cast("timestamp")
    forms = ["M/d/yyyy", "MM-dd-yyyy", "M.d.yy", "MMMM d, yyyy", "MMM dd yyyy", "MMddyyyy", "dd/MM/yyyy"]
    key = (C("o_orderkey") % 8).cast("int")
    text_of = F.coalesce(*(F.when(key == k, F.date_format(d, f)) for k, f in enumerate(forms)))
    rows = i.table("orders").select(key.alias("form"), text_of.alias("text"))
    return rows.groupBy("form", "text", dates.month_day_year("text").alias("day")).agg(F.count(F.lit(1)).alias("n"))
