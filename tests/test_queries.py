"""Every registered query against its SQL text, and the shape of some plans."""

import re

import pytest

import __spark_entry__ as entry_points
from workload.compare import compare, connect
from workload.oracle import ORACLE
from workload.queries import QUERIES

FOLDER = entry_points.SMOKE_DIR
# The queries of the operators for training data have tests of their own.
OWN = QUERIES
# Queries whose joins can take the salted form.
SPREAD = [
    "anti_null_safe",
    "cases_address_key_join",
    "cases_later_rows",
    "cases_located",
    "cases_overrides",
    "cases_prefer_sources",
    "cases_repeated_rows",
    "crimes_monthly_by_area",
    "geocode_fuzzy",
    "geocode_join",
    "geocode_rounds",
    "location_fields_merged",
    "manual_locations",
    "named_locations",
    "natural_and_null_join",
    "point_in_area",
    "polygon_overlap",
    "repeat_count",
    "semi_null_safe",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(OWN) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    assert compare(df, duck, entry_points.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", SPREAD)
def test_query_without_broadcast(spark, duck, no_broadcast, name):
    df = entry_points.queries()[name](spark, FOLDER)
    assert "__salt" in df._jdf.queryExecution().executedPlan().toString()
    assert compare(df, duck, entry_points.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def plan(spark, name):
    df = entry_points.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm(spark):
    for name in ("crimes_monthly_by_area", "polygon_overlap", "cases_labelled", "geocode_rounds"):
        text = plan(spark, name)
        assert not re.search(r"Python|CartesianProduct", text), name


def test_points_are_found_by_an_equi_join(spark):
    text = plan(spark, "point_in_area")
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text


def test_only_needed_columns_are_read(spark):
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan(spark, "crimes_monthly"))
    wide = [s for s in scans if "l_shipdate" in s]
    # All that makes up a crime counts, since crimes are a set; nothing else is read.
    assert wide and not re.search("l_(extendedprice|discount|tax|commitdate|receiptdate|comment)", " ".join(wide))


def test_one_sided_location_fields_are_worked_out_before_the_join(spark, rows):
    from civicframe.plans.locating import merge_location_fields

    own = "incident_address string, case_no string, street string, city string, state string, zip int, lat double, lon double, loc_type string, status string"
    given = "raw string, street_fin string, city_fin string, state_fin string, zip_fin string, lat_fin double, lon_fin double"
    cases = [("a", "1", None, "c", "IL", 1, 1.0, None, "", "UNKNOWN"), ("b", "2", "s", None, "IL", 2, None, 2.0, "HOSPITAL", "UNKNOWN"), (None, "3", None, None, None, None, None, None, None, None)]
    chosen = [("a", "x", None, "il", "60601-12", None, 5.0), ("a", "y", "z", None, "none", 6.0, 7.0)]
    out = merge_location_fields(spark.createDataFrame(cases, own), spark.createDataFrame(chosen, given))
    assert rows(out) == sorted([
        ("a", "1", "X", "c", "IL", 60601, 1.0, 5.0, "SCENE", "N/A"), ("a", "1", "Y", "Z", "IL", 1, 6.0, 7.0, "SCENE", "N/A"),
        ("b", "2", "s", None, "IL", 2, None, 2.0, "HOSPITAL", "OPEN"), (None, "3", None, None, None, None, None, None, "SCENE", "N/A"),
    ], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "upper(" not in above and "upper(" in below
