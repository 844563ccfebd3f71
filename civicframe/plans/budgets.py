"""City and county budgets: yearly datasets of changing layout brought to one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import (
    classify,
    if_else,
    is_in,
    lenient,
    matches,
    matches_any,
    money,
    sum_present,
    sum_strict,
)
from ..functions.text import title_case
from ..operators.columns import conform, pick, schema, union_distinct
from ..operators.groups import aggregate_by, grand_total, group_total
from ..operators.joins import look_up
from ..operators.reshape import melt_rest, separate
from ..sources.versions import SourceVersion, load_versions

CITY_INPUT = schema(
    fund_type="string",
    fund_description="string",
    department_description="string",
    amount="string",
    year="int",
)
COUNTY_SCHEMA = schema(
    fund="string",
    genfundtype="string",
    department="string",
    category="string",
    year="int",
    amount="double",
    year_total="double",
)
EXPENDITURE_SCHEMA = schema(
    fund="string", fund_type="string", year="int", amount="double", year_total="double"
)

# Years whose keys come padded with blanks.
PADDED_YEARS = (2013, 2015)
# Columns of the county time series that are not used.
WIDE_EXTRA = ["short_title", "department_id", "url", "department_description", "control_officer"]

# Names and patterns that decide the spending category.
HEALTH, SAFETY, OTHER = "Public Health", "Public Safety", "Other"
HEALTH_SYSTEM = "COOK COUNTY HEALTH AND HOSPITALS SYSTEM"
SAFETY_FUND = "Public Safety Fund"
SAFETY_TABS = [
    "CHIEF JUDGE",
    "CLERK OF THE CIRCUIT COURT",
    "HOMELAND SECURITY AND EMERGENCY MANAGEMENT",
    "STATE'S ATTORNEY",
    "PUBLIC DEFENDER",
    "SHERIFF",
]
SUMMARY_SAFETY_2012 = ["CHIEF JUDGE", "SHERIFF", "CLERK OF THE CIRCUIT COURT", "STATE'S ATTORNEY"]
SUMMARY_SAFETY_2013 = [
    "CHIEF JUDGE",
    "SHERIFF",
    "CLERK OF THE CIRCUIT COURT",
    "STATE'S ATTORNEY",
    "PUBLIC DEFENDER",
]
TITLE_SAFETY = ["Security", "Law Library", "Medical Examiner", "Judicial Advisory"]
WIDE_HEALTH = ["Lead Poisoning", "TB Sanitarium", "Managed Care"]
WIDE_SAFETY = [
    "Court",
    "State's Attorney",
    "Probation",
    "Security",
    "Sheriff",
    "911",
    "ETSB",
    "Mental Health",
    "Children's Waiting Room",
    "Women's Justice",
    "Law Library",
]
SPENT_HEALTH = ["Lead Poisoning", "TB Sanitarium", "Medical Examiner"]
TYPED_SAFETY = [
    "Chief Judge",
    "Clerk of the Circuit Court",
    "Public Defender",
    "Sheriff",
    "State's Attorney",
]


def city_budget(versions: Sequence[SourceVersion], departments: DataFrame) -> DataFrame:
    """Yearly sums by fund and department with clean names, category and the mapped year's total.

    ``departments``: department_description, department_clean_orig, department_clean_current,
    category. Departments without an entry drop out before the total is taken.
    """
    lines = load_versions(versions, CITY_INPUT)
    keys = ["year", "fund_type", "fund_description", "department_description"]
    sums = aggregate_by(lines, keys, amount=sum_present(money("amount")))
    mapped = look_up(sums, departments, "department_description")
    full = group_total(mapped, ["year"], year_total=F.sum("amount"))
    return full.withColumns({c: F.col(c).cast("double") for c in ("amount", "year_total")}).distinct()


def _county(df: DataFrame) -> DataFrame:
    return conform(df, COUNTY_SCHEMA)


def _by_year(lines: DataFrame) -> DataFrame:
    """Present amounts added up by year, fund, department and category, with the year's total."""
    keys = ["year", "fund", "department", "category"]
    lines = lines.withColumn("year", lenient("year", "int"))
    sums = aggregate_by(lines, keys, amount=sum_present(money("amount")))
    return _county(group_total(sums, ["year"], year_total=F.sum("amount")))


def _one_year(lines: DataFrame, year: int) -> DataFrame:
    """Amounts of one year added up, where a bad amount makes its sum and the total missing."""
    keys = ["fund", "genfundtype", "department", "category"]
    sums = aggregate_by(lines, keys, amount=sum_strict(money("amount")))
    sums = grand_total(sums, year_total=sum_strict("amount"))
    return _county(sums.withColumn("year", F.lit(year)))


def _by_function(lines: DataFrame) -> DataFrame:
    return pick(
        lines,
        {
            "fund": "funds",
            "department": "department",
            "category": "category",
            "year": "year",
            "amount": "amount",
        },
    )


def _by_tab(lines: DataFrame) -> DataFrame:
    named = {
        "fund": "fund_type",
        "genfundtype": "general_fund_type",
        "department": "department_name",
        "category": "category",
        "amount": "amount",
    }
    return pick(lines, named).dropna("any")


def _by_summary(lines: DataFrame) -> DataFrame:
    named = {
        "fund": "fundtype",
        "genfundtype": "genfundtype",
        "department": "depttitle",
        "category": "category",
        "amount": "amount",
    }
    return pick(lines, named).filter("amount IS NOT NULL")


def wide_to_lines(wide: DataFrame) -> DataFrame:
    """``type_year`` columns to rows: fund, department, year, expenditures, appropriations."""
    ids = ["fund", "department"]
    long = melt_rest(wide.drop(*WIDE_EXTRA), ids, "type_year", "amount")
    amount = lenient("amount", "long")
    return separate(long, "type_year", ["type", "year"], "_").select(
        *ids,
        "year",
        if_else(F.col("type") == "expenditures", amount, 0).alias("expenditures"),
        if_else(F.col("type") == "appropriations", amount, 0).alias("appropriations"),
    )


def trimmed(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in cols})


def county_budget_mapped(
    by_function: DataFrame,
    by_tab: Mapping[int, DataFrame],
    by_summary: Mapping[int, DataFrame],
    wide: DataFrame,
    maps: Mapping[object, DataFrame],
    padded: Sequence[int] = PADDED_YEARS,
) -> DataFrame:
    """County appropriations of all years, categories from mapping tables.

    Keys of the ``padded`` years are trimmed before the mapping is looked up; those of other years
    must agree with it as they are.

    ``by_function``: funds, function_area, department, year, amount. ``by_tab`` (per year): fund,
    tab, fund_type, department_name, general_fund_type, amount. ``by_summary`` (per year):
    genfundtype, sort_for_summary, depttitle, fundtype, amount. ``wide``: fund, department and
    ``type_year`` columns. ``maps`` holds the mapping of each: under "function", the year, "wide".
    """
    function_keys = ["funds", "function_area", "department"]
    parts = [_by_year(_by_function(look_up(by_function, maps["function"], function_keys)))]
    for year, df in by_tab.items():
        lines = trimmed(df, "fund") if year in padded else df
        mapped = look_up(lines, maps[year], ["fund", "tab"])
        parts.append(_one_year(_by_tab(mapped), year))
    summary_keys = ["genfundtype", "sort_for_summary", "depttitle"]
    for year, df in by_summary.items():
        lines = trimmed(df, "depttitle") if year in padded else df
        mapped = look_up(lines, maps[year], summary_keys)
        parts.append(_one_year(_by_summary(mapped), year))
    lines = look_up(wide_to_lines(wide), maps["wide"], ["fund", "department"])
    parts.append(_by_year(lines.withColumnRenamed("appropriations", "amount")))
    return union_distinct(*parts)


def function_category(function_area: Column, funds: Column) -> Column:
    health = (funds == "Health Enterprise Fund") | matches_any(function_area, ["Health", "Hospital"])
    return classify([(function_area, function_area == SAFETY), (HEALTH, health)], OTHER)


def tab_category(tab: Column, general_fund_type: Column, fund: Column, rest) -> Column:
    safety = (general_fund_type == SAFETY_FUND) | is_in(tab, SAFETY_TABS) | (fund == "Law Library")
    return classify([(HEALTH, tab == HEALTH_SYSTEM), (SAFETY, safety)], rest)


def summary_category(
    summary: Column, genfundtype: Column, title: Column, safety_names: Sequence[str]
) -> Column:
    safety = (
        (genfundtype == SAFETY_FUND)
        | matches_any(summary, safety_names)
        | matches_any(title, TITLE_SAFETY)
    )
    return classify([(HEALTH, matches(summary, HEALTH_SYSTEM)), (SAFETY, safety)], OTHER)


def wide_category(fund: Column, department: Column) -> Column:
    health = (fund == "Health Fund") | matches_any(department, WIDE_HEALTH)
    safety = (fund == SAFETY_FUND) | matches_any(department, [*WIDE_SAFETY, "Medical Examiner"])
    return classify([(HEALTH, health), (SAFETY, safety)], OTHER)


def county_budget_by_rules(
    by_function: DataFrame,
    by_tab: Mapping[int, DataFrame],
    by_summary: Mapping[int, DataFrame],
    wide: DataFrame,
) -> DataFrame:
    """County appropriations of all years, categories from rules; inputs as for the mapped form."""
    c = F.col
    ruled = by_function.withColumn("category", function_category(c("function_area"), c("funds")))
    parts = [_by_year(_by_function(ruled))]
    for year, df in by_tab.items():
        category = tab_category(c("tab"), c("general_fund_type"), c("fund"), OTHER)
        parts.append(_one_year(_by_tab(df.withColumn("category", category)), year))
    for year, df in by_summary.items():
        names = SUMMARY_SAFETY_2012 if year == 2012 else SUMMARY_SAFETY_2013
        category = summary_category(c("sort_for_summary"), c("genfundtype"), c("depttitle"), names)
        parts.append(_one_year(_by_summary(df.withColumn("category", category)), year))
    lines = wide_to_lines(wide).withColumn("category", wide_category(c("fund"), c("department")))
    parts.append(_by_year(lines.withColumnRenamed("appropriations", "amount")))
    return union_distinct(*parts)


def typed_budget(typed: DataFrame, year: int = 2020) -> DataFrame:
    """Hand-typed year: fund label by rules, incomplete rows left out. ``typed``: fund_type, department, amount."""
    department = F.col("department")
    health = (F.col("fund_type") == "Health Enterprise Fund") | matches_any(
        department, ["Health", "Hospital"]
    )
    label = classify([(HEALTH, health), (SAFETY, is_in(department, TYPED_SAFETY))], department)
    rows = typed.withColumns({"year": F.lit(year), "fund": label}).dropna("any")
    rows = rows.withColumn("amount", money("amount"))
    return conform(grand_total(rows, year_total=sum_strict("amount")), EXPENDITURE_SCHEMA)


def tab_expenditures(df: DataFrame, year: int) -> DataFrame:
    """Expenditure lines of one year with a fund label and the year's total."""
    c = F.col
    label = classify(
        [
            (HEALTH, (c("tab") == HEALTH_SYSTEM) | matches("fund", "Solid Waste")),
            (
                SAFETY,
                reduce(
                    or_,
                    [
                        c("general_fund_type") == SAFETY_FUND,
                        is_in("tab", SAFETY_TABS),
                        c("fund") == "Law Library",
                    ],
                ),
            ),
        ],
        title_case("tab"),
    )
    rows = df.select(label.alias("fund"), "fund_type", c("expenditures").alias("amount"))
    rows = rows.dropna("any").withColumns({"year": F.lit(year), "amount": money("amount")})
    return conform(grand_total(rows, year_total=sum_strict("amount")), EXPENDITURE_SCHEMA)


def wide_expenditures(wide: DataFrame) -> DataFrame:
    """Expenditure lines of the time series with a fund label and each year's total."""
    department = F.col("department")
    health = (F.col("fund_type") == "Health Fund") | matches_any(department, SPENT_HEALTH)
    safety = (F.col("fund_type") == SAFETY_FUND) | matches_any(department, WIDE_SAFETY)
    rows = wide_to_lines(wide).withColumnRenamed("fund", "fund_type")
    rows = rows.withColumns(
        {
            "fund": classify([(HEALTH, health), (SAFETY, safety)], department),
            "year": lenient("year", "int"),
            "amount": money("expenditures"),
        }
    )
    rows = group_total(rows, ["year"], drop_missing=True, year_total=sum_present("amount"))
    return conform(rows.filter("amount IS NOT NULL"), EXPENDITURE_SCHEMA)
