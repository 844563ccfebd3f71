"""Address matching, acceptance, rounds, choice among candidates and sources."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from civicframe.operators import geocoding as gc
from civicframe.plans import cases, locating

PLACES = "place_id int, address string, formatted string, lat double, lon double"


def test_house_number(spark):
    df = spark.createDataFrame(
        [("12 A St", "12 A St, X"), ("12 A St", "A St, X"), ("12 A St", "x"), ("A St", "12 A St"), (None, "12"), ("1 A", "1 A")],
        "given string, found string",
    )
    got = df.select(gc.house_number_agrees("given", "found").alias("a"), gc.house_number_agrees("given", "found", True).alias("s"))
    assert [tuple(r) for r in got.collect()] == [
        (True, True), (False, False), (False, False), (None, None), (None, None), (True, False),
    ]


def test_prepare_addresses(spark, rows):
    df = spark.createDataFrame(
        [("ME1", "1 A", None), ("ME1", "1 A", None), ("12-3", "2 B", "X"), ("ME2", "UNKNOWN", "X"), ("ME3", None, "X"), ("ME4", "3 C", "CICERO")],
        "case_no string, incident_address string, incident_city string",
    )
    assert rows(gc.prepare_addresses(df)) == [("ME1", "1 A", "CHICAGO", "1 A, CHICAGO"), ("ME4", "3 C", "CICERO", "3 C, CICERO")]
    assert [r.case_no for r in gc.prepare_addresses(df, from_row=2).collect()] == ["ME4"]


def test_geocode_join_keeps_k_nearest_in_box(spark, no_broadcast):
    places = spark.createDataFrame(
        [(1, "1 A.", "f", 41.9, -87.7), (2, "1  A", "f", 41.88, -87.68), (3, "1-A", "f", 41.0, -80.0), (4, "1 A", "f", 42.0, -87.9)],
        PLACES,
    )
    asked = spark.createDataFrame([(i, "1 A") for i in range(90)] + [(99, None)], "n int, q string")
    got = gc.geocode_join(asked, places, "q", "address", 2, locating.NARROW_BOX, locating.NEAR)
    assert {(r.place_id, r["rank"]) for r in got.collect()} == {(2, 1), (1, 2)}
    assert got.count() == 180


def test_rounds_stop_at_the_first_that_is_accepted(spark):
    todo = spark.createDataFrame(
        [("ME1", "1 S. A St", "X"), ("ME2", "2 N B St", "X"), ("ME3", "3 C St", "X"), ("ME4", "Hospital", "X"), ("ME5", "9 Q", "X")],
        "case_no string, incident_address string, incident_city string",
    )
    first = spark.createDataFrame([(1, "1 S A St X", "1 A, Chicago, IL 60601", 1.0, 1.0), (2, "2 N B St X", "B St", 2.0, 2.0)], PLACES)
    first = first.withColumns({"lat": F.lit(41.8), "lon": F.lit(-87.6)})
    second = spark.createDataFrame([(3, "2 NORTH B St X United States", "2 North B, Chicago, IL 60602", 41.8, -87.6)], PLACES)
    last = spark.createDataFrame([(4, "3 C St X", "3 C, Cicero, IL 60804", 0.0, 0.0), (5, "1 S A St X", "1 A late", 0.0, 0.0)], PLACES)
    located = locating.locate_addresses(todo, locating.standard_rounds(first, second, last))
    assert {(r.case_no, r.round) for r in located.collect()} == {
        ("ME1", "raw"), ("ME2", "rewritten"), ("ME3", "fallback"), ("ME4", None), ("ME5", None),
    }
    accepted = {r.case_no: (r.zip, r.city) for r in gc.accepted_locations(located).collect()}
    assert accepted == {"ME1": ("60601", "Chicago"), "ME2": ("60602", "Chicago"), "ME3": ("60804", "Cicero")}
    assert {r.case_no for r in gc.unplaced(located).collect()} == {"ME4", "ME5"}


def test_cleaned_locations(spark):
    work = spark.createDataFrame(
        [
            ("ME1", "a", "12 A", None, None, None, 1),
            ("ME1", "a", "99 Z", None, None, None, 2),
            ("ME2", "b", "", 41.0, -87.0, "known", 3),
            ("ME3", "c", "", None, None, None, 4),
            ("ME4", "d", "13 A", None, None, None, 5),
        ],
        "case_no string, full_address_new string, cleaned_address string, lat double, lon double, formatted string, line int",
    )
    book = spark.createDataFrame([(1, "12 A.", "12 A St", 41.8, -87.6), (2, "13 A", "A St 9", 41.8, -87.6)], PLACES)
    got = locating.cleaned_locations(work, book, ["line"])
    assert {(r.case_no, r.formatted) for r in got.collect()} == {("ME1", "12 A St"), ("ME2", "known")}


def choose(c, s):
    """The rule written out: None for cannot be told, -1 for none fits."""

    def both(a, b):
        if a is False or b is False:
            return False
        return None if a is None or b is None else True

    def eq(x, y):
        return None if x is None else x == y

    if c[0] is None:
        return None
    if c[0] == "Cook":
        return None if s[0] is None else (0 if s[0] == "IL" else -1)
    for i in (1, 2):
        fits = both(eq(c[i], "Cook"), eq(s[i], "IL"))
        if fits is None:
            return None
        if fits:
            return i
    return -1


def test_choice_of_candidate(spark):
    counties, states = ["Cook", "Will", None], ["IL", "IN", None]
    rng = random.Random(1)
    data = [tuple(rng.choice(counties) for _ in range(3)) + tuple(rng.choice(states) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(data, "COUNTY string, COUNTY_2 string, COUNTY_3 string, STATE string, STATE_2 string, STATE_3 string")
    df = df.withColumns({"N": F.lit(0.5), "N_2": F.lit(1.5), "N_3": F.lit(2.5)})
    expected = Counter()
    for d in data:
        i = choose(d[:3], d[3:])
        expected[d + ((None if i is None else gc.MISIDENTIFIED if i < 0 else str(i + 0.5)),)] += 1
    got = Counter(tuple(r) for r in gc.choose_candidate(df, ["N"]).select(*df.columns[:6], "N_FIN").collect())
    assert got == expected


def prefer(own, other):
    """The rule written out on sets of (key, value)."""

    def repeated(rows):
        counts = Counter(k for k, _ in rows)
        return {k for k, n in counts.items() if n > 1}

    everything = set(own) | set(other)
    dup = repeated(everything)
    left = set(own) | {r for r in other if r[0] not in dup}
    again = repeated(left)
    return {r for r in left if not (r[0] in again and r[1] is None)}


@pytest.mark.parametrize("seed", range(3))
def test_source_precedence(spark, no_broadcast, seed):
    rng = random.Random(seed)

    def some(n):
        return [(rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([None, 1.0, 2.0])) for _ in range(n)]

    one, two, api = some(4), some(3), some(8)
    frames = [spark.createDataFrame(x, "k string, lat double") for x in (one, two, api)]
    got = gc.prefer_sources(frames[:2], frames[2], "k", "lat")
    assert Counter(tuple(r) for r in got.collect()) == Counter(prefer(one + two, api))


def test_status_rule_and_merge(spark):
    data = [
        ("1 A", "s1", "c1", "IL", 1, 1.0, 1.0, "HOSPITAL", "OTHER"),
        ("2 B", "s2", "c2", "IL", 2, 2.0, 2.0, "HOSPITAL", "CLOSED"),
        ("3 C", "s3", "c3", "IL", 3, 3.0, 3.0, "", None),
        (None, "s4", "c4", "IL", 4, 4.0, 4.0, "HOME", "x"),
    ]
    df = spark.createDataFrame(data, "incident_address string, street string, city string, state string, zip int, lat double, lon double, loc_type string, status string")
    chosen = spark.createDataFrame(
        [("1 A", "new", None, "il", "60601-9", 9.0, None)],
        "raw string, street_fin string, city_fin string, state_fin string, zip_fin string, lat_fin double, lon_fin double",
    )
    got = {r.street: (r.city, r.zip, r.lat, r.lon, r.loc_type, r.status) for r in locating.merge_location_fields(df, chosen).collect()}
    assert got == {
        "NEW": ("c1", 60601, 9.0, 1.0, "HOSPITAL", "OPEN"),
        "s2": ("c2", 2, 2.0, 2.0, "HOSPITAL", "HOSPITAL"),
        "s3": ("c3", 3, 3.0, 3.0, "SCENE", "N/A"),
        "s4": ("c4", 4, 4.0, 4.0, "HOME", "N/A"),
    }


def test_report_columns_and_worklist(spark):
    names = [*cases.REPORT_NAMES, *cases.EMPTY_COLUMNS]
    row = {n: None for n in names} | {"CASE NO": "ME1", "DATE OF DEATH": "3/6/2014", "b": "Gunshot", "RACE": "Oriental", "...9": "no", "...19": "12 a st"}
    ddl = ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([tuple(row[n] for n in names)] * 2, ddl)
    out = cases.gunshot_cases(cases.combine_reports(df, df)).collect()
    assert len(out) == 1
    assert (out[0].race, out[0].latino, out[0].secondary_cause, out[0].incident_address) == ("ASIAN", "NO", "GUNSHOT", "12 A ST")
    work = spark.createDataFrame(
        [("12 A", "2014-01-01"), ("A 12", "2014-01-01"), ("A 12", "2016-01-01"), ("SCENE", "2016-01-01"), ("UNK", "2016-01-01"), (None, "2016-01-01"), ("A 12", None)],
        "incident_address string, d string",
    ).withColumns({"date_of_death": F.to_date("d"), "lat": F.lit(None).cast("double")})
    assert [(r.incident_address, r.d) for r in cases.location_worklist(work).collect()] == [("12 A", "2014-01-01"), ("A 12", "2016-01-01")]


def test_answers_to_check(spark):
    """Failing answers, also beside a good one; all good ones of a repeated case; rows without an answer."""
    todo = spark.createDataFrame(
        [(c, f"{n} A St", "X") for c, n in (("ME1", 1), ("ME2", 2), ("ME3", 3), ("ME4", 4), ("ME5", 5))],
        "case_no string, incident_address string, incident_city string",
    )
    answers = [
        (1, "1 A St X", "1 A, Chicago"),  # one good answer: nothing to check
        (2, "2 A St X", "2 A, Chicago"), (3, "2 A St X", "2 Another, Chicago"),  # two good ones
        (4, "3 A St X", "3 A, Chicago"), (5, "3 A St X", "9 Far, Chicago"),  # a good one and a failing one
        (6, "4 A St X", "Somewhere, Chicago"),  # only a failing one
    ]
    places = spark.createDataFrame([(i, a, f) for i, a, f in answers], "place_id int, address string, formatted string")
    places = places.withColumns({"lat": F.lit(41.8), "lon": F.lit(-87.6)})
    asked = gc.Round("all", F.concat_ws(" ", "incident_address", "incident_city"), places, "address", k=3)
    located = gc.geocode_rounds(todo, [asked], lambda given, found: found.startswith(F.regexp_extract(given, "[0-9]+", 0)))
    good, check = gc.settle(located, todo.filter("case_no IN ('ME1', 'ME2')").select("case_no"))
    assert {r.case_no for r in good.collect()} == {"ME3"}
    assert sorted((r.case_no, r.found_formatted) for r in check.collect() if r.found_formatted) == [
        ("ME2", "2 A, Chicago"), ("ME2", "2 Another, Chicago"), ("ME3", "9 Far, Chicago"), ("ME4", "Somewhere, Chicago"),
    ]
    assert [r.case_no for r in check.collect() if r.found_formatted is None] == ["ME5"]
