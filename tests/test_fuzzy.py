"""Inexact gazetteer look-up against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from civicframe.operators import fuzzy, geocoding
from civicframe.plans import locating

PLACES = "place_id int, address string, lat double, lon double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(asked, places, k, edits, share):
    keys = {a.upper() for _, a in places}
    df = Counter(w for a in keys for w in set(a.split()))
    weight = {w: math.floor(1000 * math.log1p(len(keys) / n) + 0.5) for w, n in df.items()}
    out = []
    for n, q in asked:
        if not q:
            continue
        words = {w for w in q.upper().split() if w in weight}
        total = sum(weight[w] for w in words)
        fits = []
        for i, a in places:
            shared = sum(weight[w] for w in words & set(a.upper().split()))
            d = distance(q.upper(), a.upper())
            if shared and d <= edits and shared * 100 >= total * share:
                fits.append((d, -shared, i))
        out += [(n, i, at, d) for at, (d, _, i) in enumerate(sorted(fits)[:k], 1)]
    return sorted(out)


def misspell(rng, a):
    at = rng.randrange(len(a))
    if a[at] == " ":
        return a
    return rng.choice([a[:at] + a[at + 1 :], a[:at] + "Q" + a[at:], a[:at] + "z" + a[at + 1 :], a])


@pytest.mark.parametrize("share,edits", [(1, 3), (60, 2), (100, 1)])
def test_equals_brute_force(spark, share, edits):
    rng = random.Random(7)
    streets = ["OAK", "Elm", "MAIN", "STATE", "LAKE", "LAKES"]
    places = [(i, f"{rng.randrange(1, 30)} {rng.choice('NSEW')} {rng.choice(streets)} ST") for i in range(250)]
    asked = [(n, misspell(rng, misspell(rng, rng.choice(places)[1])).strip()) for n in range(300)]
    asked += [(900, None), (901, ""), (902, "NOWHERE"), (903, "ST"), (904, asked[0][1])]
    asked = [(n, a and " ".join(a.split())) for n, a in asked]
    book = spark.createDataFrame([(i, a, 41.8, -87.6) for i, a in places], PLACES)
    rows = spark.createDataFrame(asked, "n int, typed string")
    got = geocoding.fuzzy_geocode_join(rows, book, "typed", "address", 3, edits, share)
    assert sorted((r.n, r.place_id, r["rank"], r.edits) for r in got.collect()) == brute(asked, places, 3, edits, share)


def test_hot_words_are_spread_and_copies_cost_one_look_up(spark, no_broadcast):
    places = [(i, f"{i} N OAK ST") for i in range(40)]
    asked = [(n, "7 N OKA ST") for n in range(50)] + [(n, f"{n} N OAK SR") for n in range(50, 60)]
    book = spark.createDataFrame([(i, a, 41.8, -87.6) for i, a in places], PLACES)
    got = geocoding.fuzzy_geocode_join(spark.createDataFrame(asked, "n int, typed string"), book, "typed", "address", 1, 2, 50)
    assert sorted((r.n, r.place_id, r["rank"], r.edits) for r in got.collect()) == brute(asked, places, 1, 2, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan and "CartesianProduct" not in plan


def test_words_that_decide_nothing_are_not_looked_up(spark):
    words = spark.createDataFrame([([("7", 6000), ("OAK", 3000), ("ST", 100)],)], "w array<struct<word:string,weight:bigint>>")
    needed = {s: words.select(fuzzy._needed_words(F.col("w"), s)["word"].alias("n")).first().n for s in (1, 30, 60, 100)}
    assert needed == {1: ["7", "OAK", "ST"], 30: ["7", "OAK"], 60: ["7"], 100: ["7"]}


def test_empty_tables(spark):
    book = spark.createDataFrame([], PLACES)
    rows = spark.createDataFrame([(1, "1 OAK")], "n int, typed string")
    assert geocoding.fuzzy_geocode_join(rows, book, "typed", "address").count() == 0
    book = spark.createDataFrame([(1, "1 OAK", 1.0, 1.0)], PLACES)
    assert geocoding.fuzzy_geocode_join(rows.limit(0), book, "typed", "address").count() == 0
    with pytest.raises(ValueError):
        geocoding.fuzzy_geocode_join(rows, book, "typed", "address", share=0)


def test_a_round_for_misspelled_addresses(spark, no_broadcast):
    places = "place_id int, address string, formatted string, lat double, lon double"
    book = spark.createDataFrame([(1, "12 N OAK ST CHICAGO", "12 N Oak St, Chicago, IL 60601", 41.8, -87.6)], places)
    todo = spark.createDataFrame(
        [("ME1", "12 N OAK ST", None), ("ME2", "12 N OKA ST", None), ("ME3", "13 N OAK ST", None), ("ME4", "99 ELM", None)],
        "case_no string, incident_address string, incident_city string",
    )
    asked = F.regexp_replace("full_address", ",", "")
    exact = geocoding.Round("raw", asked, book, "address")
    rounds = [exact, geocoding.Round("near", asked, book, "address", edits=2, share=50)]
    located = locating.locate_addresses(todo, rounds)
    assert {(r.case_no, r.round) for r in located.collect()} == {
        ("ME1", "raw"), ("ME2", "near"), ("ME3", None), ("ME4", None),
    }
    # One edit away, but another house: refused, and listed for a look by hand.
    assert {(r.case_no, r.found_formatted) for r in geocoding.to_check(located).collect()} == {
        ("ME3", "12 N Oak St, Chicago, IL 60601"), ("ME4", None),
    }
