"""One small frame per missing-value rule, expected values by hand."""

import datetime

from pyspark.sql import functions as F

from civicframe.functions import dates, missing, text


def values(spark, ddl, data, expr):
    df = spark.createDataFrame(data, ddl)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_if_else_keeps_missing(spark):
    got = values(spark, "t boolean", [(True,), (False,), (None,)], missing.if_else(F.col("t"), "a", "b"))
    assert got == ["a", "b", None]


def test_matches_is_false_on_missing(spark):
    data = [("GUNSHOT",), ("fall",), (None,)]
    assert values(spark, "s string", data, missing.matches("s", "GUN")) == [True, False, False]
    got = values(spark, "a string, b string", [(None, "xGUNy"), (None, None)], missing.contains_any(["a", "b"], "GUN"))
    assert got == [True, False]


def test_regex_predicate_is_case_sensitive_and_a_regex(spark):
    data = [("Health",), ("health",), ("Wealth",)]
    assert values(spark, "s string", data, missing.matches("s", "H.alth")) == [True, False, False]
    assert values(spark, "s string", data, missing.matches_any("s", ["^W", "^h"])) == [False, True, True]


def test_is_in_never_missing(spark):
    assert values(spark, "s string", [("a",), ("z",), (None,)], missing.is_in("s", ["a"])) == [True, False, False]


def test_recode_order_and_default(spark):
    expr = missing.recode("s", {"ORIENTAL": "ASIAN"}, ["BLACK"], "OTHER")
    data = [("ORIENTAL",), ("ASIAN",), ("BLACK",), ("X",), (None,)]
    assert values(spark, "s string", data, expr) == ["ASIAN", "ASIAN", "BLACK", "OTHER", None]


def test_classify_first_rule_wins_and_missing_stops(spark):
    expr = missing.classify([("h", F.col("a") == 1), ("s", F.col("b") == 1)], "o")
    data = [(1, 1), (0, 1), (0, 0), (None, 1), (0, None), (1, None)]
    assert values(spark, "a int, b int", data, expr) == ["h", "s", "o", None, None, "h"]


def test_lenient_cast(spark):
    data = [("123.9",), ("-123.9",), ("N/A",), (None,), ("7",)]
    assert values(spark, "s string", data, missing.lenient("s", "int")) == [123, -123, None, None, 7]
    assert values(spark, "s string", data, missing.lenient("s", "double")) == [123.9, -123.9, None, None, 7.0]


def test_paste_writes_missing_as_text(spark):
    got = values(spark, "a string, b int", [("x", None)], missing.paste(["a", "b"], ", "))
    assert got == ["x, NA"]
    assert values(spark, "a string, b int", [("x", None)], missing.paste_present(["a", "b"], ",")) == ["x"]


def test_sums(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), ("c", 2)], "k string, v int")
    got = {
        r.k: (r.present, r.strict)
        for r in df.groupBy("k")
        .agg(missing.sum_present("v").alias("present"), missing.sum_strict("v").alias("strict"))
        .collect()
    }
    assert got == {"a": (1, None), "b": (0, None), "c": (2, 2)}


def test_first_present_and_nonempty(spark):
    data = [("", "b"), (None, "b"), ("a", "b"), ("", None)]
    assert values(spark, "x string, y string", data, missing.first_nonempty("x", "y")) == ["b", "b", "a", None]
    assert values(spark, "x string, y string", data, missing.first_present("x", "y")) == ["", "b", "a", ""]


def test_sentinel(spark):
    assert values(spark, "x long", [(-666666666,), (5,)], missing.sentinel_to_missing("x", -666666666)) == [None, 5]


def test_title_case(spark):
    data = [("SMITH-JONES o'BRIEN 5TH ST. (a)",), ("ÉCOLE über",), ("",), (None,)]
    assert values(spark, "s string", data, text.title_case("s")) == [
        "Smith-Jones O'brien 5th St. (A)", "École Über", "", None,
    ]


def test_address_key_and_trim(spark):
    data = [(" 12 S. Main-St #4 ",), ("...",), (None,)]
    assert values(spark, "s string", data, text.address_key("s")) == ["12 S Main St 4", "", None]
    data = [("A - - 12.",), ("---",), ("abc",)]
    assert values(spark, "s string", data, text.trim_right_to_letter("s")) == ["A", "", "abc"]


def test_directions_only_first_of_each_form(spark):
    data = [("1 S. A S. B",), ("1 N X W. Y E Z",), ("nothing",), (None,)]
    assert values(spark, "s string", data, text.expand_directions("s")) == [
        "1 SOUTH A S. B", "1 NORTH X WEST Y EAST Z", "nothing", None,
    ]


def test_replacement_text_is_literal(spark):
    assert values(spark, "s string", [("a.b.c",)], text.replace_first("s", ".", "$1\\")) == ["a$1\\b.c"]


def test_extract(spark):
    data = [("no digits",), ("12 then 13",), (None,)]
    assert values(spark, "s string", data, text.extract_first("s", "[0-9]+")) == [None, "12", None]


def test_zip_and_city(spark):
    data = [
        ("1 A St, Chicago, IL 60601, USA",),
        ("12345 A St, Near North, Chicago, Cook, IL 60601",),
        ("none",),
        (None,),
    ]
    assert values(spark, "s string", data, text.parse_zip("s")) == ["60601", "60601", None, None]
    assert values(spark, "s string", data, text.parse_city("s")) == ["Chicago", "Near North", None, None]
    three = [("a, One, x 1, Two, y 2, Three, z",)]
    assert values(spark, "s string", three, text.parse_city("s")) == ["Two"]


def test_row_key_and_request(spark):
    df = spark.createDataFrame([("1 N. Main St", None)], "address string, city string")
    row = df.select(
        text.row_key(["address", "city"]).alias("k"),
        text.geocode_request("?s={s}&c={c}", s=text.request_text("address", "+"), c=F.col("city")).alias("r"),
    ).first()
    import hashlib

    assert row.k == hashlib.md5(b"1N.MainSt").hexdigest()
    assert row.r == "?s=1+N+Main+St&c="


def test_dates(spark):
    data = [("3/6/2021",), ("03/06/2021",), ("13/40/2021",), (None,)]
    day = datetime.date(2021, 3, 6)
    assert values(spark, "s string", data, dates.month_day_year("s")) == [day, day, None, None]
    same = ["3-6-2021", "3.6.21", " 03/06/21 ", "March 6, 2021", "mar 6th 2021", "Mar. 6 2021", "MARCH-06-21", "03062021", "030621"]
    assert values(spark, "s string", [(t,) for t in same], dates.month_day_year("s")) == [day] * len(same)
    odd = ["3/6/69", "3/6/68", "2/30/2021", "6 March 2021", "Marc 6 2021", "3/6", "3/6/2021/7", "", "3/6/202", "smarch 1 2021", "2021-03-06", "13/1/21"]
    years = [datetime.date(1969, 3, 6), datetime.date(2068, 3, 6)]
    assert values(spark, "s string", [(t,) for t in odd], dates.month_day_year("s")) == years + [None] * (len(odd) - 2)
    got = values(spark, "s string", [("2021-03-06 10:00:00",)], dates.month_floor(F.to_timestamp("s")).cast("date"))
    assert got == [datetime.date(2021, 3, 1)]
