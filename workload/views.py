"""Input views over the given tables, as SQL text that Spark and DuckDB both accept.

Tables stand in braces. The views stand for the case, crime, budget, census and address data
the operators work on; every one reads a whole table.
"""

from __future__ import annotations

VIEWS = {
    "cases": """
SELECT 'ME' || CAST(CAST(year(o_orderdate) AS INT) AS STRING) || '-' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS case_no,
       o_orderkey AS case_id,
       'o''neil-smith, person ' || CAST(o_custkey AS STRING) AS name,
       CASE WHEN o_orderkey % 10 = 0 THEN 'Suicide' ELSE 'Homicide' END AS manner,
       CAST(o_custkey % 90 AS INT) AS age,
       CAST(o_orderdate AS DATE) AS date_of_death,
       CAST(CAST(month(o_orderdate) AS INT) AS STRING) || '/' || CAST(CAST(day(o_orderdate) AS INT) AS STRING) || '/' || CAST(CAST(year(o_orderdate) AS INT) AS STRING) AS date_text,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
       CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Am. Indian' WHEN 2 THEN 'Oriental' WHEN 3 THEN 'Unknown' WHEN 4 THEN 'White' ELSE 'Black' END AS race,
       CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'YES' ELSE 'NO' END AS latino,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Gunshot wound (' || o_orderstatus || ') - 2' ELSE o_orderpriority END AS primary_cause_a,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'multiple gunshot' ELSE 'n/a' END AS primary_cause_b,
       CASE WHEN o_orderkey % 8 = 0 THEN 'fall' END AS primary_cause_c,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'see report 12.' END AS secondary_cause,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'UNK LOCATION' WHEN o_orderkey % 31 = 0 THEN 'SCENE'
            WHEN o_orderkey % 37 = 0 THEN 'Trinity Hospita.' WHEN o_orderkey % 41 = 0 THEN 'CORNER OF MAIN'
            ELSE CAST(o_orderkey % 900 + 1 AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN ' S. ' WHEN 1 THEN ' N ' WHEN 2 THEN ' W. ' ELSE ' E ' END
                 || 'Street#' || CAST(o_custkey % 40 AS STRING) END AS incident_address,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'OAK PARK' ELSE 'CHICAGO' END AS incident_city,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(41.6 AS DOUBLE) + CAST((o_orderkey * 7919) % 5000 AS DOUBLE) / 10000 END AS lat,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(-87.95 AS DOUBLE) + CAST((o_orderkey * 1047) % 4000 AS DOUBLE) / 10000 END AS lon,
       o_totalprice AS measure
FROM {orders}
""",
    "crimes": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS date, CAST(year(l_shipdate) AS INT) AS year,
       l_returnflag || l_linestatus AS primary_type, l_quantity > 25 AS arrest,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 25 AS STRING) END AS community_area,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(41.6 AS DOUBLE) + CAST((l_partkey * 7919) % 5000 AS DOUBLE) / 10000 END AS latitude,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(-87.95 AS DOUBLE) + CAST((l_suppkey * 1047 + l_linenumber * 531) % 4000 AS DOUBLE) / 10000 END AS longitude
FROM {lineitem} JOIN (VALUES (1), (2)) AS d(delivery) ON d.delivery = 1 OR l_partkey % 13 = 0
""",
    "crime_categories": """
SELECT * FROM (VALUES ('AF','Violent'), ('AO','Violent'), ('NF','Property'), ('RF','Other'), ('RO','Other')) AS t(primary_type, crime_category)
""",
    "community_names": """
SELECT CAST(n_nationkey AS STRING) AS community_area, 'AREA ' || n_name AS community FROM {nation}
""",
    "budget_lines": """
SELECT CAST(year(o_orderdate) AS INT) AS year,
       CASE o_custkey % 4 WHEN 0 THEN 'Health Enterprise Fund' WHEN 1 THEN 'Public Safety Fund' WHEN 2 THEN 'Law Library' ELSE 'General Fund' END AS funds,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Public Safety' WHEN '2-HIGH' THEN 'Health Services' WHEN '3-MEDIUM' THEN NULL ELSE 'Finance' END AS function_area,
       CASE o_custkey % 25 % 6 WHEN 0 THEN 'Sheriff ' WHEN 1 THEN 'Security ' WHEN 2 THEN 'Lead Poisoning ' WHEN 3 THEN 'Medical Examiner ' WHEN 4 THEN 'County Hospital ' ELSE 'Finance ' END || 'NATION_' || CAST(o_custkey % 25 AS STRING) AS department,
       CASE o_custkey % 25 % 7 WHEN 0 THEN 'COOK COUNTY HEALTH AND HOSPITALS SYSTEM' WHEN 1 THEN 'SHERIFF' WHEN 2 THEN 'CHIEF JUDGE' WHEN 3 THEN 'PUBLIC DEFENDER' WHEN 4 THEN NULL ELSE 'BOARD OF REVIEW-NORTH' END AS tab,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_custkey % 25 % 4 = 0 THEN 'Public Safety Fund' ELSE 'Corporate Fund' END AS general_fund_type,
       CASE o_orderstatus WHEN 'F' THEN ' Solid Waste' WHEN 'O' THEN 'Law Library ' ELSE 'Corporate' END AS fund,
       o_orderstatus AS status,
       CASE WHEN o_orderkey % 41 = 0 THEN 'N/A' WHEN o_orderkey % 43 = 0 THEN NULL
            ELSE CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) || '.50' END AS amount,
       CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) AS clean_amount
FROM {orders}
""",
    "census": """
SELECT 'Y' || CAST(d.datayear AS STRING) AS geogyear, d.datayear AS datayear, CAST(60600 + s_suppkey AS STRING) AS zcta,
       CAST(s_suppkey * 100 + d.datayear AS BIGINT) AS total_pop,
       CAST(s_suppkey * 40 + 500 AS BIGINT) AS total_males, CAST(s_suppkey * 60 + 400 AS BIGINT) AS total_females,
       CAST(s_suppkey * 11 AS BIGINT) AS pop_race_white, CAST(s_suppkey * 7 AS BIGINT) AS pop_race_black,
       CAST(s_suppkey * 5 AS BIGINT) AS pop_race_native_am, CAST(s_suppkey * 4 AS BIGINT) AS pop_race_asian,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey * 3 AS BIGINT) END AS pop_race_pacific_island,
       CAST(s_suppkey AS BIGINT) AS pop_race_other,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey * 2 AS BIGINT) END AS pop_race_mult,
       CAST(s_suppkey + 1 AS BIGINT) AS occupied_units, CAST(s_suppkey + 2 AS BIGINT) AS vacant_units,
       CAST(s_suppkey + 3 AS BIGINT) AS owner_occupied, CAST(s_suppkey + 4 AS BIGINT) AS renter_occupied,
       CAST(s_suppkey * 6 AS BIGINT) AS own_white_occupied,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey * 8 AS BIGINT) END AS own_black_occupied,
       CAST(s_suppkey AS BIGINT) AS own_other_occupied,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_suppkey * 9 AS BIGINT) END AS own_mult_race_occupied,
       CAST(s_suppkey * 12 AS BIGINT) AS rent_asian_occupied, CAST(s_suppkey * 2 AS BIGINT) AS rent_other_occupied,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey * 13 AS BIGINT) END AS rent_mult_race_occupied
FROM {supplier} JOIN (VALUES (1990), (2000), (2010)) AS d(datayear) ON d.datayear > 0
""",
    "case_zips": """
SELECT CASE WHEN s_nationkey = 3 OR s_acctbal <= 0 THEN NULL ELSE CAST(60600 + s_suppkey AS STRING) END AS zip FROM {supplier}
""",
    "gazetteer": """
SELECT p_partkey AS place_id,
       CAST(p_partkey % 900 + 1 AS STRING) || ' ' || upper(p_name) || ' STREET ' || CAST(p_size % 40 AS STRING)
         || CASE p_partkey % 3 WHEN 0 THEN ', Cook County' WHEN 1 THEN '' ELSE ', Near North, West Town' END
         || ', Chicago, IL ' || CAST(60600 + p_size AS STRING) || ', United States' AS formatted,
       CAST(p_partkey % 900 + 1 AS STRING) || CASE p_partkey % 4 WHEN 0 THEN ' S ' WHEN 1 THEN ' N ' WHEN 2 THEN ' W ' ELSE ' E ' END || 'Street ' || CAST(p_size % 40 AS STRING) AS short_address,
       CAST(p_partkey % 900 + 1 AS STRING) || CASE p_partkey % 4 WHEN 0 THEN ' SOUTH ' WHEN 1 THEN ' NORTH ' WHEN 2 THEN ' WEST ' ELSE ' EAST ' END || 'Street ' || CAST(p_size % 40 AS STRING) || ' CHICAGO United States' AS long_address,
       CAST(p_partkey % 900 + 1 AS STRING) || CASE p_partkey % 4 WHEN 0 THEN ' S ' WHEN 1 THEN ' N ' WHEN 2 THEN ' W ' ELSE ' E ' END || 'Street ' || CAST(p_size % 40 AS STRING) || ' CHICAGO' AS city_address,
       CAST(41.5 AS DOUBLE) + CAST((p_partkey * 31) % 9000 AS DOUBLE) / 10000 AS lat, CAST(-87.95 AS DOUBLE) + CAST((p_partkey * 17) % 8000 AS DOUBLE) / 10000 AS lon
FROM {part}
""",
    "named_places": """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'ME' || CAST(CAST(year(o_orderdate) AS INT) AS STRING) || '-' || lpad(CAST(o_orderkey AS STRING), 12, '0') END AS case_no,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(41.6 AS DOUBLE) + CAST((o_orderkey * 3) % 5000 AS DOUBLE) / 10000 END AS lat,
       CAST(-87.95 AS DOUBLE) + CAST((o_orderkey * 3) % 4000 AS DOUBLE) / 10000 AS lon
FROM {orders}
""",
    "manual_places": """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'ME' || CAST(CAST(year(o_orderdate) AS INT) AS STRING) || '-' || lpad(CAST(o_orderkey AS STRING), 12, '0') END AS case_no,
       CAST(41.6 AS DOUBLE) + CAST((o_orderkey * 11) % 5000 AS DOUBLE) / 10000 AS lat,
       CAST(-87.95 AS DOUBLE) + CAST((o_orderkey * 11) % 4000 AS DOUBLE) / 10000 AS lon
FROM {orders}
""",
    "api_places": """
SELECT 'ME' || CAST(CAST(year(o_orderdate) AS INT) AS STRING) || '-' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS case_no,
       CAST(41.6 AS DOUBLE) + CAST((o_orderkey * 13) % 5000 AS DOUBLE) / 10000 AS lat,
       CAST(-87.95 AS DOUBLE) + CAST((o_orderkey * 13) % 4000 AS DOUBLE) / 10000 AS lon
FROM {orders}
UNION ALL
SELECT 'ME' || CAST(CAST(year(o_orderdate) AS INT) AS STRING) || '-' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS case_no,
       CAST(41.7 AS DOUBLE) AS lat, CAST(-87.7 AS DOUBLE) AS lon
FROM {orders} WHERE o_orderpriority = '3-MEDIUM'
""",
    "responses": """
SELECT md5(CAST(c_custkey AS STRING)) AS hash_key,
       '{{"results":[{{"providedLocation":{{"street":"' || CAST(c_custkey AS STRING) || ' MAIN"}},"locations":['
       || '{{"street":"a","adminArea5":"Chicago"' || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ',"adminArea4":"' || CASE WHEN c_custkey % 3 = 0 THEN 'Will' ELSE 'Cook' END || '"' END || ',"adminArea3":"' || CASE WHEN c_custkey % 4 = 0 THEN 'IN' ELSE 'IL' END || '","postalCode":"60601-1","geocodeQuality":"POINT","geocodeQualityCode":"P1","latLng":{{"lat":41.8,"lng":-87.6}}}}'
       || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ',{{"street":"b","adminArea5":"Cicero","adminArea4":"' || CASE WHEN c_custkey % 2 = 0 THEN 'Cook' ELSE 'Lake' END || '","adminArea3":"IL","postalCode":"60804","geocodeQuality":"STREET","geocodeQualityCode":"B1","latLng":{{"lat":41.85,"lng":-87.7}}}}'
         || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ',{{"street":"c","adminArea5":"Berwyn","adminArea4":"Cook","adminArea3":"' || CASE WHEN c_custkey % 9 = 0 THEN 'WI' ELSE 'IL' END || '","postalCode":"60402","geocodeQuality":"ZIP","geocodeQualityCode":"Z1","latLng":{{"lat":41.84,"lng":-87.8}}}}' END END
       || ']}}]}}' AS response
FROM {customer}
""",
    "survey": """
SELECT '1400000US' || lpad(CAST(c_custkey AS STRING), 11, '0') AS geo_id, d.acs_year AS acs_year,
       CAST(c_custkey * 10 + d.acs_year AS BIGINT) AS total_population,
       CAST(c_custkey * 4 AS BIGINT) AS population_male, CAST(c_custkey * 6 AS BIGINT) AS population_female,
       CAST(c_custkey * 3 AS BIGINT) AS population_white, CAST(c_custkey * 2 AS BIGINT) AS population_black,
       CAST(c_custkey AS BIGINT) AS population_native_american, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey * 5 AS BIGINT) END AS population_asian,
       CASE WHEN c_custkey % 6 = 0 THEN CAST(-666666666 AS BIGINT) ELSE CAST(c_custkey * 100 AS BIGINT) END AS median_income_white,
       CASE WHEN c_custkey % 5 = 0 THEN CAST(-666666666 AS BIGINT) ELSE CAST(c_custkey * 90 AS BIGINT) END AS median_income_black,
       CAST(-666666666 AS BIGINT) AS median_income_native_american, CAST(c_custkey * 110 AS BIGINT) AS median_income_asian
FROM {customer} JOIN (VALUES (2018), (2019)) AS d(acs_year) ON d.acs_year > 0
""",
}

# Polygons as one row of vertex offsets each: table, id, extra attributes, origin, step, offsets.
POLYGONS = {
    "areas": {
        "table": "nation",
        "id": "n_nationkey",
        "attrs": {"area_id": "CAST(n_nationkey AS STRING)", "community": "'AREA ' || n_name"},
        "x": "CAST(-87.95 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.08 AS DOUBLE)",
        "y": "CAST(41.6 AS DOUBLE) + CAST(floor(n_nationkey / 5) AS DOUBLE) * CAST(0.1 AS DOUBLE)",
        "vertices": [(0, 0), (7, 0), (7, 9), (4, 5), (0, 9)],
        "unit": 100,
    },
    "zips": {
        "table": "supplier",
        "id": "s_suppkey",
        "attrs": {"zip": "CAST(60600 + s_suppkey AS STRING)"},
        "x": "CAST(-87.97 AS DOUBLE) + CAST(s_suppkey % 10 AS DOUBLE) * CAST(0.045 AS DOUBLE)",
        "y": "CAST(41.58 AS DOUBLE) + CAST(floor(s_suppkey / 10) AS DOUBLE) * CAST(0.055 AS DOUBLE)",
        "vertices": [(5, 0), (45, 0), (50, 30), (25, 55), (0, 30)],
        "unit": 1000,
    },
    "tracts": {
        "table": "customer",
        "id": "c_custkey",
        "attrs": {"geoid10": "lpad(CAST(c_custkey AS STRING), 11, '0')"},
        "x": "CAST(-87.96 AS DOUBLE) + CAST(c_custkey % 50 AS DOUBLE) * CAST(0.0091 AS DOUBLE)",
        "y": "CAST(41.59 AS DOUBLE) + CAST(floor(c_custkey / 50) AS DOUBLE) * CAST(0.0087 AS DOUBLE)",
        "vertices": [(0, 0), (9, 1), (8, 8), (1, 7)],
        "unit": 1000,
    },
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def vertices_sql(name: str) -> str:
    """One row per vertex: the attributes, ``seq, x, y``."""
    p = POLYGONS[name]
    attrs = ", ".join(f"{sql} AS {n}" for n, sql in p["attrs"].items())
    rows = ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(p["vertices"]))
    return f"""
SELECT {attrs}, v.seq AS seq,
       {p["x"]} + CAST(v.dx AS DOUBLE) / {p["unit"]} AS x, {p["y"]} + CAST(v.dy AS DOUBLE) / {p["unit"]} AS y
FROM {{{p["table"]}}} JOIN (VALUES {rows}) AS v(seq, dx, dy) ON v.seq >= 0
"""


def rings_sql(name: str) -> str:
    """One row per polygon: the attributes and ``rings`` (Spark only)."""
    p = POLYGONS[name]
    attrs = ", ".join(f"{sql} AS {n}" for n, sql in p["attrs"].items())
    points = ", ".join(
        f"named_struct('x', {p['x']} + CAST({dx} AS DOUBLE) / {p['unit']},"
        f" 'y', {p['y']} + CAST({dy} AS DOUBLE) / {p['unit']})"
        for dx, dy in p["vertices"]
    )
    return f"SELECT {attrs}, array(array({points})) AS rings FROM {{{p['table']}}}"
