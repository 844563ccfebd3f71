"""Spatial joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from civicframe.functions import geometry as G
from civicframe.operators import spatial

RINGS = f"id string, rings {G.RINGS_TYPE}"
SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]


def star(rng, cx, cy, r, n=9):
    """A star-shaped, usually concave ring, counter-clockwise."""
    return [
        (cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n))
        for i in range(n)
    ]


def table(spark, polygons):
    return spark.createDataFrame([(i, [[dict(x=x, y=y) for x, y in ring] for ring in rings]) for i, rings in polygons], RINGS)


def within(px, py, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
            if cross == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
                return False
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                odd = not odd
    return odd


@pytest.mark.parametrize("cell", [0.11, 0.7, 5.0, None])
def test_points_match_brute_force(spark, cell):
    rng = random.Random(5)
    polygons = [(f"p{i}", [star(rng, rng.uniform(-5, 5), rng.uniform(-5, 5), 2.5)]) for i in range(12)]
    polygons.append(("holed", [SQUARE, HOLE]))
    points = [(i, rng.uniform(-7, 7), rng.uniform(-7, 7)) for i in range(400)]
    points += [(900, 0.0, 2.0), (901, 2.0, 2.0), (902, 0.5, 0.5), (903, 4.0, 4.0), (904, None, 1.0)]
    expected = set()
    for i, x, y in points:
        hits = [] if x is None else [n for n, rings in polygons if within(x, y, rings)]
        expected |= {(i, h) for h in hits or [None]}
    df = spark.createDataFrame(points, "n int, lon double, lat double")
    got = spatial.point_in_polygon_join(df, table(spark, polygons), ["id"], cell=cell)
    assert sorted(((r.n, r.id) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_points_on_one_spot_are_spread(spark, no_broadcast):
    spots = spark.createDataFrame([(i, 2.0 if i % 3 else 0.5, 0.5) for i in range(300)], "n int, lon double, lat double")
    got = spatial.point_in_polygon_join(spots, table(spark, [("s", [SQUARE])]), ["id"], cell=0.5)
    assert got.count() == 300 and got.filter("id = 's'").count() == 300


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0)], "id string, lon double, lat double")
    with pytest.raises(ValueError):
        spatial.point_in_polygon_join(df, table(spark, [("s", [SQUARE])]), ["id"])


def test_small_cells_and_large_polygons(spark):
    """Cells far smaller than a polygon are no trouble: it takes larger ones."""
    big = [(x * 1e6, y * 1e6) for x, y in SQUARE]
    comb = [(i / 2, 0.0 if i % 2 else 3.0) for i in range(101)] + [(50.0, -1.0), (0.0, -1.0)]
    comb = comb[::-1]
    polygons = [("s", [SQUARE]), ("big", [big]), ("comb", [comb])]
    rng = random.Random(8)
    points = [(i, rng.uniform(-1, 51), rng.uniform(-2, 5)) for i in range(200)] + [(500, None, 1.0), (501, -9.0, -9.0)]
    df = spark.createDataFrame(points, "n int, lon double, lat double")
    expected = set()
    for i, x, y in points:
        hits = [] if x is None else [n for n, rings in polygons if within(x, y, rings)]
        expected |= {(i, h) for h in hits or [None]}
    for cell in (1e-9, 0.5, None):
        got = spatial.point_in_polygon_join(df, table(spark, polygons), ["id"], cell=cell)
        assert sorted(((r.n, r.id) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_size_of_cells_is_an_upper_bound(spark):
    """A comb's edges stand in all rows that they reach into, and are counted there."""
    comb = [(i / 200, 0.0 if i % 2 else 3.0) for i in range(401)] + [(2.0, -1.0), (0.0, -1.0)]
    polygons = table(spark, [("comb", [comb[::-1]]), *((f"s{i}", [[(x / 9 + i, y / 9) for x, y in SQUARE]]) for i in range(9))])
    grid = spatial.plan_grid(polygons, ["id"])
    edges = 0
    for level in grid.levels:
        cells = spatial.polygon_cells(polygons, ["id"], "rings", grid.size * 2.0**level)
        edges = max(edges, cells.agg(F.sum(F.size("__rest"))).first()[0])
    assert grid.cell_bytes >= 32 * edges


def test_shuffled_form_is_salted(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(spatial, "MAX_BROADCAST", 0)
    df = spark.createDataFrame([(i, 2.0, 0.5) for i in range(60)], "n int, lon double, lat double")
    got = spatial.point_in_polygon_join(df, table(spark, [("s", [SQUARE])]), ["id"], cell=0.5)
    assert "__salt" in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter("id = 's'").count() == 60


def areas(spark, left, right, cell):
    pairs = spatial.overlap_pairs(table(spark, left), table(spark, right).withColumnRenamed("id", "rid"), "id", "rid", cell=cell)
    return {(r.id, r.rid): r.overlap for r in pairs.collect()}


def test_overlap_area(spark):
    shifted = [(x + 2, y + 1) for x, y in SQUARE]
    got = areas(spark, [("a", [SQUARE]), ("h", [SQUARE, HOLE])], [("b", [shifted])], 1.3)
    assert got[("a", "b")] == pytest.approx(2 * 3)
    assert got[("h", "b")] == pytest.approx(2 * 3 - 1 * 2)
    apart = [(x + 40, y) for x, y in SQUARE]
    assert areas(spark, [("a", [SQUARE])], [("b", [apart])], 3.0) == {}
    # Polygons that touch along an edge or in a corner are pairs of area 0.
    for dx, dy in ((4, 0), (4, 4), (-4, 1), (2, 4)):
        beside = [(x + dx, y + dy) for x, y in SQUARE]
        assert areas(spark, [("a", [SQUARE])], [("b", [beside])], 3.0) == {("a", "b"): 0.0}
    corner = [(5.0, 2.0), (8.0, 1.0), (8.0, 3.0)]
    assert areas(spark, [("a", [SQUARE])], [("b", [corner])], 3.0) == {}
    tip = [(4.0, 2.0), (8.0, 1.0), (8.0, 3.0)]
    assert areas(spark, [("a", [SQUARE])], [("b", [tip])], 3.0) == {("a", "b"): 0.0}


def test_nested_and_tiny_pairs(spark):
    inner = [(x / 8 + 1.7, y / 8 + 1.7) for x, y in SQUARE]
    got = areas(spark, [("a", [SQUARE]), ("h", [SQUARE, HOLE])], [("in", [inner])], 1.0)
    assert got == {("a", "in"): pytest.approx(0.25)}
    assert areas(spark, [("in", [inner])], [("a", [SQUARE])], 1.0) == {("in", "a"): pytest.approx(0.25)}
    for scale in (1e-6, 1e-9, 1e9):
        small = [(x * scale + 0.1, y * scale) for x, y in SQUARE]
        moved = [(x * scale + 0.1 + 2 * scale, y * scale) for x, y in SQUARE]
        got = areas(spark, [("a", [small])], [("b", [moved])], None)
        assert got == {("a", "b"): pytest.approx(8 * scale * scale, rel=1e-4)}
    mixed = areas(spark, [("a", [SQUARE]), ("t", [[(x * 1e-5 + 1, y * 1e-5 + 1) for x, y in SQUARE]])], [("b", [SQUARE])], None)
    assert mixed[("a", "b")] == pytest.approx(16) and mixed[("t", "b")] == pytest.approx(16e-10, rel=1e-3)


def test_long_boundaries_meet_strip_by_strip(spark):
    """The rows that edges make together grow with the edges, not with their product."""
    n = 1500
    def ring(shift):
        return [(math.cos(2 * math.pi * i / n) + shift, math.sin(2 * math.pi * i / n)) for i in range(n)]
    pairs = spatial._measured_pairs(table(spark, [("a", [ring(0)])]), table(spark, [("b", [ring(0.5)])]).withColumnRenamed("id", "rid"), "id", "rid", "rings")
    half = math.acos(0.25)
    assert pairs.first().overlap == pytest.approx(2 * half - 0.5 * math.sin(half) * 1, rel=1e-3)


@pytest.mark.parametrize("cell", [0.4, 2.0, 30.0])
def test_overlap_is_symmetric_and_own_area(spark, cell):
    rng = random.Random(11)
    left = [(f"l{i}", [star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), 2)]) for i in range(4)]
    right = [(f"r{i}", [star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), 2)]) for i in range(4)]
    there, back = areas(spark, left, right, cell), areas(spark, right, left, cell)
    assert {(b, a): v for (a, b), v in there.items()} == pytest.approx(back)
    own = areas(spark, left, left, cell)
    size = {r.id: r.a for r in table(spark, left).select("id", G.polygon_area("rings").alias("a")).collect()}
    for n, a in size.items():
        assert own[(n, n)] == pytest.approx(a)


def test_overlap_agrees_with_sampling(spark):
    rng = random.Random(2)
    a, b = star(rng, 0, 0, 2), star(rng, 0.5, 0.3, 2)
    area = areas(spark, [("a", [a])], [("b", [b])], 1.0)[("a", "b")]
    n = 40000
    hits = sum(
        within(x, y, [a]) and within(x, y, [b])
        for x, y in ((rng.uniform(-2, 3), rng.uniform(-2, 3)) for _ in range(n))
    )
    assert area == pytest.approx(25 * hits / n, rel=0.06)


def test_largest_overlap_and_left_rows(spark):
    left = table(spark, [("l", [SQUARE]), ("far", [[(x + 90, y) for x, y in SQUARE]])])
    right = table(spark, [("r1", [[(x + 1, y) for x, y in SQUARE]]), ("r2", [[(x + 3, y) for x, y in SQUARE]])])
    right = right.withColumnRenamed("id", "rid").withColumn("name", F.upper("rid"))
    got = spatial.largest_overlap_join(left, right, "id", "rid", ["name"], cell=2.0)
    assert {(r.id, r.rid, r.name) for r in got.collect()} == {("l", "r1", "R1"), ("far", None, None)}
    touched = table(spark, [("t", [[(x - 3.5, y) for x, y in SQUARE]]), ("u", [[(x - 4, y) for x, y in SQUARE]])])
    only = right.filter("rid = 'r1'").unionByName(table(spark, [("r0", [SQUARE])]).select(F.col("id").alias("rid"), "rings", F.lit("x").alias("name")))
    best = {r.id: (r.rid, round(r.overlap, 9)) for r in spatial.largest_overlap(touched, only, "id", "rid").collect()}
    assert best == {"t": ("r0", 2.0), "u": ("r0", 0.0)}
    every = spatial.polygon_overlap_join(left, right, "id", "rid", cell=2.0)
    assert sorted((r.id, str(r.rid)) for r in every.collect()) == [("far", "None"), ("l", "r1"), ("l", "r2")]


def test_scalars(spark):
    row = table(spark, [("h", [SQUARE, HOLE])]).select(
        G.polygon_area("rings").alias("a"), G.centroid("rings").alias("c"),
        F.struct(*[v.alias(n) for n, v in G.bounds("rings").items()]).alias("b"),
    ).first()
    assert row.a == pytest.approx(12) and (row.c.x, row.c.y) == pytest.approx((2, 2))
    assert tuple(row.b) == (0.0, 0.0, 4.0, 4.0)


def test_orientation_is_normalized(spark):
    clockwise = SQUARE[::-1]
    df = table(spark, [("a", [clockwise, HOLE[::-1]])]).withColumn("rings", G.orient_polygon("rings"))
    assert df.select(G.polygon_area("rings")).first()[0] == pytest.approx(12)


def test_mercator_round_trip(spark):
    df = spark.createDataFrame([(-87.6, 41.8), (0.0, 0.0), (179.0, -70.0)], "lon double, lat double")
    back = df.select("lon", "lat", G.to_web_mercator("lon", "lat").alias("m")).withColumn("b", G.to_lonlat("m.x", "m.y"))
    for r in back.collect():
        assert (r.b.x, r.b.y) == pytest.approx((r.lon, r.lat), abs=1e-9)
    assert back.first().m.x == pytest.approx(-9751587.39, abs=0.5)


def test_far_polygons_leave_before_cells_are_made(spark, rows, monkeypatch):
    near = [("a", [SQUARE, HOLE]), ("b", [[(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]])]
    far = [(f"f{i}", [[(x + 100.0 * i, y) for x, y in SQUARE]]) for i in range(1, 60)]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 3.5, 3.5), (4, None, 1.0), (5, 50.0, 3.0)], "n int, lon double, lat double")
    all_of_them, some = (table(spark, p).withColumnRenamed("id", "area") for p in (near + far, near))
    room = spatial.plan_grid(some, ["area"], size=1.0).cell_bytes
    monkeypatch.setattr(spatial, "MAX_BROADCAST", room)
    assert not spatial.plan_grid(all_of_them, ["area"], size=1.0).small
    out = spatial.point_in_polygon_join(points, all_of_them, ["area"], cell=1.0)
    assert rows(out.select("n", "area")) == rows(spatial.point_in_polygon_join(points, some, ["area"], cell=1.0).select("n", "area"))
    assert rows(out.select("n", "area")) == sorted([(1, "a"), (2, None), (3, "a"), (3, "b"), (4, None), (5, None)], key=repr)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    nowhere = points.where("lon IS NULL")
    assert rows(spatial.point_in_polygon_join(nowhere, all_of_them, ["area"], cell=1.0).select("n", "area")) == [(4, None)]


def test_places_are_worked_out_once_for_all_tables(spark, rows, no_broadcast, tmp_path):
    spark.createDataFrame([(n, float(n % 5), float(n % 4) + 0.5) for n in range(40)], "n int, lon double, lat double").write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    tables = {k: (table(spark, [(k, [SQUARE])]).withColumnRenamed("id", k), [k], 1.0) for k in ("a", "b", "c")}
    out = spatial.enrich_areas(points, tables)
    want = sorted(((n, *["abc"[i] if 0 < n % 5 < 4 else None for i in range(3)]) for n in range(40)), key=repr)
    assert rows(out.select("n", "a", "b", "c")) == want
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_few_edges_as_columns_decide_like_a_list(spark):
    rng = random.Random(7)
    ring = [(0.1, 0.1), (0.7, 0.1), (0.7, 0.7), (0.4, 0.3)]
    spots = [(x / 10, y / 10) for x in range(9) for y in range(9)] + [(rng.uniform(0, 0.8), rng.uniform(0, 0.8)) for _ in range(200)]
    spots += [(float("nan"), 0.3), (0.3, float("nan")), (float("inf"), 0.3)]
    df = spark.createDataFrame(spots, "px double, py double").crossJoin(table(spark, [("a", [ring])]))
    df = df.withColumn("all", G.edges("rings")).selectExpr("*", *(f"get(all, {i}) AS e{i}" for i in range(5)), "slice(all, 1, 0) AS none", "slice(all, 3, 9) AS rest")
    df = df.select(
        "px", "py", G.inside("px", "py", "all").alias("list"), G.inside("px", "py", "none", [f"e{i}" for i in range(5)]).alias("few"),
        G.inside("px", "py", "rest", ["e0", "e1"]).alias("both"),
    )
    for r in df.collect():
        assert r["list"] == r["few"] == r["both"], r
