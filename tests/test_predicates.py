"""Orientation, touch and containment of near-collinear points against exact rationals."""

import random
from fractions import Fraction

import pytest

from civicframe.functions import geometry as G
from civicframe.operators.spatial import _edges_meet, point_in_polygon_join


def turn(a, b, p):
    (ax, ay), (bx, by), (px, py) = (tuple(map(Fraction, v)) for v in (a, b, p))
    d = (ax - px) * (by - py) - (ay - py) * (bx - px)
    return (d > 0) - (d < 0)


def near_collinear(rng):
    """An edge of some degrees, and a point within a few units in the last place, or 1e-9 degrees, of it."""
    a = (-87.6 + rng.random() * 0.2, 41.8 + rng.random() * 0.2)
    b = (a[0] + rng.uniform(-1, 1) * rng.choice([1e-6, 0.01, 1]), a[1] + rng.uniform(-1, 1) * rng.choice([1e-6, 0.01, 1]))
    t = rng.choice([0.0, 0.5, 1.0, rng.random(), rng.uniform(-1, 2)])
    off = rng.choice([0.0, 0.0, 1e-9, 1e-14, 3e-15])
    p = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]) + rng.choice([-1, 1]) * off)
    return a, b, p


def test_turns(spark):
    rng = random.Random(11)
    cases = [near_collinear(rng) for _ in range(3000)]
    # Exactly on the line by construction, on a grid that doubles hold, and coordinates of very unlike size.
    for _ in range(500):
        x, y, dx, dy = (rng.randint(-1000, 1000) / 64 for _ in range(4))
        k = rng.randint(-4, 4)
        cases.append(((x, y), (x + dx, y + dy), (x + k * dx, y + k * dy)))
        cases.append(((x, y), (x + dx, y + dy), (x + k * dx, y + k * dy + rng.choice([0, 2.0**-40, -(2.0**-44)]))))
        cases.append(((1e-12 * x, y), (x + dx, 1e9 + y), (rng.random(), rng.random() * 1e-9)))
    unit = 2.0**-53
    cases += [((0.5 + i * unit, 0.5 + j * unit), (12.0, 12.0), (24.0, 24.0)) for i in range(40) for j in range(40)]
    rows = [(i, *a, *b, *p) for i, (a, b, p) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, ax double, ay double, bx double, by double, px double, py double")
    got = df.selectExpr("i", f"{G.turn_sign(('ax', 'ay'), ('bx', 'by'), ('px', 'py'))} AS s").collect()
    expected = [turn(*c) for c in cases]
    assert [int(r.s) for r in sorted(got)] == expected
    plain = [(bx - ax) * (py - ay) - (by - ay) * (px - ax) for _, ax, ay, bx, by, px, py in rows]
    assert sum(((d > 0) - (d < 0)) != e for d, e in zip(plain, expected, strict=True)) > 100  # plain doubles are not enough


def on_segment(a, b, p):
    return turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def meet(a, b, c, d):
    crossing = turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0
    return crossing or on_segment(a, b, c) or on_segment(a, b, d) or on_segment(c, d, a) or on_segment(c, d, b)


def test_edges_meet(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(1500):
        a, b, p = near_collinear(rng)
        _, _, q = near_collinear(rng)
        cases += [(a, b, p, q), (a, b, p, a), (a, b, b, q), (a, b, p, (p[0] + 1e-9, p[1]))]
    cases = [c for c in cases if c[0] != c[1] and c[2] != c[3]]
    rows = [(i, *({"ax": float(u[0]), "ay": float(u[1]), "bx": float(v[0]), "by": float(v[1])} for u, v in (c[:2], c[2:]))) for i, c in enumerate(cases)]
    edge = "struct<ax: double, ay: double, bx: double, by: double>"
    got = spark.createDataFrame(rows, f"i int, e {edge}, f {edge}").selectExpr("i", f"{_edges_meet('e', 'f')} AS m").collect()
    wrong = [i for i, m in sorted(map(tuple, got)) if m != meet(*cases[i])]
    assert not wrong, [cases[i] for i in wrong[:3]]


def contains(ring, p):
    """Strictly within, by exact crossings."""
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    if any(on_segment(a, b, p) for a, b in edges):
        return False
    odd = False
    for a, b in edges:
        if (a[1] > p[1]) != (b[1] > p[1]):
            odd ^= turn(a, b, p) == (1 if b[1] > a[1] else -1)
    return odd


@pytest.mark.parametrize("cell", [None, 0.01])
def test_points_beside_shared_edges(spark, cell):
    """Two areas share slanted edges; points lie on them, or 1e-9 degrees and single units of rounding beside them."""
    rng = random.Random(9)
    line = [(-87.7 + i * 0.013, 41.8 + rng.random() * 0.05) for i in range(8)]
    low = [*line, (line[-1][0], 41.7), (line[0][0], 41.7)]
    high = [*reversed(line), (line[0][0], 41.95), (line[-1][0], 41.95)]
    points = []
    for _ in range(1200):
        k = rng.randrange(len(line) - 1)
        t, (a, b) = rng.choice([0.0, 0.5, 1.0, rng.random()]), (line[k], line[k + 1])
        points.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]) + rng.choice([0, 0, 1e-9, -1e-9, 7e-15, -7e-15])))
    areas = spark.createDataFrame([(n, [[{"x": x, "y": y} for x, y in r]]) for n, r in (("low", low[::-1]), ("high", high[::-1]))], f"area string, rings {G.RINGS_TYPE}")
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lon double, lat double")
    got = {(r.i, r.area) for r in point_in_polygon_join(df, areas, ["area"], cell=cell).collect()}
    expected = set()
    for i, p in enumerate(points):
        found = [n for n, r in (("low", low), ("high", high)) if contains(r, p)]
        expected |= {(i, n) for n in found or [None]}
    assert got == expected
