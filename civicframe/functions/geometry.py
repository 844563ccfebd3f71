"""Planar geometry on nested arrays, all as column expressions.

A polygon is ``rings: array<array<struct<x: double, y: double>>>``. Outer rings run
counter-clockwise and holes clockwise; ``orient`` brings a ring into either form. A ring
may or may not repeat its first vertex at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import _col

EARTH_RADIUS = 6378137.0
RINGS_TYPE = "array<array<struct<x:double,y:double>>>"


def point(x, y) -> Column:
    def as_double(v):
        return (v if isinstance(v, Column) else F.lit(v)).cast("double")

    return F.struct(as_double(x).alias("x"), as_double(y).alias("y"))


def _ring_edges(ring: Column) -> Column:
    shifted = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    joined = F.zip_with(
        ring,
        shifted,
        lambda a, b: F.struct(
            a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")
        ),
    )
    return F.filter(joined, lambda e: (e.ax != e.bx) | (e.ay != e.by))


def edges(rings: str) -> Column:
    """All edges of a polygon as ``array<struct<ax, ay, bx, by>>``, zero-length ones left out."""
    pair = "named_struct('ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y)"
    ring = f"zip_with(r, concat(slice(r, 2, size(r)), slice(r, 1, 1)), (a, b) -> {pair})"
    return F.expr(
        f"flatten(transform({rings}, r -> filter({ring}, e -> e.ax <> e.bx OR e.ay <> e.by)))"
    )


def _twice_signed_area(edge_list: Column, ox: Column, oy: Column) -> Column:
    return F.aggregate(
        edge_list,
        F.lit(0.0),
        lambda acc, e: acc + (e.ax - ox) * (e.by - oy) - (e.bx - ox) * (e.ay - oy),
    )


def _origin(rings: Column) -> tuple[Column, Column]:
    first = F.get(F.get(rings, 0), 0)
    return first.x, first.y


def orient(ring: Column, outer: Column) -> Column:
    """The ring running counter-clockwise when ``outer``, clockwise otherwise."""
    first = F.get(ring, 0)
    turn = _twice_signed_area(_ring_edges(ring), first.x, first.y)
    return F.when((turn > 0) == outer, ring).otherwise(F.reverse(ring))


def orient_polygon(rings: Column | str) -> Column:
    """Orient one polygon given as outer ring followed by its holes."""
    return F.transform(_col(rings), lambda ring, i: orient(ring, i == 0))


def polygon_area(rings: str) -> Column:
    return _twice_signed_area(edges(rings), *_origin(F.col(rings))) / 2


def centroid(rings: str) -> Column:
    """Area centroid as ``struct<x, y>``."""
    ox, oy = _origin(F.col(rings))

    def step(acc, e):
        cross = (e.ax - ox) * (e.by - oy) - (e.bx - ox) * (e.ay - oy)
        return F.struct(
            (acc.a + cross).alias("a"),
            (acc.x + cross * (e.ax + e.bx - ox * 2)).alias("x"),
            (acc.y + cross * (e.ay + e.by - oy * 2)).alias("y"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(
        edges(rings),
        zero,
        step,
        lambda s: F.struct(
            (ox + s.x / F.nullif(s.a * 3, F.lit(0.0))).alias("x"),
            (oy + s.y / F.nullif(s.a * 3, F.lit(0.0))).alias("y"),
        ),
    )


def bounds(rings: str) -> dict[str, Column]:
    """Bounding box as four columns ``x0, y0, x1, y1``."""
    return {
        f"{axis}{end}": F.expr(f"{fn}(transform(flatten({rings}), v -> v.{axis}))")
        for end, fn in ((0, "array_min"), (1, "array_max"))
        for axis in ("x", "y")
    }


#: Relative error that the sign of a difference of two products of differences of doubles can have:
#: (3 + 16 u) u with u = 2 ** -53, from the analysis of adaptive orientation tests.
TURN_ERROR = (3 + 16 * 2.0**-53) * 2.0**-53
#: Splits a double into two of 26 bits.
SPLITTER = 2.0**27 + 1


def _exact_turn(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    """Sign of the turn without any rounding: six products as pairs of doubles, added up as an expansion.

    A product's second double is what rounding took from the first. Doubles are added to a list of
    others without common bits, ascending; the last one that is not 0 has the sign of the sum.
    """
    pairs = ((ax, by, 1), (ax, py, -1), (px, by, -1), (ay, bx, -1), (ay, px, 1), (py, bx, 1))
    factors = ", ".join(f"named_struct('a', {'-' if s < 0 else ''}({a}), 'b', ({b}))" for a, b, s in pairs)
    high = lambda v: f"({SPLITTER!r}D * {v} - ({SPLITTER!r}D * {v} - {v}))"
    halves = f"transform(array({factors}), f -> named_struct('a', f.a, 'b', f.b, 'ah', {high('f.a')}, 'bh', {high('f.b')}))"
    lost = "(g.a - g.ah) * (g.b - g.bh) - (((g.a * g.b - g.ah * g.bh) - (g.a - g.ah) * g.bh) - g.ah * (g.b - g.bh))"
    terms = f"flatten(transform({halves}, g -> array(g.a * g.b, {lost})))"
    none = "CAST(array() AS array<double>)"
    error = "(s.x - ((s.x + y) - ((s.x + y) - s.x))) + (y - ((s.x + y) - s.x))"
    added = (
        f"aggregate(parts, named_struct('x', t, 'out', {none}),"
        f" (s, y) -> named_struct('x', s.x + y, 'out', concat(s.out, filter(array({error}), r -> r <> 0))),"
        " s -> concat(s.out, array(s.x)))"
    )
    parts = f"aggregate({terms}, {none}, (parts, t) -> {added})"
    return f"coalesce(sign(try_element_at(filter({parts}, r -> r <> 0), -1)), 0.0D)"


def turn_sign(a: tuple[str, str], b: tuple[str, str], p: tuple[str, str]) -> str:
    """SQL for the side of the line from ``a`` to ``b`` that ``p`` is on: 1 left, -1 right, 0 exactly on it.

    Doubles decide where their error cannot change the sign, exact sums elsewhere. Coordinates are SQL
    names or expressions of doubles, of a size whose products neither overflow nor vanish.
    """
    (ax, ay), (bx, by), (px, py) = a, b, p
    one, two = f"(({ax} - {px}) * ({by} - {py}))", f"(({ay} - {py}) * ({bx} - {px}))"
    sure = f"abs({one} - {two}) > {TURN_ERROR!r}D * (abs({one}) + abs({two}))"
    level = f"(({ax} = {px} OR {by} = {py}) AND ({ay} = {py} OR {bx} = {px}))"
    return f"CASE WHEN {sure} THEN sign({one} - {two}) WHEN {level} THEN 0.0D ELSE {_exact_turn(ax, ay, bx, by, px, py)} END"


def _side(px: str, py: str, e: str) -> str:
    return turn_sign((f"{e}.ax", f"{e}.ay"), (f"{e}.bx", f"{e}.by"), (px, py))


def _crossing(px: str, py: str, e: str) -> str:
    """The ray from the point to the right meets the edge."""
    return f"(({e}.ay > {py}) <> ({e}.by > {py}) AND ({_side(px, py, e)}) = IF({e}.by > {e}.ay, 1.0D, -1.0D))"


def _touching(px: str, py: str, e: str) -> str:
    """The point lies on the edge."""
    return (
        f"({px} BETWEEN least({e}.ax, {e}.bx) AND greatest({e}.ax, {e}.bx)"
        f" AND {py} BETWEEN least({e}.ay, {e}.by) AND greatest({e}.ay, {e}.by)"
        f" AND ({_side(px, py, e)}) = 0)"
    )


def _plain_crossing(px: str, py: str, e: str) -> tuple[str, str]:
    """Whether doubles leave open if the ray meets the edge or the point is on it; if not, whether the ray meets it."""
    one, two = f"({e}.ax - {px}) * ({e}.by - {py})", f"({e}.ay - {py}) * ({e}.bx - {px})"
    beside = f"(({e}.ay > {py}) <> ({e}.by > {py}))"
    # A point on an edge that goes across its height is not sure above; the others on an edge are in a level one's box or at an end.
    near = f"({py} = {e}.ay OR {py} = {e}.by)"
    open_ = f"({beside} OR {near}) AND NOT abs({one} - {two}) > {TURN_ERROR!r}D * (abs({one}) + abs({two}))"
    met = f"{beside} AND ({one} > {two}) = ({e}.by > {e}.ay)"
    return open_, met


def inside(px: str, py: str, edge_list: str, few: Sequence[str] = ()) -> Column:
    """``inside_sql`` as a column."""
    return F.expr(inside_sql(px, py, edge_list, few))


def inside_sql(px: str, py: str, edge_list: str, few: Sequence[str] = ()) -> str:
    """Point strictly within: odd crossings to the right, and on no edge.

    Arguments are SQL names or expressions. Edges may be given as columns in ``few``, which
    compile, with the others in ``edge_list``; a missing one counts as not met. Where there are no
    others and doubles decide every edge, which is nearly always, nothing else is evaluated.
    """
    left = f"size({edge_list}) > 0"
    crossed = f"IF({left}, size(filter({edge_list}, e -> {_crossing(px, py, 'e')})), 0)"
    touched = f"IF({left}, exists({edge_list}, e -> {_touching(px, py, 'e')}), false)"
    for e in few:
        crossed += f" + IF({_crossing(px, py, e)}, 1, 0)"
        touched = f"coalesce({_touching(px, py, e)}, false) OR {touched}"
    exact = f"(({crossed}) % 2 = 1 AND NOT ({touched}))"
    if not few:
        return exact
    plain = [_plain_crossing(px, py, e) for e in few]
    unsure = " OR ".join([left, *(f"coalesce({open_}, false)" for open_, _ in plain)])
    odd = f"({' + '.join(f'IF({met}, 1, 0)' for _, met in plain)}) % 2 = 1"
    return f"CASE WHEN {unsure} THEN {exact} ELSE {odd} END"


def to_web_mercator(lon: Column | str, lat: Column | str) -> Column:
    """Degrees to metres in spherical Mercator, as ``struct<x, y>``."""
    return point(
        _col(lon) * (EARTH_RADIUS * math.pi / 180),
        F.log(F.tan(_col(lat) * (math.pi / 360) + math.pi / 4)) * EARTH_RADIUS,
    )


def to_lonlat(x: Column | str, y: Column | str) -> Column:
    """Metres in spherical Mercator back to degrees, as ``struct<x, y>``."""
    return point(
        _col(x) * (180 / (EARTH_RADIUS * math.pi)),
        (F.atan(F.exp(_col(y) / EARTH_RADIUS)) * 2 - math.pi / 2) * (180 / math.pi),
    )


def reproject(rings: Column | str, fn) -> Column:
    """Apply ``to_web_mercator`` or ``to_lonlat`` to every vertex."""
    return F.transform(_col(rings), lambda ring: F.transform(ring, lambda v: fn(v.x, v.y)))


def distance_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2)) + F.cos(
        F.radians(lat1)
    ) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.asin(F.sqrt(a)) * (2 * EARTH_RADIUS / 1000)
