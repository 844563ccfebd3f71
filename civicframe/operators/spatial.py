"""Spatial joins as equi-joins on grid cells.

Polygon tables hold a ``rings`` column (see ``functions.geometry``). The grid is only a
means to find candidates: results do not depend on the cell size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import reliable_checkpoint
from .groups import first_per_group
from .joins import keys_to_salt, null_safe_join, spread_join

# Cell tables whose measured size is below this are broadcast, larger ones are shuffled.
MAX_BROADCAST = 64 * 1024 * 1024
# Cells along a side of a polygon, at most about: larger polygons take cells of twice, four times ... the size.
PER_SIDE = 64
# Edges of a cell that are kept as columns.
FEW = 3
# Edges of a pair's polygons that meet in a strip, about.
PER_STRIP = 8


@dataclass(frozen=True)
class Grid:
    """Cell size, the doublings of it that polygons need, and an upper bound of the cell table's bytes."""

    size: float
    levels: tuple[int, ...]
    cell_bytes: float

    @property
    def small(self) -> bool:
        return self.cell_bytes <= MAX_BROADCAST


def _doublings(side: Column, size: float) -> Column:
    """How often the cell size is doubled until a side has ``PER_SIDE`` cells or fewer."""
    return F.greatest(F.ceil(F.log2(F.nullif(side, F.lit(0.0)) / (size * PER_SIDE))), F.lit(0)).cast("int")


def plan_grid(polygons: DataFrame, attrs: Sequence[str], rings: str = "rings", size: float | None = None) -> Grid:
    """Measure a polygon table; each aggregate returns a row, or one per level in use.

    Without ``size``, a polygon of median size gets as many cells as leave few edges in each. The
    bytes are bounded from above: every cell of each polygon's box, and for each edge all cells of
    the rows that it reaches into.
    """
    box = G.bounds(rings)
    measured = polygons.select(
        *(F.octet_length(F.col(f"`{a}`").cast("string")).alias(f"__w{i}") for i, a in enumerate(attrs)),
        (box["x1"] - box["x0"]).alias("w"),
        (box["y1"] - box["y0"]).alias("h"),
        G.edges(rings).alias("e"),
    )
    if size is None:
        row = measured.agg(
            F.percentile_approx(F.greatest("w", "h"), 0.5).alias("side"),
            F.percentile_approx(F.size("e"), 0.5).alias("edges"),
        ).first()
        cuts = max(4, min(PER_SIDE, 2 * math.isqrt(int(row.edges or 0))))
        size = float(row.side) / cuts if row.side else 1.0
    level = F.coalesce(_doublings(F.greatest("w", "h"), size), F.lit(0))
    step = F.pow(F.lit(2.0), F.col("level")) * size
    text = sum((F.coalesce(F.col(f"__w{i}"), F.lit(0)) for i in range(len(attrs))), F.lit(0))
    wide = F.ceil(F.col("w") / step) + 2
    tall = F.ceil(F.col("h") / step) + 2
    reach = F.aggregate("e", F.lit(0.0), lambda t, e: t + F.abs(e.by - e.ay) / F.col("step") + 3)
    sized = measured.withColumn("level", level).withColumn("step", step)
    sized = sized.select("level", (wide * tall * (160 + 32 * len(attrs) + text) + wide * reach * 48).alias("b"))
    rows = sized.groupBy("level").agg(F.sum("b").alias("b")).collect()
    return Grid(size, tuple(sorted(r["level"] for r in rows)), float(sum(r["b"] or 0 for r in rows)))


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size))


def _cell_range(low: str, high: str, size: float) -> Column:
    """All cell numbers between two coordinates, given as SQL."""
    return F.expr(f"sequence(floor(({low}) / {size!r}D), floor(({high}) / {size!r}D))")


def polygon_cells(polygons: DataFrame, attrs: Sequence[str], rings: str, size: float) -> DataFrame:
    """One row per grid cell that a polygon reaches into.

    A cell without edges is wholly inside (``__whole``) or left out. The others carry only the
    edges that a ray to the right from a point of the cell can meet: the first few as columns,
    further ones in ``__rest``.
    """
    slack = size * 1e-6
    box = G.bounds(rings)
    base = polygons.select(
        *attrs,
        G.edges(rings).alias("__edges"),
        *[c.alias(f"__{n}") for n, c in box.items()],
    )
    rows = base.withColumn(
        "__cy", F.explode(_cell_range(f"__y0 - {slack!r}D", f"__y1 + {slack!r}D", size))
    )
    in_row = F.expr(
        f"filter(__edges, e -> greatest(e.ay, e.by) >= __cy * {size!r}D - {slack!r}D"
        f" AND least(e.ay, e.by) <= (__cy + 1) * {size!r}D + {slack!r}D)"
    )
    rows = rows.withColumn("__edges", in_row).filter("size(__edges) > 0")
    cells = rows.withColumn(
        "__cx", F.explode(_cell_range(f"__x0 - {slack!r}D", f"__x1 + {slack!r}D", size))
    )
    to_right = F.expr(f"filter(__edges, e -> greatest(e.ax, e.bx) >= __cx * {size!r}D - {slack!r}D)")
    cells = cells.withColumn("__edges", to_right)
    crossed = F.expr(f"exists(__edges, e -> least(e.ax, e.bx) <= (__cx + 1) * {size!r}D + {slack!r}D)")
    centre = G.inside(f"((__cx + 0.5D) * {size!r}D)", f"((__cy + 0.5D) * {size!r}D)", "__edges")
    cells = cells.withColumn("__whole", ~crossed).filter(~F.col("__whole") | centre)
    few = [F.when(~F.col("__whole"), F.get("__edges", i)).alias(f"__e{i}") for i in range(FEW)]
    start = F.when(F.col("__whole"), F.size("__edges") + 1).otherwise(F.lit(FEW + 1))
    rest = F.slice("__edges", start, F.size("__edges"))
    return cells.select(*attrs, "__cx", "__cy", "__whole", *few, rest.alias("__rest"))


def in_reach(polygons: DataFrame, points: DataFrame, lon: str, lat: str, rings: str = "rings") -> DataFrame:
    """Polygons whose box meets the box of all points, for which the points are read once; no other can hold one."""
    ends = [f(c) for c in (lon, lat) for f in (F.min, F.max)]
    x0, x1, y0, y1 = points.select(lon, lat).dropna().agg(*ends).first()
    if x0 is None:
        return polygons.where(F.lit(False))
    box = G.bounds(rings)
    return polygons.where((box["x0"] <= x1) & (box["x1"] >= x0) & (box["y0"] <= y1) & (box["y1"] >= y0))


def point_in_polygon_join(
    points: DataFrame,
    polygons: DataFrame,
    attrs: Sequence[str],
    lon: str = "lon",
    lat: str = "lat",
    rings: str = "rings",
    cell: float | None = None,
    how: str = "left",
    origin: DataFrame | None = None,
) -> DataFrame:
    """Attach ``attrs`` of every polygon that a point lies strictly within.

    ``origin`` is the table the points were made from, with the same coordinates, where counting
    points per cell is cheaper. Polygons that no point can be in are left out before a cell table too
    large to broadcast is made. Points without coordinates or outside all polygons stay, with missing attributes, unless
    ``how`` is inner; a point within several polygons is repeated.
    """
    clash = set(attrs) & set(points.columns)
    if clash:
        raise ValueError(f"points already have {sorted(clash)}")
    grid = plan_grid(polygons, attrs, rings, cell)
    if not grid.small:
        polygons = in_reach(polygons, points if origin is None else origin, lon, lat, rings)
        grid = plan_grid(polygons, attrs, rings, cell)
    if len(grid.levels) > 1:
        # Points are keyed once per level in use, so each place is looked up once, then attached.
        spots = points.select(lon, lat).dropna().distinct()
        found = _within_cells(spots, polygons, attrs, lon, lat, rings, grid, "inner", None)
        return spread_join(points, found, [lon, lat], how)
    return _within_cells(points, polygons, attrs, lon, lat, rings, grid, how, origin)


def _within_cells(
    points: DataFrame,
    polygons: DataFrame,
    attrs: Sequence[str],
    lon: str,
    lat: str,
    rings: str,
    grid: Grid,
    how: str,
    origin: DataFrame | None,
) -> DataFrame:
    box = G.bounds(rings)
    side = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    levels = grid.levels or (0,)
    parts = []
    for level in levels:
        own = polygons
        if len(levels) > 1:
            own = polygons.where(F.coalesce(_doublings(side, grid.size), F.lit(0)) == level)
        cut = polygon_cells(own, attrs, rings, grid.size * 2.0**level)
        parts.append(cut.withColumn("__level", F.lit(level)))
    cells = reduce(DataFrame.union, parts)

    def placed(df: DataFrame) -> DataFrame:
        at = [
            F.struct(
                F.lit(level).alias("level"),
                _cell(F.col(lon), grid.size * 2.0**level).alias("cx"),
                _cell(F.col(lat), grid.size * 2.0**level).alias("cy"),
            )
            for level in levels
        ]
        # One level needs no explode, which keeps a left join whole.
        df = df.withColumn("__at", at[0] if len(at) == 1 else F.explode(F.array(*at)))
        return df.withColumns({"__level": F.col("__at.level"), "__cx": F.col("__at.cx"), "__cy": F.col("__at.cy")}).drop("__at")

    few = [f"__e{i}" for i in range(FEW)]
    within = F.col("__whole") | G.inside(f"`{lon}`", f"`{lat}`", "__rest", few)
    source = None if origin is None else placed(origin)
    keys = ["__level", "__cx", "__cy"]
    joined = spread_join(placed(points), cells, keys, how, within, grid.small, source)
    return joined.drop("__whole", "__rest", *keys, *few)


def enrich_areas(
    points: DataFrame,
    areas: Mapping[str, tuple[DataFrame, Sequence[str], float | None]],
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """Attach several polygon tables to one set of points: name to (polygons, attrs, cell).

    Each place is looked up once in all tables; its areas are then joined to the points by place.
    Places are counted once and written to the checkpoint folder, so that the points, which may take
    long to work out, are read twice however many tables there are.
    """
    added = [a for _, attrs, _ in areas.values() for a in attrs]
    clash = set(added) & set(points.columns)
    if clash or len(added) != len(set(added)):
        raise ValueError(f"points already have {sorted(clash)}, or two tables add one name")
    counted = reliable_checkpoint(points.groupBy(lon, lat).agg(F.count(F.lit(1)).alias("__n")))
    spots = counted.select(lon, lat).dropna()
    found = spots
    for polygons, attrs, cell in areas.values():
        found = point_in_polygon_join(found, polygons, attrs, lon, lat, cell=cell, origin=spots)
    return spread_join(points, found, [lon, lat], "left", hot=keys_to_salt(counted, [lon, lat]))


def _edges_meet(a: str, b: str) -> str:
    """The two closed edges have a point in common, whatever rounding does: the turns' signs are exact."""
    ends = lambda e: ((f"{e}.ax", f"{e}.ay"), (f"{e}.bx", f"{e}.by"))
    turns_b = [f"({G.turn_sign(*ends(a), p)})" for p in ends(b)]
    turns_a = [f"({G.turn_sign(*ends(b), p)})" for p in ends(a)]
    beside = " AND ".join(
        f"greatest({a}.a{c}, {a}.b{c}) >= least({b}.a{c}, {b}.b{c}) AND greatest({b}.a{c}, {b}.b{c}) >= least({a}.a{c}, {a}.b{c})"
        for c in ("x", "y")
    )
    return f"({beside} AND {turns_b[0]} * {turns_b[1]} <= 0 AND {turns_a[0]} * {turns_a[1]} <= 0)"


def _strip_areas(pairs: DataFrame) -> DataFrame:
    """Add ``__area``: signed area below both edges ``__a, __b`` and above ``__base``, within the pair's strip.

    ``__meet``: whether the edges meet. Steps that are used several times are columns of their own.
    """

    def height(at: str, e: str) -> str:
        return f"{e}.ay + ({e}.by - {e}.ay) * ({at} - {e}.ax) / ({e}.bx - {e}.ax) - __base"

    ranged = pairs.selectExpr(
        "*",
        "greatest(least(__a.ax, __a.bx), least(__b.ax, __b.bx), __from) AS __lo",
        "least(greatest(__a.ax, __a.bx), greatest(__b.ax, __b.bx), __to) AS __hi",
        "IF((__a.bx < __a.ax) = (__b.bx < __b.ax), 1.0D, -1.0D) AS __sign",
        f"{_edges_meet('__a', '__b')} AS __meet",
    )
    heights = ranged.selectExpr(
        "*",
        *(f"IF(__lo < __hi, {height(at, e)}, 0.0D) AS {name}" for name, at, e in (
            ("__a0", "__lo", "__a"), ("__a1", "__hi", "__a"), ("__b0", "__lo", "__b"), ("__b1", "__hi", "__b"))),
    )
    lower = heights.selectExpr(
        "*",
        "__a0 - __b0 AS __d0",
        "__a1 - __b1 AS __d1",
        "least(__a0, __b0) AS __m0",
        "least(__a1, __b1) AS __m1",
    ).selectExpr("*", "__d0 / nullif(__d0 - __d1, 0.0D) AS __t")
    # Height at which the two edges cross, used only where they do.
    meeting = "(__a0 + __t * (__a1 - __a0))"
    mean = (
        "CASE WHEN __d0 * __d1 >= 0 THEN (__m0 + __m1) / 2"
        f" ELSE (__t * (__m0 + {meeting}) + (1 - __t) * ({meeting} + __m1)) / 2 END"
    )
    area = f"IF(__lo < __hi, __sign * (__hi - __lo) * {mean}, 0.0D)"
    return lower.selectExpr("__lid", "__rid", "__unit", f"{area} AS __area", "__meet")


def _box_cells(df: DataFrame, key: str, rings: str, tag: str) -> DataFrame:
    """A polygon's id, box and level: the power of two its box fits in, or for far-off boxes one that can be numbered."""
    flat = df.select(
        F.col(key).alias(f"__{tag}id"),
        *[c.alias(f"__{tag}{n}") for n, c in G.bounds(rings).items()],
    )
    x0, y0, x1, y1 = (F.col(f"__{tag}{n}") for n in ("x0", "y0", "x1", "y1"))
    exponent = lambda v: F.coalesce(F.ceil(F.log2(F.nullif(v, F.lit(0.0)))), F.lit(-500))
    far = F.greatest(F.abs(x0), F.abs(y0), F.abs(x1), F.abs(y1))
    level = F.greatest(exponent(F.greatest(x1 - x0, y1 - y0)), exponent(far) - 50)
    return flat.withColumn(f"__{tag}level", level.cast("int")).where(x0.isNotNull() & y0.isNotNull())


def _candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rings: str) -> DataFrame:
    """``__lid, __rid`` and the boxes of pairs whose boxes have a point in common, each pair once.

    A box has four cells at most on the level it fits in, and on every coarser level in use. Pairs
    meet on the coarser of their two levels, in the cell of the shared box's lower left corner.
    """
    l, r = _box_cells(left, left_id, rings, "l"), _box_cells(right, right_id, rings, "r")
    # A number per power of two in use.
    levels = sorted(x[0] for x in l.select("__llevel").union(r.select("__rlevel")).distinct().collect())

    def on_levels(df: DataFrame, tag: str) -> DataFrame:
        steps = F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>")
        df = df.withColumn(f"__{tag}at", F.explode(F.filter(steps, lambda x: x >= F.col(f"__{tag}level"))))
        for axis in ("x", "y"):
            size = f"pow(2.0D, __{tag}at)"
            span = f"sequence(floor(__{tag}{axis}0 / {size}), floor(__{tag}{axis}1 / {size}))"
            df = df.withColumn(f"__{tag}c{axis}", F.explode(F.expr(span)))
        return df

    def c(name: str) -> Column:
        return F.col(f"__{name}")

    corner_x, corner_y = F.greatest(c("lx0"), c("rx0")), F.greatest(c("ly0"), c("ry0"))
    size = F.pow(F.lit(2.0), c("lat"))
    meets = (
        (c("lat") == F.greatest(c("llevel"), c("rlevel")))
        & (corner_x <= F.least(c("lx1"), c("rx1")))
        & (corner_y <= F.least(c("ly1"), c("ry1")))
        & (c("lcx") == F.floor(corner_x / size))
        & (c("lcy") == F.floor(corner_y / size))
    )
    cells = [("__lat", "__rat"), ("__lcx", "__rcx"), ("__lcy", "__rcy")]
    kept = [f"__{t}{n}" for t in "lr" for n in ("id", "x0", "y0", "x1", "y1")]
    return spread_join(on_levels(l, "l"), on_levels(r, "r"), cells, "inner", meets).select(*kept)


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    rings: str = "rings",
    cell: float | None = None,
) -> DataFrame:
    """``(left_id, right_id, overlap)`` of all polygon pairs that have a point in common.

    A pair counts when two of its edges meet or a ring of one begins inside the other, whatever its
    area; polygons that only touch overlap by 0. Both tables hold one row per id. The area is a sum
    over pairs of edges: each pair of polygons has its own strips along x, about as many as it has
    edges, edges meet by an equi-join on pair and strip, and so a pair of long boundaries spreads
    over tasks. ``cell`` has no effect on the result and is kept for callers that give it.
    """
    return _measured_pairs(left, right, left_id, right_id, rings).drop("__unit")


def _measured_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rings: str) -> DataFrame:
    def edge_rows(df: DataFrame, key: str, tag: str) -> DataFrame:
        begins = F.expr(f"transform(filter({rings}, r -> size(r) > 0), r -> r[0])")
        return df.select(F.col(key).alias(f"__{tag}id"), G.edges(rings).alias(f"__{tag}edges"), begins.alias(f"__{tag}begins"))

    boxes = _candidates(left, right, left_id, right_id, rings)
    with_edges = spread_join(boxes, edge_rows(left, left_id, "l"), "__lid", "inner")
    with_edges = spread_join(with_edges, edge_rows(right, right_id, "r"), "__rid", "inner", hot_source=boxes)
    inner = " OR ".join(
        f"exists(__{a}begins, p -> {G.inside_sql('p.x', 'p.y', f'__{b}edges')})" for a, b in (("l", "r"), ("r", "l"))
    )
    pairs = with_edges.selectExpr(
        "*",
        "greatest(__lx0, __rx0) AS __left",
        "least(__lx1, __rx1) - greatest(__lx0, __rx0) AS __wide",
        "least(__ly0, __ry0) AS __base",
        "(__lx1 - __lx0) * (__ly1 - __ly0) AS __unit",
        f"CAST(greatest(1, (size(__ledges) + size(__redges)) DIV {PER_STRIP}) AS BIGINT) AS __strips",
        f"coalesce({inner}, false) AS __inner",
    )

    def in_strips(tag: str, *more: str) -> DataFrame:
        rows = pairs.select("__lid", "__rid", "__left", "__wide", "__strips", *more, F.explode(f"__{tag}edges").alias("__e"))
        low, high = "least(__e.ax, __e.bx)", "greatest(__e.ax, __e.bx)"
        rows = rows.where(f"{high} >= __left AND {low} <= __left + __wide")
        number = lambda v: (
            f"IF(__wide > 0, least(greatest(CAST(floor(({v} - __left) / __wide * __strips) AS BIGINT), 0L), __strips - 1), 0L)"
        )
        return rows.withColumn("__strip", F.explode(F.expr(f"sequence({number(low)}, {number(high)})")))

    mine = in_strips("l", "__base", "__unit").withColumnRenamed("__e", "__a")
    mine = mine.withColumns(
        {
            # The strips divide the shared range, so each stretch of an edge counts in one of them.
            "__from": F.expr("__left + __wide * (__strip / __strips)"),
            "__to": F.expr("__left + __wide * ((__strip + 1) / __strips)"),
        }
    ).drop("__left", "__wide", "__strips")
    theirs = in_strips("r").select("__lid", "__rid", "__strip", F.col("__e").alias("__b"))
    measured = _strip_areas(mine.join(theirs, ["__lid", "__rid", "__strip"]))
    held = pairs.where("__inner").select("__lid", "__rid", "__unit", F.lit(0.0).alias("__area"), F.lit(True).alias("__meet"))
    return (
        measured.union(held)
        .groupBy("__lid", "__rid")
        .agg(F.greatest(F.sum("__area"), F.lit(0.0)).alias("overlap"), F.max("__unit").alias("__unit"), F.bool_or("__meet").alias("__any"))
        .where("__any")
        .select(F.col("__lid").alias(left_id), F.col("__rid").alias(right_id), "overlap", "__unit")
    )


def polygon_overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    attrs: Sequence[str] = (),
    how: str = "left",
    rings: str = "rings",
    cell: float | None = None,
) -> DataFrame:
    """Pair each polygon with all polygons it has a point in common with.

    Adds ``right_id``, ``attrs`` and ``overlap``; left polygons without a partner stay unless
    ``how`` is inner.
    """
    pairs = overlap_pairs(left, right, left_id, right_id, rings, cell)
    out = null_safe_join(left, pairs, left_id, how)
    if attrs:
        out = null_safe_join(out, right.select(right_id, *attrs), right_id, "left")
    return out


def largest_overlap(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    rings: str = "rings",
    cell: float | None = None,
) -> DataFrame:
    """``(left_id, right_id, overlap)`` of the polygon each left one shares most area with.

    Areas are compared as shares of the left polygon's box, to nine decimals; equal ones, and those
    of polygons that are only touched, go by ``right_id``.
    """
    pairs = _measured_pairs(left, right, left_id, right_id, rings)
    share = F.coalesce(F.col("overlap") / F.nullif("__unit", F.lit(0.0)), F.lit(0.0))
    ranked = pairs.withColumn("__less", -F.round(share, 9))
    return first_per_group(ranked, [left_id], [right_id, "overlap"], ["__less", right_id])


def largest_overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    attrs: Sequence[str] = (),
    rings: str = "rings",
    cell: float | None = None,
) -> DataFrame:
    """Attach the polygon of largest overlap; left polygons without one stay."""
    best = largest_overlap(left, right, left_id, right_id, rings, cell).drop("overlap")
    out = null_safe_join(left, best, left_id, "left")
    if attrs:
        out = null_safe_join(out, right.select(right_id, *attrs), right_id, "left")
    return out


def assign_areas(
    left: DataFrame,
    left_id: str,
    layers: Mapping[str, tuple[DataFrame, Sequence[str]]],
    rings: str = "rings",
    cell: float | None = None,
) -> DataFrame:
    """Attach the polygon of largest overlap from several layers: id column to (polygons, attrs).

    Every layer is worked out from the bare polygons of ``left``, then joined by id.
    """
    bare, out = left.select(left_id, rings), left
    for right_id, (polygons, attrs) in layers.items():
        best = largest_overlap(bare, polygons, left_id, right_id, rings, cell).drop("overlap")
        if attrs:
            best = null_safe_join(best, polygons.select(right_id, *attrs), right_id, "left")
        out = null_safe_join(out, best, left_id, "left")
    return out
