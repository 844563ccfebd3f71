"""Near-duplicate vectors by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .jaccard_join import Forest
from .store import components, dropped, stored, tasks

#: Radii of the levels below a block's root, each half of the one before.
RADII = (0.5, 0.25, 0.125)
#: Distances and bounds are compared with this much to spare; the decision on a pair is exact.
EPS = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows on the unit sphere; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit rows."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row the row that stands for it: within ``radius``; those that stand are further apart. Row 0 is one."""
    of = np.full(len(x), -1)
    limit = 1.0 - radius * radius / 2
    for i in range(len(x)):
        if of[i] < 0:
            near = (x @ x[i] >= limit) & (of < 0)
            of[near] = i
            of[i] = i
    return of


def top_centres(x: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` rows: the nested nets of halving radii, coarse ones first."""
    chosen, gap, radius = [0], apart(x, x[:1])[:, 0], 2.0
    while len(chosen) < min(most, len(x)) and radius > 1e-3:
        far = int(gap.argmax())
        if gap[far] <= radius:
            radius /= 2
            continue
        chosen.append(far)
        gap = np.minimum(gap, apart(x, x[far : far + 1])[:, 0])
    return x[chosen]


def tree_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which every node is a run with its centre first, and the node's number by level and row."""
    order = np.arange(len(x))
    paths = np.zeros((len(RADII), len(x)), np.int64)
    runs = [(0, len(x))]
    for level, radius in enumerate(RADII):
        split, number = [], 0
        for lo, hi in runs:
            of = net(x[order[lo:hi]], radius) if hi - lo > 1 else np.zeros(1, int)
            by = np.lexsort((np.arange(hi - lo) != of, of))
            order[lo:hi], of = order[lo:hi][by], of[by]
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for a, b in zip(edge, [*edge[1:], hi - lo], strict=True):
                paths[level, lo + a : lo + b] = number
                split.append((lo + a, lo + b))
                number += 1
        runs = split
    return order, paths


class Tree:
    """A block's rows in tree order; per level the runs' starts and ends and their covering radii."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, paths: np.ndarray):
        self.x, self.weight = x, weight
        self.sum = np.concatenate([[0], np.cumsum(weight)])
        self.levels = []
        for path in [np.zeros(len(x), int), *paths]:
            start = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            end = np.append(start[1:], len(x))
            centre = np.repeat(start, end - start)
            gap = np.sqrt(np.maximum(2.0 - 2.0 * (x * x[centre]).sum(1), 0.0))
            self.levels.append((start, end, np.maximum.reduceat(gap, start)))


def dual(a: Tree, b: Tree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Weighted numbers of links of the rows of ``a`` and ``b``, and trees over the rows of both.

    A pair of nodes whose centres are further apart than the threshold's distance and both radii is
    dropped; one that is within the distance even with both radii is linked as a whole; others are
    looked at one level down, and pairs of rows at the end. ``same``: ``a`` is ``b``.
    """
    t = float(np.sqrt(2.0 - 2.0 * threshold))
    shift = 0 if same else len(a.x)
    forest = Forest(len(a.x) + (0 if same else len(b.x)))
    links_a, links_b = np.zeros(len(a.x) + 1), np.zeros(len(b.x) + 1)
    with_itself = np.zeros(len(a.x) + 1)
    whole: set[tuple[int, int]] = set()

    def all_linked(lo: int, hi: int, lo2: int, hi2: int) -> None:
        own, other = a.sum[hi] - a.sum[lo], b.sum[hi2] - b.sum[lo2]
        links_a[lo] += other
        links_a[hi] -= other
        if same and lo == lo2:
            with_itself[lo] += 1
            with_itself[hi] -= 1
        else:
            links_b[lo2] += own
            links_b[hi2] -= own
        for p, q in ((lo, hi), (lo2 + shift, hi2 + shift)):
            if (p, q) not in whole:
                whole.add((p, q))
                for i in range(p + 1, q):
                    forest.join(p, i)
        forest.join(lo, lo2 + shift)

    rows_a, rows_b = np.zeros(len(a.x)), np.zeros(len(b.x))

    def rows(lo: int, hi: int, others: np.ndarray) -> None:
        """Rows ``lo`` to ``hi`` of ``a`` against the rows ``others`` of ``b``."""
        for s in range(lo, hi, 256):
            e = min(s + 256, hi)
            near = a.x[s:e] @ b.x[others].T >= threshold
            itself = (others >= lo) & (others < hi) & same
            if same:
                near &= others[None, :] != np.arange(s, e)[:, None]
            hit = near.any(0)
            if not hit.any():
                continue
            near, column, itself = near[:, hit], others[hit], itself[hit]
            rows_a[s:e] += near @ b.weight[column]
            rows_b[column[~itself]] += a.weight[s:e] @ near[:, ~itself]
            left = near.any(1)
            while left.any():
                group = np.zeros(e - s, bool)
                group[int(left.argmax())] = True
                while True:
                    columns = near[group].any(0)
                    wider = near[:, columns].any(1)
                    if (wider == group).all():
                        break
                    group = wider
                first = s + int(group.argmax())
                for i in np.flatnonzero(group):
                    forest.join(first, s + int(i))
                for j in column[columns]:
                    forest.join(first, int(j) + shift)
                left &= ~group

    def members(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """All numbers of the given ranges."""
        size = end - start
        return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())

    # A node of `a` with all nodes of `b` that it has to be compared with.
    waiting = [(0, np.zeros(1, np.int64))]
    for level in range(len(RADII)):
        (sa, ea, _), (sb, eb, _) = a.levels[level], b.levels[level]
        (ca, da, ra), (cb, db, rb) = a.levels[level + 1], b.levels[level + 1]
        first_a, last_a = np.searchsorted(ca, sa), np.searchsorted(ca, ea)
        first_b, last_b = np.searchsorted(cb, sb), np.searchsorted(cb, eb)
        below = []
        for i, others in waiting:
            theirs = members(first_b[others], last_b[others])
            centres = b.x[cb[theirs]]
            for s in range(first_a[i], last_a[i], 256):
                e = min(s + 256, last_a[i])
                gap = apart(a.x[ca[s:e]], centres)
                reach = ra[s:e, None] + rb[None, theirs]
                near = gap <= reach + t + EPS
                inside = gap + reach < t - EPS
                if same:  # each unordered pair of nodes once
                    near &= np.arange(s, e)[:, None] <= theirs[None, :]
                for p, q in np.argwhere(near & inside):
                    all_linked(int(ca[s + p]), int(da[s + p]), int(cb[theirs[q]]), int(db[theirs[q]]))
                near &= ~inside
                below += [(s + int(p), theirs[near[p]]) for p in np.flatnonzero(near.any(1))]
        waiting = below
    (sa, ea, _), (sb, eb, _) = a.levels[-1], b.levels[-1]
    for i, others in waiting:
        rows(int(sa[i]), int(ea[i]), members(sb[others], eb[others]))
    got_a, got_b = np.cumsum(links_a[:-1]) + rows_a, np.cumsum(links_b[:-1]) + rows_b
    if same:
        return got_a + got_b - np.cumsum(with_itself[:-1]) * a.weight, got_b[:0], forest
    return got_a, got_b, forest


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, from batches in which equal keys are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(new), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


#: Vectors that are longer are not turned: the matrix would be large.
TURNED = 1_024
#: Bytes of a sketch beside one a component: the step and the error, in single precision.
MORE = 8
#: What sums of products in single precision may be off by.
SINGLE = 2e-5
#: Sketches that are compared at once, a side.
TILE = 1_024


@cache
def turn(width: int) -> np.ndarray | None:
    """A fixed rotation; after it no component says much more than others."""
    return np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))[0] if width <= TURNED else None


def sketches(x: np.ndarray) -> np.ndarray:
    """Unit rows turned, a byte a component, with the step and the distance between row and sketch at the end."""
    turned = x if turn(x.shape[1]) is None else x @ turn(x.shape[1])
    step = (np.abs(turned).max(1, keepdims=True) / 127).astype(np.float32)
    steps = np.clip(np.rint(turned / step), -127, 127).astype(np.int8)
    error = np.sqrt(((turned - steps * step.astype(float)) ** 2).sum(1, keepdims=True)) * (1 + EPS) + EPS
    return np.concatenate([steps.view(np.uint8), step.view(np.uint8), error.astype(np.float32).view(np.uint8)], axis=1)


def opened(sketch: np.ndarray, most: int | None = None) -> np.ndarray:
    """The rows that sketches stand for, in single precision; their first ``most`` components."""
    width = sketch.shape[1] - MORE
    return sketch[:, :width][:, :most].view(np.int8) * np.ascontiguousarray(sketch[:, width : width + 4]).view(np.float32)


def errors(sketch: np.ndarray) -> np.ndarray:
    """How far each sketch is from its vector, at most."""
    return np.ascontiguousarray(sketch[:, -4:]).view(np.float32)[:, 0]


def bytes_of(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """A row per value of a binary column whose values all have ``size`` bytes."""
    parts = []
    for c in column.chunks:
        if len(c):
            first = c.offset and int(np.frombuffer(c.buffers()[1], np.int32, c.offset + 1)[-1])
            parts.append(np.frombuffer(c.buffers()[2], np.uint8, len(c) * size, first).reshape(-1, size))
    return np.concatenate(parts) if parts else np.zeros((0, size), np.uint8)


def places(true: np.ndarray) -> np.ndarray:
    """Flat numbers of the true ones, of which there are few: eight are looked at together."""
    flat = true.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64) != 0)
    at = np.flatnonzero(flat.reshape(-1, 8)[some])
    return some[at // 8] * 8 + at % 8


def near_sketches(a: np.ndarray, b: np.ndarray, reach: float, same: bool) -> Forest:
    """Trees over the rows of both: ties of sketches that are no further apart than ``reach`` and both errors.

    Some of the components decide most pairs: no two rows are nearer than their parts are.
    ``same``: ``a`` is ``b``.
    """
    shift = 0 if same else len(a)
    forest = Forest(len(a) + (0 if same else len(b)))
    head = max(16, (a.shape[1] - MORE) * 5 // 16)
    reach = reach + float(errors(a).max(initial=0)) + float(errors(b).max(initial=0)) + EPS
    least = -reach * reach / 2 - SINGLE

    def halves(x: np.ndarray, left: bool) -> np.ndarray:
        """With two components more, by which a product is minus half the square of the distance."""
        half, one = -(x * x).sum(1, keepdims=True) / 2, np.ones((len(x), 1), np.float32)
        return np.concatenate([x, half, one] if left else [x, one, half], axis=1)

    heads = halves(opened(a, head), True)
    for s in range(0, len(b), TILE):
        theirs = b[s : s + TILE]
        y_head = np.ascontiguousarray(halves(opened(theirs, head), False).T)
        for r in range(0, s + 1 if same else len(a), TILE):
            own = a[r : r + TILE]
            i, j = np.divmod(places(heads[r : r + TILE] @ y_head >= least), len(theirs))
            if len(i) > len(own) * len(theirs) // 20:
                near = halves(opened(own), True) @ halves(opened(theirs), False).T >= least
                near = near[i, j]
            else:
                gap = opened(own[i]) - opened(theirs[j])
                near = (gap * gap).sum(1) <= -2 * least
            if same:
                near &= r + i < s + j
            if not near.any():
                continue
            i, j = i[near], j[near]
            rows, edge = np.unique(i, return_index=True)
            roots = np.full(len(theirs), -1)
            for k in np.unique(j):
                roots[k] = forest.root(s + shift + int(k))
            for row, met in zip(rows, np.split(j, edge[1:]), strict=True):
                mine = forest.root(r + int(row))
                for other in np.unique(roots[met]):
                    if forest.root(int(other)) != mine:
                        forest.join(mine, int(other))
                        mine = forest.root(mine)
                    roots[roots == other] = mine
    return forest


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, width)


def usable(vec: Column) -> Column:
    """Neither missing nor zero, and every component a finite number."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _sent(rows: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``rows(cell, block, ..)`` once for each pair of blocks ``p, bp, q, bq`` that has theirs, as ``side`` 0 or 1; ``pairs(p, q, np, nq)`` of cells."""
    pairs = F.broadcast(pairs)
    left = rows.join(pairs, F.col("cell") == F.col("p")).withColumn(
        "other", F.explode(F.sequence(F.when(F.col("p") == F.col("q"), F.col("block")).otherwise(0), F.col("nq") - 1))
    )
    left = left.select("p", F.col("block").alias("bp"), "q", F.col("other").alias("bq"), F.lit(0).alias("side"), *columns)
    last = F.when(F.col("p") == F.col("q"), F.col("block")).otherwise(F.col("np")) - 1
    right = rows.join(pairs, F.col("cell") == F.col("q")).where(last >= 0)
    right = right.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    right = right.select("p", F.col("other").alias("bp"), "q", F.col("block").alias("bq"), F.lit(1).alias("side"), *columns)
    return left.union(right)


def _tied(rows: DataFrame, width: int, rows_there: int, threshold: float, sample: int, most: int) -> DataFrame:
    """Ties ``a, b`` of ``rows(node, sketch)``; those of linked vectors make them one component."""
    spark = rows.sparkSession
    size = width + MORE
    # Each sketch is sent once per block: no more of these than memory asks for, some for a small table's tasks.
    wanted = max(-(-rows_there * size // most), min(6, -(-rows_there // 4_096)))
    few = rows.orderBy("node").limit(sample).select("sketch").collect()
    centres = top_centres(opened(np.array([np.frombuffer(r["sketch"], np.uint8) for r in few])).astype(float), min(sample, wanted))
    t = float(np.sqrt(2.0 - 2.0 * threshold))

    def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2.0 * (x @ y.T), 0.0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = bytes_of(pa.chunked_array([b.column("sketch")]), size)
                gap = between(opened(found).astype(float), centres)
                cell = gap.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), b.column("sketch"), pa.array(cell), pa.array(gap.min(1)), pa.array(errors(found).astype(float))],
                    names=["node", "sketch", "cell", "gap", "error"],
                )

    placed = rows.select("node", "sketch").mapInArrow(assign, "node long, sketch binary, cell long, gap double, error double")
    cells = placed.groupBy("cell").agg(F.count("node").alias("n"), F.max("gap").alias("r"), F.max("error").alias("e")).collect()
    blocks = {r["cell"]: max(1, round(r["n"] * wanted / rows_there)) for r in cells}
    names, radius, error = (np.array([r[k] for r in cells]) for k in ("cell", "r", "e"))
    reach = (radius + error)[:, None] + (radius + error)[None, :] + t + EPS
    near = [(int(names[i]), int(names[j])) for i, j in np.argwhere(between(centres[names], centres[names]) <= reach) if names[i] <= names[j]]
    pairs = spark.createDataFrame([(i, j, blocks[i], blocks[j]) for i, j in near], "p long, q long, np long, nq long")
    there = spark.createDataFrame(list(blocks.items()), "cell long, blocks long")
    dealt = placed.join(F.broadcast(there), "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    keys = ["p", "bp", "q", "bq"]
    together = _sent(dealt, pairs, ["node", "sketch"]).repartition(tasks(spark), *keys).sortWithinPartitions(*keys, "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows_of in runs_of(batches, keys):
            found, nodes = bytes_of(rows_of["sketch"], size), rows_of["node"].to_numpy()
            cut = int((rows_of["side"].to_numpy() == 0).sum())
            same = key[:2] == key[2:]
            del rows_of
            forest = near_sketches(found[:cut], found[:cut] if same else found[cut:], t, same)
            up = np.array([forest.root(i) for i in range(len(found))])
            tied = np.flatnonzero(up != np.arange(len(up)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[up[tied]])], names=["a", "b"])

    return together.mapInArrow(meet, "a long, b long")


def _searched(rows: DataFrame, width: int, rows_there: int, threshold: float, block: int) -> DataFrame:
    """``id, links, up`` as of ``_linked``, for ``rows(id, weight, vec, group)`` of groups that fit a block; links are within groups."""
    bins = -(-rows_there // block)
    dealt = rows.withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(bins)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows_of in runs_of(batches, ["bin"]):
            x = unit(rows_of["vec"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, width))
            order, paths = tree_order(x)
            tree = Tree(x[order], rows_of["weight"].to_numpy().astype(float)[order], paths)
            links, _, forest = dual(tree, tree, threshold, True)
            ids = rows_of["id"].to_numpy()[order]
            yield _hits(ids, links, forest)

    grouped = dealt.select("bin", "id", "weight", "vec").repartition(tasks(rows.sparkSession), "bin").sortWithinPartitions("bin")
    return grouped.mapInArrow(search, "id long, links long, up long")


def _hits(ids: np.ndarray, links: np.ndarray, forest: Forest) -> pa.RecordBatch:
    """The rows with links."""
    links = np.rint(links).astype(np.int64)
    hit = np.flatnonzero(links > 0)
    up = [int(ids[forest.root(int(i))]) for i in hit]
    return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(up, pa.int64())], names=["id", "links", "up"])


def _linked(rows: DataFrame, width: int, rows_there: int, threshold: float, sample: int, block: int) -> DataFrame:
    """``id, links, up`` per task in which a vector of ``rows(id, weight, vec)`` has links; all of one width."""
    spark = rows.sparkSession
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    centres = top_centres(unit(np.array([r["vec"] for r in few], float)), min(sample, -(-rows_there // block)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(b.column("vec").flatten().to_numpy().astype(float).reshape(-1, width))
                gap = apart(x, centres)
                cell = gap.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id"),
                        b.column("weight"),
                        pa.array(cell),
                        pa.array(gap[np.arange(len(x)), cell]),
                        pa.array([v.tobytes() for v in x], pa.binary()),
                    ],
                    names=["id", "weight", "cell", "gap", "unit"],
                )

    placed = stored(rows.mapInArrow(assign, "id long, weight long, cell long, gap double, unit binary"))
    # A row per centre, of which there are ``sample`` at most.
    cells = placed.groupBy("cell").agg(F.count("id").alias("n"), F.max("gap").alias("r")).collect()
    blocks = {r["cell"]: -(-r["n"] // block) for r in cells}
    names = np.array([r["cell"] for r in cells])
    reach = np.array([r["r"] for r in cells])
    t = float(np.sqrt(2.0 - 2.0 * threshold))
    near = apart(centres[names], centres[names]) <= reach[:, None] + reach[None, :] + t + EPS
    near = [(int(names[i]), int(names[j])) for i, j in np.argwhere(near) if names[i] <= names[j]]
    pairs = spark.createDataFrame([(i, j, blocks[i], blocks[j]) for i, j in near], "p long, q long, np long, nq long")
    sizes = spark.createDataFrame(list(blocks.items()), "cell long, blocks long")
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows_of in runs_of(batches, ["cell", "block"]):
            order, paths = tree_order(_matrix(rows_of["unit"], width))
            rows_of = rows_of.take(pa.array(order))
            for batch in rows_of.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("cell", "block", "id", "weight", "unit")),
                        pa.array(np.arange(len(order))),
                        pa.array(paths.T.tolist(), pa.list_(pa.int64())),
                    ],
                    names=["cell", "block", "id", "weight", "unit", "place", "path"],
                )

    grouped = dealt.select("cell", "block", "id", "weight", "unit").repartition(tasks(spark), "cell", "block")
    grown = stored(
        grouped.sortWithinPartitions("cell", "block").mapInArrow(
            grow, "cell long, block long, id long, weight long, unit binary, place long, path array<long>"
        )
    )
    dropped(placed)
    keys = ["p", "bp", "q", "bq"]
    sent = _sent(grown, pairs, ["place", "id", "weight", "unit", "path"])
    together = sent.repartition(tasks(spark), *keys).sortWithinPartitions(*keys, "side", "place")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows_of in runs_of(batches, keys):
            x, w = _matrix(rows_of["unit"], width), rows_of["weight"].to_numpy().astype(float)
            paths = rows_of["path"].combine_chunks().flatten().to_numpy().reshape(-1, len(RADII)).T
            ids, cut = rows_of["id"].to_numpy(), int((rows_of["side"].to_numpy() == 0).sum())
            a = Tree(x[:cut], w[:cut], paths[:, :cut])
            same = key[:2] == key[2:]
            b = a if same else Tree(x[cut:], w[cut:], paths[:, cut:])
            links_a, links_b, forest = dual(a, b, threshold, same)
            yield _hits(ids, np.concatenate([links_a, links_b]), forest)

    return together.mapInArrow(search, "id long, links long, up long")


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    sample: int = 1_024,
    block: int = 4_096,
    most: int = 1 << 25,
) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``; links have cosine ``threshold`` or more.

    Equal vectors are one with a weight, told by a 128-bit digest. Vectors are first told apart by
    sketches of a byte a component, with a bound on their error: sketches meet in blocks of ``most``
    bytes, unless the cells they are of rule that out, and only ties that no bound can rule out count.
    Vectors without one are done. The others are searched in the groups that ties make: by a tree per
    ``block`` of whole groups, and groups that are larger by a tree per block of a cell. The top of
    that tree is made of at most ``sample`` centres, nested nets of halving radii over a sample; every
    vector belongs to its nearest one, and a centre's covering radius comes from all its vectors.
    Centres with many vectors have several blocks of about ``block``, each with a tree of its own. Two
    blocks meet in a task unless their centres' radii rule that out; there ``dual`` goes down both
    trees. A task sends one row per vector with links or ties, never its pairs.

    A vector that is missing, empty, zero or holds a missing or non-finite number has no links, and
    so does a row without an id (whose component is missing). Vectors of different lengths are never
    linked. Repeated rows count as vectors of their own; rows that share an id share its component.
    """
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    # Single precision stays until a task works on it: it takes half the room.
    vec = F.col(vec_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    rows = rows.withColumn("fit", usable(F.col("vec")) & F.col("id").isNotNull())
    fits = rows.where("fit").select("id", "vec")

    def by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes]]]:
        """Rows of one width, their vectors and digests."""
        for b in batches:
            if b.num_rows:
                width = pc.list_value_length(b.column("vec")).to_numpy()
                for w in np.unique(width):
                    part = b.filter(pa.array(width == w))
                    x = part.column("vec").flatten().to_numpy().astype(float).reshape(-1, w) + 0.0  # no zero with a sign
                    yield part, x, [blake2b(v.tobytes(), digest_size=16).digest() for v in x]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, digests in by_width(batches):
            made = [v.tobytes() for v in sketches(unit(x))]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(digests, pa.binary()), pa.array(np.full(len(x), x.shape[1])), pa.array(made, pa.binary())],
                names=["id", "digest", "width", "sketch"],
            )

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, digests in by_width(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary()), part.column("vec")], names=["id", "digest", "vec"])

    measured = stored(fits.mapInArrow(measure, "id long, digest binary, width long, sketch binary"))
    unlike = measured.groupBy("width", "digest").agg(F.min("id").alias("id"), F.count("id").alias("weight"), F.first("sketch").alias("sketch"))
    unlike = stored(unlike.withColumn("node", F.xxhash64("digest")))
    spark = vectors.sparkSession
    widths = unlike.groupBy("width").agg(F.count("id").alias("n")).where("n > 1").orderBy("width").collect()
    ties = spark.createDataFrame([], "a long, b long")
    for r in widths:
        ties = ties.union(_tied(unlike.where(F.col("width") == r["width"]), r["width"], r["n"], threshold, sample, most))
    groups = components(ties).toDF("node", "group")
    groups = groups.join(groups.groupBy("group").agg((F.count("node") > block).alias("large")), "group")
    members = unlike.select("node", "width", "digest", "id", "weight").join(groups, "node")
    kept = fits.mapInArrow(named, f"id long, digest binary, vec {'array<float>' if single else 'array<double>'}")
    # A vector's own rows repeat it; one is enough.
    kept = kept.join(members.hint("merge"), ["digest", "id"]).dropDuplicates(["digest", "id"])
    kept = stored(kept.select("id", "weight", "width", "group", "large", "vec"))
    found = spark.createDataFrame([], "id long, links long, up long")
    for r in kept.groupBy("width", "large").agg(F.count("id").alias("n")).orderBy("width", "large").collect():
        part = kept.where((F.col("width") == r["width"]) & (F.col("large") == r["large"]))
        if r["large"]:
            part = _linked(part.select("id", "weight", "vec"), r["width"], r["n"], threshold, sample, block)
        else:
            part = _searched(part, r["width"], r["n"], threshold, block)
        found = found.union(part)
    found = stored(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # Equal vectors share a row of `unlike`; all their ids hang on its smallest.
    fit = measured.select("id", "width", "digest").join(unlike.select("width", "digest", F.col("id").alias("first"), "weight"), ["width", "digest"])
    fit = stored(fit.select("id", "first", "weight"))
    dropped(measured, unlike, kept)
    tied = components(found.select("id", "up").union(fit.where("id != first").select("first", "id")).toDF("a", "b"))
    fit = fit.join(links.withColumnRenamed("id", "first"), "first", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    every = fit.union(rows.where("not fit").select("id", F.lit(0).cast("long")))
    return every.join(tied, "id", "left").select(
        F.col("id").alias(id_col),
        "n_links",
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
