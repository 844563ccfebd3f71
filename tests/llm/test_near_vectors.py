"""Near vectors against all pairs."""

import math

import numpy as np
import pytest

from civicframe.llm import near_vectors as vectors
from civicframe.llm.near_vectors import RADII, Tree, dual, errors, near_sketches, near_vectors, opened, places, sketches, tree_order, turn, unit
from civicframe.llm.queries import QUERIES
from civicframe.llm.store import stored
from pyspark.sql import functions as F


def brute(rows, threshold):
    fit = [v is not None and len(v) > 0 and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for width in {len(v) for (_, v), f in zip(rows, fit, strict=True) if f}:
        at = [k for k in range(n) if fit[k] and len(rows[k][1]) == width]
        x = unit(np.array([rows[k][1] for k in at], float))
        near[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    up = list(range(n))
    for i in range(n):
        for j in range(i):
            if near[i, j] or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                a, b = up[i], up[j]
                if a != b:
                    up = [b if u == a else u for u in up]
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[up[k]] = min(rows[k][0], least.get(up[k], rows[k][0]))
    out = [(i, int(near[k].sum()), None if i is None else least[up[k]]) for k, (i, _) in enumerate(rows)]
    return sorted(((i, n_, c, c == i and i is not None) for i, n_, c in out), key=repr)


def clustered(rng, n, width, hot=0.3):
    """A third near one vector, some clusters of all tightnesses, the rest apart."""
    base = rng.normal(size=(8, width))
    x = np.empty((n, width))
    for i in range(n):
        u = rng.random()
        if u < hot:
            x[i] = base[0] + rng.normal(size=width) * 0.05
        elif u < 0.8:
            x[i] = base[rng.integers(1, 8)] + rng.normal(size=width) * rng.choice([0.02, 0.1, 0.25, 0.5])
        else:
            x[i] = rng.normal(size=width)
    return x


@pytest.mark.parametrize("width,threshold", [(3, 0.95), (8, 0.95), (8, 0.6), (32, 0.99)])
def test_dual_counts_all_pairs(width, threshold):
    rng = np.random.default_rng(width)
    x = unit(clustered(rng, 700, width))
    w = rng.integers(1, 4, 700).astype(float)
    for own in (slice(0, 700), slice(0, 300)):
        order, paths = tree_order(x[own])
        a = Tree(x[own][order], w[own][order], paths)
        rest = slice(300, 700)
        if own.stop == 700:
            b, same = a, True
        else:
            order_b, paths_b = tree_order(x[rest])
            b, same = Tree(x[rest][order_b], w[rest][order_b], paths_b), False
        got_a, got_b, forest = dual(a, b, threshold, same)
        near = a.x @ b.x.T >= threshold
        if same:
            np.fill_diagonal(near, False)
        assert np.allclose(got_a, near @ b.weight)
        if not same:
            assert np.allclose(got_b, a.weight @ near)
        shift = 0 if same else len(a.x)
        label = np.arange(shift + len(b.x))
        for i, j in np.argwhere(near):
            p, q = label[i], label[j + shift]
            label[label == p] = q
        roots = np.array([forest.root(i) for i in range(len(label))])
        assert len(set(zip(roots, label, strict=True))) == len(set(roots)) == len(set(label))


def test_nodes_are_covered():
    x = unit(clustered(np.random.default_rng(4), 500, 6))
    order, paths = tree_order(x)
    assert sorted(order) == list(range(500))
    tree = Tree(x[order], np.ones(500), paths)
    for (_, _, reach), radius in zip(tree.levels[1:], RADII, strict=True):
        assert (reach <= radius + 1e-9).all()


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("weight", F.lit(1))


@pytest.mark.parametrize("block,sample", [(4096, 1024), (40, 16), (15, 64)])
def test_all_pairs(spark, block, sample):
    x = clustered(np.random.default_rng(block), 300, 5)
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[i // 2][1]) for i in range(20)]
    got = near_vectors(table(spark, rows), block=block, sample=sample)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 0.95)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0]), (8, [2e300, 0.0]), (9, [1e-300, 0.0]), (9, [1e-300, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]),
        (None, [1.0, 0.0]), (12, [1.0, -0.0]), (13, [5.0]), (14, [0.95, math.sqrt(1 - 0.95**2) + 1e-6]),
    ]
    got = near_vectors(table(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 0.95)
    assert near_vectors(table(spark, rows).limit(0)).count() == 0
    assert near_vectors(table(spark, rows[:3])).count() == 3


def test_query_on_a_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = QUERIES["op1_near_vectors"](spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 0.95)


@pytest.mark.parametrize("width", [1, 3, 24, 100])
def test_sketches_know_their_error(width):
    x = unit(np.random.default_rng(width).normal(size=(50, width)) ** 3)
    made = sketches(x)
    gap = np.sqrt(((opened(made).astype(float) - x @ turn(width)) ** 2).sum(1))
    assert made.shape == (50, width + 8) and (gap <= errors(made)).all() and errors(made).max() < 0.02
    assert (opened(made, 2) == opened(made)[:, :2]).all()


@pytest.mark.parametrize("width,tile", [(5, 64), (32, 1024), (64, 100)])
def test_ties_of_sketches_hold_all_links(monkeypatch, width, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(width)
    x = unit(clustered(rng, 600, width))
    t = math.sqrt(0.1)
    for cut in (600, 250):
        same = cut == 600
        own, other = sketches(x[:cut]), sketches(x if same else x[cut:])
        forest = near_sketches(own, own if same else other, t, same)
        y = x if same else x[cut:]
        links = np.argwhere(x[:cut] @ y.T >= 0.95)
        shift = 0 if same else cut
        assert len(links) > 600 and all(forest.root(int(i)) == forest.root(int(j) + shift) for i, j in links)
        assert len({forest.root(i) for i in range(len(forest.up))}) > 50


def test_places_of_true():
    rng = np.random.default_rng(1)
    for shape in ((8, 8), (7, 5), (3, 40)):
        true = rng.random(shape) < 0.1
        assert places(true).tolist() == np.flatnonzero(true).tolist()


def test_vectors_without_ties_are_not_sent(spark, monkeypatch):
    """Vectors without structure meet as sketches; what is written and dealt in full has a link."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64))
    x = np.concatenate([x, x[:5] + rng.normal(size=(5, 64)) * 0.05])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    seen = []

    def kept(df):
        out = stored(df)
        if {"vec", "unit"} & set(df.columns):
            seen.extend(r.id for r in out.select("id").collect())
        return out

    monkeypatch.setattr(vectors, "stored", kept)
    got = near_vectors(table(spark, rows), block=50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 0.95)
    assert sorted(seen) == [*range(5), *range(400, 405)]


@pytest.mark.parametrize("kind", ["float", "int"])
def test_blocks_of_sketches_and_kinds(spark, kind):
    x = clustered(np.random.default_rng(7), 200, 6)
    x = np.rint(x * 50) if kind == "int" else x.astype(np.float32)
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)]
    df = table(spark, rows).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    got = near_vectors(df, block=30, sample=32, most=1000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 0.95)
