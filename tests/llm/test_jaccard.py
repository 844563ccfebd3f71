"""The similarity join against all pairs."""

import random
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from civicframe.llm import jaccard_join as jaccard
from civicframe.llm.jaccard_join import Words, alike, divide_skip, folded, jaccard_join, levels, routing_keys, shingles, sketch, sketch_bits, words_of
from civicframe.llm.queries import QUERIES
from civicframe.llm.store import components, stored
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def sets_of(texts, size):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(rows, size, num, den):
    """Smallest id of each row's component, over all pairs."""
    sets = sets_of([t for _, t in rows], size)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, s) in enumerate(rows):
        for j in range(i):
            if a is None or rows[j][0] is None:
                continue
            meet = len(sets[i] & sets[j])
            if meet and den * meet >= num * len(sets[i] | sets[j]) or a == rows[j][0]:
                up[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[root(i)] = min(a, least.get(root(i), a))
    return sorted(((a, len(sets[i]), None if a is None else least[root(i)]) for i, (a, _) in enumerate(rows)), key=repr)


def made_texts(rng, families=25):
    """Families of texts around the limit, on a small vocabulary, with a passage that many share."""
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(families):
        base = rng.choices(words, k=rng.choice([3, 6, 8, 12, 40, 120, 400]))
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t + (passage if rng.random() < 0.3 else [])))
    return texts


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit("x"))


@pytest.mark.parametrize("size,num,den,block", [(4, 85, 100, 6000), (5, 4, 5, 6000), (4, 85, 100, 3), (2, 1, 2, 4)])
def test_components_are_those_of_all_pairs(spark, size, num, den, block):
    rows = list(enumerate(made_texts(random.Random(size * block))))
    rows = [(1000 - i, t) for i, t in rows]
    got = jaccard_join(table(spark, rows), words=size, num=num, den=den, block_rows=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, size, num, den)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 977}y{i % 1013}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a  B"), (6, "a b c d e f g"), (6, "a b c d e f g"), (None, "a b c d e f g")]
    rows += [(7, long), (8, long + " end"), (9, "é É"), (10, "é é")]
    got = jaccard_join(table(spark, rows), words=4, num=85, den=100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 4, 85, 100)
    assert jaccard_join(table(spark, rows).limit(0)).count() == 0
    assert jaccard_join(table(spark, rows[:3])).count() == 3


def test_query_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op10_jaccard_join"](spark, FOLDER).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (1, 2)])
def test_linked_sets_share_a_key(num, den):
    rng = np.random.default_rng(5)
    for n in [2, 3, 5, 6, 7, 9, 13, 20, 57, 200, 1500]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, n // 4 + 2)
            add = rng.integers(0, n // 4 + 2)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            meet = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and den * meet >= num * (len(a) + len(b) - meet):
                assert len(np.intersect1d(routing_keys(a, num, den), routing_keys(b, num, den)))


def test_search_of_two_sides():
    known = Words()
    texts = made_texts(random.Random(9), 12)
    found = sorted((shingles(t, 3, known) for t in texts), key=len)
    side = np.arange(len(found)) % 2 == 0
    forest = divide_skip(found, side, 4, 5)
    up = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            meet = len(np.intersect1d(found[i], found[j]))
            if side[i] != side[j] and 5 * meet >= 4 * (len(found[i]) + len(found[j]) - meet):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    roots = [forest.root(i) for i in range(len(found))]
    assert all((roots[i] == roots[j]) == (up[i] == up[j]) for i in range(len(found)) for j in range(i))


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (300, 200), (539, 3)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 3 for i in range(500, 540))
    assert got[300] == got[200] == 200 and 7 not in got


def test_search_leaves_out_pairs_of_small_sets():
    known = Words()
    found = sorted((shingles(t, 3, known) for t in made_texts(random.Random(4), 12)), key=len)
    above = len(found[len(found) // 2])
    forest = divide_skip(found, None, 4, 5, above)
    up = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            meet = len(np.intersect1d(found[i], found[j]))
            if len(found[i]) > above and 5 * meet >= 4 * (len(found[i]) + len(found[j]) - meet):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    roots = [forest.root(i) for i in range(len(found))]
    assert len(set(roots)) < len(roots)
    assert all((roots[i] == roots[j]) == (up[i] == up[j]) for i in range(len(found)) for j in range(i))


def test_search_holds_few_bytes_a_shingle():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[i : i + 1000], rng.integers(0, 2**63, 1000).astype(np.uint64)])) for i in range(0, 4000, 10)]
    sets.sort(key=len)
    tracemalloc.start()
    divide_skip(sets, None, 4, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The sets themselves take 8.
    assert peak < 30 * sum(map(len, sets))


def test_sets_of_many_sizes_are_not_one_group(spark, monkeypatch):
    """Each text is like the next longer one, and too short to be linked with it."""
    long = [f"w{i}" for i in range(3000)]
    texts, n = [], 40
    while n <= 3000:
        texts += [" ".join(long[:n]), " ".join(long[:n] + ["end"])]
        n = n * 13 // 10
    rows = list(enumerate(texts))
    groups = []

    def seen(df):
        out = stored(df)
        if "met" in df.columns:
            groups.extend(r["count"] for r in out.groupBy("met").count().collect())
        return out

    monkeypatch.setattr(jaccard, "stored", seen)
    got = jaccard_join(table(spark, rows), words=5, num=4, den=5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 5, 4, 5)
    # Of two neighbouring sizes, at most two steps of each.
    assert max(groups) <= 8 < len(rows)


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (1, 2)])
def test_sketches_rule_out_no_linked_pair(num, den):
    rng = np.random.default_rng(8)
    for n in [2, 5, 9, 40, 300, 1500]:
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets = [base]
        for change in rng.integers(0, n // 4 + 2, 30):
            sets.append(np.unique(np.concatenate([rng.permutation(base)[change:], rng.integers(0, 2**63, rng.integers(0, n // 4 + 2)).astype(np.uint64)])))
        sets = sorted((s for s in sets if len(s)), key=len)
        size = np.array([len(s) for s in sets])
        bits = sketch_bits(int(levels([size[0]], num, den)[0]), num, den)
        words = np.array([folded(sketch(s, 4 * bits), bits) for s in sets])
        assert (words[0] == sketch(sets[0], bits)).all()
        tree, forest = alike(words, size, None, num, den), divide_skip(sets, None, num, den)
        assert all(tree[i] == tree[forest.root(i)] for i in range(len(sets)))


def test_sketches_of_two_sides():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [base[2:], base[1:], base, np.unique(rng.integers(0, 2**63, 201).astype(np.uint64))]
    words, size = np.array([sketch(s, 1024) for s in sets]), np.array([len(s) for s in sets])
    assert alike(words, size, None, 4, 5).tolist() == [0, 0, 0, 3]
    assert alike(words, size, np.array([True, True, False, False]), 4, 5).tolist() == [0, 0, 0, 3]
    assert alike(words, size, np.array([True, True, True, False]), 4, 5).tolist() == [0, 1, 2, 3]
    assert alike(words, size, None, 4, 5, 199).tolist() == [0, 0, 0, 3]
    assert alike(words, size, None, 4, 5, 200).tolist() == [0, 1, 2, 3]


def test_texts_that_only_share_passages_are_not_sent(spark, monkeypatch):
    """They agree in keys, directly or through others; their sketches tell them apart before texts are sent."""
    rng = random.Random(3)
    passages = [[f"p{k}w{i}" for i in range(300)] for k in range(4)]
    rows = [(i, " ".join([*(w for p in rng.sample(passages, 3) for w in p), *(f"x{i}y{j}" for j in range(500))])) for i in range(40)]
    rows += [(100, rows[0][1] + " end"), (101, "end " + rows[0][1])]
    met = []

    def seen(df):
        out = stored(df)
        if "met" in df.columns:
            met.append({r.id for r in out.select("id").collect()})
        return out

    monkeypatch.setattr(jaccard, "stored", seen)
    got = jaccard_join(table(spark, rows), words=5, num=4, den=5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 5, 4, 5)
    assert len(met[0]) > 10 and met[-1] == {0, 100, 101}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_what_is_stored_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = stored(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert kept.count() == 10


def test_rounds_of_components_leave_one_table(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"), "civicframe-llm")
    folder.mkdir(exist_ok=True)
    before = set(folder.iterdir())
    got = components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long"))
    assert len(set(folder.iterdir()) - before) == 1
    assert {r.component_id for r in got.collect()} == {0} and got.count() == 101
