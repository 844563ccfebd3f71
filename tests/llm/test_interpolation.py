"""Deleted interpolation against plain counting."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from civicframe.llm import interpolation
from civicframe.llm.interpolation import bucket_of, interpolated, mixture_weights, sorted_spread, sorted_squeezed, spread, squeezed
from civicframe.llm.queries import QUERIES
from pyspark.sql import functions as F

END, BEGIN = ("end",), ("begin",)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), END]


def counts(texts):
    ones, twos = Counter(), Counter()
    for t in texts:
        own = tokens_of(t)
        ones.update(own)
        ones[BEGIN] += 1
        twos.update(zip([BEGIN, *own], own, strict=False))
    return ones, twos


def brute(rows, train, fold):
    """Scores by dictionaries; mixture weights by EM on every held-out token."""
    ones, twos = counts([t for i, t in rows if train(i)])
    main1, main2 = counts([t for i, t in rows if train(i) and not fold(i)])
    size = lambda c: sum(n for w, n in c.items() if w is not BEGIN)
    total, part, v = size(ones), size(main1), len([w for w in ones if w is not BEGIN and ones[w]])
    held = defaultdict(list)
    for i, t in rows:
        if train(i) and fold(i):
            own = tokens_of(t)
            for h, w in zip([BEGIN, *own], own, strict=False):
                c = main1[h]
                held[int(bucket_of(np.array([c]))[0])].append(
                    (main2[h, w] / c * (v + 1) if c else 0, main1[w] / part * (v + 1) if part else 0, 1)
                )

    def fit(ratio):
        weight = np.full(3, 1 / 3)
        for _ in range(200):
            p = np.array(ratio) * weight
            p /= p.sum(1, keepdims=True)
            weight = (p.sum(0) + 1 / 3) / (len(ratio) + 1)
        return weight

    everything = fit([x for h in held.values() for x in h]) if held else np.full(3, 1 / 3)
    weights = {b: fit(held[b]) if held[b] else everything for b in range(interpolation.BUCKETS + 1)}
    weights[0] = np.array([0, *(weights[0][1:] / weights[0][1:].sum())])
    out = []
    for i, t in rows:
        own, base, score = tokens_of(t), 0.0, 0.0
        for h, w in zip([BEGIN, *own], own, strict=False):
            a = weights[int(bucket_of(np.array([ones[h]]))[0])]
            p = (a[0] * twos[h, w] / ones[h] if ones[h] else 0) + (a[1] * ones[w] / total if total else 0) + a[2] / (v + 1)
            score += math.log10(p) if total else 0.0
            base += math.log10((ones[w] + 1) / (total + v + 1))
        out.append((i, len(own), sum(ones[w] > 0 for w in own), total, base, score))
    return out


def close(got, expected):
    key = lambda r: (repr(r[0]), r[1], r[2], round(r[4], 6))
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:4] == b[:4]
        assert math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
        # Weights come from binned ratios, so scores agree closely, not to the last digit.
        assert math.isclose(a[5], b[5], rel_tol=2e-3, abs_tol=1e-6)


def columns(rows):
    return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]


def test_codes():
    x = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (sorted_spread(sorted_squeezed(x)) == x).all() and (spread(squeezed(x), np.uint64) == x).all()
    assert len(spread(squeezed(x[:0]), np.uint64)) == 0


def test_weights_find_the_mixture():
    rng = np.random.default_rng(1)
    q2, q1 = rng.integers(-20, 40, 4000), rng.integers(-20, 40, 4000)
    true = np.array([0.6, 0.3, 0.1])
    n = 100 * (np.exp(np.column_stack([q2, q1, 0 * q1]) * 0.1) @ true)
    one = mixture_weights([(3, int(a), int(b), float(c)) for a, b, c in zip(q2, q1, n, strict=True)])
    assert one[3].argmax() in (0, 1) and np.allclose(one.sum(1), 1) and one[0, 0] == 0 and np.allclose(one[5], one[3])
    assert np.allclose(mixture_weights([])[4], 1 / 3)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_scores_on_a_table(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = interpolated(docs.repartition(3), F.col("doc_id") % 7 != 2, F.col("doc_id") % 8 == 0, shards=5, block=block).collect()
    close(columns(got), brute(rows, lambda i: i % 7 != 2, lambda i: i % 8 == 0))


def test_slices_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.createDataFrame([(None, None, "en", "s", 0), (5, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    args = (F.col("doc_id") % 7 != 2, F.col("doc_id") % 8 == 0)
    whole = sorted(map(tuple, interpolated(docs, *args).collect()), key=repr)
    monkeypatch.setattr("civicframe.llm.interpolation.SLICE", 300)
    cut = sorted(map(tuple, interpolated(docs, *args, block=5000, shards=3).collect()), key=repr)
    assert len(whole) == len(cut) == 202
    for a, b in zip(whole, cut, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    crc = lambda i: zlib.crc32(str(i).encode())
    got = QUERIES["op4_interpolation"](spark, folder).collect()
    close(columns(got), brute([(r.doc_id, r.text) for r in docs.collect()], lambda i: crc(i) % 7 != 2, lambda i: crc(i) // 7 % 8 == 0))
    assert all(r.held_out == (crc(r.doc_id) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b A é É"), (3, "a b A é É"), (None, "a b"), (5, "w " * 20000), (6, "new words\x0bhere"), (7, "a b a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    train, fold = (lambda i: i is not None and i != 6), (lambda i: i is not None and i % 2 == 1)
    got = interpolated(docs, F.col("doc_id") != 6, F.col("doc_id") % 2 == 1, shards=3).collect()
    close(columns(got), brute(rows, train, fold))
    none = interpolated(docs, F.lit(None).cast("boolean"), F.lit(True)).collect()
    assert all(r.score == r.base_score == 0 and r.train_tokens == r.n_known == 0 for r in none)
    assert interpolated(docs.limit(0), F.lit(True), F.lit(True)).count() == 0
