"""Packing, toxicity and mixing against brute force, round trips and held-out labels."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from civicframe.llm.mixing import fitted_rates, mix
from civicframe.llm.packing import encoder, pack, pack_rows
from civicframe.llm.queries import QUERIES
from civicframe.llm.toxicity import BlockMaxIndex, Reader, counted_terms, feature_weights, grouped, indexed, platt, toxicity
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a" * 5000, "it's  <|endoftext|> x  y\r\n\n z", "\U0001f600é\x00", "12345 don't  "]


def test_ids_are_those_of_the_file(spark):
    own, theirs = encoder(PATH), Tokenizer.from_file(PATH)
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for t in texts:
        assert own(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def check_packing(rows, expected, tokens, segments, loss):
    """``expected``: ids and first loss-bearing place by key, each key once."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(expected)
    for key, (ids, _) in expected.items():
        own = sorted(pieces[key], key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, "<u4").tobytes()
        assert all(r["doc_tokens"] == len(ids) for r in own)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        total = sum(r["length"] for r in own)
        assert total <= tokens and total & (total - 1) == 0
        assert len(own) <= segments and sum(r["loss_tokens"] for r in own) <= loss


def test_pack_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("offset", F.lit(3))
    encode = encoder(PATH)
    expected = {i: ([*encode(t or "").tolist(), 1], 0) for i, t in enumerate(ODD)}
    check_packing([r.asDict() for r in pack(docs, PATH).collect()], expected, 2048, 128, 2048)
    assert pack(docs.limit(0), PATH).count() == 0
    twice = pack(docs.union(docs), PATH).collect()
    assert sum(r["length"] for r in twice) == 2 * sum(len(x) for x, _ in expected.values())


@pytest.mark.parametrize("caps", [(64, 5, 64), (64, 4, 20), (16, 2, 3)])
def test_limits_hold_together(caps):
    rng = np.random.default_rng(1)
    rows, expected = [], {}
    for key in range(400):
        n = int(rng.choice([1, 2, 7, 30, 64, 65, 300]))
        ids, loss_from = rng.integers(0, 50000, n).astype(np.uint32), int(rng.integers(0, n + 1))
        rows.append((key, ids, loss_from))
        expected[key] = (ids, loss_from)
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens")
    got = [dict(zip(names, p, strict=True)) for p in pack_rows(rows, caps, 50, 10)]
    check_packing(got, expected, *caps)
    for r in got:
        first = expected[r["doc_id"]][1]
        assert r["loss_tokens"] == sum(i >= first for i in range(r["start"], r["start"] + r["length"]))


def test_packing_query(spark):
    encode = encoder(PATH)
    docs = {r.doc_id: encode(r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op7_packing"](spark, FOLDER).collect()
    for r in rows:
        ids = np.append(docs[r.doc_id], np.uint32(1)).astype("<u4")[r.start : r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in docs.values())


@pytest.mark.parametrize("first", [0.1, 0.8, 1.0])
def test_block_max_search_is_exact(first):
    rng = np.random.default_rng(2)
    names = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))

    def draw():
        terms = np.unique(rng.geometric(0.12, rng.integers(0, 8)) % 40)
        return names[terms], rng.integers(1, 4, len(terms))

    examples = [(i, float(rng.integers(2)), *draw()) for i in range(500)]
    examples += [(500 + i, *examples[i][1:]) for i in range(100)]
    index = BlockMaxIndex(names, rng.uniform(0, 3, 40).round(1), examples, block=16)
    index.FIRST = first
    dense = np.zeros((len(index.keys), 40))
    by_key = {e[0]: e for e in examples}
    for n, key in enumerate(index.keys):
        at, w = index.unit(*by_key[key][2:])
        dense[n, at] = w
    for _ in range(200):
        at, w = index.unit(*draw())
        i, s = index.nearest(at, w, 15)
        q = np.zeros(40)
        q[at] = w
        full = np.round(dense @ q, 12)
        best = [j for j in np.lexsort((np.arange(len(full)), -full)) if full[j] > 0][:15]
        assert i.tolist() == best and np.allclose(s, full[best])


def test_toxicity_query_against_brute_force(spark):
    """Weights, cosines of all pairs, votes and calibration of the whole query, worked out plainly."""
    rows = QUERIES["op2_toxicity"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marks = marks.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))).collect()
    marks = [r for r in marks if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    counts = {i: dict(zip(*(x.tolist() for x in counted_terms(t)), strict=True)) for i, t in texts.items()}
    chosen, aside = [r for r in marks if r.u % 4], [r for r in marks if r.u % 4 == 0]
    names = sorted({t for r in chosen for t in counts[r.doc_id]})
    place = {t: k for k, t in enumerate(names)}
    n, n1 = np.zeros(len(names)), np.zeros(len(names))
    for r in chosen:
        for t in counts[r.doc_id]:
            n[place[t]] += 1
            n1[place[t]] += r.y
    share = sum(r.y for r in chosen) / len(chosen)
    weight = np.log(len(chosen) / n) * feature_weights(n, n1, share)

    def vector(i):
        v = np.zeros(len(names))
        for t, c in counts[i].items():
            if t in place:
                v[place[t]] = (1 + np.log(c)) * weight[place[t]]
        return v / (np.linalg.norm(v) or 1)

    ordered = sorted(((int(v.argmax()), r.doc_id, v, r.y) for r in chosen if (v := vector(r.doc_id)).any()), key=lambda x: x[:2])
    matrix = np.array([v for *_, v, _ in ordered])

    def vote(i):
        if not counts[i]:
            return share / 16, []
        cosine = np.round(matrix @ vector(i), 12)
        best = [j for j in np.lexsort((np.arange(len(cosine)), -cosine)) if cosine[j] > 0][:15]
        return (sum(cosine[j] * ordered[j][3] for j in best) + share) / (sum(cosine[j] for j in best) + 1), [ordered[j][1] for j in best[:3]]

    slope, offset = platt(np.array([vote(r.doc_id)[0] for r in aside]), np.array([r.y for r in aside], float))
    for r in rows:
        raw, evidence = vote(r.doc_id)
        assert abs(r.score - 1 / (1 + np.exp(-(slope * np.log(raw / (1 - raw)) + offset)))) < 1e-8
        assert [e.doc_id for e in r.evidence] == evidence


def test_one_text_of_an_id_is_an_example(spark):
    texts = [(1, f"text number {i}") for i in range(300)] + [(i, f"plain w{i}" if i % 2 else f"rotten w{i}") for i in range(2, 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(1, 60)], "doc_id long, toxic int")
    found = {e.doc_id: e.label for r in toxicity(docs, labels, F.lit(True), evidence=15).collect() for e in r.evidence if e.doc_id == 1}
    assert len(found) <= 1
    assert max(Counter(e.doc_id for e in r.evidence)[1] for r in toxicity(docs, labels, F.lit(True), evidence=15).collect()) <= 1


def test_platt_is_calibrated():
    raw = np.repeat([0.1, 0.5, 0.9], 200)
    y = np.concatenate([np.arange(200) < n for n in (4, 60, 180)]).astype(float)
    a, b = platt(raw, y)
    p = 1 / (1 + np.exp(-(a * np.log(raw / (1 - raw)) + b)))
    assert a > 0 and abs(p.mean() - y.mean()) < 0.02


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(rows[r.doc_id], r.toxic) for r in labels if rows[r.doc_id].held_out]
    assert len(rows) == 10000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    hits = sum(p.predicted for p, y in held if y)
    assert hits >= 0.85 * sum(y for _, y in held)
    assert sum(p.predicted for p, y in held if not y) <= 0.03 * sum(not y for _, y in held)
    assert any(r.evidence and r.evidence[0].label == 1 for r in rows.values())


def test_toxicity_odd_rows(spark):
    texts = [None, "", "fine words", "x rotten y", "x rotten y", "z " * 20000, "Rotten!"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "rotten"), (5, "rotten")], "doc_id long, text string")
    more = spark.createDataFrame([(100 + i, "a rotten b" if i % 4 == 0 else "a fine b") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0), None) for i in range(400)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, score int")
    rows = toxicity(docs.union(more).withColumn("score", F.lit("x")), labels, F.lit(True)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.score)
    assert len(rows) == 409 and all(0 <= r.score <= 1 for r in rows)
    assert by[0] == by[1] == by[2] and by[3] == by[4] and by[6][0] > 0.8 > 0.2 > by[0][0]
    assert sorted(by[5])[1] == by[None][0] == by[6][0]
    assert toxicity(docs.limit(0), labels, F.lit(True)).count() == 0
    assert {r.score for r in toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
    terms, often = counted_terms("Ab-ab, vequ9 abcdef")
    expected = {xxhash.xxh64_intdigest(t): n for t, n in ((b"ab", 2), (b"vequ", 1), (b"vequ*", 1), (b"abcdef", 1), (b"abcd*", 1), (b"abcdef*", 1))}
    assert dict(zip(terms.tolist(), often.tolist(), strict=True)) == expected and not len(counted_terms(None)[0])


def test_toxicity_small_table(spark):
    """With few examples too, documents have evidence and most toxic ones are found."""
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, folder).collect()}
    held = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert all(p.evidence for p, _ in held)
    hits = sum(p.predicted for p, y in held if y)
    assert hits >= 0.75 * sum(y for _, y in held)
    assert sum(p.predicted for p, y in held if not y) <= 0.05 * sum(not y for _, y in held)


def brute_rates(a, wanted, keep, steps=4000):
    """The same least squares, by plain steps on the whole matrix of token shares."""
    share = np.maximum(a.sum(0), 1e-9)
    t, r = a.sum(1), np.ones(len(a))
    for _ in range(steps):
        g = (r @ a - wanted) / share
        r = np.maximum(0, r - ((a / t[:, None]) @ g + keep * (r - 1)) / (1 + keep))
    return r


def test_rates_match_targets(spark):
    rng = np.random.default_rng(3)
    tokens, p = rng.integers(1, 500, 300), rng.dirichlet([0.3, 0.3, 0.3], 300)
    rows = spark.createDataFrame([(i, int(n), q.tolist()) for i, (n, q) in enumerate(zip(tokens, p, strict=True))], "__id long, tokens long, posterior array<double>")
    out = sorted(fitted_rates(rows, [0.6, 0.3, 0.1], tolerance=1e-7).collect(), key=lambda r: r["__id"])
    rates = np.array([r.rate for r in out])
    a = p * tokens[:, None] / tokens.sum()
    assert (rates >= 0).all() and np.allclose(rates @ a, [0.6, 0.3, 0.1], atol=5e-3)
    best = brute_rates(a, np.array([0.6, 0.3, 0.1]), 1e-3)
    assert abs((rates @ a - best @ a)).max() < 5e-3


def test_mix(spark):
    rows = mix(
        spark.createDataFrame(
            [(i, ("%%% junk !!" if i % 5 == 0 else "good plain text") + " w" * (i % 9), i) for i in range(200)] + [(None, None, 1), (1000, "", 1)],
            "doc_id long, text string, rate int",
        ),
        spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 200, 2)] + [(None, 1), (1, None)], "doc_id long, quality int"),
        F.concat(F.lit("q"), "quality"),
        {"q0": 0.05, "q1": 0.95},
    ).collect()
    total = sum(r.tokens for r in rows)
    low = sum(r.rate * r.tokens * r.posterior[0] for r in rows) / total
    assert len(rows) == 202 and abs(low - 0.05) < 0.02 and all(r.rate >= 0 for r in rows)
    assert {r.tokens for r in rows if r.doc_id in (None, 1000)} == {1}


def test_mix_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = mix(docs, labels, F.concat(F.lit("q"), "quality"), {"q0": 0.5, "q1": 0.5}).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, 2: 1} and all(abs(r.rate - 1) < 1e-6 for r in rows)
    assert mix(docs.limit(0), labels, F.concat(F.lit("q"), "quality"), {"q0": 0.5, "q1": 0.5}).count() == 0


def test_every_labelled_domain_has_a_target(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    with pytest.raises(ValueError, match="q0"):
        mix(docs, labels, F.concat(F.lit("q"), "quality"), {"q1": 1.0})
    rows = QUERIES["op3_mixing"](spark, "/root/testdata/sf0.01").collect()
    total = sum(r.tokens for r in rows)
    got = [sum(r.rate * r.tokens * r.posterior[d] for r in rows) / total for d in range(4)]
    assert np.allclose(got, [0.10, 0.0, 0.88, 0.02], atol=0.02)


def test_index_is_sent_as_its_examples_and_votes_alike():
    import pickle

    from civicframe.llm import toxicity as tox

    rng = np.random.default_rng(5)
    sets = []
    for key in range(300):
        own = np.unique(rng.integers(1, 4_000, 120).astype(np.uint64) ** 2)
        sets.append((key, float(key % 7 == 0), own, rng.integers(1, 9, len(own)).astype(np.uint32)))
    index, share = tox.indexed(sets)
    data = pickle.dumps(index, 5)
    # Postings, maxima and rows are made again where the index is opened: ten bytes a posting and twenty a term stay.
    assert len(data) < 10 * len(index.of) + 20 * len(index.terms) + 20_000
    again = pickle.loads(data)
    for _, _, own, n in sets[::10]:
        (a, i, s), (b, j, t) = index.vote(own, n, 15, share), again.vote(own, n, 15, share)
        at, w = index.unit(own, n)
        full = np.zeros(len(index.weight))
        full[at] = w
        cosines = np.round(np.add.reduceat(full[index.far_term] * index.far_value, index.far_start[:-1]), 12)
        assert a == b and (i == j).all() and (s == t).all()
        assert np.allclose(np.sort(cosines)[::-1][: len(s)], s, atol=2e-12)


def drawn_texts(rng, texts):
    """Texts of words with common beginnings, among them long, empty and missing ones and copies."""
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(3_000)]
    out = [" ".join(words[i] for i in rng.geometric(0.004, rng.integers(1, 150)) % 3_000) for _ in range(texts)]
    return [None, "", "12 !", "zz zzzzzzz", *out, *out[:50], " ".join(words) * 400]


def test_words_are_looked_up_once(monkeypatch):
    """Texts of one task: a word's terms are hashed when it is first met, not again with every text (op2_toxicity: CPU a GB)."""
    rng = np.random.default_rng(6)
    texts = drawn_texts(rng, 300)
    index, prior = indexed([(i, float(i % 5 == 0), *counted_terms(t)) for i, t in enumerate(texts) if t and i % 3])
    hashed = []
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda t: hashed.append(t) or xxhash.xxh64(t).intdigest())
    reader = Reader(index)
    groups = list(grouped(texts))
    found = [v for g in groups for v in index.votes(*reader.read(g), 15, prior)]
    different = {w for t in texts if t for w in t.encode().translate(bytes(i if chr(i).isalpha() else 32 for i in range(256))).split()}
    assert len(groups) > 3 and sum(groups, []) == texts and len(groups[-1]) == 1
    assert len(hashed) <= 3 * len(different)
    hashed.clear()
    # Copies, in other company: the same to the last bit, and nothing is hashed again.
    again = [index.votes(*reader.read([t]), 15, prior)[0] for t in texts]
    assert not hashed
    assert all(a == b and (i == j).all() and (s == z).all() for (a, i, s), (b, j, z) in zip(found, again, strict=True))
    reader.KEPT = 1
    forgetful = [v for g in groups for v in index.votes(*reader.read(g), 15, prior)]
    assert [v[0] for v in forgetful] == [v[0] for v in found] and hashed


@pytest.mark.parametrize("first", [0.2, 0.95])
@pytest.mark.parametrize("wide", [0, 10, 5_000])
def test_texts_searched_together_are_exact(first, wide):
    """Votes of many texts at once against plain sums over all terms, whatever part of the terms is kept as rows."""
    rng = np.random.default_rng(7)
    texts = drawn_texts(rng, 300)
    index, prior = indexed([(i, float(i % 5 == 0), *counted_terms(t)) for i, t in enumerate(texts) if i % 3])
    index.WIDE, index.FIRST, index.block = wide, first, 8
    index.spread()
    dense = np.zeros((len(index.keys), len(index.weight)))
    dense[np.repeat(np.arange(len(dense)), np.diff(index.far_start)), index.far_term] = index.far_value
    reader = Reader(index)
    found = [v for g in grouped(texts) for v in index.votes(*reader.read(g), 15, prior)]
    for text, (raw, i, s) in zip(texts, found, strict=True):
        own, n = counted_terms(text)
        q = np.zeros(len(index.weight))
        at, w = index.unit(own, n)
        q[at] = w
        full = np.round(dense @ q, 12)
        best = [j for j in np.lexsort((np.arange(len(full)), -full)) if full[j] > 0][:15]
        assert np.allclose(s, full[best], atol=3e-12) and np.allclose(full[i], full[best], atol=3e-12)
        share = (full[best] @ index.labels[i] + prior) / (full[best].sum() + 1) if len(own) else prior / 16
        assert abs(raw - share) < 1e-10


def test_index_without_examples_votes():
    index, share = indexed([])
    votes = index.votes(*Reader(index).read([None, "words of a text"]), 15, 0.5)
    assert share == 0 and [v[0] for v in votes] == [0.5 / 16, 0.5]
