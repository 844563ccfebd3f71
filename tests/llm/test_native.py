"""URL filter, exact dedup, secret scan and sharding against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from civicframe.llm.exact_dedup import exact_dedup
from civicframe.llm.hilbert import curve, document_shards, hilbert_index
from civicframe.llm.queries import ORACLE, QUERIES, URL_RULES
from civicframe.llm.secret_scan import BASE, MORE, Rule, digest, secret_scan, trigram_query
from civicframe.llm.url_filter import url_filter
from pyspark.sql import functions as F
from workload.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (1, None, "x"),
    (2, "", "x"),
    (3, "a  b\tc", None),
    (4, "a b c", "x"),
    (4, "a b c", "x"),
    (None, "a\nb c", "x"),
    (6, "é\u00a0b", "x"),
    (7, "word " * 30000, "x"),
    (8, "A b c", "x"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, 7, "s") for r in ODD], "doc_id long, text string, lang string, shard int, spans string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def space(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_sql(spark):
    assert compare(QUERIES["op6_exact_dedup"](spark, FOLDER), connect(FOLDER), ORACLE["op6_exact_dedup"]) is None


def test_exact_dedup_odd_rows(spark, odd):
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[space(t)].append(i)
    expected = Counter()
    for i, t, _ in ODD:
        ids = [x for x in groups[space(t)] if x is not None]
        keep = min(ids, default=None)
        expected[(i, keep, len(groups[space(t)]), i == keep, hashlib.sha256(space(t).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_dedup(odd).collect()) == expected
    assert exact_dedup(empty(spark)).count() == 0


def test_urls_repeated_very_long_and_none(spark):
    rules = [("allow", "com", "/"), ("block", "net", "/x/")]
    long = "http://a.net/x/" + "q" * 200_000
    urls = [(1, "http://a.com/b"), (1, "http://a.com/b"), (2, long), (2, long), (3, "http://b.org/" + "z" * 90_000), (None, None)]
    pages = spark.createDataFrame([(*u, "r", "v", 1.0) for u in urls], "page_id long, url string, rule string, verdict string, block_score double")
    got = [(r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in url_filter(pages, rules).collect()]
    assert len(got) == 6 and got.count((1, "a.com", 2, "com/", "allow")) == 2
    assert got.count((2, "a.net", 200_003, "net/x/", "block")) == 2
    assert {g[0]: g[3] for g in got if g[0] not in (1, 2)} == {3: None, None: None}
    assert url_filter(pages.limit(0), rules).count() == 0


def test_copies_without_any_id_all_stay(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a  b"), (None, "c"), (4, "c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()), key=repr)
    assert got == sorted([(None, None, 2, True)] * 2 + [(None, 4, 2, False), (4, 4, 2, True)], key=repr)


def brute_spans(text, rules):
    found = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), rank, r.kind, m.end()))
    return sorted(found)


SECRETS = [
    (1, 'x password = "hunter22" \U0001f600 Api_Key:abcdef.=/ token=abc secret=token =abcdefg'),
    (2, "AKIA" + "Q" * 16 + " AKIA1 " + "ab12" * 6 + "ab12" * 5),
    (3, "\U0001f600é ghp_" + "a" * 36 + " xoxb-1234567890-ab eyJhbGciOiJI.eyJzdWIiOiIx -----BEGIN RSA PRIVATE KEY-----"),
    (4, None),
    (5, ""),
    (5, "passwd='abcdefgh"),
    (6, "ordinary " * 5000 + "SECRET:zzzzzz" + "f" * 40),
    (None, "token: q1w2e3r4"),
]


def test_secret_spans(spark):
    docs = spark.createDataFrame([(*r, 1) for r in SECRETS], "doc_id long, text string, spans int")
    rules = BASE + MORE
    got = Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in secret_scan(docs).collect())
    assert got == Counter((i, tuple(brute_spans(t, rules))) for i, t in SECRETS)
    assert secret_scan(docs.limit(0)).count() == 0


def test_secret_spans_of_a_text_with_many_hits(spark):
    text = "".join(f"\u00e9 token={'abcdefg'[: 5 + i % 3]}{i % 7} \U0001f600" for i in range(5000))
    docs = spark.createDataFrame([(1, text), (2, text[:3000])], "doc_id long, text string")
    for r in secret_scan(docs).collect():
        want = brute_spans(text if r.doc_id == 1 else text[:3000], BASE + MORE)
        assert [tuple(s) for s in r.spans] == want


def test_secret_query_on_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    kinds = [r.kind for r in BASE]
    rows = QUERIES["op8_secret_scan"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute_spans(texts[r.doc_id], BASE + MORE)
        base = [s for s in spans if s[2] in kinds]
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in base) for k in kinds]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def test_trigram_queries_are_necessary():
    for rule, text in [(BASE[0], "api_key=1"), (BASE[0], "PASSWD:x"), (MORE[0], "gho_"), (MORE[2], "-----BEGIN EC PRIVATE KEY-----")]:
        low = text.lower()
        assert any(all(g in low for g in need) for need in trigram_query(rule.pattern))
    assert trigram_query("[0-9a-f]{24,}") is None and trigram_query("ab|cdef") is None
    assert trigram_query("x?abcd") is not None


def test_rule_without_trigram_scans_all(spark):
    docs = spark.createDataFrame([(1, "ab 12"), (2, None)], "doc_id long, text string")
    got = digest(secret_scan(docs, [Rule("num", "[0-9]+")]), ["num"]).collect()
    assert sorted((r.doc_id, r.n_num, r.spans) for r in got) == [(1, 1, "num:3:5"), (2, 0, "")]


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    side = 2**bits
    cells = spark.range(side**dims).select(*(F.floor(F.col("id") / side**i) .cast("long").alias(f"c{i}") for i in range(dims)))
    cells = cells.select(*((F.col(f"c{i}") % side).alias(f"c{i}") for i in range(dims)))
    names = [f"c{i}" for i in range(dims)]
    rows = sorted((r.h, [r[n] for n in names]) for r in cells.withColumn("h", hilbert_index([F.col(n) for n in names], bits)).collect())
    assert [h for h, _ in rows] == list(range(side**dims))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(rows, rows[1:], strict=False))
    assert len(curve(dims)[0]) == 4**dims * dims


def check_shards(rows, texts, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min([sizes[s] for s in range(shards)]) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in rows)
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)


def test_shards(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [r.asDict() for r in QUERIES["op9_hilbert_shards"](spark, FOLDER).collect()]
    assert {r["law"] for r in rows} == {"rows"}
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 8)
    check_shards([r.asDict() for r in document_shards(odd, 4).collect()], [(i, t) for i, t, _ in ODD], 4)
    assert document_shards(empty(spark)).count() == 0


URLS = [
    ("http://a.com", "a.com", "", None),
    ("http://WWW.Example.com/en/x?y=/z", "www.example.com", "/en/x", "allow"),
    ("https://m.example.com/en/1#top", "m.example.com", "/en/1", "block"),
    ("x://example.com/EN/", "example.com", "/EN/", "allow"),
    ("http://foo.net/fr/1/2", "foo.net", "/fr/1/2", "block"),
    ("http://notcom/en/", "notcom", "/en/", None),
    ("no scheme", "", "", None),
    (None, "", "", None),
    ("a?://b.com/c", "b.com", "/c", "allow"),
    ("http://b.org/\nq", "b.org", "/\nq", None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = sorted(url_filter(pages, URL_RULES).collect(), key=lambda r: r.page_id)
    for r, (_, host, path, verdict) in zip(rows, URLS, strict=True):
        assert (r.host, r.path) == (host, path)
        assert (r.rule is None) == (verdict is None)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter(pages.limit(0), URL_RULES).count() == 0
    allowed = url_filter(pages.where("page_id in (1, 5)"), URL_RULES).collect()
    assert {r.verdict for r in allowed} == {"allow"}


def test_trees_learn_a_lexical_rule(spark):
    urls = [
        (i, f"http://h{i % 7}.{'ads' if i % 2 else 'lib'}/{'a/' * (i % 3)}{i}{'?x=1&y=22&z=3' if i % 2 else ''}") for i in range(600)
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = [(("block" if h % 2 else "allow"), f"h{h % 7}.{'ads' if h % 2 else 'lib'}", "/") for h in range(10)]
    rows = url_filter(pages, rules).collect()
    free = [r for r in rows if r.rule is None]
    assert free and sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in free) >= 0.9 * len(free)
