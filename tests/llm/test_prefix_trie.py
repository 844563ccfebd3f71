"""Conversation tries, running values and list ranks against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from civicframe.llm import prefix_trie as module
from civicframe.llm.prefix_trie import prefix_trie
from civicframe.llm.queries import ORACLE, QUERIES
from civicframe.llm.scans import list_ranks, running
from workload.compare import compare, connect


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    out, below = Counter(), {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves = sum(below[j][0] for j in children[k]) if children[k] else 1
        below[k] = (leaves, (len(members[k]) - 1) * words + sum(below[j][1] for j in children[k]))
        ends = ",".join(map(str, sorted(c for c in members[k] if len(rebuilt[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out[min(members[k]), len(k), parent, len(members[k]), len(children[k]), *below[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


KINDS = "conv_id long, turn long, role string, text string, depth int, h1 string, id long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KINDS)


@pytest.fixture
def odd():
    rng = random.Random(3)
    some = [
        (rng.choice([None, *range(50)]), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["u", "a", None]), rng.choice(["x y", "x", None, "z"]))
        for _ in range(200)
    ]
    # A long conversation, a repeated row, a very long text, one turn that a taker leaves out.
    return some + [(7, i, "u", "long") for i in range(60)] + [(8, 1, "u", "x")] * 3 + [(9, 0, "u", "w " * 50000), (61, 0, "u", "x")]


def test_against_brute_force(spark, odd):
    assert Counter(map(tuple, prefix_trie(frame(spark, odd)).collect())) == brute(odd)


def test_small_stretches(spark, odd, monkeypatch):
    monkeypatch.setattr(module, "SIBLINGS", 3)
    monkeypatch.setattr(module, "CHUNK", 2)
    monkeypatch.setattr(module, "list_ranks", lambda links: list_ranks(links, sparse=4, walked=5))
    assert Counter(map(tuple, prefix_trie(frame(spark, odd)).collect())) == brute(odd)


def test_hot_conversation_and_hot_node(spark):
    """A third of the rows in one conversation, a third of the conversations alike."""
    rows = [(5, i, "u", f"t{i}") for i in range(300)] + [(1000 + i, k, "u", f"same{k}") for i in range(100) for k in range(3)]
    rows += [(2000 + i, 0, "u", f"own{i}") for i in range(300)]
    assert Counter(map(tuple, prefix_trie(frame(spark, rows).repartition(6)).collect())) == brute(rows)


def test_no_conversations(spark):
    assert prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie(frame(spark, [(None, 1, "u", "x")])).count() == 0


def test_only_turnless(spark):
    lone = next(c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "u", "x")]
    assert Counter(map(tuple, prefix_trie(frame(spark, rows)).collect())) == brute(rows)


def test_running_values(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 9), rng.randint(-(10**18), 10**18), rng.randint(0, 50)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, o long")
    for factor in (1, 0x9E3779B97F4A7C15):
        held, expected = defaultdict(lambda: (0, 0)), Counter()
        for k, o, v in sorted((k, o, v) for k, v, o in rows):
            place, run = held[k]
            held[k] = (place + 1, (run * factor + v) % 2**64)
            expected[k, place + 1, held[k][1], run] += 1
        found = running(df, [F.col("o"), F.col("v")], ["k"], ["v"], factor)
        wrap = 2**64
        assert Counter((r.k, r.place, r.run_v % wrap, r.prev_v % wrap) for r in found.collect()) == expected


@pytest.mark.parametrize("walked", [10, 1000])
def test_list_ranks(spark, walked):
    rng = random.Random(7)
    order = list(range(700))
    rng.shuffle(order)
    lists = [order[:500], order[500:699], order[699:]]
    weight = {a: rng.randint(1, 9) for a in order}
    links = [(a, n, weight[a]) for items in lists for a, n in zip(items, [*items[1:], None], strict=True)]
    expected = {}
    for items in lists:
        left = 0
        for i, a in enumerate(reversed(items)):
            left += weight[a] if i else 0
            expected[a] = left
    found = list_ranks(spark.createDataFrame(links, "a long, nxt long, w long"), sparse=4, walked=walked)
    assert {r.a: r.left for r in found.collect()} == expected


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op12_prefix_trie"](spark, folder), connect(folder), ORACLE["op12_prefix_trie"]) is None
