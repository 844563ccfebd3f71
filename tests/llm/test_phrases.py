"""Removal of recurring passages against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from civicframe.llm.phrase_automata import Block, compiled, covered, leftmost_least, phrases, repeated_phrases
from civicframe.llm.queries import ORACLE, QUERIES
from workload.compare import compare, connect


def brute(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    often = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = Counter()
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - size + 1) if often[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        out[doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def got(df):
    rows = df.collect()
    for r in rows:
        assert sum(s.length for s in r.spans) == r.n_removed
    return Counter((r[0], r.n_words, r.n_removed, r.kept) for r in rows)


def texts(seed, letters="ab"):
    rng = np.random.default_rng(seed)
    rows = [(i if i % 11 else None, " ".join(rng.choice(list(letters), rng.choice([0, 3, 7, 20, 60])))) for i in range(60)]
    return rows + [(1, None), (2, ""), (2, " \t"), (3, "a" * 5000), (3, "a " * 200), (4, "é b " * 9), (4, "é b " * 9), (5, "a\nb\x0bc\x85d")]


@pytest.mark.parametrize("size, block, shards", [(5, 40, 3), (7, 1000, 1), (12, 90, 5), (1, 50, 2), (35, 10**6, 4)])
def test_against_brute_force(spark, size, block, shards):
    rows = texts(size)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, spans string")
    assert got(repeated_phrases(df, size=size, block=block, shards=shards)) == brute(rows, size)


def test_blocks_do_not_matter(spark):
    """One passage in a third of all rows, in documents dealt to many blocks and partitions."""
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(i, f"a{i} b{i} {shared} c{i}" if i % 3 == 0 else " ".join(f"w{i}x{k}" for k in range(60))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 35)
    assert sum(n for _, _, n, _ in expected) == 100 * 50
    for block, parts in ((100, 7), (10**6, 1)):
        assert got(repeated_phrases(df.repartition(parts), block=block)) == expected


def test_phrases_are_whole_wherever_one_of_their_windows_is():
    lines = [b"a b c d e f g h", b"x b c d e f y", b"d e f g h", b"e f g h a b c d"]
    block = Block(lines, 3)
    _, _, number, often = block.windows(block.at)
    again = often[number] > 1
    found = phrases(block.at[again], number[again])
    every = Counter(w for s, n in found for w in range(s, s + n))
    assert len({number[np.searchsorted(block.at, w)] for w in every}) == len(every) == int((often > 1).sum())
    automaton = compiled(block, found)
    words = [w for line in lines for w in line.split()]
    for k, s in enumerate(block.starts):
        own = lines[k].split()
        seen = covered(automaton, block.numbers[s : s + len(own)])
        grams = Counter(tuple(w[i : i + 3]) for w in map(bytes.split, lines) for i in range(len(w) - 2))
        expected = [any(grams[tuple(own[i : i + 3])] > 1 for i in range(max(0, p - 2), min(p, len(own) - 3) + 1)) for p in range(len(own))]
        assert list(seen) == expected and len(words) == len(block.numbers)


def test_leftmost_least():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 3, 20, 33):
        expected = [i + int(np.argmin(x[i : i + width])) for i in range(len(x) - width + 1)]
        assert list(leftmost_least(x, width)) == expected


def test_empty_table(spark):
    assert repeated_phrases(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op11_phrase_automata"](spark, folder), connect(folder), ORACLE["op11_phrase_automata"]) is None
