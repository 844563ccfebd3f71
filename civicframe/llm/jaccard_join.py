"""Similarity join on word n-grams by T-occurrence search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import components, dropped, stored, tasks

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(31)
#: Words whose hash a task remembers, at most.
REMEMBERED = 200_000


class Words(dict):
    """Hash by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX[1]
    return x ^ (x >> _SHIFT)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, size: int, known: Words) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of runs of ``size`` words; of all words if there are fewer."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    run = each[: len(each) - size + 1].copy()
    for i in range(1, size):
        run = mixed(run * _MIX[0]) + each[i : len(each) - size + 1 + i]
    return np.unique(mixed(run))


@cache
def level_tops(num: int, den: int) -> list[int]:
    """Largest set size of each level: a set's partners are of its level or one beside it."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * den // num))
    return tops


def levels(n: list[int], num: int, den: int) -> np.ndarray:
    """The level of each set size."""
    return np.searchsorted(level_tops(num, den), n)


#: Parts of a class, of which a key leaves out one.
PARTS = 3
#: The last bits of a key: of the level that it is for.
LEVEL = np.uint64(63)


@cache
def classes(level: int, num: int, den: int) -> tuple[int, int]:
    """For a level: the number of classes, and how many of them a set need not be told by."""
    differ = 2 * level_tops(num, den)[level] * (den - num) // (den + num)
    least = differ // 2 + 1
    spare = -(-least // 5) if differ else 0
    return least + spare, spare


def routing_keys(found: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys such that two different sets of similarity ``num / den`` or more share one at least.

    Linked sets of a level differ in at most d shingles. Dealt into d // 2 + 1 + e classes, they
    differ in one shingle at most in e + 1 classes or more; of a class's three parts two then agree,
    and a key is the fingerprint of two parts. Texts that only share a passage agree in small keys,
    so a set leaves out keys below a size that it chooses: the largest for which at most e of its
    classes have a smaller key. Of the e + 1 classes one has none in the set that chose the larger
    size, and keys that agree are of one size, so a common key is left.

    A set has keys for its own level and for the one above, so sets of one level share a key for
    it, sets of two levels a key for the larger. The last bits of a key tell the level.
    """
    n = len(found)
    if n * den < num * (n + 1):  # no other set can be near enough
        return np.zeros(0, np.uint64)
    own = int(levels([n], num, den)[0])
    keys = []
    for level in (own, own + 1):
        m, spare = classes(level, num, den)
        at = ((found >> np.uint64(17)) % np.uint64(m * PARTS)).astype(np.int64)
        # Sums of halves of the fingerprints are exact in doubles.
        sums = [np.bincount(at, w, m * PARTS).reshape(m, PARTS) for w in (
            (found & np.uint64(0xFFFFFFFF)).astype(float), (found >> np.uint64(32)).astype(float), np.ones(n))]
        low, high, size = (x.sum(1, keepdims=True) - x for x in sums)
        place = np.arange(m * PARTS, dtype=np.uint64).reshape(m, PARTS) * _MIX[2] + np.uint64(level)
        key = mixed(mixed(low.astype(np.uint64) * _MIX[0] + high.astype(np.uint64)) + place)
        key = (key & ~LEVEL) | (np.uint64(level) & LEVEL)
        keys.append(key[size >= np.sort(size.min(1))[spare]])
    return np.concatenate(keys)


def sketch_bits(level: int, num: int, den: int) -> int:
    """Bits of a level's sketches: a power of two, two a shingle or more."""
    return max(256, 1 << (2 * level_tops(num, den)[level] - 1).bit_length())


def sketch(found: np.ndarray, bits: int) -> np.ndarray:
    """For each of ``bits`` buckets whether an odd number of shingles is in it, as 64-bit words.

    Two sets' sketches differ in no more bits than the sets have shingles that only one holds.
    """
    odd = np.bincount((found >> np.uint64(11) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """A sketch of ``bits`` or more as one of ``bits``."""
    return np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)


def alike(words: np.ndarray, size: np.ndarray, side: np.ndarray | None, num: int, den: int, above: int = 0) -> np.ndarray:
    """For each set the first one of its tree, under ties of sets that their sketches do not keep from being linked.

    ``words`` holds a sketch a row. Order, ``side`` and ``above`` are those of ``divide_skip``.
    """
    tree = np.arange(len(size))
    for i in range(max(1, int(np.searchsorted(size, above, "right"))), len(size)):
        least = int(np.searchsorted(size, -(-num * int(size[i]) // den)))
        if least >= i:
            continue
        differ = np.bitwise_count(words[least:i] ^ words[i]).sum(1, dtype=np.int64)
        near = differ * (num + den) <= (size[least:i] + size[i]) * (den - num)
        if side is not None:
            near &= side[least:i] != side[i]
        for other in np.unique(tree[least:i][near]):
            mine = tree[i]
            if other != mine:
                tree[: i + 1][tree[: i + 1] == max(other, mine)] = min(other, mine)
    return tree


class Forest:
    """Union-find over numbers; the smallest of a tree is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def inverted(sets: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists of the shingles that two sets or more hold.

    ``name`` has for each place in the sets the number of its list, or -1; list k is
    ``lists[start[k] : start[k + 1]]``, the numbers of the sets in ascending order. Arrays that have
    a place for every shingle go as soon as they are used: some 32 bytes a shingle at most, with the sets.
    """
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")  # by shingle, then by set
    flat = flat[order]
    new = np.ones(len(flat) + 1, bool)
    np.not_equal(flat[1:], flat[:-1], out=new[1:-1])
    del flat
    shared = ~(new[:-1] & new[1:])
    name = np.full(len(order), -1, np.int32)
    order, new = order[shared], new[:-1][shared]
    name[order] = np.cumsum(new, dtype=np.int32) - 1
    lists = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
    return name, lists, np.append(np.flatnonzero(new), len(order))


#: How dear a probe of a long list is against a step of the merge, in the rule for the number of long lists.
MU = 0.01


def divide_skip(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int, above: int = 0) -> Forest:
    """Trees of linked sets. With ``side`` (booleans), only pairs of a set of each side are looked at.

    Sets come in ascending order of size; pairs whose larger set has ``above`` shingles or fewer are left out. Each is a query against the smaller ones: it needs at
    least T of its shingles in common. The T / (mu log M + 1) longest of its inverted lists are put
    aside; the others are merged by counting, and what occurs in T less the number of long lists is
    looked for in the long ones by binary search, until the overlap is reached or out of reach. Sets
    that are already in the query's tree are not probed: a link more does not change the trees.
    """
    forest = Forest(len(sets))
    size = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(size)])
    name, lists, start = inverted(sets, size)
    for i in range(max(1, int(np.searchsorted(size, above, "right"))), len(sets)):
        n = int(size[i])
        least = int(np.searchsorted(size, -(-num * n // den)))
        if least >= i:
            continue
        need = -(-num * n // den)
        own = name[first[i] : first[i + 1]]
        own = own[own >= 0]
        if len(own) < need:
            continue
        length = start[own + 1] - start[own]
        by_length = np.argsort(length, kind="stable")
        own = own[by_length]
        long = min(need - 1, int(need / (MU * np.log2(max(int(length.max()), 2)) + 1)), len(own) - 1)
        short, far = own[: len(own) - long], own[len(own) - long :]
        met = np.concatenate([lists[start[k] : start[k + 1]] for k in short])
        met = met[(met >= least) & (met < i)]
        if not len(met):
            continue
        seen = np.bincount(met - least, minlength=i - least)
        found = np.flatnonzero(seen >= need - long)
        if side is not None:
            found = found[side[found + least] != side[i]]
        mine = forest.root(i)
        # Of the type of the lists, which a search would convert else.
        found = np.array([j for j in found if forest.root(int(j) + least) != mine], np.int32)
        have, at = seen[found], found + least
        # The overlap that a pair needs, from both sizes.
        wanted = -(-num * (n + size[at]) // (num + den))
        for left, k in zip(range(len(far), 0, -1), far[::-1], strict=True):
            open_ = have + left >= wanted
            if not open_.all():
                have, at, wanted = have[open_], at[open_], wanted[open_]
            if not len(at):
                break
            own_list = lists[start[k] : start[k + 1]]
            place = np.minimum(np.searchsorted(own_list, at), len(own_list) - 1)
            have = have + (own_list[place] == at)
        for j in at[have >= wanted]:
            forest.join(i, int(j))
    return forest


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    num: int = 4,
    den: int = 5,
    block_rows: int = 6_000,
    block_shingles: int = 2_000_000,
    block_bits: int = 128_000_000,
) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id`` under links of similarity ``num / den`` or more.

    Four steps. (1) Sets are fingerprinted; equal sets are one from here on. (2) Sets that share a
    routing key meet; keys are merged within a batch first, so a hot key has one row per batch.
    (3) Sets that met on a level, directly or through others, are told apart by their sketches, which
    take some 3 bits a shingle: only ties that a sketch cannot rule out count from here on.
    (4) Sets that are still together are searched by ``divide_skip`` in one task, or in one task per
    pair of blocks where they are more than ``block_rows`` or ``block_shingles``; so are sketches by
    ``alike`` where they are more than four times ``block_rows`` or more than ``block_bits``.
    No pair leaves a task: each sends the trees that it has found, at most a row per set.
    A group holds sets of its level and of the one below, and a pair of the latter is looked at on its
    own level, so sets of many sizes do not become one group through weak likeness from size to size.
    A task holds two blocks at most, some 32 bytes a shingle.

    Fingerprints have 64 bits; equality of sets is that of their 128-bit digests. Texts without
    words and rows without an id have no partners; the latter get no component. Rows that share an
    id are one node of the graph. Repeated rows and ties change nothing. An empty table gives an
    empty result. Ids are integers.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            n, digest, bits = [], [], []
            for t in b.column("text"):
                found = shingles(t.as_py(), words, known)
                n.append(len(found))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                own = int(levels([len(found)], num, den)[0])
                bits.append(sketch(found, sketch_bits(own, num, den)).tobytes() if len(found) else None)
            level = levels(n, num, den).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(level), pa.array(bits, pa.binary())],
                names=["id", "n", "digest", "level", "sketch"],
            )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            texts_of, order = b.column("text"), np.argsort(ids, kind="stable")
            done: set[bytes] = set()
            held: list[tuple[np.ndarray, int]] = []
            room = 0
            for i in order:
                found = shingles(texts_of[int(i)].as_py(), words, known)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if digest in done:
                    continue
                done.add(digest)
                own = routing_keys(found, num, den)
                if len(own):
                    held.append((own, int(ids[i])))
                    room += len(own)
                if room > 1_500_000:
                    yield merged(held)
                    held, room = [], 0
            if held:
                yield merged(held)

    def merged(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        """A row per key, with the smallest id; sets that met here are tied by keys of their own, once a level."""
        ids = np.array([i for _, i in held], np.int64)
        key = np.concatenate([k for k, _ in held])
        who = np.repeat(np.arange(len(held)), [len(k) for k, _ in held])
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        leader = who[np.flatnonzero(new)[np.cumsum(new) - 1]]
        # A set on a level is a node; of the ties only trees are sent.
        room = int(LEVEL) + 1
        nodes, bits = len(held) * room, (key & LEVEL).astype(np.int64)
        ties = np.unique(((leader * room + bits) * nodes + who * room + bits)[leader != who])
        forest = Forest(nodes)
        for a, b in zip((ties // nodes).tolist(), (ties % nodes).tolist(), strict=True):
            forest.join(a, b)
        tied = np.unique(ties % nodes)
        low, high = ids[np.array([forest.root(x) for x in tied.tolist()], np.int64) // room], ids[tied // room]
        tie_key = mixed(low.astype(np.uint64) * _MIX[0] + mixed(high.astype(np.uint64) + _MIX[2]))
        tie_key = (tie_key & ~LEVEL) | (tied % room).astype(np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key[new], tie_key, tie_key]).view(np.int64)),
                pa.array(np.concatenate([ids[leader[new]], low, high])),
            ],
            names=["key", "id"],
        )

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def ties() -> pa.RecordBatch:
            ordered = sorted(held, key=lambda x: (x[1], x[0]))
            _, on, lo, hi = group
            bits = sketch_bits(max(on - 1, 0), num, den)
            each = np.array([folded(np.frombuffer(x[2], np.uint64), bits) for x in ordered])
            size = np.array([x[1] for x in ordered])
            side = None if lo == hi else np.array([x[3] == lo for x in ordered])
            tree = alike(each, size, side, num, den, level_tops(num, den)[on - 1] if on else 0)
            ids = np.array([x[0] for x in ordered], np.int64)
            tied = np.flatnonzero(tree != np.arange(len(tree)))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[tied]), pa.array(ids[tree[tied]]), pa.array(np.full(len(tied), on))], names=["a", "b", "on"]
            )

        for b in batches:
            columns = [b.column(c) for c in ("met", "on", "lo", "hi", "id", "n", "sketch", "block")]
            for i in range(b.num_rows):
                *own, key, n, bits, block = (c[i].as_py() for c in columns)
                if group != own:
                    if len(held) > 1:
                        yield ties()
                    group, held = own, []
                held.append((key, n, bits, block))
        if len(held) > 1:
            yield ties()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        group, held = None, []

        def edges() -> pa.RecordBatch:
            ordered = sorted(held, key=lambda x: (len(x[1]), x[0]))
            _, level, lo, hi = group
            side = None if lo == hi else np.array([x[2] == lo for x in ordered])
            forest = divide_skip([x[1] for x in ordered], side, num, den, level_tops(num, den)[level - 1] if level else 0)
            up = [(ordered[i][0], ordered[forest.root(i)][0]) for i in range(len(ordered)) if forest.root(i) != i]
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in up], pa.int64()), pa.array([b for _, b in up], pa.int64())], names=["a", "b"]
            )

        for b in batches:
            columns = [b.column(c) for c in ("met", "on", "lo", "hi", "block", "id", "text")]
            for i in range(b.num_rows):
                *own, block, key, text = (c[i].as_py() for c in columns)
                if group != own:
                    if len(held) > 1:
                        yield edges()
                    group, held = own, []
                found = shingles(text, words, known)
                if len(found):
                    held.append((key, found, block))
        if len(held) > 1:
            yield edges()

    sets = stored(texts.mapInArrow(measure, "id long, n long, digest binary, level long, sketch binary"))
    known_sets = sets.where("n > 0 and id is not null")
    first = known_sets.groupBy("digest").agg(F.min("id").alias("first"))
    keyed = texts.where("id is not null").mapInArrow(route, "key long, id long")
    # Each id with the smallest one under its key: as many rows as ids, however many share the key.
    # What is worked out from a key or an id comes after the window, else it is exchanged with them.
    starred = keyed.selectExpr(
        "key", "id", "first_value(id) over (partition by key order by id rows between unbounded preceding and current row) as least"
    ).where("least != id")
    # Written as plain ids: of hashes the exchange would take more room beside that of the keys.
    starred = stored(starred.select(F.col("least").alias("a"), F.col("id").alias("b"), F.expr(f"key & {LEVEL}L").alias("bits")).distinct())

    def node(of: str, on: str) -> Column:
        """An id on a level is a node of its own. Nodes that fall together only make a group larger."""
        return F.xxhash64(of, F.expr(f"{on} & {LEVEL}L"))

    def dealt(met: DataFrame, size: Column, most_rows: int, most: int) -> DataFrame:
        """Rows of ``met(met, on, level, ..)`` that meet others, once for each pair of blocks ``lo, hi`` that their ``block`` is in."""
        # Where all are of the level below, their pairs are looked at on that one.
        groups = met.groupBy("met", "on").agg(F.count("id").alias("rows"), F.sum(size).alias("all"), F.max("level").alias("top"))
        groups = groups.where("rows > 1 and top = on")
        blocks = F.ceil(F.greatest(F.col("rows") / most_rows, F.col("all") / most))
        return (
            met.join(groups.select("met", "on", blocks.alias("__blocks")), ["met", "on"])
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("__blocks")))
            .withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
            .withColumns({"lo": F.least("block", "__other"), "hi": F.greatest("block", "__other")})
            .drop("__blocks", "__other")
        )

    group = ["met", "on", "lo", "hi"]
    spark = docs.sparkSession
    met = components(starred.select(node("a", "bits").alias("a"), node("b", "bits").alias("b")))
    dropped(starred)
    placed = known_sets.select("id", "digest", "level", "n", "sketch", F.explode(F.array("level", F.col("level") + 1)).alias("on"))
    placed = placed.withColumn("node", node("id", "on")).join(met.toDF("node", "met"), "node").join(first, "digest")
    placed = stored(placed.dropDuplicates(["digest", "met", "on"]).select(F.col("first").alias("id"), "met", "on", "level", "n", "sketch"))
    sifted = dealt(placed, F.length("sketch") * 8, 4 * block_rows, block_bits).select(*group, "block", "id", "n", "sketch")
    ties = sifted.repartition(tasks(spark), *group).sortWithinPartitions(*group).mapInArrow(sift, "a long, b long, on long")
    near = components(ties.select(node("a", "on").alias("a"), node("b", "on").alias("b")))
    met = placed.select("id", "on", "level", "n", node("id", "on").alias("node")).join(near.toDF("node", "met"), "node")
    met = stored(met.select("id", "met", "on", "level", "n").distinct())
    dropped(placed)
    parts = dealt(met, F.col("n"), block_rows, block_shingles).select(*group, "block", "id")
    together = (
        texts.join(parts.hint("merge"), "id")  # what met grows with the corpus: never broadcast
        .select(*group, "block", "id", "text")
        .repartition(tasks(spark), *group)
        .sortWithinPartitions(*group)
    )
    linked = together.mapInArrow(search, "a long, b long")
    copies = known_sets.join(first.select("digest", "first"), "digest").where("id != first")
    found = components(linked.union(copies.select("first", "id")))
    return sets.join(found, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
