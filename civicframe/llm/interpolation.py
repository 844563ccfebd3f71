"""Language-model scores by deleted interpolation of unigrams and bigrams.

Counts are exchanged in blocks. A block of documents knows its distinct n-grams, sorted by a 64-bit
fingerprint; it sends each shard of the fingerprints' range its part of them with their counts, and
gets back the totals of the whole corpus in the same order. A row is a block's part of a shard, so
the shuffle moves each distinct n-gram of a block once and no task sees a whole vocabulary.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard_join import _MIX, Words, mixed, words_of
from .store import stored, tasks

#: Fingerprints of the marks before a text and after it; words hash into the same range.
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Tokens of a block, about.
BLOCK = 3_000_000
#: Tokens of a block that are scored at a time, about; a longer document is scored as a whole.
SLICE = 200_000
#: Characters of input for each shard of the exchange.
SHARD_CHARS = 20_000_000
#: Context counts fall into buckets by powers of two up to this one.
BUCKETS = 18
#: Width of the bins, in natural logarithms, in which held-out tokens are counted for the mixture weights.
BIN = 0.1
#: Stands for the bin of what was never seen.
NEVER = -9999

PACK, ASK, ANSWER, SIZE = range(4)
ROW = "kind int, block long, grams int, shard int, goes long, a binary, b binary, c binary, d binary"


def squeezed(x: np.ndarray) -> bytes:
    """Integers with bytes of like weight side by side, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def spread(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def sorted_squeezed(x: np.ndarray) -> bytes:
    """Numbers that mostly ascend, as differences; any others come back right too."""
    return squeezed(np.diff(x, prepend=np.uint64(0)))


def sorted_spread(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data, np.uint64), dtype=np.uint64)


def pairs_of(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of (word before, word) for every token; ``starts``: places of first tokens."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = START
    return mixed(mixed(before * _MIX[0]) + words * _MIX[2])


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the whole binary logarithm of its count."""
    return np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))) + 1, BUCKETS), 0).astype(np.int64)


def mixture_weights(bins: list[tuple], width: float = BIN, rounds: int = 200) -> np.ndarray:
    """Weights of bigram, unigram and uniform per bucket, by expectation-maximisation.

    ``bins``: (bucket, bin of the bigram's ratio to uniform or None, same for the unigram, tokens).
    One token's worth of even weights is added, so none is 0 but the bigram's for unseen contexts.
    A bucket without held-out tokens gets the weights of all others together.
    """
    even = np.full(3, 1 / 3)

    def fit(rows: list[tuple]) -> np.ndarray:
        ratio = np.array([[0 if q is None else np.exp(q * width) for q in (q2, q1)] + [1.0] for _, q2, q1, _ in rows])
        n = np.array([r[3] for r in rows], float)
        weight = even.copy()
        for _ in range(rounds):
            part = ratio * weight
            part /= part.sum(1, keepdims=True)
            new = n @ part + even
            new /= new.sum()
            if np.abs(new - weight).max() < 1e-10:
                break
            weight = new
        return weight

    by = defaultdict(list)
    for r in bins:
        by[r[0]].append(r)
    everything = fit(bins) if bins else even
    weights = np.array([fit(by[b]) if b in by else everything for b in range(BUCKETS + 1)])
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def interpolated(
    docs: DataFrame, train: Column, fold: Column, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``id_col, trained, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words between ASCII white space, A to Z lower-cased, and one end per text. Counts
    come from the rows that ``train`` picks; of these, the ones that ``fold`` picks are held out
    while the mixture weights are learned against the counts of the others, and the scores use the
    counts of all. A token's probability is the mixture of its bigram's and its own relative
    frequency and of a uniform share for each known token and one unknown, by weights that depend on
    how often the token before was seen. ``base_score`` is the unigram model with one added to each
    count. Both are base-10 logarithms, summed over the text.

    Missing and empty texts consist of the end token. Rows that repeat an id are scored, and
    counted, each. Without training rows all probabilities are those of one unknown token. An empty
    table gives an empty result. ``train`` and ``fold`` count as false where they are missing.
    """
    spark = docs.sparkSession
    limit = block
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        (yes(train).cast("int") + (yes(train) & yes(fold)).cast("int")).alias("part"),
    )
    parts = shards
    if parts is None:
        chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        parts = max(tasks(spark), -(-chars // SHARD_CHARS))
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = ROW.replace(",", "").split()[::2]

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names
        )

    def meta_of(ids: list, lengths: list[int], part: list[int]) -> bytes:
        known = np.array([i is not None for i in ids], np.uint8)
        plain = np.array([i or 0 for i in ids], np.int64)
        return b"".join((np.int64(len(ids)).tobytes(), plain.tobytes(), np.array(lengths, np.int64).tobytes(), np.array(part, np.uint8).tobytes(), known.tobytes()))

    def meta(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        at = 8
        ids = np.frombuffer(data, np.int64, n, at)
        lengths = np.frombuffer(data, np.int64, n, at + 8 * n)
        part = np.frombuffer(data, np.uint8, n, at + 16 * n)
        return ids, lengths, part, np.frombuffer(data, np.uint8, n, at + 17 * n)

    def starts_of(lengths: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Words(), TaskContext.get().partitionId() << 24
        words: list[np.ndarray] = []
        about: list[list] = [[], [], []]
        total = 0

        def block() -> pa.RecordBatch:
            nonlocal number, words, about, total
            stream = np.concatenate(words)
            lengths = np.array(about[1])
            part = np.repeat(np.array(about[2], np.uint8), lengths)
            vocabulary, rank, often = np.unique(stream, return_inverse=True, return_counts=True)
            # Frequent words get small numbers, which take less room.
            by_count = np.lexsort((vocabulary, -often))
            code = np.empty(len(by_count), np.uint32)
            code[by_count] = np.arange(len(by_count))
            found = [(PACK, number, 0, 0, number % parts, squeezed(code[rank]), sorted_squeezed(vocabulary[by_count]), meta_of(*about), None)]
            grams, place = np.unique(pairs_of(stream, starts_of(lengths)), return_inverse=True)
            # The mark before the text is a context, seen once per document.
            docs_in = [sum(p >= 1 for p in about[2]), sum(p == 1 for p in about[2])]
            for order, (names_of, at) in enumerate(((vocabulary, rank), (grams, place)), 1):
                each = [np.bincount(at[mask], minlength=len(names_of)) for mask in (part >= 1, part == 1)]
                if order == 1:
                    spot = int(np.searchsorted(names_of, START))
                    names_of = np.insert(names_of, spot, START)
                    each = [np.insert(c, spot, n) for c, n in zip(each, docs_in, strict=True)]
                shard = ((names_of >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                edge = np.searchsorted(shard, np.arange(parts + 1))
                for s in range(parts):
                    lo, hi = edge[s], edge[s + 1]
                    if hi > lo:
                        counts = [squeezed(c[lo:hi].astype(np.uint32)) for c in each]
                        found.append((ASK, number, order, s, s, sorted_squeezed(names_of[lo:hi]), *counts, None))
            number, words, about, total = number + 1, [], [[], [], []], 0
            return table(found)

        for b in batches:
            ids, part = b.column("id").to_pylist(), b.column("part").to_pylist()
            for i, text in enumerate(b.column("text")):
                own = words_of(text.as_py())
                each = np.empty(len(own) + 1, np.uint64)
                each[:-1] = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
                each[-1] = END
                words.append(each)
                for held, x in zip(about, (ids[i], len(each), part[i]), strict=True):
                    held.append(x)
                total += len(each)
                if total >= limit:
                    yield block()
        if words:
            yield block()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Totals per shard, one shard after the other; packs pass through to their block's task."""
        now, held = None, []

        def totals_of() -> Iterator[pa.RecordBatch]:
            order, shard = now
            grams = [sorted_spread(x[1]) for x in held]
            names_of, place = np.unique(np.concatenate(grams), return_inverse=True)
            edge = np.cumsum([0, *map(len, grams)])
            del grams
            totals = [np.bincount(place, np.concatenate([spread(x[k], np.uint32) for x in held]), len(names_of)) for k in (2, 3)]
            if order == 1:
                seen = totals[0] > 0
                seen &= names_of != START
                yield table([(SIZE, shard, 1, shard, shard, np.int64(seen.sum()).tobytes(), None, None, None)])
            for (number, *_), lo, hi in zip(held, edge, edge[1:], strict=False):
                back = [squeezed(t[place[lo:hi]].astype(np.uint64)) for t in totals]
                yield table([(ANSWER, number, order, shard, number, None, *back, None)])

        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                if row[0] == PACK:
                    yield table([(*row[:4], row[1], *row[5:])])
                    continue
                if now != (row[2], row[3]):
                    if held:
                        yield from totals_of()
                    now, held = (row[2], row[3]), []
                held.append((row[1], row[5], row[6], row[7]))
        if held:
            yield from totals_of()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs with totals: of each word of the block, of the start, and of each token's bigram. A block's rows come together."""
        now, pack, answers = None, None, {}

        def finished(number: int) -> pa.RecordBatch:
            totals = {
                (order, k): np.concatenate([spread(answers[o, s][k], np.uint64) for o, s in sorted(answers) if o == order])
                for order in (1, 2)
                for k in (0, 1)
            }
            vocabulary = sorted_spread(pack[1])
            stream = vocabulary[spread(pack[0], np.uint32)]
            _, lengths, part, _ = meta(pack[2])
            _, place = np.unique(pairs_of(stream, starts_of(lengths)), return_inverse=True)
            # Totals come in the order of fingerprints, with the start's among them.
            by_name = np.argsort(vocabulary)
            spot = int(np.searchsorted(vocabulary[by_name], START))
            ones = [np.array([totals[1, k][spot] for k in (0, 1)], np.uint64)]
            for k in (0, 1):
                own = np.empty(len(vocabulary), np.uint64)
                own[by_name] = np.delete(totals[1, k], spot)
                ones.append(own)
            ones = np.concatenate(ones)
            # Counts without the held-out part are needed where that part is scored, and only there.
            twos = np.concatenate([totals[2, 0][place], totals[2, 1][place[np.repeat(part == 2, lengths)]]])
            return table([(PACK, number, 0, 0, number, pack[0], squeezed(ones), pack[2], squeezed(twos))])

        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                if row[0] == SIZE:
                    yield table([tuple(row)])
                    continue
                if row[1] != now:
                    if now is not None:
                        yield finished(now)
                    now, pack, answers = row[1], None, {}
                if row[0] == PACK:
                    pack = row[5:8]
                else:
                    answers[row[2], row[3]] = row[6:8]
        if now is not None:
            yield finished(now)

    asked = rows.mapInArrow(ask, ROW).repartition(parts, "goes").sortWithinPartitions("goes", "grams", "kind")
    exchanged = asked.mapInArrow(answer, ROW).repartition(parts, "goes").sortWithinPartitions("goes", "kind")
    blocks = stored(exchanged.mapInArrow(counted, ROW))
    packs = blocks.where(F.col("kind") == PACK).select("a", "b", "c", "d")

    def opened(batches: Iterator[pa.RecordBatch]):
        """Blocks in slices of whole documents."""
        for b in batches:
            for i in range(b.num_rows):
                rank, ones, about, twos = (b.column(c)[i].as_py() for c in "abcd")
                rank, ones, twos = spread(rank, np.uint32), spread(ones, np.uint64), spread(twos, np.uint64)
                ids, lengths, part, known = meta(about)
                size, tokens = (len(ones) - 2) // 2, len(rank)
                end = np.cumsum(lengths)
                # Where the counts of held-out documents' bigrams begin.
                held_before = np.concatenate([[0], np.cumsum(np.where(part == 2, lengths, 0))])
                lo = 0
                while lo < len(ids):
                    begin = int(end[lo] - lengths[lo])
                    hi = max(lo + 1, int(np.searchsorted(end, begin + SLICE, "right")))
                    mine, stop = slice(lo, hi), int(end[hi - 1])
                    starts = starts_of(lengths[mine])
                    held = np.zeros(stop - begin)
                    held[np.repeat(part[mine] == 2, lengths[mine])] = twos[tokens + held_before[lo] : tokens + held_before[hi]]
                    counts = []
                    for k, two in enumerate((twos[begin:stop].astype(float), held)):
                        one = ones[2 + k * size : 2 + (k + 1) * size][rank[begin:stop]].astype(float)
                        before = np.empty(len(one))
                        before[1:] = one[:-1]
                        before[starts] = float(ones[k])
                        counts.append((two, before, one))
                    yield ids[mine], lengths[mine], part[mine], known[mine], starts, counts
                    lo = hi

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lengths, part, _, _, _ in opened(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(lengths[part >= 1].sum())]), pa.array([int(lengths[part == 1].sum())])], names=["n", "m"]
            )

    vocabulary = sum(int(np.frombuffer(r["a"], np.int64)[0]) for r in blocks.where(F.col("kind") == SIZE).select("a").collect())
    tokens_all, tokens_main = packs.mapInArrow(sums, "n long, m long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    uniform = 1.0 / (vocabulary + 1)

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lengths, part, _, _, counts in opened(batches):
            mask = np.repeat(part == 2, lengths)
            two, before, one = (c[mask] for c in counts[1])
            if not len(two):
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                q2 = np.where(two > 0, np.rint(np.log(two / before / uniform) / BIN), NEVER)
                q1 = np.where(one > 0, np.rint(np.log(one / tokens_main / uniform) / BIN), NEVER)
            seen, n = np.unique(np.column_stack([bucket_of(before), q2, q1]).astype(np.int64), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(seen[:, k]) for k in range(3)), pa.array(n.astype(np.int64))], names=["bucket", "q2", "q1", "n"]
            )

    # Bounded by the number of buckets and bins, whatever the corpus.
    bins = packs.mapInArrow(held_out, "bucket long, q2 long, q1 long, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n")).collect()
    weights = mixture_weights([(b, *(None if q == NEVER else q for q in (q2, q1)), n) for b, q2, q1, n in sorted(map(tuple, bins))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, part, known, starts, counts in opened(batches):
            two, before, one = counts[0]
            weight = weights[bucket_of(before)]
            p = weight[:, 0] * two / np.maximum(before, 1) + weight[:, 1] * one / max(tokens_all, 1) + weight[:, 2] * uniform
            if not tokens_all:
                p[:] = uniform
            base = np.log10((one + 1) / (tokens_all + vocabulary + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=known == 0),
                    pa.array(part >= 1),
                    pa.array(lengths),
                    pa.array(np.add.reduceat((one > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(ids), tokens_all, np.int64)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(np.log10(p), starts)),
                ],
                names=["id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    out = "id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packs.mapInArrow(score, out).withColumnRenamed("id", id_col)
