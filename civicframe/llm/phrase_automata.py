"""Removal of passages that recur anywhere in the corpus, by automata of repeated phrases.

A window is ``size`` consecutive words. Every window picks an anchor: the run of ``ANCHOR`` words
inside it with the least fingerprint, the leftmost of equals. Equal windows pick equal anchors, so only
windows whose anchor occurs twice need to be counted, and anchors are a tenth of the words. Documents are
dealt into blocks; a block sends each shard of the fingerprints' range its distinct ones with a mark
for those it holds twice, and gets back a mark for those that the corpus holds twice. No key, however
common, has more than one entry a block.

What recurs is then cut into phrases, compiled into one automaton per block, and the block's documents
are streamed through it word by word: the automaton alone says where a phrase occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .interpolation import sorted_spread, sorted_squeezed, spread, squeezed
from .jaccard_join import _MIX, Words, mixed
from .store import stored, tasks

#: Words of an anchor, for windows of twice as many or more.
ANCHOR = 16
#: Words of a block, about; a longer document has a block of its own.
BLOCK = 1_000_000
#: Characters of input for each shard of the exchange.
SHARD_CHARS = 20_000_000

ROW = "kind int, block long, shard int, a binary, b binary, c binary"
ASK, MARKS, PACK = range(3)
_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
_NAMES = ROW.replace(",", "").split()[::2]


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all runs of ``length`` words: of power-of-two runs by doubling, of others by two that overlap."""
    each, have = words, 1
    while 2 * have <= length:
        each = mixed(each[: len(each) - have] * _MIX[0]) + each[have:]
        have *= 2
    if have < length:
        over = length - have
        each = mixed(each[: len(each) - over] * _MIX[2]) + each[over:]
    return mixed(each)


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least, leftmost of equals, in each stretch of ``width``."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[left] <= x[right], left, right)
        have += step
    return at


class Block:
    """Documents of a block as numbers of words, with windows and their anchors."""

    def __init__(self, texts: list[bytes], size: int):
        self.words = [t.split(b" ") if t else [] for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        number: dict[bytes, int] = {}
        self.numbers = np.fromiter(
            (number.setdefault(w, len(number)) for words in self.words for w in words), np.int32, int(self.lengths.sum())
        )
        known = Words()
        self.prints = np.fromiter(map(known.__getitem__, number), np.uint64, len(number))[self.numbers]
        n, short = len(self.numbers), min(ANCHOR, max(size // 2, 1))
        #: Where a window starts.
        fits = np.zeros(n, bool)
        for s, length in zip(self.starts, self.lengths, strict=True):
            if length >= size:
                fits[s : s + length - size + 1] = True
        self.at = np.flatnonzero(fits)
        self.size = size
        if len(self.at):
            grams = runs(self.prints, short)
            self.picks = leftmost_least(grams, size - short + 1)[self.at]
            self.grams = grams

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, ascending, and whether the block has them at two places."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        found, often = np.unique(self.grams[np.unique(self.picks)], return_counts=True)
        return found, often > 1

    def candidates(self, anchors: np.ndarray, recurs: np.ndarray) -> np.ndarray:
        """Starts of windows whose anchor recurs in the corpus."""
        if not len(self.at):
            return self.at
        return self.at[recurs[np.searchsorted(anchors, self.grams[self.picks])]]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows among those at ``at``: two fingerprints, the number of each one's, and how often."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        one = runs(self.prints, self.size)[at]
        two = (runs(mixed(self.prints + _MIX[1]), self.size)[at] >> np.uint64(32)).astype(np.uint32)
        return distinct(one, two)


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return a[first], b[first], number, np.diff(np.append(first, len(a)))


def phrases(at: np.ndarray, number: np.ndarray) -> list[tuple[int, int]]:
    """Recurring windows as phrases ``(first window's place, windows)``, each distinct window in exactly one.

    ``at``: places of recurring windows, ascending; ``number``: which distinct window each is. A phrase
    goes on as long as its windows always follow each other: it ends where a window is followed, or
    the next one preceded, by different ones. So wherever one of its windows occurs, the whole does.
    """
    if not len(at):
        return []
    joined = at[1:] == at[:-1] + 1
    after, before = np.full(len(at), -1), np.full(len(at), -1)
    after[:-1][joined] = number[1:][joined]
    before[1:][joined] = number[:-1][joined]
    count = int(number.max()) + 1
    several = []
    for other in (after, before):
        pairs = np.unique(np.column_stack([number, other]), axis=0)
        several.append(np.bincount(pairs[:, 0], minlength=count) > 1)
    cut = np.ones(len(at), bool)
    cut[1:] = ~joined | several[0][number[:-1]] | several[1][number[1:]]
    heads = np.flatnonzero(cut)
    length = np.diff(np.append(heads, len(at)))
    _, first = np.unique(number[heads], return_index=True)
    return [(int(at[heads[i]]), int(length[i])) for i in first]


def compiled(block: Block, found: list[tuple[int, int]]):
    """Automaton of the phrases' word numbers; a match gives the phrase's length."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for start, windows in found:
        length = windows + block.size - 1
        automaton.add_word(tuple(block.numbers[start : start + length].tolist()), length)
    automaton.make_automaton()
    return automaton


def covered(automaton, words: np.ndarray) -> np.ndarray:
    """Which words of a document some phrase covers, by streaming it through the automaton."""
    change = np.zeros(len(words) + 1, np.int64)
    for end, length in automaton.iter(tuple(words.tolist())):
        change[end + 1 - length] += 1
        change[end + 1] -= 1
    return np.cumsum(change[:-1]) > 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _edges(keys: np.ndarray, shards: int) -> np.ndarray:
    shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(shard, np.arange(shards + 1))


def _asks(block: int, one: np.ndarray, two: np.ndarray | None, twice: np.ndarray, shards: int) -> Iterator[tuple]:
    edge = _edges(one, shards)
    for s in range(shards):
        lo, hi = edge[s], edge[s + 1]
        if hi > lo:
            more = None if two is None else squeezed(two[lo:hi])
            yield (ASK, block, s, sorted_squeezed(one[lo:hi]), more, np.packbits(twice[lo:hi]).tobytes())


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks for a shard's asks: what the corpus holds twice. The task's shards come one after the other."""
    shard, held = None, []

    def marks() -> pa.RecordBatch:
        one = [sorted_spread(r[1]) for r in held]
        edge = np.cumsum([0, *map(len, one)])
        two = [np.zeros(len(o), np.uint32) if r[2] is None else spread(r[2], np.uint32) for r, o in zip(held, one, strict=True)]
        twice = [np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(o)) for r, o in zip(held, one, strict=True)]
        _, _, number, _ = distinct(np.concatenate(one), np.concatenate(two))
        recurs = np.bincount(number, 1.0 + np.concatenate(twice)) > 1
        recurs = recurs[number]
        return _batch(
            [(MARKS, r[0], shard, np.packbits(recurs[lo:hi]).tobytes(), np.int64(hi - lo).tobytes(), None) for r, lo, hi in zip(held, edge, edge[1:], strict=False)]
        )

    for b in batches:
        columns = [b.column(c) for c in ("shard", "block", "a", "b", "c")]
        for i in range(b.num_rows):
            row = [c[i].as_py() for c in columns]
            if row[0] != shard:
                if held:
                    yield marks()
                shard, held = row[0], []
            held.append(row[1:])
    if held:
        yield marks()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], list]]:
    """Blocks of a task, whole: number, marks by round in the order of fingerprints, and the pack. Rows come sorted."""
    number, marks, pack = None, [[], []], None

    def whole():
        return number, [np.concatenate([np.zeros(0, bool), *m]) for m in marks], pack

    for b in batches:
        columns = [b.column(c) for c in ("block", "kind", "step", "a", "b", "c")]
        for i in range(b.num_rows):
            block, kind, step, one, two, three = (c[i].as_py() for c in columns)
            if block != number:
                if number is not None:
                    yield whole()
                number, marks, pack = block, [[], []], None
            if kind == PACK:
                pack = (one, two, three)
            else:
                marks[step].append(np.unpackbits(np.frombuffer(one, np.uint8), count=int(np.frombuffer(two, np.int64)[0])).astype(bool))
    if number is not None:
        yield whole()


def _texts(pack: tuple) -> list[bytes]:
    return zstandard.decompress(pack[0]).split(b"\n")


def repeated_phrases(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35, block: int = BLOCK, shards: int | None = None
) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_removed, kept, spans array<struct<start, length>>``.

    Words are what stands between ASCII white space. Of a document go all words that lie in a window
    of ``size`` words whose word sequence starts anywhere else too, in any row or at another place of
    the same one; windows are judged on the input. ``kept`` has the other words, joined by a space;
    ``spans`` says which words went.

    Missing and empty texts have no words; texts shorter than a window keep all. Rows count as they
    come: a repeated row makes its own windows recur. A missing id is an id like others. Long texts are
    whole, in a block of their own if need be. An empty table gives an empty result; no further
    column is read. Windows are equal when two fingerprints of 64 and 32 bits are; inside a block
    the automaton compares the words themselves.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if shards is None:
        chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        shards = max(tasks(spark), -(-chars // SHARD_CHARS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, total = [], [], 0

        def ready() -> Iterator[pa.RecordBatch]:
            known = np.array([i is not None for i in ids], bool)
            plain = np.array([i or 0 for i in ids], np.int64)
            # Compressed frames of texts that repeat in a block cost next to nothing.
            yield _batch([(PACK, number, -1, zstandard.compress(b"\n".join(texts), 3), squeezed(plain), np.packbits(known).tobytes())])
            found, twice = Block(texts, size).anchors()
            yield _batch([(ASK, number, -1, None, None, None), *_asks(number, found, None, twice, shards)])

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                if total and total + len(words) > block:
                    yield from ready()
                    number, ids, texts, total = number + 1, [], [], 0
                ids.append(i)
                texts.append(b" ".join(words))
                total += len(words) + 1  # rows without words do not pile up
        if ids:
            yield from ready()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (marks, _), held in _blocks(batches):
            own = Block(_texts(held), size)
            one, two, _, often = own.windows(own.candidates(own.anchors()[0], marks))
            if len(one):
                yield _batch(list(_asks(number, one, two, often > 1, shards)))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (marks, recurs), held in _blocks(batches):
            own = Block(_texts(held), size)
            at = own.candidates(own.anchors()[0], marks)
            _, _, each, _ = own.windows(at)
            mask = recurs[each] if len(each) else np.zeros(0, bool)
            found = phrases(at[mask], each[mask])
            automaton = compiled(own, found) if found else None
            count = len(own.words)
            ids = spread(held[1], np.int64)
            known = np.unpackbits(np.frombuffer(held[2], np.uint8), count=count).astype(bool)
            for lo in range(0, count, 256):
                out = []
                for k in range(lo, min(lo + 256, count)):
                    words, gone = own.words[k], None
                    if automaton is not None and len(words) >= size:
                        gone = covered(automaton, own.numbers[own.starts[k] : own.starts[k] + len(words)])
                    if gone is None or not gone.any():
                        out.append((int(ids[k]) if known[k] else None, len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass"), []))
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    kept = b" ".join([words[i] for i in np.flatnonzero(~gone)]).decode("utf-8", "surrogatepass")
                    spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                    out.append((int(ids[k]) if known[k] else None, len(words), int(gone.sum()), kept, spans))
                span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["id", "n_words", "n_removed", "kept", "spans"],
                )

    def answered(asks: DataFrame) -> DataFrame:
        return asks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_answer, ROW)

    def gathered(*parts: tuple[DataFrame, int]) -> DataFrame:
        """Packs with the marks of each round, a block's rows together; within a round by shard, the pack last."""
        every = [p.withColumn("step", F.lit(step)) for p, step in parts]
        together = every[0]
        for p in every[1:]:
            together = together.union(p)
        return together.repartition(shards, "block").sortWithinPartitions("block", "kind", "step", "shard")

    packed = stored(rows.mapInArrow(pack, ROW))
    packs = packed.where(F.col("kind") == PACK)
    first = stored(answered(packed.where((F.col("kind") == ASK) & (F.col("shard") >= 0))))
    asks = gathered((packs, 0), (first, 0)).mapInArrow(second, ROW)
    last = gathered((packs, 0), (first, 0), (answered(asks), 1))
    out = "id long, n_words long, n_removed long, kept string, spans array<struct<start: long, length: long>>"
    return last.mapInArrow(remove, out).withColumnRenamed("id", id_col)
