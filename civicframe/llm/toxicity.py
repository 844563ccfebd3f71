"""Toxicity by the nearest labelled examples."""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import batched, chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

#: ASCII marks and digits count as blanks between words.
SPLIT = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
PREFIXES = (4, 6)
#: Bytes of the index in one row.
PART = 8_000_000
#: Texts, and their characters, that are looked up together.
TOGETHER, CHARS = 64, 1_000_000


def counted_words(text: str | None) -> Counter:
    """Words of a text, lower-cased in ASCII, and their numbers."""
    return Counter((text or "").encode("utf-8", "replace").lower().translate(SPLIT).split())


def fingerprints(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))


def counted_terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text's terms, ascending, and their numbers: words, lower-cased in ASCII, and beginnings of longer words.

    Terms are equal when their 64-bit fingerprints are.
    """
    words = counted_words(text)
    terms, often = list(words), list(words.values())
    for p in PREFIXES:
        longer = [(w[:p] + b"*", n) for w, n in words.items() if len(w) >= p]
        terms += [w for w, _ in longer]
        often += [n for _, n in longer]
    found, place = np.unique(fingerprints(terms), return_inverse=True)
    return found, np.bincount(place, often, len(found)).astype(np.int64)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start[i] .. start[i] + length[i] - 1`` for every i, one after the other."""
    end = np.cumsum(length)
    out = np.repeat(start - end + length, length)
    out += np.arange(len(out), dtype=out.dtype)
    return out


class BlockMaxIndex:
    """Examples as unit vectors: postings by term, and for each term its largest value in every block of examples.

    ``terms`` are ascending fingerprints, ``weight`` their weights; ``examples`` are rows (key, label,
    terms, counts). Examples without a known term are left out.
    """

    #: Share of the bound on a text's cosine whose terms are summed for all blocks.
    FIRST = 0.95
    #: Terms of the most examples, whose values are also kept as rows over all examples.
    WIDE = 1024

    def __init__(self, terms: np.ndarray, weight: np.ndarray, examples: list[tuple], block: int = 64):
        self.terms, self.weight, self.block = terms, np.asarray(weight, float), block
        vectors = []
        for key, y, own, n in examples:
            at, n = self.known(own, n)
            if len(at):
                vectors.append((int(at[self.scaled(at, n).argmax()]), key, y, at, n))
        # Alike examples share a block, which keeps its maxima sharp.
        vectors.sort(key=lambda v: v[:3])
        self.keys, self.labels = [v[1] for v in vectors], np.array([v[2] for v in vectors], float)
        empty = np.zeros(0, int)
        self.far_start = np.cumsum([0, *(len(v[3]) for v in vectors)])
        #: By example: terms and their numbers.
        self.far_term = np.concatenate([v[3] for v in vectors] or [empty]).astype(np.int32)
        self.far_n = np.concatenate([v[4] for v in vectors] or [empty]).astype(np.uint32)
        del vectors
        self.spread()

    def spread(self) -> None:
        """What follows from the examples and is not sent with them."""
        rows, width = len(self.keys), len(self.weight)
        self.blocks = -(-rows // self.block)
        cut = [slice(a, b) for a, b in zip(self.far_start[:-1], self.far_start[1:], strict=True)]
        #: By example: values.
        self.far_value = np.concatenate([self.scaled(self.far_term[i], self.far_n[i]) for i in cut] or [np.zeros(0)])
        order = np.argsort(self.far_term, kind="stable")
        of = np.repeat(np.arange(rows), np.diff(self.far_start))
        #: By term: examples, ascending, and values.
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.far_term, minlength=width))])
        self.of, self.value = of[order], self.far_value[order]
        term, where = self.far_term[order], self.of // self.block
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (where[1:] != where[:-1])])[: len(term)])
        #: By term: blocks that hold it, the largest value in each, and the largest of all.
        self.peak_start = np.searchsorted(term[new], np.arange(width + 1))
        self.peak_block, self.peak = where[new], np.maximum.reduceat(self.value, new) if len(new) else np.zeros(0)
        self.top = np.zeros(width)
        np.maximum.at(self.top, term[new], self.peak)
        self.full = np.zeros(width)
        often = np.diff(self.start)
        wide = np.sort(np.argsort(-often, kind="stable")[: self.WIDE])
        #: By term, -1 for all but the widest: its row of values over all examples.
        self.row = np.full(width, -1)
        self.row[wide] = np.arange(len(wide))
        self.rows = np.zeros((len(wide), rows))
        i = ranges(self.start[wide], often[wide])
        self.rows[np.repeat(np.arange(len(wide)), often[wide]), self.of[i]] = self.value[i]

    def __reduce__(self):
        sent = ("terms", "weight", "block", "keys", "labels", "far_start", "far_term", "far_n")
        return _opened, ({k: self.__dict__[k] for k in sent},)

    def places(self, own: np.ndarray) -> np.ndarray:
        """Places of terms, -1 for those that are not known or without weight."""
        if not len(self.terms):
            return np.full(len(own), -1)
        i = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        return np.where((self.terms[i] == own) & (self.weight[i] > 0), i, -1)

    def known(self, own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known terms with weight, ascending, and their numbers."""
        i = self.places(own)
        return i[i >= 0], n[i >= 0]

    def scaled(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Values of terms in a vector of length 1."""
        w = (1 + np.log(n)) * self.weight[at]
        return w / np.sqrt((w * w).sum()) if len(at) else w

    def unit(self, own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known terms with weight, ascending, and their values in a vector of length 1."""
        at, n = self.known(own, n)
        return at, self.scaled(at, n)

    def summed(self, doc: np.ndarray, at: np.ndarray, w: np.ndarray, docs: int) -> np.ndarray:
        """What these terms of texts ``doc`` add to the cosines, a row for each text, a column for each example."""
        length = self.start[at + 1] - self.start[at]
        i = ranges(self.start[at], length)
        cell = np.repeat(doc * len(self.keys), length)
        cell += self.of[i]
        return np.bincount(cell, self.value[i] * np.repeat(w, length), docs * len(self.keys)).reshape(docs, -1)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``all_nearest``, for one text."""
        return self.all_nearest(np.zeros(len(at), int), at, w, 1, k)[0]

    def all_nearest(self, doc: np.ndarray, at: np.ndarray, w: np.ndarray, docs: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For texts 0 .. ``docs`` - 1: numbers and cosines, to 12 places, of the ``k`` nearest examples with any common term; ties by number.

        ``doc`` has the text of each term and ascends. The widest terms are summed for all texts as one
        product of matrices. The others go by falling bound, the largest value that they have anywhere,
        until most of the bound is summed. What the rest can add to a block is the sum of its
        maxima there: a block whose best sum with it stays under the ``k``-th cosine so far is not
        opened, and neither is such an example of an open block. The rest is summed in full, by
        whichever lists are shorter, so the result is exact.
        """
        if not len(at) or not self.blocks:
            return [(np.zeros(0, int), np.zeros(0))] * docs
        rows = len(self.keys)
        bound, row = w * self.top[at], self.row[at]
        wide = row >= 0
        # Full groups, so that sums do not depend on how many other texts there are.
        matrix = np.zeros((-(-docs // TOGETHER) * TOGETHER, len(self.rows)))
        matrix[doc[wide], row[wide]] = w[wide]
        score = (matrix @ self.rows)[:docs]
        narrow = np.flatnonzero(~wide)
        narrow = narrow[np.argsort(2.0 * doc[narrow] - bound[narrow], kind="stable")]
        d, b = doc[narrow], bound[narrow]
        total = np.bincount(doc, bound, docs)
        # By term: the bounds of all terms of its text that come before it, the widest among them.
        before = np.cumsum(b) - b + (total - np.cumsum(np.bincount(d, b, docs)))[d]
        cut = before < self.FIRST * total[d]
        first, rest = narrow[cut], narrow[~cut]
        score += self.summed(doc[first], at[first], w[first], docs)
        d, t, x = doc[rest], at[rest], w[rest]
        length = self.peak_start[t + 1] - self.peak_start[t]
        i = ranges(self.peak_start[t], length)
        block = np.repeat(d * self.blocks, length) + self.peak_block[i]
        more = np.bincount(block, np.repeat(x, length) * self.peak[i], docs * self.blocks).reshape(docs, -1)
        least = np.partition(score, -k, axis=1)[:, -k, None] - 1e-9 if rows > k else -1.0
        best = np.maximum.reduceat(score, np.arange(0, rows, self.block), axis=1)
        most = score + np.repeat(np.where(best + more >= least, more, -9.0), self.block, axis=1)[:, :rows]
        near = (most >= least) & (most > 0)
        far = np.diff(self.far_start)
        long = near @ far >= np.bincount(d, self.start[t + 1] - self.start[t], docs)
        i = long[d]
        score += self.summed(d[i], t[i], x[i], docs)
        place = np.searchsorted(d, np.arange(docs + 1))
        out = []
        for j in range(docs):
            n = np.flatnonzero(near[j])
            found = score[j, n]
            if not long[j]:
                own = slice(place[j], place[j + 1])
                self.full[t[own]] = x[own]
                i = ranges(self.far_start[n], far[n])
                found += np.bincount(np.repeat(np.arange(len(n)), far[n]), self.full[self.far_term[i]] * self.far_value[i], len(n))
                self.full[t[own]] = 0
            found = np.round(found, 12)
            hit = np.flatnonzero(found > 0)
            if len(hit) > k:
                hit = hit[found[hit] >= np.partition(found[hit], -k)[-k]]
            order = hit[np.lexsort((n[hit], -found[hit]))[:k]]
            out.append((n[order], found[order]))
        return out

    def vote(self, own: np.ndarray, n: np.ndarray, k: int, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
        """As ``votes``, for one text with these terms."""
        return self.votes(*self.units([(own, n)]), k, prior)[0]

    def votes(
        self, words: np.ndarray, doc: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, prior: float
    ) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Share of label 1 among the neighbours, each with its cosine as weight, drawn to ``prior`` where they are few or far.

        One for each text, with its neighbours. ``words`` is 0 for texts without words: nothing in them is
        toxic, their neighbours count as equal to them and of label 0.
        """
        out = []
        for some, (i, s) in zip(words, self.all_nearest(doc, at, w, len(words), k), strict=True):
            share = (float((s * self.labels[i]).sum()) + prior) / (float(s.sum()) + 1.0) if some else prior / (k + 1.0)
            out.append((share, i, s))
        return out

    def units(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts (terms, counts): number of terms by text; text, place and value of all known terms."""
        found = [self.unit(own, n) for own, n in texts]
        doc = np.repeat(np.arange(len(texts)), [len(at) for at, _ in found])
        return np.array([len(own) for own, _ in texts]), doc, *(np.concatenate(x) for x in zip(*found, strict=True))


class Reader:
    """Texts as unit vectors of an index. Places of a word's terms are looked up when it is first met, and kept."""

    #: Words that are kept at most from one call to the next.
    KEPT = 200_000

    def __init__(self, index: BlockMaxIndex):
        self.index = index
        self.forget()

    def forget(self) -> None:
        #: Word to its row in ``place``, given out in turn.
        self.row: defaultdict = defaultdict(count().__next__)
        #: By word: places of it and of its beginnings, -1 for none.
        self.place = np.zeros((0, 1 + len(PREFIXES)), int)

    def learn(self, words: list[bytes]) -> None:
        found = np.full((len(words), 1 + len(PREFIXES)), -1)
        found[:, 0] = self.index.places(fingerprints(words))
        size = np.fromiter(map(len, words), int, len(words))
        for c, p in enumerate(PREFIXES, 1):
            i = np.flatnonzero(size >= p)
            found[i, c] = self.index.places(fingerprints([words[j][:p] + b"*" for j in i.tolist()]))
        self.place = np.concatenate([self.place, found])

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``units`` of the index, with the number of words by text."""
        counted = [counted_words(t) for t in texts]
        words, often = list(chain.from_iterable(counted)), list(chain.from_iterable(c.values() for c in counted))
        size = np.fromiter(map(len, counted), int, len(counted))
        row = np.fromiter(map(self.row.__getitem__, words), int, len(words))
        new = np.flatnonzero(row >= len(self.place))
        if len(new):
            self.learn([words[j] for j in new[np.unique(row[new], return_index=True)[1]].tolist()])
        at, width = self.place[row], len(self.index.terms)
        i, c = np.nonzero(at >= 0)
        key = np.repeat(np.arange(len(texts)) * width, size)[i] + at[i, c]
        order = np.argsort(key)
        key, n = key[order], np.array(often, int)[i][order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        doc, at = np.divmod(key[new], max(width, 1))
        w = (1 + np.log(np.add.reduceat(n, new) if len(new) else n)) * self.index.weight[at]
        if len(self.row) > self.KEPT:
            self.forget()
        return size, doc, at, w / np.sqrt(np.bincount(doc, w * w, len(texts)))[doc]


def grouped(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in turn, few or short enough to be held together with what they are cut into."""
    group, chars = [], 0
    for t in texts:
        if group and (len(group) == TOGETHER or chars + len(t or "") > CHARS):
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t or "")
    if group:
        yield group


def _opened(kept: dict) -> BlockMaxIndex:
    index = BlockMaxIndex.__new__(BlockMaxIndex)
    index.__dict__.update(kept)
    index.spread()
    return index


def indexed(sets: list[tuple]) -> tuple[BlockMaxIndex, float]:
    """Index of examples (key, label, terms, counts), and the share of label 1 among them."""
    sets = sorted(sets, key=lambda r: (r[0], r[1], r[2].tobytes()))
    total = len(sets)
    share = sum(r[1] for r in sets) / total if total else 0.0
    names, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[2] for r in sets)]), return_counts=True)
    toxic, some = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[2] for r in sets if r[1] > 0)]), return_counts=True)
    n1 = np.zeros(len(names))
    n1[np.searchsorted(names, toxic)] = some
    return BlockMaxIndex(names, np.log(max(total, 1) / n) * feature_weights(n, n1, share), sets), share


def feature_weights(n: np.ndarray, n1: np.ndarray, share: float) -> np.ndarray:
    """How much more a term is in examples of label 1 than chance has it, in standard deviations, from 0.3 up.

    ``n1`` of the ``n`` examples with the term have label 1, ``share`` of all examples. The 1 in the
    variance keeps terms of few examples low. No term has a weight of 0.
    """
    return 0.3 + np.maximum(0.0, n1 - n * share) / np.sqrt(n * share * (1 - share) + 1)


#: Pull of the logistic curve towards the raw votes: few labels do not turn it over.
PULL = 0.3


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (log-odds of ``raw``, ``y``), a little regularised."""
    x = np.column_stack([np.log(raw / (1 - raw)), np.ones(len(raw))])
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (p - y) + PULL * (beta - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + PULL * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def sampled_labels(labels: DataFrame, id_col: str, label: Column, allowed: Column, sample: int) -> DataFrame:
    """About ``sample`` labelled ids at most, chosen by a hash; an id labelled twice has its larger label."""
    known = labels.where(F.col(id_col).isNotNull() & label.isNotNull() & allowed)
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label).alias("__y"))
    known = known.withColumn("__u", F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1_000_000)))
    total = known.count()
    return stored(known.where(F.col("__u") < F.lit(1_000_000 * min(1.0, sample / max(total, 1)))))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 3_000,
    k: int = 15,
    evidence: int = 3,
    carry: list[str] | None = None,
    named: tuple[str, str] = ("score", "evidence"),
) -> DataFrame:
    """One row per document: ``id_col, score, evidence array<struct<doc_id, cosine, label>>``.

    Columns named in ``carry`` come instead of ``id_col``, so that a filter needs no join; ``named``
    are the names of the other two, for tables that have such columns.

    At most about ``sample`` labelled ids that ``allowed`` lets through are used, a text of each, three
    quarters as examples, the rest to calibrate. Examples are indexed over all their words and word beginnings;
    cosines are exact. A term's weight is its IDF times what ``feature_weights`` says. The score is
    the calibrated vote of the ``k`` nearest examples and depends on the text alone. Empty and
    missing texts score as if all neighbours were of label 0, texts without a known term get the
    calibrated prior. Without any label of either kind all scores are the known share of label 1,
    or 0. Whole texts are read; the model that is broadcast has a posting for each term of an
    example, and at most about ``sample`` examples.
    """
    spark = docs.sparkSession
    chosen = sampled_labels(labels, id_col, F.col(label_col), allowed, sample)
    out = carry or [id_col]
    source = docs.select(F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(out)))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    # Ids of the sample: bounded by its size. An id that comes with several texts is one example.
    picked = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__y", "__u")
    picked = picked.agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [counted_terms(t.as_py()) for t in b.column("__text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("__id"),
                    b.column("__y").cast(pa.float64()),
                    pa.array([u % 4 == 0 for u in b.column("__u").to_pylist()]),
                    pa.array([t.tobytes() for t, _ in own], pa.binary()),
                    pa.array([n.astype(np.uint32).tobytes() for _, n in own], pa.binary()),
                ],
                names=["id", "y", "check", "terms", "counts"],
            )

    vectors = stored(
        picked.select("__id", "__y", "__u", "__text").mapInArrow(features, "id long, y double, check boolean, terms binary, counts binary")
    )

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                key, y, terms, counts = (b.column(c)[i].as_py() for c in ("id", "y", "terms", "counts"))
                yield key, y, np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, share = indexed(list(unpacked(batches)))
        data = zstandard.compress(pickle.dumps(index, 5))
        for at in range(0, len(data), PART):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([data[at : at + PART]]), pa.array([share])], names=["at", "data", "share"])

    # One task builds the index of at most about ``sample`` examples; the driver passes its bytes on.
    parts = vectors.where("not check").coalesce(1).mapInArrow(build, "at long, data binary, share double").collect()
    share = parts[0]["share"]
    prior = min(max(share, 1e-4), 1 - 1e-4)
    model = spark.sparkContext.broadcast(b"".join(bytes(r["data"]) for r in sorted(parts, key=lambda r: r["at"])))
    del parts

    def opened() -> BlockMaxIndex:
        return pickle.loads(zstandard.decompress(model.value))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = opened()
        for group in batched(unpacked(batches), TOGETHER):
            found = index.votes(*index.units([r[2:] for r in group]), k, prior)
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in found]), pa.array([r[1] for r in group])], names=["raw", "y"])

    slope, offset = 1.0, 0.0
    if 0 < share < 1:
        # Two numbers for each row kept aside: bounded by ``sample``.
        held = np.array([tuple(r) for r in vectors.where("check").mapInArrow(votes, "raw double, y double").collect()], float)
        if len(held):
            held = held[np.lexsort(held.T)]
            slope, offset = platt(held[:, 0], held[:, 1])
    only = None if 0 < share < 1 else share

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = opened()
        reader = Reader(found)
        for b in batches:
            scores, proofs = [], []
            for group in grouped(t.as_py() for t in b.column("__text")):
                for raw, i, s in found.votes(*reader.read(group), k, prior):
                    x = slope * np.log(raw / (1 - raw)) + offset
                    scores.append(only if only is not None else float(1 / (1 + np.exp(-x))))
                    proofs.append(
                        [{"doc_id": found.keys[j], "cosine": float(c), "label": int(found.labels[j])} for j, c in zip(i[:evidence], s, strict=False)]
                    )
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(scores, pa.float64()), pa.array(proofs, kind)],
                names=[*b.schema.names[1:], "__score", "__evidence"],
            )

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
    scored = source.mapInArrow(
        score, f"{kinds}__score double, __evidence array<struct<doc_id: long, cosine: double, label: int>>"
    )
    return scored.toDF(*out, *named)
