"""Fill-in-the-middle transformation on a piece table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word with the blanks before it, or the blanks at the end.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SENTINELS = ("<P>", "<S>", "<M>")
#: What follows what in each form. Capitals are sentinels, small letters the parts.
ARRANGED = {"psm": "PpSsMm", "spm": "SsPpMm"}


@dataclass(frozen=True)
class Piece:
    """A descriptor: a run of one immutable buffer."""

    buffer: int
    start: int
    length: int


class PieceTable:
    """A document as descriptors over immutable buffers; no edit copies text."""

    def __init__(self, buffers: Sequence[str], pieces: Sequence[Piece]):
        self.buffers, self.pieces = tuple(buffers), tuple(pieces)

    @classmethod
    def of(cls, text: str) -> PieceTable:
        return cls([text], [Piece(0, 0, len(text))])

    def cut(self, at: int) -> PieceTable:
        """Split the descriptor that spans place ``at``; at the edges an empty descriptor comes to be."""
        out, seen, done = [], 0, False
        for p in self.pieces:
            if not done and seen + p.length >= at:
                out += [Piece(p.buffer, p.start, at - seen), Piece(p.buffer, p.start + at - seen, p.length - at + seen)]
                done = True
            else:
                out.append(p)
            seen += p.length
        return PieceTable(self.buffers, out)

    def with_buffers(self, more: Sequence[str]) -> PieceTable:
        """Further buffers, each with one descriptor at the end."""
        first = len(self.buffers)
        return PieceTable((*self.buffers, *more), (*self.pieces, *(Piece(first + i, 0, len(b)) for i, b in enumerate(more))))

    def permuted(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def stream(self) -> Iterator[str]:
        for p in self.pieces:
            if p.length:
                whole = p.length == len(self.buffers[p.buffer])
                yield self.buffers[p.buffer] if whole else self.buffers[p.buffer][p.start : p.start + p.length]

    def text(self) -> str:
        return "".join(self.stream())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part.encode("utf-8", "surrogatepass"))
        return digest.hexdigest()


#: Places of a table's descriptors: prefix, middle, suffix, then the three sentinels.
_PLACES = {"p": 0, "m": 1, "s": 2, "P": 3, "S": 4, "M": 5}


def arranged(text: str, first: int, second: int, form: str) -> PieceTable:
    """``text`` cut at two places and put into ``form``, as descriptors."""
    if form == "plain":
        return PieceTable.of(text)
    parts = PieceTable.of(text).cut(second).cut(first).with_buffers(SENTINELS)
    return parts.permuted([_PLACES[x] for x in ARRANGED[form]])


def restored(output: str, form: str) -> PieceTable:
    """The text from an output and its form alone: cut at the sentinels, inverse permutation, sentinels left out."""
    whole = PieceTable.of(output)
    if form == "plain":
        return whole
    layout = ARRANGED[form]
    # No text that is arranged holds a sentinel, so each is where it is first found.
    for mark in (x for x in reversed(layout) if x.isupper()):
        sentinel = SENTINELS["PSM".index(mark)]
        at = output.index(sentinel)
        whole = whole.cut(at + len(sentinel)).cut(at)
    # The first cut, at 0, leaves an empty descriptor in front.
    pieces = whole.permuted(range(1, 7))
    inverse = {mark: i for i, mark in enumerate(layout)}
    return pieces.permuted([inverse[x] for x in "pms"])


def cut_places(doc_id: int | None, n: int, text: str, seed: int, plain_from: int, spm_below: int) -> tuple[str, int, int]:
    """Form, and units in the prefix and up to the end of the middle."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= plain_from:
        return "plain", low, high
    return ("spm" if h[3] % 100 < spm_below else "psm"), low, high


def fill_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    plain_from: int = 50,
    spm_below: int = 80,
) -> DataFrame:
    """One row per input row: ``id_col, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256``.

    A text is cut into ``n`` units, words with the blanks before them; where to cut, and which form
    the row gets, follows from a hash of ``seed`` and its id alone, so the result depends on nothing
    but the row. ``plain_from`` is the share of rows, in percent, that may be rearranged, and
    ``spm_below`` the share of these with the suffix first. ``restored_sha256`` is of the text
    rebuilt from ``output`` and ``form``.

    Missing and empty texts, and texts that hold a sentinel, stay as they are: form ``plain``,
    lengths missing. A missing id counts as no digits. Rows that repeat an id give a row each.
    Texts of any length are cut as a whole; a task holds one batch of them. No shuffle; an empty
    table gives an empty result, and no further column is read.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("__id").to_pylist(), b.column("__text").to_pylist(), strict=True):
                text = text or ""
                ends = [m.end() for m in UNIT.finditer(text)]
                form, low, high = cut_places(doc_id, len(ends), text, seed, plain_from, spm_below)
                first, second = (ends[i - 1] if i else 0 for i in (low, high))
                table = arranged(text, first, second, form)
                output = table.text()
                sizes = (None, None) if form == "plain" else (first, second - first)
                rows.append((doc_id, len(ends), form, *sizes, output, table.sha256(), restored(output, form).sha256()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    kinds = [("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    schema = pa.schema([*kinds, *((c, pa.string()) for c in ("output", "output_sha256", "restored_sha256"))])
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    out = "id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
    return rows.mapInArrow(transform, out).withColumnRenamed("id", id_col)
