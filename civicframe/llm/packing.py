"""Packing token sequences by vector bin packing."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids, equal to the ``tokenizers`` file at ``path`` without added special tokens.

    Ids of byte-level BPE are in order of merging, so the same vocabulary runs in ``tiktoken``,
    several times faster. Special tokens spelled out in a text get their own id, as there.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    own = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(own.encode(text, allowed_special="all"), np.uint32)
        return np.array(own.encode_ordinary(text), np.uint32)

    return ids


class Pool:
    """Open pieces as arrays: tokens, loss-bearing tokens and what they are pieces of."""

    def __init__(self, caps: tuple[int, int, int]):
        self.caps = np.array(caps, float)
        self.size = np.zeros((0, 3))
        self.items: list[tuple] = []

    def add(self, items: list[tuple], sizes: list[tuple[int, int, int]]) -> None:
        if items:
            self.items += items
            self.size = np.vstack([self.size, np.array(sizes, float)])

    def bin(self, cut) -> list[tuple]:
        """One sequence: again and again the piece that fits and whose size has the largest dot product with the room left.

        When none fits, the largest piece is cut to fill the tokens left, if the other limits allow.
        """
        room, chosen = self.caps.copy(), []
        scaled = self.size / self.caps
        free = np.ones(len(self.items), bool)
        while True:
            fits = free & (self.size <= room).all(1)
            if not fits.any():
                break
            score = np.where(fits, scaled @ (room / self.caps), -1.0)
            i = int(score.argmax())
            chosen.append(self.items[i])
            room -= self.size[i]
            free[i] = False
        rest = [self.items[i] for i in np.flatnonzero(free)]
        self.size, self.items = self.size[free], rest
        if room[0] >= 1 and room[1] >= 1 and rest:
            i = int(self.size[:, 0].argmax())
            head, tail, tail_size = cut(rest[i], int(room[0]), int(room[2]))
            if head is not None:
                chosen.append(head)
                rest[i], self.size[i] = tail, tail_size
        return chosen


def pack_rows(rows: Iterable[tuple], caps: tuple[int, int, int], pool: int, first_id: int) -> Iterator[tuple]:
    """Pieces ``(key, start, length, ids, total, sequence, offset, loss)`` from rows ``(key, ids, loss_from)``.

    ``caps``: tokens, pieces and loss-bearing tokens of a sequence. Pieces as long as a sequence are
    sequences. Shorter ends wait in a pool of ``pool`` pieces. A sequence that cannot be filled is
    cut at powers of two, which need no padding.
    """
    tokens, _, loss_cap = caps
    open_, number = Pool(caps), first_id

    def loss_of(start: int, length: int, loss_from: int) -> int:
        return max(0, start + length - max(start, loss_from))

    def sized(item: tuple) -> tuple[int, int, int]:
        _, start, ids, _, loss_from = item
        return len(ids), 1, loss_of(start, len(ids), loss_from)

    def cut(item: tuple, most: int, loss: int):
        key, start, ids, total, loss_from = item
        before = max(0, loss_from - start)  # tokens that bear no loss
        most = min(most, before + loss, len(ids) - 1)
        if most < 1:
            return None, None, None
        tail = (key, start + most, ids[most:], total, loss_from)
        return (key, start, ids[:most], total, loss_from), tail, sized(tail)

    def emit(chosen: list[tuple]) -> Iterator[tuple]:
        nonlocal number
        left = sum(len(x[2]) for x in chosen)
        limit = tokens if left == tokens else 1 << left.bit_length() - 1
        at = 0
        for key, start, ids, total, loss_from in chosen:
            done = 0
            while done < len(ids):
                n = min(len(ids) - done, limit - at)
                part = ids[done : done + n]
                yield key, start + done, n, part.tobytes(), total, number, at, loss_of(start + done, n, loss_from)
                done, at, left = done + n, at + n, left - n
                if at == limit:
                    number, at = number + 1, 0
                    limit = 1 << left.bit_length() - 1 if left else 0

    for key, ids, loss_from in rows:
        total, items, sizes = len(ids), [], []
        step = tokens
        for start in range(0, total, step):
            piece = (key, start, ids[start : start + step], total, loss_from)
            size = sized(piece)
            if size[0] == tokens and size[2] <= loss_cap:
                yield from emit([piece])
            else:
                while size[2] > loss_cap:
                    head, piece, size = cut(piece, tokens, loss_cap)
                    items.append(head)
                    sizes.append(sized(head))
                items.append(piece)
                sizes.append(size)
        open_.add(items, sizes)
        while len(open_.items) >= pool:
            yield from emit(open_.bin(cut))
    while open_.items:
        yield from emit(open_.bin(cut))


PIECES = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokens: int = 2048,
    segments: int = 128,
    loss_tokens: int | None = None,
    end_id: int = 1,
    pool: int = 1024,
) -> DataFrame:
    """One row per piece: ``id_col`` and the columns of ``PIECES``; ``ids`` are little-endian unsigned 32-bit.

    A row's tokens are those of its prompt, which bear no loss, of its text and ``end_id``. A
    sequence holds at most ``tokens`` tokens, ``segments`` pieces and ``loss_tokens`` loss-bearing
    tokens (default: as many as tokens). Sequences are full or as long as a power of two, so none
    needs padding. Missing text or prompt is empty; a row then still has its end token. Rows that
    repeat an id are packed each. Packing goes on within an input partition: no shuffle, and memory
    for one batch of rows and ``pool`` open pieces. ``tokenizer`` is a path that every executor has.
    """
    caps = (tokens, segments, loss_tokens or tokens)
    if tokens & (tokens - 1):
        raise ValueError("tokens must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], np.uint32)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                keys, texts, prompts = (batch.column(i) for i in range(3))
                for i in range(batch.num_rows):
                    head = encode(prompts[i].as_py() or "") if prompt_col else end[:0]
                    ids = np.concatenate([head, encode(texts[i].as_py() or ""), end])
                    yield keys[i].as_py(), ids, len(head)

        def flush(held: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        held = []
        first = TaskContext.get().partitionId() << 33
        for piece in pack_rows(rows(), caps, pool, first):
            held.append(piece)
            if len(held) == 2000:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    from pyspark.sql.pandas.types import to_arrow_schema

    prompt = F.col(prompt_col) if prompt_col else F.lit(None)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), prompt.cast("string").alias("prompt"))
    out = f"id {source.schema['id'].dataType.simpleString()}, {PIECES}"
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))
    return source.mapInArrow(run, out).withColumnRenamed("id", id_col)
