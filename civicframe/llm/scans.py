"""Running values over a table in global order, and ranks of linked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored, tasks


def powers(factor: int, n: int) -> np.ndarray:
    """``factor ** 0 .. factor ** n`` in 64 bits."""
    each = np.full(n + 1, factor % (1 << 64), np.uint64)
    each[0] = 1
    return np.cumprod(each, dtype=np.uint64)


def running(
    df: DataFrame, order: list[Column], key: list[str], values: list[str], factor: int = 1, keep: list[str] | None = None
) -> DataFrame:
    """Rows with their ``place`` within ``key`` (1 for the first) and, for each value, ``run_<value>`` and ``prev_<value>``.

    Rows lie in ascending order of ``key`` and then ``order``; with an empty key the table is one stretch.
    ``run`` is ``run of the row before * factor + value`` in 64 bits: with factor 1 a running sum,
    else a fingerprint of all values so far; ``prev`` is the run of the row before, 0 for the first of
    a key. Keys and values are integers without missing ones; ``keep`` names the columns that stay, keys and values among them.

    The table is dealt by ranges of key and order, so a key with very many rows spreads over tasks.
    Each task runs over its own rows; what one range hands to the next is a row per range.
    """
    keep = df.columns if keep is None else keep
    sort = [*(F.col(k) for k in key), *order]
    dealt = df.repartitionByRange(tasks(df.sparkSession), *sort).sortWithinPartitions(*sort) if sort else df
    dealt = dealt.select(*keep)
    inverse = pow(factor, -1, 1 << 64)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, spot = TaskContext.get().partitionId(), 0
        last, place, carry = None, 0, [0] * len(values)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            first = tuple(int(k[0]) for k in keys)
            new[0] = last is not None and first != last
            seg = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: goes on from the batch before
            goes_on = seg < 0
            at = np.arange(n) - np.maximum(seg, 0) + 1
            places = at + np.where(goes_on, place, 0)
            up, down = powers(factor, n), powers(inverse, n)
            out = []
            for j, v in enumerate(values):
                x = b.column(v).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                total = np.cumsum(x * down[:n], dtype=np.uint64)
                before = np.where(seg > 0, total[np.maximum(seg, 1) - 1], np.uint64(0))
                run = up[:n] * (total - before) + np.where(goes_on, np.uint64(carry[j]) * up[at], np.uint64(0))
                carry[j] = int(run[-1])
                out.append(pa.array(run.view(np.int64)))
            last, place = tuple(int(k[-1]) for k in keys), int(places[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part)), pa.array(np.arange(spot, spot + n)), pa.array(places), *out],
                names=[*b.schema.names, "__part", "__spot", "place", *(f"run_{v}" for v in values)],
            )
            spot += n

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in dealt.schema.fields)
    more = ["__part long", "__spot long", "place long", *(f"`run_{v}` long" for v in values)]
    ran = stored(dealt.mapInArrow(local, kinds + ", ".join(more)))
    runs = [f"run_{v}" for v in values]
    # A row per range: bounded by the number of tasks.
    ends = (
        ran.groupBy("__part")
        .agg(
            F.min_by(F.array(*key) if key else F.array(F.lit(0)), "__spot").alias("first"),
            F.max_by(F.struct(F.array(*key) if key else F.array(F.lit(0)), "place", *runs), "__spot").alias("end"),
        )
        .orderBy("__part")
        .collect()
    )
    brought: dict[int, tuple] = {}
    open_key, before = None, [0] * (1 + len(values))
    for r in ends:
        k, n, *run = r["end"]
        whole = r["first"] == k  # else the range's last key begins in it
        if r["first"] == open_key:
            brought[r["__part"]] = (tuple(open_key), *before)
            if whole:
                run = [(b * pow(factor, n, 1 << 64) + x) % (1 << 64) for b, x in zip(before[1:], run, strict=True)]
                n += before[0]
        open_key, before = k, [n, *(x % (1 << 64) for x in run)]

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("__part").to_numpy()
            place = b.column("place").to_numpy().copy()
            run = [b.column(r).to_numpy().view(np.uint64).copy() for r in runs]
            keys = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
            for p in np.unique(part):
                if int(p) not in brought:
                    continue
                own, count, *carry = brought[int(p)]
                mine = part == p
                for k, v in zip(keys, own, strict=False):
                    mine &= k == v
                if mine.any():
                    up = powers(factor, int(place[mine].max()))[place[mine]]
                    for r, c in zip(run, carry, strict=True):
                        r[mine] += np.uint64(c) * up
                    place[mine] += count
            own = [b.column(v).to_numpy().astype(np.int64).view(np.uint64) for v in values]
            prev = [(r - x) * np.uint64(inverse) for r, x in zip(run, own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(place), *(pa.array(r.view(np.int64)) for r in (*run, *prev))],
                names=[*keep, "place", *runs, *(f"prev_{v}" for v in values)],
            )

    return ran.mapInArrow(shifted, kinds + ", ".join([*more[2:], *(f"`prev_{v}` long" for v in values)]))


#: Links that are ranked in one task, at most.
WALKED = 50_000


def list_ranks(links: DataFrame, sparse: int = 16, walked: int = WALKED, level: int = 0) -> DataFrame:
    """Rows ``(a, left)``: how much weight lies between ``a`` and the end of its list.

    ``links(a, nxt, w)``: each ``a`` once, ``nxt`` missing at a list's end, ``w`` the weight of the step. One in ``sparse`` items is a
    ruler, by a hash. Every item jumps along the list, twice as far each round, until it stands on a
    ruler or the end; the rulers then make a list of their own, which is ranked alike. A list of ``walked`` items at most
    is walked in one task. Work is some log2(sparse) + 8 joins of the list, and a ``sparse``-th of that for each further level.
    """
    links = stored(links.select("a", "nxt", "w"))
    if links.count() <= walked:

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = {a: (n, w) for b in batches for a, n, w in zip(*(c.to_pylist() for c in b.columns), strict=True)}
            left: dict[int, int] = {}
            for a in step:
                path = []
                while a is not None and a not in left:
                    path.append(a)
                    a = step[a][0]
                for x in reversed(path):
                    n, w = step[x]
                    left[x] = 0 if n is None else w + left[n]
            yield pa.RecordBatch.from_arrays([pa.array(list(left), pa.int64()), pa.array(list(left.values()), pa.int64())], names=["a", "left"])

        return links.coalesce(1).mapInArrow(walk, "a long, left long")

    def ruler(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(sparse)) == 0

    # The end of a list is done, and so is what stands before a ruler.
    now = links.select("a", F.col("nxt").alias("to"), F.when(F.col("nxt").isNull(), 0).otherwise(F.col("w")).alias("d"))
    now = stored(now.withColumn("done", F.col("to").isNull() | ruler("to")))
    for _ in range(200):
        if not now.where("not done").limit(1).count():
            break
        ahead = now.select(F.col("a").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        jumped = now.where("not done").join(ahead, "to")
        # What stands on the end of a list stays there.
        ended = F.col("to2").isNull()
        jumped = jumped.select(
            "a", F.when(ended, F.col("to")).otherwise(F.col("to2")).alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done")
        )
        now = stored(now.where("done").union(jumped))
    else:
        raise RuntimeError("a list did not end: the links hold a circle")
    rulers = now.where(ruler("a") | F.col("to").isNull())
    ranked = list_ranks(rulers.select("a", F.col("to").alias("nxt"), F.col("d").alias("w")), sparse, walked, level + 1)
    found = now.join(ranked.select(F.col("a").alias("to"), "left"), "to", "left")
    return found.select("a", (F.col("d") + F.coalesce("left", F.lit(0))).alias("left"))
