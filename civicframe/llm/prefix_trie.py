"""The trie of conversation prefixes by the Euler-tour technique."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard_join import _MIX
from .scans import list_ranks, running
from .store import stored, tasks

#: Multiplier of the prefixes' fingerprints: odd, so that it can be undone.
FACTOR = int(_MIX[0])
#: Children of one node that share a key in the join with their parent, at most.
SIBLINGS = 100_000
#: Members of a node in one row of its digest, at most.
CHUNK = 200_000
NODE = ["depth", "h1", "h2"]


def borrowed(conv: Column) -> Column:
    """How many turns a conversation takes from the one whose id is the next lower multiple of 20."""
    return (F.crc32(conv.cast("string")) % 4).cast("long")


def rebuilt(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All conversations, and the turns of each as rebuilt: ``conv, part, at, x1, x2, words``, in order of the first three."""
    own = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))),
    )
    own = own.withColumns(
        {
            "x1": F.xxhash64("role", "text"),
            "x2": F.xxhash64(F.lit(1), "text", "role"),
            "words": F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long"),
        }
    )
    # Equal turns are ordered by what they say; rows that agree in all are alike.
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.monotonically_increasing_id()]
    placed = stored(running(own, order, ["conv"], [], keep=["conv", "x1", "x2", "words"]).withColumnRenamed("place", "at"))
    convs = stored(placed.select("conv").distinct())
    tail = placed.where(F.col("at") > borrowed(F.col("conv"))).select("conv", F.lit(1).cast("long").alias("part"), "at", "x1", "x2", "words")
    # Three rows a conversation at most, for twenty takers at most.
    heads = placed.where("at <= 3").withColumnRenamed("conv", "giver")
    takers = convs.select("conv", (F.col("conv") - F.col("conv") % 20).alias("giver"))
    head = takers.join(heads, "giver").where(F.col("at") <= borrowed(F.col("conv")))
    return convs, tail.union(head.select("conv", F.lit(0).cast("long").alias("part"), "at", "x1", "x2", "words"))


def member_digests(ends: DataFrame) -> DataFrame:
    """Rows ``depth, h1, h2, ends_sha256`` of the members ``conv`` of each node, ascending, comma-joined.

    Members are dealt by ranges of node and id, so a node with very many of them spreads over tasks;
    each sends its stretch as one string. The digest itself can only run from the first to the last
    stretch of a node, which it does a row at a time.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k], pa.int64()) for k in key), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
                names=[*NODE, "first", "ids"],
            )

        for b in batches:
            for *node, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node != key or len(ids) >= CHUNK:
                    if ids:
                        yield row()
                    key, ids = node, []
                ids.append(conv)
        if ids:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([digest.hexdigest()])], names=[*NODE, "ends_sha256"])

        for b in batches:
            for *node, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        yield row()
                    key, digest = node, hashlib.sha256()
                digest.update(ids.encode())
        if key is not None:
            yield row()

    n = tasks(ends.sparkSession)
    sort = [*NODE, "conv"]
    stretches = ends.select(*sort).repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    stretches = stretches.mapInArrow(strings, "depth long, h1 long, h2 long, first long, ids string")
    joined = stretches.repartition(n, *NODE).sortWithinPartitions(*NODE, "first")
    return joined.mapInArrow(digests, "depth long, h1 long, h2 long, ends_sha256 string")


def subtree_sums(tree: DataFrame) -> DataFrame:
    """Rows ``id, n_leaves, saved_tokens`` summed over each node's subtree, from ``tree(id, first, n_children, leaf, saved)``.

    ``first``: the id of the first of a node's ``n_children`` children, whose ids follow each other.
    A node has an arc to enter it, ``2 * id``, and one to leave it, ``2 * id + 1``. The tour enters
    the first child or leaves at once, goes on to the next sibling or leaves the parent. The list of
    arcs is ranked, put in order and summed; a subtree lies between its two arcs.
    """
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    last = tree.where("n_children > 0").select((F.col("first") + F.col("n_children") - 1).alias("id"), leave.alias("up"))
    inward = tree.select(
        enter.alias("a"), F.when(F.col("n_children") > 0, F.col("first") * 2).otherwise(leave).alias("nxt"), "leaf", "saved"
    )
    # The root, which has the id 1, has no sibling: the tour ends when it is left.
    beside = F.when(F.col("id") == 1, F.lit(None)).otherwise(F.coalesce("up", (F.col("id") + 1) * 2))
    zero = F.lit(0).cast("long")
    outward = tree.select("id").join(last, "id", "left").select(leave.alias("a"), beside.alias("nxt"), zero.alias("leaf"), zero.alias("saved"))
    arcs = stored(inward.union(outward))
    ranks = list_ranks(arcs.select("a", "nxt", F.lit(1).cast("long").alias("w")))
    toured = arcs.join(ranks, "a").select("a", "leaf", "saved", (-F.col("left")).alias("spot"))
    summed = running(toured, [F.col("spot")], [], ["leaf", "saved"], keep=["a", "leaf", "saved"])
    entered, node = F.col("a") % 2 == 0, F.shiftright("a", 1).alias("id")
    # What lies before a node's subtree counts as less, what lies before its end as more.
    return summed.groupBy(node).agg(
        *(
            F.sum(F.when(entered, F.col(c) - F.col(f"run_{c}")).otherwise(F.col(f"run_{c}"))).alias(name)
            for c, name in (("leaf", "n_leaves"), ("saved", "saved_tokens"))
        )
    )


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` (both over the subtree), ``ends_sha256`` (of the members that end there).

    A conversation's turns are ordered by ``turn``, missing first, then by role and text. Its first h
    turns, h from a hash of its id, are replaced by those of the conversation whose id is the next
    lower multiple of 20 (fewer or none if that has fewer or is absent). A node is a distinct sequence
    of first turns, the root the empty one. Missing roles and texts are empty; rows without a conversation id
    belong to none; rows that repeat are turns of their own. Texts of any length count by
    fingerprints of 128 bits in all. Without any conversation there is no node. No further column is read.

    Prefixes are fingerprints that run along the table in order of conversation and turn, so a
    conversation of any length spreads over tasks. The same holds for a node with any number of
    children or members.
    """
    convs, rows = rebuilt(turns, conv, turn, role, text)
    rows = running(rows, [F.col("part"), F.col("at")], ["conv"], ["x1", "x2"], FACTOR, keep=["conv", "x1", "x2", "words"])
    names = {"place": "depth", "run_x1": "h1", "run_x2": "h2", "prev_x1": "p1", "prev_x2": "p2"}
    rows = stored(rows.select("conv", "words", *(F.col(c).alias(n) for c, n in names.items())))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.count("conv").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in NODE), zero.alias("words"), none.alias("p1"), none.alias("p2"), "n_convs", "conv_id")
    nodes = rows.groupBy(*NODE).agg(
        *(F.max(c).alias(c) for c in ("words", "p1", "p2")), F.count("conv").alias("n_convs"), F.min("conv").alias("conv_id")
    )
    # Ids in this order: the root first, siblings side by side.
    order = [F.col(c).asc_nulls_first() for c in ("depth", "p1", "p2", "conv_id", "h1", "h2")]
    ids = stored(running(root.unionByName(nodes), order, [], []).withColumnRenamed("place", "id"))
    parents = ids.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    parents = parents.agg(F.min("id").alias("first"), F.count("id").alias("n_children"))
    tree = ids.join(parents, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    tree = stored(
        tree.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    )
    # Children's ids follow each other, so a node's join with its children is cut into stretches of ids.
    stretch = F.explode(F.sequence(F.floor(F.col("first") / SIBLINGS), F.floor((F.col("first") + F.col("n_children") - 1) / SIBLINGS)))
    above = tree.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), stretch.alias("stretch"), F.col("conv_id").alias("parent_conv_id")
    )
    ends = rows.groupBy("conv").agg(F.max_by(F.struct(*NODE), "depth").alias("end"))
    ends = convs.join(ends, "conv", "left").select("conv", *(F.coalesce(f"end.{c}", zero).alias(c) for c in NODE))
    found = (
        tree.withColumn("stretch", F.floor(F.col("id") / SIBLINGS))
        .join(above, ["depth", "p1", "p2", "stretch"], "left")
        .join(member_digests(ends), NODE, "left")
        .join(subtree_sums(tree), "id")
    )
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
