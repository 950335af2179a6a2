"""Conversation prefix trie by preorder intervals.

A node is a distinct sequence of first d turns, told by 128 bits: the exclusive or of hashes of (position,
turn), so prefixes of any length come from running totals over blocks of ``TURNS`` turns and no task holds
a conversation whole. Conversations are ranked lexicographically the same way: each block's turns are one
array, distinct arrays are sorted over the cluster and named by their place, and names are gathered into
blocks again until one is left. A node's place in preorder is that of (least rank of its members, depth).

Its subtree is what follows up to the last node whose least rank is no larger than its own members' greatest:
``subtree_end``. Leaves and savings of a subtree are differences of prefix sums along the preorder, made per
range of a distributed sort, with the ranges' totals added after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import before, value_bucket
from .shared import map_arrow, materialize

#: Turns of a conversation that meet in one group.
TURNS = 256
#: Conversation numbers of which one piece of an ends list is made.
ENDS = 1 << 16
NODE = ["depth", "h1", "h2"]


def _two(*columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), *columns) for salt in (1, 2)]


def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, d (1 for the first turn, ...), k1, k2 (identity of role and text), bytes (of the text).

    Turns are in the order of their number, null first, equal ones by role and text; null role or text counts as
    empty; rows without a conversation id belong to none and are left out. Positions come from counts per
    range of turn numbers, so a conversation that holds most rows isn't sorted in one task."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = before(rows, order, F.lit(1).cast("long"), value_bucket(rows, "turn"), "d", ["conv_id"])
    k1, k2 = _two(F.col("role"), F.col("text"))
    return materialize(placed.select("conv_id", (F.col("d") + 1).alias("d"), k1.alias("k1"), k2.alias("k2"), F.octet_length("text").cast("long").alias("bytes")), "turns")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginning by groups of ``group`` numbers: with h = crc32(number) % most, the first h
    turns of the group's first conversation (all if fewer, none if it is absent), then the own turns after the first h.
    -> (turns as in ``numbered``; conv_id, n: every conversation with its number of turns, which may be 0)."""
    c = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.max("d").alias("own")).withColumns({"h": (F.crc32(c.cast("string")) % most).cast("long"), "base": c - c % group})
    heads = turns.where((F.col("d") < most) & (c % group == 0)).groupBy(c.alias("base")).agg(F.sort_array(F.collect_list(F.struct("d", "k1", "k2", "bytes"))).alias("head"))
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<d:bigint,k1:bigint,k2:bigint,bytes:bigint>>")), F.lit(1), F.col("h").cast("int"))
    asked = own.join(heads, "base", "left").select("conv_id", "own", "h", head.alias("head"))
    asked = materialize(asked.withColumn("k", F.size("head").cast("long")), "asked")
    first = asked.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    rest = turns.join(asked.select("conv_id", "h", "k"), "conv_id").where(F.col("d") > F.col("h"))
    rest = rest.select("conv_id", (F.col("d") - F.col("h") + F.col("k")).alias("d"), "k1", "k2", "bytes")
    length = F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return materialize(first.unionByName(rest), "rebuilt"), asked.select("conv_id", length.alias("n"))


def _ranks(turns: DataFrame) -> DataFrame:
    """conv_id, rank: ascending with the sequences of turns, equal for equal ones, a prefix before what goes on."""
    level = turns.select("conv_id", (F.col("d") - 1).alias("at"), F.struct("k1", "k2").alias("item"))
    while True:
        block = F.floor(F.col("at") / TURNS).cast("long").alias("block")
        parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: x["item"])
        blocks = materialize(level.groupBy("conv_id", block).agg(parts.alias("parts")), "blocks")
        # a task of a sort numbers what it has above what the ranges before it have
        names = materialize(blocks.select("parts").distinct().sort("parts").select("parts", (F.monotonically_increasing_id() + 1).alias("item")), "names")
        named = blocks.join(names, "parts")
        if not blocks.agg(F.max("block").alias("b")).first()["b"]:
            return named.select("conv_id", F.col("item").alias("rank"))
        level = named.select("conv_id", F.col("block").alias("at"), "item")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Adds h1, h2 (the sequence up to the turn) and p1, p2 (without it)."""
    x1, x2 = _two(F.col("d"), F.col("k1"), F.col("k2"))
    rows = turns.withColumns({"x1": x1, "x2": x2, "block": F.floor((F.col("d") - 1) / TURNS)})
    own = ["conv_id", "block"]
    totals = rows.groupBy(*own).agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    base = totals.select(*own, *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    within = Window.partitionBy(*own).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"w{i}": F.bit_xor(f"x{i}").over(within) for i in (1, 2)}).join(base, own)
    h = {f"h{i}": F.col(f"w{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)}
    return run.withColumns(h).withColumns({f"p{i}": F.col(f"h{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)})


def _sums(rows: DataFrame, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Adds ``<name>_0`` and ``<name>_1`` for each value: its total before a row in ``order``, which must be total, and with it."""
    dealt = materialize(rows.withColumns({f"_{n}": v for n, v in values.items()}).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_p").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values])
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = totals.select("_p", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_b") for n in values])
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumns({f"_{n}_w": F.sum(f"_{n}").over(within) for n in values}).join(base, "_p")
    return run.withColumns({f"{n}_1": F.col(f"_{n}_b") + F.col(f"_{n}_w") for n in values}).withColumns({f"{n}_0": F.col(f"{n}_1") - F.col(f"_{n}") for n in values}).select(
        *rows.columns, *[f"{n}_{i}" for n in values for i in (0, 1)])


def _digests(batches):
    """Rows (rank, piece) in order -> rank and SHA-256 of its pieces joined by commas, read as a stream."""
    at, digest = None, None
    for batch in batches:
        done = []
        for rank, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if rank != at:
                if digest:
                    done.append((at, digest.hexdigest()))
                at, digest = rank, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["rank", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["rank", "ends_sha256"])


def _ends(ids: DataFrame) -> DataFrame:
    """rank, ends_sha256: of the ids that share the rank, ascending, joined by commas."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ids.groupBy("rank", F.floor(F.col("conv_id") / ENDS).alias("part")).agg(listed.alias("piece"))
    return map_arrow(pieces.repartition("rank").sortWithinPartitions("rank", "part").select("rank", "piece"), _digests, "rank long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie of the given conversations: conv_id (its smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree: bytes of a node's last text times its members
    but one), ends_sha256, and with them preorder (from 0) and subtree_end (the first place after the subtree).

    ``turns`` as of ``numbered``, ``ids`` (conv_id, n) has every conversation, those without turns too, once. No
    conversation, no row. Conversations that repeat others are members of the same nodes."""
    ids = materialize(ids.join(_ranks(turns), "conv_id", "left").select("conv_id", "n", F.coalesce("rank", F.lit(0)).alias("rank")), "ids")
    rows = _prefixes(turns).join(ids, "conv_id").select("conv_id", F.col("d").alias("depth"), "h1", "h2", "p1", "p2", "bytes", "rank", (F.col("d") == F.col("n")).alias("ends"))
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    roots = ids.select("conv_id", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), none.alias("p1"), none.alias("p2"), zero.alias("bytes"), "rank", (F.col("n") == 0).alias("ends"))
    nodes = rows.unionByName(roots).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("rank").alias("low"), F.max("rank").alias("high"),
        F.count_if("ends").alias("n_ends"), *[F.min(c).alias(c) for c in ("p1", "p2", "bytes")])
    # what all members end at has no children
    values = {"nodes": F.lit(1).cast("long"), "leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}
    ordered = materialize(_sums(nodes, ["low", "depth"], values), "preorder")
    last = ordered.groupBy(F.col("low").alias("high")).agg(*[F.max(f"{n}_1").alias(f"{n}_e") for n in values])
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")]
    children = ordered.where("depth > 0").groupBy(*above).agg(F.count("*").alias("children"))
    parents = ordered.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(ids).withColumnRenamed("rank", "low")
    return (
        ordered.join(last, "high").join(children, NODE, "left").join(parents, ["depth", "p1", "p2"], "left").join(ends, "low", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"), (F.col("leaves_e") - F.col("leaves_0")).alias("n_leaves"),
            (F.col("saved_e") - F.col("saved_0")).alias("saved_tokens"),
            F.when(F.col("n_ends") > 0, F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
            F.col("nodes_0").alias("preorder"), F.col("nodes_e").alias("subtree_end"))
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see ``numbered``, ``rebuilt`` and ``prefix_trie``."""
    return prefix_trie(*rebuilt(numbered(conversations)))
