"""Fingerprints within a Hamming radius: multi-index hashing and the components it spans.

By the pigeonhole rule two 64-bit fingerprints that differ in at most ``radius`` bits differ in at
most ``radius // segments`` bits within one of their ``segments``. So each segment value is looked
up in its own table together with its small Hamming ball, and full distances are verified.

Components need no pair list. Segment values, not fingerprints, are probed; the fingerprints of a
value are held in chunks of bounded size, each pair of chunks is verified in one vectorised step,
and only a spanning forest of its links is passed on. A segment value that very many fingerprints
share becomes many chunk pairs, each a join key of its own; no task holds more than two chunks at a time.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, materialize
from .simhash import distance

CHUNK = 1024


def ball(width: int, radius: int) -> list[int]:
    """All bit patterns of ``width`` bits with at most ``radius`` ones, 0 first."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def segment_keys(fps: DataFrame, segments: int) -> DataFrame:
    """fp -> a row (fp, key) for each segment; key = segment number and value in one long."""
    width = 64 // segments
    mask = (1 << width) - 1
    keys = [
        F.shiftrightunsigned(F.col("fp"), s * width).bitwiseAND(F.lit(mask)) + F.lit(s << width).cast("long")
        for s in range(segments)
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _forest(batches, radius: int):
    """Rows of (a list, b list) -> spanning links (u, v) of the pairs within the radius."""
    for batch in batches:
        left, right = batch.column(0), batch.column(1)
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(batch.num_rows):
            a, b = left[i].values.to_numpy(zero_copy_only=False), right[i].values.to_numpy(zero_copy_only=False)
            near = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= radius
            rows, cols = near.any(1), near.any(0)
            if not rows.any():
                continue
            near, a, b = near[rows][:, cols], a[rows], b[cols]
            of_a = np.arange(len(a))
            while True:
                of_b = np.where(near, of_a[:, None], len(a)).min(0)
                new = np.minimum(of_a, np.where(near, of_b[None, :], len(a)).min(1))
                if (new == of_a).all():
                    break
                of_a = new
            us += [a, b]
            vs += [a[of_a], a[of_b]]
        u, v = np.concatenate(us), np.concatenate(vs)
        keep = u != v
        yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])


def links(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) whose components are those of all pairs within
    ``radius``; as few as span them."""
    width = 64 // segments
    table = segment_keys(fps, segments)
    sizes = table.groupBy("key").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    chunk = F.pmod(F.xxhash64("fp"), F.coalesce(F.col("parts"), F.lit(1))).cast("int")
    buckets = materialize(
        table.join(large, "key", "left")
        .groupBy("key", F.coalesce(F.col("parts"), F.lit(1)).alias("parts"), chunk.alias("c"))
        .agg(F.collect_list("fp").alias("fps")),
        "buckets",
    )
    patterns = [p for p in ball(width, radius // segments) if p]
    values = buckets.select("key", "parts").distinct()
    inside = (1 << width) - 1
    b = buckets.select("key", F.col("c").alias("cb"), F.col("fps").alias("b"))
    # each pair of chunks is a join key of its own, so those of a value that very many share are spread
    later = F.explode(F.sequence(F.col("c"), F.col("parts") - 1)).alias("cb")
    own = buckets.where((F.size("fps") > 1) | (F.col("parts") > 1)).select("key", F.col("fps").alias("a"), later)
    pairs = own.join(b, ["key", "cb"]).select("a", "b")
    if patterns:
        # of each unordered pair of values only the smaller one probes
        probes = values.select("key", "parts", F.explode(F.array(*[F.lit(p).cast("long") for p in patterns])).alias("p")).where(
            (F.col("key").bitwiseXOR(F.col("p"))).bitwiseAND(F.lit(inside)) > F.col("key").bitwiseAND(F.lit(inside))
        ).select(F.col("key").alias("from"), F.col("parts").alias("from_parts"), F.col("key").bitwiseXOR(F.col("p")).alias("key"))
        each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        hits = probes.join(values, "key").withColumn("ca", each("from_parts")).withColumn("cb", each("parts"))
        a = buckets.select(F.col("key").alias("from"), F.col("c").alias("ca"), F.col("fps").alias("a"))
        pairs = pairs.unionByName(hits.join(a, ["from", "ca"]).join(b, ["key", "cb"]).select("a", "b"))
    single = (F.size("a") == 1) & (F.size("b") == 1)
    near = distance(F.get(F.col("a"), 0), F.get(F.col("b"), 0)) <= radius
    pairs = pairs.where(~single | near)
    return pairs.transform(map_arrow, lambda it: _forest(it, radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Links (u, v) -> (node, root) for every node of a link: root is the least node that can be
    reached. Alternating large-star and small-star rounds; each node's minimum is pre-aggregated
    and a hub's rows stay splittable, so no neighbour list is ever built."""
    edges = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
