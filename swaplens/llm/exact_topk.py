"""Exact top-k by inner product through a pivot-distance index.

Components become integers floor(``scale`` * x), so scores are exact. A vector x of norm at most M is lifted to (x, sqrt(M^2 - |x|^2)),
a query q to (q, 0); then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the largest scores are the nearest points. Each point is keyed
by its nearest pivot and its distance r from it; sorted by that key, runs of at most ``BLOCK`` points of one pivot are the index's
annuli. By the triangle inequality a point nearer to the query than D has |d(q, pivot) - r| < D.

Queries that lie close together go in blocks too. First each block of queries searches the annulus it lies in or nearest
to; a query's k-th score there gives the D beyond which nothing can enter its result. Then the annuli on either side that
reach into D for some query of the block are searched, and no others. Rows are never left out: pivots, from a bounded sample, only
decide how much is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import map_arrow, materialize
from .vector_codes import finite_vectors, matrix

K, SCALE = 20, 64.0
#: Points of one annulus and queries of one block, at most.
BLOCK, QUERIES = 2048, 256
#: Rows (least hashes) that pivots are taken from, and how many there are at most.
SAMPLE, PIVOTS = 4096, 64
#: Float distances are off by far less than this share of their size.
SLACK = 1e-6


def _ints(values: np.ndarray) -> np.ndarray:
    """Rows of whole numbers as float64 where all inner products are exact in it, else as 64-bit integers."""
    return values if (values**2).sum(1).max(initial=0) < 2**52 else values.astype(np.int64)


def _pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Points far from each other, from the first on: each next one is that farthest from those before."""
    if not len(points):
        return points
    chosen, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]])


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots."""
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def _keyed(batches: Iterator, pivots: np.ndarray, most: float, query: bool) -> Iterator:
    """vec_id, row, x -> with cell (nearest pivot) and r (distance from it)."""
    for batch in batches:
        x = matrix(batch.column("x"), pivots.shape[1] - 1)
        gaps = _gaps(np.hstack([x, np.zeros((len(x), 1))]) if query else _lift(x, most), pivots)
        cell = gaps.argmin(1) if len(x) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(x)), cell])], names=[*batch.schema.names, "cell", "r"])


BLOCKS = "cell int, low double, high double, ids array<long>, rows array<long>, data binary"


def _cut(batches: Iterator, size: int) -> Iterator:
    """Sorted rows -> runs of one cell and at most ``size`` rows; only one run is held at a time."""
    held, count = [], 0

    def run(part: pa.Table) -> pa.RecordBatch:
        r = part.column("r").to_numpy()
        values = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays(
            [part.column("cell").combine_chunks().slice(0, 1), pa.array([r[0]]), pa.array([r[-1]]), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
             pa.array([part.column("row").to_pylist()], pa.list_(pa.int64())), pa.array([values.astype(np.float64).tobytes()], pa.binary())], names=["cell", "low", "high", "ids", "rows", "data"])

    for batch in batches:
        start, cells = 0, batch.column("cell").to_numpy()
        while start < batch.num_rows:
            here = held[0].column("cell")[0].as_py() if held else cells[start]
            end = start + int(np.searchsorted(cells[start:], here, side="right"))
            end = min(end, start + size - count)
            if end > start:
                held.append(batch.slice(start, end - start))
                count += end - start
                start = end
            if count == size or (start < batch.num_rows and held):
                yield run(pa.Table.from_batches(held))
                held, count = [], 0
    if held:
        yield run(pa.Table.from_batches(held))


def _blocks(keyed: DataFrame, size: int) -> DataFrame:
    """Runs of rows in the order of (cell, r); equal distances go by id, so that any number of equal vectors is cut too."""
    order = ["cell", "r", "vec_id", "row"]
    cut = map_arrow(keyed.repartitionByRange(*order).sortWithinPartitions(*order), lambda b: _cut(b, size), BLOCKS)
    return materialize(cut.withColumn("block", F.monotonically_increasing_id()), "annuli")


FOUND = "row long, query_id long, vec_id long, score long"


def _search(batches: Iterator, k: int) -> Iterator:
    """Rows of an annulus and a block of queries -> the k best of the annulus for each query, of those that reach its threshold."""
    empty = [np.empty(0, np.int64)]
    for batch in batches:
        out = [list(empty) for _ in range(4)]
        column = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            ids, asked = column["ids"][i].values.to_numpy(), column["q_ids"][i].values.to_numpy()
            x = np.frombuffer(column["data"][i].as_buffer(), np.float64).reshape(len(ids), -1)
            q = np.frombuffer(column["q_data"][i].as_buffer(), np.float64).reshape(len(asked), -1)
            least = column["least"][i].values.to_numpy()
            both = _ints(np.vstack([x, q]))
            x, q = both[: len(ids)], both[len(ids) :]
            scores = (q @ x.T).astype(np.int64)
            good = (scores >= least[:, None]) & (asked[:, None] != ids[None, :])
            rows = column["q_rows"][i].values.to_numpy()
            for n in np.flatnonzero(good.any(1)):
                at = np.flatnonzero(good[n])
                if len(at) > k:  # what is below the k-th score can't be among the k best
                    at = at[scores[n, at] >= np.partition(scores[n, at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((ids[at], -scores[n, at]))[:k]]
                for held, new in zip(out, (np.full(len(at), rows[n]), np.full(len(at), asked[n]), ids[at], scores[n, at]), strict=True):
                    held.append(new)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["row", "query_id", "vec_id", "score"])


NONE = -(1 << 62)


def _reach(batches: Iterator, pivots: np.ndarray, most: float, first: bool) -> Iterator:
    """Blocks of queries with thresholds -> the distances (low..high) from each pivot that they still must search.

    ``first``: only the pivot they lie at, and only their own distance."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            n = len(batch.column("q_ids")[i].values)
            q = np.frombuffer(batch.column("q_data")[i].as_buffer(), np.float64).reshape(n, -1)
            block = batch.column("q_block")[i].as_py()
            gaps = _gaps(np.hstack([q, np.zeros((n, 1))]), pivots)
            if first:
                cell = batch.column("q_cell")[i].as_py()
                rows.append((block, cell, float(gaps[:, cell].min()), float(gaps[:, cell].max())))
                continue
            least = batch.column("least")[i].values.to_numpy()
            squares = (q**2).sum(1) + most
            far = np.where(least == NONE, np.inf, np.sqrt(np.maximum(squares - 2.0 * np.maximum(least, -(2.0**60)), 0)))
            far = far + SLACK * (np.sqrt(squares) + 1)
            lows, highs = (gaps - far[:, None]).min(0), (gaps + far[:, None]).max(0)
            rows += [(block, c, float(lo), float(hi)) for c, (lo, hi) in enumerate(zip(lows, highs, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.float64()))], names=["q_block", "cell", "q_low", "q_high"])


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_topk(
    vectors: DataFrame, every: int = 20, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = BLOCK, queries: int = QUERIES, pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every`` its k best of all rows of another id, by
    the inner product of the integer vectors, ties to the smaller id; all if there are fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Rows that repeat an id are
    candidates each, and queries each (never for rows of their own id). Unequal lengths, and vectors whose squared norm reaches
    2^62, raise. An empty table gives no row."""
    vec_id = F.col(id_col).cast("long").alias("vec_id")
    ints = F.transform("x", lambda v: F.floor(v * F.lit(scale)).cast("double"))
    kept = finite_vectors(vectors, vector_col, vec_id).where("vec_id IS NOT NULL").select("vec_id", F.monotonically_increasing_id().alias("row"), ints.alias("x"))
    kept = materialize(kept, "vectors")
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    told = kept.agg(F.max(norm).alias("most"), F.min(F.size("x")).alias("short"), F.max(F.size("x")).alias("long")).first()
    if told["most"] is None:
        return kept.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if told["short"] != told["long"]:
        raise ValueError("vectors must all have one length")
    if told["most"] >= 2.0**62:
        raise ValueError("vector components are too large for exact integers")
    most = told["most"]
    sample = kept.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).select("x").toPandas()["x"]  # SAMPLE rows
    chosen = _pivots(_lift(np.array([np.asarray(x, float) for x in sample]).reshape(len(sample), told["long"]), most), pivots)

    def keyed(rows: DataFrame, query: bool) -> DataFrame:
        return map_arrow(rows, lambda b: _keyed(b, chosen, most, query), "vec_id long, row long, x array<double>, cell int, r double")

    annuli = _blocks(keyed(kept, False), block)
    asked = _blocks(keyed(kept.where(F.col("vec_id") % every == 0), True), queries)
    asked = asked.select(F.col("block").alias("q_block"), F.col("cell").alias("q_cell"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("data").alias("q_data"))
    directory = annuli.select("cell", "low", "high", "block", F.size("ids").alias("n"))

    def searched(waiting: DataFrame, visits: DataFrame) -> DataFrame:
        """What the visits (q_block, block) find."""
        return map_arrow(
            visits.join(waiting, "q_block").join(annuli.select("block", "ids", "data"), "block").select("ids", "data", "q_ids", "q_rows", "q_data", "least"), lambda b: _search(b, k), FOUND)

    def reach(waiting: DataFrame, first: bool) -> DataFrame:
        return map_arrow(waiting, lambda b: _reach(b, chosen, most, first), "q_block long, cell int, q_low double, q_high double")

    # the annulus that a block of queries lies in, or nearest to, of the pivot it lies at; if that has none, any
    fresh = asked.withColumn("least", F.transform("q_ids", lambda _: F.lit(NONE).cast("long")))
    own = reach(fresh, True).join(directory, "cell")
    gap = F.greatest(F.col("low") - F.col("q_high"), F.col("q_low") - F.col("high"), F.lit(0.0))
    home = own.groupBy("q_block").agg(F.min(F.struct(gap.alias("gap"), F.abs(F.col("low") + F.col("high") - F.col("q_low") - F.col("q_high")).alias("off"), F.col("block"))).alias("b"))
    home = materialize(home.select("q_block", F.col("b.block").alias("block")), "home")
    begun = materialize(searched(fresh, home), "begun")
    kth = _best(begun, k).where(F.col("rank") == k).select("row", F.col("score").alias("least"))
    flat = asked.select("q_block", F.posexplode("q_rows").alias("at", "row")).join(kth, "row", "left")
    least = flat.groupBy("q_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("least", F.lit(NONE)).alias("least")))), lambda t: t["least"]).alias("least"))
    open_ = materialize(asked.join(least, "q_block"), "open")
    visits = (
        reach(open_, False).join(directory, "cell").where((F.col("low") <= F.col("q_high")) & (F.col("high") >= F.col("q_low"))).select("q_block", "block")
        .join(home, ["q_block", "block"], "left_anti")
    )
    found = begun.unionByName(searched(open_, materialize(visits, "visits")))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
