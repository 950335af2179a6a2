"""Nearest donors in a tree of cells, exactly.

The donors of a group are cut by quantiles of one feature after another into cells of about ``size`` donors; equal
vectors, which no cut can part, are dealt to several blocks of a cell. A block is one row with its donors' values and the box
around them; the levels of the tree are tables of boxes.

Requests of a group that fall into one cell form chunks. A chunk first meets the blocks of its own cell, which bounds the
k-th distance of each request; a request that finds fewer than k there asks the cell above, and so on. Then chunks go down the tree,
from level to level by equality joins, into those boxes only that one of their requests reaches. The blocks of a chunk come to it one
after another, the nearest first, and each meets only the requests that still reach it. What can be among their k nearest is kept, so
few rows more than k leave the task for a request. No join pairs requests with a group, and no task holds more than a chunk, what it
found and the blocks of one batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stored import stored

#: Donors of a cell, about, and requests of a chunk, at most.
SIZE, CHUNK = 1024, 2048
#: Parts that one level cuts a cell into, at most.
FAN = 64
#: Distances are compared after rounding to nine digits.
MARGIN = 2e-9
#: Donors that a chunk remembers before it forgets those that it found no longer near.
ROOM = 8192
#: Requests of a chunk where all donors within a radius are asked for, at most: fewer chunks carry fewer copies of blocks.
WIDE = 4096
#: Rows of an output batch.
OUT = 1 << 17


def _parts(df: DataFrame, by: Sequence[str], size: int, key: Column) -> DataFrame:
    """Adds ``part``: groups of ``by`` with more than ``size`` rows are dealt to several parts by the hash of ``key``."""
    large = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > size).select(*by, F.ceil(F.col("_n") / size).cast("int").alias("_parts"))
    return df.join(large, list(by), "left").withColumn("part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def _place(cuts: Column, x: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= x))


def _tree(donors: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int) -> tuple[list[DataFrame], DataFrame]:
    """Cuts (keys, cell, cuts) of each level, and donors with ``cell``, a number with a digit to base ``FAN`` for each level."""
    largest = donors.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    wanted = math.ceil(largest / size)
    levels = 0 if wanted <= 2 else max(min(len(columns), math.ceil(math.log2(wanted))), math.ceil(math.log(wanted, FAN)))
    donors = donors.withColumn("cell", F.lit(0).cast("long"))
    steps = []
    for level in range(levels):
        x = columns[level % len(columns)]
        quantiles = F.percentile_approx(x, F.array(*[F.lit(i / FAN) for i in range(1, FAN)])).alias("q")
        found = donors.groupBy(*keys, "cell").agg(F.count("*").alias("n"), quantiles)
        parts = F.least(F.ceil(F.pow(F.col("n") / size, 1 / (levels - level))), F.lit(FAN)).alias("parts")
        # of the quantiles, those that begin a part
        cuts = F.filter("q", lambda _, i: F.floor((i + 1) * F.col("parts") / FAN) > F.floor(i * F.col("parts") / FAN))
        step = stored(found.select(*keys, "cell", "q", parts).select(*keys, "cell", F.array_distinct(cuts).alias("cuts")), "cuts")
        donors = _down(donors, step, keys, x)
        steps.append(step)
    return steps, donors


def _down(rows: DataFrame, step: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Rows to the cells of the next level; where the tree has none, to the first below."""
    return rows.join(step, [*keys, "cell"], "left").withColumn("cell", F.col("cell") * FAN + F.coalesce(_place(F.col("cuts"), F.col(x)), F.lit(0))).drop("cuts")


def _box(columns: Sequence[str], low: str, high: str) -> list[Column]:
    return [F.array(*[F.min(c) for c in columns]).alias(low), F.array(*[F.max(c) for c in columns]).alias(high)]


def _around(boxes: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """The boxes around boxes."""
    g = boxes.groupBy(*by).agg(*[F.min(F.get("low", F.lit(i))).alias(f"_l{i}") for i in range(width)], *[F.max(F.get("high", F.lit(i))).alias(f"_h{i}") for i in range(width)])
    return g.select(*by, F.array(*[F.col(f"_l{i}") for i in range(width)]).alias("low"), F.array(*[F.col(f"_h{i}") for i in range(width)]).alias("high"))


def _near(width: int) -> Column:
    """Whether boxes (c_low, c_high) and (low, high) are no further apart than ``reach``; null reaches everything."""
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    gaps = [F.greatest(at("low", i) - at("c_high", i), at("c_low", i) - at("high", i), F.lit(0.0)) for i in range(width)]
    return F.col("reach").isNull() | (F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gaps])) <= F.col("reach"))


def codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where values are; -1 and -2 for null, which equals nothing."""
    encoded = pa.concat_arrays([a, b]).dictionary_encode().indices
    numbers = encoded.fill_null(-1).to_numpy(zero_copy_only=False)
    left, right = numbers[: len(a)], numbers[len(a) :].copy()
    right[right == -1] = -2
    return left, right


def _apart(donors: pa.StructArray, asked: pa.StructArray, width: int) -> np.ndarray:
    """Distances of requests (rows) and donors (columns), inf where a donor is barred."""
    total = np.zeros((len(asked), len(donors)))
    for j in range(width):
        gap = asked.field(f"z{j}").to_numpy(zero_copy_only=False)[:, None] - donors.field(f"z{j}").to_numpy(zero_copy_only=False)[None, :]
        total = gap * gap if j == 0 else total + gap * gap
    distance = np.sqrt(total)
    own, theirs = codes(donors.field("d_physical"), asked.field("physical_id"))
    ids, sources = codes(donors.field("donor_id"), asked.field("source_id"))
    barred = (theirs[:, None] == own[None, :]) | (sources[:, None] == ids[None, :]) | (own == -1)[None, :] | (theirs == -2)[:, None] | np.isnan(distance)
    distance[barred] = np.inf
    return distance


def _floats(a: pa.Array) -> np.ndarray:
    """Numbers, with inf for null."""
    x = a.to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(x), np.inf, x)


def _points(asked: pa.StructArray, width: int) -> np.ndarray:
    return np.column_stack([asked.field(f"z{j}").to_numpy(zero_copy_only=False) for j in range(width)])


def _gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of points (rows) and boxes (columns)."""
    total = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j][:, None]
        gap = np.maximum(np.maximum(low[:, j][None, :] - x, x - high[:, j][None, :]), 0.0)
        total += gap * gap
    return np.sqrt(total)


def _reached(batches: Iterator, width: int, schema: pa.Schema) -> Iterator:
    """Rows of (chunk, asked, boxes) -> chunk, block, gap: the boxes that one of the requests reaches, and their distance from the nearest request."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked, boxes = batch.column("asked")[i].values, batch.column("boxes")[i].values
            points, reach = _points(asked, width), _floats(asked.field("kth")) + MARGIN
            for first in range(0, len(boxes), SIZE):
                part = boxes.slice(first, SIZE)
                low, high = (part.field(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("low", "high"))
                gaps = _gaps(points, low, high)
                met = np.flatnonzero((gaps <= reach[:, None]).any(axis=0))
                chunk = batch.column("chunk").take(pa.array(np.full(len(met), i)))
                yield pa.RecordBatch.from_arrays([chunk, part.field("block").take(pa.array(met)), pa.array(gaps[:, met].min(axis=0))], schema=schema)


class _Found:
    """What a chunk of requests has found: places of requests, places of donors in ``known`` and distances."""

    def __init__(self, asked: pa.StructArray, hospital: pa.Array, width: int, k: int) -> None:
        self.asked, self.hospital, self.width, self.k = asked, hospital, width, k
        self.points, self.limit = _points(asked, width), _floats(asked.field("kth"))
        self.full = np.zeros(len(asked), bool)
        self.known, self.room = None, ROOM
        self.rows, self.at, self.distance = np.zeros(0, int), np.zeros(0, int), np.zeros(0)

    def near(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The requests that still reach a box."""
        return np.flatnonzero(_gaps(self.points, low[None, :], high[None, :])[:, 0] <= self.limit + MARGIN)

    def meet(self, donors: pa.StructArray, active: np.ndarray) -> None:
        distance = _apart(donors, self.asked.take(pa.array(active)), self.width)
        limit = self.limit[active]
        if len(donors) > self.k:
            limit = np.minimum(limit, np.partition(distance, self.k - 1, axis=1)[:, self.k - 1])
        rows, at = np.nonzero((distance <= (limit + MARGIN)[:, None]) & ~np.isinf(distance))
        if not len(rows):
            return
        used, places = np.unique(at, return_inverse=True)
        new = donors.take(pa.array(used))
        before = 0 if self.known is None else len(self.known)
        self.known = new if self.known is None else pa.concat_arrays([self.known, new])
        touched = np.zeros(len(self.asked), bool)
        touched[active[rows]] = True
        old = touched[self.rows]
        d = np.concatenate([self.distance[old], distance[rows, at]])
        at = np.concatenate([self.at[old], places + before])
        rows = np.concatenate([self.rows[old], active[rows]])
        tie = pc.rank(self.known.field("tie"), tiebreaker="dense").to_numpy()
        order = np.lexsort((tie[at], d, rows))
        rows, at, d = rows[order], at[order], d[order]
        # beyond the first k stay those that rounding can move among them: fewer than k of lesser tie at the very same distance or surely nearer
        index, new_row, new_d = np.arange(len(rows)), np.ones(len(rows), bool), np.ones(len(rows), bool)
        new_row[1:] = rows[1:] != rows[:-1]
        new_d[1:] = new_row[1:] | (d[1:] != d[:-1])
        start, same = (np.maximum.accumulate(np.where(n, index, 0)) for n in (new_row, new_d))
        last = np.flatnonzero(index - start == self.k - 1)
        self.limit[rows[last]] = np.minimum(self.limit[rows[last]], d[last])
        self.full[rows[last]] = True
        reach = self.limit[rows]
        surely = np.bincount(rows[d < reach - MARGIN], minlength=len(self.asked))[rows]
        good = (d <= reach + MARGIN) & ((index - start < self.k) | (index - same < self.k - surely))
        rest = ~old
        self.rows, self.at, self.distance = (np.concatenate([a[rest], b[good]]) for a, b in ((self.rows, rows), (self.at, at), (self.distance, d)))
        if len(self.known) > self.room:
            live, self.at = np.unique(self.at, return_inverse=True)
            self.known = self.known.take(pa.array(live))
            self.room = max(ROOM, 2 * len(live))


def _chunks(batches: Iterator) -> Iterator:
    """Rows of one chunk after another, in each first that of its requests, then blocks -> (chunk, d_hospital, asked, None) and (chunk, None, None, (donors, low, high))."""
    for batch in batches:
        number = batch.column("chunk").to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            if batch.column("asked")[i].is_valid:
                yield number[i], batch.column("d_hospital").slice(i, 1), batch.column("asked")[i].values, None
            else:
                low, high = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("low", "high"))
                yield number[i], None, None, (batch.column("donors")[i].values, low, high)


def _gathered(batches: Iterator, width: int, k: int) -> Iterator:
    """Rows as in ``_chunks`` -> what each chunk has found among all its blocks."""
    found = None
    for _, hospital, asked, block in _chunks(batches):
        if block is None:
            if found is not None:
                yield found
            found = _Found(asked, hospital, width, k)
        else:
            donors, low, high = block
            active = found.near(low, high)
            if len(active):
                found.meet(donors, active)
    if found is not None:
        yield found


def _bounds(batches: Iterator, width: int, k: int, schema: pa.Schema) -> Iterator:
    """-> source_id, role, d_hospital, kth: the k-th distance of each request among the blocks of its chunk, no row if there are fewer."""
    for f in _gathered(batches, width, k):
        known = pa.array(np.flatnonzero(f.full))
        hospital = f.hospital.take(pa.array(np.zeros(len(known), int)))
        yield pa.RecordBatch.from_arrays([f.asked.field("source_id").take(known), f.asked.field("role").take(known), hospital, pa.array(f.limit).take(known)], schema=schema)


def _rows(asked: pa.StructArray, donors: pa.StructArray, hospital: pa.Array, rows: np.ndarray, at: np.ndarray, distance: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    of, to = pa.array(rows), pa.array(at)
    columns = {"distance": lambda: pa.array(distance), "d_hospital": lambda: hospital.take(pa.array(np.zeros(len(rows), int)))}
    columns |= {c: (lambda c=c: asked.field(c).take(of)) for c in ("source_id", "role")}
    return pa.RecordBatch.from_arrays([columns[c]() if c in columns else donors.field(c).take(to) for c in schema.names], schema=schema)


def _search(batches: Iterator, width: int, k: int, schema: pa.Schema) -> Iterator:
    """-> for each request what of the donors of its chunk's blocks can be among its k nearest."""
    for f in _gathered(batches, width, k):
        if f.known is not None:
            yield _rows(f.asked, f.known, f.hospital, f.rows, f.at, f.distance, schema)


def _around_requests(batches: Iterator, width: int, schema: pa.Schema) -> Iterator:
    """-> for each request the donors of its chunk's blocks no further than ``kth``."""
    for _, hospital, asked, block in _chunks(batches):
        if block is None:
            whole, where = asked, hospital
            points, reach = _points(asked, width), _floats(asked.field("kth")) + MARGIN
            continue
        donors, low, high = block
        near = np.flatnonzero(_gaps(points, low[None, :], high[None, :])[:, 0] <= reach)
        for active in np.split(near, range(CHUNK, len(near), CHUNK)):
            distance = _apart(donors, whole.take(pa.array(active)), width)
            rows, at = np.nonzero(distance <= reach[active][:, None])
            for first in range(0, len(rows), OUT):
                part = slice(first, first + OUT)
                yield _rows(whole, donors, where, active[rows[part]], at[part], distance[rows[part], at[part]], schema)


class _Index:
    """Donors in blocks under a tree, and the joins in which chunks of requests reach them."""

    def __init__(self, asked: DataFrame, donors: DataFrame, keys: Sequence[str], features: Sequence[str], tie: Column, size: int) -> None:
        self.width, self.keys, self.cell = len(features), list(keys), [*keys, "cell"]
        self.z = [f"z{j}" for j in range(self.width)]
        columns, own = [f"d_z_{c}" for c in features], [f"s_z_{c}" for c in features]
        finite = lambda names: reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in names])  # noqa: E731  false for NaN and null, which no box could hold
        asked, donors = asked.where(finite(own)), donors.where(finite(columns))
        steps, placed = _tree(donors, keys, columns, size)
        self.levels = len(steps)
        home = asked.withColumn("cell", F.lit(0).cast("long"))
        for level, step in enumerate(steps):
            home = _down(home, step, keys, own[level % self.width])
        self.home = home.select(*self.cell, "source_id", "role", "physical_id", *[F.col(c).alias(z) for c, z in zip(own, self.z, strict=True)])
        told = [c for c in ("donor_id", "d_physical", "d_slide") if c in donors.columns]
        each = F.struct(tie.alias("tie"), *told, *[F.col(c).alias(z) for c, z in zip(columns, self.z, strict=True)])
        blocks = _parts(placed, self.cell, 2 * size, F.col("donor_id")).groupBy(*self.cell, "part").agg(*_box(columns, "low", "high"), F.sort_array(F.collect_list(each)).alias("donors"))
        self.blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
        kinds = {c: asked.schema[c].dataType.simpleString() for c in ("source_id", "role", "d_hospital")}
        kinds |= {c: donors.schema[c].dataType.simpleString() for c in told}
        self.kinds = kinds | {c: "double" for c in ("distance", "kth", "gap", *self.z)} | {"chunk": "long", "block": "long"}
        self.spread = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def above(self, up: int) -> Column:
        return F.floor(F.col("cell") / FAN**up).cast("long")

    def chunks(self, rows: DataFrame, up: int, most: int) -> DataFrame:
        """Requests with ``kth`` of a cell, ``up`` levels above their own, as rows of at most about ``most``; those without a bound apart."""
        by = [*self.cell, "free"]
        placed = _parts(rows.withColumns({"cell": self.above(up), "free": F.col("kth").isNull()}), by, most, F.struct("source_id", "role"))
        asked = F.collect_list(F.struct("source_id", "role", "physical_id", *self.z, "kth")).alias("asked")
        reach = (F.max("kth") + MARGIN).alias("reach")
        grouped = placed.groupBy(*by, "part").agg(asked, *_box(self.z, "c_low", "c_high"), reach).drop("part", "free")
        return stored(grouped.withColumn("chunk", F.monotonically_increasing_id()), "chunks")

    def size_up(self, most: int) -> int:
        """How many levels up the requests of a cell are ``most`` on average, at most."""
        counts = self.home.groupBy(*self.cell).agg(F.count("*").alias("n"))
        told = counts.agg(F.sum("n").alias("n"), *[F.count_distinct(*self.keys, self.above(up)).alias(f"c{up}") for up in range(self.levels + 1)]).first()
        return max([0, *[up for up in range(self.levels + 1) if told["n"] and told["n"] <= most * told[f"c{up}"]]])

    def reached(self, chunks: DataFrame) -> DataFrame:
        """(chunk, block, gap) of the blocks that a request of the chunk reaches."""
        visits = chunks.select("chunk", *self.keys, "c_low", "c_high", "reach", F.lit(0).cast("long").alias("cell"))
        boxes = self.blocks.select(*self.cell, "block", "low", "high")
        for level in range(1, self.levels + 1):
            below = F.floor(F.col("cell") / FAN ** (self.levels - level)).cast("long")
            inner = _around(boxes.withColumn("next", below), [*self.keys, "next"], self.width).withColumn("cell", F.floor(F.col("next") / FAN).cast("long"))
            visits = visits.join(inner, self.cell).where(_near(self.width)).select("chunk", *self.keys, "c_low", "c_high", "reach", F.col("next").alias("cell"))
        lists = visits.join(boxes, self.cell).where(_near(self.width)).groupBy("chunk").agg(F.collect_list(F.struct("block", "low", "high")).alias("boxes"))
        told, schema = self.schema("chunk", "block", "gap")
        width = self.width
        return chunks.select("chunk", "asked").join(lists, "chunk").repartition(self.spread, "chunk").mapInArrow(lambda batches: _reached(batches, width, schema), told)

    def under(self, chunks: DataFrame, up: int) -> DataFrame:
        """(chunk, block, gap) of the blocks of the chunk's own cell, ``up`` levels above the leaves."""
        return chunks.join(self.blocks.select(*self.keys, self.above(up).alias("cell"), "block"), self.cell).select("chunk", "block", F.lit(0.0).alias("gap"))

    def met(self, chunks: DataFrame, visits: DataFrame, work: Callable, *columns: str) -> DataFrame:
        """``work`` over rows of a chunk's requests, then of its blocks, nearest first, in as many tasks as shuffle partitions: they have few bytes for their work."""
        lists = dict(self.blocks.dtypes) | dict(chunks.dtypes)
        no = lambda c: F.lit(None).cast(lists[c]).alias(c)
        waiting = chunks.select("chunk", "d_hospital", F.lit(-1.0).alias("gap"), "asked", no("donors"), no("low"), no("high"))
        coming = visits.join(self.blocks.select("block", "donors", "low", "high"), "block")
        coming = coming.select("chunk", no("d_hospital"), "gap", no("asked"), "donors", "low", "high")
        told, schema = self.schema(*columns)
        return waiting.unionByName(coming).repartition(self.spread, "chunk").sortWithinPartitions("chunk", "gap").mapInArrow(lambda batches: work(batches, schema), told)

    def schema(self, *columns: str) -> tuple[str, pa.Schema]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        told = ", ".join(f"{c} {self.kinds[c]}" for c in columns)
        return told, to_arrow_schema(StructType.fromDDL(told))

    def bounded(self, k: int) -> DataFrame:
        """Requests with ``kth``, a distance within which they have k donors: of their own cell, or of the first above that has as many; null where none has."""
        request = ["source_id", "role", "d_hospital"]
        none, width = F.lit(None).cast("double").alias("kth"), self.width
        home = stored(self.home, "home") if self.levels else self.home
        open_, known = home, None
        for up in range(self.levels):
            chunks = self.chunks(open_.select("*", none), up, CHUNK)
            kth = stored(self.met(chunks, self.under(chunks, up), lambda b, s: _bounds(b, width, k, s), *request, "kth"), "kth")
            known = kth if known is None else known.unionByName(kth)
            open_ = stored(open_.join(kth, request, "left_anti"), "unbounded")
            if open_.isEmpty():
                break
        if known is None:
            return home.select("*", none)
        # a request that is there twice is told one bound
        return home.join(known.groupBy(*request).agg(F.min("kth").alias("kth")), request, "left")


def nearest(asked: DataFrame, donors: DataFrame, keys: Sequence[str], features: Sequence[str], k: int, tie: Column, size: int = SIZE) -> DataFrame:
    """For each row of ``asked`` (keys, source_id, role, physical_id, s_z_<feature>) its k nearest donors (keys, donor_id, d_physical, d_slide,
    d_z_<feature>) of the group, not of its own id or physical id, by distance and ``tie``: source_id, role, d_hospital (of the
    keys), donor columns, distance, rank. A null or non-finite feature or a null physical id is nobody's neighbour."""
    index = _Index(asked, donors, keys, features, tie, size)
    width = index.width
    chunks = index.chunks(index.bounded(k), index.size_up(CHUNK), CHUNK)
    kept = ["source_id", "role", "donor_id", "d_slide", "d_physical", "distance", *index.z, "d_hospital"]
    found = index.met(chunks, index.reached(chunks), lambda b, s: _search(b, width, k, s), *kept)
    own = Window.partitionBy("source_id", "role", "d_hospital").orderBy("distance", tie)
    # what follows a source meets it where it is
    best = found.repartition(index.spread, "source_id").withColumn("distance", F.round("distance", 9)).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return best.select("source_id", "role", "d_hospital", "donor_id", "d_slide", "d_physical", "distance", "rank", *[F.col(z).alias(f"d_z_{c}") for z, c in zip(index.z, features, strict=True)])


def within(asked: DataFrame, donors: DataFrame, keys: Sequence[str], features: Sequence[str], radius: float, tie: Column, size: int = SIZE) -> DataFrame:
    """Tables as in ``nearest`` -> source_id, role, d_hospital, donor_id, distance of all donors within the radius."""
    index = _Index(asked, donors.drop("d_slide"), keys, features, tie, size)
    width = index.width
    chunks = index.chunks(index.home.withColumn("kth", F.lit(float(radius))), index.size_up(WIDE), WIDE)
    found = index.met(chunks, index.reached(chunks), lambda b, s: _around_requests(b, width, s), "source_id", "role", "d_hospital", "donor_id", "distance")
    return found.withColumn("distance", F.round("distance", 9)).where(F.col("distance") <= radius)
