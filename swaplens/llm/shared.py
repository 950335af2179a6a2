"""Helpers that several operators use: shared-folder tables and value ranges of a key."""

from __future__ import annotations

import ctypes
import json
import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType
from pyspark.sql.window import Window


#: Folders chosen where the session names none, by application.
_CHOSEN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and Spark runs in this one process a temporary folder is chosen, once for each
    application; on a cluster executors couldn't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        # the setting can't be changed in a running session
        if context.applicationId not in _CHOSEN:
            _CHOSEN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="swaplens-shared-")
        root = _CHOSEN[context.applicationId]
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, and a
    lost executor costs a re-read, never a recomputation. Zstandard keeps its buffers in a pool,
    where Snappy takes new ones outside the heap for each of many small files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/swaplens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where a column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def content_key(df: DataFrame) -> list[Column]:
    """Two longs, 128 bits, from all columns of a row: the row's own key, the same in every scan and
    every rerun. Rows share it only if they agree in all columns, and so can stand for one another."""
    nulls = [F.col(f"`{f.name}`").isNull() for f in df.schema.fields]
    plain = [_told(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return [F.xxhash64(F.lit(salt), *nulls, *plain) for salt in (1, 2)]


def _told(c: Column, kind: DataType) -> Column:
    """The value for a hash: a hash passes over nulls, so within arrays and structs each value is told with whether it is there; maps,
    which can't be hashed, become their entries in order of the keys' own text."""
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: F.struct(x.isNull().alias("n"), _told(x, kind.elementType).alias("v")))
    if isinstance(kind, StructType):
        return F.struct(*[F.struct(c[f.name].isNull().alias("n"), _told(c[f.name], f.dataType).alias("v")).alias(f"f{i}") for i, f in enumerate(kind.fields)]) if kind.fields else c
    if isinstance(kind, MapType):
        entry = lambda e: F.struct(_told(e["key"], kind.keyType).alias("k"), e["value"].isNull().alias("n"), _told(e["value"], kind.valueType).alias("v"))
        return F.transform(F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"].cast("string") < b["key"].cast("string"), -1).when(a["key"].cast("string") > b["key"].cast("string"), 1).otherwise(0)), entry)
    return c


def repeated(df: DataFrame, times: str, *, block: int = 1024) -> DataFrame:
    """Each row as often as the column ``times`` says, which goes; dealt anew between two steps, so that
    a row with very many copies is spread over tasks."""
    few, many = df.where(F.col(times) <= block), df.where(F.col(times) > block)
    (part,) = fresh(df, "part")
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / block))
    many = many.withColumn(part, F.explode(starts)).repartition(part).withColumn(times, F.least(F.lit(block), F.col(times) - F.col(part) * block)).drop(part)
    one = few.unionByName(many)
    return one.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).drop(times)


#: Bytes of an Arrow batch that a worker gets at once, at most (a longer row is a batch of its own).
BATCH = 4 << 20


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches bounded by bytes, not only by rows; workers give memory back between them.

    Spark reads the bound from the session when the plan runs, so it is lowered there where it is larger, and stays so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(df.sparkSession.conf.get(name)) > BATCH:
        df.sparkSession.conf.set(name, f"{BATCH}b")

    def run(batches):
        for number, batch in enumerate(work(batches)):
            yield batch
            if number % 8 == 7:
                give_back()

    return df.mapInArrow(run, schema)


def _bytes(setting: str) -> int:
    """Bytes of a size as Spark's settings write it: a number, with b, k, m, g, t or p, and b after that."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)(?:i?b)?", setting.strip().lower()).groups()
    return int(number) << 10 * "_kmgtp".index(unit or "_")


def give_back() -> None:
    """Return freed memory of this process to the system, where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_env() -> None:
    """Python workers are Spark's unit of parallelism; libraries start no threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


#: Ranges that a table is cut into, at most: a sorted range is read as a stream, so it may be large.
MOST_RANGES = 10_000
#: Rows of the sample that bounds are taken from, for each range.
SAMPLED = 20


def range_bounds(df: DataFrame, key: str, tie: str, n: int) -> list[tuple]:
    """At most ``n`` ascending (key, tie) that cut the rows, nulls first, into ranges of about equal counts. The first is the least; all
    occur. They come from a sample by the hash of both, bounded by ``SAMPLED`` rows a range, so a key that very many
    rows share is cut by its ties too."""
    place = F.struct(F.col(key).cast("long").alias("k"), F.col(tie).cast("long").alias("t"))
    told = df.agg(F.count("*").alias("n"), F.min(place).alias("least")).first()
    if not told["n"]:
        return []
    every = max(1, told["n"] // (SAMPLED * n))
    some = df.where(F.pmod(F.xxhash64(F.lit(9), key, tie), F.lit(every)) == 0).select(place.alias("p"), F.xxhash64(F.lit(8), key, tie).alias("h"))
    rows = sorted(((r["p"]["k"], r["p"]["t"]) for r in some.orderBy("h").limit(2 * SAMPLED * n).collect()), key=_nulls_first)
    cuts = [rows[len(rows) * i // n] for i in range(1, n)] if rows else []
    return sorted({tuple(told["least"]), *cuts}, key=_nulls_first)


def _nulls_first(pair: tuple) -> tuple:
    return tuple((x is not None, x or 0) for x in pair)


def range_index(key: Column, tie: Column, bounds: list[tuple]) -> tuple[Column, Column]:
    """(How many bounds are <= (key, tie), the last of those): two short scans of about sqrt(len) values. The bounds are
    one literal each for both scans, however many they are."""
    kind = "struct<k:bigint,t:bigint>"
    step = max(1, math.isqrt(len(bounds)))
    told = lambda rows: "[" + ",".join(f'{{"k":{json.dumps(k)},"t":{json.dumps(t)}}}' for k, t in rows) + "]"
    coarse = F.from_json(F.lit(told(bounds[::step])), f"array<{kind}>")
    fine = F.from_json(F.lit("[" + ",".join(told(bounds[i : i + step]) for i in range(0, len(bounds), step)) + "]"), f"array<array<{kind}>>")
    here = F.struct(key.cast("long").alias("k"), tie.cast("long").alias("t"))
    c = F.size(F.filter(coarse, lambda b: b <= here))
    part = F.coalesce(F.get(fine, c - 1), F.array().cast(f"array<{kind}>"))
    d = F.size(F.filter(part, lambda b: b <= here))
    return F.greatest(c - 1, F.lit(0)) * step + d, F.get(part, d - 1)


def with_next(df: DataFrame, key: str, tie: str, take: list[str], n: int) -> DataFrame:
    """Add ``next_<c>`` for each column of ``take``: its value in the next row by (key, tie),
    nulls first; after the last row comes the first.

    The rows are dealt into ``n`` ranges of (key, tie), each sorted in one task. The first row of a
    range is also dealt, as a sentinel, to the range before it (and the very first row to the
    last range), so one exchange is enough and no task sees more than its range.
    """
    bounds = range_bounds(df, key, tie, n)
    last = len(bounds)
    here, bound = range_index(F.col(key), F.col(tie), bounds)
    is_start = F.coalesce(F.col("_b") == F.struct(F.col(key).cast("long").alias("k"), F.col(tie).cast("long").alias("t")), F.lit(False))
    place = lambda r, s: F.struct(F.lit(r).cast("int").alias("r") if isinstance(r, int) else r.cast("int").alias("r"), F.lit(s).alias("s"))
    none = F.lit(None).cast("struct<r:int,s:int>")
    copies = F.array(
        place(F.col("_r"), 0),
        F.when(is_start & (F.col("_r") > 1), place(F.col("_r") - 1, 1)).otherwise(none),
        F.when(is_start & (F.col("_r") == 1), place(last, 2)).otherwise(none),
    )
    dealt = (
        df.withColumns({"_r": here, "_b": bound})
        .withColumn("_p", F.explode(F.filter(copies, lambda x: x.isNotNull())))
        .withColumn("_r", F.col("_p.r"))
        .withColumn("_s", F.col("_p.s"))
        .drop("_p", "_b")
    )
    # a range is a task of its own
    dealt = dealt.repartitionById(last + 1, F.col("_r"))
    w = Window.partitionBy("_r").orderBy("_s", F.col(key).asc_nulls_first(), tie)
    return (
        dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in take})
        .where(F.col("_s") == 0)
        .drop("_r", "_s")
    )


def ranges_wanted(df: DataFrame, text: str, most_bytes: int = 16 << 20) -> int:
    """Ranges to cut a table into, so that one has about ``most_bytes`` of the column ``text``; as many as
    shuffle partitions at least, or ``MOST_RANGES`` at most."""
    total = df.agg(F.sum(F.octet_length(text).cast("long")).alias("b")).first()["b"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-total // most_bytes)))
