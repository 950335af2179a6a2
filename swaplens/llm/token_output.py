"""Token ids as Parquet list columns, in ascending document order, and their way back."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokenizing, word_encoding
from .shared import map_arrow, range_bounds, range_index, ranges_wanted, shared_dir

END = 0
#: Bytes of a row group and of a page; a page index is written, so ids of few documents and
#: metadata of all are read without the rest.
ROW_GROUP, PAGE = 32 << 20, 1 << 20
CHUNK, OVERLAP = 1 << 15, 256
#: Parts up to which their totals are broadcast; beyond, they are joined by shuffling.
BROADCAST_PARTS = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(batches, path: str, chunk: int, overlap: int):
    encoder = word_encoding.load(path)
    last, ordinal = None, 0
    for batch in batches:
        for a, length in tokenizing.slices(batch.column(2)):
            part = batch.slice(a, length)
            ids, n = encoder.encode(part.column(2), chunk, overlap)
            ids = np.insert(ids, np.cumsum(n), END).astype("<u4")
            n = n + 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.view("<i4")))
            # documents of a part come in order and none of another part between them
            of = part.column(0).to_numpy()
            new = np.flatnonzero(np.diff(of, prepend=-1 if last is None else last))
            place = np.arange(length)
            count = place - np.repeat(np.concatenate([[0], new]), np.diff(np.concatenate([[0], new, [length]])))
            count[: new[0] if len(new) else length] += ordinal
            last, ordinal = of[-1], int(count[-1]) + 1
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), part.column(1), pa.array(n), lists], ["part", "ordinal", "doc_id", "n_tokens", "ids"])


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> None:
    """Write (part, ordinal, doc_id, n_tokens, ids) to ``path``: each part one file or more of one range of
    doc_id (and, where very many rows share one, of a hash of their texts), ascending within and across parts; ordinal counts the documents of a part from 0.

    Texts, which are shorter than their ids, are dealt by range before they are encoded, so
    nothing is shuffled afterwards. Ids are a list column, dictionary-encoded, in row groups and
    pages of set size with a page index.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    bounds = range_bounds(rows, "doc_id", "tie", ranges_wanted(rows, "text"))
    part = range_index(F.col("doc_id"), F.col("tie"), bounds)[0].cast("int") if bounds else F.lit(0)
    dealt = rows.select(part.alias("part"), "doc_id", "text", "tie").repartitionById(len(bounds) + 1, F.col("part"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").drop("tie")
    (
        dealt.transform(map_arrow, lambda it: _encode(it, tokenizer, chunk, overlap), "part int, ordinal long, doc_id long, n_tokens long, ids array<int>")
        .write.option("compression", "zstd").option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(ROW_GROUP)).option("parquet.page.size", str(PAGE))
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """part, ordinal, doc_id, n_tokens, ids of the chosen documents. Files and row groups are in order of
    doc_id and pages have an index, so Spark's reader passes over all others by their bounds."""
    return spark.read.parquet(path).where(F.col("doc_id").isin([int(d) for d in doc_ids])).orderBy("part", "ordinal")


def _crc(batches):
    for batch in batches:
        lists = batch.column(4)
        flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], ["part", "ordinal", "doc_id", "n_tokens", "ids_crc32"])


def _small(df: DataFrame) -> DataFrame:
    """One row a part: marked for broadcast up to ``BROADCAST_PARTS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS else df


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files.

    Totals of the parts come from a read of the metadata columns alone; they are one row a part, which one
    window adds up. Starts run within a part, in the order of the file.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    base = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))
    sums = files.select("part", "ordinal", "doc_id", "n_tokens", "ids").transform(map_arrow, _crc, "part int, ordinal long, doc_id long, n_tokens long, ids_crc32 long")
    within = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return sums.join(_small(base), "part").select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, **kwargs) -> DataFrame:
    """Write the token file of ``docs`` to the shared folder and summarise it from there: doc_id,
    start (ids of all documents before it), n_tokens (with the end id), ids_crc32.

    Null texts count as empty and have the end id alone; null doc_ids come first; rows that share
    a doc_id stay, in order of a hash of their texts; an empty table gives an empty file.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/swaplens-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, **kwargs)
    return read_summaries(spark, path)
