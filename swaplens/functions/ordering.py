"""Ranks and running totals over whole tables without one task that sees all rows.

Rows are put into buckets by value, so buckets don't depend on partitions or sampling; a bucket is one
window group, and buckets meet as one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hexadecimal digits that put a hash into one of 4096 buckets.
HASH_DIGITS = 3


def hash_bucket(h: Column) -> Column:
    """Bucket of a hexadecimal hash; ascending with it, and about equally full."""
    return F.conv(F.substring(h, 1, HASH_DIGITS), 16, 10).cast("int")


def value_bucket(df: DataFrame, value: str) -> Column:
    """Bucket of a numeric column, ascending with it, nulls first: between approximate quantiles, as many
    as the session's shuffle partitions. Equal values share a bucket."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("c")).first()["c"]  # n numbers
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    bucket = F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col(value))) + 1, F.lit(0))
    # plus 0, but not deterministic to the optimizer, which else infers a filter from the lambda in which it mixes up the sides of a self join
    return bucket + F.floor(F.rand(0)).cast("int")


def before(df: DataFrame, order: Sequence[Column | str], value: Column, bucket: Column, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: the total of ``value`` over the rows before each in ``order``, which must be total,
    per group of ``by``. ``bucket`` must ascend with the order."""
    placed = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = placed.groupBy(*by, "_b").agg(F.sum("_v").alias("_t"))
    base = totals.select(*by, "_b", (F.sum("_t").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_t")).alias("_base"))
    within = F.sum("_v").over(Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = placed.withColumn("_w", F.coalesce(within, F.lit(0)))
    return summed.join(base, [*by, "_b"]).withColumn(out, F.col("_base") + F.col("_w")).drop("_b", "_v", "_w", "_base")


def ranked(df: DataFrame, order: Sequence[Column | str], bucket: Column, out: str = "_r", by: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based rank of each row in ``order``, per group of ``by``."""
    return before(df, order, F.lit(1).cast("long"), bucket, out, by)


def least_from(df: DataFrame, order: Sequence[Column | str], value: Column, bucket: Column, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: the least ``value`` among the row and those after it in ``order``, which must be total, per group of ``by``.
    ``bucket`` must ascend with the order. A group is as many windows as it has buckets; these meet as one row each."""
    placed = df.withColumn("_b", bucket).withColumn("_v", value)
    lowest = placed.groupBy(*by, "_b").agg(F.min("_v").alias("_m"))
    later = Window.partitionBy(*by).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    beyond = lowest.select(*by, "_b", F.min("_m").over(later).alias("_beyond"))
    within = F.min("_v").over(Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return placed.withColumn("_w", within).join(beyond, [*by, "_b"]).withColumn(out, F.least("_w", "_beyond")).drop("_b", "_v", "_w", "_beyond")
