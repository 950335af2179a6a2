"""Standardization and distances of descriptors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import euclidean, require_columns
from ..functions.ordering import ranked
from ..functions.stored import stored


def fit_standardizer(df: DataFrame, features: Sequence[str], split: str = "train") -> DataFrame:
    """STD-1/3: feature, mean, scale (population deviation) over one split; raises on values that
    are not finite. One row a feature; a lazy table, so it is broadcast rather than collected."""
    require_columns(df, [*features, "split"], "descriptors")
    checked = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c))
    one = df.where(F.col("split") == split).agg(*[
        F.struct(F.lit(c).alias("feature"), F.avg(checked(c)).alias("mean"), F.stddev_pop(checked(c)).alias("scale")).alias(c) for c in features
    ])
    return one.select(F.explode(F.array(*[F.col(c) for c in features])).alias("f")).select("f.*")


def validated(standardizer: DataFrame, features: Sequence[str]) -> DataFrame:
    """STD-3: a standardizer that was read or handed over, held to one finite mean and one finite scale of 0 or more for each of the
    features, and to these features alone; else raises. A row a feature, so it is checked in one group."""
    require_columns(standardizer, ["feature", "mean", "scale"], "standardizer")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = Window.partitionBy()
    fault = (
        F.when(~F.coalesce(F.col("feature").isin(*features), F.lit(False)), F.concat(F.lit("standardizer has an unknown feature: "), F.coalesce("feature", F.lit("null"))))
        .when(F.count("*").over(Window.partitionBy("feature")) > 1, F.concat(F.lit("standardizer repeats the feature "), F.col("feature")))
        .when(F.count("*").over(whole) != len(set(features)), F.lit("standardizer lacks features"))
        .when(~finite("mean") | ~finite("scale") | (F.col("scale") < 0), F.concat(F.lit("standardizer has an invalid mean or scale of "), F.col("feature"))))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("scale"))
    return standardizer.withColumn("_scale", checked).select("feature", "mean", F.col("_scale").alias("scale"))


def transform(df: DataFrame, standardizer: DataFrame, features: Sequence[str], digits: int = 9) -> DataFrame:
    """STD-2, DST-3: z_<feature> = (x - mean) / scale, with 1 for a scale of 0. The standardizer
    is pivoted into one row and joined to all."""
    wide = standardizer.agg(*[F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(f"_s_{c}") for c in features])
    z = {
        f"z_{c}": F.round((F.col(c) - F.col(f"_s_{c}.mean")) / F.when(F.col(f"_s_{c}.scale") == 0, 1.0).otherwise(F.col(f"_s_{c}.scale")), digits)
        for c in features
    }
    return df.crossJoin(F.broadcast(wide)).withColumns(z).drop(*[f"_s_{c}" for c in features])


def z_columns(features: Sequence[str], prefix: str = "") -> list:
    return [F.col(f"{prefix}z_{c}") for c in features]


#: Rows of a group in one block, at most.
PART = 2048


def _blocks(rows: DataFrame, keys: Sequence[str], features: Sequence[str], key: str, number: str, out: str) -> DataFrame:
    """The rows of each group in blocks of ``PART``, each one row: keys, number of the block, rows in order of the vector. Equal vectors lie next to
    each other, however many blocks they fill."""
    z, side = z_columns(features), key[0]  # s or d
    placed = ranked(rows.withColumn("_h", F.xxhash64(*z)), ["_h", key], F.shiftright("_h", 52), "_place", keys)
    one = F.struct(*[F.col(f"z_{c}").alias(f"{side}_z_{c}") for c in features], key)
    return stored(placed.groupBy(*keys, F.floor(F.col("_place") / PART).cast("int").alias(number)).agg(F.sort_array(F.collect_list(one)).alias(out)), "blocks")


def pair_distances(sources: DataFrame, candidates: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """DST-1: each source with each candidate that agrees in ``keys``: source_id, donor_id, distance. The sources of a large group are cut into
    blocks, each of which meets all candidates of the group, so that a group is many tasks, and what a candidate meets at once is one block.
    Candidates with equal vectors come one after another: written out, all columns repeat at short distance and take few bytes."""
    s = sources.select("source_id", *keys, *[f"z_{c}" for c in features])
    d = candidates.withColumnRenamed("source_id", "donor_id").join(s.select(*keys).distinct(), list(keys), "left_semi").select("donor_id", *keys, *[f"z_{c}" for c in features])
    own, others = _blocks(s, keys, features, "source_id", "_part", "_own"), _blocks(d, keys, features, "donor_id", "_block", "_others")
    spread, by = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "_part"]
    parts = own.groupBy(*keys).agg(F.count("*").cast("int").alias("_parts"))
    d = others.join(parts, list(keys)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).repartition(spread, *by).select(*by, F.inline("_others"))
    met = d.join(own.repartition(spread, *by).hint("merge"), by)  # files of blocks look small enough to be broadcast, but aren't
    pairs = met.select("donor_id", *[f"d_z_{c}" for c in features], F.inline("_own"))
    return pairs.select("source_id", "donor_id", euclidean(z_columns(features, "s_"), z_columns(features, "d_")).alias("distance"))
