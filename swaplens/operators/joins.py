"""Joins that hold both sides to one row a key and tell what they leave out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import require_columns


def _once(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Rows as they are; a key that is null or occurs twice raises. The count is made where the join deals rows to anyway."""
    name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    seen = F.count("*").over(Window.partitionBy(*keys))
    fault = F.when(~known, F.concat(F.lit(f"{side}: a key is null: "), name)).when(F.col("_seen") > 1, F.concat(F.lit(f"{side}: a key is not unique: "), name))
    return df.withColumn("_seen", seen).withColumn("_ok", F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True))).drop("_seen")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], missing: str = "drop") -> DataFrame:
    """JOIN-2: the inner join of tables of which each has a key once at most. A key that is null or repeated on either side
    raises; so does one that the other side lacks if ``missing`` is ``raise``, while ``drop`` leaves it out (see ``unmatched``).

    Both checks ride on the join's own shuffle: the counts are windows over its keys."""
    if missing not in ("drop", "raise"):
        raise ValueError("missing must be drop or raise")
    keys = list(keys)
    for df, side in ((left, "left"), (right, "right")):
        require_columns(df, keys, side)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have columns: {sorted(clash)}")
    a = _once(left, keys, "left").withColumnRenamed("_ok", "_left")
    b = _once(right, keys, "right").withColumnRenamed("_ok", "_right")
    both = F.coalesce(F.col("_left") & F.col("_right"), F.lit(False))
    joined = a.join(b, keys, "full")
    if missing == "raise":
        name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        lacking = F.when(F.col("_left").isNull(), F.lit("left")).otherwise(F.lit("right"))
        both = F.when(both, F.lit(True)).otherwise(F.raise_error(F.concat(lacking, F.lit(" lacks the key "), name)).cast("boolean"))
    return joined.where(both).drop("_left", "_right")


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN-2: keys that only one side has: the key columns and ``missing_side``. Cardinalities are checked as in ``one_to_one``."""
    keys = list(keys)
    a = _once(left.select(*keys), keys, "left").withColumnRenamed("_ok", "_left")
    b = _once(right.select(*keys), keys, "right").withColumnRenamed("_ok", "_right")
    side: Column = F.when(F.col("_left").isNull(), "left").when(F.col("_right").isNull(), "right")
    return a.join(b, keys, "full").withColumn("missing_side", side).where("missing_side IS NOT NULL").select(*keys, "missing_side")
