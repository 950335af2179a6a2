"""Counterfactual inputs and their scores by any frozen model (INF-1)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present, require_columns
from . import arrays

IDENTITY = ["source_split", "source_hospital", "source_slide", "source_patient", "source_physical_id", "label"]
#: A model maps a batch of images (n x pixels) to n logits. It is pickled into the tasks.
Model = Callable[[np.ndarray], np.ndarray]


def check_identities(triplets: DataFrame) -> DataFrame:
    """The triplets, raising where rows of one source differ in what describes the source."""
    columns = present(triplets, IDENTITY)
    if not columns:
        return triplets
    odd = triplets.groupBy("source_id").agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in columns])).alias("_n"))
    checked = odd.select("source_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("inconsistent metadata of source "), F.col("source_id").cast("string")))).cast("int").alias("_bad"))
    return triplets.join(checked, "source_id").where("_bad is null").drop("_bad")


def composites(triplets: DataFrame, images: DataFrame, side: int, roi: int, buffer: int = 0, feather: int = 4, roi_only: bool = False) -> DataFrame:
    """triplet columns, source, within and cross images. A donor without an image has no row."""
    require_columns(triplets, ["triplet_id", "source_id", "within_donor", "cross_donor"], "triplets")
    of = lambda key, name: images.select(F.col("source_id").alias(key), F.col("pixels").alias(name))
    j = triplets.join(of("source_id", "_s"), "source_id").join(of("within_donor", "_w"), "within_donor").join(of("cross_donor", "_c"), "cross_donor")
    arms = {"within": arrays.transplant(F.col("_s"), F.col("_w"), side, roi, buffer, feather), "cross": arrays.transplant(F.col("_s"), F.col("_c"), side, roi, buffer, feather), "source": F.col("_s")}
    if roi_only:
        arms = {k: arrays.roi_only(v, side, roi) for k, v in arms.items()}
    return j.select(*triplets.columns, *[v.alias(f"{k}_image") for k, v in arms.items()])


def construction_qa(built: DataFrame, side: int, roi: int, buffer: int = 0) -> DataFrame:
    """A row per triplet and arm: how the region compares with the source's, and the boundary jump."""
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}_image").alias("image")) for a in ("within", "cross")])).alias("a")
    rows = built.select("triplet_id", "source_image", arm).select("triplet_id", "source_image", "a.arm", "a.image")
    checks = arrays.roi_metrics(F.col("source_image"), F.col("image"), side, roi)
    return rows.select("triplet_id", "arm", *[c.alias(n) for n, c in checks.items()], arrays.boundary_jump(F.col("image"), side, roi, buffer).alias("cross_boundary_intensity_jump"))


def _scored(batches, model: Model, n_keys: int, names: list[str]):
    for batch in batches:
        out = []
        for column in batch.columns[n_keys:]:
            images = np.array(column.to_pylist(), float).reshape(batch.num_rows, -1)
            out.append(pa.array(np.asarray(model(images), float).reshape(-1), pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *out], names)


def infer(triplets: DataFrame, images: DataFrame, model: Model, side: int, roi: int, buffer: int = 0, feather: int = 4, roi_only: bool = False) -> DataFrame:
    """Triplet columns, original_logit, within_logit, cross_logit and the settings.

    Sources are scored once each, so a source's original logit is one number. A composite whose region
    differs from the source's raises. Models run in Arrow batches where the rows are.
    """
    built = composites(check_identities(triplets), images, side, roi, buffer, feather, roi_only)
    intact = arrays.roi_equal(F.col("source_image"), F.col("within_image"), side, roi) & arrays.roi_equal(F.col("source_image"), F.col("cross_image"), side, roi)
    guarded = F.when(intact, F.col("within_image")).otherwise(F.raise_error(F.concat(F.lit("region identity failed for triplet "), F.col("triplet_id"))))
    arms = built.select("triplet_id", guarded.alias("w"), F.col("cross_image").alias("c"))
    pair_schema = f"triplet_id {dict(triplets.dtypes)['triplet_id']}, within_logit double, cross_logit double"
    scored = arms.mapInArrow(lambda it: _scored(it, model, 1, ["triplet_id", "within_logit", "cross_logit"]), pair_schema)
    sources = images.join(triplets.select("source_id").distinct(), "source_id", "left_semi")
    pixels = arrays.roi_only(F.col("pixels"), side, roi) if roi_only else F.col("pixels")
    own = sources.select(F.col("source_id").cast("long").alias("source_id"), pixels.alias("p"))
    originals = own.mapInArrow(lambda it: _scored(it, model, 1, ["source_id", "original_logit"]), "source_id long, original_logit double")
    return triplets.join(originals, "source_id").join(scored, "triplet_id").withColumns({
        "source_buffer": F.lit(buffer), "feather_width": F.lit(feather), "roi_only_control": F.lit(roi_only)})
