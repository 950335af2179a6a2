"""Pair metrics and directed means over a stream of predictions.

An extension: pair metrics need one row at a time and directed means are sums and counts, so the batch
definitions carry over. The normalizer is a small static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import donor_pair_metrics


def stream_pair_metrics(predictions: DataFrame, normalizer: DataFrame) -> DataFrame:
    """MET-1 on a stream: stateless."""
    return donor_pair_metrics(predictions, normalizer)


def stream_directed(pairs: DataFrame, time: str | None = None, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Means per directed pair, over all so far (update or complete mode) or per event-time window
    (append mode: a window is final once the watermark passes it; later rows are dropped)."""
    keys = [F.col(c) for c in ("source_split", "source_hospital", "target_hospital")]
    if time:
        pairs, keys = pairs.withWatermark(time, late), [F.window(time, window).alias("window"), *keys]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg("hcs_pair").alias("hcs"), F.avg("hce_pair").alias("hce"))
