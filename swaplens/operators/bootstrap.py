"""Crossed multiplier bootstrap of means, directed and equal-pair-weighted."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present

#: Rows that are weighed at once, and bytes of multipliers that a task keeps.
ROWS, KEPT = 256, 64 << 20


class _Multipliers:
    """Exponential multipliers of identities, an array of draws each: those of (seed, draw, identity), the same in every role and
    task. As many are kept as the bound on bytes allows."""

    def __init__(self, draws: int, seed: int):
        self.told = [f"{seed}|{draw}" for draw in range(draws)]
        self.most = max(ROWS, KEPT // (8 * draws))
        self.known: dict[str | None, np.ndarray] = {}

    def of(self, identity: str | None) -> np.ndarray:
        if identity not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            tail = "" if identity is None else f"|{identity}"
            digits = b"".join(hashlib.md5((t + tail).encode()).digest()[:6] for t in self.told)
            whole = np.frombuffer(digits, np.uint8).reshape(-1, 6).astype(np.int64) @ (1 << np.arange(40, -1, -8, dtype=np.int64))
            self.known[identity] = -np.log((whole + 0.5) / float(1 << 48))
        return self.known[identity]

    def rows(self, identities: pa.Array) -> np.ndarray:
        encoded = identities.dictionary_encode()
        unlike = [self.of(i) for i in encoded.dictionary.to_pylist()]
        index = encoded.indices.to_numpy(zero_copy_only=False) if not encoded.null_count else encoded.indices.fill_null(len(unlike)).to_numpy(zero_copy_only=False)
        return np.stack([*unlike, *([self.of(None)] if encoded.null_count else [])])[index]


def weighted_sums(cells: DataFrame, roles: Sequence[str], by: Sequence[str], values: Sequence[str], draws: int, seed: int) -> DataFrame:
    """One row per group of ``by`` and draw: the sum of each value, null as 0, weighted by the product over roles of exponential
    multipliers that belong to (seed, draw, identity). Missing identities count as one.

    A task multiplies blocks of rows by their draws as matrices and passes on one array of draws for each group that it
    meets; these are added up element by element. So what is shuffled depends on tasks and groups, not on rows times draws."""
    by, roles = list(by), list(dict.fromkeys(roles))
    names = [f"_role{i}" for i in range(len(roles))]
    plain = cells.select(*by, *[F.col(r).cast("string").alias(n) for r, n in zip(roles, names, strict=True)], *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    kinds = dict(plain.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], *[f"{v} array<double>" for v in values]])

    def weigh(batches):
        multipliers, at, total, head = _Multipliers(draws, seed), None, None, None

        def told():
            return pa.RecordBatch.from_arrays([*head, *[pa.array([t], pa.list_(pa.float64())) for t in total]], names=[*by, *values])

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                weights = reduce(lambda a, b: a * b, [multipliers.rows(part.column(n)) for n in names])
                numbers = np.stack([part.column(v).to_numpy(zero_copy_only=False) for v in values])
                groups = list(zip(*[part.column(c).to_pylist() for c in by], strict=True)) if by else [()] * part.num_rows
                edges = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if total is not None and groups[lo] != at:
                        yield told()
                        total = None
                    if total is None:
                        at, total, head = groups[lo], np.zeros((len(values), draws)), [part.column(c).slice(lo, 1) for c in by]
                    total += numbers[:, lo:hi] @ weights[lo:hi]
        if total is not None:
            yield told()

    sums = plain.sortWithinPartitions(*by, *names).mapInArrow(weigh, schema)
    each = sums.select(*by, F.posexplode(F.arrays_zip(*values)).alias("draw", "_v"))
    return each.groupBy(*by, "draw").agg(*[F.sum(F.col("_v")[v]).alias(v) for v in values])


def draw_means(pairs: DataFrame, value: str, roles: Sequence[str], by: Sequence[str], draws: int, seed: int) -> DataFrame:
    """One row per group and draw: the mean weighted by the product over roles of exponential
    multipliers, see ``weighted_sums``. Pairs of the same identities are added up first, so the draws weigh
    the distinct identities of a group and not its pairs."""
    keys = list(dict.fromkeys([*by, *roles]))
    cells = pairs.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    return weighted_sums(cells, roles, by, ["_s", "_n"], draws, seed).select(*by, "draw", (F.col("_s") / F.col("_n")).alias("estimate"))


def _interval(df: DataFrame, by: Sequence[str], confidence: float) -> DataFrame:
    a = (1 - confidence) / 2
    q = F.percentile("estimate", F.array(F.lit(a), F.lit(1 - a)))
    return df.groupBy(*by).agg(q.alias("q"), F.stddev_samp("estimate").alias("standard_error"), F.count("*").alias("draws")).select(
        *by, "draws", F.get("q", F.lit(0)).alias("ci_lower"), F.get("q", F.lit(1)).alias("ci_upper"), "standard_error")


def crossed(pairs: DataFrame, value: str, roles: Sequence[str], by: Sequence[str], draws: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """BST-1: estimate and percentile interval of the mean in each group."""
    points = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("estimate"))
    ci = _interval(draw_means(pairs, value, roles, by, draws, seed), by, confidence)
    return points.join(ci, list(by)).withColumn("status", F.lit("available")) if by else points.crossJoin(ci).withColumn("status", F.lit("available"))


def grouped(pairs: DataFrame, value: str, roles: Sequence[str], groups: Sequence[str], by: Sequence[str] = (), draws: int = 2000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """BST-2: groups (directed pairs) weigh equally; the same draws serve all of them."""
    inner = draw_means(pairs, value, roles, [*by, *groups], draws, seed)
    ci = _interval(inner.groupBy(*by, "draw").agg(F.avg("estimate").alias("estimate")), by, confidence)
    means = pairs.groupBy(*by, *groups).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    points = means.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"), F.avg("m").alias("estimate"))
    j = points.join(ci, list(by)) if by else points.crossJoin(ci)
    return j.withColumn("status", F.lit("available"))


def audit_intervals(pairs: DataFrame, expected: Sequence[tuple[int, int]] | None, draws: int, seed: int = 42, run_keys: Sequence[str] = ("source_split",)) -> DataFrame:
    """BST-3: global intervals of both metrics, over all pairs and in common support; unavailable
    where the directed pairs are not the expected ones. Draws are made once: both metrics and both
    populations are sums over the same weights."""
    roles = [c for c in ("source_physical_id", "within_physical_id", "cross_physical_id") if c in pairs.columns] or ["source_id"]
    groups, kinds, metrics = ["source_hospital", "target_hospital"], ("pair_weighted", "common_support"), ("hcs", "hce")
    inside = {"pair_weighted": F.lit(True), "common_support": F.col("common_support") if "common_support" in pairs.columns else F.lit(True)}
    pairs = pairs.select(*run_keys, *groups, *dict.fromkeys(roles), *[f"{m}_pair" for m in metrics], *present(pairs, ["common_support"]))
    part = lambda k, x: F.sum(F.when(inside[k], x))
    cells = pairs.groupBy(*run_keys, *groups, *dict.fromkeys(roles)).agg(
        *[part(k, F.lit(1)).alias(f"n_{k}") for k in kinds], *[part(k, F.col(f"{m}_pair")).alias(f"s_{m}_{k}") for k in kinds for m in metrics])
    values = [*[f"n_{k}" for k in kinds], *[f"s_{m}_{k}" for k in kinds for m in metrics]]
    sums = weighted_sums(cells, roles, [*run_keys, *groups], values, draws, seed)
    item = F.explode(F.array(*[F.struct(F.lit(k).alias("summary_type"), F.lit(m).alias("metric"), F.try_divide(F.col(f"s_{m}_{k}"), F.col(f"n_{k}")).alias("e")) for k in kinds for m in metrics])).alias("i")
    by = [*run_keys, "summary_type", "metric"]
    each = sums.select(*run_keys, *groups, "draw", item).select(*run_keys, *groups, "draw", "i.*")
    ci = _interval(each.groupBy(*by, "draw").agg(F.avg("e").alias("estimate")), by, 0.95)
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("summary_type"), F.lit(m).alias("metric"), inside[k].alias("ok"), F.col(f"{m}_pair").alias("v")) for k in kinds for m in metrics])).alias("i")
    means = pairs.select(*run_keys, *groups, told).select(*run_keys, *groups, "i.*").where("ok").groupBy(*by, *groups).agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    want = F.array(*[F.lit(x) for x in sorted(f"{s}>{t}" for s, t in expected or ())]).cast("array<string>")
    points = means.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_groups"), F.avg("m").alias("estimate"), F.array_sort(F.collect_set(F.concat_ws(">", *groups))).alias("_seen"))  # few pairs
    fits = F.lit(True) if expected is None else F.col("_seen") == want
    all_runs = pairs.select(*run_keys).distinct().select(*run_keys, F.explode(F.array(*[F.struct(F.lit(k).alias("summary_type"), F.lit(m).alias("metric")) for k in kinds for m in metrics])).alias("i"))
    good = points.where(fits).drop("_seen").join(ci, by)
    return all_runs.select(*run_keys, "i.*").join(good, by, "left").withColumn("status", F.when(F.col("estimate").isNull(), "unavailable").otherwise("available"))


def seed_estimates(points: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """BST-4: n_seeds, mean, std; std is 0 for one seed; null if any value is missing or not finite."""
    x = F.col(value)
    bad = F.coalesce(F.bool_or(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return points.groupBy(*by).agg(
        F.count("*").alias("n_seeds"), F.when(~bad, F.avg(x)).alias("mean"),
        F.when(~bad, F.when(F.count("*") > 1, F.stddev_samp(x)).otherwise(0.0)).alias("std"))
