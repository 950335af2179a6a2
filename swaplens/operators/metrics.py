"""Normalized paired metrics: excess instability (HCS) and signed shift (HCE), and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present, require_columns
from ..functions.ordering import before, least_from, ranked, value_bucket

KEYS = ["source_id", "source_split", "source_hospital", "target_hospital"]
RUN = ["source_split", "seed", "backbone"]
LOGITS = ["original_logit", "within_logit", "cross_logit"]


def fit_normalizer(logits: DataFrame, column: str = "logit", q_min: float = 1e-3, by: Sequence[str] = ()) -> DataFrame:
    """NRM-1: median and max(interquartile range, q_min), exact and linear between values; per group
    of ``by``. Raises on values that are not finite and on an empty table."""
    x = F.col(column)
    checked = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("logits must be finite"))).otherwise(x)
    g = logits.withColumn("_x", checked).groupBy(*by).agg(F.percentile("_x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    g = g.withColumn("q", F.when(F.col("q").isNull(), F.raise_error(F.lit("no logits to normalize by"))).otherwise(F.col("q")))
    return g.select(*by, F.get("q", F.lit(1)).alias("median"), F.greatest(F.get("q", F.lit(2)) - F.get("q", F.lit(0)), F.lit(q_min)).alias("scale"))


def normalize(df: DataFrame, normalizer: DataFrame, columns: Sequence[str] = LOGITS, by: Sequence[str] = ()) -> DataFrame:
    """NRM-2: normalized_<column> = (x - median) / scale; without ``by`` the normalizer is one row."""
    n = normalizer.withColumnsRenamed({"median": "_median", "scale": "_scale"})
    j = df.join(n, list(by)) if by else df.crossJoin(F.broadcast(n))  # one row
    return j.withColumns({f"normalized_{c}": (F.col(c) - F.col("_median")) / F.col("_scale") for c in columns}).drop("_median", "_scale")


def donor_pair_metrics(predictions: DataFrame, normalizer: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MET-1: changes of each donor pair; nothing is clipped."""
    require_columns(predictions, [*KEYS, *LOGITS], "predictions")
    o, w, c = (F.col(f"normalized_{x}") for x in LOGITS)
    return normalize(predictions, normalizer, by=by).withColumns({
        "absolute_within_change": F.abs(w - o), "absolute_cross_change": F.abs(c - o), "hcs_pair": F.abs(c - o) - F.abs(w - o),
        "within_signed_shift_pair": w - o, "cross_signed_shift_pair": c - o, "hce_pair": c - w})


def source_metrics(pairs: DataFrame) -> DataFrame:
    """MET-2: one row per source and target. Passed-through columns are part of the key, on which
    they depend; an original logit that varies raises."""
    extra = present(pairs, ["source_slide", "source_patient", "source_physical_id", "label", "seed", "backbone", "setting", "common_support"])
    o = F.col("normalized_original_logit")
    g = pairs.groupBy(*KEYS, *extra).agg(
        F.count("*").alias("n_donor_pairs"), F.min(o).alias("normalized_original_logit"), F.max(o).alias("_hi"),
        F.avg("absolute_within_change").alias("delta_within"), F.avg("absolute_cross_change").alias("delta_cross"),
        F.avg("normalized_within_logit").alias("_w"), F.avg("normalized_cross_logit").alias("_c"))
    same = F.when(F.col("_hi") != F.col("normalized_original_logit"), F.raise_error(F.lit("original logit varies within a source")).cast("double")).otherwise(F.col("normalized_original_logit"))
    return g.select(
        *KEYS, *extra, "n_donor_pairs", same.alias("normalized_original_logit"), "delta_within", "delta_cross", (F.col("delta_cross") - F.col("delta_within")).alias("hcs_source"),
        (F.col("_w") - F.col("normalized_original_logit")).alias("within_signed_shift"), (F.col("_c") - F.col("normalized_original_logit")).alias("cross_signed_shift"),
        (F.col("_c") - F.col("_w")).alias("hce_source"))


def pairs_with_sources(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """JOIN-1: source metrics on each pair; more than one source row for a pair raises."""
    keys = [*KEYS, *present(pairs, ["seed", "backbone", "setting"])]
    once = sources.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in ("delta_within", "delta_cross", "hcs_source", "hce_source")])
    checked = once.withColumn("hcs_source", F.when(F.col("_n") > 1, F.raise_error(F.lit("source metrics are not unique")).cast("double")).otherwise(F.col("hcs_source"))).drop("_n")
    return pairs.join(checked, keys, "left")


def directed(sources: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """HCS-1, HCE-1, ROB-1: means per directed pair, and per the columns of ``keys`` too."""
    by = [*present(sources, [*RUN, "source_hospital", "target_hospital"]), *keys]
    return sources.groupBy(*by).agg(
        F.count_distinct("source_id").alias("n_sources"), F.avg("delta_within").alias("delta_within"), F.avg("delta_cross").alias("delta_cross"),
        F.avg("hcs_source").alias("hcs"), F.avg("within_signed_shift").alias("within_signed_shift"), F.avg("cross_signed_shift").alias("cross_signed_shift"),
        F.avg("hce_source").alias("hce"))


def _pairs(expected: Sequence[tuple[int, int]]):
    if not expected:
        return F.array().cast("array<struct<s:int,t:int>>")
    return F.array_sort(F.array(*[F.struct(F.lit(s).cast("int").alias("s"), F.lit(t).cast("int").alias("t")) for s, t in expected]))


def pair_weighted(directed_table: DataFrame, metric: str, expected: Sequence[tuple[int, int]] | None) -> DataFrame:
    """HCS-2, HCE-2: the mean over directed pairs, only where exactly the expected pairs are there.

    ``expected`` None: whatever is there counts; empty: any pair is unexpected."""
    by = present(directed_table, RUN)
    seen = F.array_sort(F.collect_set(F.struct(F.col("source_hospital").cast("int").alias("s"), F.col("target_hospital").cast("int").alias("t"))))  # few pairs
    want = _pairs(expected or ())
    g = directed_table.groupBy(*by).agg(seen.alias("_seen"), F.avg(metric).alias("_mean"))
    g = g.withColumn("missing_pairs", F.array_except(want, "_seen")).withColumn(
        "unexpected_pairs", F.array_except("_seen", want) if expected is not None else F.array().cast("array<struct<s:int,t:int>>"))
    ok = F.lit(True) if expected is None else (F.size("missing_pairs") == 0) & (F.size("unexpected_pairs") == 0)
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(">", p["s"].cast("string"), p["t"].cast("string"))), ";")
    return g.select(*by, F.when(ok, "available").otherwise("unavailable").alias("status"), F.when(ok, F.col("_mean")).alias(f"{metric}_pair_weighted"),
                    F.size("_seen").alias("n_pairs"), text("missing_pairs").alias("missing_pairs"), text("unexpected_pairs").alias("unexpected_pairs"))


def _targets_of(pairs: str, hospital: int):
    return F.array_sort(F.transform(F.filter(pairs, lambda p: p["s"] == hospital), lambda p: p["t"]))


def common_support(sources: DataFrame, metric: str, expected: dict[int, set[int]] | None) -> DataFrame:
    """HCS-3, HCE-3: sources in common support only; mean of pair means, unavailable unless each
    expected hospital has exactly its targets. Without run columns an empty table gives one
    unavailable row, with them none."""
    df = sources.where(F.col("common_support")) if "common_support" in sources.columns else sources
    by = present(df, RUN)
    value = f"{metric}_source"
    per = df.groupBy(*by, "source_hospital", "target_hospital").agg(F.avg(value).alias("v"), F.avg("delta_within").alias("dw"), F.avg("delta_cross").alias("dc"))
    g = per.groupBy(*by).agg(
        F.avg("v").alias("v"), F.avg("dw").alias("dw"), F.avg("dc").alias("dc"), F.count("*").alias("_n"),
        F.array_sort(F.collect_set(F.struct(F.col("source_hospital").cast("int").alias("s"), F.col("target_hospital").cast("int").alias("t")))).alias("_seen"))
    ok = F.col("_n") > 0
    for hospital, targets in (expected or {}).items():
        have = _targets_of("_seen", hospital)
        ok = ok & (have == F.array(*[F.lit(t).cast("int") for t in sorted(targets)]))
    n = df.groupBy(*by).agg(F.count_distinct("source_id").alias("n_unique_sources"))
    j = g.join(n, by) if by else g.crossJoin(n)
    return j.select(*by, F.when(ok, "available").otherwise("unavailable").alias("status"), "n_unique_sources",
                    F.when(ok, F.col("dw")).alias("delta_within"), F.when(ok, F.col("dc")).alias("delta_cross"), F.when(ok, F.col("v")).alias(f"{metric}_common_support"))


def benjamini_hochberg(df: DataFrame, p: str = "p", key: str = "id", by: Sequence[str] = ("family",)) -> DataFrame:
    """FDR-1: adjusted p-values within each family: running minimum, from the largest down, of
    p * n / rank. p outside 0..1 raises. Equal p-values get equal results, whatever the order that ``key`` gives them.

    Ranks and minima come from buckets of p-values, so a family may be of any size."""
    x = F.when((F.col(p) < 0) | (F.col(p) > 1) | F.isnan(p), F.raise_error(F.lit("p-values must lie in [0, 1]")).cast("double")).otherwise(F.col(p))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    counted = df.join(sizes, list(by)) if by else df.crossJoin(F.broadcast(sizes))  # one row
    order = [F.col(p), F.col(key)]
    placed = ranked(counted.withColumn("_p", value_bucket(df, p)), order, F.col("_p"), by=by).withColumn("_q", x * F.col("_n") / (F.col("_r") + 1))
    # from here on in the order of the ranks, as rows may agree in both
    return least_from(placed, [F.col(p), F.col("_r")], F.col("_q"), F.col("_p"), "q", by).withColumn("q", F.least("q", F.lit(1.0))).select(*df.columns, "q")


def performance(df: DataFrame, label: str = "label", logit: str = "logit", by: Sequence[str] = ()) -> DataFrame:
    """PRF-1: n, accuracy at probability 0.5, and AUROC by mid-ranks; null with one class.

    Ties are aggregated first; totals below each distinct score accumulate within buckets of scores, so
    no task sees all rows."""
    scores = df.groupBy(*by, F.col(logit).alias("x")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    below = before(scores, ["x"], F.col("n"), value_bucket(scores, "x"), "b", by)
    right = F.when(1 / (1 + F.exp(-F.col("x"))) >= 0.5, F.col("p")).otherwise(F.col("n"))
    return below.groupBy(*by).agg(
        (F.sum("p") + F.sum("n")).alias("n"), (F.sum(right) / (F.sum("p") + F.sum("n"))).alias("accuracy"),
        F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))
