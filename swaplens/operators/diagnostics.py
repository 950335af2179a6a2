"""Coverage, balance, reuse and gates of a matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import require_columns

PAIR = ["source_split", "source_hospital", "target_hospital"]


def directed_coverage(ledger: DataFrame) -> DataFrame:
    """COV-1: n_sources, n_accepted, coverage per directed pair."""
    require_columns(ledger, [*PAIR, "coverage_status"], "ledger")
    ok = (F.col("coverage_status") == "accepted").cast("double")
    return ledger.groupBy(*PAIR).agg(F.count("*").alias("n_sources"), F.sum(ok).cast("long").alias("n_accepted"), F.avg(ok).alias("coverage"))


def annotate_common_support(ledger: DataFrame) -> DataFrame:
    """COV-2: common_support is true where all targets of the source are accepted."""
    w = Window.partitionBy("source_split", "source_hospital", "source_id")
    return ledger.withColumn("common_support", F.bool_and(F.col("coverage_status") == "accepted").over(w))


def common_support_coverage(ledger: DataFrame) -> DataFrame:
    """COV-3: over distinct sources; null hospitals are left out."""
    one = ledger.where("source_hospital is not null").select("source_split", "source_hospital", "source_id", "common_support").dropDuplicates(["source_split", "source_hospital", "source_id"])
    ok = F.col("common_support").cast("double")
    return one.groupBy("source_split", "source_hospital").agg(F.count("*").alias("n_sources"), F.sum(ok).cast("long").alias("n_common_support"), F.avg(ok).alias("coverage"))


def attrition(ledger: DataFrame) -> DataFrame:
    """COV-4: sources per directed pair and reason; no reason is ``accepted``."""
    reason = F.coalesce("exclusion_reason", F.lit("accepted")).alias("exclusion_reason")
    return ledger.where("source_hospital is not null and target_hospital is not null").groupBy(*PAIR, reason).agg(F.count("*").alias("n"))


def stamp_common_support(triplets: DataFrame, ledger: DataFrame) -> DataFrame:
    """JOIN-5: common_support of the ledger on each triplet."""
    keys = ["source_id", *PAIR]
    return triplets.join(ledger.select(*keys, "common_support"), keys, "left")


def balance_summary(triplets: DataFrame) -> DataFrame:
    """BAL-1: distances per directed pair; the scale of paired_smd is the sample deviation of both
    distances together, in closed form, so no row is doubled."""
    w, c = F.col("matching_distance_within"), F.col("matching_distance_cross")
    # around the pair mean, so that squares don't cancel
    mean = F.avg((w + c) / 2).over(Window.partitionBy(*PAIR))
    g = triplets.withColumn("_m", mean).groupBy(*PAIR).agg(
        F.count("*").alias("n_triplets"), F.avg(w).alias("within_mean"), F.avg(c).alias("cross_mean"),
        F.percentile("matching_distance_within", 0.5).alias("within_median"), F.percentile("matching_distance_cross", 0.5).alias("cross_median"),
        F.avg(c - w).alias("mean_paired_difference"), F.avg("matching_distance_pair").alias("mean_pair_distance"),
        F.sum((w - F.col("_m")) * (w - F.col("_m")) + (c - F.col("_m")) * (c - F.col("_m"))).alias("_ss"), F.bool_and(w == c).alias("_equal"))
    scale = F.when(F.col("n_triplets") > 1, F.sqrt(F.col("_ss") / (2 * F.col("n_triplets") - 1))).otherwise(0.0)
    smd = F.when(scale > 0, (F.col("cross_mean") - F.col("within_mean")) / scale).when(F.col("_equal"), 0.0)
    return g.withColumn("paired_smd", smd).drop("_ss", "_equal")


def feature_balance(triplets: DataFrame, descriptors: DataFrame, features: Sequence[str], standardizer: DataFrame) -> DataFrame:
    """BAL-2, JOIN-3/4: per feature, on the scale of the training bank. A donor without a
    descriptor, or with a value that is not finite, raises."""
    require_columns(descriptors, ["source_id", *features], "descriptors")
    def of(p: str) -> DataFrame:
        return descriptors.dropDuplicates(["source_id"]).select(F.col("source_id").alias(f"{p}_donor"), *[F.col(c).cast("double").alias(f"{p}_{c}") for c in features])
    joined = triplets.select(*PAIR, "within_donor", "cross_donor").join(of("within"), "within_donor", "left").join(of("cross"), "cross_donor", "left")
    long = joined.select(*PAIR, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"within_{c}").alias("w"), F.col(f"cross_{c}").alias("c")) for c in features])).alias("f")).select(*PAIR, "f.*")
    bad = F.col("w").isNull() | F.col("c").isNull() | F.isnan("w") | F.isnan("c")
    long = long.withColumn("w", F.when(bad, F.raise_error(F.lit("a donor has no finite descriptor"))).otherwise(F.col("w")))
    g = long.groupBy(*PAIR, "feature").agg(
        F.count("*").alias("n_pairs"), F.avg("w").alias("within_mean"), F.avg("c").alias("cross_mean"),
        F.percentile("w", 0.5).alias("within_median"), F.percentile("c", 0.5).alias("cross_median"),
        F.avg(F.col("c") - F.col("w")).alias("paired_mean_difference"), F.bool_and(F.col("w") == F.col("c")).alias("_equal"))
    j = g.join(standardizer.select("feature", F.col("scale").alias("train_scale")), "feature")
    smd = F.when(F.col("train_scale") > 0, F.col("paired_mean_difference") / F.col("train_scale")).when(F.col("_equal"), 0.0)
    status = F.when(F.col("train_scale") > 0, "estimable").when(F.col("_equal"), "zero_train_scale_equal_values").otherwise("non_estimable_zero_train_scale")
    return j.withColumn("paired_smd", smd).withColumn("paired_smd_status", status).drop("_equal")


def _uses(triplets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each donor use once: (keys, donor_id, slide, kind). Exploded from the row, read once."""
    use = F.explode(F.array(*[
        F.struct(F.col(f"{k}_donor").alias("donor_id"), F.col(f"{k}_slide").alias("slide"), F.lit(k).alias("kind")) for k in ("within", "cross")])).alias("u")
    return triplets.select(*keys, use).select(*keys, "u.*")


def _by_kind(names: tuple[str, str, str]) -> list[Column]:
    return [F.count_if(F.col("kind") == "within").alias(names[0]), F.count_if(F.col("kind") == "cross").alias(names[1]), F.count("*").alias(names[2])]


def _lookup(descriptors: DataFrame) -> DataFrame:
    return descriptors.dropDuplicates(["source_id"]).select(F.col("source_id").alias("donor_id"), F.col("hospital_id").alias("hospital"), "label")


def _spread(df: DataFrame, column: str) -> DataFrame:
    """One row: min, median, p90, p95, p99, max of a column, null where it is empty."""
    q = F.percentile(column, F.array(*[F.lit(p) for p in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)]))
    names = ("min", "median", "p90", "p95", "p99", "max")
    return df.agg(F.count("*").alias("n"), q.alias("q")).select("n", *[F.get(F.col("q"), i).alias(x) for i, x in enumerate(names)])


def donor_reuse_summary(triplets: DataFrame, descriptors: DataFrame) -> DataFrame:
    """REU-1: a row per donor and slide, and a summary row per statistic."""
    detail = _uses(triplets).groupBy("donor_id", "slide").agg(*_by_kind(("within_reuse", "cross_reuse", "total_reuse"))).join(_lookup(descriptors), "donor_id", "left")
    rows = detail.select(F.lit("donor").alias("row_type"), F.col("donor_id").alias("donor_source_id"), "slide", "within_reuse", "cross_reuse",
                         F.col("total_reuse").cast("double").alias("total_reuse"), "hospital", "label")
    s = _spread(detail, "total_reuse")
    long = s.select(F.explode(F.array(*[F.struct(F.lit(x).alias("statistic"), F.col(x).alias("total_reuse")) for x in s.columns[1:]])).alias("v")).select("v.*")
    return rows.unionByName(long.withColumn("row_type", F.lit("summary")), allowMissingColumns=True)


def slide_reuse_summary(triplets: DataFrame, descriptors: DataFrame) -> DataFrame:
    """REU-2: uses per slide within each directed pair with its share, and a summary per pair."""
    keys = [*PAIR, "hospital", "slide"]
    detail = _uses(triplets, PAIR).join(_lookup(descriptors), "donor_id", "left").groupBy(*keys).agg(*_by_kind(("within_uses", "cross_uses", "total_donor_uses")))
    share = F.col("total_donor_uses") / F.sum("total_donor_uses").over(Window.partitionBy(*PAIR))
    detail = detail.withColumn("directed_pair_fraction", share)
    total = detail.groupBy(*PAIR).agg(
        F.count("*").alias("unique_donor_slides"), (1 / F.sum(F.col("directed_pair_fraction") * F.col("directed_pair_fraction"))).alias("effective_donor_slide_count"),
        F.max("directed_pair_fraction").alias("maximum_slide_share"), F.sum("total_donor_uses").alias("total_donor_uses"))
    return detail.withColumn("row_type", F.lit("slide")).unionByName(total.withColumn("row_type", F.lit("summary")), allowMissingColumns=True)


def donor_reuse_detail(triplets: DataFrame, descriptors: DataFrame) -> DataFrame:
    """REU-3."""
    g = _uses(triplets).groupBy("donor_id", "slide").agg(*_by_kind(("within_uses", "cross_uses", "total_uses")))
    return g.join(_lookup(descriptors), "donor_id", "left").select(
        "donor_id", F.col("hospital").alias("donor_hospital"), F.col("slide").alias("donor_slide"), F.col("label").alias("donor_label"), "within_uses", "cross_uses", "total_uses")


def donor_reuse_distribution(triplets: DataFrame, descriptors: DataFrame) -> DataFrame:
    """REU-4: one row, nulls for an empty matching."""
    return _spread(donor_reuse_detail(triplets, descriptors), "total_uses").withColumnRenamed("n", "n_unique_donors").drop("min")


def slide_reuse_detail(triplets: DataFrame, descriptors: DataFrame) -> DataFrame:
    """REU-5: the share of all uses comes from a total of one row, not from one window over all."""
    g = _uses(triplets).join(_lookup(descriptors), "donor_id", "left").groupBy("hospital", F.col("slide").alias("slide_id")).agg(*_by_kind(("within_uses", "cross_uses", "total_uses")))
    total = g.agg(F.sum("total_uses").alias("_t"))
    return g.crossJoin(F.broadcast(total)).withColumn("share_of_all_donor_uses", F.col("total_uses") / F.col("_t")).drop("_t")


def slide_reuse_distribution(triplets: DataFrame, descriptors: DataFrame) -> DataFrame:
    """REU-6."""
    detail = slide_reuse_detail(triplets, descriptors)
    top = detail.agg(F.max("share_of_all_donor_uses").alias("maximum_slide_share"))
    return _spread(detail, "total_uses").withColumnRenamed("n", "n_unique_slides").drop("min").crossJoin(top)


def coverage_gate(coverage: DataFrame, minimum: float = 0.9) -> DataFrame:
    """GATE-1: observed minimum against the threshold; no rows fail."""
    return coverage.agg(F.coalesce(F.min("coverage"), F.lit(0.0)).alias("observed")).select(
        F.lit("directed_coverage").alias("check"), "observed", F.lit(minimum).alias("threshold"), (F.col("observed") >= minimum).alias("passed"))


def preflight(
    descriptors: DataFrame, features: Sequence[str], coverage: DataFrame, common: DataFrame, balance: DataFrame, by_feature: DataFrame, donor_reuse: DataFrame,
    expected_pairs: Sequence[tuple[str, int, int]], min_coverage: float = 0.9, max_smd: float = 0.1, donor_cap: int = 20,
) -> DataFrame:
    """GATE-2: check, observed, threshold, passed for each check, and ``overall``. What is empty or
    not finite fails."""
    spark = descriptors.sparkSession
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in features])

    def check(name: str, df: DataFrame, observed: Column, threshold: float, below: bool) -> DataFrame:
        one = df.agg(observed.cast("double").alias("observed"))
        ok = F.col("observed") <= threshold if below else F.col("observed") >= threshold
        return one.select(F.lit(name).alias("check"), "observed", F.lit(float(threshold)).alias("threshold"), F.coalesce(ok & ~F.isnan("observed"), F.lit(False)).alias("passed"))

    expected = spark.createDataFrame(list(expected_pairs), "source_split string, source_hospital int, target_hospital int")
    seen = coverage.select(*PAIR).distinct()
    odd = expected.exceptAll(seen).unionByName(seen.exceptAll(expected))
    all_known = F.when(F.count("*") == F.count("paired_smd"), F.max(F.abs("paired_smd")))
    checks = [
        check("finite_descriptors", descriptors, F.avg(finite.cast("double")), 1.0, False),
        check("directed_coverage", coverage, F.min("coverage"), min_coverage, False),
        check("expected_hospital_pairs", odd, F.count("*"), 0.0, True),
        check("common_support_coverage", common, F.min("coverage"), min_coverage, False),
        check("aggregate_matching_smd", balance, F.when(F.count("*") == F.count("paired_smd"), F.try_divide(F.sum(F.abs("paired_smd") * F.col("n_triplets")), F.sum("n_triplets"))), max_smd, True),
        check("per_feature_balance", by_feature.where(F.col("feature").isin(*features)), all_known, max_smd, True),
        check("donor_reuse_cap", donor_reuse, F.coalesce(F.max("total_uses"), F.lit(0)), float(donor_cap), True),
    ]
    table = reduce(lambda a, b: a.unionByName(b), checks)
    overall = table.agg(F.bool_and("passed").alias("passed")).select(
        F.lit("overall").alias("check"), F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("threshold"), "passed")
    return table.unionByName(overall)


CHECKS = "check string, observed double, threshold double, passed boolean"


def required_files(required: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """GATE-2: a check for each required file, passed where it was found. Files of size 0 (if ``found`` has ``bytes``) don't count; nothing
    required is one failed check, as nothing would have been looked at."""
    there = found.where(F.col("bytes") > 0) if "bytes" in found.columns else found
    j = required.select(key).distinct().join(there.select(key).distinct().withColumn("_there", F.lit(1.0)), key, "left")
    rows = j.select(F.concat(F.lit("required_file:"), F.coalesce(F.col(key), F.lit("null"))).alias("check"), F.coalesce("_there", F.lit(0.0)).alias("observed"), F.lit(1.0).alias("threshold"))
    none = required.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("required_files").alias("check"), F.lit(0.0).alias("observed"), F.lit(1.0).alias("threshold"))
    return rows.unionByName(none).withColumn("passed", F.col("observed") >= F.col("threshold"))


def recorded_state(spark, locked_hash: str | None, protocol_hash: str | None, commit: str | None, dirty: bool | None, markers: Mapping[str, str | None] | None = None) -> DataFrame:
    """GATE-2: that the protocol is the locked one, the commit known and clean, and each marker (of tests, of the data's integrity) says that
    it passed. What isn't known fails."""
    rows = [("protocol_hash", bool(locked_hash) and locked_hash == protocol_hash), ("git_clean", bool(commit) and dirty is False)]
    rows += [(name, str(said or "").lower() in ("pass", "passed")) for name, said in (markers or {}).items()]
    return spark.createDataFrame([(n, float(ok), 1.0, bool(ok)) for n, ok in rows], CHECKS)


def gated(*tables: DataFrame) -> DataFrame:
    """GATE-2: checks of several tables in one, without their own ``overall`` rows, and one ``overall`` for all; no check at all fails."""
    rows = reduce(lambda a, b: a.unionByName(b), [t.where("check <> 'overall'") for t in tables])
    overall = rows.agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("passed")).select(
        F.lit("overall").alias("check"), F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("threshold"), "passed")
    return rows.unionByName(overall)
