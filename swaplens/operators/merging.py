"""Merging the matching of the held-out split into that of the others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import diagnostics


@dataclass(frozen=True)
class Matching:
    """Triplets and ledger of one matching."""

    triplets: DataFrame
    ledger: DataFrame


def merged(primary: Matching, final: Matching, held_out: str = "test") -> Matching:
    """MRG-1: the primary matching without rows of the held-out split, and after it the final matching. What the final one has beside
    the held-out split is kept too; columns that one side lacks are null."""
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.where(F.coalesce(F.col("source_split") != held_out, F.lit(True))).unionByName(b, allowMissingColumns=True)

    return Matching(both(primary.triplets, final.triplets), both(primary.ledger, final.ledger))


def recomputed(m: Matching, descriptors: DataFrame, features: Sequence[str], standardizer: DataFrame) -> dict[str, DataFrame]:
    """MRG-1: the diagnostics of a merged matching, by the names of their tables."""
    support = diagnostics.annotate_common_support(m.ledger)
    return {
        "directed_coverage": diagnostics.directed_coverage(m.ledger), "common_support_coverage": diagnostics.common_support_coverage(support),
        "attrition": diagnostics.attrition(m.ledger), "matching_balance": diagnostics.balance_summary(m.triplets),
        "feature_balance": diagnostics.feature_balance(m.triplets, descriptors, features, standardizer),
        "donor_reuse": diagnostics.donor_reuse_detail(m.triplets, descriptors), "donor_reuse_summary": diagnostics.donor_reuse_distribution(m.triplets, descriptors),
        "slide_reuse": diagnostics.slide_reuse_detail(m.triplets, descriptors), "slide_reuse_summary": diagnostics.slide_reuse_distribution(m.triplets, descriptors)}


def final_check(tables: dict[str, DataFrame], held_out: str = "test", min_coverage: float = 0.9, max_smd: float = 0.1, donor_cap: int = 20) -> DataFrame:
    """MRG-1: check, observed, threshold, passed, and ``overall``. Coverage and balance are those of the held-out split, an absent
    split fails; reuse is that of all triplets, of none it fails."""
    own = lambda name: tables[name].where(F.col("source_split") == held_out)

    def check(name: str, df: DataFrame, observed: Column, threshold: float, below: bool) -> DataFrame:
        ok = F.col("observed") <= threshold if below else F.col("observed") >= threshold
        return df.agg(observed.cast("double").alias("observed")).select(
            F.lit(name).alias("check"), "observed", F.lit(float(threshold)).alias("threshold"), F.coalesce(ok & ~F.isnan("observed"), F.lit(False)).alias("passed"))

    known = F.when(F.count("*") == F.count("paired_smd"), F.max(F.abs("paired_smd")))
    rows = reduce(lambda a, b: a.unionByName(b), [
        check("directed_coverage", own("directed_coverage"), F.min("coverage"), min_coverage, False),
        check("common_support_coverage", own("common_support_coverage"), F.min("coverage"), min_coverage, False),
        check("per_feature_abs_smd", own("feature_balance"), known, max_smd, True),
        check("donor_reuse_cap", tables["donor_reuse"], F.max("total_uses"), donor_cap, True)])
    overall = rows.agg(F.bool_and("passed").alias("passed")).select(
        F.lit("overall").alias("check"), F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("threshold"), "passed")
    return rows.unionByName(overall)
