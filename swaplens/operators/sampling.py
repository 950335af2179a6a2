"""Audit subsets, quotas, permutations, planted cues and context assignment.

Random choices follow from md5 hashes of (seed, id), the same in every engine and partitioning. They
have the distribution of a seeded generator, not its draws.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import hash_order, present, require_columns, uniform
from ..functions.ordering import hash_bucket, ranked, value_bucket
from ..functions.stored import stored

ELIGIBLE = ["source_id", "source_split", "source_hospital", "source_slide", "source_physical_id", "label"]


def eligible_sources(triplets: DataFrame, split: str) -> DataFrame:
    """SUB-1: one row per matched source of the split."""
    require_columns(triplets, [c for c in ELIGIBLE if c != "source_physical_id"], "triplets")
    return triplets.where(F.col("source_split") == split).select(*present(triplets, ELIGIBLE)).dropDuplicates(["source_id"])


def largest_remainder(cells: DataFrame, keys: Sequence[str], weight: str, total: Column | int, out: str = "quota", by: Sequence[str] = ()) -> DataFrame:
    """QUO-1: whole shares of ``total`` in proportion to ``weight``: floors, then one more for the
    largest remainders, ties to the earlier key. One row per cell, so the table is small; with
    ``by`` each group is apportioned on its own."""
    whole = Window.partitionBy(*by)
    total = total if isinstance(total, Column) else F.lit(total)
    exact = F.round(F.col(weight) * total / F.sum(weight).over(whole), 9)
    parts = cells.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    rank = F.row_number().over(whole.orderBy(F.desc(F.col("_exact") - F.col("_floor")), *keys))
    left = total - F.sum("_floor").over(whole)
    return parts.withColumn(out, (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_exact", "_floor")


def audit_subset(sources: DataFrame, size: int, seed: int, strata: Sequence[str] = ("label", "source_slide")) -> DataFrame:
    """SUB-2: all sources if there are at most ``size``; else a sample stratified by ``strata``,
    apportioned by largest remainder and drawn by hash order. No count reaches the driver."""
    cells = sources.groupBy(*strata).agg(F.count("*").alias("_n"))
    total = F.least(F.lit(size), F.sum("_n").over(Window.partitionBy()))  # one row a stratum
    quotas = largest_remainder(cells, list(strata), "_n", total, "_take")
    quotas = quotas.select(*[F.col(c).alias(f"_q_{c}") for c in strata], "_take")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in strata])
    dealt = sources.join(quotas, same).drop(*[f"_q_{c}" for c in strata])
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(seed, F.col("source_id")), "source_id"))
    return dealt.withColumn("_r", rank).where(F.col("_r") <= F.col("_take")).drop("_r", "_take")


def cell_quotas(bank: DataFrame, n: int) -> DataFrame:
    """QUO-2: quota and available donors per hospital and label."""
    cells = bank.groupBy("hospital_id", "label").agg(F.count("*").alias("available"))
    return largest_remainder(cells, ["hospital_id", "label"], "available", n)


def permuted(df: DataFrame, value: str, seed: int, key: str = "source_id", strata: Sequence[str] = ()) -> DataFrame:
    """PRM-1: adds permuted_<value>, the values of each stratum in hash order; counts are kept.

    Rows meet by their ranks in both orders, by the numeric ``key`` and by its hash. Ranks come from buckets, so a
    stratum, or a table without strata, may be of any size."""
    strata = list(strata)
    a = ranked(df, [key], value_bucket(df, key), by=strata)
    other = df.select(*strata, F.col(value).alias(f"permuted_{value}"), hash_order(seed, F.col(key)).alias("_h"), F.col(key).alias("_k"))
    b = ranked(other, ["_h", "_k"], hash_bucket(F.col("_h")), by=strata)
    return a.join(b.drop("_h", "_k"), [*strata, "_r"]).drop("_r")


def corner_cue(images: DataFrame, strength: float, side: int, roi: int, cue: int, seed: int, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """CUE-1: with probability ``strength`` the top left ``cue`` x ``cue`` pixels become ``high`` for
    label 1 and ``low`` for others; a cue that would reach into the region of interest raises."""
    if not 0 <= strength <= 1:
        raise ValueError("strength must lie in [0, 1]")
    if cue > (side - roi) // 2:
        raise ValueError("the cue would modify the region of interest")
    planted = uniform(seed, F.col("source_id")) <= strength
    value = F.when(F.col("label") > 0, F.lit(float(high))).otherwise(F.lit(float(low)))
    inside = lambda i: ((i % side) < cue) & (i < side * cue)
    with_cue = F.transform("pixels", lambda v, i: F.when(inside(i), value).otherwise(v))
    return images.withColumn("planted", planted).withColumn("pixels", F.when(F.col("planted"), with_cue).otherwise(F.col("pixels")))


#: Partners that a clash is offered in the first round of exchanges.
OFFERED = 16


def independent_assignments(sources: DataFrame, bank: DataFrame, seed: int, cap: int) -> DataFrame:
    """ASG-1: a donor for each source, whatever its label: no donor more than ``cap`` times, never
    the source itself or its physical identity. Raises if sources outnumber the places, or if nothing can serve all.

    Places (donor, copy) and sources are put in hash order and meet by rank. A source s whose place p isn't allowed then
    exchanges it: with a source t at q, if s may have q and t may have p, or with an unused place. If all can be served, each
    clash has such a partner: without one, all places outside its identity would be held by its own identity's other sources. In a round
    clashes get disjoint runs of partners in hash order, as many each as there are partners to go round at most, and take the first that
    fits; a round is an equality join no longer than the list of partners, and its result is written. A round without
    any success offers all partners to one clash, which then is settled or shows that nothing can be."""
    require_columns(sources, ["source_id", "label", "hospital_id", "physical_id"], "sources")
    require_columns(bank, ["source_id", "label", "hospital_id", "physical_id", "slide_id"], "donor bank")
    places = bank.select(
        F.col("source_id").alias("donor_source_id"), F.col("label").alias("donor_label"), F.col("hospital_id").alias("donor_hospital"),
        F.col("slide_id").alias("donor_slide"), F.col("physical_id").alias("donor_physical_id"), F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("copy"))
    asked = sources.select("source_id", F.col("label").alias("source_label"), F.col("hospital_id").alias("source_hospital"), F.col("physical_id").alias("source_physical_id"))
    who, where = asked.columns, places.columns

    def allowed(s: str, p: str) -> Column:
        fits = (F.col(f"{p}donor_source_id") != F.col(f"{s}source_id")) & (F.col(f"{p}donor_physical_id") != F.col(f"{s}source_physical_id"))
        return F.col(f"{s}source_id").isNull() | F.coalesce(fits, F.lit(False))  # nobody may have any place

    s = _hash_ranked(asked, hash_order(seed, "source", F.col("source_id")), ["source_id"])
    p = _hash_ranked(places, hash_order(seed, "place", F.col("donor_source_id"), F.col("copy")), ["donor_source_id", "copy"])
    met = stored(s.join(p, "_r", "full").drop("_r"), "met")  # a row for each place, nobody at those that are left
    if not met.where("donor_source_id IS NULL").isEmpty():
        raise ValueError("donor reuse capacity is insufficient")
    round_, offered, alone = 0, OFFERED, False
    while True:
        met = met.withColumn("_ok", allowed("", ""))
        bad = met.where("NOT _ok").drop("_ok")
        m = bad.count()
        if not m:
            return met.where("source_id IS NOT NULL").drop("_ok", "copy", "source_physical_id")
        good = met.where("_ok").drop("_ok")
        n = good.count()
        m = 1 if alone else min(m, n)
        each = n if alone else max(1, min(offered, n // max(m, 1)))
        clashes = _hash_ranked(bad, hash_order(seed, round_, "clash", F.col("source_id")), ["source_id"]).where(F.col("_r") < m)
        partners = _hash_ranked(good, hash_order(seed, round_, "partner", F.col("donor_source_id"), F.col("copy")), ["donor_source_id", "copy"])
        partners = partners.withColumn("_at", F.col("_r")).withColumn("_r", F.floor(F.col("_at") / each)).where(F.col("_r") < m)
        partners = partners.select("_r", "_at", *[F.col(c).alias(f"t_{c}") for c in who + where])
        fitting = clashes.join(partners, "_r").where(allowed("", "t_") & allowed("t_", ""))
        whole = F.struct("_at", *who, *where, *[f"t_{c}" for c in who + where])
        pairs = stored(fitting.groupBy("_r").agg(F.min_by(whole, "_at").alias("x")).select("x.*"), "exchanges")
        if pairs.isEmpty():
            if alone:
                raise ValueError("no independent context donor remained for some sources")
            alone = True
        else:
            alone = False
            one = F.struct(*who, *[F.col(f"t_{c}").alias(c) for c in where])
            other = F.struct(*[F.col(f"t_{c}").alias(c) for c in who], *where)
            changed = pairs.select(F.explode(F.array(one, other)).alias("x")).select("x.*")
            kept = met.drop("_ok").join(changed.select("donor_source_id", "copy"), ["donor_source_id", "copy"], "left_anti")
            met = stored(kept.unionByName(changed), "met")
        met, round_, offered = met.drop("_ok"), round_ + 1, 2 * offered


def _hash_ranked(df: DataFrame, order: Column, ties: Sequence[str]) -> DataFrame:
    return ranked(df.withColumn("_o", order), ["_o", *ties], hash_bucket(F.col("_o"))).drop("_o")


def assignment_diagnostics(assignments: DataFrame) -> DataFrame:
    """ASG-1: per source label; the largest reuse is that over all assignments."""
    most = assignments.groupBy("donor_source_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_donor_reuse"))
    g = assignments.groupBy("source_label").agg(
        F.count("*").alias("n"), F.avg(F.col("donor_label").cast("double")).alias("donor_positive_rate"), F.count_distinct("donor_source_id").alias("unique_donors"))
    return g.crossJoin(F.broadcast(most))


def control_status(spark, kind: str, assignments_prepared: bool = False) -> DataFrame:
    """CTL-1: the stages of a control and where they stand; training is outside this engine."""
    if kind == "context_randomized":
        rows = [("assignment_quota_preparation", "completed", "joint-cell quotas are written")]
    elif kind == "planted_shortcut":
        rows = [("cue_generator", "completed" if assignments_prepared else "implemented", "corner cues can be planted")]
        if not assignments_prepared:
            rows.append(("cue_assignment_preparation", "unavailable", "no assignments were given"))
    else:
        raise ValueError(f"unknown control: {kind}")
    rows += [("control_training", "unavailable", "training is outside this engine"), ("control_audit", "implemented", "uses the audit of the primary runs")]
    return spark.createDataFrame(rows, "stage string, status string, reason string")
