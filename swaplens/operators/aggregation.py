"""Experiment aggregation: which runs count, their union, stability over seeds, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_KEYS = ["backbone", "seed"]


def run_ledger(expected: DataFrame, runs: DataFrame, dataset_version: Mapping[str, str], config_hash: str, required_tables: Sequence[str]) -> DataFrame:
    """AGG-1: status and the first reason against each expected (backbone, seed, split).

    runs: backbone, seed, split, run_status, run_seed, dataset_version, architecture, config_hash,
    tables (names that the run wrote), run_path. A run that isn't there is ``missing``, one that
    doesn't fit ``invalid``, else ``completed``.
    """
    want = F.coalesce(*[F.when(F.col("backbone") == b, F.lit(v)) for b, v in dataset_version.items()])
    lacking = F.array_except(F.array(*[F.lit(t) for t in sorted(required_tables)]), F.coalesce("tables", F.array().cast("array<string>")))
    say = lambda *parts: F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    reason = (
        F.when(F.col("run_path").isNull(), F.lit("the expected run is missing"))
        .when(~same(F.col("run_status"), F.lit("completed")), say("run status is", F.coalesce("run_status", F.lit("missing"))))
        .when(~same(F.col("run_seed"), F.col("seed")), say("seed", F.coalesce(F.col("run_seed").cast("string"), F.lit("none")), "is not the expected one"))
        .when(~same(F.col("dataset_version"), want), say("dataset version", F.coalesce("dataset_version", F.lit("none")), "is not", want))
        .when(~same(F.col("architecture"), F.col("backbone")), F.lit("architecture is not the expected one"))
        .when(~same(F.col("config_hash"), F.lit(config_hash)), F.lit("audit configuration is incompatible"))
        .when(F.size(lacking) > 0, say("missing tables:", F.array_join(lacking, ", ")))
    )
    keys = [*RUN_KEYS, "split"]
    j = expected.select(*keys).join(runs, keys, "left").withColumn("reason", reason)
    status = F.when(F.col("run_path").isNull(), "missing").when(F.col("reason").isNotNull(), "invalid").otherwise("completed")
    return j.select(*keys, status.alias("status"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("run_path", F.lit("")).alias("run_path"))


def combine(tables: Mapping[str, DataFrame], tag: str = "summary_type") -> DataFrame:
    """AGG-5, SET-1: union of tables of unlike columns, each tagged with its name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in tables.items()])


def completed_only(table: DataFrame, ledger: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """AGG-2: rows of runs that count."""
    good = ledger.where("status = 'completed'").select(*keys).distinct()
    return table.join(good, list(keys), "left_semi")


def stamped(table: DataFrame, ledger: DataFrame, protocol_hash: str | None = None) -> DataFrame:
    """AGG-2: how many runs were expected and completed, what is missing and whether all is there, on each
    row; an empty table gives one row that says so."""
    bad = F.when(F.col("status") != "completed", F.concat_ws(":", "backbone", "seed", "reason"))
    meta = ledger.agg(
        F.count("*").alias("number_expected_runs"), F.count_if(F.col("status") == "completed").alias("number_completed_runs"),
        F.array_join(F.array_sort(F.collect_list(bad)), ";").alias("missing_runs_detail"))
    meta = meta.withColumn("run_status", F.when(F.col("number_expected_runs") == F.col("number_completed_runs"), "complete").otherwise("incomplete"))
    meta = meta.withColumn("protocol_hash", F.lit(protocol_hash).cast("string"))
    return meta.join(table.withColumn("_one", F.lit(True)), F.lit(True), "left").drop("_one")


def missing_runs(ledger: DataFrame, split: str) -> DataFrame:
    """AGG-2: runs that don't count; one ``complete`` row if there are none."""
    bad = ledger.where("status <> 'completed'")
    none = bad.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(split).alias("split"), F.lit("complete").alias("status"), F.lit("").alias("reason"), F.lit("").alias("run_path"))
    return bad.unionByName(none, allowMissingColumns=True)


def seed_stability(directed: DataFrame, expected_seeds: Mapping[str, int], metrics: Sequence[str] = ("hcs", "hce")) -> DataFrame:
    """AGG-3: n, mean, sample deviation (null for one seed), least and largest over seeds per metric and
    directed pair; available only with as many seeds as expected."""
    keys = ["source_split", "backbone", "source_hospital", "target_hospital"]
    item = F.explode(F.array(*[F.struct(F.lit(f"directed_{m}").alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")
    long = directed.select(*keys, item).select(*keys, "m.*")
    want = F.coalesce(*[F.when(F.col("backbone") == b, F.lit(n)) for b, n in expected_seeds.items()]).cast("long")
    g = long.groupBy("metric", *keys).agg(
        F.count("value").alias("n_seeds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    g = g.withColumn("expected_seeds", want)
    return g.withColumn("status", F.when(F.col("n_seeds") == F.col("expected_seeds"), "available").otherwise("unavailable"))


def settings_completeness(expected: DataFrame, completed: DataFrame) -> DataFrame:
    """AGG-4: per (population, setting): expected and completed seeds, the missing ones and the status."""
    keys = ["population", "setting"]
    done = completed.select(*keys, "seed").distinct().withColumn("done", F.lit(True))
    j = expected.join(done, [*keys, "seed"], "left")
    g = j.groupBy(*keys).agg(
        F.count("*").alias("expected_runs"), F.count("done").alias("completed_runs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("done").isNull(), F.col("seed")))), lambda s: s.cast("string")), ";").alias("missing_seeds"))
    return g.withColumn("status", F.when(F.col("completed_runs") == F.col("expected_runs"), "complete").otherwise("incomplete"))


def assemble(populations: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """AGG-6: union over populations with the class of analysis that each result belongs to, so that
    what is exploratory is never read as confirmatory."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        df.withColumns({"population": F.lit(name), "analysis_class": F.lit(kind)}) for name, (df, kind) in populations.items()])


def population_tables(settings: Mapping[str, Mapping[str, DataFrame]], population: str) -> dict[str, DataFrame]:
    """AGG-5: setting -> table name -> table becomes table name -> union over settings, each row with its setting and population.
    Settings may lack tables, and tables of one name columns."""
    names = list(dict.fromkeys(n for tables in settings.values() for n in tables))
    return {n: combine({s: tables[n] for s, tables in settings.items() if n in tables}, "setting").withColumn("population", F.lit(population)) for n in names}


def individual_seeds(directed: Mapping[str, DataFrame], population: str, metrics: Sequence[str] = ("hcs", "hce")) -> DataFrame:
    """AGG-5: the directed tables of the settings as one row per setting, seed, directed pair and metric."""
    keys = ["setting", "source_split", "backbone", "seed", "source_hospital", "target_hospital", "n_sources"]
    item = F.explode(F.array(*[F.struct(F.lit(f"directed_{m}").alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")
    return combine(directed, "setting").select(*keys, item).select(*keys, "m.*").withColumn("population", F.lit(population))


def robustness_by_seed(runs: DataFrame, expected: DataFrame, population: str, backbone: str) -> DataFrame:
    """AGG-5: robustness summaries of the expected (setting, seed) under their population and architecture. Runs that weren't
    expected are left out; an expected one without a summary is a row that says ``missing``."""
    found = expected.select("setting", "seed").distinct().join(runs.withColumn("_there", F.lit(True)), ["setting", "seed"], "left")
    return found.withColumn("status", F.when(F.col("_there").isNull(), "missing").otherwise("available")).drop("_there").withColumns(
        {"population": F.lit(population), "backbone": F.lit(backbone)})


def matching_results(tables: Mapping[str, DataFrame], population: str, protocol_hash: str | None = None) -> DataFrame:
    """AGG-5: balance, balance by feature, coverage and common support of a matching in one table, each row with the table it is from."""
    return combine(tables, "source_table").withColumns({"population": F.lit(population), "protocol_hash": F.lit(protocol_hash).cast("string")})
