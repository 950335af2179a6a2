"""Metrics, roll-ups, bootstrap: known answers and fail-closed cases."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from swaplens.operators import bootstrap, metrics
from swaplens.streaming.metrics import stream_directed, stream_pair_metrics

PRED = "source_id long, source_split string, source_hospital int, target_hospital int, original_logit double, within_logit double, cross_logit double"
UNIT = "median double, scale double"


def predictions(spark):
    return spark.createDataFrame([(1, "val", 1, 0, 0.0, 1.0, 2.0), (1, "val", 1, 0, 0.0, -1.0, -2.0), (2, "val", 1, 0, 5.0, 7.0, 6.0)], PRED)


def unit(spark):
    return spark.createDataFrame([(0.0, 1.0)], UNIT)


def test_known_answers(spark):
    s = metrics.source_metrics(metrics.donor_pair_metrics(predictions(spark), unit(spark)))
    assert {r.source_id: (r.hcs_source, r.hce_source, r.n_donor_pairs) for r in s.collect()} == {1: (1.0, 0.0, 2), 2: (-1.0, -1.0, 1)}
    d = metrics.directed(s).first()
    assert (d.hcs, d.hce, d.n_sources) == (0.0, -0.5, 2)


def test_normalizer(spark):
    one = metrics.fit_normalizer(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "logit double")).first()
    assert (one.median, one.scale) == (2.5, 3.0)
    assert metrics.fit_normalizer(spark.createDataFrame([(1.0,), (1.0,)], "logit double")).first().scale == 1e-3
    for rows in ([], [(float("nan"),)], [(None,)], [(float("inf"),)]):
        with pytest.raises(Exception, match="logits"):
            metrics.fit_normalizer(spark.createDataFrame(rows, "logit double")).collect()


def test_an_original_logit_that_varies_raises(spark):
    bad = predictions(spark).union(spark.createDataFrame([(2, "val", 1, 0, 5.5, 7.0, 6.0)], PRED))
    with pytest.raises(Exception, match="varies"):
        metrics.source_metrics(metrics.donor_pair_metrics(bad, unit(spark))).collect()
    with pytest.raises(KeyError):
        metrics.donor_pair_metrics(predictions(spark).drop("cross_logit"), unit(spark))


def directed(spark, pairs):
    return spark.createDataFrame([("val", s, t, 0.25 * (i + 1)) for i, (s, t) in enumerate(pairs)], "source_split string, source_hospital int, target_hospital int, hcs double")


def test_missing_or_unexpected_pairs_are_never_averaged(spark):
    want = [(1, 0), (1, 3)]
    full = metrics.pair_weighted(directed(spark, want), "hcs", want).first()
    assert (full.status, full.hcs_pair_weighted) == ("available", 0.375)
    for pairs, missing, odd in (([(1, 0)], "1>3", ""), ([(1, 0), (1, 3), (1, 4)], "", "1>4"), ([(1, 0), (2, 3)], "1>3", "2>3")):
        r = metrics.pair_weighted(directed(spark, pairs), "hcs", want).first()
        assert (r.status, r.hcs_pair_weighted, r.missing_pairs, r.unexpected_pairs) == ("unavailable", None, missing, odd)
    assert metrics.pair_weighted(directed(spark, want), "hcs", None).first().status == "available"
    assert metrics.pair_weighted(directed(spark, want), "hcs", []).first().status == "unavailable"


SOURCES = "source_id long, source_hospital int, target_hospital int, hcs_source double, delta_within double, delta_cross double, common_support boolean"


def test_common_support(spark):
    rows = [(1, 1, 0, 1.0, 0.0, 1.0, True), (2, 1, 0, 3.0, 0.0, 3.0, True), (1, 1, 3, 5.0, 0.0, 5.0, True), (3, 1, 0, 99.0, 0.0, 9.0, False), (4, 7, 0, 2.0, 0.0, 2.0, True)]
    df = spark.createDataFrame(rows, SOURCES)
    ok = metrics.common_support(df.where("source_hospital = 1"), "hcs", {1: {0, 3}}).first()
    assert (ok.status, ok.hcs_common_support, ok.n_unique_sources) == ("available", 3.5, 2)
    assert metrics.common_support(df, "hcs", {1: {0, 3}}).first().status == "available"  # more hospitals than expected pass
    assert metrics.common_support(df, "hcs", {1: {0}}).first().status == "unavailable"
    assert metrics.common_support(df.limit(0), "hcs", {1: {0}}).first().status == "unavailable"
    assert metrics.common_support(df.limit(0).withColumn("seed", F.lit(1)), "hcs", {1: {0}}).count() == 0


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, "f", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.2])], "id long, family string, p double")
    q = [r.q for r in metrics.benjamini_hochberg(df).orderBy("id").collect()]
    assert q == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])
    with pytest.raises(Exception, match="p-values"):
        metrics.benjamini_hochberg(df.union(spark.createDataFrame([(9, "f", 1.5)], "id long, family string, p double"))).collect()


def test_one_large_family_with_ties_and_buckets(spark):
    """Against the definition, in more buckets than one, with repeated values and keys."""
    import random

    rng = random.Random(4)
    ps = [rng.choice([0.0, 1.0, 0.5, round(rng.random(), 2), rng.random() ** 3]) for _ in range(700)]
    rows = [(i // 2, f, p) for f, part in (("one", ps), ("two", ps[:9]), ("three", [0.3])) for i, p in enumerate(part)]
    df = spark.createDataFrame(rows, "id long, family string, p double").repartition(5)
    want = {}
    for f in ("one", "two", "three"):
        own = sorted(p for _, g, p in rows if g == f)
        least, q = 1.0, {}
        for rank in range(len(own), 0, -1):
            least = min(least, own[rank - 1] * len(own) / rank)
            q[own[rank - 1]] = least
        want[f] = q
    got = metrics.benjamini_hochberg(df).collect()
    assert len(got) == len(rows) and all(r.q == pytest.approx(want[r.family][r.p]) for r in got)
    windows = metrics.benjamini_hochberg(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_b" in line.split("windowspecdefinition(")[1] for line in windows.split("\n") if "Window [" in line)  # none over a family alone
    alone = metrics.benjamini_hochberg(df.where("family = 'two'").drop("family"), by=()).collect()
    assert sorted(r.q for r in alone) == pytest.approx(sorted(want["two"][p] for p in ps[:9]))


def test_performance(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 0.5), (0, 0.5), (0, -1.0)], "label int, logit double")
    r = metrics.performance(df).first()
    assert (r.n, r.accuracy, r.auroc) == (4, 0.75, 0.875)
    assert metrics.performance(df.where("label = 1")).first().auroc is None


GROUPED = "v double, source string, within string, cross string, source_hospital int, target_hospital int"


def test_bootstrap(spark):
    df = spark.createDataFrame([(1.0, "a", "b", "c", 1, 0), (3.0, "b", "d", "e", 1, 0), (9.0, "a", "f", "g", 1, 3)], GROUPED)
    roles, groups = ["source", "within", "cross"], ["source_hospital", "target_hospital"]
    one = bootstrap.grouped(df, "v", roles, groups, draws=200).first()
    assert (one.estimate, one.n_groups, one.n) == (5.5, 2, 3) and one.ci_lower <= 5.5 <= one.ci_upper and one.standard_error > 0
    again = bootstrap.grouped(df.repartition(3), "v", roles, groups, draws=200).first()
    assert [again.estimate, again.ci_lower, again.ci_upper, again.standard_error] == pytest.approx([one.estimate, one.ci_lower, one.ci_upper, one.standard_error])
    same = bootstrap.crossed(df.where("source = 'a'").withColumn("v", F.lit(2.0)), "v", roles, [], draws=20).first()
    assert (same.estimate, same.ci_lower, same.ci_upper) == pytest.approx((2.0, 2.0, 2.0))


def plain_multiplier(seed, draw, identity):
    told = "|".join(str(x) for x in (seed, draw, identity) if x is not None)
    return -math.log((int(hashlib.md5(told.encode()).hexdigest()[:12], 16) + 0.5) / 2**48)


@pytest.mark.parametrize("rows,kept", [(256, 64 << 20), (2, 1)])
def test_weighted_sums_are_those_of_every_row_and_draw(spark, monkeypatch, rows, kept):
    """In any blocks, also where multipliers have to be made again, with missing identities and values and several groups."""
    monkeypatch.setattr(bootstrap, "ROWS", rows)
    monkeypatch.setattr(bootstrap, "KEPT", kept)
    data = [(1.0, "a", "b", 0), (4.0, "b", "a", 1), (7.0, "c", "a", 0), (7.0, "c", "a", 0), (2.0, "c", None, 1), (None, "d", "e", 1), (3.0, None, None, None)]
    df = spark.createDataFrame(data, "v double, source string, within string, g int").repartition(3)
    got = {(r.g, r.draw): r.v for r in bootstrap.weighted_sums(df, ["source", "within"], ["g"], ["v"], 9, 3).collect()}
    want = {}
    for v, a, b, g in data:
        for draw in range(9):
            want[g, draw] = want.get((g, draw), 0) + (v or 0) * plain_multiplier(3, draw, a) * plain_multiplier(3, draw, b)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    whole = {r.draw: r.v for r in bootstrap.weighted_sums(df, ["source", "within"], [], ["v"], 9, 3).collect()}
    assert whole == {d: pytest.approx(sum(want[g, d] for g in (0, 1, None))) for d in range(9)}
    assert bootstrap.weighted_sums(df.limit(0), ["source"], ["g"], ["v"], 9, 3).count() == 0


def test_what_the_bootstrap_shuffles_does_not_grow_with_rows_times_draws(spark):
    """One array a task and group; the rows that are exploded are those of tasks, groups and draws."""
    df = spark.range(3000).selectExpr("CAST(id AS DOUBLE) AS v", "CAST(id % 50 AS STRING) AS source", "CAST(id % 2 AS INT) AS g").repartition(4)
    sums = bootstrap.weighted_sums(df, ["source"], ["g"], ["v"], 40, 1)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.index("MapInArrow") > plan.index("Generate posexplode")  # exploded after, not before
    assert sums.count() == 80


def test_one_identity_has_one_weight_in_all_roles(spark):
    """With one identity everywhere the weight is the cube of its draw and cancels; with two the mean moves."""
    df = spark.createDataFrame([(1.0, "x", "x"), (5.0, "y", "y")], "v double, source string, within string")
    got = bootstrap.draw_means(df, "v", ["source", "within"], [], 30, 1).collect()
    single = {r.draw: r.estimate for r in bootstrap.draw_means(df, "v", ["source"], [], 30, 1).collect()}
    for r in got:
        w = (single[r.draw] - 1) / (5 - single[r.draw])  # ratio of the draws of y and x
        assert r.estimate == pytest.approx((1 + 5 * w * w) / (1 + w * w))


def test_seed_estimates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None), ("c", 1.0)], "k string, v double")
    got = {r.k: (r.n_seeds, r.mean, r.std) for r in bootstrap.seed_estimates(df, "v", ["k"]).collect()}
    assert got == {"a": (2, 2.0, math.sqrt(2)), "b": (1, 2.0, 0.0), "c": (2, None, None)}


def test_intervals_are_unavailable_for_other_pairs(spark):
    df = spark.createDataFrame([("val", 1, 0, "a", 1.0, 2.0, True), ("val", 1, 3, "b", 2.0, 3.0, False)],
                               "source_split string, source_hospital int, target_hospital int, source_physical_id string, hcs_pair double, hce_pair double, common_support boolean")
    got = {(r.summary_type, r.metric): (r.status, r.estimate) for r in bootstrap.audit_intervals(df, [(1, 0), (1, 3)], 10).collect()}
    assert got["pair_weighted", "hcs"] == ("available", 1.5) and got["pair_weighted", "hce"] == ("available", 2.5)
    assert got["common_support", "hcs"] == got["common_support", "hce"] == ("unavailable", None)


def test_streamed_metrics_are_the_batch_ones(spark, tmp_path):
    df = predictions(spark)
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_directed(stream_pair_metrics(stream, unit(spark))).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    try:
        q.processAllAvailable()
        got = spark.table("streamed").first()
    finally:
        q.stop()
    want = stream_directed(metrics.donor_pair_metrics(df, unit(spark))).first()
    assert got == want
