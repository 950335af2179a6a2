"""Joins held to one row a key, merged matchings, the data source of audited tables, path policy, standardizers that are read."""

import pytest
from pyspark.sql import functions as F

from swaplens.functions import stored as storing
from swaplens.operators import aggregation, diagnostics, features, joins, merging
from swaplens.sources import shards, tables


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, a string")
    b = spark.createDataFrame([(2, 5.0), (3, None), (9, 1.0)], "k int, b double")
    assert sorted(map(tuple, joins.one_to_one(a, b, ["k"]).collect())) == [(2, "y", 5.0), (3, None, None)]
    assert sorted(map(tuple, joins.unmatched(a, b, ["k"]).collect())) == [(1, "right"), (9, "left")]
    assert joins.one_to_one(a.limit(0), b, ["k"]).count() == 0 == joins.one_to_one(a.where("k > 1"), b.where("k < 9"), ["k"], missing="raise").count() - 2
    for left, right, told in ((a.union(a.limit(1)), b, "left: a key is not unique"), (a, b.union(b), "right: a key is not unique"),
                              (a.withColumn("k", F.when(F.col("k") > 1, F.col("k"))), b, "left: a key is null")):
        with pytest.raises(Exception, match=told):
            joins.one_to_one(left, right, ["k"]).collect()
        with pytest.raises(Exception, match=told):
            joins.unmatched(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="lacks the key"):
        joins.one_to_one(a, b, ["k"], missing="raise").collect()
    with pytest.raises(ValueError, match="both sides"):
        joins.one_to_one(a, b.withColumnRenamed("b", "a"), ["k"])
    with pytest.raises(KeyError):
        joins.one_to_one(a, b, ["no"])


def test_both_checks_ride_on_the_joins_own_shuffle(spark):
    a, b = (spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias(n)).repartition(3) for n in "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.one_to_one(a, b, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # one a side


LEDGER = "source_id long, source_split string, source_hospital int, target_hospital int, coverage_status string, exclusion_reason string"
TRIPLETS = """triplet_id string, source_id long, source_split string, source_hospital int, target_hospital int, within_donor long, within_slide string, cross_donor long, cross_slide string,
    matching_distance_within double, matching_distance_cross double, matching_distance_pair double"""


def matching_of(spark, split, targets, status="accepted", first=1):
    ledger = [(first + i, split, 1, t, status, None if status == "accepted" else "distance_threshold") for i in range(4) for t in targets]
    rows = [(f"t{i}-{t}", i, s, h, t, 100 + i % 2, "sa", 200 + i % 2, "sb", 1.0, 1.0, 0.5) for i, s, h, t, st, _ in ledger if st == "accepted"]
    return merging.Matching(spark.createDataFrame(rows, TRIPLETS), spark.createDataFrame(ledger, LEDGER))


def test_merged_matching(spark):
    descriptors = spark.createDataFrame([(i, 1, 0, 2.0 + i % 2) for i in (100, 101, 200, 201)], "source_id long, hospital_id int, label int, f double")
    scale = spark.createDataFrame([("f", 0.0, 2.0)], "feature string, mean double, scale double")
    primary = matching_of(spark, "val", (0, 2))
    stale = matching_of(spark, "test", (0,), "excluded", 50)
    before = merging.Matching(primary.triplets, primary.ledger.unionByName(stale.ledger))
    m = merging.merged(before, matching_of(spark, "test", (0, 2), first=10))
    assert {r.source_id for r in m.ledger.collect()} == {1, 2, 3, 4, 10, 11, 12, 13} and m.triplets.count() == 16
    found = merging.recomputed(m, descriptors, ["f"], scale)
    assert {(r.source_split, r.target_hospital): r.coverage for r in found["directed_coverage"].collect()} == {(s, t): 1.0 for s in ("val", "test") for t in (0, 2)}
    assert found["donor_reuse"].agg(F.sum("total_uses")).first()[0] == 32
    got = {r.check: r.passed for r in merging.final_check(found).collect()}
    assert got == dict.fromkeys(("directed_coverage", "common_support_coverage", "per_feature_abs_smd", "donor_reuse_cap", "overall"), True)
    assert not {r.check: r.passed for r in merging.final_check(found, donor_cap=7).collect()}["overall"]
    # without the held-out split nothing is known of it, and that is no success
    none = merging.recomputed(merging.merged(primary, merging.Matching(primary.triplets.limit(0), primary.ledger.limit(0))), descriptors, ["f"], scale)
    lacking = {r.check: r.passed for r in merging.final_check(none).collect()}
    assert lacking == {"directed_coverage": False, "common_support_coverage": False, "per_feature_abs_smd": False, "donor_reuse_cap": True, "overall": False}


def test_data_source_of_shards(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 7 AS g", "CAST(id AS STRING) AS s", "CASE WHEN id % 5 > 0 THEN id / 2.0D END AS x", "ARRAY(id) AS more")
    df.repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/t")
    read = shards.load_dataset(spark, f"{tmp_path}/t")
    assert read.schema == spark.read.parquet(f"{tmp_path}/t").schema and sorted(read.collect()) == sorted(df.collect())
    for condition in ("id < 100", "g IN (2, 3) AND x >= 40", "s = '77'", "x IS NOT NULL AND id > 990", "id > 5000", "s LIKE '9%'", "id = 3 OR id = 4", "more[0] = 6"):
        assert sorted(read.where(condition).collect()) == sorted(df.where(condition).collect()), condition
    # row groups that a filter excludes aren't read
    reader = shards.ShardReader(f"{tmp_path}/t", ".parquet", read.schema)
    kept = list(reader.pushFilters([shards.LessThan(("id",), 100), shards.EqualTo(("more", "x"), 1)]))
    assert len(kept) == 1 and len(reader.partitions()) == 1 and len(shards.ShardReader(f"{tmp_path}/t", ".parquet", read.schema).partitions()) == 4


def test_data_source_of_tables_and_missing_data(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for i in range(2):
        (tmp_path / "c" / f"m{i}.csv").write_text("id,split,x\n" + "".join(f"{i * 10 + k},{'train' if k % 2 else ''},{k}.5\n" for k in range(5)))
    read = shards.load_dataset(spark, f"{tmp_path}/c", "table")
    assert read.count() == 10 and read.where("id >= 10 AND split = 'train'").agg(F.sum("x")).first()[0] == 5.0
    (tmp_path / "empty").mkdir()
    for path, backend, told in ((f"{tmp_path}/none", "shards", "nothing is fetched"), (f"{tmp_path}/empty", "table", "nothing is fetched"), (f"{tmp_path}/c", "shards", "no .parquet data"), (f"{tmp_path}/c", "odd", "unknown backend")):
        with pytest.raises(Exception, match=told):
            shards.load_dataset(spark, path, backend).collect()
    with pytest.raises(Exception, match="never downloaded"):
        spark.read.format(shards.FORMAT).option("path", f"{tmp_path}/c").option("download", "true").load()


def test_path_policy(spark):
    cases = {
        "audits/a.csv": ("audits/a.csv", None), "\\audits\\x.json": ("audits/x.json", None), "/p0/./a//b": ("p0/a/b", None), "figures/final/a.png": ("figures/final/a.png", None),
        "figures/a.PNG": (None, "not a final figure"), "p0/.png": ("p0/.png", None), "audits/RAW/x": (None, "source data"), "wilds/x": (None, "outside the layout"), "": (None, "outside the layout"),
        None: (None, "outside the layout"), "Audits/x": (None, "outside the layout"), "logs": ("logs", None), "p0/x.tar.xml": (None, "not a final figure")}
    df = spark.createDataFrame([(c,) for c in cases], "path string")
    assert {r.path: (r.artifact_path, r.reason) for r in tables.artifact_paths(df).collect()} == cases


def test_standardizers_that_are_read(spark):
    good = [("a", 0.0, 1.0), ("b", 2.0, 0.0)]
    df = lambda rows: spark.createDataFrame(rows, "feature string, mean double, scale double")
    assert sorted(map(tuple, features.validated(df(good), ["a", "b"]).collect())) == good
    for rows, told in (([*good, ("c", 0.0, 1.0)], "unknown feature|lacks"), ([*good, good[0]], "repeats|lacks"), (good[:1], "lacks"), ([good[0], ("b", None, 1.0)], "invalid"),
                       ([good[0], ("b", 0.0, -1.0)], "invalid"), ([good[0], ("b", float("inf"), 1.0)], "invalid"), ([good[0], (None, 0.0, 1.0)], "unknown feature"), ([good[0], good[0]], "repeats")):
        with pytest.raises(Exception, match=told):
            features.validated(df(rows), ["a", "b"]).collect()


def test_tables_of_a_population(spark):
    one, two = spark.createDataFrame([(1, 2.0)], "seed int, v double"), spark.createDataFrame([(3, "x")], "seed int, w string")
    got = aggregation.population_tables({"p": {"t": one, "u": one}, "q": {"t": two}}, "h")
    assert set(got) == {"t", "u"}
    assert {(r.setting, r.seed, r.v, r.w, r.population) for r in got["t"].collect()} == {("p", 1, 2.0, None, "h"), ("q", 3, None, "x", "h")}
    runs = spark.createDataFrame([("a", 1, 0.5), ("a", 9, 0.1)], "setting string, seed int, v double")
    found = aggregation.robustness_by_seed(runs, spark.createDataFrame([("a", 1), ("b", 1)], "setting string, seed int"), "h", "net").collect()
    assert {(r.setting, r.status, r.v) for r in found} == {("a", "available", 0.5), ("b", "missing", None)}


def test_ids_that_are_kept(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "source_id long, v string")
    wanted = spark.createDataFrame([(1,), (1,), (7,), (None,)], "source_id long")
    assert [tuple(r) for r in tables.kept_ids(df, wanted).collect()] == [(1, "a")] and tables.rows_by_id(df, wanted).count() == 2


def test_stored_tables(spark):
    df = spark.createDataFrame([(1, [1, None])], "a int, b array<int>")
    assert storing.stored(df, "x").collect() == df.collect() and storing.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_gates_of_files_and_states(spark):
    want = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "path string")
    found = spark.createDataFrame([("a", 3), ("b", 0), ("z", 1)], "path string, bytes long")
    got = {r.check: r.passed for r in diagnostics.required_files(want, found).collect()}
    assert got == {"required_file:a": True, "required_file:b": False, "required_file:c": False}
    assert [r.passed for r in diagnostics.required_files(want.limit(0), found).collect()] == [False]
    good = diagnostics.recorded_state(spark, "h", "h", "c", False, {"unit_tests": "PASS", "roi_tests": "passed"})
    assert {r.check for r in good.collect() if r.passed} == {"protocol_hash", "git_clean", "unit_tests", "roi_tests"}
    for state in (("h", "g", "c", False), (None, None, "c", False), ("h", "h", None, False), ("h", "h", "c", None), ("h", "h", "c", True)):
        assert not all(r.passed for r in diagnostics.recorded_state(spark, *state).collect())
    told = lambda *t: {r.check: r.passed for r in diagnostics.gated(*t).collect()}["overall"]
    files = diagnostics.required_files(want.where("path = 'a'"), found)
    assert told(files, good) and told(diagnostics.gated(files), good) and not told(diagnostics.required_files(want, found), good) and not told(good.limit(0))
