"""Diagnostics, sampling, metadata and experiment aggregation: known answers."""

import hashlib
import pytest
from pyspark.sql import functions as F

from swaplens.functions import columns, ordering
from swaplens.operators import aggregation, diagnostics, metadata, sampling

DESC = "source_id long, hospital_id int, slide_id string, label int, f1 double, f2 double"
TRIPLETS = "source_split string, source_hospital int, target_hospital int, within_donor long, within_slide string, cross_donor long, cross_slide string"


@pytest.fixture(scope="module")
def desc(spark):
    return spark.createDataFrame([(10, 1, "s1", 0, 0.0, 3.0), (11, 1, "s2", 0, 4.0, 3.0), (20, 0, "s3", 0, 10.0, 3.0), (21, 0, "s4", 0, 6.0, 5.0)], DESC)


@pytest.fixture(scope="module")
def triplets(spark):
    return spark.createDataFrame([("val", 1, 0, 10, "s1", 20, "s3"), ("val", 1, 0, 11, "s2", 21, "s4")], TRIPLETS)


def scale(spark, **by):
    return spark.createDataFrame([(c, 0.0, s) for c, s in by.items()], "feature string, mean double, scale double")


def test_feature_balance_is_on_the_training_scale(spark, desc, triplets):
    got = {r.feature: (r.paired_smd, r.paired_smd_status) for r in diagnostics.feature_balance(triplets, desc, ["f1", "f2"], scale(spark, f1=10.0, f2=0.0)).collect()}
    assert got == {"f1": (0.6, "estimable"), "f2": (None, "non_estimable_zero_train_scale")}
    equal = diagnostics.feature_balance(triplets.where("within_donor = 10"), desc, ["f2"], scale(spark, f2=0.0)).first()
    assert (equal.paired_smd, equal.paired_smd_status) == (0.0, "zero_train_scale_equal_values")
    lost = triplets.withColumn("cross_donor", F.lit(99).cast("long"))
    with pytest.raises(Exception, match="finite descriptor"):
        diagnostics.feature_balance(lost, desc, ["f1"], scale(spark, f1=1.0)).collect()


def test_reuse(spark, desc, triplets):
    rows = diagnostics.slide_reuse_summary(triplets, desc).collect()
    total = next(r for r in rows if r.row_type == "summary")
    assert (total.effective_donor_slide_count, total.maximum_slide_share, total.total_donor_uses, total.unique_donor_slides) == (4.0, 0.25, 4, 4)
    twice = diagnostics.donor_reuse_distribution(triplets.union(triplets.limit(1)), desc).first()
    assert (twice.n_unique_donors, twice["max"], twice["median"]) == (4, 2.0, 1.5)
    none = diagnostics.donor_reuse_distribution(triplets.limit(0), desc).first()
    assert (none.n_unique_donors, none["max"]) == (0, None)
    kinds = [r.row_type for r in diagnostics.donor_reuse_summary(triplets, desc).collect()]
    assert kinds.count("donor") == 4 and kinds.count("summary") == 6


def test_distance_balance(spark):
    schema = "source_split string, source_hospital int, target_hospital int, matching_distance_within double, matching_distance_cross double, matching_distance_pair double"
    df = spark.createDataFrame([("val", 1, 0, 1.0, 2.0, 0.5), ("val", 1, 0, 3.0, 6.0, 1.5)], schema)
    r = diagnostics.balance_summary(df).first()
    assert r.paired_smd == pytest.approx(2.0 / (14.0 / 3) ** 0.5) and (r.within_median, r.cross_mean, r.mean_pair_distance) == (2.0, 4.0, 1.0)
    same = diagnostics.balance_summary(df.withColumn("matching_distance_cross", F.col("matching_distance_within")).limit(1)).first()
    assert same.paired_smd == 0.0
    one = diagnostics.balance_summary(df.limit(1)).first()
    assert one.paired_smd is None and one.n_triplets == 1  # no scale in one triplet


LEDGER = "source_id long, source_split string, source_hospital int, target_hospital int, coverage_status string, exclusion_reason string"


def test_coverage(spark):
    df = spark.createDataFrame([(1, "val", 1, 0, "accepted", None), (1, "val", 1, 3, "excluded", "distance_threshold"), (2, "val", 1, 0, "accepted", None), (2, "val", 1, 3, "accepted", None)], LEDGER)
    assert {r.target_hospital: r.coverage for r in diagnostics.directed_coverage(df).collect()} == {0: 1.0, 3: 0.5}
    marked = diagnostics.annotate_common_support(df)
    assert {(r.source_id, r.common_support) for r in marked.collect()} == {(1, False), (2, True)}
    assert diagnostics.common_support_coverage(marked).first().coverage == 0.5
    assert {(r.target_hospital, r.exclusion_reason, r.n) for r in diagnostics.attrition(df).collect()} == {(0, "accepted", 2), (3, "accepted", 1), (3, "distance_threshold", 1)}
    assert not diagnostics.coverage_gate(diagnostics.directed_coverage(df)).first().passed
    assert not diagnostics.coverage_gate(diagnostics.directed_coverage(df.limit(0))).first().passed  # nothing fails


# --- sampling -----------------------------------------------------------------------------------------

def test_largest_remainder(spark):
    cells = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 0)], "k string, n int")
    got = {r.k: r.quota for r in sampling.largest_remainder(cells, ["k"], "n", 7).collect()}
    assert got == {"a": 3, "b": 2, "c": 2, "d": 0} and sum(got.values()) == 7
    tie = {r.k: r.quota for r in sampling.largest_remainder(cells.where("k IN ('b', 'c')"), ["k"], "n", 3).collect()}
    assert tie == {"b": 2, "c": 1}


def test_audit_subset(spark):
    rows = [(i, i % 2, f"s{i % 5}" if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "source_id long, label int, source_slide string")
    got = sampling.audit_subset(df, 50, 1).collect()
    assert len(got) == 50 == len({r.source_id for r in got})
    assert sampling.audit_subset(df.repartition(7), 50, 1).orderBy("source_id").collect() == sorted(got, key=lambda r: r.source_id)
    assert sampling.audit_subset(df, 500, 1).count() == 200
    for label in (0, 1):
        assert abs(sum(r.label == label for r in got) - 25) <= 6
    assert {r.source_id for r in sampling.audit_subset(df, 50, 2).collect()} != {r.source_id for r in got}


def test_permutations_keep_counts(spark):
    df = spark.createDataFrame([(i, i % 3, i * i) for i in range(60)], "source_id long, k int, v long")
    for out in (sampling.permuted(df, "v", 3, strata=["k"]), sampling.permuted(df, "v", 3)):
        rows = out.collect()
        assert sorted(r.v for r in rows) == sorted(r.permuted_v for r in rows) == [i * i for i in range(60)]
        assert any(r.v != r.permuted_v for r in rows) and all(r.v == r.source_id**2 for r in rows)
    for k in range(3):
        inside = [r for r in sampling.permuted(df, "v", 3, strata=["k"]).collect() if r.k == k]
        assert sorted(r.v for r in inside) == sorted(r.permuted_v for r in inside)


def test_permutations_of_a_hot_stratum_follow_the_hash(spark):
    """The i-th row by key gets the value of the i-th by hash, in each stratum, one of which holds most rows."""
    rows = [(i * 7 % 500, 0 if i % 5 else i % 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "source_id long, k int, v long").repartition(6)
    order = lambda i: (hashlib.md5(f"3|{i}".encode()).hexdigest(), i)
    want = {}
    for k in (0, 1, 2):
        own = [(i, v) for i, g, v in rows if g == k]
        values = [v for _, v in sorted(own, key=lambda x: order(x[0]))]
        want |= dict(zip(sorted(i for i, _ in own), values, strict=True))
    assert {r.source_id: r.permuted_v for r in sampling.permuted(df, "v", 3, strata=["k"]).collect()} == want


def test_least_of_what_follows(spark):
    import random

    rng = random.Random(1)
    rows = [(i, i % 2, rng.randrange(1000)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, g int, v long").repartition(5)
    got = ordering.least_from(df, ["k"], F.col("v"), ordering.value_bucket(df, "k"), "m", ["g"]).collect()
    assert len(got) == 120 and all(r.m == min(v for k, g, v in rows if g == r.g and k >= r.k) for r in got)


def test_ranks_and_running_totals_over_a_whole_table(spark):
    rows = [(i * 37 % 100, i * 37 % 100 % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, g int").repartition(7)
    assert all(r._r == r.k for r in ordering.ranked(df, ["k"], ordering.value_bucket(df, "k")).collect())
    sums = ordering.before(df, ["k"], F.col("k"), ordering.value_bucket(df, "k"), "s", ["g"]).collect()
    assert all(r.s == sum(k for k, g in rows if g == r.g and k < r.k) for r in sums)
    hashed = df.withColumn("h", columns.hash_order(1, F.col("k")))
    got = sorted(ordering.ranked(hashed, ["h", "k"], ordering.hash_bucket(F.col("h"))).collect(), key=lambda r: r._r)
    assert [r.h for r in got] == sorted(r.h for r in got) and [r._r for r in got] == list(range(100))


BANK = "source_id long, label int, hospital_id int, physical_id string, slide_id string"


def test_context_assignments(spark):
    bank = spark.createDataFrame([(i, i % 2, i % 3, f"p{i // 2}", f"s{i}") for i in range(8)], BANK)
    got = sampling.independent_assignments(bank, bank, 11, 2).collect()
    by = {r.source_id: r for r in bank.collect()}
    assert len(got) == 8 and all(by[r.source_id].physical_id != r.donor_physical_id and r.source_id != r.donor_source_id for r in got)
    uses = [r.donor_source_id for r in got]
    assert max(map(uses.count, uses)) <= 2
    assert sampling.independent_assignments(bank.repartition(3), bank.repartition(2), 11, 2).orderBy("source_id").collect() == sorted(got, key=lambda r: r.source_id)
    diagnosed = sampling.assignment_diagnostics(spark.createDataFrame(got)).collect()
    assert sum(r.n for r in diagnosed) == 8 and {r.max_donor_reuse for r in diagnosed} == {max(map(uses.count, uses))}
    with pytest.raises(ValueError, match="capacity"):
        sampling.independent_assignments(bank, bank.limit(3), 11, 2)
    with pytest.raises(ValueError, match="no independent"):
        sampling.independent_assignments(bank.limit(1), bank.where("physical_id = 'p0'"), 11, 2)


@pytest.mark.parametrize("offered", [1, 16])
def test_tight_assignments_are_found_by_exchanges(spark, monkeypatch, offered):
    """One identity holds half of all sources and no place is to spare: all of its sources must have places of the others and the reverse."""
    monkeypatch.setattr(sampling, "OFFERED", offered)
    rows = [(i, 0, 0, "hot" if i < 40 else f"p{i}", f"s{i}") for i in range(80)]
    bank = spark.createDataFrame(rows, BANK)
    for seed in (1, 2):
        got = sampling.independent_assignments(bank, bank, seed, 1).collect()
        assert sorted(r.source_id for r in got) == sorted(r.donor_source_id for r in got) == list(range(80))
        assert all((r.source_id < 40) == (r.donor_source_id >= 40) for r in got)
    # one more of the identity, and nothing can serve all
    more = bank.union(spark.createDataFrame([(99, 0, 0, "hot", "s")], BANK))
    with pytest.raises(ValueError, match="no independent"):
        sampling.independent_assignments(more, more, 1, 1)
    # a missing identity can't be told from the donor's
    with pytest.raises(ValueError, match="no independent"):
        sampling.independent_assignments(bank.limit(1).withColumn("physical_id", F.lit(None).cast("string")), bank, 1, 1)
    assert sampling.independent_assignments(bank.limit(0), bank, 1, 1).count() == 0


# --- metadata -------------------------------------------------------------------------------------------

def test_identities(spark):
    raw = spark.createDataFrame([(1, "train", 0, "a", "P1", 1), (2, "val", 1, "b", "nan", 0), (3, "val", 1, "c", None, 0)], "id long, split string, hospital int, slide string, patient string, y int")
    got = {r.source_id: (r.patient_id, r.physical_id) for r in metadata.canonicalize(raw).collect()}
    assert got == {1: ("P1", "patient:P1"), 2: (None, "slide:b"), 3: (None, "slide:c")}
    assert metadata.duplicate_ids(metadata.canonicalize(raw)).count() == 0
    with pytest.raises(KeyError):
        metadata.canonicalize(raw.drop("slide"))
    with pytest.raises(Exception, match="neither"):
        raw.select(columns.physical_cluster(F.lit(""), F.lit(None))).collect()


def test_slide_mapping_keeps_what_is_ambiguous_or_absent(spark):
    m = spark.createDataFrame([("s1", "val", 1), ("s2", "val", 1), ("s3", "val", 1)], "slide_id string, split string, hospital_id int")
    files = spark.createDataFrame([("s1", "w1"), ("s2", "w2"), ("s2", "w3")], "wilds_slide_id string, camelyon_wsi string")
    got = {r.slide_id: (r.mapping_status, r.camelyon_wsi, r.candidates) for r in metadata.map_slides(m, files).collect()}
    assert got == {"s1": ("mapped", "w1", "w1"), "s2": ("ambiguous", None, "w2;w3"), "s3": ("unmapped", None, "")}


PATCH = "source_id long, label int, split string, hospital_id int, slide_id string, patient_id string, x_coord int, y_coord int"


@pytest.mark.parametrize(("change", "status"), [
    ({}, "mapped"), ({"patch_size": None}, "unavailable"), ({"level": None}, "unavailable"), ({"orientation": "flip"}, "unavailable"), ({"reference": "center"}, "unavailable"), ({"scale": 0.0}, "unavailable")])
def test_patch_mapping_needs_every_setting(spark, change, status):
    m = spark.createDataFrame([(1, 1, "val", 1, "s1", "p", 3, 4)], PATCH)
    slides = spark.createDataFrame([("s1", "mapped", "", "w1", "/w1.tif", None)], "slide_id string, mapping_status string, mapping_reason string, camelyon_wsi string, wsi_path string, annotation_path string")
    files = spark.createDataFrame([("/w1.tif",), ("/x/W1.xml",)], "path string")
    settings = {"patch_size": 96, "scale": 1.0, "level": 0, "orientation": "identity", "reference": "top_left"} | change
    r = metadata.patch_mapping(m, slides, files, **settings).first()
    assert r.mapping_status == status and r.annotation_path == "/x/W1.xml"


# --- experiments ----------------------------------------------------------------------------------------

RUNS = "backbone string, seed int, split string, run_status string, run_seed int, dataset_version string, architecture string, config_hash string, tables array<string>, run_path string"


def test_every_run_that_does_not_count_is_listed(spark):
    ok = ("r", 1, "val", "completed", 1, "v1", "r", "c", ["a", "b"], "/1")
    variants = [dict(zip(("backbone", "seed", "split", "run_status", "run_seed", "dataset_version", "architecture", "config_hash", "tables", "run_path"), ok, strict=True)) for _ in range(8)]
    for i, change in enumerate([{}, {"run_status": "failed"}, {"run_seed": 77}, {"dataset_version": "v0"}, {"architecture": "x"}, {"config_hash": "d"}, {"tables": ["a"]}, {"run_status": None}]):
        variants[i] |= {"seed": i + 1, "run_seed": i + 1, "run_path": f"/{i + 1}"} | change
    runs = spark.createDataFrame([tuple(v.values()) for v in variants], RUNS)
    expected = spark.createDataFrame([("r", i, "val") for i in range(1, 10)], "backbone string, seed int, split string")
    ledger = aggregation.run_ledger(expected, runs, {"r": "v1"}, "c", ["a", "b"])
    got = {r.seed: (r.status, r.reason) for r in ledger.collect()}
    assert got[1] == ("completed", "") and got[9][0] == "missing" and {got[i][0] for i in range(2, 9)} == {"invalid"} and "b" in got[7][1]
    table = spark.createDataFrame([("r", i, 1.0) for i in range(1, 10)], "backbone string, seed int, v double")
    kept = aggregation.stamped(aggregation.completed_only(table, ledger), ledger).collect()
    assert len(kept) == 1 and (kept[0].number_expected_runs, kept[0].number_completed_runs, kept[0].run_status) == (9, 1, "incomplete")
    assert aggregation.missing_runs(ledger, "val").count() == 8
    fine = ledger.where("status = 'completed'")
    assert aggregation.missing_runs(fine, "val").first().status == "complete"
    assert aggregation.stamped(table.limit(0), fine).first().run_status == "complete"  # an empty table says so


def test_seed_stability_of_one_seed_has_no_deviation(spark):
    df = spark.createDataFrame([("val", "r", 1, 0, 1, 2.0, 3.0)], "source_split string, backbone string, source_hospital int, target_hospital int, seed int, hcs double, hce double")
    rows = {r.metric: (r.n_seeds, r.mean, r.std, r.status) for r in aggregation.seed_stability(df, {"r": 2}).collect()}
    assert rows == {"directed_hcs": (1, 2.0, None, "unavailable"), "directed_hce": (1, 3.0, None, "unavailable")}


def test_preflight_fails_closed(spark, desc, triplets):
    ledger = spark.createDataFrame([(1, "val", 1, 0, "accepted", None)], LEDGER)
    marked = diagnostics.annotate_common_support(ledger)
    balance = spark.createDataFrame([(0.05, 3)], "paired_smd double, n_triplets long")
    by_feature = spark.createDataFrame([("f1", 0.05), ("f2", 0.0)], "feature string, paired_smd double")
    reuse = diagnostics.donor_reuse_detail(triplets, desc)
    run = lambda **x: {r.check: r.passed for r in diagnostics.preflight(**({
        "descriptors": desc, "features": ["f1", "f2"], "coverage": diagnostics.directed_coverage(ledger), "common": diagnostics.common_support_coverage(marked),
        "balance": balance, "by_feature": by_feature, "donor_reuse": reuse, "expected_pairs": [("val", 1, 0)]} | x)).collect()}
    assert all(run().values())
    for change in ({"balance": balance.limit(0)}, {"by_feature": by_feature.limit(0)}, {"expected_pairs": [("val", 1, 3)]}, {"donor_cap": 0}, {"descriptors": desc.limit(0)},
                   {"coverage": diagnostics.directed_coverage(ledger.limit(0))}, {"descriptors": desc.withColumn("f1", F.lit(float("nan")))}):
        got = run(**change)
        assert not got["overall"], change
