"""Nearest donors, greedy pairs, caps: known answers and brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from swaplens.operators import cells, allocator, features, matching

BANK = "source_id long, split string, hospital_id int, label int, slide_id string, patient_id string, physical_id string, f1 double, f2 double"
FEATURES = ["f1", "f2"]


def donors(n=40, seed=1, hospitals=(0, 1), split="train"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h, label = hospitals[i % len(hospitals)], i // len(hospitals) % 2
        rows.append((i + 1, split, h, label, f"s{h}{i % 5}", None, f"slide:p{i % 13}", rng.choice([0.0, 0.5, 1.0, rng.random() * 3]), rng.random()))
    return rows


def bank_of(spark, rows):
    df = spark.createDataFrame(rows, BANK)
    return features.transform(df, features.fit_standardizer(df, FEATURES), FEATURES)


def plain_pools(z, source, hospital, split, pool, used=None, donor_cap=math.inf, slides=None, slide_cap=math.inf):
    group = [d for d in z if (d.hospital_id, d.label, d.split) == (hospital, source.label, split) and d.physical_id != source.physical_id and d.source_id != source.source_id]
    group = [d for d in group if (used or {}).get(d.source_id, 0) < donor_cap and (slides or {}).get(d.slide_id, 0) < slide_cap]
    dist = lambda d: round(math.sqrt((source.z_f1 - d.z_f1) ** 2 + (source.z_f2 - d.z_f2) ** 2), 9)
    return sorted(((dist(d), str(d.source_id), d) for d in group), key=lambda x: x[:2])[:pool]


def plain_match(z, sources, targets, rules):
    """The sequential definition: sources in order of (split, hospital, id), targets in list order."""
    used, slides, out, reasons = Counter(), Counter(), [], {}
    caps = (rules.donor_cap or math.inf, rules.slide_cap or math.inf)
    for s in sorted(sources, key=lambda s: (s.split, s.hospital_id, s.source_id)):
        for t in (t for t in targets if t != s.hospital_id):
            w = plain_pools(z, s, s.hospital_id, s.split, rules.pool, used, caps[0], slides, caps[1])
            c = plain_pools(z, s, t, "train" if s.split in ("val", "test") else s.split, rules.pool, used, caps[0], slides, caps[1])
            near = lambda p: [x for x in p if x[0] <= rules.tau_distance]
            reason = "no_within_candidate" if not w else "no_cross_candidate" if not c else None
            w, c = near(w), near(c)
            reason = reason or ("distance_threshold" if not w or not c else None)
            if not reason and min(len({x[2].slide_id for x in w}), len({x[2].slide_id for x in c})) < rules.min_slides:
                reason = "insufficient_donor_slide_diversity"
            chosen = []
            if not reason:
                pairs = []
                for dw, iw, a in w:
                    for dc, ic, b in c:
                        if abs(dw - dc) <= rules.tau_balance and a.physical_id != b.physical_id:
                            p = round(math.sqrt((a.z_f1 - b.z_f1) ** 2 + (a.z_f2 - b.z_f2) ** 2), 9)
                            pairs.append((round(dw + dc + rules.lambda_balance * abs(dw - dc) + rules.lambda_pair * p, 9), iw, ic, a, b))
                for _, _, _, a, b in sorted(pairs, key=lambda x: x[:3]):
                    if any(a.source_id == x.source_id or b.source_id == y.source_id for x, y in chosen):
                        continue
                    mine, yours = {x.slide_id for x, _ in chosen}, {y.slide_id for _, y in chosen}
                    if (len(mine) < rules.min_slides and a.slide_id in mine) or (len(yours) < rules.min_slides and b.slide_id in yours):
                        continue
                    count = lambda side, d: slides[d.slide_id] + sum(p[side].slide_id == d.slide_id for p in chosen)
                    if count(0, a) >= caps[1] or count(1, b) >= caps[1]:
                        continue
                    chosen.append((a, b))
                    if len(chosen) == rules.k:
                        break
                if len(chosen) < rules.k:
                    reason, chosen = "insufficient_balanced_pairs", []
            reasons[s.source_id, t] = reason
            for i, (a, b) in enumerate(chosen):
                out.append((s.source_id, t, i, a.source_id, b.source_id))
                for d in (a, b):
                    used[d.source_id] += 1
                    slides[d.slide_id] += 1
    return out, reasons


def check(spark, rows, rules, capped):
    z = bank_of(spark, rows)
    sources = z.where("hospital_id = 1")
    f = allocator.match_capped if capped else matching.match
    triplets, ledger = f(sources, z, FEATURES, rules, (0, 2))
    want, reasons = plain_match(z.collect(), sources.collect(), (0, 2), rules)
    got = [(r.source_id, r.target_hospital, r.donor_index, r.within_donor, r.cross_donor) for r in triplets.collect()]
    assert sorted(got) == sorted(want)
    assert {(r.source_id, r.target_hospital): r.exclusion_reason for r in ledger.collect()} == reasons
    return got, reasons


ROWS = donors(60, hospitals=(0, 1, 2))


@pytest.mark.parametrize("rules", [
    matching.Rules(k=2, pool=4), matching.Rules(k=3, pool=64, min_slides=2), matching.Rules(k=1, pool=64, tau_distance=0.8, tau_balance=0.3), matching.Rules(k=9, pool=64)])
def test_uncapped_matching_is_the_sequential_definition(spark, rules):
    check(spark, ROWS, rules, False)


@pytest.mark.parametrize("rules", [
    matching.Rules(k=2, pool=5, donor_cap=8), matching.Rules(k=1, pool=3, donor_cap=3), matching.Rules(k=2, pool=6, donor_cap=9, slide_cap=18, min_slides=2)])
def test_capped_matching_is_the_sequential_definition(spark, rules):
    got, _ = check(spark, ROWS, rules, True)
    used = Counter(d for r in got for d in r[3:])
    assert got and max(used.values()) <= rules.donor_cap


def test_lists_grow_until_pools_are_full(spark):
    check(spark, donors(420, hospitals=(0, 1, 2)), matching.Rules(k=1, pool=70, donor_cap=2, tau_distance=99.0), True)


def test_short_lists_are_made_longer_alone(spark, monkeypatch):
    looked = []
    keep = allocator.stored

    def counted(df, name):
        out = keep(df, name)
        looked.append((name, out.count()))
        return out

    monkeypatch.setattr(allocator, "stored", counted)
    monkeypatch.setattr(allocator, "LIST", 4)
    check(spark, ROWS, matching.Rules(k=1, pool=3, donor_cap=3, tau_distance=99.0), True)
    rows = lambda *names: [n for name, n in looked if name in names]
    assert sum(rows("longer")) > 0 and len(rows("lists")) == 1
    assert sum(rows("pools")) == sum(rows("units", "again"))


def test_infeasible_caps_raise_before_matching(spark):
    z = bank_of(spark, ROWS)
    with pytest.raises(ValueError, match="infeasible"):
        allocator.match_capped(z.where("hospital_id = 1"), z, FEATURES, matching.Rules(k=3, donor_cap=1), (0, 2))


def test_infeasible_caps_are_told_with_their_figures(spark):
    z = bank_of(spark, ROWS)  # 20 of each hospital
    with pytest.raises(ValueError) as error:
        allocator.match_capped(z.where("hospital_id = 1"), z, FEATURES, matching.Rules(k=3, donor_cap=1), (0, 2))
    told = str(error.value).split("before matching: ")[1].split("; ")
    assert sorted(told) == ["global:None requires 240, capacity 60", "hospital:0 requires 60, capacity 20", "hospital:1 requires 120, capacity 20", "hospital:2 requires 60, capacity 20"]


def test_prior_uses_count_against_the_caps(spark):
    z = bank_of(spark, ROWS)
    s = z.where("hospital_id = 1")
    rules = matching.Rules(k=1, pool=10, donor_cap=12)
    first, _ = allocator.match_capped(s, z, FEATURES, rules, (0, 2))
    hot = Counter(r.cross_donor for r in first.collect()).most_common(1)[0][0]
    prior = spark.createDataFrame([(hot, "other")] * 12, "donor_id long, slide_id string")
    again, _ = allocator.match_capped(s, z, FEATURES, rules, (0, 2), prior)
    assert hot not in {r.cross_donor for r in again.collect()}


def test_ties_break_by_id_as_text(spark):
    rows = [(100, "train", 0, 1, "s", None, "a", 0.0, 0.0)] + [(i, "train", 1, 1, f"t{i}", None, f"b{i}", 1.0, 0.0) for i in (9, 10, 2)]
    z = bank_of(spark, rows)
    asked = matching.requests(z.where("source_id = 100"), (1,))
    pool = matching.nearest(asked, z, FEATURES, 2).where("role = 'cross'").orderBy("rank").collect()
    assert [r.donor_id for r in pool] == [10, 2]
    raw = matching.nearest(asked, z, FEATURES, 2, by_string=False).where("role = 'cross'").orderBy("rank").collect()
    assert [r.donor_id for r in raw] == [2, 9]


def test_the_pool_is_cut_before_the_threshold(spark):
    """A full pool of near donors hides no reason; a pool beyond the threshold is a threshold."""
    rows = [(1, "train", 1, 0, "s", None, "p1", 0.0, 0.0), (2, "train", 1, 0, "t", None, "p2", 9.0, 9.0), (3, "train", 0, 0, "u", None, "p3", 0.1, 0.0), (4, "train", 0, 0, "v", None, "p4", 0.0, 0.1)]
    _, reasons = check(spark, rows, matching.Rules(k=1, pool=1, tau_distance=0.5), False)
    assert reasons[1, 0] == "distance_threshold" and reasons[1, 2] == "no_cross_candidate"


def plain_nearest(rows, asked, k, text):
    """Every request against its whole group."""
    out = set()
    for a in asked:
        group = [d for d in rows if (d.hospital_id, d.label, d.split) == (a.d_hospital, a.label, a.d_split)]
        near = []
        for d in group:
            distance = math.sqrt((a.z_f1 - d.z_f1) ** 2 + (a.z_f2 - d.z_f2) ** 2)
            if d.source_id != a.source_id and None not in (d.physical_id, a.physical_id) and d.physical_id != a.physical_id and math.isfinite(distance):
                near.append((round(distance, 9), str(d.source_id) if text else d.source_id, d.source_id))
        out |= {(a.source_id, a.role, a.d_hospital, d, rank + 1, distance) for rank, (distance, _, d) in enumerate(sorted(near)[:k])}
    return out


@pytest.mark.parametrize("size", [1, 7, 1024])
def test_cells_of_any_size_find_the_nearest(spark, monkeypatch, size):
    """Also with many equal vectors, ties, groups that are absent, missing identities and values that aren't finite."""
    monkeypatch.setattr(cells, "CHUNK", 5)
    rows = donors(150)
    rows += [(1000 + i, "train", i % 2, i % 2, f"s{i}", None, f"same{i % 30}", 0.5, -0.25) for i in range(60)]
    rows += [(2000, "train", 0, 0, "s", None, "p", 1.0, 0.0), (2001, "train", 1, 1, "s", None, "p", 40.0, -40.0), (2002, "val", 7, 0, "s", None, "q", 0.1, 0.1)]
    z = bank_of(spark, rows)
    z = z.withColumn("physical_id", F.when(F.col("source_id") % 41 != 0, F.col("physical_id"))).withColumn("z_f1", F.when(F.col("source_id") == 2000, F.lit(float("nan"))).otherwise(F.col("z_f1")))
    asked = matching.requests(z, (0, 1, 5))
    for text in (True, False):
        got = {(r.source_id, r.role, r.d_hospital, r.donor_id, r.rank, r.distance) for r in matching.nearest(asked, z, FEATURES, 5, by_string=text, size=size).collect()}
        assert got == plain_nearest(z.collect(), asked.collect(), 5, text)
    assert matching.nearest(asked, z.limit(0), FEATURES, 5, size=size).count() == 0 == matching.nearest(asked.limit(0), z, FEATURES, 5, size=size).count()


def test_cells_are_bounded_and_few_are_visited(spark):
    """No block is larger than twice its size, even of one vector alone, and the tree leaves most pairs out."""
    import random

    rng = random.Random(5)
    rows = [(i, "train", 0, 0, "s", None, f"p{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(2000)] + [(5000 + i, "train", 0, 0, "s", None, f"q{i}", 3.0, 3.0) for i in range(900)]
    z = bank_of(spark, rows)
    d = z.selectExpr("hospital_id AS g", "source_id AS donor_id", "z_f1", "z_f2")
    steps, placed = cells._tree(d, ["g"], ["z_f1", "z_f2"], 32)
    dealt = cells._parts(placed, ["g", "cell"], 64, F.col("donor_id")).groupBy("cell", "part").count()
    assert len(steps) >= 2 and dealt.agg(F.max("count")).first()[0] <= 130 and dealt.agg(F.sum("count")).first()[0] == 2900
    asked = matching.requests(z.where("source_id < 40"), ())
    found = matching.nearest(asked, z, FEATURES, 3, size=32).select("source_id", "donor_id", "rank").collect()
    assert {(r.source_id, r.donor_id, r.rank) for r in found} == {(x[0], x[3], x[4]) for x in plain_nearest(z.collect(), asked.collect(), 3, True)}


def test_standardizer(spark):
    df = spark.createDataFrame([("train", 0.0, 3.0), ("train", 20.0, 3.0), ("val", 500.0, 4.0)], "split string, f1 double, f2 double")
    fit = features.fit_standardizer(df, FEATURES)
    assert {r.feature: (r.mean, r.scale) for r in fit.collect()} == {"f1": (10.0, 10.0), "f2": (3.0, 0.0)}
    assert [(r.z_f1, r.z_f2) for r in features.transform(df, fit, FEATURES).collect()] == [(-1.0, 0.0), (1.0, 0.0), (49.0, 1.0)]
    bad = df.withColumn("f1", F.when(F.col("f2") == 3, F.lit(float("nan"))).otherwise(F.col("f1")))
    with pytest.raises(Exception, match="not finite"):
        features.fit_standardizer(bad, FEATURES).collect()


def test_random_pairs_are_deterministic_and_eligible(spark):
    z = bank_of(spark, ROWS)
    a, b = (sorted(map(tuple, matching.random_pairs(df.where("hospital_id = 1"), df, (0, 2), 3, 7).collect())) for df in (z, z.repartition(5)))
    by = {r.source_id: r for r in z.collect()}
    assert a == b and a
    for s, _, _, t, label, w, c, _ in a:
        assert by[w].hospital_id == 1 and by[c].hospital_id == t and by[w].label == by[c].label == label and by[w].physical_id != by[s].physical_id != by[c].physical_id


def test_keyed_permutations_hold_every_place_once(spark):
    for width in (1, 2, 4):
        df = spark.range(4**width).select(F.col("id").alias("j"), F.lit(width).alias("w"))
        places = [sorted(r[0] for r in df.select(matching.keyed_permutation(F.col("j"), F.col("w"), 7, F.lit(key))).collect()) for key in (1, 2)]
        assert places == [list(range(4**width))] * 2
    orders = {tuple(r[0] for r in df.orderBy("j").select(matching.keyed_permutation(F.col("j"), F.col("w"), 7, F.lit(key))).collect()) for key in range(5)}
    assert len(orders) == 5


def test_random_pairs_exhaust_small_groups_and_are_even(spark):
    """Groups with just enough eligible donors serve everybody, those with fewer nobody; no donor is drawn twice or far more often than others."""
    rows = [(i, "train", 0, 0, "s", None, "own" if i < 40 else f"d{i}", 0.0, 0.0) for i in range(43)]  # 40 sources that bar each other, 3 donors
    rows += [(100 + i, "train", 1, 0, "s", None, f"e{i}", 0.0, 0.0) for i in range(50)] + [(200 + i, "train", 2, 0, "s", None, f"f{i}", 0.0, 0.0) for i in range(2)]
    z = bank_of(spark, rows)
    got = matching.random_pairs(z.where("source_id < 40"), z, (1, 2), 3, 7).collect()
    assert {r.target_hospital for r in got} == {1} and len(got) == 40 * 3
    for s in range(40):
        assert {r.within_donor for r in got if r.source_id == s} == {40, 41, 42} and len({r.cross_donor for r in got if r.source_id == s}) == 3
    used = Counter(r.cross_donor for r in got)
    assert len(used) > 35 and max(used.values()) < 10


def test_unknown_levels_never_look_like_success(spark):
    assert matching.level_status(spark, 6, [], ["stain"]).first().status == "unavailable"
    assert matching.level_status(spark, 5, ["x"], ["x"]).first().status == "not_implemented"
    with pytest.raises(ValueError):
        matching.level_status(spark, 4, [], [])


def test_alike_donors_leave_few_pairs_and_the_same_choice(spark):
    """Copies tie in all their pairs: of 40 x 40 few may leave the matrix, and the choice is still the sequential one."""
    same = lambda first, hospital, x: [(first + i, "train", hospital, 1, f"s{i % 3}", None, f"{hospital}-{i % 7}", x, 0.0) for i in range(40)]
    rows = [(1, "train", 1, 1, "s", None, "own", 0.0, 0.0), *same(100, 1, 0.25), *same(200, 0, -0.25)]
    z, rules = bank_of(spark, rows), matching.Rules(k=3, pool=64)
    one = z.where("source_id = 1")
    units = matching.unit_candidates(matching.nearest(matching.requests(one, (0,)), z, FEATURES, rules.pool), FEATURES, rules, (0,)).collect()
    assert [(u.source_id, u.target_hospital, u.n_w, u.n_c) for u in units] == [(1, 0, 40, 40)] and 3 <= len(units[0].pairs) <= 36
    check(spark, rows, rules, False)


def test_a_chunk_passes_on_few_rows_and_every_request_is_bounded(spark, monkeypatch):
    """Copies in many blocks: what leaves the search is k rows a request, not k of each block; and where a cell
    holds fewer than k donors the cells above bound a request, so that it doesn't meet the whole group."""
    monkeypatch.setattr(cells, "CHUNK", 8)
    rng = random.Random(9)
    points = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(60)]
    rows = [(100 * i + c, "train", 0, 0, "s", None, f"p{i}-{c}", x, y) for i, (x, y) in enumerate(points) for c in range(30)]
    z = bank_of(spark, rows)
    asked = matching.requests(z.where("source_id % 100 < 3"), ())
    s, d = matching._grouped(asked, z, FEATURES)
    index = cells._Index(s, d, matching.GROUP, FEATURES, F.col("donor_id").cast("string"), 8)
    bounded = index.bounded(16)
    assert bounded.count() == 180 and bounded.where("kth IS NULL").count() == 0
    chunks = index.chunks(bounded, index.size_up(8), 8)
    visits = index.reached(chunks)
    found = index.met(chunks, visits, lambda b, t: cells._search(b, 2, 16, t), "source_id", "role", "d_hospital", "donor_id", "distance")
    assert found.count() == 180 * 16
    assert visits.count() < chunks.count() * index.blocks.count() / 2
    got = {(r.source_id, r.donor_id, r.rank) for r in matching.nearest(asked, z, FEATURES, 16, size=8).select("source_id", "donor_id", "rank").collect()}
    assert got == {(x[0], x[3], x[4]) for x in plain_nearest(z.collect(), asked.collect(), 16, True)}


def test_all_within_a_radius_are_found_whatever_the_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "WIDE", 5)
    rows = donors(150) + [(1000 + i, "train", i % 2, i % 2, f"s{i}", None, f"same{i % 30}", 0.5, -0.25) for i in range(60)]
    z = bank_of(spark, rows)
    asked = matching.requests(z, (0, 1, 5))
    s, d = matching._grouped(asked, z, FEATURES)
    want = {(x[0], x[1], x[2], x[3], x[5]) for x in plain_nearest(z.collect(), asked.collect(), 10_000, True) if x[5] <= 0.75}
    for size in (1, 7, 1024):
        got = cells.within(s, d, matching.GROUP, FEATURES, 0.75, F.col("donor_id"), size).collect()
        assert len(got) == len(want) and {(r.source_id, r.role, r.d_hospital, r.donor_id, r.distance) for r in got} == want


def test_pairs_search_pools_once(spark):
    """Pairs of a within and a cross donor come from one reading of the pools."""
    z, rules = bank_of(spark, ROWS), matching.Rules(pool=4, tau_distance=99.0, tau_balance=99.0)
    one = z.where("hospital_id = 1")
    pools = matching.nearest(matching.requests(one, (0, 2)), z, FEATURES, rules.pool)
    pairs = matching.pair_candidates(one, pools, FEATURES, rules, (0, 2))
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == pools._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    rows = pools.collect()
    want = {(w.source_id, c.d_hospital, w.donor_id, c.donor_id) for w in rows for c in rows if (w.role, c.role, w.source_id) == ("within", "cross", c.source_id) and w.d_physical != c.d_physical}
    got = [(r.source_id, r.target_hospital, r.within_donor, r.cross_donor) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want


def test_pairs_of_a_large_group_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(features, "PART", 3)
    z = bank_of(spark, ROWS).withColumn("label", F.when(F.col("source_id") % 9 != 0, F.lit(1)))
    found = features.pair_distances(z.where("source_id <= 30"), z, ["label"], FEATURES)
    got = [(r.source_id, r.donor_id) for r in found.collect()]
    known = [r.source_id for r in z.where("label = 1").collect()]
    assert sorted(got) == sorted((s, d) for s in known if s <= 30 for d in known)
    assert found.rdd.mapPartitions(lambda rows: [len(list(rows))]).filter(lambda n: n > 0).count() > 1


def test_pairs_come_by_candidate_and_equal_vectors_lie_together(spark, monkeypatch):
    monkeypatch.setattr(features, "PART", 16)
    rows = [(i, "train", 0, 1 if i < 64 else None, "s", None, f"p{i}", float(i % 4), float(i % 2)) for i in range(70)]
    z = bank_of(spark, rows)
    parts = features.pair_distances(z, z, ["slide_id", "label"], FEATURES).rdd.mapPartitions(lambda it: [[tuple(r) for r in it]]).collect()
    got = {(s, d): x for part in parts for s, d, x in part}
    assert sum(map(len, parts)) == len(got) == 64 * 64
    scale = {r.source_id: [r[f"z_{c}"] for c in FEATURES] for r in z.where("label = 1").collect()}
    assert all(abs(x - math.dist(scale[s], scale[d])) < 1e-8 for (s, d), x in got.items())
    # a candidate meets a block of 16 sources, which are alike here, as 16 of each vector are
    assert sum(a[1:] != b[1:] for part in parts for a, b in zip(part, part[1:], strict=False)) < 64 * 64 / 16
