"""SimHash operators against plain Python: near duplicates, document fingerprints, Hamming search."""

import hashlib
import random

import pytest
import xxhash

from swaplens.llm import fingerprints, hamming, near_dedup, shingle_sets, simhash

from .helpers import PROSE, awkward, components, empty, table, words


def plain_fp(text, size=3):
    w = words(text)
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected_classes(rows):
    ids = {}
    prints = [(d, plain_fp(t)) for d, t in rows]
    for d, f in prints:
        if d is not None and (f not in ids or ids[f] is None or d < ids[f]):
            ids[f] = d
        ids.setdefault(f, None)
    root = components(sorted(ids), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for f, r in root.items():
        known = [x for x in (least.get(r), ids[f]) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((d, f"{f:016x}", least[root[f]]) for d, f in prints), key=repr)


def test_near_duplicates_match_brute_force(spark, tiny):
    docs = table(spark, tiny, "documents")
    got = near_dedup.near_duplicate_classes(docs).collect()
    assert sorted(map(tuple, got), key=repr) == expected_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_of_awkward_rows(spark):
    docs = awkward(spark)
    got = near_dedup.near_duplicate_classes(docs).collect()
    assert sorted(map(tuple, got), key=repr) == expected_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}  # texts without words link to one another
    kept = near_dedup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({r.component_id for r in got if r.component_id is not None})
    assert sum(r.doc_id is None for r in kept) == 1 and "score" in kept[0].asDict()
    assert near_dedup.near_duplicate_classes(empty(spark)).count() == 0


@pytest.mark.parametrize("segments", [2, 4])
def test_components_are_those_of_all_pairs(spark, segments):
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for c in centers for _ in range(8)}
    fps |= {(7 << 32) | i for i in range(300)}  # one segment value shared by many
    signed = [simhash.signed(f) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in hamming.components(hamming.links(df, 3, segments)).collect()}
    mask = (1 << 64) - 1
    want = components(sorted(signed), lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    assert {f: got.get(f, f) for f in signed} == want


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r.root for r in hamming.components(edges).collect()} == {0}


def test_large_buckets_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "CHUNK", 16)
    fps = [(5 << 32) | (i * 2654435761 % 4096) for i in range(200)]
    df = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")
    got = {r.node: r.root for r in hamming.components(hamming.links(df, 3, 2)).collect()}
    want = components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 3)
    assert {f: got.get(f, f) for f in set(fps)} == want


def test_fingerprints_and_edited_texts(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fingerprints.fingerprint_table(docs).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
        assert r.near_edited == 1 - bits(r.fingerprint, r.edited_fingerprint) / 64
        assert r.near_next == 1 - bits(r.fingerprint, got[rows[(i + 1) % len(rows)][0]].fingerprint) / 64
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.fingerprint == f"{plain_fp(t, fingerprints.TERM_WORDS):016x}"
    for d, r in got.items():
        near = sum(bits(r.fingerprint, x.fingerprint) <= 3 for x in got.values())
        assert r.n_near == (near if d % 100 == 0 else None)


def test_fingerprints_of_awkward_rows(spark):
    docs = awkward(spark)
    got = fingerprints.fingerprint_table(docs).collect()
    assert len(got) == docs.count() and all(len(r.fingerprint) == 16 for r in got)
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {"0" * 16}
    assert fingerprints.fingerprint_table(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert fingerprints.fingerprint_table(one).first().edited_sha256 == hashlib.sha256(b"a b c a").hexdigest()


def test_block_tables_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    index = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4)}
    df = lambda xs: spark.createDataFrame([(simhash.signed(x),) for x in xs], "fp long")
    got = {tuple(r) for r in fingerprints.search(df(index), df(base)).collect()}
    want = {(simhash.signed(q), simhash.signed(x)) for q in base for x in index if (q ^ x).bit_count() <= 3}
    assert got == want


def plain_similar(texts, at_least=0.8):
    """doc -> least doc that pairs of five-word similarity reach, all pairs tried."""
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for d, t in texts.items()}

    def linked(a, b):
        x, y = sorted((grams[a], grams[b]), key=len)
        return x == y or (len(x) >= at_least * len(y) and len(x & y) / len(x | y) >= at_least)

    return components(sorted(texts), linked)


def test_the_stage_links_all_pairs_of_the_similarity(spark, small):
    import corpus_pipeline

    docs = table(spark, small, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_similar(texts)
    assert {r.doc_id: r.component_id for r in near_dedup.similar_classes(docs).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, small).collect()} == set(want.values())


def test_similar_texts_at_the_threshold_with_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ONE_IN", 2)
    monkeypatch.setattr(near_dedup, "BROADCAST", 5)
    monkeypatch.setattr(shingle_sets, "SLICE", 700)
    rng = random.Random(8)
    line, texts = [f"l{i}" for i in range(12)], {}
    for d in range(240):
        base = [f"v{d // 12}x{i}" for i in range(60)] if d % 12 == 0 else base
        w = list(base[rng.randrange(4) : 60 - rng.randrange(4)])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
        texts[d] = " ".join(line + w if d % 2 else w[: rng.choice([3, 4, 5, 60])] + line)
    texts |= {900: None, 901: " ", 902: "a b", 903: "A  b", 904: "a c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_dedup.similar_classes(docs).collect()} == plain_similar(texts)
    odd = awkward(spark)
    kept = near_dedup.keep_one_similar(odd).collect()
    want = plain_similar({r.doc_id: r.text for r in odd.collect() if r.doc_id is not None})
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values())) and sum(r.doc_id is None for r in kept) == 1
    assert near_dedup.keep_one_similar(empty(spark)).count() == 0


CLASHING = ["_kept", "_rows", "_id", "_copies", "_leaked", "k1", "k2", "stays", "node", "root"]


def odd_ids(spark):
    """Several rows without an id, ids that like and unlike texts share, repeated rows, names that clash."""
    other, third = " ".join(f"o{i}" for i in range(80)), " ".join(f"t{i}" for i in range(80))
    rows = [(None, PROSE), (None, PROSE + " tail"), (None, other), (None, third), (3, other), (3, "short of words here now"), (3, third), (4, third),
            (5, PROSE), (5, PROSE), (5, other), (6, None), (6, ""), (None, None), (7, "only this one has these words")]
    df = spark.createDataFrame([(d, t, "s", i % 2 if d is None else 0) for i, (d, t) in enumerate(rows)], "doc_id long, text string, source string, n_chars long")
    return df.selectExpr("*", *[f"doc_id AS {c}" for c in CLASHING]).repartition(3)


@pytest.mark.parametrize("keep", [near_dedup.keep_one, near_dedup.keep_one_similar])
def test_one_row_of_each_class_stays_whatever_its_id(spark, keep):
    docs = odd_ids(spark)
    kept = keep(docs)
    got = sorted(((r.doc_id, (r.text or "")[:8]) for r in kept.collect()), key=repr)
    assert kept.columns == docs.columns and got == sorted([(5, PROSE[:8]), (3, "o0 o1 o2"), (3, "t0 t1 t2"), (3, "short of"), (6, ""), (7, "only thi")], key=repr)


def test_rows_that_agree_in_all_columns_stay_once(spark):
    docs = spark.createDataFrame([(1, PROSE)] * 3 + [(None, "a b c d e f")] * 2, "doc_id long, text string")
    assert sorted((r.doc_id or 0 for r in near_dedup.keep_one_similar(docs).collect())) == [0, 1]


def test_large_groups_meet_hubs_first(spark, monkeypatch):
    """With few members to a large group and two hubs at a time the rounds of hubs run, and the classes are those of all pairs: also for
    members that reach no hub, chains of similar texts, and groups that only share a line."""
    monkeypatch.setattr(near_dedup, "LARGE", 4)
    monkeypatch.setattr(near_dedup, "HUBS", 2)
    monkeypatch.setattr(near_dedup, "ONE_IN", 2)
    rng = random.Random(3)
    line, texts = [f"l{i}" for i in range(10)], {}
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(50)]
        for member in range(18):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(999)}"
            texts[len(texts)] = " ".join(line + w)
    chain = [f"c{i}" for i in range(60)]
    for step in range(15):
        chain = [*chain[1:], f"d{step}"]
        texts[len(texts)] = " ".join(chain)
    for alone in range(20):
        texts[len(texts)] = " ".join(line + [f"a{alone}x{i}" for i in range(40)])
    rounds = []
    materialize = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: rounds.append(name) or materialize(df, name))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_dedup.similar_classes(docs).collect()} == plain_similar(texts)
    assert len(rounds) > 8


def test_row_keys_tell_nulls_inside_values_and_take_maps(spark):
    rows = [(1, [None, 1], (None, 2), {"a": 1}), (1, [1, None], (None, 2), {"a": 1}), (1, [1], (None, 2), {"a": 1}), (1, [None, 1], (2, None), {"a": 1}),
            (1, [None, 1], (None, 2), {"a": None}), (1, [None, 1], None, {"a": 1}), (1, None, (None, 2), {"a": 1}), (1, [None, 1], (None, 2), None), (1, [], (None, 2), {})]
    kind = "k int, tags array<int>, s struct<x:int,y:int>, m map<string,int>"
    df = spark.createDataFrame(rows, kind).selectExpr("*", "struct(m AS inner, tags AS t) AS deep")
    from swaplens.llm.shared import content_key

    keys = [tuple(r) for r in df.select(*content_key(df)).collect()]
    assert len(set(keys)) == len(rows)
    again = [tuple(r) for r in df.union(df).select(*content_key(df)).collect()]
    assert set(again) == set(keys)
    # the same entries in another order are the same map
    two = [tuple(r) for r in spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)").transform(lambda d: d.select(*content_key(d))).collect()]
    assert two[0] == two[1]


def test_sizes_as_settings_write_them():
    from swaplens.llm import shared

    assert [shared._bytes(x) for x in ("64m", "4194304b", "10", "1g", "2kb", "-1", "3MiB")] == [64 << 20, 4 << 20, 10, 1 << 30, 2 << 10, -1, 3 << 20]


def test_ranges_cut_hot_keys_by_their_ties(spark):
    """Null and repeated keys are several ranges; bounds are values that occur, the first the least; thousands are planned at once."""
    import time

    from pyspark.sql import functions as F

    from swaplens.llm import shared

    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.when(F.col("id") % 4 == 1, F.lit(7).cast("long")).otherwise(F.col("id"))).alias("k"), F.xxhash64("id").alias("t"))
    bounds = shared.range_bounds(df, "k", "t", 40)
    rows = sorted(((r.k, r.t) for r in df.collect()), key=shared._nulls_first)
    assert bounds[0] == rows[0] and set(bounds) <= set(rows) and 30 <= len(bounds) <= 40 and sum(k is None for k, _ in bounds) >= 5
    index = {(r.k, r.t): r.i for r in df.select("k", "t", shared.range_index(F.col("k"), F.col("t"), bounds)[0].alias("i")).collect()}
    order = [index[r] for r in rows]
    assert order == sorted(order) and set(order) == set(range(1, len(bounds) + 1)) and max(order.count(i) for i in set(order)) < 350
    many = [(i, -i) for i in range(10_000)]
    began = time.time()
    big = spark.range(3).select(shared.range_index(F.col("id") * 4000, F.lit(0), many)[0].alias("i"))
    big._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5 and [r.i for r in big.collect()] == [1, 4001, 8001]
