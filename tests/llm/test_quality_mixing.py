"""The quality classifier on held-out rows; the mix of sources against its contract."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from swaplens.llm import mixing, quality

from swaplens.llm.shared import content_key

from .helpers import awkward, empty, table, words

LABELS = "doc_id long, quality int, toxic int"


def auroc(pairs):
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_quality(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    known = [(got[r.doc_id].score, r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in got and got[r.doc_id].held_out]
    assert auroc(known) > 0.9
    assert np.mean([(s >= 0.3) == (y == 1) for s, y in known]) > 0.85


def test_held_out_labels_and_other_columns_are_not_inputs(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    first = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    other = docs.withColumns({"lang": quality.F.lit("zz"), "source": quality.F.lit(None).cast("string"), "n_chars": quality.F.lit(0)}).repartition(7)
    assert {r.doc_id: r.score for r in quality.score_quality(other, flipped).collect()} == first


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, 0, 0), (6, 1, 0), (6, None, 0), (None, 1, 1), (99, 1, 0)], LABELS)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    same = defaultdict(set)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        same[texts[r.doc_id] or ""].add(r.score)
    assert all(len(s) == 1 for s in same.values())
    assert quality.score_quality(empty(spark), labels).count() == 0
    blank = quality.score_quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in blank} == {0.5}
    kept = quality.accepted(docs, labels)
    good = {r.doc_id for r in got if r.predicted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good


def test_attention_weighs_every_passage():
    """A bag's score depends on a passage at the very end of a long text."""
    rng = np.random.default_rng(1)
    good, bad = "calm words here and there. " * 2000, "$$ ## !! " * 40
    x, n = zip(*(quality.encode([t.encode()]) for t in [good[: 200 + 50 * i] + (bad if i % 2 else "") for i in range(60)]), strict=True)
    model = quality.fit(np.concatenate(x), np.array([int(k[0]) for k in n]), np.array([1.0 - i % 2 for i in range(60)]), epochs=80)
    def score(t):
        f, k = quality.encode([t.encode()])
        return quality._forward(model, f, np.array([0]), k)[-1][0]
    assert score(good) > 0.8 > score(good[:20_000] + bad * 3) + 0.1
    assert rng is not None


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left = budget - sum(target.values())
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return target


def check_mix(rows, docs):
    sizes = {r.doc_id: len(words(r.text)) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    by = Counter()
    for r in docs:
        by[r.source] += len(words(r.text))
    target, taken, most = plain_targets(dict(by)), Counter(), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.source_size == by[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s] + 1


def test_mix_meets_its_targets(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = mixing.mix(docs).collect()
    check_mix(rows, docs.collect())
    again = mixing.mix(docs.repartition(11)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_residuals_combine_through_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = spark.createDataFrame([(i, "w " * (1 + i * 37 % 90), "s" if i % 3 else None) for i in range(600)], "doc_id long, text string, source string")
    check_mix(mixing.mix(docs).collect(), docs.collect())


def test_pivotal_rounding_keeps_words_and_expectations():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 50, 40).astype(float)
    p0, hits = rng.random(40), np.zeros(40)
    for _ in range(3000):
        p = p0.copy()
        at = mixing._pivot(p, size, rng.random(40))
        assert abs((p * size).sum() - (p0 * size).sum()) < 1e-5
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != at)
        hits += p
    assert np.abs(hits / 3000 - p0).max() < 0.05


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark, [(11, "a b c", "en", None, 1), (12, None, None, None, None)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(empty(spark)).count() == 0
    unique = docs.dropDuplicates(["doc_id"])
    copies = {r.doc_id: r.copies for r in mixing.mix(unique).collect()}
    out = mixing.mixed_documents(unique)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({d: c for d, c in copies.items() if c})


def test_rows_that_share_an_id_or_have_none_keep_their_own_copies(spark):
    rows = [(i % 7 or None, "w " * (3 + i % 40), "s" if i % 3 else "t", i) for i in range(300)]
    rows += [(500, "same text", "u", 1000 + i) for i in range(40)] + [(None, "no id", None, 2000 + i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, number long")
    want = Counter()
    number = docs.select("number", *[c.alias(k) for c, k in zip(content_key(docs), ("k1", "k2"), strict=True)])
    for r in mixing._copies(docs, "doc_id", "text", "source", 20).join(number, ["k1", "k2"]).collect():
        want[r.number, r["size"]] += r["all"]
    out = mixing.mixed_documents(docs)
    got = out.collect()
    assert out.columns == docs.columns and {tuple(r) for r in got} <= set(rows)
    assert Counter((r.number, len(words(r.text))) for r in got) == +want
    sizes, taken, most = Counter(), Counter(), Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(words(text))
        most[source] = max(most[source], len(words(text)))
    for r in got:
        taken[r.source] += len(words(r.text))
    target = plain_targets(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= most[s] + 1 for s in target)


def test_rows_without_an_id_and_rows_that_agree_in_all_columns(spark):
    """What once multiplied: 10 rows without an id and one other; one row four times."""
    many = spark.createDataFrame([(None, f"t {i}", "s") for i in range(10)] + [(1, "x y z", "s")], "doc_id long, text string, source string")
    rows = many.selectExpr("*", "1 AS _id", "2 AS _copies", "3 AS k1", "4 AS times", "5 AS rows")
    out = mixing.mixed_documents(rows)
    assert out.columns == rows.columns and out.count() == sum(r.copies for r in mixing.mix(rows).collect())
    assert max(Counter(r.text for r in out.collect()).values()) <= 2
    same = spark.createDataFrame([(1, "x y z", "s")] * 4 + [(2, "a", "t")], "doc_id long, text string, source string")
    mixed = mixing.mix(same).collect()
    assert len(mixed) == 5 and all(r.taken <= 2 * r.size for r in mixed)
    assert mixing.mixed_documents(same).count() == sum(r.copies for r in mixed)


def test_very_many_copies_of_a_row(spark):
    from swaplens.llm import shared

    got = shared.repeated(spark.createDataFrame([(1, 5000), (2, 3), (3, 1024), (4, 0)], "part long, times long"), "times")
    assert Counter(r.part for r in got.collect()) == {1: 5000, 2: 3, 3: 1024}


def test_a_text_that_does_not_fit_switches_nothing_off(spark, small):
    """Longer than the bound, wherever it stands in the order: it is passed over, those after it are learned from."""
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    usable = labels.where(~quality.held_out(F.col("doc_id"))).select("doc_id")
    first = docs.join(usable, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("very long "), 30_000)).otherwise(F.col("text")))
    bound = 250_000
    known = {r.doc_id for r in quality._sample(long, labels, "doc_id", "text", "quality", 3000, bound).collect()}
    assert first not in known and len(known) > 20
    assert sum(len(r.text.encode()) for r in long.where(F.col("doc_id").isin(*known)).collect()) <= bound
    assert quality.train(long, labels, most_bytes=bound) is not None
    assert quality.train(long, labels, most_bytes=0) is None
