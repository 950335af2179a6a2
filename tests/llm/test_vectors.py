"""Vector codes and exact search against every distance and every score."""

import hashlib
import math
import random

import numpy as np
import pytest

from swaplens.llm import exact_topk, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def awkward_vectors(n=260, width=32, seed=3):
    """Nulls, non-finite components, repeated ids and rows, many equal vectors, clusters."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.4, (5, width))
    rows = [(i * 3 - 60, (centers[i % 5] + rng.normal(0, 0.1, width)).astype(np.float32).tolist(), i % 4 if i % 9 else None) for i in range(n)]
    rows += [(1000 + i, [0.25] * width, 1) for i in range(80)]
    bad = [[*[0.1] * (width - 1), x] for x in (None, math.nan, math.inf, -math.inf)]
    rows += [(20, None, 1), *[(40 + 20 * i, b, 1) for i, b in enumerate(bad)], (None, [0.5] * width, None), rows[3], rows[20], (rows[20][0], [-0.5] * width, 2), (2000, [0.0] * width, 3)]
    return rows


def frame(spark, rows):
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, VECTORS).repartition(5).selectExpr("*", "1 AS x", "2 AS row", "3 AS code", "4 AS score", "5 AS cell")


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def ints(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, ints(v, 256), label) for i, v, label in usable(rows)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    step = len(first[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((gap(cut(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        learned = []
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, p)[1], []).append(cut(v, p))
            learned.append([[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[p])])
        books = learned
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [near(v, p) for p in range(parts)], label) for i, v, label in kept]
    by_label = {}
    for _, n, label in found:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in n)
    return [(i, "".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n), by_label[label], told) for i, n, label in found]


@pytest.mark.parametrize("parts,entries,rounds", [(16, 64, 2), (4, 7, 3), (8, 200, 0)])
def test_codes_are_those_of_every_distance(spark, parts, entries, rounds):
    rows = awkward_vectors()
    got = vector_codes.vector_codes(frame(spark, rows), parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_codes(rows, parts, entries, rounds), key=repr)


def test_few_vectors_and_none(spark):
    few = [(5, [0.1] * 16, None), (1, [0.3] * 16, 2)]
    got = vector_codes.vector_codes(spark.createDataFrame(few, VECTORS)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_codes(few)) and all(r.error == 0 for r in got)
    for none in (spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, None, 1), (2, [math.nan] * 16, 1)], VECTORS)):
        out = vector_codes.vector_codes(none)
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    for odd in ([(1, [0.1] * 16, 1), (2, [0.1] * 32, 1)], [(1, [0.1] * 15, 1)], [(1, [3e9] * 16, 1)]):
        with pytest.raises(Exception, match="vector"):
            vector_codes.vector_codes(spark.createDataFrame(odd, VECTORS)).collect()


def test_the_search_stays_inside_its_radius():
    """Every entry as near as the nearest lies in the part of the list that is scanned, whatever the previous entry; the lower index wins."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-40, 40, (50, 4))
    entries[30] = entries[7]
    book = vector_codes.Neighbours(entries)
    x = np.vstack([rng.integers(-50, 50, (400, 4)), entries])
    gaps = ((x[:, None] - entries[None]) ** 2).sum(2)
    for previous in (np.zeros(len(x), np.int64), rng.integers(0, 50, len(x)), gaps.argmax(1)):
        best, least = book.assign(x, previous)
        assert (best == gaps.argmin(1)).all() and (least == gaps.min(1)).all()


def plain_topk(rows, every=20, k=20):
    kept = [(i, np.array(ints(v, 64))) for i, v, _ in usable(rows) if i is not None]
    out = []
    for q, v in kept:
        if q % every == 0:
            best = sorted((-int(v @ w), c) for c, w in kept if c != q)[:k]
            out += [(q, rank + 1, c, -s) for rank, (s, c) in enumerate(best)]
    return out


@pytest.mark.parametrize("block,queries,pivots,k", [(16, 4, 5, 20), (2048, 256, 64, 20), (7, 3, 1, 500)])
def test_search_is_that_of_every_score(spark, block, queries, pivots, k):
    """Small annuli and blocks of queries, one pivot, more results than rows."""
    rows = awkward_vectors()
    got = exact_topk.exact_topk(frame(spark, rows), k=k, block=block, queries=queries, pivots=pivots).collect()
    assert sorted(map(tuple, got)) == sorted(plain_topk(rows, k=k))


def test_annuli_beyond_reach_are_not_searched(spark, monkeypatch):
    """In well-parted clusters a query meets few annuli, and still finds its best."""
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 1, (40, 8))
    centers *= 3 / np.linalg.norm(centers, axis=1)[:, None]
    rows = [(i, (centers[i % 40] + rng.normal(0, 0.01, 8)).astype(np.float32).tolist(), 0) for i in range(2000)]
    met = []
    materialize = exact_topk.materialize

    def watched(df, name):
        out = materialize(df, name)
        if name in ("visits", "home", "annuli", "open"):
            met.append((name, out.count()))
        return out

    monkeypatch.setattr(exact_topk, "materialize", watched)
    got = exact_topk.exact_topk(spark.createDataFrame(rows, VECTORS), k=5, block=50, queries=10, pivots=40).collect()
    assert sorted(map(tuple, got)) == sorted(plain_topk(rows, k=5))
    counts = {name: sum(n for m, n in met if m == name) for name, _ in met}
    annuli, blocks = next(n for m, n in met if m == "annuli"), counts["open"]
    assert counts["visits"] + counts["home"] < 0.35 * annuli * blocks


def test_search_without_rows_and_with_odd_ones(spark):
    for none in (spark.createDataFrame([], VECTORS), spark.createDataFrame([(20, None, 1), (None, [1.0], 1)], VECTORS)):
        out = exact_topk.exact_topk(none)
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0
    assert exact_topk.exact_topk(spark.createDataFrame([(20, [1.0], 1)], VECTORS)).count() == 0
    assert [tuple(r) for r in exact_topk.exact_topk(spark.createDataFrame([(20, [], 1), (21, [], 1)], VECTORS)).collect()] == [(20, 1, 21, 0)]
    large = [(20, [1e5, -1e5], 1), (21, [3e5, 7.7], 1), (22, [-3e6, 9e6], 1)]  # beyond exact doubles
    assert sorted(map(tuple, exact_topk.exact_topk(spark.createDataFrame(large, VECTORS)).collect())) == sorted(plain_topk(large))
    for odd in ([(20, [0.1] * 2, 1), (2, [0.1] * 3, 1)], [(20, [3e30], 1)]):
        with pytest.raises(Exception, match="vector"):
            exact_topk.exact_topk(spark.createDataFrame(odd, VECTORS)).collect()
