"""Repeated passages and benchmark decontamination against all windows."""

import math
import random
import re
from collections import Counter, defaultdict

from swaplens.llm import decontamination, substring_dedup

from .helpers import PROSE, WORD, awkward, empty, table


def runs(places):
    out = []
    for i in sorted(places):
        if out and i == out[-1][1] + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return out


def repeated(docs, size=50):
    """doc -> words that lie in a window of ``size`` words that another document has."""
    at = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w) - size + 1):
            at[tuple(w[i : i + size])].add(d)
    return {d: {j for i in range(len(w) - size + 1) if len(at[tuple(w[i : i + size])]) > 1 for j in range(i, i + size)} for d, w in docs.items()}


def check_passages(rows, docs):
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
        assert r.other_doc_id != r.doc_id and r.n_words >= 50
    want = repeated(docs)
    for d in docs:
        assert got[d] <= want[d]
        for a, b in runs(want[d]):
            assert got[d] & set(range(a, b + 1)), (d, a, b)
        for a, b in runs(want[d] - got[d]):
            assert b - a + 1 < substring_dedup.WINDOW + substring_dedup.REACH


def test_passages_match_all_windows(spark, tiny):
    docs = table(spark, tiny, "documents")
    check_passages(substring_dedup.repeated_passages(docs).collect(), {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()})


def test_planted_passages_of_just_the_length(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)] + ["a", "b", "c"] * 40
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 60, 75, 98, 130, 300) for _ in range(4)]
    docs = {}
    for d in range(160):
        text = []
        for p in rng.sample(passages, 2):
            text += [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))] + p
        docs[d] = text + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
    df = spark.createDataFrame([(d, rng.choice([" ", "\n", "  "]).join(w)) for d, w in docs.items()], "doc_id long, text string").repartition(5)
    check_passages(substring_dedup.repeated_passages(df).collect(), docs)


def test_passages_of_awkward_rows(spark):
    got = {(r.doc_id, r.start_word, r.n_words) for r in substring_dedup.repeated_passages(awkward(spark)).collect()}
    assert {d for d, _, _ in got} == {1, 2, 7, 9} and (1, 0, 120) in got and (2, 0, 120) in got
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0
    same = spark.createDataFrame([(1, PROSE), (1, PROSE)], "doc_id long, text string")
    assert substring_dedup.repeated_passages(same).count() == 0  # rows of one document
    nameless = spark.createDataFrame([(None, PROSE), (None, PROSE + " more"), (-4, "x " + PROSE), (None, None), (None, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.other_doc_id) for r in substring_dedup.repeated_passages(nameless).collect()), key=repr)
    assert [g[0] for g in got] == [-4, None, None] and all(g[1] >= 94 for g in got)
    half = spark.createDataFrame([(1, PROSE), (2, " ".join(PROSE.split()[:49]))], "doc_id long, text string")
    assert substring_dedup.repeated_passages(half).count() == 0


def test_a_text_in_pieces_has_the_codes_of_the_whole(monkeypatch):
    text = "αβγ " * 50 + PROSE + " " + "z" * 700 + " end"
    whole = substring_dedup.words_of([text.encode(), b"", b"x"])
    monkeypatch.setattr(substring_dedup, "BLOCK", 64)
    pieces = substring_dedup.words_of([text.encode(), b"", b"x"])
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    assert len(whole[0]) == len(text.split()) + 1


# --- decontamination --------------------------------------------------------------------------------

def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def likeness(a, b):
    both = sum((Counter(a) & Counter(b)).values())
    return both / (len(a) + len(b) - both)


def best_window(grams, item):
    """The greatest likeness of a window as long as the item, all windows tried; what they share is kept up."""
    want, has, both, best, m = Counter(item), Counter(), 0, 0, len(item)
    for k, g in enumerate(grams):
        both += has[g] < want[g]
        has[g] += 1
        if k >= m:
            old = grams[k - m]
            has[old] -= 1
            both -= has[old] < want[old]
        if k >= m - 1:
            best = max(best, both / (2 * m - both))
    return best


def test_the_plain_version_of_windows():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(9) for _ in range(rng.randrange(40))], [rng.randrange(9) for _ in range(1 + rng.randrange(9))]
        assert math.isclose(best_window(a, b), max((likeness(a[k : k + len(b)], b) for k in range(len(a) - len(b) + 1)), default=0))


def all_windows(docs, items, at_least=0.8):
    found = {}
    for d, text in docs:
        w = tokens(text)
        for i, item in items:
            v = tokens(item)
            if not v:
                continue
            size = min(5, len(v))
            grams = lambda x, s=size: [tuple(x[k : k + s]) for k in range(len(x) - s + 1)]
            gi, gd = grams(v), grams(w)
            best = best_window(gd, gi)
            if best >= at_least:
                found[d, i] = max(best, found.get((d, i), 0))
    return found


ITEMS = "item_id long, text string"


def test_contamination_matches_all_windows(spark, tiny):
    docs, items = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(docs, items).collect()}
    want = all_windows([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_near_copies_and_repeats(spark):
    rng = random.Random(6)
    item = [f"q{rng.randrange(60)}" for _ in range(40)]
    docs = []
    for d in range(60):
        copy = list(item)
        for _ in range(d % 4):
            copy[rng.randrange(len(copy))] = "changed"
        docs.append((d, " ".join([f"n{rng.randrange(99)}" for _ in range(d)] + copy + ["tail"] * 3)))
    items = [(1, " ".join(item)), (2, "tail tail tail"), (3, "Tail, TAIL! tail."), (4, ""), (5, None), (6, "never seen words here at all")]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    want = all_windows(docs, items)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert {i for _, i in got} == {1, 2, 3}


def test_contamination_of_awkward_rows(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, PROSE), (2, "one"), (None, "nameless text of some words")], ITEMS).selectExpr("*", "1 AS size", "'x' AS h")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert {(1, 1), (2, 1), (7, 1), (9, 1), (6, 2), (None, None)} <= got and not {d for d, _ in got} & {3, 4, 5}
    left = decontamination.without_contaminated(docs, items)
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, 8} and left.columns == docs.columns
    assert decontamination.contaminated(empty(spark), items).count() == 0
    assert decontamination.contaminated(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_main_path_has_no_python(spark, tiny):
    df = decontamination.contaminated(table(spark, tiny, "documents"), table(spark, tiny, "benchmark"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_documents_shorter_than_an_item(spark):
    """The whole of a shorter document is its only window, here and in the brute force."""
    rng = random.Random(9)
    items = [(i, [f"q{rng.randrange(40) if i % 2 else (i, k)}" for k in range(n)]) for i, n in enumerate((5, 6, 9, 14, 29, 60, 60, 104))]
    docs = []
    for _, w in items * 12:
        cut = w[rng.randrange(3) :]
        cut = cut[: len(cut) - rng.randrange(1 + len(w) // 6)]
        if cut and rng.random() < 0.3:
            cut[rng.randrange(len(cut))] = "changed"
        docs.append((len(docs), " ".join(cut)))
    docs.append((1000, " ".join(items[5][1][:-5])))
    items = [(i, " ".join(w)) for i, w in items]
    want = all_windows(docs, items)
    grams = lambda t: [tuple(tokens(t)[k : k + 5]) for k in range(len(tokens(t)) - 4)]
    whole = {(d, i): likeness(grams(t), grams(v)) for d, t in docs for i, v in items if 0 < len(grams(t)) < len(grams(v))}
    want |= {k: s for k, s in whole.items() if s >= 0.8}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontamination.contaminated(df, spark.createDataFrame(items, ITEMS)).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert math.isclose(got[1000, 5], 51 / 56) and all(r.n_words == len(tokens(docs[-1][1])) for r in rows if r.doc_id == 1000)
    assert 1000 not in {r.doc_id for r in decontamination.without_contaminated(df, spark.createDataFrame(items, ITEMS)).collect()}


def test_each_row_is_judged_by_its_own_text(spark):
    """Rows without an id, an id that clean and leaked texts share, names that clash."""
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(None, item + " more"), (None, "clean words here"), (None, None), (5, "before " + item), (5, "clean too"), (6, item), (6, item), (7, "q1 q2 q3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _leaked", "2 AS t1", "3 AS t2", "4 AS win")
    items = spark.createDataFrame([(1, item), (2, item), (None, item)], ITEMS)
    left = decontamination.without_contaminated(docs, items)
    assert left.columns == docs.columns and sorted((r.text or "" for r in left.collect())) == ["", "clean too", "clean words here", "q1 q2 q3"]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(d, i) for d in (None, 5, 6) for i in (None, 1, 2)}


def test_windows_at_the_threshold_and_their_radius(spark):
    """Every window of similarity 0.8 or more is found, also beyond the radius; most lie within it."""
    rng = random.Random(12)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(rng.randrange(20, 90)))) for i in range(30)]
    docs = []
    for d in range(400):
        w = items[d % 30][1].split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((d, " ".join([f"n{rng.randrange(99)}" for _ in range(rng.randrange(30))] + w + ["tail"] * rng.randrange(4))))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    want = all_windows(docs, items)
    rows = decontamination.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want.keys()
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench, radius=0).collect()} == want.keys()
    assert sum(r.n_bits <= decontamination.RADIUS for r in rows) >= 0.97 * len(rows)


def test_blocks_find_all_prints_within_the_radius(spark):
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(20)]
    near = [(b, b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(decontamination.RADIUS + 1)))) for b in base for _ in range(20)]
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in near], "a long, b long")
    from pyspark.sql import functions as F

    asked = decontamination._block_values(F.col("a"), decontamination.RADIUS // decontamination.BLOCKS)
    met = df.where(F.size(F.array_intersect(asked, decontamination._block_values(F.col("b"), 0))) > 0)
    assert met.count() == len(near)


def test_unlike_prints_do_not_meet(spark):
    """Block values are those of the print; of unrelated prints of one length fewer than two pairs in a hundred meet."""
    from pyspark.sql import functions as F

    known = spark.createDataFrame([(0,), (-77,), (0x123456789ABCDEF,)], "fp long").select("fp", decontamination._block_values(F.col("fp"), 0).alias("v")).collect()
    for r in known:
        assert r.v == [((r.fp & (1 << 64) - 1) >> 16 * i & 0xFFFF) + (i << 32) for i in range(4)]
    assert len(spark.range(1).select(decontamination._block_values(F.lit(5).cast("long"), 2).alias("v")).first().v) == 4 * 137
    rng = random.Random(6)
    prints = lambda n, name: spark.createDataFrame([(5, 40, rng.getrandbits(63)) for _ in range(n)], f"size int, m int, {name} long")
    met = decontamination._meeting(prints(600, "fp"), prints(100, "item_fp"), decontamination.RADIUS)
    assert met.count() <= 0.02 * 600 * 100


def test_passages_of_ids_of_any_size(spark):
    """The largest and smallest ids, ids that only differ in their highest bits, texts without an id, unlike texts under one id."""
    shared = " ".join(f"s{i * 31 % 997}" for i in range(80))
    text = lambda n: " ".join(f"u{n}x{k}" for k in range(30)) + " " + shared + " " + " ".join(f"v{n}x{k}" for k in range(30))
    ids = [2**62 + 5, 5 - 2**62, 5, 2**63 - 1, -(2**63), None, None]
    docs = spark.createDataFrame([(i, text(n)) for n, i in enumerate(ids)] + [(5, "another text under five")], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(docs).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted(ids, key=repr)
    for r in rows:
        assert r.start_word <= 30 + 26 and r.start_word + r.n_words >= 110 - 26
        assert r.other_doc_id is None or r.other_doc_id in ids and r.other_doc_id != r.doc_id
    # two texts without an id have each other, and say so by no id
    alone = substring_dedup.repeated_passages(docs.where("doc_id IS NULL")).collect()
    assert [(r.doc_id, r.other_doc_id) for r in alone] == [(None, None)] * 2
    assert substring_dedup.repeated_passages(docs.where("doc_id = 5")).count() == 0
