"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Only DataFrame functions. A window and an item of m shingles each have weighted Jaccard similarity
of at least t only if they share s = ceil(2 t m / (1 + t)) shingles, repeats counted. So such a
window holds at least one of any m - s + 1 of the item's shingles; those that fewest items have are
its seeds. Windows without a seed can't qualify and are not fingerprinted; every window around a
seed is. A document of n < m shingles is one window; it reaches t only if n >= t m and t m shingles are
shared, so it holds one of the rarest m - ceil(t m) + 1, its seeds.

Fingerprints are looked up in ``BLOCKS`` tables of 16 bits: of 64 bits that differ in ``RADIUS`` at
most, one block differs in ``RADIUS // BLOCKS`` at most, so with the small Hamming balls of an item's
blocks (137 of 65,536 values each) all windows within the radius are found, and of unlike prints fewer than one pair in a hundred
meets. A radius decides no similarity (0.8 gives 9.7 bits on average, deviation 2.9), so windows that share a seed with an item and lie
beyond are compared too. The exact similarity of whole windows decides all, and none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hamming import ball
from .shared import fresh, materialize
from .simhash import distance, vote

WORDS, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 11, 4
#: Rows of a few numbers up to which a table (of seeds, of texts found) is broadcast; beyond, it is joined by
#: shuffling.
BROADCAST = 200_000


def norm_words(text: Column) -> Column:
    """Letters and digits, lower-cased; punctuation and white space only separate."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.array_remove(parts, "")


def shingle_hashes(words: str, size: int) -> Column:
    w = F.col(words)
    runs = F.transform(
        F.sequence(F.lit(0), F.size(w) - size),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]),
    )
    return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _identity(*columns: Column) -> list[Column]:
    """Two longs, 128 bits, that stand for the values."""
    return [F.xxhash64(F.lit(salt), *columns) for salt in (1, 2)]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, i1, i2 (identity of its shingles), size (words a shingle), m, hashes; items without words
    can't be found."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), norm_words(F.col(text_col)).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(WORDS)))
    hashes = F.array().cast("array<bigint>")
    for size in range(1, WORDS + 1):
        hashes = F.when(F.col("size") == size, shingle_hashes("w", size)).otherwise(hashes)
    i1, i2 = _identity(F.col("size"), F.col("hashes"))
    return rows.select("item_id", "size", hashes.alias("hashes")).select("item_id", i1.alias("i1"), i2.alias("i2"), "size", F.size("hashes").alias("m"), "hashes")


def _seeds(items: DataFrame, similarity: float) -> DataFrame:
    """i1, i2, size, m, h, whole: for each unlike item the seeds of shorter documents, whole where they are
    also its rarest m - s + 1 shingles."""
    flat = items.select("i1", "i2", "size", "m", F.posexplode("hashes").alias("q", "h"))
    common = flat.groupBy("h").agg(F.count_distinct("i1", "i2").alias("df"))
    need = F.ceil(F.round(F.lit(2 * similarity / (1 + similarity)) * F.col("m"), 9))
    rank = F.row_number().over(Window.partitionBy("i1", "i2").orderBy("df", "h", "q"))
    ranked = flat.join(common, "h").withColumn("k", rank).where(F.col("k") <= F.col("m") - _least(similarity) + 1)
    return ranked.groupBy("i1", "i2", "size", "m", "h").agg(F.max(F.col("k") <= F.col("m") - need + 1).alias("whole"))


def _least(similarity: float) -> Column:
    """Shingles that a text has at least if it is similar to an item of m."""
    return F.ceil(F.round(F.lit(similarity) * F.col("m"), 9))


def _apart(hashes: Column) -> Column:
    """The array with the second, third, ... of equal hashes replaced by others, the same everywhere."""
    ordered = F.sort_array(hashes)
    nth = lambda x, i: i + 1 - F.array_position(ordered, x)
    told = F.transform(ordered, lambda x, i: F.when(nth(x, i) == 0, x).otherwise(F.xxhash64(x, nth(x, i))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(told)


def _block_values(fp: Column, patterns: int) -> Column:
    """(number, value) of each block of bits, as one long, with all patterns of so many bits at most."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    values = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        value = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) + F.lit(i << 32).cast("long")
        values.append(_around(value, ball(hi - lo, patterns)))
    return F.flatten(F.array(*values))


def _around(value: Column, patterns: list[int]) -> Column:
    # a lambda of one parameter: a second one would be the place in the array
    return F.transform(F.array(*[F.lit(p).cast("long") for p in patterns]), lambda pattern: value.bitwiseXOR(pattern))


def _meeting(printed: DataFrame, item_prints: DataFrame, radius: int) -> DataFrame:
    """Windows (size, m, fp) and items (size, m, item_fp) of one length that share a block value, once for each."""
    asked = item_prints.withColumn("block", F.explode(_block_values(F.col("item_fp"), radius // BLOCKS)))
    return printed.withColumn("block", F.explode(_block_values(F.col("fp"), 0))).join(asked, ["size", "m", "block"])


def _windows(docs: DataFrame, seeds: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """Windows around seeds of unlike texts: t1, t2 (the text), size, m, start, win, c1, c2 (its identity)."""
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # WORDS values at most
    wanted = seeds.groupBy("size", "m", "h").agg(F.max("whole").alias("whole"))
    wanted = F.broadcast(wanted) if seeds.limit(BROADCAST + 1).count() <= BROADCAST else wanted
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = _identity(text)
    # a row number, so that no filter is moved below the words, which would make them again for each shingle
    base = docs.select(F.monotonically_increasing_id().alias("row"), t1.alias("t1"), t2.alias("t2"), norm_words(text).alias("w"))
    hits = None
    for size in sizes or [WORDS]:
        found = (
            base.withColumn("all", shingle_hashes("w", size))
            .select("row", "t1", "t2", "all", F.posexplode("all").alias("p", "h"))
            .join(wanted.where(F.col("size") == size), "h")
            .where(F.when(F.size("all") >= F.col("m"), F.col("whole")).otherwise(F.size("all") >= _least(similarity)))
            # only the shingles around the hit go on, not the document
            .select("row", "t1", "t2", "size", "m", "p", F.greatest(F.col("p") - F.col("m") + 1, F.lit(0)).alias("lo"),
                    F.slice("all", F.greatest(F.col("p") - F.col("m") + 2, F.lit(1)), F.col("m") * 2 - 1).alias("near"),
                    F.size("all").alias("n"))
        )
        hits = found if hits is None else hits.unionByName(found)
    hits = materialize(hits.dropDuplicates(["t1", "t2", "size", "m", "p"]), "hits")  # of equal texts
    # each window belongs to the first seed that it holds
    before = F.lag("p").over(Window.partitionBy("t1", "t2", "size", "m").orderBy("p"))
    first = F.greatest(F.col("lo"), F.coalesce(F.col("before") + 1, F.lit(0)))
    final = F.least(F.col("p"), F.greatest(F.col("n") - F.col("m"), F.lit(0)))
    windows = (
        hits.withColumn("before", before).where(first <= final)
        .select("t1", "t2", "size", "m", "lo", "near", F.explode(F.sequence(first, final)).alias("start"))
        .select("t1", "t2", "size", "m", "start", F.slice("near", F.col("start") - F.col("lo") + 1, F.col("m")).alias("win"))
    )
    c1, c2 = _identity(F.col("size"), F.col("m"), F.col("win"))
    return materialize(windows.withColumns({"c1": c1, "c2": c2}), "windows")


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, i1, i2, best: the best window of each unlike text and item), (i1, i2, item_id)."""
    items = materialize(_items(benchmark, item_col, "text"), "items")
    unlike = items.drop("item_id").dropDuplicates(["i1", "i2"])
    seeds = materialize(_seeds(unlike, similarity), "seeds")
    windows = _windows(docs, seeds, text_col, similarity)
    # the same window in many documents is fingerprinted and compared once
    own = ["c1", "c2", "size", "m"]
    contents = materialize(windows.groupBy(*own).agg(F.first("win").alias("win")), "contents")
    terms = contents.select(*own, F.explode("win").alias("h"))
    printed = materialize(vote(terms, own, "h").drop("n_terms"), "printed")
    of_item = ["i1", "i2", "size", "m"]
    item_prints = materialize(vote(unlike.select(*of_item, F.explode("hashes").alias("h")), of_item, "h").select(*of_item, F.col("fp").alias("item_fp")), "item_prints")
    near = _meeting(printed, item_prints, radius).where(distance(F.col("fp"), F.col("item_fp")) <= radius).select(*own, "i1", "i2")
    beyond = terms.join(seeds.where("whole").select(*of_item, "h"), ["size", "m", "h"]).select(*own, "i1", "i2")
    shorter = terms.join(contents.where(F.size("win") < F.col("m")).select(*own), own, "left_semi")
    shorter = shorter.join(seeds.select(*of_item, "h"), ["size", "m", "h"]).select(*own, "i1", "i2")
    pairs = near.unionByName(beyond).unionByName(shorter).distinct()
    both = F.size(F.array_intersect("a", "b"))
    verified = (
        pairs.join(printed.select("c1", "c2", "fp"), ["c1", "c2"]).join(contents.select("c1", "c2", _apart(F.col("win")).alias("a")), ["c1", "c2"])
        .join(item_prints.select("i1", "i2", "item_fp"), ["i1", "i2"]).join(unlike.select("i1", "i2", _apart(F.col("hashes")).alias("b")), ["i1", "i2"])
        .select(*own, "i1", "i2", F.size("a").alias("n"), distance(F.col("fp"), F.col("item_fp")).alias("n_bits"), (both / (F.size("a") + F.size("b") - both)).alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )
    # written out, so that what joins it is dealt anew: a window that very many documents share is split
    verified = materialize(verified, "verified")
    best = F.struct((-F.col("similarity")).alias("less"), F.col("start"), F.col("m"), F.col("size"), F.col("n_bits"), F.col("n"))
    found = windows.select("t1", "t2", "start", *own).join(verified, own).groupBy("t1", "t2", "i1", "i2").agg(F.min(best).alias("best"))
    return materialize(found, "found"), items.select("i1", "i2", "item_id").distinct()


def _small(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has at most ``BROADCAST`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """One row for each (doc_id, item_id) of which some window as long as the item, or the whole of a
    shorter document, reaches the similarity over five-word shingles: doc_id, item_id, start_word, n_words, similarity (of the
    best window, the first of equals), n_bits (its Hamming distance).

    An item of fewer than five words counts as one shingle. Null and empty texts, items without
    words and empty tables give no row; rows that repeat a doc_id count as one document; a null doc_id is reported as null. Other columns are ignored.
    """
    found, ids = _found(docs, benchmark, text_col, item_col, similarity, radius)
    t1, t2 = _identity(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(id_col).cast("long").alias("doc_id")).join(_small(found), ["t1", "t2"])
    return (
        rows.join(ids, ["i1", "i2"]).groupBy("doc_id", "item_id").agg(F.min("best").alias("b"))
        .select("doc_id", "item_id", F.col("b.start").cast("long").alias("start_word"),
                (F.col("b.n") + F.col("b.size") - 1).cast("long").alias("n_words"),
                (-F.col("b.less")).alias("similarity"), F.col("b.n_bits").alias("n_bits"))
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """The rows in whose text no benchmark item is found, each judged by its own text, whatever its id;
    columns as they are. Rows with a null, empty or wordless text stay, all rows do if the benchmark has no words, repeated
    rows stay as often as they come, and an empty table stays empty."""
    found, _ = _found(docs, benchmark, text_col, item_col, similarity, radius)
    a, b = fresh(docs, "t1", "t2")
    t1, t2 = _identity(F.coalesce(F.col(text_col), F.lit("")))
    leaked = _small(found.select(F.col("t1").alias(a), F.col("t2").alias(b)).distinct())
    return docs.withColumns({a: t1, b: t2}).join(leaked, [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
