"""SimHash near-duplicates by multi-index hashing; near duplicates of a similarity on top of it.

A Hamming radius alone can't decide a similarity: sets of Jaccard similarity 0.8 differ in 9.7 of 64 bits
on average. So ``similar_classes`` lets the multi-index search propose links first and verifies them on
whole sets, which settles copies and closer ones; what lies beyond the radius is completed exactly. Two
sets of n and m shingles reach similarity t only if they share t (n + m) / (1 + t) of them, which is t n at
least. So in any one order of all shingles, the first n - ceil(t n) + 1 of each set have one in common: those
prefixes propose the rest of the pairs, and whole sets decide. No pair is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingle_sets
from .hamming import components, links
from .shared import content_key, fresh, map_arrow, materialize
from .simhash import as_hex, ascii_words, fingerprints

#: Five-word similarity from which documents are near duplicates for a stage of a pipeline.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
RADIUS, SEGMENTS = 3, 2
#: Which shingles go last in the order: those that ``COMMON`` of one in ``ONE_IN`` texts have, at most
#: ``LISTED``. Any order gives the same result; this one proposes fewer pairs.
ONE_IN, COMMON, LISTED = 16, 8, 100_000
#: Nodes that share a prefix shingle above which they are compared with more hubs before all their pairs are.
LARGE = 256
#: Hubs of such a group that its nodes are compared with at a time.
HUBS = 16
#: Rows of two or three longs up to which a table is broadcast; beyond, it is joined by shuffling.
BROADCAST = 200_000


def _small(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has at most ``BROADCAST`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _prints(rows: DataFrame, keys: list[str], shingle: int, radius: int, segments: int) -> tuple[DataFrame, DataFrame]:
    """Rows of (keys, words w) -> (keys, fp) of every row, and (fp, root) of every fingerprint."""
    prints = materialize(fingerprints(rows, keys, "w", shingle).select(*keys, "fp"), "prints")
    nodes = materialize(prints.select("fp").distinct(), "nodes")
    joined = components(links(nodes, radius, segments)).withColumnRenamed("node", "fp")
    return prints, materialize(nodes.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, segments: int = SEGMENTS
) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    Fingerprints vote over ``shingle``-word runs and link at ``radius`` or fewer differing bits;
    component_id is the smallest doc_id that links reach. Exact copies share a fingerprint and
    are collapsed before the search. Null, empty and blank texts have fingerprint zero and link
    like any other; a null doc_id keeps its row and never names a component that has another id;
    repeated rows stay; an empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_words(F.col(text_col)).alias("w"))
    prints, roots = _prints(rows, ["doc_id"], shingle, radius, segments)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    nodes = materialize(nodes, "least")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    # written out, so that what joins it is dealt anew: a fingerprint that very many rows share is split
    of_fp = materialize(nodes.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(of_fp, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _alike(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes of which the sets reach the similarity. Sets are made again from the texts,
    of the nodes of pairs only that their tallies don't rule out; v's is fetched first, so that a hub u meets
    rows that can be split."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("tally").alias(f"tally_{c}"))
    most = F.aggregate(F.zip_with("tally_u", "tally_v", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    likely = pairs.distinct().join(of("v"), "v").join(of("u"), "u")
    likely = likely.where(most + 1e-6 >= similarity / (1 + similarity) * (F.col("n_u") + F.col("n_v")))
    pairs = materialize(likely.select("u", "v"), "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = materialize(nodes.select("node", "first.k1", "first.k2").join(wanted, "node"), "wanted")
    texts = keyed.select("k1", "k2", "text").join(_small(wanted), ["k1", "k2"]).select("node", "text")
    sets = texts.transform(map_arrow, lambda it: shingle_sets.whole_sets(it, shingle), "node long, hs array<long>")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    both = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(sets.select(F.col("node").alias("v"), F.col("hs").alias("b")), "v")
        .join(sets.select(F.col("node").alias("u"), F.col("hs").alias("a")), "u")
        .where(both / (F.size("a") + F.size("b") - both) >= similarity).select("u", "v")
    )


def _common(keyed: DataFrame, shingle: int) -> np.ndarray:
    """Hashes that many texts have, ascending, from one unlike text in ``ONE_IN``."""
    some = keyed.where(F.pmod("k1", F.lit(ONE_IN)) == 0).select(F.xxhash64("text").alias("node"), "text")
    sets = some.transform(map_arrow, lambda it: shingle_sets.whole_sets(it, shingle), "node long, hs array<long>").dropDuplicates(["node"])
    found = sets.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["h"] for r in found.orderBy(F.desc("n"), "h").limit(LISTED).collect()], np.int64).view(np.uint64))


def _likely(near: DataFrame) -> DataFrame:
    """Pairs (u, v) of a node v and that node lo with which it shares most; a pair left out costs nothing but
    comparisons later, so only likely ones."""
    some = near.groupBy("node", "n", "lo").agg(F.count("*").alias("c")).where("20 * c >= n")
    return some.groupBy("node").agg(F.max_by("lo", F.struct("c", "lo")).alias("lo")).select(F.col("lo").alias("u"), F.col("node").alias("v"))


def _by_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) that the multi-index search links: nodes of one fingerprint with its least node, and
    those least nodes along the links of the fingerprints."""
    prints = nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("hub"))
    prints = materialize(prints, "prints")
    same = nodes.where("n > 0").join(prints, "fp").where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    near = links(prints.select("fp"), RADIUS, SEGMENTS)
    near = near.join(prints.select(F.col("fp").alias("u"), F.col("hub").alias("hu")), "u").join(prints.select(F.col("fp").alias("v"), F.col("hub").alias("hv")), "v")
    return same.unionByName(near.select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v")))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, doc_id, s1, s2 of every row; s1, s2, node, root and first row of every set)."""
    k1, k2 = content_key(docs)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    last = _common(keyed, shingle)
    rows = materialize(
        keyed.transform(
            map_arrow,
            lambda it: shingle_sets.sketch(it, shingle, last, similarity),
            "k1 long, k2 long, doc_id long, s1 long, s2 long, n int, fp long, prefix array<long>, tally array<int>"), "sketch")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")  # the row that stands for its set
    alike = rows.groupBy("s1", "s2").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("tally").alias("tally"))
    nodes = materialize(alike.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed once written
    postings = nodes.select("node", "n", F.posexplode("prefix").alias("place", "h"))
    # written out, so that what joins it is dealt anew: a shingle that very many texts share is split
    shared = materialize(postings.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("h", "lo"), "shared")
    near = materialize(postings.join(shared, "h"), "near")
    proposed = _by_prints(nodes).unionByName(_likely(near.where("node <> lo")))
    found = materialize(_alike(proposed, nodes, keyed, shingle, similarity), "stars")
    near, round_ = near.drop("lo"), 0
    # nodes of large groups are compared with some of their most central nodes first, while that joins more
    sizes = near.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > LARGE)
    large = materialize(near.join(materialize(sizes, "sizes"), "h"), "large")
    # the more of its set a node shares with large groups, the fewer shingles of its own keep others from it
    central = large.groupBy("node", "n").agg((F.count("*") / F.col("n")).alias("share"), F.max(F.struct("c", "h"))["h"].alias("largest"))
    central = materialize(central.where("20 * share >= 1").select("node", "share", "largest"), "central")
    large = large.join(central, "node").join(central.select(F.col("largest").alias("h")).distinct(), "h", "left_semi")
    large = materialize(large.select("node", "h", "share", (F.col("h") == F.col("largest")).alias("asks")), "large")
    roots = components(found)
    while large.limit(1).count():
        round_ += 1
        rooted = materialize(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        drawn = F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(HUBS))
        best = F.max_by(F.struct(F.col("node").alias("lo"), F.col("root").alias("lo_root")), F.struct("share", "node"))
        hubs = rooted.groupBy("h", drawn.alias("drawn")).agg(best.alias("hub"))
        stars = rooted.where("asks").join(materialize(hubs.select("h", "hub.*"), "hubs"), "h").where("root <> lo_root")
        proposed = materialize(stars.select(F.col("lo").alias("u"), F.col("node").alias("v")), "proposed")
        more = materialize(_alike(proposed, nodes, keyed, shingle, similarity), "stars")
        asked, joined = (df.select("v").distinct().count() for df in (proposed, more))
        if 50 * joined <= asked:
            break
        found = found.unionByName(more)
        roots = components(found)
    rooted = near.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    open_ = materialize(rooted.join(mixed, "h", "left_semi"), "open")
    a = open_.select("h", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "place", "root")])
    b = open_.select("h", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "place", "root")])
    # two sets can share what their prefixes do, up to the last of it, and what comes after in both; of what
    # they share the first leaves enough after it
    needed = similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b"))
    left = lambda pa, pb: F.least(F.col("n_a") - pa - 1, F.col("n_b") - pb - 1)
    pairs = a.join(b, "h").where(
        (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
        & (F.least("n_a", "n_b") + 1e-6 >= similarity * F.greatest("n_a", "n_b"))
        & (left(F.col("place_a"), F.col("place_b")) + 1 + 1e-6 >= needed)
    ).groupBy("node_a", "node_b", "n_a", "n_b").agg((F.count("*") + left(F.max("place_a"), F.max("place_b"))).alias("most")).where(
        F.col("most") + 1e-6 >= needed
    ).select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    more = materialize(_alike(pairs, nodes, keyed, shingle, similarity), "more")
    joined = components(found.unionByName(more)) if more.limit(1).count() else roots
    nodes = nodes.select("node", "s1", "s2", "first").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows.select("k1", "k2", "doc_id", "s1", "s2"), materialize(nodes, "classes")


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per input row: doc_id, component_id.

    Texts link if the Jaccard similarity of their sets of ``shingle``-word runs is ``similarity`` or
    more, all pairs considered; component_id is the smallest doc_id that links reach. A text of fewer
    words is one run; null, empty and blank texts link to one another only. Null ids and repeated rows
    count as in ``near_duplicate_classes``.

    Sets that agree are one node. Nodes are first compared along the links of their fingerprints, and with
    one node that is the least of many of their prefix shingles, which joins most of a large group; those of
    large groups again with ``HUBS`` of its most central nodes at a time, as long as that joins more. Then all
    pairs that share a prefix shingle and lie in different components are. So a group of near copies isn't
    compared pair by pair.
    """
    rows, nodes = _classes(docs, id_col, text_col, shingle, similarity)
    least = nodes.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    of_set = materialize(nodes.join(least, "root").select("s1", "s2", "component_id"), "ids")
    return rows.join(of_set, ["s1", "s2"]).select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of ``similar_classes``: that of the smallest doc_id (rows without one come
    last), of rows that share it the one with the least key of its content, once where it is repeated.
    Rows are told apart by all their columns, never by their ids. Columns as they are."""
    rows, nodes = _classes(docs, id_col, text_col, shingle, similarity)
    kept = nodes.groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    return _only(docs, rows.select("k1", "k2"), kept)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """As ``keep_one_similar``, for the classes of ``near_duplicate_classes``."""
    k1, k2 = content_key(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).cast("long").alias("doc_id"), ascii_words(F.col(text_col)).alias("w"))
    prints, roots = _prints(rows, ["k1", "k2", "doc_id"], shingle, radius, segments)
    of_print = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("first"))
    kept = of_print.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    return _only(docs, prints.select("k1", "k2"), kept)


def _only(docs: DataFrame, keys: DataFrame, kept: DataFrame) -> DataFrame:
    """Of ``docs``, whose rows have ``keys`` (k1, k2), one row of each key that is ``kept``."""
    sign = lambda df, stays: df.select("k1", "k2", F.lit(stays).alias("stays"))
    told = sign(keys, 0).unionByName(sign(kept, 1)).groupBy("k1", "k2").agg((F.count("*") - F.sum("stays")).alias("rows"), F.max("stays").alias("stays"))
    # only rows that go, or are repeated, are looked up
    told = materialize(told.where((F.col("stays") == 0) | (F.col("rows") > 1)), "told")
    a, b, stays = fresh(docs, "k1", "k2", "stays")
    marked = docs.withColumns(dict(zip((a, b), content_key(docs), strict=True)))
    marked = marked.join(_small(told.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("stays").alias(stays))), [a, b], "left")
    once = marked.where(F.col(stays) == 1).dropDuplicates([a, b])
    return marked.where(F.col(stays).isNull()).unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
