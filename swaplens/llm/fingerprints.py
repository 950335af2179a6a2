"""Document fingerprints: SimHash over weighted terms, and search by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, ranges_wanted, with_next
from .simhash import as_hex, ascii_words, distance, shingles, vote

#: Words in a term; a term's weight is how often it occurs.
TERM_WORDS = 2
BLOCKS, RADIUS = 6, 3


def block_tables(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp -> one row (key, fp) for each choice of ``blocks - radius`` blocks, moved to the front.

    Fingerprints that differ in at most ``radius`` bits agree wholly in at least one choice. The
    key holds the chosen blocks (about ``64 * (blocks - radius) / blocks`` bits) and the table.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, kept in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in kept)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask)), F.lit(number)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def search(index: DataFrame, wanted: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints (fp) of an index and of queries -> all pairs (query, fp) within
    ``radius`` bits. Exact: block keys only propose, full distances decide."""
    a = block_tables(wanted, radius, blocks).withColumnRenamed("fp", "query")
    b = block_tables(index, radius, blocks)
    return b.join(a, "key").where(distance(F.col("query"), F.col("fp")) <= radius).select("query", "fp").distinct()


def fingerprint_table(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_every: int = 100
) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_near.

    The edited text has its last quarter of code points replaced by the start of the next
    document (ascending doc_id, after the last the first). near_* are 1 - distance / 64. n_near
    counts the rows within 3 bits of rows whose doc_id ``query_every`` divides, itself included;
    it is null for other rows. A null text counts as empty; empty texts have fingerprint zero;
    null ids sort first, equal ids by a hash of their texts; a table of one row is its own next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    n = ranges_wanted(rows, "text")
    n_chars = F.length("text").cast("long")
    cut = F.floor(n_chars / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (n_chars - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut)
    )
    both = with_next(rows, "doc_id", "tie", ["text"], n).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "tie", n_chars.alias("n_chars"), "text", edited.alias("edited")
    )
    keys = ["row", "doc_id", "tie", "n_chars", "sha", "which"]
    texts = both.withColumn("sha", F.unhex(F.sha2(F.col("edited"), 256))).select(
        *keys[:-1], F.posexplode(F.array("text", "edited")).alias("which", "t")
    )
    words = texts.select(*keys, ascii_words(F.col("t")).alias("w"))
    terms = words.select(*keys, F.explode_outer(shingles("w", TERM_WORDS)).alias("term"))
    voted = vote(terms.select(*keys, F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("h")), keys, "h")
    prints = materialize(
        voted.groupBy(*keys[:-1]).agg(
            F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"),
            F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("fp_edited"),
        ).drop("row"),
        "prints",
    )
    near = lambda other: 1 - distance(F.col("fp"), F.col(other)) / F.lit(64.0)
    is_query = F.col("doc_id") % query_every == 0
    index = prints.groupBy("fp").agg(F.count("*").alias("n"))
    wanted = prints.where(is_query).select("fp").distinct()
    found = (
        search(index.select("fp"), wanted).join(index, "fp").groupBy("query").agg(F.sum("n").alias("n_near"))
        .select(F.col("query").alias("fp"), F.lit(True).alias("asked"), "n_near")
    )
    # written out, so that what joins it is dealt anew: a fingerprint that very many rows share is split
    found = materialize(found, "found")
    return (
        with_next(prints, "doc_id", "tie", ["fp"], n)
        .withColumn("asked", F.when(is_query, F.lit(True)))
        .join(found, ["fp", "asked"], "left")
        .select(
            "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"),
            as_hex(F.col("fp_edited")).alias("edited_fingerprint"), near("fp_edited").alias("near_edited"),
            near("next_fp").alias("near_next"), "n_near",
        )
    )
