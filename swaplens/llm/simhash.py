"""SimHash with DataFrame functions only: words, shingles, and 64-bit majority votes.

A term's occurrences each cast one vote per bit, so a term weighs as often as it occurs. The 64
counters of a text are held in 32 longs of two 32-bit lanes: ``(h >>> i) & 0x100000001`` has bit i
in the low lane and bit i + 32 in the high one, so one addition counts both. Counting is a hash
aggregation with map-side combine; what is shuffled is 32 longs a text, never its terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LANES = 0x0000000100000001


def ascii_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; null and blank: none."""
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def shingles(words: str, size: int) -> Column:
    """Space-joined runs of ``size`` words of the array column, repeats included; of fewer words
    the whole sequence; of none, no shingle."""
    w, n = F.col(words), F.size(F.col(words))
    runs = F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(size)])
    )
    return F.when(n >= size, runs).when(n > 0, F.array(F.concat_ws(" ", w))).otherwise(F.array().cast("array<string>"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def vote(df: DataFrame, keys: list[str], hashed: str) -> DataFrame:
    """Rows of (keys, hash) -> keys, n_terms, fp: a bit of fp is 1 if it is set in over half the
    hashes. A null hash votes for nothing; keys with no other have fingerprint 0."""
    h = F.col(hashed)
    lanes = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES))).alias(f"_l{i}") for i in range(32)]
    counted = df.groupBy(*keys).agg(F.count(h).alias("n_terms"), *lanes)

    def bit(i: int) -> Column:
        lane = F.col(f"_l{i % 32}")
        ones = F.shiftrightunsigned(lane, 32) if i >= 32 else lane.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(ones * 2 > F.col("n_terms"), F.lit(signed(1 << i))).otherwise(F.lit(0).cast("long"))

    fp = reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(64)])
    return counted.select(*keys, "n_terms", fp.alias("fp"))


def fingerprints(df: DataFrame, keys: list[str], words: str, size: int) -> DataFrame:
    """Fingerprint each row's word array over its shingles of ``size`` words: keys, n_terms, fp.

    Rows that agree in all keys stay apart, so repeated rows come out as often as they go in.
    """
    rows = df.select(F.monotonically_increasing_id().alias("_row"), *keys, words)
    terms = rows.select("_row", *keys, F.explode_outer(shingles(words, size)).alias("_t"))
    hashed = terms.select("_row", *keys, F.when(F.col("_t").isNotNull(), F.xxhash64("_t")).alias("_h"))
    return vote(hashed, ["_row", *keys], "_h").drop("_row")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
