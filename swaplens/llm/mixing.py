"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import content_key, fresh, materialize, repeated
from .simhash import ascii_words

#: Weights of the sources by code point, repeating; share of all sizes; most copies.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents that one task rounds at once, about, and residuals that one node of the tree combines.
LEAF, FAN_IN = 4096, 256


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n) -> the same with target: ``SHARE`` of all sizes by weight, at most
    ``MOST`` times the source's size, the excess reshared until none is above.

    Works on one row per source, ranked in one window. Each round settles every source that its share would overfill;
    the rounds end when none is, at the latest when all are settled.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    table = materialize(
        sizes.withColumn("weight", F.get(weights, F.pmod(rank - 1, F.lit(len(WEIGHTS)))))
        .withColumn("cap", F.col("source_size") * MOST), "sources"
    )
    budget = float(table.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * SHARE
    rate = 0.0  # of target words for a weight of 1
    while True:
        full = F.col("cap") <= F.col("weight") * rate
        r = table.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("settled"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not r["open"]:
            break
        new = max(0.0, budget - r["settled"]) / r["open"]
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    return table.withColumn("target", F.least(F.col("cap"), F.col("weight") * rate)).drop("weight", "cap")


def _pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> int:
    """Round the probabilities ``p`` in place to 0 or 1, but for one whose place is returned (-1:
    none). Each step moves mass between two fractional units so that expected words stay put:
    one of the two becomes integral, at random, with every unit's expectation unchanged."""
    open_at = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # words that a can gain from b
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        words = up if u[i] * (up + down) < down else -down
        p[a] += words / size[a]
        p[b] -= words / size[b]
        for k in (a, b):
            p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
        still = [k for k in (a, b) if 0.0 < p[k] < 1.0]
        open_at = still[0] if still else -1
    return open_at


def _draw(seed: int, level: int) -> Column:
    """A uniform number of (0, 1) from a unit's key; the same in every rerun."""
    return (F.pmod(F.xxhash64("k1", "k2", F.lit(seed), F.lit(level)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


UNITS = "source string, k1 long, k2 long, size long, p double, groups long"


def _round_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["u", "k1", "k2"], ignore_index=True)
    p, size = pdf["p"].to_numpy(float).copy(), np.maximum(pdf["size"].to_numpy(float), 1e-12)
    _pivot(p, size, pdf["u2"].to_numpy(float))
    return pdf.assign(p=p)[["source", "k1", "k2", "size", "p", "groups"]]


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    size counts the words ``[^\\x20\\x09-\\x0D]+`` of the text. A source's documents are each taken
    target / source_size times on average: the whole part for sure, the fraction by pivotal
    rounding, in words, over groups of about ``LEAF`` documents; each group leaves one fractional
    unit at most, and a tree of ``FAN_IN`` combines those until a source has one, which a draw
    rounds. So a source misses its target by less than one document's size. Groups and draws
    follow from the content of rows, not from partitions or ids, so reruns agree. Null texts have size 0
    and are taken as often as the fraction says, with 0 words; null is a source, last in order. Rows that
    agree in all columns are one unit, whose copies are shared out evenly.
    """
    units = _copies(docs, id_col, text_col, source_col, seed)
    each = F.floor(F.col("all") / F.col("rows"))
    more = F.col("all") - each * F.col("rows")
    part = lambda times, copies: F.struct(times.alias("times"), copies.alias("copies"))
    shares = units.withColumn("share", F.explode(F.array(part(F.col("rows") - more, each), part(more, each + 1)))).where("share.times > 0")
    rows = materialize(shares.select(
        "doc_id", "size", "source_size", "target", (F.col("share.copies") * F.col("size")).alias("taken"), "share.copies", "share.times"), "shares")
    return repeated(rows, "times")


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """k1, k2 (content), rows that agree in them, doc_id, size, source_size, target, all: their copies."""
    k1, k2 = content_key(docs)
    rows = docs.select(
        k1.alias("k1"), k2.alias("k2"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.size(ascii_words(F.col(text_col))).cast("long").alias("size"),
    )
    sized = materialize(rows.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    targets = source_targets(
        sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    )
    targets = materialize(targets, "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a third of the rows may share a source: what joins it is one row a source
    units = materialize(
        sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", F.round(rate * F.col("rows"), 12))
        .select("k1", "k2", "rows", "doc_id", "source", "size", "source_size", "target", "n",
                F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p")),
        "units",
    )
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / LEAF)).cast("long")
    level, open_units, done = 0, units.where("p > 0 and size > 0").withColumn("groups", groups), []
    while True:
        dealt = open_units.select(
            "source", "k1", "k2", "size", "p", "groups", F.pmod(F.xxhash64("k1", "k2", F.lit(level)), F.col("groups")).alias("g"),
            _draw(seed, 2 * level).alias("u"), _draw(seed, 2 * level + 1).alias("u2"),
        )
        rounded = materialize(dealt.groupBy("source", "groups", "g").applyInPandas(_round_group, UNITS), "rounded")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        final = F.when(is_open, (_draw(seed, -1) < F.col("p")).cast("double")).otherwise(F.col("p")).alias("extra")
        last = rounded.agg(F.max("groups").alias("g")).first()["g"] in (None, 1)
        done.append((rounded if last else rounded.where(~is_open | (F.col("groups") == 1))).select("k1", "k2", final))
        if last:
            break
        open_units = rounded.where(is_open & (F.col("groups") > 1)).withColumn(
            "groups", F.greatest(F.lit(1), F.ceil(F.col("groups") / FAN_IN)).cast("long"))
        level += 1
    extra = done[0]
    for more in done[1:]:
        extra = extra.unionByName(more)
    blank = F.when(F.col("size") == 0, (_draw(seed, -1) < F.col("p")).cast("double")).otherwise(0.0)
    return units.join(extra, ["k1", "k2"], "left").select(
        "k1", "k2", "rows", "doc_id", "size", "source_size", "target", (F.col("whole") + F.coalesce(F.col("extra"), blank).cast("long")).alias("all")
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20
) -> DataFrame:
    """The documents as the mix takes them: each row as many times as its copies, columns unchanged.

    Rows find their copies by the key of their content, so rows that share an id, or have none, keep
    their own; rows that agree in all columns stand for one another.
    """
    copies = materialize(_copies(docs, id_col, text_col, source_col, seed).where("all > 0").select("k1", "k2", "rows", "all"), "copies")
    a, b, times = fresh(docs, "k1", "k2", "times")
    keyed = docs.withColumns(dict(zip((a, b), content_key(docs), strict=True)))
    taken = lambda some: keyed.join(some.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("all").alias(times)), [a, b])
    # a row of its own is taken MOST times at most
    out = taken(copies.where("rows = 1")).withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).drop(times)
    if copies.where("rows > 1").limit(1).count():
        out = out.unionByName(repeated(materialize(taken(copies.where("rows > 1")).dropDuplicates([a, b]), "repeated"), times))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
