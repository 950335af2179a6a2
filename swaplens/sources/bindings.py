"""The engine's tables, bound to the test tables. Only this module knows their schema.

Customers are patches, regions hospitals, nations slides; a customer's orders give descriptors;
embeddings are 8 x 8 images; the frozen scorer is linear in the standardized descriptors, with
weights from hashes of the seed. Held-out rows (split ``test``) are in the tables; queries read the
``val`` split unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import physical_cluster, uniform
from ..functions.stored import stored
from ..operators import features as standard
from ..operators import joins, matching

ROI_FEATURES = ["n_orders", "price_mean"]
CONTEXT_FEATURES = ["price_std", "open_share"]
FEATURES = ROI_FEATURES + CONTEXT_FEATURES
TARGETS = (0, 3, 4)
EXPECTED_PAIRS = tuple((1, t) for t in TARGETS)
SEEDS = (11, 42, 101)
SIDE, ROI = 8, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the alias names that canonicalization resolves."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    split = (
        F.when(F.col("n_regionkey") == 1, "val").when(F.col("n_regionkey") == 2, "test")
        .when(F.col("c_custkey") % 5 == 0, "id_val").otherwise("train")
    )
    patient = F.when(F.col("c_custkey") % 7 != 0, F.concat_ws("-", F.col("n_nationkey"), F.col("c_custkey") % 11))
    joined = c.join(F.broadcast(n.select("n_nationkey", "n_regionkey")), c.c_nationkey == n.n_nationkey)  # 25 nations
    return joined.select(
        F.col("c_custkey").alias("id"), split.alias("split"), F.col("n_regionkey").cast("int").alias("hospital"),
        F.concat(F.lit("slide_"), F.col("n_nationkey").cast("string")).alias("slide"), patient.alias("patient"),
        (F.col("c_acctbal") > 4500).cast("int").alias("y"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_metadata(spark, sf_dir)
    return raw.select(
        F.col("id").alias("source_id"), "split", F.col("hospital").alias("hospital_id"), F.col("slide").alias("slide_id"),
        F.col("patient").alias("patient_id"), F.col("y").alias("label"), physical_cluster(F.col("patient"), F.col("slide")).alias("physical_id"),
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    per = o.groupBy(F.col("o_custkey").alias("source_id")).agg(
        F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("price_mean"),
        F.stddev_pop("o_totalprice").alias("price_std"), F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("open_share"),
    )
    return joins.one_to_one(metadata(spark, sf_dir), per, ["source_id"])


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors with z columns, fitted on the training split. Written out, as all that follows reads them several times."""
    d = descriptors(spark, sf_dir)
    return stored(standard.transform(d, standard.validated(standard.fit_standardizer(d, FEATURES), FEATURES), FEATURES), "bank")


def audited(z: DataFrame, split: str = "val") -> DataFrame:
    return z.where(F.col("split") == split)


def matched(spark: SparkSession, sf_dir: str, rules: matching.Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """(triplets, ledger) of the audited split, without caps."""
    z = bank(spark, sf_dir)
    return matching.match(audited(z), z, FEATURES, rules or matching.Rules(), TARGETS)


def score(seed: Column, roi: str, context: str) -> Column:
    """The frozen scorer: what lies in the region of interest comes from ``roi``, the rest from ``context``."""
    total = F.lit(0.0)
    for prefix, names in ((roi, ROI_FEATURES), (context, CONTEXT_FEATURES)):
        for name in names:
            total = total + (uniform(seed, name) * 2 - 1) * F.col(f"{prefix}z_{name}")
    return total


def with_seeds(df: DataFrame, seeds: Sequence[int] = SEEDS) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def predictions(triplets: DataFrame, z: DataFrame, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """INF-1 as expressions: original, within and cross logits of each triplet and seed."""
    def of(prefix: str, key: str) -> DataFrame:
        return z.select(F.col("source_id").alias(key), *[F.col(f"z_{c}").alias(f"{prefix}z_{c}") for c in FEATURES])

    joined = triplets.join(of("s_", "source_id"), "source_id").join(of("w_", "within_donor"), "within_donor").join(of("c_", "cross_donor"), "cross_donor")
    s = F.col("seed")
    return with_seeds(joined, seeds).select(
        *triplets.columns, "seed", F.lit("linear").alias("backbone"), score(s, "s_", "s_").alias("original_logit"),
        score(s, "s_", "w_").alias("within_logit"), score(s, "s_", "c_").alias("cross_logit"))


def id_logits(z: DataFrame, seeds: Sequence[int] = SEEDS) -> DataFrame:
    own = with_seeds(audited(z, "id_val"), seeds)
    return own.select("source_id", "label", "seed", score(F.col("seed"), "", "").alias("logit"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("source_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("pixels"))


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image with the next one by id as donor."""
    a = images(spark, sf_dir)
    b = a.select((F.col("source_id") - 1).alias("source_id"), F.col("pixels").alias("donor"))
    return a.join(b, "source_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide and annotation files that exist, one per nation at most; every fourth nation has none."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 3")
    stem = F.format_string("Patient_%d_Node_%d", F.col("n_nationkey"), F.col("n_nationkey") % 3)
    kinds = F.explode(F.array(F.lit("tif"), F.when(F.col("n_nationkey") % 5 != 0, F.lit("xml")))).alias("kind")
    return n.select(stem.alias("stem"), kinds).where("kind is not null").select("stem", F.concat_ws("", F.lit("/slides/"), "stem", F.lit("."), "kind").alias("path"))


def slide_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides and files; nations divisible by 6 occur twice, those with remainder 5 never."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5")
    twice = F.explode(F.when(F.col("n_nationkey") % 6 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("v")
    return n.select(F.concat_ws("", F.lit("slide_"), "n_nationkey").alias("wilds_slide_id"), "n_nationkey", twice).select(
        "wilds_slide_id", F.format_string("patient_%d_node_%d%s", F.col("n_nationkey"), F.col("n_nationkey") % 3, F.when(F.col("v") == "b", "_b").otherwise("")).alias("camelyon_wsi"))
