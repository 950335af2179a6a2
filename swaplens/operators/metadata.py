"""Metadata: canonical names, identities, integrity, slide and patch mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_missing, physical_cluster, present, require_columns

#: Names that raw tables use for each canonical column; the first present wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "source_id": ("source_id", "id", "index"),
    "split": ("split", "split_name"),
    "hospital_id": ("hospital_id", "hospital", "center"),
    "slide_id": ("slide_id", "slide"),
    "patient_id": ("patient_id", "patient"),
    "label": ("label", "y", "tumor"),
}
OPTIONAL = {"patient_id"}


def canonicalize(df: DataFrame) -> DataFrame:
    """META-1: canonical names, null patients where missing, physical_id; other columns stay.

    A column of another name that clashes with a canonical one is kept only under the latter.
    Duplicate ids are reported by ``duplicate_ids``; checking costs a shuffle, so it is separate.
    """
    chosen = {name: next((a for a in names if a in df.columns), None) for name, names in ALIASES.items()}
    missing = [n for n, c in chosen.items() if c is None and n not in OPTIONAL]
    if missing:
        raise KeyError(f"metadata lacks columns: {missing}")
    patient = F.col(chosen["patient_id"]).cast("string") if chosen["patient_id"] else F.lit(None).cast("string")
    cols = [F.col(c).alias(n) for n, c in chosen.items() if n != "patient_id"]
    rest = [c for c in df.columns if c not in chosen.values() and c not in ALIASES and c != "physical_id"]
    return df.select(
        *cols, F.when(~is_missing(patient), patient).alias("patient_id"),
        physical_cluster(patient, F.col(chosen["slide_id"])).alias("physical_id"), *rest,
    )


def duplicate_ids(df: DataFrame, key: str = "source_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def cluster_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """META-3: one row, distinct non-null values of each column."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def summary(df: DataFrame) -> DataFrame:
    """META-4: patch_count per split, hospital, slide and label; null keys count."""
    keys = ["split", "hospital_id", "slide_id", "label"]
    return df.groupBy(*keys).agg(F.count("*").alias("patch_count"))


def integrity(df: DataFrame, rows: int, slides: int, hospitals: Mapping[str, Sequence[int]]) -> DataFrame:
    """META-5: check, passed for each check and ``overall``; a split that is not expected fails."""
    spark = df.sparkSession
    one = df.agg(F.count("*").alias("rows"), F.count_distinct("slide_id").alias("slides"))
    counts = one.select(F.explode(F.array(
        F.struct(F.lit("row_count").alias("check"), (F.col("rows") == rows).alias("passed")),
        F.struct(F.lit("slide_count").alias("check"), (F.col("slides") == slides).alias("passed")),
    )).alias("c")).select("c.check", "c.passed")
    expected = spark.createDataFrame([(s, sorted(h)) for s, h in hospitals.items()], "split string, expected array<int>")
    seen = df.groupBy("split").agg(F.array_sort(F.collect_set("hospital_id")).alias("seen"))  # few hospitals
    sets = expected.join(seen, "split", "full").select(
        F.concat(F.lit("hospitals_"), "split").alias("check"), F.coalesce(F.col("seen") == F.col("expected"), F.lit(False)).alias("passed")
    )
    spans = df.groupBy("physical_id").agg(F.min("hospital_id").alias("lo"), F.max("hospital_id").alias("hi")).agg(
        F.coalesce(F.bool_and(F.col("lo") == F.col("hi")), F.lit(True)).alias("passed")
    ).select(F.lit("physical_id_in_one_hospital").alias("check"), "passed")
    checks = counts.unionByName(sets).unionByName(spans)
    return checks.unionByName(checks.agg(F.bool_and("passed").alias("passed")).select(F.lit("overall").alias("check"), "passed"))


def map_slides(metadata: DataFrame, manifest: DataFrame, key: str = "wilds_slide_id", value: str = "camelyon_wsi") -> DataFrame:
    """JOIN-9: each slide of the metadata is mapped (one row of the manifest), ambiguous (several)
    or unmapped (none). The manifest is one small row a slide; it is grouped before it joins."""
    require_columns(manifest, [key, value], "slide manifest")
    grouped = manifest.groupBy(F.col(key).alias("_k")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(value)), ";").alias("candidates")
    )
    slides = metadata.groupBy("slide_id").agg(
        F.array_join(F.array_sort(F.collect_set("split")), ";").alias("splits"),
        F.array_join(F.array_sort(F.collect_set(F.col("hospital_id").cast("string"))), ";").alias("hospitals"),
    )
    status = F.when(F.col("n") == 1, "mapped").when(F.col("n") > 1, "ambiguous").otherwise("unmapped")
    reason = F.when(F.col("n") == 1, "exact manifest match").when(F.col("n") > 1, "several manifest rows").otherwise("no manifest row")
    return slides.join(grouped, slides.slide_id == grouped["_k"], "left").select(
        "slide_id", "splits", "hospitals", status.alias("mapping_status"), reason.alias("mapping_reason"),
        F.when(F.col("n") == 1, F.col("candidates")).alias(value), F.coalesce("candidates", F.lit("")).alias("candidates"),
    )


def normalized_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def manifest_by_name(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """JOIN-10: slides whose (patient, node) is one and the same, joined to files by the name
    ``patient<p>node<n>`` without case and signs."""
    parts = metadata.where(~is_missing(F.col("patient_id")) & F.col("node").isNotNull()).groupBy("slide_id").agg(
        F.count_distinct("patient_id", "node").alias("n"), F.min("patient_id").alias("patient_id"), F.min("node").alias("node"),
    ).where("n = 1").withColumn("name", normalized_name(F.concat(F.lit("patient"), F.col("patient_id"), F.lit("node"), F.col("node"))))
    named = files.withColumn("name", normalized_name(F.col("stem")))
    return parts.join(named, "name").select("slide_id", "patient_id", "node", "path")


def patch_mapping(
    metadata: DataFrame, slides: DataFrame, files: DataFrame, patch_size: int | None, scale: float | None,
    level: int | None, orientation: str | None, reference: str | None,
) -> DataFrame:
    """JOIN-11: patch ledger with one status and the first reason that applies.

    slides: slide_id, mapping_status, mapping_reason, camelyon_wsi, wsi_path, annotation_path.
    files: path of every file that exists; that a path is listed stands for a look at the disk.
    """
    xy = ("x", "y") if {"x", "y"} <= set(metadata.columns) else ("x_coord", "y_coord")
    known = slides.groupBy("slide_id").agg(
        F.count("*").alias("_n"), *[F.min(c).alias(f"_{c}") for c in ("mapping_status", "mapping_reason", "camelyon_wsi", "wsi_path", "annotation_path")]
    )
    stem = F.lower(F.regexp_extract("path", r"([^/]+)\.xml$", 1))
    xml = files.where(F.col("path").endswith(".xml")).groupBy(stem.alias("_stem")).agg(F.count("*").alias("_n_xml"), F.min("path").alias("_xml"))
    wsi = files.select(F.col("path").alias("_wsi_path"), F.lit(True).alias("_has_wsi")).distinct()
    own = files.select(F.col("path").alias("_annotation_path"), F.lit(True).alias("_has_own")).distinct()
    j = (
        metadata.join(known, "slide_id", "left").join(wsi, "_wsi_path", "left").join(own, "_annotation_path", "left")
        .withColumn("_stem", F.lower(F.col("_camelyon_wsi"))).join(xml, "_stem", "left")
    )
    given = ~is_missing(F.col("_annotation_path"))
    configured = patch_size is not None and patch_size > 0 and scale is not None and scale > 0
    ladder = [
        ((F.col("_n") > 1) | (F.col("_mapping_status") == "ambiguous"), "ambiguous", F.lit("ambiguous slide mapping")),
        (F.coalesce(F.col("_mapping_status") != "mapped", F.lit(True)), "unavailable", F.coalesce("_mapping_reason", F.lit("no exact slide mapping"))),
        (is_missing(F.col(xy[0])) | is_missing(F.col(xy[1])), "unavailable", F.lit("missing patch coordinates")),
        (F.lit(not configured), "unavailable", F.lit("patch size and scale are not configured")),
        (F.lit(level is None), "unavailable", F.lit("coordinate level is not configured")),
        (F.lit(orientation != "identity"), "unavailable", F.lit("orientation is not validated as identity")),
        (F.lit(reference != "top_left"), "unavailable", F.lit("coordinate reference is not top_left")),
        (F.col("_has_wsi").isNull(), "unavailable", F.lit("mapped slide file is missing")),
        (~given & (F.col("_n_xml") > 1), "ambiguous", F.lit("several annotation files")),
        (~given & F.col("_n_xml").isNull(), "unavailable", F.lit("annotation file is missing")),
        (given & F.col("_has_own").isNull(), "unavailable", F.lit("mapped annotation file is missing")),
    ]
    status, reason = F.lit("mapped"), F.lit("exact mapping")
    for test, s, r in reversed(ladder):
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    return j.select(
        *present(metadata, ["source_id", "label", "split", "hospital_id", "slide_id", "patient_id"]),
        F.col("_camelyon_wsi").alias("camelyon_wsi"), F.col("_wsi_path").alias("wsi_path"), F.col(xy[0]).alias("x"), F.col(xy[1]).alias("y"),
        F.when(given, F.col("_annotation_path")).when(F.col("_n_xml") == 1, F.col("_xml")).alias("annotation_path"),
        status.alias("mapping_status"), reason.alias("mapping_reason"),
    )
