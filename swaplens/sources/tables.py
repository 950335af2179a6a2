"""Readers and writers: suffix dispatch, sharded splits, manifests, file discovery, polygons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import require_columns


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet or CSV by suffix (SRC-1); other suffixes raise. CSV takes a schema, or has text columns."""
    if path.rstrip("/").endswith(".parquet"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True).option("nullValue", "")
        return (reader if schema is None else reader.schema(schema)).csv(path)
    raise ValueError(f"unsupported table suffix: {path}")


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), single_file: bool = False) -> None:
    """Write by suffix (SNK-1). The commit protocol makes the output appear whole or not at all;
    ``single_file`` is for small reports."""
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".parquet"):
        writer.parquet(path)
    elif path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported table suffix: {path}")


def derived_split(split: Column, center: Column) -> Column:
    """Name of a shard's split (SRC-2): a validation shard is ``val`` only for center 1."""
    return F.when(split != "validation", split).when(center == 1, F.lit("val")).otherwise(F.lit("id_val"))


def read_shards(shards: dict[str, DataFrame], center: str) -> DataFrame:
    """Shards per raw split -> one table with ``split`` (SRC-2)."""
    named = [df.withColumn("split", derived_split(F.lit(s), F.col(center))) for s, df in shards.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def metadata_frame(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Projection under new names (SRC-3). Ids come from the data, never from row positions."""
    require_columns(df, list(renames), "metadata")
    return df.select([F.col(old).alias(new) for old, new in renames.items()])


def rows_by_id(df: DataFrame, wanted: DataFrame, key: str = "source_id") -> DataFrame:
    """Random access by id (SRC-4): only the wanted rows, each as often as it is asked for."""
    return wanted.select(key).join(df, key)


def kept_ids(df: DataFrame, wanted: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows whose id is wanted (FLT-2), each once, however often it is asked for; a null id is nobody's."""
    return df.join(wanted.select(key), key, "left_semi")


def decode_split(df: DataFrame, names: DataFrame, code: str = "split_code") -> DataFrame:
    """Split code -> name by a small dimension (code, split) (SRC-5)."""
    return df.join(names, code, "left").drop(code)


def discover_files(spark: SparkSession, root: str, pattern: str = "*.tif") -> DataFrame:
    """Files below ``root``, recursively: path, stem, patient, node from the name (SRC-8).
    Only the listing is read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select("path", stem.alias("stem")).transform(with_name_parts)


def with_name_parts(df: DataFrame, name: str = "stem") -> DataFrame:
    """Patient and node numbers of a file name, null where it has none."""
    part = lambda kind: F.when(F.col(name).rlike(rf"(?i){kind}[_-]?\d+"), F.regexp_extract(name, rf"(?i){kind}[_-]?(\d+)", 1))
    return df.withColumns({"patient": part("patient"), "node": part("node")})


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Annotation XML -> one row per polygon of at least three points: path, polygon array<struct<x,y>> (SRC-9)."""
    schema = "_Name string, Coordinates struct<Coordinate:array<struct<_Order:int,_X:double,_Y:double>>>"
    rows = spark.read.format("xml").option("rowTag", "Annotation").schema(schema).load(path)
    points = F.transform("Coordinates.Coordinate", lambda p: F.struct(p["_X"].alias("x"), p["_Y"].alias("y")))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_Name").alias("name"), points.alias("polygon")).where(F.size("polygon") >= 3)


def manifest(files: DataFrame) -> DataFrame:
    """binaryFile rows -> path, bytes, sha256 (SNK-3)."""
    return files.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Entries that are absent or differ; none if all is well (SNK-3)."""
    a = actual.select("path", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("actual_sha256"))
    joined = expected.join(a, "path", "left")
    reason = (
        F.when(F.col("actual_sha256").isNull(), "missing").when(F.col("bytes") != F.col("actual_bytes"), "size")
        .when(F.col("sha256") != F.col("actual_sha256"), "sha256")
    )
    return joined.withColumn("reason", reason).where("reason is not null").select("path", "reason")


#: Where artifacts may lie, parts of a path that would hold source data, and the suffixes of images
#: and annotations, which belong to final figures only.
TOP_LEVEL = ("README.md", "MANIFEST.json", "protocol", "p0", "subsets", "checkpoints", "predictions", "audits", "aggregate", "figures", "logs")
FORBIDDEN_PARTS = ("camelyon17", "wsi", "xml_annotations", "raw", "wilds")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".svs", ".xml")
FIGURES = ("figures", "final")


def artifact_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``artifact_path`` (with single forward slashes, none in front; null if the policy forbids it) and ``reason`` (null if
    allowed): outside the layout, source data, or an image that is no final figure (SNK-3)."""
    parts = F.filter(F.split(F.translate(F.coalesce(F.col(path), F.lit("")), "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    last = F.lower(F.coalesce(F.get(F.col("_parts"), F.size("_parts") - 1), F.lit("")))
    suffix = F.regexp_extract(last, r"[^.](\.[^.]+)$", 1)
    final = (F.get(F.col("_parts"), F.lit(0)) == FIGURES[0]) & (F.get(F.col("_parts"), F.lit(1)) == FIGURES[1])
    lowered = F.transform("_parts", lambda x: F.lower(x))
    reason = (
        F.when(~F.coalesce(F.get(F.col("_parts"), F.lit(0)).isin(*TOP_LEVEL), F.lit(False)), "outside the layout")
        .when(F.arrays_overlap(lowered, F.array(*[F.lit(x) for x in FORBIDDEN_PARTS])), "source data")
        .when(suffix.isin(*IMAGE_SUFFIXES) & ~F.coalesce(final, F.lit(False)), "not a final figure"))
    named = df.withColumn("_parts", parts).withColumn("reason", reason)
    return named.withColumn("artifact_path", F.when(F.col("reason").isNull(), F.array_join("_parts", "/"))).drop("_parts")
