"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders chosen where the session names none, by application.
_CHOSEN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where that is unset and Spark runs in this one process a temporary
    folder is chosen, once for each application; on a cluster executors couldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        # the setting can't be changed in a running session
        if context.applicationId not in _CHOSEN:
            _CHOSEN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="swaplens-shared-")
        root = _CHOSEN[context.applicationId]
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage is cut, and a lost executor costs a
    re-read, never a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/swaplens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
