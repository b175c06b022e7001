"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new local folder, but only for a master that runs in this process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="docmill-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(root)
    return root


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str = "kept") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: worked out once, whoever reads it, and safe from lost executors."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
