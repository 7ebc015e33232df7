"""Tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.  Only a local master, as in tests, may leave spark.checkpoint.dir unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/") + "/quillon"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles.  The planner takes the size of compressed files for that of their rows, and would
    send tables of millions of rows to the driver and on to all executors."""
    return df.hint("merge")
