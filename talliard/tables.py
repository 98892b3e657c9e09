"""Reading the driver's Parquet tables by a path only Spark needs to understand, and staging a result in the shared folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir (a temporary folder only where that is unset, on a local master)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/talliard-stage"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to a new shared path and read back."""
    spark = df.sparkSession
    path = shared_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
