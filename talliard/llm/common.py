"""What the corpus operators share: the word pattern, scratch tables in the shared folder, and Arrow batches."""

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word by white space, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text"):
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder that spark.checkpoint.dir names; a temporary folder only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.gettempdir()}/talliard-scratch"
    return f"{base}/talliard-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage and survives a lost executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns under names that no operator uses for its own, and these names by column."""
    names = {c: f"_in{k}" for k, c in enumerate(df.columns)}
    return df.select(*(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in names.items())), names


def shown(names: dict[str, str], *but: str) -> list:
    """The columns of hidden() under their own names, without some."""
    return [F.col(n).alias(c) for c, n in names.items() if c not in but]


#: Rows of a broadcast side at most.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast, after counting up to the limit; a larger one is left to a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which grow with the input where the cluster sets them so."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def wider(df: DataFrame, more: str) -> StructType:
    """The schema of df with more columns, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])
