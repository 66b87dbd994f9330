"""What the corpus operators share: tables, words, durable cuts, encoded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

#: White space of the contracts; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker is given at a time, where the session leaves Spark's default: texts may be long.
ROWS = 1000


def lean(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def key_of(col: Column) -> Column:
    """A non-null string for equality joins, distinct for null and every value."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share."""
    lean(spark)
    return tables.shared_folder(spark)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
