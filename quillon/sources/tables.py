"""Sources and sinks: tables with a declared schema, ordered arrays and sample matrices, delimited text, generators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of types in a declared schema.
TYPES = {"Int64": T.LongType(), "Int32": T.IntegerType(), "Float64": T.DoubleType(), "Float32": T.FloatType(), "Bool": T.BooleanType(), "String": T.StringType()}


def schema(columns: dict[str, str | T.DataType]) -> T.StructType:
    """{name: type} as a StructType; types by the names of TYPES or as Spark types. Unknown names raise."""
    return T.StructType([T.StructField(c, t if isinstance(t, T.DataType) else TYPES[t]) for c, t in columns.items()])


def default_path(name: str = "") -> str:
    """Where inputs lie: $QUILLON_DATA, else $SCRATCH/input_data, else input_data under the working folder."""
    base = os.environ.get("QUILLON_DATA") or (f"{os.environ['SCRATCH']}/input_data" if os.environ.get("SCRATCH") else "input_data")
    return f"{base.rstrip('/')}/{name}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A session on one machine that names none gets one of its own; any other raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a shared file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, path: str, columns: dict[str, str | T.DataType]) -> DataFrame:
    """The declared columns of a Parquet table and no others. A declared column that the file lacks or holds as another type raises ValueError."""
    df = spark.read.parquet(path)
    there = dict(df.dtypes)
    for f in schema(columns):
        if there.get(f.name) != f.dataType.simpleString():
            raise ValueError(f"{path}: {f.name} is {there.get(f.name)}, declared as {f.dataType.simpleString()}")
    return df.select(*columns)


def write_array(df: DataFrame, file: str, variable: str, append: bool = False) -> None:
    """Store an array (idx and value, or idx and features) as one variable of a file: a folder with a Parquet table for each.

    Each variable is replaced as a whole; other variables of the file stay.
    """
    df.write.mode("append" if append else "overwrite").parquet(f"{file.rstrip('/')}/{variable.strip('/')}")


def read_array(spark: SparkSession, file: str, variable: str) -> DataFrame:
    return spark.read.parquet(f"{file.rstrip('/')}/{variable.strip('/')}")


def write_text(df: DataFrame, path: str, sep: str = ",") -> None:
    """One line per sample in the order of idx: the value, or the features of a matrix, without idx.

    Rows are range-partitioned by idx, so the part files in order of name are the array.
    """
    value = F.concat_ws(sep, F.transform("features", lambda x: x.cast("string"))) if "features" in df.columns else F.col("value").cast("string")
    df.repartitionByRange("idx").sortWithinPartitions("idx").select(value.alias("value")).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str, width: int = 1, sep: str = ",") -> DataFrame:
    """Lines of numbers as (idx, value), or (idx, features) if width is over 1; idx counts from 0 by name of file and line.

    Files are read in splits, which tasks take by size, not by name. A first pass counts the lines of each
    split; the running sums of those counts, a row per split, are what the lines of a split are numbered from.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("_id"))
    per = lines.groupBy("_file", "_start").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_base"))
    lines = lines.join(base, ["_file", "_start"]).withColumn("idx", F.col("_base") + F.col("_id"))
    if width == 1:
        return lines.select("idx", F.col("value").cast("double").alias("value"))
    return lines.select("idx", F.transform(F.split("value", sep), lambda x: F.trim(x).cast("double")).alias("features"))


def read_csv_table(spark: SparkSession, path: str, columns: dict[str, str | T.DataType], sep: str = ",", missing: str = "") -> DataFrame:
    """A delimited file as a table; `missing` reads as null."""
    return spark.read.schema(schema(columns)).csv(path, sep=sep, nullValue=missing, header=False)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def zeros(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(0.0).alias("value"))


def ones(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(1.0).alias("value"))


def comprehension(spark: SparkSession, n: int, f) -> DataFrame:
    """[f(i) for i in 1..n] as (idx, value); f takes and returns a column."""
    return spark.range(1, n + 1).select(F.col("id").alias("idx"), f(F.col("id")).alias("value"))


def uniform(spark: SparkSession, n: int, seed: int, width: int = 1) -> DataFrame:
    """Random numbers of [0, 1): (idx, value), or (idx, features)."""
    v = F.rand(seed).alias("value") if width == 1 else F.array(*(F.rand(seed + k) for k in range(width))).alias("features")
    return spark.range(n).select(F.col("id").alias("idx"), v)


def normal(spark: SparkSession, n: int, seed: int, width: int = 1) -> DataFrame:
    v = F.randn(seed).alias("value") if width == 1 else F.array(*(F.randn(seed + k) for k in range(width))).alias("features")
    return spark.range(n).select(F.col("id").alias("idx"), v)


def regression_data(spark: SparkSession, n: int, weights: list[list[float]], seed: int = 1, logistic: bool = False) -> DataFrame:
    """Samples for regression: (idx, features, labels), a label per row of weights; logistic: labels are the sign, 1 or -1."""
    x = uniform(spark, n, seed, len(weights[0]))
    dots = [sum((F.col("features")[k] * float(w) for k, w in enumerate(ws)), F.lit(0.0)) for ws in weights]
    return x.withColumn("labels", F.array(*(F.when(d > 0, 1.0).otherwise(-1.0) if logistic else d for d in dots)))
