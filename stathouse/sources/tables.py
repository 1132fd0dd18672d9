"""Table files: typed CSV with clean values, JSON lines, partitioned Parquet, file comparison."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="stathouse-")
    return f"{base.rstrip('/')}/stathouse-{uuid.uuid4().hex}"


def clean_values(df: DataFrame, date_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Values for a lossy CSV: commas become semicolons, 0 and empty become null, booleans 0 and 1, times are formatted."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c != "", F.replace(c, F.lit(","), F.lit(";")))
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.NumericType):
            c = F.when(c != 0, c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, date_format)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    clean_values(df).write.option("header", True).option("compression", "gzip").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, renamed: dict[str, str] | None = None) -> DataFrame:
    """Typed, trimmed; ``renamed`` gives columns names that a program can use."""
    df = spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return df.withColumnsRenamed(renamed or {})


def roundtrip(df: DataFrame, kind: str, partition_by: str | None = None) -> DataFrame:
    """Written to the shared folder and read back by schema."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    if kind == "csv":
        write_csv(df, path)
        return read_csv(spark, path, df.schema)
    writer = df.write.format(kind)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)
    return spark.read.schema(df.schema).format(kind).load(path)


def append_new(df: DataFrame, known: DataFrame, key: list[str], path: str) -> None:
    """Loads rows whose key isn't loaded yet; a second run adds nothing."""
    df.join(known.select(*key), key, "left_anti").write.mode("append").parquet(path)


def files_to_sync(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files (id, length, modificationTime) that the target lacks or has in an older state."""
    t = target.select("id", F.col("length").alias("_l"), F.col("modificationTime").alias("_m"))
    state = F.when(F.col("_l").isNull(), "missing").when((F.col("length") != F.col("_l")) & (F.col("modificationTime") > F.col("_m")), "outdated")
    return source.join(t, "id", "left").withColumn("state", state).where("state IS NOT NULL").drop("_l", "_m")


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.md5("content").alias("md5"))
