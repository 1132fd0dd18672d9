"""Objects and tables in a shared store: text objects, documents in several places, batches, backups with keys derived anew."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import matching
from . import tables


class ObjectStore:
    """Text objects below a folder of any file system that Spark reaches: write, read, list, rename, delete."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _at(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{key}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, key: str) -> bool:
        path, fs = self._at(key)
        return fs.exists(path)

    def write(self, key: str, text: str) -> None:
        path, fs = self._at(key)
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, key: str) -> str | None:
        """Null if there is no such object."""
        if not self.exists(key):
            return None
        return self.spark.read.text(f"{self.base}/{key}", wholetext=True).first()[0]

    def rename(self, old: str, new: str) -> bool:
        (a, fs), (b, _) = self._at(old), self._at(new)
        fs.mkdirs(b.getParent())
        return fs.rename(a, b)

    def delete(self, key: str) -> bool:
        path, fs = self._at(key)
        return fs.delete(path, True)

    def keys(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.base).select("path", "length")
        return files.select(F.regexp_extract("path", rf"{self.base.split(':')[-1]}/(.*)$", 1).alias("key"), "length")


def save_everywhere(df: DataFrame, paths: list[str], kind: str = "json") -> dict[str, str | None]:
    """The same table at several places; what each said (null: written).  One that fails doesn't stop the others."""
    said: dict[str, str | None] = {}
    for path in paths:
        try:
            df.write.mode("overwrite").format(kind).save(path)
            said[path] = None
        except Exception as e:  # noqa: BLE001  the caller sees it
            said[path] = f"{type(e).__name__}: {e}"[:500]
    return said


def in_batches(df: DataFrame, path: str, rows: int = 20_000) -> DataFrame:
    """Written in files of at most ``rows`` rows, and read back."""
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def from_naive_csv(df: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """Rows of CSV texts without quotes: a header line, then values by place; empty ones are null."""
    lines = F.filter(F.split(F.col(text), "\r?\n"), lambda x: F.trim(x) != "")
    keys = [c for c in df.columns if c != text]
    rows = df.select(*keys, F.posexplode(lines).alias("_n", "_l")).where("_n > 0").withColumn("_v", F.split("_l", ",", -1))
    value = lambda i, f: F.nullif(F.trim(F.try_element_at("_v", F.lit(i + 1))), F.lit("")).try_cast(f.dataType).alias(f.name)
    return rows.select(*keys, *(value(i, f) for i, f in enumerate(schema.fields)))


def backup(named: Mapping[str, DataFrame], path: str) -> None:
    """Each table as CSV with clean values."""
    for name, df in named.items():
        tables.write_csv(df, f"{path}/{name}")


def restore(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType], order: list[str], keys: Mapping[str, list[tuple[str, list[str], str, str]]]) -> dict[str, DataFrame]:
    """Tables of a backup in order of their dependencies; surrogate keys are looked up anew.

    keys: table -> (parent table, natural key, parent's id, name of the new column).
    """
    out: dict[str, DataFrame] = {}
    for name in order:
        df = tables.read_csv(spark, f"{path}/{name}", schemas[name])
        lookups = [(out[parent].select(*natural, own).withColumnRenamed(own, f"_{own}"), natural, f"_{own}", column) for parent, natural, own, column in keys.get(name, [])]
        out[name] = matching.with_keys(df, lookups) if lookups else df
    return out


def as_views(named: Mapping[str, DataFrame]) -> None:
    """Names that SQL can use."""
    for name, df in named.items():
        df.createOrReplaceTempView(name)


def report_lines(df: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """A table's rows as text of fixed columns."""
    return df.select(F.concat_ws(" | ", *(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ") for c, n in widths.items())).alias("line"))


def player_json(df: DataFrame, column: str) -> DataFrame:
    """Rows of a player service's answers (one or many players a document)."""
    kind = "people array<struct<id: int, fullName: string, birthDate: string, mlbDebutDate: string, batSide: struct<code: string>, pitchHand: struct<code: string>>>"
    people = df.select(*(c for c in df.columns if c != column), F.explode(F.from_json(column, kind)["people"]).alias("p"))
    return people.select(*(c for c in df.columns if c != column), "p.id", F.col("p.fullName").alias("name"), F.to_date("p.birthDate").alias("birth_date"), F.to_date("p.mlbDebutDate").alias("debut"), F.col("p.batSide.code").alias("bats"), F.col("p.pitchHand.code").alias("throws"))


def orphans(facts: DataFrame, dimension: DataFrame, column: str, key: str) -> DataFrame:
    """Ids that facts use and the dimension lacks, and how often."""
    used = facts.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n"))
    return used.join(dimension.select(key), key, "left_anti")


#: The order in which data sets depend on one another.
IMPORT_ORDER = ("bbref_games_for_date", "brooks_games_for_date", "bbref_boxscores", "brooks_pitch_logs", "brooks_pitchfx")


def import_order(found: DataFrame, kind: str) -> DataFrame:
    """Files with the step at which their data set is imported; others are left out."""
    step = F.array_position(F.array(*map(F.lit, IMPORT_ORDER)), F.col(kind)).cast("int")
    return found.withColumn("step", step).where("step > 0")
