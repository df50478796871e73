"""State that runs write: tables in versions, snapshots, journals and documents.

A version is a folder that is written whole and then named in the table's log, so a reader sees the version before or the
one after, never a part; a run that is repeated writes nothing if the content is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import relational


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def content_digest(df: DataFrame) -> str:
    """Digest of a table's rows in any order: count and sums of two row hashes (64 bits each, 128 in all, which tell versions apart)."""
    cols = sorted(df.columns)
    flat = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in cols]
    r = df.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(salt), *flat).cast("decimal(38,0)")) for salt in (1, 2)]).first()
    return ":".join(str(x or 0) for x in r)


class Table:
    """A table kept in versions ``v-000, v-001, ...`` under a folder."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def versions(self) -> list[str]:
        fs, path = _fs(self.spark, self.at)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((n for n in names if n.startswith("v-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{n}/_SUCCESS"))), key=lambda n: int(n[2:]))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{self.versions()[-1]}")

    def write(self, df: DataFrame) -> bool:
        """A new version, unless the last one has the same rows; the old ones stay as backups.  Whether one was written."""
        have = self.versions()
        if have and content_digest(self.read()) == content_digest(df) and sorted(self.read().columns) == sorted(df.columns):
            return False
        df.write.parquet(f"{self.at}/v-{int(have[-1][2:]) + 1 if have else 0:03d}")
        return True

    def batch(self, *changes) -> bool:
        """Several changes (functions of the table) as one version: all of them are seen, or none."""
        df = self.read()
        for change in changes:
            df = change(df)
        return self.write(df)


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def rename(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes(old, new)``: rows under a new key; a row that had that key before is replaced."""
    to = table.join(changes, table[key] == changes.old, "left")
    kept = to.join(changes.select(F.col("new").alias("_n")), (F.col(key) == F.col("_n")) & F.col("old").isNull(), "left_anti")
    return kept.withColumn(key, F.coalesce("new", key)).drop("old", "new")


def snapshot(table: DataFrame, at: str) -> bool:
    """A copy that is read back and compared; whether it is the same."""
    table.write.parquet(at)
    return content_digest(table.sparkSession.read.parquet(at)) == content_digest(table)


def append(rows: DataFrame, at: str) -> DataFrame:
    """Rows added to a log; the log."""
    rows.write.mode("append").parquet(at)
    return rows.sparkSession.read.parquet(at)


def lines(rows: DataFrame, order: list[str], at: str) -> None:
    """Rows as JSON lines in total order, in files whose names follow it; keys sorted."""
    cols = sorted(rows.columns)
    rows.orderBy(*order).select(F.to_json(F.struct(*cols)).alias("value")).write.text(at)


def manifest(files: DataFrame) -> DataFrame:
    """``(name, path, sha256, size)`` of files with their content."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.sha2("content", 256).alias("sha256"), "size")


def dependencies(parts: dict[str, DataFrame], key: str, line: Column) -> DataFrame:
    """``(dep, fp)``: each part's index fingerprint."""
    out = None
    for name, df in parts.items():
        one = relational.index_fingerprint(df, F.col(key), line).select(F.lit(name).alias("dep"), F.col("fingerprint").alias("fp"))
        out = one if out is None else out.union(one)
    return out
