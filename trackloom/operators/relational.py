"""Equi, anti and bijective joins, keep-first, upserts, staleness and fingerprints."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bijective(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose key stands exactly once on either side; counts are plain aggregations, so hot keys never gather."""
    one = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"), F.first("path").alias("path")).where("n = 1").drop("n")
    a, b = one(old).withColumnRenamed("path", "old_path"), one(new).withColumnRenamed("path", "new_path")
    return a.join(b, keys)


def keep_first(files: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Every file with the group's retained file (first in order) and whether it is that one; null keys are a group."""
    best = files.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("path").alias("retained"))).alias("b"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    found = files.join(best.select(*[f"_{c}" for c in group], F.col("b.retained").alias("retained")), same)
    return found.drop(*[f"_{c}" for c in group]).withColumn("kept", F.col("path") == F.col("retained"))


def by(*columns: str):
    return Window.partitionBy(*columns)


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    b, d = base.alias("b"), delta.alias("d")
    on = F.col(f"b.{key}") == F.col(f"d.{key}")
    has = F.col(f"d.{key}").isNotNull()
    return b.join(d, on, "full_outer").select(*[F.when(has, F.col(f"d.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in base.columns])


def first_write_wins(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    return base.unionByName(delta.join(base, key, "left_anti"))


def stale(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Dependencies whose fingerprint changed, appeared or vanished."""
    r, c = recorded.withColumnRenamed("fp", "was"), current.withColumnRenamed("fp", "now")
    reason = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return r.join(c, "dep", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("dep", reason.alias("reason"))


def index_fingerprint(rows: DataFrame, key: Column, line: Column, per_bucket: int = 50_000) -> DataFrame:
    """Order-independent fingerprint of a table: each row's line is hashed, the rows' hashes in order within a bucket,
    and the buckets' hashes in order, 256 to one at a time, up to the root.

    A bucket is by the first hex digits of the key's hash, so buckets stay even; there are so many digits (2 at
    least, always an even number) that a bucket has about ``per_bucket`` rows at most, whatever the table's size.
    """
    size, digits = rows.count(), 2
    while size > per_bucket * 16**digits:
        digits += 2
    bucket = F.substring(F.sha2(key.cast("string"), 256), 1, digits)
    each = rows.select(bucket.alias("b"), F.sha2(line, 256).alias("l")).groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("h"))
    for n in range(digits - 2, 0, -2):
        each = each.groupBy(F.substring("b", 1, n).alias("b")).agg(_joined().alias("h"))
    return each.agg(_joined().alias("fingerprint"), F.count("*").alias("buckets"))


def _joined() -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256)


def clobbers(moves: DataFrame) -> DataFrame:
    """Steps at which an ordered list of moves would put a second file on a path.

    ``(path, seq, delta)``: +1 a file arrives, -1 one leaves; the running sum of a path must stay at most 1.
    """
    w = Window.partitionBy("path").orderBy("seq", "delta").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return moves.withColumn("held", F.sum("delta").over(w)).where("held > 1").select("path", "seq", "held")
