"""Gates before a run: each is a relation of what stands against it; a gate holds if its relation is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def workspace(files: DataFrame, recorded: DataFrame) -> dict[str, tuple[str, DataFrame]]:
    """Gates of calibrating and merging a workspace: name to reason and the paths that break it."""
    photo = F.col("class").isin("image", "raw")
    dest = files.where("top = 'by-dest'")
    was = recorded.select("path", F.col("size").alias("was"))
    return {
        "stale": ("changed since planning", files.join(was, "path").where("size <> was").select("path")),
        "sources": ("sources are not empty", files.where("top = 'sources'").select("path")),
        "by-date": ("photos are left by date", files.where((F.col("top") == "by-date") & photo).select("path")),
        "by-dest": ("not only photos", dest.where(~photo).select("path")),
        "library": ("photos are not in the record", dest.where(photo).join(recorded.select("path"), "path", "left_anti").select("path")),
    }


def failed(gates: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """``(gate, reason, n, example)`` of the gates that do not hold, all of them in one pass of aggregation."""
    every = None
    for name, (reason, paths) in gates.items():
        one = paths.select(F.lit(name).alias("gate"), F.lit(reason).alias("reason"), "path")
        every = one if every is None else every.union(one)
    return every.groupBy("gate", "reason").agg(F.count("*").alias("n"), F.min("path").alias("example"))
