"""The plan that places finalised photos in a library by name and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import naming

OUTCOMES = ("placed_new", "already_present", "renamed_incoming", "blocked")


def finalised(handoff: DataFrame, renames: DataFrame) -> DataFrame:
    """``(fp, lib_dest, name, path)`` of the handoff's photos under the names that were planned for their content."""
    own = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    joined = handoff.select("fp", folder.alias("folder"), own.alias("own")).join(renames, "fp", "left")
    name = F.coalesce("new_name", "own")
    lib = F.regexp_replace("folder", "^[^/]*/?", "")
    return joined.select("fp", lib.alias("lib_dest"), name.alias("name"), F.concat_ws("/", "folder", name).alias("path"))


def unrecorded(on_disk: DataFrame, entries: DataFrame) -> DataFrame:
    """Photos on disk that the finalised record does not know."""
    return on_disk.join(entries.select("path"), "path", "left_anti")


def _disposed(entries: DataFrame, library: DataFrame) -> DataFrame:
    """Entries with ``lib_fp, readable`` of the library's file of their exact name, and whether a file has it but for case."""
    exact = library.select("lib_dest", "name", F.col("fp").alias("lib_fp"), "readable", F.lit(True).alias("there"))
    lower = library.select("lib_dest", F.lower("name").alias("low")).distinct().withColumn("clash", F.lit(True))
    return entries.withColumn("low", F.lower("name")).join(exact, ["lib_dest", "name"], "left").join(lower, ["lib_dest", "low"], "left")


def plan(entries: DataFrame, library: DataFrame) -> DataFrame:
    """``(path, lib_dest, name, outcome, target, collision)`` for ``entries(fp, lib_dest, name, path)`` and ``library(lib_dest, name, fp, readable)``.

    By content: an equal file under the name is present already, an unreadable one blocks, another means a new name.
    Without a file of that exact name the photo is placed, but if the library, or an entry before it in the
    order of paths, has the name but for case, it gets a new one too.  New names continue after the largest suffix of the library and
    the incoming batch; gaps stay.

    An entry claims its name when it is placed or present; the first of a folder's equal names (case aside) that has no
    library file of its exact name is the one that is placed, if the library has no such name and no entry before it is present.
    """
    d = _disposed(entries, library)
    there = F.coalesce("there", F.lit(False))
    by_content = F.when(~F.col("readable"), "blocked").when(F.col("lib_fp").eqNullSafe(F.col("fp")), "already_present").otherwise("renamed_incoming")
    first = F.when(there, by_content)
    d = d.withColumn("own", first).withColumn("free", first.isNull() & F.col("clash").isNull())
    # A name that the library has in no case: its entries are all without a file, and the first claims it.
    order = Window.partitionBy("lib_dest", "low").orderBy("path")
    d = d.withColumn("turn", F.row_number().over(order))
    outcome = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("free") & (F.col("turn") == 1), "placed_new").otherwise("renamed_incoming")
    d = d.withColumn("outcome", outcome)
    collision = F.when(F.col("outcome") == "renamed_incoming", F.when(there, "content").otherwise("case")).when(F.col("outcome") == "blocked", "unreadable")
    again = d.where("outcome = 'renamed_incoming'").select(F.col("lib_dest").alias("dir"), "path", "name")
    names = library.select(F.col("lib_dest").alias("dir"), "name").union(entries.select("lib_dest", "name"))
    renamed = naming.append_names(again, names).select("path", F.col("name").alias("new_name"))
    out = d.withColumn("collision", collision).join(renamed, "path", "left")
    return out.select("path", "lib_dest", "name", "outcome", F.concat_ws("/", F.nullif("lib_dest", F.lit("")), F.coalesce("new_name", "name")).alias("target"), "collision")


def totals(planned: DataFrame) -> DataFrame:
    return planned.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in OUTCOMES])


def reuse(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Library files with the fingerprint that was computed before, if size and time are the same; null means it must be computed."""
    known = cache.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("mtime_ns").alias("m"), F.col("fp").alias("cached"))
    return files.join(known, (F.col("path") == F.col("p")) & (F.col("size") == F.col("s")) & (F.col("mtime_ns") == F.col("m")), "left").drop("p", "s", "m")


def journey(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Merge steps of the photos that were moved: ``(path, action, value)``."""
    moved = planned.join(done.select("path"), "path", "left_semi").where("outcome <> 'blocked'")
    return moved.select("path", F.when(F.col("outcome") == "already_present", "merged_as_present").otherwise("merged").alias("action"), F.col("target").alias("value"))

