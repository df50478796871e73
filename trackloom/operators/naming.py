"""Collision-free names: ``base.ext``, ``base-001.ext``, ...; case-insensitive.

Names are slots: 0 is the bare name, N the one with ``-NNN``.  The items that want one name (of a
folder, base and extension) get its free slots in the order of their paths: the r-th free
slot is r plus the number of taken slots before it, which a running count over both sides gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def _parts(name: Column) -> tuple[Column, Column]:
    """Stem and extension (without its dot; empty where there is none) in lower case."""
    low = F.lower(name)
    return F.regexp_replace(low, r"\.[^.]*$", ""), F.regexp_extract(low, r"\.([^.]*)$", 1)


def slots(names: DataFrame) -> DataFrame:
    """``(dir, root, ext, slot)``: what ``names(dir, name)`` take; a suffixed name is a slot of its root, and slot 0 of itself."""
    stem, ext = _parts(F.col("name"))
    number = F.regexp_extract("stem", r"-(\d{3,})$", 1)
    cut = names.select("dir", stem.alias("stem"), ext.alias("ext"))
    bare = cut.select("dir", F.col("stem").alias("root"), "ext", F.lit(0).cast("long").alias("slot"))
    # A number is written with three digits, more only where it needs them.
    numbered = cut.where(number.rlike(r"^(\d{3}|[1-9]\d{3,17})$") & (number != "000")).select("dir", scalar.suffix_root(F.col("stem")).alias("root"), "ext", number.try_cast("long").alias("slot"))
    return bare.union(numbered).distinct()


def written(base: Column, ext: Column, slot: Column) -> Column:
    number = F.when(slot == 0, "").otherwise(F.concat(F.lit("-"), F.lpad(slot.cast("string"), 3, "0")))
    number = F.when(slot >= 1000, F.concat(F.lit("-"), slot.cast("string"))).otherwise(number)
    return F.concat(base, number, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))


def allocate_names(incoming: DataFrame, existing: DataFrame, first: int = 0) -> DataFrame:
    """``(dir, path, name)`` for ``incoming(dir, path, base, ext)`` in path order, given ``existing(dir, name)``.

    Free slots are filled from ``first`` on.  A base that is itself written like another's suffixed name
    keeps that name from it.  Rows of a null base get a null name.
    """
    wanted = incoming.select("dir", "path", "base", "ext", F.lower("base").alias("root"), F.lower("ext").alias("low"))
    order = Window.partitionBy("dir", "root", "low").orderBy("path")
    items = wanted.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    bases = wanted.select("dir", F.concat("root", F.when(F.col("low") == "", "").otherwise(F.concat(F.lit("."), "low"))).alias("name")).distinct()
    looks_numbered = slots(bases).where("slot > 0")
    taken = slots(existing).union(looks_numbered).distinct().where(F.col("slot") >= first).withColumnRenamed("ext", "low")
    # Free slots before the i-th taken one: its number less i.
    place = Window.partitionBy("dir", "root", "low").orderBy("slot")
    gaps = taken.withColumn("rank", F.col("slot") - first - (F.row_number().over(place) - 1))
    both = items.select("dir", "root", "low", "rank", F.lit(1).alias("item"), "path", "base", "ext").unionByName(
        gaps.select("dir", "root", "low", "rank", F.lit(0).alias("item")), allowMissingColumns=True
    )
    running = Window.partitionBy("dir", "root", "low").orderBy("rank", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = both.withColumn("skipped", F.count_if(F.col("item") == 0).over(running)).where("item = 1")
    return named.select("dir", "path", written(F.col("base"), F.col("ext"), F.col("rank") + F.col("skipped") + first).alias("name"))


def max_suffix(names: DataFrame) -> DataFrame:
    """Largest ``-NNN`` suffix per directory and root; 0 where there is none."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    number = F.coalesce(F.nullif(F.regexp_extract(stem, r"-(\d{3,})$", 1), F.lit("")).cast("long"), F.lit(0))
    return names.groupBy("dir", F.lower(scalar.suffix_root(stem)).alias("root")).agg(F.max(number).alias("top"))


def append_names(incoming: DataFrame, names: DataFrame) -> DataFrame:
    """``(dir, path, name)`` for ``incoming(dir, path, name)`` in path order: the root with the largest suffix of ``names(dir, name)`` plus 1, 2, ...; gaps stay."""
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"\.([^.]*)$", 1)
    wanted = incoming.select("dir", "path", scalar.suffix_root(stem).alias("base"), ext.alias("ext")).withColumn("root", F.lower("base"))
    order = Window.partitionBy("dir", "root").orderBy("path")
    ranked = wanted.withColumn("rank", F.row_number().over(order).cast("long"))
    joined = ranked.join(max_suffix(names), ["dir", "root"], "left")
    return joined.select("dir", "path", written(F.col("base"), F.col("ext"), F.col("rank") + F.coalesce("top", F.lit(0))).alias("name"))
