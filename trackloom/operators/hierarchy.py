"""Inheritance down a path hierarchy: nearest ancestor with a value, in one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar


def expand(paths: DataFrame) -> DataFrame:
    """All destinations: the paths and their ancestors."""
    return paths.select("path").union(paths.select(F.explode(scalar.ancestors(F.col("path"))))).distinct()


def inherit(paths: DataFrame, own: DataFrame, proper: bool = False) -> DataFrame:
    """``(path, value, inherited_from)`` from the deepest ancestor (or self) that ``own(path, value)`` lists."""
    chain = scalar.ancestors(F.col("path"))
    chain = chain if proper else F.concat(chain, F.array("path"))
    up = paths.select("path", F.posexplode_outer(chain).alias("depth", "ancestor"))
    found = up.join(own.select(F.col("path").alias("ancestor"), "value"), "ancestor")
    best = found.groupBy("path").agg(F.max_by(F.struct("value", "ancestor"), "depth").alias("b"))
    return paths.join(best, "path", "left").select("path", F.col("b.value").alias("value"), F.col("b.ancestor").alias("inherited_from"))
