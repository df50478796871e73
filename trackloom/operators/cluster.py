"""Consensus of clock offsets: greedy leader clustering of ranked candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchors(candidates: DataFrame) -> DataFrame:
    """Candidates with their rank in the group (points before segments, then distance, then path) as ``rank`` and ``anchor-NNN``.

    A group (one camera in one folder, or one day of it) has some thousand candidates at most, by the photos it holds.
    """
    order = Window.partitionBy("grp").orderBy((F.col("kind") != "point").cast("int"), "metres", "path")
    return candidates.withColumn("rank", F.row_number().over(order)).withColumn("anchor", F.format_string("anchor-%03d", "rank"))


def _leaders(spread: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Leaders are more than the spread apart, so a cell of that width holds one at most.
        at, out = {}, []
        for offset, n, points, path in group.sort_values(["far", "metres", "path"])[["offset_s", "n", "points", "path"]].itertuples(index=False):
            cell = offset // (spread + 1)
            near = [k for c in (cell - 1, cell, cell + 1) if (k := at.get(c)) is not None and abs(out[k][1] - offset) <= spread]
            if near:
                out[min(near)][2] += n
                out[min(near)][3] += points
            else:
                at[cell] = len(out)
                out.append([len(out), offset, n, points, path])
        rows = pd.DataFrame(out, columns=["cluster", "offset_s", "members", "points", "lead"])
        rows.insert(0, "grp", group["grp"].iloc[0])
        return rows

    return run


def clusters(candidates: DataFrame, spread: int = 120) -> DataFrame:
    """``(grp, cluster, offset_s, members, points, lead)``: each ranked candidate joins the first cluster whose leader is within ``spread``.

    A candidate counts once, or as often as its ``n`` says where there is such a column.

    Equal offsets are folded together first, so a group has one row per distinct offset (bounded by the clock
    window) in its task, however many frames agree, and each is compared with three leaders at most.
    """
    rank = F.min(F.struct((F.col("kind") != "point").cast("int").alias("far"), "metres", "path")).alias("r")
    n = F.col("n") if "n" in candidates.columns else F.lit(1)
    folded = candidates.groupBy("grp", "offset_s").agg(rank, F.sum(n).alias("n"), F.sum(F.when(F.col("kind") == "point", n).otherwise(0)).alias("points"))
    rows = folded.select("grp", F.col("offset_s").cast("long").alias("offset_s"), "r.far", "r.metres", "r.path", "n", "points")
    kind = dict(candidates.dtypes)["grp"]
    return rows.groupBy("grp").applyInPandas(_leaders(spread), f"grp {kind}, cluster int, offset_s long, members long, points long, lead string")


def consensus(candidates: DataFrame, spread: int = 120) -> DataFrame:
    """``(grp, offset_s, members, conflicts, confidence)``: the largest cluster of each group, the earliest of equal ones."""
    each = clusters(candidates, spread)
    won = each.groupBy("grp").agg(F.max_by(F.struct("offset_s", "members", "points", "cluster", "lead"), F.struct("members", -F.col("cluster"))).alias("best"), F.sum("members").alias("total"))
    clash = F.col("total") - F.col("best.members")
    # A leader is its cluster's best candidate, so it is a point where any member is.
    confidence = F.when(clash > 0, "review_required").when((F.col("best.members") > 1) | (F.col("best.points") > 0), "high").otherwise("medium")
    return won.select("grp", F.col("best.offset_s").alias("offset_s"), F.col("best.members").alias("members"), clash.alias("conflicts"), confidence.alias("confidence"), F.col("best.lead").alias("lead"))
