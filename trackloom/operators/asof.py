"""As-of matching on time, and placement of items on a time series.

Rows of both sides are sorted within time buckets; what a bucket's first rows
need from earlier (later) buckets is carried over from a table with one row
per bucket.  So no window spans the whole series, and a window of the carry
table has as many rows as the series has buckets.  Buckets are days, a busy day
cut into as many equal parts as its rows call for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

DAY = 86_400
#: Rows of a bucket, about; a day of more is cut.
BUCKET_ROWS = 500_000


def bucketed(rows: DataFrame, sizes: DataFrame, t: str = "t", rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``bucket``, in the order of time; ``sizes(t)`` are all the rows that share the buckets."""
    busy = sizes.groupBy(F.floor(F.col("t") / DAY).alias("_day")).agg(F.ceil(F.count("*") / rows_per_bucket).alias("_parts")).where("_parts > 1")
    day = F.floor(F.col(t) / DAY)
    cut = rows.withColumn("_day", day).join(busy, "_day", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    part = F.floor((F.col(t) - F.col("_day") * DAY) * F.col("_parts") / DAY)
    # A bucket is named by its first second, or one before it.
    return cut.withColumn("bucket", F.col("_day") * DAY + F.floor(part * DAY / F.col("_parts"))).drop("_day", "_parts")


def bracket(items: DataFrame, track: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """``items`` with ``before`` (last point at or before ``t``) and ``after`` (first point later than ``t``).

    ``track`` has ``t, lat, lon, file, idx``; ties are broken by file and index.
    Points are structs ``(t, file, idx, lat, lon)``, null where there is none.
    """
    point = F.struct("t", "file", "idx", "lat", "lon")
    points = track.select(F.col("t"), F.lit(0).alias("side"), point.alias("p"), F.lit(None).cast(items.select(F.struct("*").alias("r")).schema[0].dataType).alias("r"))
    rows = items.select(F.col("t"), F.lit(1).alias("side"), F.lit(None).cast(points.schema["p"].dataType).alias("p"), F.struct("*").alias("r"))
    both = bucketed(points.union(rows), items.select("t").union(track.select("t")), rows_per_bucket=rows_per_bucket)
    # Of a bucket without points (items alone) the edges are null.
    buckets = both.groupBy("bucket").agg(F.max("p").alias("last"), F.min("p").alias("first"))
    up, down = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.select("bucket", F.last("last", True).over(up).alias("from_before"), F.last("first", True).over(down).alias("from_after"))
    order = [F.col("t"), F.col("side"), F.col("p.file"), F.col("p.idx")]
    running = (Window.unboundedPreceding, Window.currentRow)
    forth = Window.partitionBy("bucket").orderBy(*order).rowsBetween(*running)
    back = Window.partitionBy("bucket").orderBy(*[c.desc() for c in order]).rowsBetween(*running)
    found = both.withColumn("b", F.last("p", True).over(forth)).withColumn("a", F.last("p", True).over(back)).where("side = 1")
    joined = found.join(carry, "bucket")
    return joined.select("r.*", F.coalesce("b", "from_before").alias("before"), F.coalesce("a", "from_after").alias("after"))


def nearest(before: Column, after: Column, t: Column) -> Column:
    """The nearer bracket; the earlier one where both are as near."""
    return F.when(after.isNull() | (t - before["t"] <= after["t"] - t), before).otherwise(F.coalesce(after, before))


def ends(track: DataFrame) -> DataFrame:
    """One row: the first two and the last two points as arrays (nearest the end first)."""
    point = F.struct("t", "file", "idx", "lat", "lon")
    order = [F.col(c) for c in ("t", "file", "idx")]
    # Two rows each by top-k, never a sort of the series.
    first = track.orderBy(*order).limit(2).agg(F.array_sort(F.collect_list(point)).alias("first"))
    last = track.orderBy(*[c.desc() for c in order]).limit(2).agg(F.reverse(F.array_sort(F.collect_list(point))).alias("last"))
    return first.crossJoin(F.broadcast(last))  # one row by one row


def place(items: DataFrame, track: DataFrame, direct: float = 60, gap: float = 1800, distance: float = 1000, speed: float = 150, reach: float = 300) -> DataFrame:
    """``items`` with ``method, lat, lon, gpx_file`` (replacing such columns of theirs): direct match, interpolation between
    brackets, or extrapolation past an end; ``gpx_file`` is that of the matched, the earlier or the end point.

    With both brackets a failed gate blocks; extrapolation is for items beyond
    the track, from its last (first) two points.  Coordinates that are computed
    are rounded to 6 places, as SQL does.
    """
    rows = bracket(items, track).crossJoin(F.broadcast(ends(track)))
    t, b, a = F.col("t"), F.col("before"), F.col("after")
    near = nearest(b, a, t)
    is_direct = F.coalesce(F.abs(t - near["t"]) <= direct, F.lit(False))
    span = a["t"] - b["t"]
    metres = scalar.haversine(b["lat"], b["lon"], a["lat"], a["lon"])
    fits = (span > 0) & (span <= gap) & (metres <= distance) & (metres / F.when(span == 0, 1).otherwise(span) * 3.6 <= speed)
    between = b.isNotNull() & a.isNotNull()
    side = F.when(a.isNull(), F.col("last")).otherwise(F.col("first"))
    p, q = F.get(side, F.lit(0)), F.get(side, F.lit(1))
    beyond = F.coalesce(F.abs(t - p["t"]) <= reach, F.lit(False)) & ~between
    method = F.when(is_direct, "direct").when(between & fits, "interpolated").when(beyond, "extrapolated").otherwise("blocked")

    def value(c: str) -> Column:
        inner = scalar.rounded(scalar.interpolate(b[c], a[c], b["t"], a["t"], t), 6)
        outer = scalar.rounded(F.when(q.isNull() | (q["t"] == p["t"]), p[c]).otherwise(scalar.interpolate(q[c], p[c], q["t"], p["t"], t)), 6)
        return F.when(method == "direct", near[c]).when(method == "interpolated", inner).when(method == "extrapolated", outer)

    file = F.when(method == "direct", near["file"]).when(method == "interpolated", b["file"]).when(method == "extrapolated", p["file"])
    return rows.select(*[c for c in items.columns if c not in ("method", "lat", "lon", "gpx_file")], method.alias("method"), value("lat").alias("lat"), value("lon").alias("lon"), file.alias("gpx_file"))


def within(buckets: DataFrame, track: DataFrame, cell: int = 86_400) -> DataFrame:
    """Interval join: the points in ``[lo, hi]`` of each bucket, by cells of time instead of a theta join."""
    cells = buckets.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    return cells.join(track.withColumn("cell", F.floor(F.col("t") / cell)), "cell").where(F.col("t").between(F.col("lo"), F.col("hi"))).drop("cell")
