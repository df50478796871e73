"""Nearest points and segments within a distance and a time window, by grid cells of latitude, longitude and time.

Cells are a little wider than the reach, so a frame goes to the cells that its reach touches (one or two a
dimension) and a point to its own.  A crowded cell is a hot key of an equi-join, which adaptive execution splits.

Frames of one time and place have one answer, so they are searched once.  The least distance is found first (a
minimum of numbers, which Spark aggregates by hash as the pairs come), then the candidates that have it: pairs are
never sorted or written.  ``staged`` writes the least distances, a row per spot, between the two searches, so that their
shuffle files do not stand side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..session import cut, settled
from .asof import bucketed

#: What a frame's answer depends on.
_SPOT = ["t", "lat", "lon"]
#: Spots times points that are searched at the whole reach at once.
_AT_ONCE = 1_000_000_000
#: Shares of the reach by which more are searched, with the width of a cell as a multiple of twice that reach (and of a slot as
#: one of twice the window): where a reach has few points, wider cells take fewer copies of a frame and cost little.
_NARROW = ((64, 2), (8, 1))
#: Degrees of latitude a metre is at most (a little more than 1 / 111,194).
_DEGREE = 1 / 111_000


def _steps(band: Column, width: float, reach: float) -> Column:
    """Cells of longitude around the globe in a band of latitude: as many as are at least ``width`` wide at its far edge."""
    far = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * width + 2 * reach, F.lit(90.0))
    return F.greatest(F.lit(1).cast("long"), F.floor(360.0 * F.cos(F.radians(far)) / width))


def _cell(lon: Column, steps: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * steps)


def _around(frames: DataFrame, reach: float, width: float, own: Column | None = None) -> DataFrame:
    """Frames once for each cell of latitude and longitude that their reach touches; ``own`` is a frame's own, no more than ``reach``."""
    edge = (F.lit(reach) if own is None else own) * _DEGREE
    lat, lon = F.col("lat"), F.col("lon")
    f = frames.withColumn("band", F.explode(F.sequence(F.floor((lat - edge) / width), F.floor((lat + edge) / width))))
    steps = _steps(F.col("band"), width, reach * _DEGREE)
    # The reach in cells is at most edge / width of one, as a cell is at least so wide.
    at = (lon + 180.0) / 360.0 * steps
    span = F.sequence(F.floor(at - edge / width), F.floor(at + edge / width))
    return f.withColumn("cell", F.explode(F.array_distinct(F.transform(span, lambda c: F.pmod(c, steps)))))


def _gridded(points: DataFrame, lat: str, lon: str, reach: float, width: float) -> DataFrame:
    p = points.withColumn("band", F.floor(F.col(lat) / width))
    steps = _steps(F.col("band"), width, reach * _DEGREE)
    return p.withColumn("cell", F.pmod(_cell(F.col(lon), steps), steps))


def _spots(frames: DataFrame) -> DataFrame:
    return frames.select(*_SPOT).where(" AND ".join(f"{c} IS NOT NULL" for c in _SPOT)).distinct()


def _first(spots: DataFrame, near, order: list[str], staged: bool) -> DataFrame:
    """Spots with their first candidate in ``order`` (``metres`` leads it) as ``b``; ``near(spots, own)`` are a spot's candidates
    within its own reach (None: the whole), with its columns.

    The second search takes a little more than the least distance, so it does not rely on equal sums."""
    least = near(spots, None).groupBy(*_SPOT).agg(F.min("metres").alias("least"))
    least = cut(least) if staged else least
    own = F.col("least") + 1e-6
    close = near(least, own).where(F.col("metres") <= own)
    return close.groupBy(*_SPOT).agg(F.min(F.struct(*order)).alias("b"))


def nearest_point(frames: DataFrame, track: DataFrame, reach: float = 50, window: int = 172_800, at_once: int = _AT_ONCE, staged: bool = False) -> DataFrame:
    """``(path, metres, offset, point)`` of frames that have a point within reach and window; ties go to the earlier point.

    Of points of one time and place the first in order is kept.  Where there are many spots and points, narrower reaches
    go first: what has a point within one needs no wider search (eager: a round is written before the next).
    """
    points = track.groupBy(F.col("t").alias("pt"), F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.min(F.struct("file", "idx")).alias("o"))
    points, left = cut(points.select("pt", "plat", "plon", "o.file", "o.idx")), cut(_spots(frames))

    def search(r: float, wide: int = 1, staged: bool = True):
        width, slot = 2 * r * _DEGREE * wide, 2 * window * wide
        p = _gridded(points, "plat", "plon", r, width).withColumn("slot", F.floor(F.col("pt") / slot))
        d = scalar.haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))

        def near(spots: DataFrame, own: Column | None) -> DataFrame:
            f = _around(spots, r, width, own).withColumn("slot", F.explode(F.sequence(F.floor((F.col("t") - window) / slot), F.floor((F.col("t") + window) / slot))))
            return f.join(p, ["band", "cell", "slot"]).where(F.abs(F.col("pt") - F.col("t")) <= window).withColumn("metres", d).where(F.col("metres") <= r)

        return _first(left, near, ["metres", "pt", "file", "idx"], staged)

    found = []
    if left.count() * points.count() > at_once:
        for share, wide in _NARROW:
            found.append(settled(track.sparkSession, lambda: search(reach / share, wide)))  # noqa: B023
            left = cut(left.join(found[-1].select(*_SPOT), _SPOT, "left_anti"))
    best = search(reach, staged=staged)
    for more in found:
        best = best.union(more)
    best = frames.select("path", *_SPOT).join(best, _SPOT).groupBy("path", "t").agg(F.min("b").alias("b"))
    return best.select("path", F.round("b.metres", 2).alias("metres"), (F.col("b.pt") - F.col("t")).alias("offset_s"), F.col("b.idx").alias("point"))


def segments(track: DataFrame) -> DataFrame:
    """Adjacent pairs of the series, without a window over all of it: each bucket's last point meets the next bucket's first."""
    point = F.struct("t", "file", "idx", "lat", "lon")
    rows = bucketed(track, track.select("t")).select("bucket", point.alias("a"))
    heads = rows.groupBy("bucket").agg(F.min("a").alias("head"))
    following = heads.select("bucket", F.lead("head").over(Window.orderBy("bucket")).alias("head"))
    pairs = rows.withColumn("b", F.lead("a").over(Window.partitionBy("bucket").orderBy("a")))
    return pairs.join(following, "bucket").select("a", F.coalesce("b", "head").alias("b")).where("b is not null")


def skip_reason(frames: DataFrame, track: DataFrame, matched: DataFrame, reach: float = 50) -> DataFrame:
    """Why frames have no match: a point is near at another time, or none is near at all."""
    width = 2 * reach * _DEGREE
    left = frames.join(matched.select("path"), "path", "left_anti")
    p = _gridded(track.select(F.col("lat").alias("plat"), F.col("lon").alias("plon")).distinct(), "plat", "plon", reach, width)
    near = _around(left, reach, width).alias("f").join(
        p.alias("p"), (F.col("f.band") == F.col("p.band")) & (F.col("f.cell") == F.col("p.cell")) & (scalar.haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")) <= reach), "left_semi"
    )
    near = near.select("path").distinct().withColumn("near", F.lit(True))
    return left.join(near, "path", "left").select("path", F.when(F.col("near"), "outside_time_window").otherwise("no_nearby_track").alias("reason"))


def nearest_segment(frames: DataFrame, track: DataFrame, reach: float = 25, window: int = 172_800, gap: int = 1800, width: float = 0.01, staged: bool = False) -> DataFrame:
    """``(path, metres, offset_s, duration_s, point)``: the closest segment of adjacent points within reach.

    A segment lasts more than 0 and at most ``gap`` seconds; the time at the frame's projection lies within the
    window.  A segment goes to the cells along it (in each band of latitude those between the longitudes at which it
    enters and leaves), and a frame to its own; ties go to the earlier segment.
    """
    pair = segments(track).select(*[F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in ("t", "file", "idx", "lat", "lon")])
    pair = cut(pair.withColumn("span", F.col("bt") - F.col("at")).where((F.col("span") > 0) & (F.col("span") <= gap)))
    edge = reach * _DEGREE
    low, high = F.least("alat", "blat"), F.greatest("alat", "blat")
    pair = pair.withColumn("band", F.explode(F.sequence(F.floor((low - edge) / width), F.floor((high + edge) / width))))
    # Shares of the segment at the band's edges, taken a reach further out.
    slope = F.when(F.col("blat") == F.col("alat"), None).otherwise(F.col("blat") - F.col("alat"))
    ends = [F.coalesce((F.col("band") * width - edge - F.col("alat")) / slope, F.lit(0.0)), F.coalesce(((F.col("band") + 1) * width + edge - F.col("alat")) / slope, F.lit(1.0))]
    shares = [F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) for x in ends]
    lons = [F.col("alon") + (F.col("blon") - F.col("alon")) * x for x in shares]
    steps = _steps(F.col("band"), width, edge)
    first, last = ((F.least(*lons) + 180.0) / 360.0 * steps - edge / width, (F.greatest(*lons) + 180.0) / 360.0 * steps + edge / width)
    pair = pair.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(F.floor(first), F.floor(last)), lambda c: F.pmod(c, steps)))))
    pair = pair.withColumn("slot", F.floor(F.col("at") / window))
    bx, by = scalar.equirect(F.col("blat"), F.col("blon"), F.col("alat"), F.col("alon"))
    px, py = scalar.equirect(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon"))
    zero = F.lit(0.0)
    metres, share = scalar.point_segment(F.col("px"), F.col("py"), zero, zero, F.col("bx"), F.col("by"))

    def near(spots: DataFrame, own: Column | None) -> DataFrame:
        f = _gridded(spots, "lat", "lon", reach, width)
        f = f.withColumn("slot", F.explode(F.expr(f"sequence(cast(floor((t - {window + gap}) / {window}) as bigint), cast(floor((t + {window}) / {window}) as bigint))")))
        c = f.join(pair, ["band", "cell", "slot"]).select(*spots.columns, "at", "afile", "aidx", "span", *[x.alias(n) for x, n in ((bx, "bx"), (by, "by"), (px, "px"), (py, "py"))])
        return c.withColumn("metres", metres).where(F.col("metres") <= reach).withColumn("when", F.col("at") + share * F.col("span")).where(F.abs(F.col("when") - F.col("t")) <= window)

    best = _first(cut(_spots(frames)), near, ["metres", "at", "afile", "aidx", "when", "span"], staged)
    best = frames.select("path", *_SPOT).join(best, _SPOT).groupBy("path", "t").agg(F.min("b").alias("b"))
    return best.select("path", F.round("b.metres", 2).alias("metres"), scalar.whole_seconds(F.col("b.when") - F.col("t")).alias("offset_s"), F.col("b.span").alias("duration_s"), F.col("b.aidx").alias("point"))
