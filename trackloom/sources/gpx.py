"""GPX tracks: a folder of files, or a column of texts, as one relation of points.

Everything is SQL functions: a text is parsed by ``from_xml``, its track points
are numbered in document order across tracks and segments, and a point is kept
when its coordinates are numbers in range and its time is whole seconds ending
in ``Z``, or an ISO time with an offset.  Points that are dropped keep their
number.  A text that is not well-formed gives no points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

_SCHEMA = "trk array<struct<trkseg: array<struct<trkpt: array<struct<_lat: string, _lon: string, time: string>>>>>>"
_OPTIONS = {"rowTag": "gpx", "ignoreNamespace": "true"}


def _solid(a: Column) -> Column:
    """An array without its nulls; a null is an empty array (one null part would void the whole when flattened)."""
    return F.filter(a, lambda x: x.isNotNull())


def _points(text: Column) -> Column:
    tracks = F.coalesce(_solid(F.from_xml(text, _SCHEMA, _OPTIONS)["trk"]), F.array())
    parts = F.flatten(_solid(F.transform(tracks, lambda t: _solid(t["trkseg"]))))
    return F.flatten(_solid(F.transform(parts, lambda s: s["trkpt"])))


def parse(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """``(file, idx, time_utc, lat, lon)`` of the usable points of every text; a null text has none."""
    rows = texts.select(F.col(file).alias("file"), F.posexplode(_points(F.col(text))).alias("idx", "p"))
    rows = rows.select("file", "idx", scalar.gpx_time(F.col("p.time")).alias("time_utc"), F.col("p._lat").try_cast("double").alias("lat"), F.col("p._lon").try_cast("double").alias("lon"))
    return rows.where(F.col("time_utc").isNotNull() & scalar.valid_coordinates(F.col("lat"), F.col("lon")))


def _qualified(spark: SparkSession, root: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toString().rstrip("/"), fs.exists(at) and fs.getFileStatus(at).isDirectory()


def files(spark: SparkSession, root: str) -> DataFrame:
    """``(file, sha256, text)`` of every GPX file below ``root``, the name's case aside; ``file`` is relative to it."""
    base, _ = _qualified(spark, root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[gG][pP][xX]").load(base)
    return found.select(F.substring("path", F.lit(len(base) + 2), F.length("path")).alias("file"), F.sha2("content", 256).alias("sha256"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def index(spark: SparkSession, root: str | None) -> tuple[str, DataFrame | None]:
    """Status (``disabled``, ``missing``, ``empty`` or ``usable``) and the points of a folder."""
    if not root:
        return "disabled", None
    if not _qualified(spark, root)[1]:
        return "missing", None
    points = parse(files(spark, root))
    return ("empty" if points.isEmpty() else "usable"), points
