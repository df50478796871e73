"""Decision rules and small relations: states, validators, texts of the editor.  All stay in the JVM."""

from __future__ import annotations

import json
import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scalar

#: Keys of a document that change with every run; fixed.
VOLATILE = ("run_metadata", "content_fingerprint", "diagnostics", "execution_journal", "cache_freshness", "conflicts_or_duplicates")
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def zones(spark: SparkSession) -> DataFrame:
    """The names of all time zones (some 600)."""
    return spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "zone string")


def utc_of(text: Column) -> Column:
    """Instant of an ISO time; one without an offset is UTC; else null."""
    full = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")
    full = F.when(full.rlike(r"[T ].*(Z|[+-]\d{2}:\d{2})$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"), full.try_cast("timestamp"))


def scrub_offset(track_ms: Column, naive_ms: Column) -> Column:
    """Seconds between two instants, halves rounded up (as the editor rounds)."""
    return F.floor((track_ms - naive_ms) / 1000 + 0.5).cast("long")


def naive_ms(text: Column) -> Column:
    """Milliseconds of a camera's wall time read as UTC."""
    return F.unix_seconds(scalar.naive_time(text).cast("timestamp")) * 1000


def field_ms(text: Column) -> Column:
    """Milliseconds of a date and time field (seconds may be left out); null for other texts."""
    full = F.concat(text, F.when(F.length(text) == 16, ":00Z").otherwise("Z"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?$"), F.unix_seconds(full.try_cast("timestamp")) * 1000)


def ms_field(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")


def shown_offset(seconds: Column) -> Column:
    n = F.abs(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.when(seconds < 0, "−").otherwise("+"), F.floor(n / 3600).cast("string"), F.lit("h "), two(F.floor(n % 3600 / 60)), F.lit("m "), two(n % 60), F.lit("s"))
    return F.coalesce(text, F.lit("—"))


def shown_date(iso: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(iso.cast("date")))
    return F.concat_ws(" ", F.day(iso.cast("date")).cast("string"), month, F.year(iso.cast("date")).cast("string"))


def parse_pair(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of ``lat, lon``; both null where they are no place."""
    number = r"([+-]?\d+(?:\.\d+)?)"
    lat, lon = (F.regexp_extract(text, rf"^\s*{number}\s*,\s*{number}\s*$", i).try_cast("double") for i in (1, 2))
    ok = scalar.valid_coordinates(lat, lon)
    return F.when(ok, lat), F.when(ok, lon)


def unset(value: Column) -> Column:
    return value.isNull() | (value == "")


def both_or_neither(a: Column, b: Column) -> Column:
    return unset(a) == unset(b)


def nearest_index(points: Column, t: Column) -> Column:
    """Place (from 0) of the point of an array ordered by time whose ``t`` is nearest, the first of equal ones; 0 without points."""
    apart = F.transform(points, lambda p, i: F.struct(F.abs(p["t"] - t).alias("d"), i.alias("i")))
    return F.coalesce(F.array_min(apart)["i"], F.lit(0)).cast("long")


def contiguous(order: Column, anchor: Column, target: Column) -> Column:
    """The items of a list between two of its items, whichever comes first; just the target if the anchor is not in it."""
    a, b = F.array_position(order, anchor), F.array_position(order, target)
    return F.when(b == 0, F.array().cast("array<bigint>")).when(a == 0, F.array(target)).otherwise(F.slice(order, F.least(a, b).cast("int"), (F.abs(a - b) + 1).cast("int")))


def misplaced(files: DataFrame, photo_bands: list[str], video_band: str) -> DataFrame:
    """``(path, reason)`` of videos among photos and photos among videos."""
    video = F.col("top").isin(photo_bands) & (F.col("class") == "video")
    photo = (F.col("top") == video_band) & F.col("class").isin("image", "raw")
    return files.where(video | photo).select("path", F.when(video, F.concat(F.lit("video under "), F.col("top"))).otherwise(F.concat(F.col("class"), F.lit(f" under {video_band}"))).alias("reason"))


def folder_states(files: DataFrame, roles: DataFrame) -> DataFrame:
    """``(folder, state)``: the role of every top folder, or that it is not managed, or that a managed one is missing."""
    tops = files.select("top").distinct()
    both = tops.join(roles, tops.top == roles.folder, "full_outer")
    return both.select(F.coalesce("top", "folder").alias("folder"), F.when(F.col("role").isNull(), "not managed").when(F.col("top").isNull(), "missing").otherwise(F.col("role")).alias("state"))


def without_keys(text: Column, keys: tuple[str, ...] = VOLATILE) -> Column:
    """A JSON text without the members of these names at any depth; keys sorted, blanks gone.  Null for what is no JSON."""
    drop = frozenset(keys)

    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if k not in drop}
        return [strip(v) for v in x] if isinstance(x, list) else x

    def one(t):
        try:
            return json.dumps(strip(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    # The tree's depth is open, which SQL functions cannot follow.
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)


def geotag_status(applied: Column, skipped: Column, failed: Column, mismatched: Column, blocked: Column) -> Column:
    clean = failed + mismatched + blocked == 0
    return F.when(clean, "success").when((mismatched > 0) | (applied > 0) | (skipped > 0), "partial").otherwise("failed")


def merge_status(placed: Column, blocked: Column) -> Column:
    return F.when(blocked == 0, "success").when(placed > 0, "partial").otherwise("failed")


def contained(path: Column) -> Column:
    """Whether a relative path stays below its root, read as text: no step above it on the way, not absolute, not empty."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda a, x: F.struct((a["d"] + F.when(x == "..", -1).otherwise(1)).alias("d"), (a["ok"] & ((x != "..") | (a["d"] > 0))).alias("ok")))
    return F.coalesce(~path.startswith("/") & depth["ok"] & (depth["d"] > 0), F.lit(False))


def config_problems(rows: DataFrame, kinds: dict[str, str], known_zones: DataFrame) -> DataFrame:
    """``(config, key, problem)`` of ``rows(config, key, value)``; ``kinds`` names each key's kind of value."""
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("key")]
    number = F.col("value").try_cast("double")
    zone = rows.join(F.broadcast(known_zones.select(F.col("zone").alias("value"), F.lit(True).alias("known"))), "value", "left").withColumn("kind", kind)
    problem = (
        F.when(F.col("kind").isNull(), "unknown key")
        .when(F.col("kind").isin("seconds", "positive") & number.isNull(), "not a number")
        .when((F.col("kind") == "seconds") & ~number.between(0, 172_800) | (F.col("kind") == "positive") & (number <= 0), "out of range")
        .when((F.col("kind") == "zone") & (F.col("value") != "") & F.col("known").isNull(), "unknown zone")
        .when((F.col("kind") == "strftime") & ~F.col("value").rlike("%[YmdHMSjyf]"), "does not vary")
        .when((F.col("kind") == "boolean") & ~F.col("value").isin("true", "false"), "not a boolean")
    )
    twice = rows.groupBy("config", "key").count().where("count > 1").select("config", "key", F.lit("set twice").alias("problem"))
    return zone.select("config", "key", problem.alias("problem")).where("problem is not null").union(twice)


def nothing_to_do(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row: whether every file is recorded as it is, and nothing else is."""
    f, r = files.withColumn("here", F.lit(True)), recorded.select("path", F.col("size").alias("was"), F.lit(True).alias("there"))
    both = f.join(r, "path", "full_outer")
    return both.agg((F.count_if(F.col("here").isNull() | F.col("there").isNull() | ~F.col("size").eqNullSafe(F.col("was"))) == 0).alias("nothing_to_do"))


def cell_status(needs: Column, stale: Column, auto: Column, fallback: Column, effective: Column) -> Column:
    return F.when(needs, "needs").when(stale, "stale").when(auto, "auto").when(fallback & effective.isNull(), "none").otherwise("ok")


def lifecycle(marks: Column, tools: Column, wanted: list[str]) -> tuple[Column, Column, Column]:
    """Whether a workspace is sealed or a library by its marks, and the tools it lacks."""
    return F.array_contains(marks, "sealed"), F.array_contains(marks, "library"), F.array_join(F.array_except(F.lit(wanted), tools), ",")


def affordances(workspaces: DataFrame) -> DataFrame:
    """``(ws, command, blocked_by)`` for each command; null where it may run.  The first reason counts."""
    each = workspaces.withColumn("command", F.explode(F.array(*map(F.lit, ("prep", "plan", "execute")))))
    execute = F.col("command") == "execute"
    why = (
        F.when(F.col("busy"), "a job is running").when(F.col("sealed"), "sealed").when((F.col("command") != "prep") & ~F.col("initialised"), "not initialised")
        .when(execute & ~F.col("planned"), "no plan").when(execute & F.col("stale"), "stale plan")
    )
    return each.select("ws", "command", why.alias("blocked_by"))


def plan_time(plan_id: Column) -> Column:
    """The instant that a plan's id begins with; null where it does not."""
    return F.try_to_timestamp(F.split(plan_id, "-")[0], F.lit("yyyyMMdd'T'HHmmss'Z'"))


def pre_state(lat: Column, lon: Column, method: Column) -> Column:
    """What a file held before a place was written to it: its own place, or that it had none."""
    has = lat.isNotNull() & lon.isNotNull()
    return F.struct(has.alias("present"), F.when(has, lat).alias("lat"), F.when(has, lon).alias("lon"), F.when(has, F.coalesce(method, F.lit(""))).alias("method"))


def revert_tags(pre: Column) -> Column:
    """The tags that restore such a state; empty values clear them."""
    text = lambda c: F.when(pre["present"], c.cast("string")).otherwise("")
    return F.struct(text(pre["lat"]).alias("GPSLatitude"), text(pre["lon"]).alias("GPSLongitude"), text(pre["method"]).alias("GPSProcessingMethod"))


def first_examples(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The first ``n`` values of every group.  The limit on the rank is applied before the shuffle too (a partial limit
    of each input partition), so a group that holds most rows does not reach one task whole."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(value))
    return rows.select(group, value).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
