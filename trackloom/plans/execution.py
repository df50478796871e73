"""The executable plan of decided photos, what carrying it out reports, and the log of every photo's way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, scalar
from ..operators import naming

#: Origin and marker that a category's place is written with; fixed.
ORIGINS = {"gpx_interpolation": ("apply_gpx", "GPX-INTERPOLATED"), "gpx_extrapolation": ("apply_gpx", "GPX-EXTRAPOLATED"), "manual_fallback": ("apply_manual", "MANUAL"), "manual_locked": ("apply_manual", "MANUAL")}
MANUAL = ("manual_locked", "manual_fallback")
KINDS = ("metadata_time_write", "metadata_gps_write", "gps_marker_write", "rename_no_clobber", "revert_manual_gps")


def rename_plan(photos: DataFrame) -> DataFrame:
    """``(path, name, new_name, rename)`` for ``photos(path, dest, name, utc, zone)``: the local time's name, with a suffix
    where a file has it.  Every current name of the folder counts as taken, also those that are given up."""
    stamp = F.when(F.col("zone").isNotNull(), scalar.utc_to_stamp(F.timestamp_seconds("utc").cast("timestamp_ntz"), F.col("zone")))
    ext = F.regexp_extract("name", r"\.([^.]*)$", 1)
    p = photos.withColumn("_base", stamp).withColumn("_ext", ext)
    same = F.lower("name") == F.lower(F.concat_ws(".", "_base", F.when(F.col("_ext") != "", F.col("_ext"))))
    p = p.withColumn("rename", F.coalesce(F.col("_base").isNotNull() & ~same, F.lit(False)))
    wanted = p.where("rename").select(F.col("dest").alias("dir"), "path", F.col("_base").alias("base"), F.col("_ext").alias("ext"))
    named = naming.allocate_names(wanted, p.select(F.col("dest").alias("dir"), "name")).select("path", F.col("name").alias("new_name"))
    return p.join(named, "path", "left").select("path", "name", F.coalesce("new_name", "name").alias("new_name"), "rename")


def file_operations(decided: DataFrame, renames: DataFrame | None, times: bool = True, offsets: bool = True, names: bool = True) -> DataFrame:
    """``(path, dest, seq, kind, payload, op_id)`` of every photo: time, place, marker and name, as the policy allows.

    ``decided`` has ``path, dest, utc, zone, category, to_lat, to_lon``; ``renames`` are read for names alone."""
    p = decided.join(renames.select("path", "name", "new_name", "rename"), "path", "left") if names else decided
    local, offset = scalar.utc_to_text(F.timestamp_seconds("utc").cast("timestamp_ntz"), F.col("zone"))
    text = F.concat_ws(" ", local, offset) if offsets else local
    origin = F.create_map(*[F.lit(x) for k, (o, _) in ORIGINS.items() for x in (k, o)])[F.col("category")]
    marker = F.create_map(*[F.lit(x) for k, (_, m) in ORIGINS.items() for x in (k, m)])[F.col("category")]
    number = lambda c: F.format_string("%.6f", c)
    place = F.when(origin.isNotNull() & F.col("to_lat").isNotNull(), F.concat_ws(" ", number(F.col("to_lat")), number(F.col("to_lon")), origin))
    steps = [
        (F.when(F.col("utc").isNotNull() & F.col("zone").isNotNull(), text) if times else F.lit(None).cast("string")), place, F.when(place.isNotNull(), marker),
        (F.when(F.coalesce("rename", F.lit(False)), F.concat_ws(" ", "name", "new_name")) if names else F.lit(None).cast("string")),
    ]
    each = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(i).alias("seq"), F.lit(k).alias("kind"), v.alias("payload"))) for i, (k, v) in enumerate(zip(KINDS, steps, strict=False))])
    ops = p.select("path", "dest", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("o")).select("path", "dest", "o.*")
    return ops.withColumn("op_id", scalar.op_id(F.col("kind"), F.col("path"), F.col("payload")))


def reverts(decided: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger entries whose photo is there and no longer placed by hand: ``path, dest, seq, kind, payload, op_id``.

    ``ledger(fp, path, pre)``, where ``pre`` is the state that was pinned."""
    back = ledger.join(decided.where(~F.col("category").isin(*MANUAL)).select("path", "dest"), "path")
    tags = rules.revert_tags(F.col("pre"))
    payload = F.concat_ws("|", tags["GPSLatitude"], tags["GPSLongitude"], tags["GPSProcessingMethod"])
    return back.select("path", "dest", F.lit(4).alias("seq"), F.lit(KINDS[4]).alias("kind"), payload.alias("payload")).withColumn("op_id", scalar.op_id(F.col("kind"), F.col("path"), F.col("payload")))


def pins(ops: DataFrame, photos: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(fp, path, pre)`` to pin before a place is written by hand: photos so placed whose content is not pinned yet."""
    by_hand = ops.where((F.col("kind") == KINDS[1]) & F.col("payload").endswith("apply_manual")).select("path")
    first = photos.where("fp IS NOT NULL").join(by_hand, "path", "left_semi").groupBy("fp").agg(F.min_by(F.struct("path", "pre"), "path").alias("p"))
    return first.join(ledger.select("fp"), "fp", "left_anti").select("fp", "p.path", "p.pre")


def blockers(resolved: DataFrame, gates: DataFrame) -> DataFrame:
    """``(what, reason)``: photos without a time, and decisions ``gates(name, complete)`` that are not complete."""
    left = resolved.where("utc IS NULL").select(F.col("path").alias("what"), F.lit("no valid time").alias("reason"))
    return left.union(gates.where("NOT complete").select("name", F.lit("not complete")))


def op_summary(photos: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations of every folder by kind, and its photos that need none."""
    per = ops.groupBy("dest").agg(F.count("*").alias("operations"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], F.count_distinct("path").alias("touched"))
    all_ = photos.groupBy("dest").agg(F.count("*").alias("photos"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_.join(per, "dest", "left").select("dest", zero("operations"), *[zero(k) for k in KINDS], (F.col("photos") - F.coalesce("touched", F.lit(0))).alias("no_ops"))


def results_summary(ops: DataFrame, results: DataFrame) -> DataFrame:
    """Applied operations by folder and kind with a grand total, and what was skipped, failed or did not match.

    ``ops(op, dest, kind)`` and ``results(op, result)``; an operation without a result was not reached."""
    both = ops.join(results, "op", "left")
    n = lambda k: F.count_if(F.col("result") == k).alias(k)
    r = both.rollup("dest").agg(n("applied"), n("skipped"), n("failed"), n("mismatch"), F.count_if(F.col("result").isNull()).alias("not_reached"), F.grouping("dest").alias("g"))
    status = rules.geotag_status(F.col("applied"), F.col("skipped"), F.col("failed"), F.col("mismatch"), F.lit(0))
    return r.select(F.when(F.col("g") == 1, "total").otherwise(F.col("dest").cast("string")).alias("dest"), "applied", "skipped", "failed", "mismatch", "not_reached", status.alias("status"))


def step(seq: int, action: str, value: Column) -> Column:
    """A step of a journey; none where the value is null."""
    return F.when(value.isNotNull(), F.struct(F.lit(seq).alias("seq"), F.lit(action).alias("action"), value.cast("string").alias("value")))


def journeys(photos: DataFrame, ops: DataFrame, prior: DataFrame) -> DataFrame:
    """``(fp, steps, journey)``: the steps of every content so far with those of this run after them.

    ``photos(fp, path, rule, used, utc, zone, native)`` and ``prior(fp, seq, action, value)``; photos of one content add
    their steps in the order of their paths.
    """
    said = ops.groupBy("path").agg(*[F.max(F.when(F.col("kind") == k, F.col("payload"))).alias(f"p{i}") for i, k in enumerate(KINDS)])
    p = photos.where("fp IS NOT NULL").join(said, "path", "left")
    offset = F.when(F.col("rule") == "camera_group_offset", F.col("used"))
    none = F.col("p4").isNull() & F.col("p1").isNull()
    steps = F.array(
        step(0, "clock_offset_applied", offset), step(1, "resolved_utc", F.col("utc")), step(2, "timezone_resolved", F.col("zone")), step(3, "gps_reverted", F.col("p4")),
        step(4, "gps_written", F.when(F.col("p4").isNull(), F.col("p1"))), step(5, "gps_preserved", F.when(none & F.col("native"), F.lit("native"))), step(6, "final_rename", F.col("p3")),
    )
    now = p.select("fp", F.lit(1).alias("run"), "path", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("s"))
    before = prior.select("fp", F.lit(0).alias("run"), F.lit("").alias("path"), F.struct("seq", "action", "value").alias("s"))
    both = before.unionByName(now).groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("run", "path", "s"))).alias("j"))
    line = F.transform("j", lambda x: F.concat_ws("=", x["s"]["action"], x["s"]["value"]))
    return both.select("fp", F.size("j").cast("long").alias("steps"), F.array_join(line, ";").alias("journey"))
