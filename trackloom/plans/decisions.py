"""Decisions about time and place: zones of folders, clock offsets of cameras, resolved times, drift, and the source of
each photo's place.

Photos have ``path, dest, grp, class`` (``camera`` or another), ``naive`` (wall time in seconds), ``offset_text``,
``native`` and the columns that placement and matching read.  Prior decisions are tables keyed as the decisions are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, scalar
from ..operators import asof, cluster, hierarchy
from ..session import cut

GPS_CATEGORIES = ("preserve_native", "manual_locked", "gpx_interpolation", "gpx_extrapolation", "manual_fallback", "no_change", "blocked")
#: Sources of an offset that the track has not confirmed.
UNCONFIRMED = ("timezone_accepted", "manual", "manual_real_utc")


def _inherited(nodes: DataFrame, own: Column) -> DataFrame:
    """Nodes with what they inherit: the value and the path of their nearest ancestor that has one."""
    up = hierarchy.inherit(nodes.select("path"), nodes.select("path", own.alias("value")).where("value IS NOT NULL"), proper=True)
    return nodes.join(up.select("path", F.col("value").alias("up"), "inherited_from"), "path")


def zones(dests: DataFrame, prior: DataFrame, known: DataFrame, default: str | None = None) -> DataFrame:
    """Zone of every folder and its ancestors: ``path, proposed, source, inherited_from, zone, requires, stale, mode, bad``.

    ``prior(path, manual, accept)``.  A valid manual zone wins; else the zone of the nearest ancestor that has one, else
    the default.  A manual zone that is none blocks its folder, and the folders below look past it.  What
    resolves a folder is always the nearest valid manual zone at or above it, or the default, so no level waits for the one above.
    """
    real = cut(dests.select("path", F.lit(True).alias("real")))
    nodes = hierarchy.expand(real).join(real, "path", "left").join(prior, "path", "left").join(F.broadcast(known.select(F.col("zone").alias("manual"), F.lit(True).alias("ok"))), "manual", "left")
    manual = F.coalesce(F.col("manual"), F.lit(""))
    nodes = nodes.select("path", F.coalesce("real", F.lit(False)).alias("real"), manual.alias("manual"), F.coalesce("accept", F.lit(False)).alias("accept"), F.coalesce("ok", F.lit(False)).alias("ok"))
    nodes = cut(nodes)  # a row per folder
    seen = _inherited(nodes, F.when(F.col("ok"), F.col("manual"))).drop("inherited_from")
    zone = F.when(F.col("ok"), F.col("manual")).when(F.col("manual") != "", None).otherwise(F.coalesce(F.col("up"), F.lit(default).cast("string")))
    found = _inherited(cut(seen.withColumn("zone", zone).drop("up")), F.col("zone"))
    proposed = F.coalesce("up", F.lit(default).cast("string"))
    source = F.when(F.col("up").isNotNull(), "inherited").otherwise("none" if default is None else "config_default")
    mode = F.when((F.col("manual") == "") & ~F.col("accept") & proposed.isNotNull(), "auto_resolved")
    return found.select(
        "path", proposed.alias("proposed"), source.alias("source"), "inherited_from", "zone", (F.col("zone").isNull() & F.col("real")).alias("requires"),
        ((F.col("manual") == "") & F.col("accept") & proposed.isNull()).alias("stale"), mode.alias("mode"), ((F.col("manual") != "") & ~F.col("ok")).alias("bad"),
    )


def fallbacks(dests: DataFrame, prior: DataFrame) -> DataFrame:
    """Fallback place of every folder and its ancestors: ``path, lat, lon, inherited_from, stale, bad``.

    ``prior(path, lat, lon, accept)``.  A valid pair wins; an accepted folder takes that of the nearest ancestor that
    has one; others have none, and the folders below look past them.
    """
    nodes = hierarchy.expand(cut(dests.select("path"))).join(prior, "path", "left")
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    valid = given & scalar.valid_coordinates(F.col("lat"), F.col("lon"))
    pair = F.when(valid, F.struct("lat", "lon"))
    nodes = cut(nodes.select("path", pair.alias("pair"), given.alias("given"), F.coalesce("accept", F.lit(False)).alias("accept")))
    seen = _inherited(nodes, F.col("pair")).drop("inherited_from")
    own = F.coalesce("pair", F.when(~F.col("given") & F.col("accept"), F.col("up")))
    found = _inherited(cut(seen.withColumn("own", own).drop("up")), F.col("own"))
    return found.select("path", "own.lat", "own.lon", "inherited_from", (F.col("accept") & ~F.col("given") & F.col("up").isNull()).alias("stale"), (F.col("given") & F.col("pair").isNull()).alias("bad"))


def day_of(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def buckets(photos: DataFrame) -> DataFrame:
    """Photos of cameras with their ``bucket``: the group, or group@day where it has several days in the folder.

    The numbers of days, a row per folder and group, are written first, so photos are not dealt by these few keys."""
    cams = photos.where("class = 'camera'").withColumn("day", day_of(F.col("naive")))
    days = cut(cams.groupBy("dest", "grp").agg(F.count_distinct("day").alias("days")))
    joined = cams.join(days, ["dest", "grp"])
    return joined.withColumn("day", F.when(F.col("days") > 1, F.col("day"))).withColumn("bucket", F.concat_ws("@", F.col("grp").cast("string"), "day")).drop("days")


def offset_cells(photos: DataFrame, matches: DataFrame, zoned: DataFrame, prior: DataFrame, spread: int = 120, one_anchor: bool = False, many_anchors: bool = True) -> DataFrame:
    """The clock offset of every bucket: ``dest, bucket, grp, day, source, proposed, anchors, conflicts, offset_s, how, requires, stale, bad``.

    ``matches(path, kind, metres, offset_s)`` are native frames found on the track, ``zoned(path, zone)`` the folders' zones,
    ``prior(dest, bucket, accept, manual_s, manual_utc)`` what was decided.  Seconds win over a real time, that over an
    accepted proposal; an unopposed proposal of the track resolves by itself, one of the zone never does.
    """
    frames = cut(buckets(photos).select("path", "dest", "bucket", "grp", "day", "naive", "native"))
    key = F.concat_ws("|", "dest", "bucket")
    cells = frames.groupBy("dest", "bucket", "grp", "day").agg(F.min("naive").alias("first"))
    ranked = frames.where("native")
    # Frames of one path in one bucket are counted, not joined one by one; what has won is a row per bucket.
    held = ranked.select("path", key.alias("grp")).repartition("path").groupBy("path", "grp").agg(F.count("*").alias("n"))
    won = cut(cluster.consensus(matches.join(held, "path").select("grp", "path", "kind", "metres", "offset_s", "n"), spread))
    leads = ranked.select(F.col("path").alias("lead"), F.col("naive").alias("lead_naive"))
    won = won.join(leads, "lead").select(F.col("grp").alias("_key"), F.col("offset_s").alias("gpx"), "members", "conflicts", "lead_naive")
    c = cells.withColumn("_key", key).join(won, "_key", "left").join(zoned.select(F.col("path").alias("dest"), "zone"), "dest", "left").join(prior, ["dest", "bucket"], "left")
    by_zone = F.when(F.col("zone").isNotNull(), scalar.zone_offset(F.timestamp_seconds("first").cast("timestamp_ntz"), F.col("zone")))
    is_gpx = F.col("gpx").isNotNull()
    proposed = F.coalesce("gpx", by_zone)
    source = F.when(is_gpx, "gpx_self_anchor").when(by_zone.isNotNull(), "timezone_naive").otherwise("manual_required")
    anchors = F.coalesce(F.col("members") + F.col("conflicts"), F.lit(0))
    accept, said = F.coalesce("accept", F.lit(False)), F.coalesce("manual_utc", F.lit(""))
    utc = F.unix_seconds(rules.utc_of(said))
    has_s, has_utc = F.col("manual_s").isNotNull(), said != ""
    ok_s = scalar.valid_offset(F.col("manual_s"))
    auto = is_gpx & (F.col("conflicts") == 0) & (F.when(anchors >= 2, F.lit(many_anchors)).otherwise(F.lit(one_anchor)))
    how = (
        F.when(has_s, F.when(ok_s, "manual")).when(has_utc, F.when(utc.isNotNull() & is_gpx, "manual_real_utc"))
        .when(accept, F.when(is_gpx, "gpx_anchor_accepted").when(proposed.isNotNull(), "timezone_accepted")).when(auto, "gpx_anchor_auto")
    )
    value = F.when(how == "manual", F.col("manual_s")).when(how == "manual_real_utc", utc - F.col("lead_naive")).otherwise(F.when(how.isNotNull(), proposed))
    return c.select(
        "dest", "bucket", "grp", "day", source.alias("source"), proposed.alias("proposed"), anchors.alias("anchors"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), value.alias("offset_s"), how.alias("how"),
        how.isNull().alias("requires"), (~has_s & ~has_utc & accept & proposed.isNull()).alias("stale"), (has_s & ~ok_s | ~has_s & has_utc & utc.isNull()).alias("bad"),
    )


def resolve(photos: DataFrame, cells: DataFrame, zoned: DataFrame, validated: DataFrame | None = None) -> DataFrame:
    """Every photo with ``utc`` (seconds, null where it is not resolved), ``rule``, ``used`` (the offset) and ``provenance``.

    A camera's photo takes the cell of its bucket, or the validated offset ``validated(dest, bucket, corrected)`` of it; any other its
    own offset's text, else its folder's zone.  The day's cell counts where it exists, even without an offset.
    """
    zone = zoned.select(F.col("path").alias("dest"), "zone")
    known = cells.select("dest", "bucket", "offset_s", "how")
    day = day_of(F.col("naive"))
    p = photos.withColumn("_dated", F.concat_ws("@", F.col("grp").cast("string"), day)).withColumn("_plain", F.col("grp").cast("string")).join(zone, "dest", "left")
    dated = known.select("dest", F.col("bucket").alias("_dated"), F.struct("bucket", "offset_s", "how").alias("a"))
    plain = known.select("dest", F.col("bucket").alias("_plain"), F.struct("bucket", "offset_s", "how").alias("b"))
    p = p.join(dated, ["dest", "_dated"], "left").join(plain, ["dest", "_plain"], "left").withColumn("cell", F.coalesce("a", "b")).withColumn("bucket", F.col("cell.bucket"))
    if validated is None:
        p = p.withColumn("corrected", F.lit(None).cast("long"))
    else:
        p = p.join(validated.select("dest", "bucket", "corrected"), ["dest", "bucket"], "left")
    camera, own = F.col("class") == "camera", scalar.iso_offset(F.col("offset_text")).cast("long")
    by_zone = F.unix_seconds(scalar.local_to_utc(F.timestamp_seconds("naive").cast("timestamp_ntz"), F.col("zone")).cast("timestamp"))
    offset = F.coalesce("corrected", "cell.offset_s")
    utc = F.when(camera, F.col("naive") + offset).when(own.isNotNull(), F.col("naive") - own).when(F.col("zone").isNotNull(), by_zone)
    rule = F.when(F.col("naive").isNull(), "missing_timestamp").when(camera, F.when(offset.isNull(), "offset_missing").otherwise("camera_group_offset")).when(own.isNotNull(), "smartphone_native_offset").when(F.col("zone").isNotNull(), "destination_timezone").otherwise("timezone_missing")
    used = F.when(F.col("naive").isNotNull(), F.when(camera, offset).otherwise(own))
    provenance = F.when(camera, F.when(F.col("corrected").isNotNull(), "gps_drift_validated").otherwise(F.when(offset.isNotNull(), F.col("cell.how")))).when(own.isNull(), F.col("zone"))
    return p.withColumn("utc", utc).withColumn("rule", rule).withColumn("used", used).withColumn("provenance", F.when(F.col("naive").isNotNull(), provenance)).drop("_dated", "_plain", "a", "b", "cell", "corrected")


def drift(photos: DataFrame, cells: DataFrame, track: DataFrame, prior: DataFrame, window: int = 172_800) -> DataFrame:
    """Buckets whose offset the track could contradict: ``dest, bucket, current, frames, points, corrected, requires, bad``.

    Those with an unconfirmed offset, no native frame on the track (no anchor in their cell), a resolved time, and track
    within the window around their times.  ``prior(dest, bucket, confirmed, corrected_s)``; without a correction the current
    offset is confirmed.  A bucket's photos share its offset, so its times need no resolved photo; spans, a row per bucket, are written.
    """
    left = cells.where(F.col("how").isin(*UNCONFIRMED) & (F.col("anchors") == 0)).select("dest", "bucket", F.col("offset_s").alias("current"))
    frames = buckets(photos).groupBy("dest", "bucket").agg(F.count("*").alias("frames"), F.min("naive").alias("first"), F.max("naive").alias("last"))
    lo, hi = F.col("first") + F.col("current") - window, F.col("last") + F.col("current") + window
    spans = cut(left.join(frames, ["dest", "bucket"]).where("first IS NOT NULL").select("dest", "bucket", "current", "frames", lo.alias("lo"), hi.alias("hi")))
    covered = asof.within(spans, track).groupBy("dest", "bucket", "current", "frames").agg(F.count("*").alias("points"))
    d = covered.join(prior, ["dest", "bucket"], "left")
    confirmed = F.coalesce("confirmed", F.lit(False))
    ok = F.col("corrected_s").isNull() | scalar.valid_offset(F.col("corrected_s"))
    corrected = F.when(confirmed & ok, F.coalesce("corrected_s", "current"))
    return d.select("dest", "bucket", "current", "frames", "points", corrected.alias("corrected"), corrected.isNull().alias("requires"), (confirmed & ~ok).alias("bad"))


def gps(resolved: DataFrame, track: DataFrame, fallback: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every photo with ``category, to_lat, to_lon, gpx_file``; ``fallback(path, lat, lon)`` of folders and
    ``reviews(path, manual_lat, manual_lon, accept)`` of photos."""
    timed = resolved.where("utc IS NOT NULL").select("path", F.col("utc").alias("t"))
    placed = asof.place(timed, track).select("path", "method", F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon"), "gpx_file")
    p = resolved.join(placed, "path", "left").join(fallback.select(F.col("path").alias("dest"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")), "dest", "left").join(reviews, "path", "left")
    manual = F.col("manual_lat").isNotNull() & F.col("manual_lon").isNotNull()
    category = (
        F.when(F.col("native"), "preserve_native").when(manual, "manual_locked").when(F.col("method").isin("direct", "interpolated"), "gpx_interpolation").when(F.col("method") == "extrapolated", "gpx_extrapolation")
        .when(F.col("f_lat").isNotNull(), "manual_fallback").when(F.coalesce("accept", F.lit(False)), "no_change").otherwise("blocked")
    )
    p = p.withColumn("category", category)

    def place(c: str) -> Column:
        return F.when(F.col("category") == "manual_locked", F.col(f"manual_{c}")).when(F.col("category").startswith("gpx"), F.col(f"m_{c}")).when(F.col("category") == "manual_fallback", F.col(f"f_{c}"))

    bad = manual & ~scalar.valid_coordinates(F.col("manual_lat"), F.col("manual_lon"))
    return p.withColumn("to_lat", place("lat")).withColumn("to_lon", place("lon")).withColumn("gpx_file", F.when(F.col("category").startswith("gpx"), F.col("gpx_file"))).withColumn("bad", bad).drop("m_lat", "m_lon", "f_lat", "f_lon", "manual_lat", "manual_lon", "accept", "method")


def gps_summary(decided: DataFrame) -> DataFrame:
    """Counts of every folder by category, with the items to review and the tracks used."""
    counts = [F.count_if(F.col("category") == k).alias(k) for k in GPS_CATEGORIES]
    files = F.array_join(F.array_sort(F.collect_set("gpx_file")), ",").alias("gpx_files")
    return decided.groupBy("dest").agg(F.count("*").alias("files"), *counts, F.count_if(F.col("category") == "blocked").alias("to_review"), files)


def review_items(decided: DataFrame) -> DataFrame:
    reason = F.when(F.col("category") == "manual_locked", "manual_locked").when(F.col("category") == "no_change", "accepted_unlocated").when(F.col("category") == "blocked", "no_reliable_gps_source")
    return decided.select("path", reason.alias("reason"), (F.col("category") == "blocked").alias("requires")).where("reason IS NOT NULL")
