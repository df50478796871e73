"""Scalar expressions on columns: geometry, times, names.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; fixed.
EARTH_RADIUS = 6_371_000.0
NAIVE = "yyyy:MM:dd HH:mm:ss"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def equirect(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Local plane coordinates in metres around (lat0, lon0)."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS, F.radians(lat - lat0) * EARTH_RADIUS


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Distance from a point to a segment and the clamped share along it (0 for a segment without length)."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    share = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(square == 0, 1.0).otherwise(square))))
    return F.hypot(px - (ax + share * dx), py - (ay + share * dy)), share


def interpolate(a: Column, b: Column, ta: Column, tb: Column, t: Column) -> Column:
    """Value at t on the line through (ta, a) and (tb, b), also beyond them; a where the span is zero."""
    span = tb - ta
    return F.when(span == 0, a).otherwise(a + (b - a) * ((t - ta) / F.when(span == 0, 1).otherwise(span)))


def rounded(value: Column, places: int) -> Column:
    """Rounded as SQL engines round binary numbers: the scaled number's nearest whole one, halves away from zero (Spark's
    own ``round`` goes by the shortest decimal text, which may be a half where the number is none, and none where it scales to one)."""
    return F.round(value * float(10**places)) / float(10**places)


def naive_time(text: Column) -> Column:
    """Wall time of the first 19 characters; null where they are none."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit(NAIVE)).cast("timestamp_ntz")


def iso_offset(text: Column) -> Column:
    """Seconds of ``+HH:MM`` or ``-HH:MM`` (what follows is ignored); null for other texts."""
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    hours, minutes = F.regexp_extract(text, r"^[+-](\d{2}):(\d{2})", 1), F.regexp_extract(text, r"^[+-](\d{2}):(\d{2})", 2)
    return F.when(text.rlike(r"^[+-]\d{2}:\d{2}"), sign * (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60))


def local_to_utc(naive: Column, zone: Column) -> Column:
    """Wall time in a zone as UTC; in an overlap the earlier instant."""
    return F.convert_timezone(zone, F.lit("UTC"), naive)


def utc_to_stamp(utc: Column, zone: Column) -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), zone, utc), "yyyy-MM-dd--HH-mm-ss")


def suffix_root(stem: Column) -> Column:
    """A name without its ``-NNN`` suffix (three digits or more)."""
    return F.regexp_replace(stem, r"-(\d{3,})$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_class(path: Column, classes: dict[str, str]) -> Column:
    """Class of a path's extension; ``other`` where it is not listed."""
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return F.coalesce(table[extension(path)], F.lit("other"))


def ancestors(path: Column) -> Column:
    """Proper ancestors of a path, the topmost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def camera_key(*fields: Column) -> Column:
    """Trimmed identity fields joined by a pipe, nulls left out; ``unknown`` where all are null."""
    return F.coalesce(F.nullif(F.concat_ws("|", *[F.trim(f) for f in fields]), F.lit("")), F.lit("unknown"))


def op_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, each on a line of its own."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def extrapolate(a: Column, b: Column, ta: Column, tb: Column, t: Column) -> Column:
    """Value at t on the line from (ta, a) through the anchor (tb, b), to 6 digits; the anchor's where the span is zero."""
    return F.round(F.when(ta == tb, b).otherwise(interpolate(a, b, ta, tb, t)), 6)


def whole_seconds(seconds: Column) -> Column:
    """Rounded half to even."""
    return F.bround(seconds, 0).cast("long")


def naive_date(text: Column) -> Column:
    """Calendar date of a wall time's text; null where it is none."""
    return F.date_format(naive_time(text), "yyyy-MM-dd")


def taken_at(*fields: Column) -> Column:
    """Wall time of the first field that is not null; a bad one is not rescued by a later field."""
    return naive_time(F.coalesce(*fields))


def zone_offset(naive: Column, zone: Column) -> Column:
    """Seconds to add to a wall time to get UTC."""
    return F.timestamp_diff("SECOND", naive, local_to_utc(naive, zone))


def utc_to_text(utc: Column, zone: Column) -> tuple[Column, Column]:
    """Wall time's text and ``+HH:MM`` of a UTC time in a zone."""
    local = F.convert_timezone(F.lit("UTC"), zone, utc)
    seconds = F.timestamp_diff("SECOND", utc, local)
    minutes = F.floor(F.abs(seconds) / 60)
    sign = F.when(seconds < 0, "-").otherwise("+")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.date_format(local, NAIVE), F.concat(sign, two(F.floor(minutes / 60)), F.lit(":"), two(minutes % 60))


def gpx_time(text: Column) -> Column:
    """Instant of ``YYYY-MM-DDTHH:MM:SSZ``, or of an ISO time (a fraction allowed) with an offset; else null."""
    t = F.trim(text)
    whole = t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    offset = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?[+-]\d{2}:\d{2}$")
    return F.when(whole | offset, t.try_cast("timestamp"))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def valid_offset(seconds: Column) -> Column:
    """Whether a clock offset is at most a day."""
    return F.coalesce(F.abs(seconds) <= 86_400, F.lit(False))


def priority(path: Column, order: list[str]) -> Column:
    """Place of a path's top folder in ``order``; their number where it is not listed."""
    return F.when(F.array_position(F.lit(order), top := F.split(path, "/")[0]) > 0, F.array_position(F.lit(order), top) - 1).otherwise(len(order))
