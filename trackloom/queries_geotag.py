"""Queries of decisions about time and place, of the executable plan, and of its reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from . import queries as base
from . import sinks
from .adapters import with_
from .functions import rules
from .operators import hierarchy, spatial
from .plans import decisions, execution
from .registry import query
from .session import cut, folder, settled

# --- zones and fallback places ---------------------------------------------------------------

_PRIOR_ZONES = "('root/c1', 'Asia/Tokyo', false), ('root/c2', 'Mars/Base', false), ('root/c2/s2', '', true), ('root/c2/s7', 'America/New_York', true), ('root/c3/s3', '', true), ('root/c4/s14', 'Europe/Paris', false)"
_PRIOR_PLACES = "('root', 50.5, 4.5, false), ('root/c1', 95.0, 4.0, false), ('root/c1/s1', NULL, NULL, true), ('root/c2', NULL, NULL, true), ('root/c2/s2', NULL, NULL, true), ('root/c3/s3', 10.0, 20.0, false), ('root/c4/s4', 1.0, NULL, true)"
_NODES = """, dests AS (SELECT DISTINCT dest AS path FROM photos), nodes AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM dests),
tree AS (SELECT path, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') END AS parent, path IN (SELECT path FROM dests) AS is_real FROM nodes)"""


def _zone_walk(default: str) -> str:
    """Zones by walking down the tree, level by level."""
    return f""", zp(path, manual, accept) AS (VALUES {_PRIOR_ZONES}), zn AS (SELECT t.*, coalesce(manual, '') AS manual, coalesce(accept, false) AS accept, coalesce(manual, '') IN ('Asia/Tokyo', 'America/New_York', 'Europe/Paris') AS ok FROM tree t LEFT JOIN zp USING (path)),
zw AS (SELECT path, is_real, manual, accept, ok, NULL::VARCHAR AS up, NULL::VARCHAR AS up_from, CASE WHEN ok THEN manual WHEN manual <> '' THEN NULL ELSE {default} END AS zone FROM zn WHERE parent IS NULL
  UNION ALL SELECT c.path, c.is_real, c.manual, c.accept, c.ok, CASE WHEN p.zone IS NULL THEN p.up ELSE p.zone END, CASE WHEN p.zone IS NULL THEN p.up_from ELSE p.path END,
    CASE WHEN c.ok THEN c.manual WHEN c.manual <> '' THEN NULL ELSE coalesce(CASE WHEN p.zone IS NULL THEN p.up ELSE p.zone END, {default}) END FROM zw p JOIN zn c ON c.parent = p.path),
zoned AS (SELECT path, coalesce(up, {default}) AS proposed, CASE WHEN up IS NOT NULL THEN 'inherited' WHEN {default} IS NULL THEN 'none' ELSE 'config_default' END AS source, up_from AS inherited_from, zone, zone IS NULL AND is_real AS requires,
  manual = '' AND accept AND coalesce(up, {default}) IS NULL AS stale, CASE WHEN manual = '' AND NOT accept AND coalesce(up, {default}) IS NOT NULL THEN 'auto_resolved' END AS mode, manual <> '' AND NOT ok AS bad FROM zw)"""


_NO_DEFAULT = "NULL::VARCHAR"
_TREE = with_("photos").replace("WITH ", "WITH RECURSIVE ", 1) + _NODES


def _dests(s):
    return s.photos().select(F.col("dest").alias("path")).distinct()


def _prior_zones(s):
    return s.values(_PRIOR_ZONES, "path, manual, accept")


def _zoned(s, default=None):
    return decisions.zones(_dests(s), _prior_zones(s), rules.zones(s.spark), default)


@query(_TREE + _zone_walk(_NO_DEFAULT) + " SELECT * FROM zoned")
def zone_decisions_f12(s):
    return _zoned(s)


@query(_TREE + _zone_walk("'Europe/Brussels'") + " SELECT * FROM zoned")
def zone_decisions_default_f12(s):
    return _zoned(s, "Europe/Brussels")


@query(_TREE + _zone_walk("'Europe/Brussels'") + " SELECT path, zone AS shown, source <> 'none' AND inherited_from IS NOT NULL AS from_above FROM zoned")
def zone_preview_x31(s):
    """What the editor shows before a run: the same rule on the edits at hand."""
    return _zoned(s, "Europe/Brussels").select("path", F.col("zone").alias("shown"), F.col("inherited_from").isNotNull().alias("from_above"))


_PLACES = f""", fp_(path, lat, lon, accept) AS (VALUES {_PRIOR_PLACES}), fn AS (SELECT t.*, lat IS NOT NULL AND lon IS NOT NULL AS given, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS valid, lat::DOUBLE AS lat, lon::DOUBLE AS lon, coalesce(accept, false) AS accept FROM tree t LEFT JOIN fp_ USING (path)),
fw AS (SELECT path, given, valid, accept, NULL::DOUBLE AS ulat, NULL::DOUBLE AS ulon, NULL::VARCHAR AS up_from, CASE WHEN valid THEN lat END AS lat, CASE WHEN valid THEN lon END AS lon FROM fn WHERE parent IS NULL
  UNION ALL SELECT path, given, valid, accept, ulat, ulon, up_from, CASE WHEN valid THEN lat WHEN NOT given AND accept THEN ulat END, CASE WHEN valid THEN lon WHEN NOT given AND accept THEN ulon END
    FROM (SELECT c.path, c.given, c.valid, c.accept, c.lat, c.lon, CASE WHEN p.lat IS NULL THEN p.ulat ELSE p.lat END AS ulat, CASE WHEN p.lat IS NULL THEN p.ulon ELSE p.lon END AS ulon, CASE WHEN p.lat IS NULL THEN p.up_from ELSE p.path END AS up_from FROM fw p JOIN fn c ON c.parent = p.path)),
fallback AS (SELECT path, lat, lon, up_from AS inherited_from, accept AND NOT given AND ulat IS NULL AS stale, given AND NOT valid AS bad FROM fw)"""


def _fallback(s):
    prior = s.values(_PRIOR_PLACES, "path, lat, lon, accept").selectExpr("path", "cast(lat AS DOUBLE) AS lat", "cast(lon AS DOUBLE) AS lon", "accept")
    return decisions.fallbacks(_dests(s), prior)


@query(_TREE + _PLACES + " SELECT * FROM fallback")
def fallback_places_f16(s):
    return _fallback(s)


# --- clock offsets ---------------------------------------------------------------------------

_SHOTS = """SELECT p.path, dest, grp, CASE WHEN grp IN (1, 2, 3) THEN 'camera' WHEN grp IN (0, 5) THEN 'smartphone' ELSE 'unknown' END AS class, naive, t, native, lat, lon,
  CASE WHEN grp = 0 AND t % 3 = 0 THEN '+02:00' WHEN grp = 5 AND t % 3 = 1 THEN '-05:30' END AS offset_text, md5(cast(cast(floor(t / 7000) AS BIGINT) AS STRING)) AS fp FROM {photos} AS p"""
_PRIOR_CELLS = """SELECT dest, bucket, n % 4 = 0 AS accept, CASE WHEN n % 14 = 0 THEN 90000 WHEN n % 7 = 0 THEN 100 + n END AS manual_s, CASE WHEN n % 15 = 0 THEN 'noon' WHEN n % 5 = 0 THEN '2024-01-10T00:00:00Z' END AS manual_utc
FROM (SELECT dest, bucket, cast(substr(bucket, length(bucket) - 1) AS BIGINT) + length(dest) AS n FROM {keys}) AS k"""
_PRIOR_DRIFT = """SELECT dest, bucket, n % 2 = 0 AS confirmed, CASE WHEN n % 6 = 0 THEN 99999 WHEN n % 4 = 0 THEN 1000 + n END AS corrected_s FROM (SELECT dest, bucket, cast(substr(bucket, length(bucket) - 1) AS BIGINT) + length(dest) AS n FROM {keys}) AS k"""
_DAY = "strftime(make_timestamp(naive * 1000000), '%Y-%m-%d')"
_BUCKETS = ", shots AS (" + _SHOTS.replace("{photos}", "photos").replace("STRING", "VARCHAR") + f"""), cams AS (SELECT *, {_DAY} AS d, count(DISTINCT {_DAY}) OVER (PARTITION BY dest, grp) AS days FROM shots WHERE class = 'camera'),
bk AS (SELECT * EXCLUDE (d, days), CASE WHEN days > 1 THEN d END AS day, grp::VARCHAR || CASE WHEN days > 1 THEN '@' || d ELSE '' END AS bucket FROM cams), cellof AS (SELECT path, dest || '|' || bucket AS grp FROM bk WHERE native)"""
_MATCHED = base._NEAR + base._SEGMENT + _NODES + _zone_walk("'Europe/Brussels'") + _BUCKETS + base._CANDS.split(base._SEGMENT, 1)[1].replace("(SELECT path, grp FROM photos)", "cellof")
_CONS = (_MATCHED + base._LEADERS.split(base._CANDS.replace("WITH ", "WITH RECURSIVE ", 1), 1)[1]).replace("WITH ", "WITH RECURSIVE ", 1)
_PCELLS = ", keys AS (SELECT DISTINCT dest, bucket FROM bk), pc AS (" + _PRIOR_CELLS.replace("{keys}", "keys") + "), pd AS (" + _PRIOR_DRIFT.replace("{keys}", "keys") + ")"
_CELLS = _CONS + _PCELLS + """, lead AS (SELECT grp, naive FROM (SELECT r.grp, r.path, w.offset_s FROM won w JOIN ranked r ON r.grp = w.grp AND r.offset_s = w.offset_s QUALIFY row_number() OVER (PARTITION BY r.grp ORDER BY r.rank) = 1) JOIN (SELECT path, naive FROM shots) USING (path)),
c0 AS (SELECT dest, bucket, grp, day, min(naive) AS first FROM bk GROUP BY ALL),
c1 AS (SELECT c0.*, w.offset_s AS gpx, w.members, w.total, l.naive AS lead_naive, accept, manual_s, coalesce(manual_utc, '') AS said, (epoch(timezone('UTC', timezone(zone, make_timestamp(first * 1000000)))) - first)::BIGINT AS by_zone,
  CASE WHEN manual_utc = '2024-01-10T00:00:00Z' THEN 1704844800 END AS utc FROM c0 LEFT JOIN won w ON w.grp = c0.dest || '|' || c0.bucket LEFT JOIN lead l ON l.grp = w.grp LEFT JOIN zoned z ON z.path = c0.dest LEFT JOIN pc ON pc.dest = c0.dest AND pc.bucket = c0.bucket),
c2 AS (SELECT *, CASE WHEN manual_s IS NOT NULL THEN CASE WHEN abs(manual_s) <= 86400 THEN 'manual' END WHEN said <> '' THEN CASE WHEN utc IS NOT NULL AND gpx IS NOT NULL THEN 'manual_real_utc' END
  WHEN accept THEN CASE WHEN gpx IS NOT NULL THEN 'gpx_anchor_accepted' WHEN by_zone IS NOT NULL THEN 'timezone_accepted' END WHEN gpx IS NOT NULL AND total = members AND total >= 2 THEN 'gpx_anchor_auto' END AS how FROM c1),
cells AS (SELECT dest, bucket, grp, day, CASE WHEN gpx IS NOT NULL THEN 'gpx_self_anchor' WHEN by_zone IS NOT NULL THEN 'timezone_naive' ELSE 'manual_required' END AS source, coalesce(gpx, by_zone) AS proposed, coalesce(total, 0)::BIGINT AS anchors, coalesce(total - members, 0)::BIGINT AS conflicts,
  CASE how WHEN 'manual' THEN manual_s WHEN 'manual_real_utc' THEN utc - lead_naive ELSE CASE WHEN how IS NOT NULL THEN coalesce(gpx, by_zone) END END AS offset_s, how, how IS NULL AS requires,
  manual_s IS NULL AND said = '' AND coalesce(accept, false) AND coalesce(gpx, by_zone) IS NULL AS stale, coalesce(abs(manual_s) > 86400, false) OR (manual_s IS NULL AND said <> '' AND utc IS NULL) AS bad FROM c2)"""


def _shots(s):
    return s.spark.sql(_SHOTS, photos=s.photos())


def _matches(s):
    return base._found(s)


def _cells(s, shots, matches, zoned):
    keys = decisions.buckets(shots).select("dest", "bucket").distinct()
    prior = s.spark.sql(_PRIOR_CELLS, keys=keys).selectExpr("dest", "bucket", "accept", "cast(manual_s AS BIGINT) AS manual_s", "manual_utc")
    return decisions.offset_cells(shots, matches, zoned, prior)


class Stages:
    """The stages of the whole decision: artifacts that are written once and that later stages, and later queries of the
    session over the same unchanged input, read."""

    kept: dict[tuple, Stages] = {}

    def __init__(self, s):
        self.s, self.shots, self.track = s, _shots(s), s.track()

    @classmethod
    def of(cls, s) -> Stages:
        path = s.spark._jvm.org.apache.hadoop.fs.Path(f"{s.dir}/events.parquet")
        status = path.getFileSystem(s.spark._jsc.hadoopConfiguration()).getFileStatus(path)
        key = (s.spark.sparkContext.applicationId, s.dir, status.getModificationTime(), status.getLen())
        return cls.kept.setdefault(key, cls(s))

    @cached_property
    def zoned(self):
        return settled(self.s.spark, lambda: _zoned(self.s, "Europe/Brussels"))

    @cached_property
    def cells(self):
        zoned = self.zoned  # a stage of its own, which stays
        return settled(self.s.spark, lambda: _cells(self.s, self.shots, _matches(self.s), zoned))

    @cached_property
    def drift(self):
        keys = self.cells.select("dest", "bucket").distinct()
        prior = self.s.spark.sql(_PRIOR_DRIFT, keys=keys).selectExpr("dest", "bucket", "confirmed", "cast(corrected_s AS BIGINT) AS corrected_s")
        return cut(decisions.drift(self.shots, self.cells, self.track, prior))

    def times(self, shots):
        """``shots`` with their validated times; each depends on its own row and the cells alone."""
        return decisions.resolve(shots, self.cells, self.zoned, self.drift.where("corrected IS NOT NULL"))

    def places(self, shots, resolved):
        return decisions.gps(resolved, self.track, _fallback(self.s), self.s.spark.sql(_REVIEWS, shots=shots))

    @cached_property
    def resolved(self):
        return cut(self.times(self.shots))

    @cached_property
    def decided(self):
        return cut(self.places(self.shots, self.resolved))

    def decided_of(self, paths):
        """The decisions of the photos in ``paths(path)`` alone, none of which depends on another photo's."""
        if "decided" in vars(self):
            return self.decided.join(paths, "path", "left_semi")
        shots = cut(self.shots.join(paths, "path", "left_semi"))
        return self.places(shots, cut(self.times(shots)))

    @cached_property
    def renames(self):
        # Names need five columns of the photos: where these are not written yet, they alone are.
        res = self.resolved if "resolved" in vars(self) else self.times(self.shots)
        return cut(execution.rename_plan(cut(self.s.spark.sql(_NAMED, res=res))))

    @cached_property
    def operations(self):
        ops = execution.file_operations(self.decided, self.renames)
        return cut(ops.union(execution.reverts(self.decided, _ledger(self.s, self.shots))))


@query(_CELLS + " SELECT * FROM cells")
def offset_cells_f13(s):
    return Stages.of(s).cells


@query(_CELLS + """ SELECT 'zones' AS part, count(*) AS n, count(*) FILTER (requires) AS open, count(*) FILTER (bad) AS bad FROM zoned UNION ALL SELECT 'offsets', count(*), count(*) FILTER (requires), count(*) FILTER (bad) FROM cells""")
def time_decisions_c2(s):
    st = Stages.of(s)
    n = [F.count("*").alias("n"), F.count_if("requires").alias("open"), F.count_if("bad").alias("bad")]
    return st.zoned.agg(*n).select(F.lit("zones").alias("part"), "*").union(st.cells.agg(*n).select(F.lit("offsets"), "*"))


_BACK = {"+02:00": 7200, "-05:30": -19800}


def _resolved_sql(name: str, over: str) -> str:
    own = "CASE offset_text WHEN '+02:00' THEN 7200 WHEN '-05:30' THEN -19800 END"
    return f""", {name} AS (SELECT s.*, z.zone, c.bucket, CASE WHEN class = 'camera' THEN naive + coalesce({over}, c.offset_s) WHEN offset_text IS NOT NULL THEN naive - {own} ELSE epoch(timezone('UTC', timezone(z.zone, make_timestamp(naive * 1000000))))::BIGINT END AS utc,
  CASE WHEN class = 'camera' THEN CASE WHEN coalesce({over}, c.offset_s) IS NULL THEN 'offset_missing' ELSE 'camera_group_offset' END WHEN offset_text IS NOT NULL THEN 'smartphone_native_offset' WHEN z.zone IS NOT NULL THEN 'destination_timezone' ELSE 'timezone_missing' END AS rule,
  CASE WHEN class = 'camera' THEN coalesce({over}, c.offset_s) ELSE {own} END AS used, CASE WHEN class = 'camera' THEN CASE WHEN {over} IS NOT NULL THEN 'gps_drift_validated' WHEN c.offset_s IS NOT NULL THEN c.how END WHEN offset_text IS NULL THEN z.zone END AS provenance
  FROM shots s LEFT JOIN zoned z ON z.path = s.dest LEFT JOIN cells c ON c.dest = s.dest AND c.bucket = CASE WHEN EXISTS (SELECT 1 FROM cells k WHERE k.dest = s.dest AND k.bucket = s.grp::VARCHAR || '@' || {_DAY.replace('naive', 's.naive')}) THEN s.grp::VARCHAR || '@' || {_DAY.replace('naive', 's.naive')} ELSE s.grp::VARCHAR END
  {'LEFT JOIN dr ON dr.dest = s.dest AND dr.bucket = c.bucket' if over != 'NULL::BIGINT' else ''})"""


_DRIFT = _CELLS + _resolved_sql("r0", "NULL::BIGINT") + """, anchored AS (SELECT DISTINCT bk.dest, bk.bucket FROM bk JOIN cand USING (path) WHERE native),
spans AS (SELECT c.dest, c.bucket, c.offset_s AS current, min(r.utc) - 172800 AS lo, max(r.utc) + 172800 AS hi, count(*) AS frames FROM cells c JOIN bk ON bk.dest = c.dest AND bk.bucket = c.bucket JOIN r0 r ON r.path = bk.path
  WHERE how IN ('timezone_accepted', 'manual', 'manual_real_utc') AND NOT EXISTS (SELECT 1 FROM anchored a WHERE a.dest = c.dest AND a.bucket = c.bucket) GROUP BY ALL),
drifts AS (SELECT s.dest, s.bucket, current, frames, points, CASE WHEN confirmed AND (corrected_s IS NULL OR abs(corrected_s) <= 86400) THEN coalesce(corrected_s, current) END AS corrected,
  NOT (confirmed AND (corrected_s IS NULL OR abs(corrected_s) <= 86400)) AS requires, confirmed AND coalesce(abs(corrected_s) > 86400, false) AS bad
  FROM spans s JOIN (SELECT s.dest, s.bucket, count(*) AS points FROM spans s JOIN track k ON k.t BETWEEN lo AND hi GROUP BY ALL) n ON n.dest = s.dest AND n.bucket = s.bucket LEFT JOIN pd ON pd.dest = s.dest AND pd.bucket = s.bucket),
dr AS (SELECT dest, bucket, corrected FROM drifts WHERE corrected IS NOT NULL)"""


@query(_DRIFT + " SELECT * FROM drifts")
def drift_cells_f14(s):
    return Stages.of(s).drift


@query(_CELLS + _resolved_sql("r0", "NULL::BIGINT") + " SELECT path, utc, rule, used, provenance FROM r0")
def resolved_times_j14(s):
    st = Stages.of(s)
    return decisions.resolve(st.shots, st.cells, st.zoned).select("path", "utc", "rule", "used", "provenance")


_RESOLVED = _DRIFT + _resolved_sql("res", "dr.corrected")


@query(_RESOLVED + " SELECT path, utc, used, provenance FROM res")
def validated_times_j15(s):
    return Stages.of(s).resolved.select("path", "utc", "used", "provenance")


@query(_MATCHED.replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT dest, bucket, bool_or(native AND path IN (SELECT path FROM cand)) AS anchored FROM bk GROUP BY dest, bucket")
def anchored_buckets_j21(s):
    frames = decisions.buckets(_shots(s))
    found = _matches(s).select("path", F.lit(True).alias("found"))
    return frames.join(found, "path", "left").groupBy("dest", "bucket").agg(F.bool_or(F.col("native") & F.coalesce("found", F.lit(False))).alias("anchored"))


@query(_CELLS + " SELECT dest, bucket, coalesce(accept, false) AS accept, manual_s, manual_utc FROM cells LEFT JOIN pc USING (dest, bucket)")
def carried_decisions_j19(s):
    """Prior decisions onto the cells of this run; decisions of cells that are gone are left behind."""
    keys = decisions.buckets(_shots(s)).select("dest", "bucket").distinct()
    old = keys.union(s.values("('gone', '1@2024-01-01')", "dest, bucket"))
    prior = s.spark.sql(_PRIOR_CELLS, keys=old).selectExpr("dest", "bucket", "accept", "cast(manual_s AS BIGINT) AS manual_s", "manual_utc")
    return keys.join(prior, ["dest", "bucket"], "left").select("dest", "bucket", F.coalesce("accept", F.lit(False)).alias("accept"), "manual_s", "manual_utc")


@query(_CELLS + """, g AS (SELECT dest, grp, coalesce(accept, false)::INT || '|' || coalesce(manual_s::VARCHAR, '') || '|' || coalesce(manual_utc, '') || '@' || coalesce(proposed::VARCHAR, 'none') AS signature, bucket FROM cells LEFT JOIN pc USING (dest, bucket))
SELECT dest, grp, signature, count(*) AS days, string_agg(bucket, ',' ORDER BY bucket) AS buckets FROM g GROUP BY ALL""")
def editor_rows_a18(s):
    st = Stages.of(s)
    keys = st.cells.select("dest", "bucket").distinct()
    prior = s.spark.sql(_PRIOR_CELLS, keys=keys)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    signature = F.concat(F.concat_ws("|", F.coalesce("accept", F.lit(False)).cast("int").cast("string"), text("manual_s"), text("manual_utc")), F.lit("@"), F.coalesce(F.col("proposed").cast("string"), F.lit("none")))
    rows = st.cells.join(prior, ["dest", "bucket"], "left").select("dest", "grp", signature.alias("signature"), "bucket")
    return rows.groupBy("dest", "grp", "signature").agg(F.count("*").alias("days"), F.array_join(F.array_sort(F.collect_list("bucket")), ",").alias("buckets"))


@query(_CELLS + " SELECT class AS kind, count(*) AS n FROM shots GROUP BY class UNION ALL SELECT 'open cells', count(*) FILTER (requires) FROM cells UNION ALL SELECT 'open zones', count(*) FILTER (requires) FROM zoned")
def console_counts_a17(s):
    st = Stages.of(s)
    n = st.shots.groupBy(F.col("class").alias("kind")).agg(F.count("*").alias("n"))
    return n.union(st.cells.agg(F.count_if("requires")).select(F.lit("open cells"), "*")).union(st.zoned.agg(F.count_if("requires")).select(F.lit("open zones"), "*"))


@query(with_("photos") + _BUCKETS + f""" SELECT grp, class, count(*) AS n, string_agg(DISTINCT dest, ',' ORDER BY dest) AS dests, count(*) FILTER (native) AS with_gps, count(*) FILTER (offset_text IS NULL) AS without_offset, min(naive) AS first_naive, max(naive) AS last_naive FROM shots GROUP BY grp, class""")
def camera_group_facts_a2(s):
    return _shots(s).groupBy("grp", "class").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("dest")), ",").alias("dests"), F.count_if("native").alias("with_gps"), F.count_if(F.col("offset_text").isNull()).alias("without_offset"), F.min("naive").alias("first_naive"), F.max("naive").alias("last_naive"))


@query(with_("photos") + _BUCKETS + """ SELECT dest, count(*) AS n, count(DISTINCT grp) AS groups, count(DISTINCT CASE WHEN class = 'camera' THEN grp END) AS cameras, count(*) FILTER (native) AS with_gps, count(*) FILTER (NOT native) AS without_gps, min(naive) AS first_naive, max(naive) AS last_naive,
  count(DISTINCT fp) AS contents FROM shots GROUP BY dest""")
def dest_fact_table_a3(s):
    camera = F.when(F.col("class") == "camera", F.col("grp"))
    return _shots(s).groupBy("dest").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"), F.count_distinct(camera).alias("cameras"), F.count_if("native").alias("with_gps"), F.count_if(~F.col("native")).alias("without_gps"), F.min("naive").alias("first_naive"), F.max("naive").alias("last_naive"), F.count_distinct("fp").alias("contents"))


# --- places ----------------------------------------------------------------------------------

_REVIEWS = "SELECT path, CASE WHEN t % 19 = 0 THEN 51.5D END AS manual_lat, CASE WHEN t % 19 = 0 THEN 4.25D WHEN t % 17 = 0 THEN 3D END AS manual_lon, t % 4 = 0 AS accept FROM {shots}"
_GPS = _RESOLVED + ", rev AS (" + _REVIEWS.replace("{shots}", "shots").replace("51.5D", "51.5::DOUBLE").replace("4.25D", "4.25::DOUBLE").replace("3D", "3::DOUBLE") + ")" + _PLACES + f""",
tp AS (SELECT path, utc AS t FROM res WHERE utc IS NOT NULL), br AS (SELECT p.*, b.t AS bt, b.lat AS blat, b.lon AS blon, b.file AS bfile, a.t AS at_, a.lat AS alat, a.lon AS alon, a.file AS afile FROM tp p ASOF LEFT JOIN track b ON b.t <= p.t ASOF LEFT JOIN track a ON a.t > p.t),
e AS (SELECT (SELECT list([t, lat, lon] ORDER BY t) FROM (SELECT * FROM track ORDER BY t, file, idx LIMIT 2)) AS first, (SELECT list([t, lat, lon] ORDER BY t DESC) FROM (SELECT * FROM track ORDER BY t DESC, file DESC, idx DESC LIMIT 2)) AS last,
  (SELECT file FROM track ORDER BY t, file, idx LIMIT 1) AS ffile, (SELECT file FROM track ORDER BY t DESC, file DESC, idx DESC LIMIT 1) AS lfile),
g AS (SELECT br.*, CASE WHEN at_ IS NULL THEN e.last ELSE e.first END AS side, CASE WHEN at_ IS NULL THEN lfile ELSE ffile END AS sfile, {base.hav('blat', 'blon', 'alat', 'alon')} AS metres, bt IS NOT NULL AND (at_ IS NULL OR t - bt <= at_ - t) AS early FROM br, e),
pl AS (SELECT *, CASE WHEN abs(t - CASE WHEN early THEN bt ELSE at_ END) <= 60 THEN 'direct' WHEN bt IS NOT NULL AND at_ IS NOT NULL THEN CASE WHEN at_ - bt <= 1800 AND metres <= 1000 AND metres / (at_ - bt) * 3.6 <= 150 THEN 'interpolated' ELSE 'blocked' END WHEN abs(t - side[1][1]) <= 300 THEN 'extrapolated' ELSE 'blocked' END AS method FROM g),
fin AS (SELECT path, method, CASE method WHEN 'direct' THEN CASE WHEN early THEN blat ELSE alat END WHEN 'interpolated' THEN round(blat + (alat - blat) * ((t - bt) / (at_ - bt)), 6) WHEN 'extrapolated' THEN round(side[2][2] + (side[1][2] - side[2][2]) * ((t - side[2][1]) / (side[1][1] - side[2][1])), 6) END AS mlat,
  CASE method WHEN 'direct' THEN CASE WHEN early THEN blon ELSE alon END WHEN 'interpolated' THEN round(blon + (alon - blon) * ((t - bt) / (at_ - bt)), 6) WHEN 'extrapolated' THEN round(side[2][3] + (side[1][3] - side[2][3]) * ((t - side[2][1]) / (side[1][1] - side[2][1])), 6) END AS mlon,
  CASE method WHEN 'direct' THEN CASE WHEN early THEN bfile ELSE afile END WHEN 'interpolated' THEN bfile WHEN 'extrapolated' THEN sfile END AS file FROM pl),
dec AS (SELECT res.*, CASE WHEN native THEN 'preserve_native' WHEN manual_lat IS NOT NULL AND manual_lon IS NOT NULL THEN 'manual_locked' WHEN method IN ('direct', 'interpolated') THEN 'gpx_interpolation' WHEN method = 'extrapolated' THEN 'gpx_extrapolation' WHEN fb.lat IS NOT NULL THEN 'manual_fallback' WHEN accept THEN 'no_change' ELSE 'blocked' END AS category,
  manual_lat, manual_lon, mlat, mlon, file, fb.lat AS flat, fb.lon AS flon FROM res LEFT JOIN fin ON fin.path = res.path LEFT JOIN fallback fb ON fb.path = res.dest LEFT JOIN rev ON rev.path = res.path),
decided AS (SELECT *, CASE category WHEN 'manual_locked' THEN manual_lat WHEN 'gpx_interpolation' THEN mlat WHEN 'gpx_extrapolation' THEN mlat WHEN 'manual_fallback' THEN flat END AS to_lat, CASE category WHEN 'manual_locked' THEN manual_lon WHEN 'gpx_interpolation' THEN mlon WHEN 'gpx_extrapolation' THEN mlon WHEN 'manual_fallback' THEN flon END AS to_lon,
  CASE WHEN category LIKE 'gpx%' THEN file END AS gpx_file FROM dec)"""


@query(_GPS + " SELECT path, category, to_lat, to_lon, gpx_file FROM decided")
def gps_decisions_f15(s):
    return Stages.of(s).decided.select("path", "category", "to_lat", "to_lon", "gpx_file")


@query(_GPS + " SELECT dest, count(*) AS files, " + ", ".join(f"count(*) FILTER (category = '{k}') AS {k}" for k in decisions.GPS_CATEGORIES) + ", count(*) FILTER (category = 'blocked') AS to_review, coalesce(string_agg(DISTINCT gpx_file, ',' ORDER BY gpx_file), '') AS gpx_files FROM decided GROUP BY dest")
def gps_decisions_c3(s):
    return decisions.gps_summary(Stages.of(s).decided)


@query(_GPS + " SELECT path, CASE category WHEN 'manual_locked' THEN 'manual_locked' WHEN 'no_change' THEN 'accepted_unlocated' ELSE 'no_reliable_gps_source' END AS reason, category = 'blocked' AS requires FROM decided WHERE category IN ('manual_locked', 'no_change', 'blocked')")
def review_items_f17(s):
    return decisions.review_items(Stages.of(s).decided)


# --- the executable plan ---------------------------------------------------------------------

_NAMED = "SELECT path, dest, CASE WHEN t % 6 = 0 THEN '2024-01-05--10-00-00' WHEN t % 6 = 1 THEN '2024-01-05--10-00-00-001' ELSE 'IMG' || cast(t AS STRING) END || CASE WHEN t % 4 = 0 THEN '.JPG' ELSE '.jpg' END AS name, CASE WHEN utc IS NOT NULL THEN 1704445200 + utc % 40 END AS utc, zone FROM {res}"
_RENAMES = _GPS + ", nm AS (" + _NAMED.replace("{res}", "res").replace("STRING", "VARCHAR") + """), want AS (SELECT *, strftime(timezone(zone, timezone('UTC', make_timestamp(utc * 1000000))), '%Y-%m-%d--%H-%M-%S') AS base, regexp_extract(name, '\\.([^.]*)$', 1) AS e FROM nm),
wr AS (SELECT *, coalesce(base IS NOT NULL AND lower(name) <> lower(base || '.' || e), false) AS rename FROM want),
rk AS (SELECT *, row_number() OVER (PARTITION BY dest, lower(base), lower(e) ORDER BY path) AS r FROM wr WHERE rename),
tk AS (SELECT DISTINCT dest, lower(regexp_replace(name, '-[0-9]{3}(\\.[^.]*)$', '\\1')) AS bare, coalesce(nullif(regexp_extract(name, '-([0-9]{3})\\.[^.]*$', 1), '')::INT, 0) AS slot FROM nm),
fr AS (SELECT dest, bare, slot, row_number() OVER (PARTITION BY dest, bare ORDER BY slot) AS r FROM (SELECT dest, lower(base || '.' || e) AS bare, unnest(range(0, count(*) + 300)) AS slot FROM rk GROUP BY 1, 2) ANTI JOIN tk USING (dest, bare, slot)),
renames AS (SELECT wr.path, wr.name, CASE WHEN wr.rename THEN wr.base || CASE WHEN slot = 0 THEN '' ELSE '-' || lpad(slot::VARCHAR, 3, '0') END || '.' || wr.e ELSE wr.name END AS new_name, wr.rename
  FROM wr LEFT JOIN rk ON rk.path = wr.path LEFT JOIN fr ON fr.dest = rk.dest AND fr.bare = lower(rk.base || '.' || rk.e) AND fr.r = rk.r)"""


@query(_RENAMES + " SELECT path, name, new_name, rename FROM renames")
def rename_plan_w4(s):
    return Stages.of(s).renames.select("path", "name", "new_name", "rename")


_LEDGER = "SELECT fp, min(path) AS path, max(t % 2 = 0) AS present, max(t % 90) AS lat FROM {shots} WHERE t % 3 = 0 GROUP BY fp"
_OPS = _RENAMES + ", led AS (" + _LEDGER.replace("{shots}", "shots") + """), six AS (SELECT *, CASE WHEN to_lat IS NOT NULL THEN printf('%.6f', to_lat) || ' ' || printf('%.6f', to_lon) || ' ' || CASE WHEN category LIKE 'gpx%' THEN 'apply_gpx' ELSE 'apply_manual' END END AS place,
  timezone(zone, timezone('UTC', make_timestamp(utc * 1000000))) AS loc FROM decided),
tx AS (SELECT *, strftime(loc, '%Y:%m:%d %H:%M:%S') || ' ' || CASE WHEN epoch(loc) < utc THEN '-' ELSE '+' END || lpad((abs(epoch(loc)::BIGINT - utc) // 3600)::VARCHAR, 2, '0') || ':' || lpad((abs(epoch(loc)::BIGINT - utc) % 3600 // 60)::VARCHAR, 2, '0') AS stamp FROM six),
ops AS (SELECT path, dest, 0 AS seq, 'metadata_time_write' AS kind, stamp AS payload FROM tx WHERE utc IS NOT NULL AND zone IS NOT NULL UNION ALL SELECT path, dest, 1, 'metadata_gps_write', place FROM tx WHERE place IS NOT NULL
  UNION ALL SELECT path, dest, 2, 'gps_marker_write', CASE category WHEN 'gpx_interpolation' THEN 'GPX-INTERPOLATED' WHEN 'gpx_extrapolation' THEN 'GPX-EXTRAPOLATED' ELSE 'MANUAL' END FROM tx WHERE place IS NOT NULL
  UNION ALL SELECT d.path, dest, 3, 'rename_no_clobber', name || ' ' || new_name FROM decided d JOIN renames r ON r.path = d.path WHERE rename
  UNION ALL SELECT l.path, dest, 4, 'revert_manual_gps', CASE WHEN present THEN l.lat::VARCHAR || '|4.5|receiver' ELSE '||' END FROM led l JOIN decided d ON d.path = l.path WHERE category NOT IN ('manual_locked', 'manual_fallback'))"""


def _ledger(s, shots):
    rows = s.spark.sql(_LEDGER, shots=shots)
    lat = F.when(F.col("present"), F.col("lat"))
    return rows.select("fp", "path", rules.pre_state(lat, F.lit(4.5), F.lit("receiver")).alias("pre"))


def _operations(s):
    st = Stages.of(s)
    return st, st.decided, st.operations


@query(_OPS + " SELECT path, kind, payload, substr(sha256(kind || chr(10) || path || chr(10) || payload), 1, 16) AS op_id FROM ops")
def executable_plan_c4(s):
    return _operations(s)[2].select("path", "kind", "payload", "op_id")


@query(_OPS + " SELECT path, kind, payload FROM ops WHERE kind = 'rename_no_clobber' OR kind LIKE '%gps%' AND kind <> 'revert_manual_gps'")
def gated_operations_x22(s):
    """The policy writes no times."""
    st = Stages.of(s)
    return execution.file_operations(st.decided, st.renames, times=False).select("path", "kind", "payload")


@query(_OPS + " SELECT path, payload FROM ops WHERE kind = 'revert_manual_gps'")
def reverts_j16(s):
    """The ledger has a photo per content, so only these are decided; the whole plan's decisions are not written for it."""
    st = Stages.of(s)
    ledger = cut(_ledger(s, st.shots))
    return execution.reverts(st.decided_of(ledger.select("path")), ledger).select("path", "payload")


@query(_OPS + """ SELECT fp, min(path) AS path, min_by(t % 2 = 0, path) AS present FROM shots WHERE path IN (SELECT path FROM ops WHERE kind = 'metadata_gps_write' AND payload LIKE '%apply_manual') AND fp NOT IN (SELECT fp FROM led) GROUP BY fp""")
def pins_j23(s):
    """Places alone are pinned, so neither names nor the whole plan are made for it."""
    st = Stages.of(s)
    ops = execution.file_operations(st.decided, None, times=False, names=False)
    lat = F.when(F.col("t") % 2 == 0, F.col("lat"))
    photos = st.shots.select("fp", "path", rules.pre_state(lat, F.col("lon"), F.lit(None).cast("string")).alias("pre"))
    return execution.pins(ops, photos, _ledger(s, st.shots)).select("fp", "path", F.col("pre.present").alias("present"))


@query(_OPS + ", per AS (SELECT dest, count(*) AS operations, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in execution.KINDS) + ", count(DISTINCT path) AS touched FROM ops GROUP BY dest) SELECT d.dest, coalesce(operations, 0) AS operations, " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in execution.KINDS) + ", n - coalesce(touched, 0) AS no_ops FROM (SELECT dest, count(*) AS n FROM decided GROUP BY dest) d LEFT JOIN per ON per.dest = d.dest")
def plan_counts_a7(s):
    _, decided, ops = _operations(s)
    return execution.op_summary(decided, ops)


@query(_RESOLVED + " SELECT path AS what, 'no valid time' AS reason FROM res WHERE utc IS NULL UNION ALL SELECT 'offsets', 'not complete' WHERE EXISTS (SELECT 1 FROM cells WHERE requires) UNION ALL SELECT 'drift', 'not complete' WHERE EXISTS (SELECT 1 FROM drifts WHERE requires)")
def plan_blockers_f23(s):
    st = Stages.of(s)
    drift = st.drift
    done = lambda df, name: df.agg((F.count_if("requires") == 0).alias("complete")).select(F.lit(name).alias("name"), "complete")
    gates = done(st.zoned, "zones").union(done(st.cells, "offsets")).union(done(drift, "drift"))
    return execution.blockers(st.resolved, gates)


_OLD = "SELECT DISTINCT fp, 0 AS seq, 'organized' AS action, 'by-date/' AS value FROM {shots} WHERE t % 2 = 0"


_LOG = _OPS + ", old AS (" + _OLD.replace("{shots}", "shots") + """), st AS (SELECT fp, 0 AS run, '' AS path, seq, action, value FROM old
  UNION ALL SELECT fp, 1, path, 0, 'clock_offset_applied', used::VARCHAR FROM decided WHERE rule = 'camera_group_offset' UNION ALL SELECT fp, 1, path, 1, 'resolved_utc', utc::VARCHAR FROM decided WHERE utc IS NOT NULL
  UNION ALL SELECT fp, 1, path, 2, 'timezone_resolved', zone FROM decided WHERE zone IS NOT NULL UNION ALL SELECT fp, 1, d.path, 3, 'gps_reverted', payload FROM decided d JOIN ops o ON o.path = d.path AND kind = 'revert_manual_gps'
  UNION ALL SELECT fp, 1, d.path, 4, 'gps_written', payload FROM decided d JOIN ops o ON o.path = d.path AND kind = 'metadata_gps_write' WHERE NOT EXISTS (SELECT 1 FROM ops x WHERE x.path = d.path AND x.kind = 'revert_manual_gps')
  UNION ALL SELECT fp, 1, d.path, 5, 'gps_preserved', 'native' FROM decided d WHERE native AND NOT EXISTS (SELECT 1 FROM ops x WHERE x.path = d.path AND x.kind IN ('revert_manual_gps', 'metadata_gps_write'))
  UNION ALL SELECT fp, 1, d.path, 6, 'final_rename', payload FROM decided d JOIN ops o ON o.path = d.path AND kind = 'rename_no_clobber')
SELECT fp, count(*) AS steps, string_agg(action || '=' || value, ';' ORDER BY run, path, seq) AS journey FROM st GROUP BY fp"""


@query(_LOG)
def complete_log_j17(s):
    st, decided, ops = _operations(s)
    return execution.journeys(decided, ops, s.spark.sql(_OLD, shots=st.shots))


@query("SELECT count(*) AS photos, sum(steps)::BIGINT AS steps, true AS snapshot_same FROM (" + _LOG + ")")
def finalised_package_c11(s):
    """The log of every photo, a verified snapshot of it, and what the package holds."""
    st, decided, ops = _operations(s)
    log = cut(execution.journeys(decided, ops, s.spark.sql(_OLD, shots=st.shots)))
    same = sinks.snapshot(log, folder(s.spark, "package"))
    return log.agg(F.count("*").alias("photos"), F.sum("steps").alias("steps")).withColumn("snapshot_same", F.lit(same))


@query(with_("ops", "results") + """, c AS (SELECT dest, count(*) FILTER (result = 'applied') AS applied, count(*) FILTER (result = 'skipped') AS skipped, count(*) FILTER (result = 'failed') AS failed, count(*) FILTER (result = 'mismatch') AS mismatch, count(*) FILTER (result IS NULL) AS not_reached, grouping(dest) AS g FROM ops LEFT JOIN results USING (op) GROUP BY ROLLUP (dest))
SELECT CASE WHEN g = 1 THEN 'total' ELSE dest::VARCHAR END AS dest, applied, skipped, failed, mismatch, not_reached, CASE WHEN failed + mismatch = 0 THEN 'success' WHEN mismatch > 0 OR applied > 0 OR skipped > 0 THEN 'partial' ELSE 'failed' END AS status FROM c""")
def execution_summary_c9(s):
    return execution.results_summary(s.rel("ops"), s.rel("results"))


@query(with_("ops", "results") + "SELECT kind, dest, count(*) AS n FROM ops JOIN results USING (op) WHERE result = 'applied' GROUP BY kind, dest")
def applied_by_kind_j24(s):
    return s.rel("ops").join(s.rel("results"), "op").where("result = 'applied'").groupBy("kind", "dest").agg(F.count("*").alias("n"))


@query(with_("ops", "results") + "SELECT op, item FROM ops JOIN results USING (op) WHERE result = 'mismatch' AND item IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0)")
def accepted_mismatches_j26(s):
    accepted = s.part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("item"))
    return s.rel("ops").join(s.rel("results").where("result = 'mismatch'"), "op").join(accepted, "item", "left_semi").select("op", "item")


_TRACK_SET = "SELECT file, count(*) AS points, min(t) AS first_t, max(t) AS last_t FROM track GROUP BY file"


@query(with_("track", "photos") + f"SELECT p.path, k.file, k.points FROM (SELECT path, t FROM photos WHERE native) p JOIN ({_TRACK_SET}) k ON p.t BETWEEN k.first_t AND k.last_t")
def covering_tracks_j9(s):
    """The tracks whose time spans a native frame's; there is a row per track file, so that side is small."""
    files = s.track().groupBy("file").agg(F.count("*").alias("points"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return s.photos().where("native").select("path", "t").join(files, F.col("t").between(F.col("first_t"), F.col("last_t"))).select("path", "file", "points")


@query(base._NEAR + "SELECT f.path, point IS NOT NULL AS found FROM f LEFT JOIN near USING (path)")
def matched_frames_o6(s):
    frames = s.photos().where("native")
    return frames.join(spatial.nearest_point(frames, s.track()).select("path", "point"), "path", "left").select("path", F.col("point").isNotNull().alias("found"))


@query(base._CANDS.replace("WITH ", "WITH ", 1) + "SELECT grp, path, rank FROM ranked WHERE rank <= 3")
def best_anchors_o4(s):
    from .operators import cluster

    return cluster.anchors(base._candidates(s)).where("rank <= 3").select("grp", "path", F.col("rank").cast("long").alias("rank"))


@query(with_("photos") + _NODES + " SELECT path, coalesce(nullif(regexp_replace(path, '^root/?', ''), ''), '(root)') AS label, len(string_split(path, '/')) AS depth, coalesce(array_to_string(string_split(path, '/')[1:-2], '/'), '') AS parent FROM nodes")
def labels_x24(s):
    nodes = hierarchy.expand(_dests(s))
    parts = F.split("path", "/")
    label = F.coalesce(F.nullif(F.regexp_replace("path", "^root/?", ""), F.lit("")), F.lit("(root)"))
    return nodes.select("path", label.alias("label"), F.size(parts).cast("long").alias("depth"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("parent"))
