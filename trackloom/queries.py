"""One query per operator, each with its DuckDB oracle where SQL can express it; the other modules of queries add theirs."""

# ruff: noqa: E402, F401

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .adapters import CLASSES, with_
from .functions import scalar
from .operators import asof, cluster, hierarchy, naming, relational, spatial
from .registry import ORACLES, QUERIES, query
from .session import settled
from .sources import gpx

_HAV = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return _HAV.format(a=a)


# --- time series -----------------------------------------------------------------------------

@query(with_("bracket") + "SELECT path, bidx AS before_idx, aidx AS after_idx FROM bracket")
def asof_backward_forward_j7(s):
    return asof.bracket(s.photos(), s.track()).select("path", F.col("before.idx").alias("before_idx"), F.col("after.idx").alias("after_idx"))


@query(with_("bracket") + "SELECT path, CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN bidx ELSE coalesce(aidx, bidx) END AS idx, CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN t - bt ELSE at_ - t END AS apart FROM bracket")
def nearest_tolerance_j8(s):
    rows = asof.bracket(s.photos(), s.track())
    near = asof.nearest(F.col("before"), F.col("after"), F.col("t"))
    return rows.select("path", near["idx"].alias("idx"), F.abs(F.col("t") - near["t"]).alias("apart"))


def _placed(extra: str = "") -> str:
    return with_("bracket") + f""", e AS (SELECT
  (SELECT list([t, lat, lon] ORDER BY t) FROM (SELECT * FROM track ORDER BY t, file, idx LIMIT 2)) AS first,
  (SELECT list([t, lat, lon] ORDER BY t DESC) FROM (SELECT * FROM track ORDER BY t DESC, file DESC, idx DESC LIMIT 2)) AS last),
g AS (SELECT b.*, CASE WHEN at_ IS NULL THEN e.last ELSE e.first END AS side, {hav('blat', 'blon', 'alat', 'alon')} AS metres,
  CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN bt ELSE coalesce(at_, bt) END AS nt, CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN blat ELSE coalesce(alat, blat) END AS nlat,
  CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN blon ELSE coalesce(alon, blon) END AS nlon FROM bracket b, e),
placed AS (SELECT *, CASE WHEN abs(t - nt) <= 60 THEN 'direct'
  WHEN bt IS NOT NULL AND at_ IS NOT NULL THEN CASE WHEN at_ - bt <= 1800 AND metres <= 1000 AND metres / (at_ - bt) * 3.6 <= 150 THEN 'interpolated' ELSE 'blocked' END
  WHEN abs(t - side[1][1]) <= 300 THEN 'extrapolated' ELSE 'blocked' END AS method FROM g),
final AS (SELECT path, dest, grp, native, method,
  CASE method WHEN 'direct' THEN nlat WHEN 'interpolated' THEN round(blat + (alat - blat) * ((t - bt) / (at_ - bt)), 6)
    WHEN 'extrapolated' THEN round(side[2][2] + (side[1][2] - side[2][2]) * ((t - side[2][1]) / (side[1][1] - side[2][1])), 6) END AS lat,
  CASE method WHEN 'direct' THEN nlon WHEN 'interpolated' THEN round(blon + (alon - blon) * ((t - bt) / (at_ - bt)), 6)
    WHEN 'extrapolated' THEN round(side[2][3] + (side[1][3] - side[2][3]) * ((t - side[2][1]) / (side[1][1] - side[2][1])), 6) END AS lon FROM placed)
{extra}"""


@query(_placed("SELECT path, method, lat, lon FROM final"))
def place_gps_f18(s):
    return asof.place(s.photos(), s.track()).select("path", "method", "lat", "lon")


_CATEGORY = "CASE WHEN native THEN 'preserve_native' WHEN method IN ('direct', 'interpolated') THEN 'gpx_interpolation' WHEN method = 'extrapolated' THEN 'gpx_extrapolation' WHEN grp = 4 THEN 'manual_fallback' WHEN grp = 5 THEN 'no_change' ELSE 'blocked' END"


def _categories(s):
    return asof.place(s.photos(), s.track()).withColumn("category", F.expr(_CATEGORY))


@query(_placed(f"SELECT path, {_CATEGORY} AS category FROM final"))
def gps_category_f15(s):
    return _categories(s).select("path", "category")


_KINDS = ("preserve_native", "gpx_interpolation", "gpx_extrapolation", "manual_fallback", "no_change", "blocked")


@query(_placed(f", c AS (SELECT dest, {_CATEGORY} AS category FROM final) SELECT dest, " + ", ".join(f"count(*) FILTER (category = '{k}') AS {k}" for k in _KINDS) + " FROM c GROUP BY dest"))
def gps_summary_a6(s):
    return _categories(s).groupBy("dest").agg(*[F.count_if(F.col("category") == k).alias(k) for k in _KINDS])


@query(with_("track") + "SELECT 'first' AS side, t, idx FROM (SELECT * FROM track ORDER BY t, file, idx LIMIT 2) UNION ALL SELECT 'last', t, idx FROM (SELECT * FROM track ORDER BY t DESC, file DESC, idx DESC LIMIT 2)")
def track_ends_w9(s):
    e = asof.ends(s.track())
    one = lambda c: e.select(F.lit(c).alias("side"), F.explode(c).alias("p"))
    return one("first").union(one("last")).select("side", "p.t", "p.idx")


@query(with_("track") + "SELECT idx AS a, b, bt - t AS seconds FROM (SELECT idx, t, lead(idx) OVER w AS b, lead(t) OVER w AS bt FROM track WINDOW w AS (ORDER BY t, file, idx)) WHERE b IS NOT NULL")
def track_segments_w3(s):
    return spatial.segments(s.track()).select(F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), (F.col("b.t") - F.col("a.t")).alias("seconds"))


@query(with_("track", "photos") + ", k AS (SELECT dest, grp, min(t) - 600 AS lo, min(t) + 7200 AS hi FROM photos GROUP BY ALL) SELECT dest, grp, count(*) AS points, min(track.idx) AS least, max(track.idx) AS most FROM k JOIN track ON track.t BETWEEN lo AND hi GROUP BY dest, grp")
def interval_track_j9(s):
    k = s.photos().groupBy("dest", "grp").agg((F.min("t") - 600).alias("lo"), (F.min("t") + 7200).alias("hi"))
    return asof.within(k, s.track()).groupBy("dest", "grp").agg(F.count("*").alias("points"), F.min("idx").alias("least"), F.max("idx").alias("most"))


@query(with_("photos") + "SELECT dest, grp, min(t) AS first_t, max(t) AS last_t FROM photos GROUP BY dest, grp")
def bucket_minmax_a11(s):
    return s.photos().groupBy("dest", "grp").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))


# --- space -----------------------------------------------------------------------------------

_NEAR = with_("track", "photos") + f""", f AS (SELECT * FROM photos WHERE native),
m AS (SELECT f.path, f.t, {hav('f.lat', 'f.lon', 'k.lat', 'k.lon')} AS metres, k.t AS pt, k.file, k.idx FROM f JOIN track k ON abs(k.t - f.t) <= 172800 AND abs(k.lat - f.lat) < 0.001),
near AS (SELECT path, t, first(metres ORDER BY metres, pt, file, idx) AS metres, first(pt ORDER BY metres, pt, file, idx) - t AS offset_s, first(idx ORDER BY metres, pt, file, idx) AS point FROM m WHERE metres <= 50 GROUP BY path, t)
"""


@query(_NEAR + "SELECT path, round(metres, 2) AS metres, offset_s, point FROM near")
def nearest_point_j5(s):
    return spatial.nearest_point(s.photos().where("native"), s.track())


@query(_NEAR + f"SELECT f.path, CASE WHEN EXISTS (SELECT 1 FROM track k WHERE abs(k.lat - f.lat) < 0.001 AND {hav('f.lat', 'f.lon', 'k.lat', 'k.lon')} <= 50) THEN 'outside_time_window' ELSE 'no_nearby_track' END AS reason FROM f WHERE f.path NOT IN (SELECT path FROM near)")
def skip_reason_j22(s):
    frames, track = s.photos().where("native"), s.track()
    return spatial.skip_reason(frames, track, spatial.nearest_point(frames, track))


def _found(s):
    """Every native frame's nearest point, or else its nearest segment: a row for each path and time."""
    frames, track = s.photos().where("native"), s.track()
    near = settled(s.spark, lambda: spatial.nearest_point(frames, track, staged=True).select("path", "metres", "offset_s", F.lit("point").alias("kind")))
    far = spatial.nearest_segment(frames.join(near.select("path"), "path", "left_anti"), track, reach=200, staged=True).select("path", "metres", "offset_s", F.lit("segment").alias("kind"))
    return near.union(far)


def _candidates(s):
    return _found(s).join(s.photos().select("path", "grp"), "path").select("grp", "path", "kind", "metres", "offset_s")


_SEGMENT = f""", s AS (SELECT * FROM (SELECT t AS at_, file, idx, lat AS alat, lon AS alon, lead(t) OVER w AS bt, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon FROM track WINDOW w AS (ORDER BY t, file, idx)) WHERE bt - at_ BETWEEN 1 AND 1800),
xy AS (SELECT f.path, f.t, s.*, radians(blon - alon) * cos(radians(alat)) * 6371000.0 AS bx, radians(blat - alat) * 6371000.0 AS b_y, radians(f.lon - alon) * cos(radians(alat)) * 6371000.0 AS px, radians(f.lat - alat) * 6371000.0 AS py
  FROM f JOIN s ON s.at_ BETWEEN f.t - 174600 AND f.t + 172800 WHERE f.path NOT IN (SELECT path FROM near)),
sh AS (SELECT *, CASE WHEN bx * bx + b_y * b_y = 0 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * bx + py * b_y) / (bx * bx + b_y * b_y))) END AS share FROM xy),
d AS (SELECT *, sqrt(power(px - share * bx, 2) + power(py - share * b_y, 2)) AS metres, at_ + share * (bt - at_) AS at_frame FROM sh),
best AS (SELECT * FROM d WHERE metres <= 200 AND abs(at_frame - t) <= 172800 QUALIFY row_number() OVER (PARTITION BY path, t ORDER BY metres, at_, file, idx) = 1)
"""
_CANDS = _NEAR + _SEGMENT + """, cand AS (SELECT grp, path, 'point' AS kind, round(metres, 2) AS metres, offset_s FROM near JOIN (SELECT path, grp FROM photos) USING (path)
  UNION ALL SELECT grp, path, 'segment', round(metres, 2), round_even(at_frame - t, 0)::BIGINT FROM best JOIN (SELECT path, grp FROM photos) USING (path)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY kind <> 'point', metres, path) AS rank FROM cand)
"""
_LEADERS = _CANDS.replace("WITH ", "WITH RECURSIVE ", 1) + """, step(grp, rank, leads, sizes, points) AS (
  SELECT grp, rank, [offset_s], [1], [CASE WHEN kind = 'point' THEN 1 ELSE 0 END] FROM ranked WHERE rank = 1
  UNION ALL
  SELECT n.grp, n.rank, CASE WHEN n.at IS NULL THEN list_append(leads, offset_s) ELSE leads END,
    CASE WHEN n.at IS NULL THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda x, i: x + CASE WHEN i = n.at THEN 1 ELSE 0 END) END,
    CASE WHEN n.at IS NULL THEN list_append(points, is_point) ELSE list_transform(points, lambda x, i: x + CASE WHEN i = n.at THEN is_point ELSE 0 END) END
  FROM (SELECT r.grp, r.rank, s.leads, s.sizes, s.points, r.offset_s, CASE WHEN r.kind = 'point' THEN 1 ELSE 0 END AS is_point,
      list_position(list_transform(s.leads, lambda x: abs(x - r.offset_s) <= 120), true) AS at
    FROM step s JOIN ranked r ON r.grp = s.grp AND r.rank = s.rank + 1) n),
done AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank DESC) = 1),
clusters AS (SELECT grp, unnest(leads) AS offset_s, unnest(sizes) AS members, unnest(points) AS points, unnest(range(len(leads))) AS cluster FROM done),
won AS (SELECT *, sum(members) OVER (PARTITION BY grp) AS total FROM clusters QUALIFY row_number() OVER (PARTITION BY grp ORDER BY members DESC, cluster) = 1)
"""


@query(_CANDS + "SELECT grp, path, kind, rank, 'anchor-' || lpad(rank::VARCHAR, greatest(3, length(rank::VARCHAR))::INT, '0') AS anchor FROM ranked")
def anchor_rank_w5(s):
    return cluster.anchors(_candidates(s)).select("grp", "path", "kind", F.col("rank").cast("long").alias("rank"), "anchor")


@query(_LEADERS + """SELECT grp, offset_s, members::BIGINT AS members, (total - members)::BIGINT AS conflicts,
  CASE WHEN total > members THEN 'review_required' WHEN members > 1 OR points > 0 THEN 'high' ELSE 'medium' END AS confidence FROM won""")
def consensus_cluster_a13(s):
    return cluster.consensus(_candidates(s)).drop("lead")


@query(_LEADERS + "SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY members DESC, offset_s) AS position, offset_s, members::BIGINT AS members FROM clusters")
def cluster_order_o5(s):
    order = Window.partitionBy("grp").orderBy(F.desc("members"), "offset_s")
    return cluster.clusters(_candidates(s)).select("grp", F.row_number().over(order).cast("long").alias("position"), "offset_s", "members")


@query(with_("track") + f", w AS (SELECT idx, lat, lon, lead(lat) OVER o AS lat2, lead(lon) OVER o AS lon2 FROM track WINDOW o AS (ORDER BY t, file, idx)) SELECT idx, round({hav('lat', 'lon', 'lat2', 'lon2')}, 3) AS metres FROM w WHERE lat2 IS NOT NULL")
def haversine_x1(s):
    g = spatial.segments(s.track())
    return g.select(F.col("a.idx").alias("idx"), F.round(scalar.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 3).alias("metres"))


_E = "embedding[{}]::DOUBLE"


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS ax, embedding[4]::DOUBLE AS ay, embedding[5]::DOUBLE AS bx, embedding[6]::DOUBLE AS b_y FROM embeddings),
u AS (SELECT *, greatest(0.0, least(1.0, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS share FROM v)
SELECT vec_id, round(share, 6) AS share, round(sqrt(power(px - (ax + share * (bx - ax)), 2) + power(py - (ay + share * (b_y - ay)), 2)), 6) AS distance FROM u""")
def point_segment_x3(s):
    x = [F.col("embedding")[i].cast("double") for i in range(6)]
    d, share = scalar.point_segment(*x)
    return s.embeddings.select("vec_id", F.round(share, 6).alias("share"), F.round(d, 6).alias("distance"))


# --- hierarchy -------------------------------------------------------------------------------

_DESTS = with_("photos") + """, d AS (SELECT DISTINCT dest AS path FROM photos),
a AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS up FROM d),
nodes AS (SELECT DISTINCT up AS path FROM a)"""
_OWN = """, own AS (SELECT path, 'tz-' || path AS value FROM nodes WHERE path IN ('root', 'root/c1', 'root/c2/s2', 'root/c3/s3'))"""
_OWN_PATHS = ("root", "root/c1", "root/c2/s2", "root/c3/s3")


def _dests(s):
    return hierarchy.expand(s.photos().select(F.col("dest").alias("path")).distinct())


def _own(nodes):
    return nodes.where(F.col("path").isin(*_OWN_PATHS)).withColumn("value", F.concat(F.lit("tz-"), "path"))


@query(_DESTS + "SELECT path FROM nodes")
def set_union_u1(s):
    return _dests(s)


@query(_DESTS + "SELECT path, len(string_split(path, '/')) AS depth, row_number() OVER (ORDER BY len(string_split(path, '/')), path) AS position FROM nodes")
def parent_first_o3(s):
    depth = F.size(F.split("path", "/")).cast("long")
    # A tree of folders, not of files: one ordered list by contract.
    return _dests(s).select("path", depth.alias("depth"), F.row_number().over(Window.orderBy(depth, "path")).cast("long").alias("position"))


_UP = _DESTS + _OWN + """, c AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + {}), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS up FROM nodes),
m AS (SELECT c.path, max_by(value, len(up)) AS value, max_by(up, len(up)) AS inherited_from FROM c JOIN own ON own.path = up GROUP BY c.path)
SELECT nodes.path, value, inherited_from FROM nodes LEFT JOIN m USING (path)"""


@query(_UP.format(1))
def ancestor_inherit_j10(s):
    nodes = _dests(s)
    return hierarchy.inherit(nodes, _own(nodes))


@query(_UP.format(0))
def fallback_inherit_f16(s):
    nodes = _dests(s)
    return hierarchy.inherit(nodes, _own(nodes), proper=True)


@query("SELECT DISTINCT split_part(url, '?', 1) AS path, len(string_split(split_part(url, '?', 1), '/')) - 1 AS n_up FROM pages WHERE url IS NOT NULL")
def ancestors_x24(s):
    path = F.substring_index("url", "?", 1)
    return s.pages.where("url is not null").select(path.alias("path")).distinct().select("path", F.size(scalar.ancestors(F.col("path"))).cast("long").alias("n_up"))


# --- times -----------------------------------------------------------------------------------

_CELLS = """, cells AS (SELECT grp, NULL AS day, CASE WHEN grp < 4 THEN grp * 1800 - 3600 END AS off FROM (SELECT DISTINCT grp FROM photos)
  UNION ALL SELECT DISTINCT grp, naive // 86400, CASE WHEN naive // 86400 % 5 = 0 THEN NULL ELSE grp * 60 END FROM photos WHERE naive // 86400 % 3 = 0),
r AS (SELECT p.path, p.grp, p.naive, d.grp IS NOT NULL AS dated, CASE WHEN d.grp IS NOT NULL THEN d.off ELSE g.off END AS off
  FROM photos p LEFT JOIN cells d ON d.grp = p.grp AND d.day = p.naive // 86400 LEFT JOIN cells g ON g.grp = p.grp AND g.day IS NULL)"""


def _offsets(s):
    p = s.photos().withColumn("day", F.floor(F.col("naive") / 86400))
    dated = p.where("day % 3 = 0").select("grp", "day").distinct().select("grp", "day", F.expr("CASE WHEN day % 5 <> 0 THEN grp * 60 END").alias("d_off"), F.lit(True).alias("dated"))
    plain = p.select("grp").distinct().select("grp", F.expr("CASE WHEN grp < 4 THEN grp * 1800 - 3600 END").alias("g_off"))
    # The dated cell decides when it exists, even if it is empty.
    return p.join(dated, ["grp", "day"], "left").join(plain, "grp").withColumn("off", F.when(F.col("dated"), F.col("d_off")).otherwise(F.col("g_off")))


@query(with_("photos") + _CELLS + "SELECT path, naive + off AS utc, off AS utc_offset, CASE WHEN off IS NULL THEN 'offset_missing' ELSE 'resolved' END AS status, CASE WHEN dated THEN 'dated' ELSE 'group' END AS rule FROM r")
def resolved_utc_j14(s):
    return _offsets(s).select("path", (F.col("naive") + F.col("off")).alias("utc"), F.col("off").alias("utc_offset"), F.when(F.col("off").isNull(), "offset_missing").otherwise("resolved").alias("status"), F.when(F.col("dated"), "dated").otherwise("group").alias("rule"))


@query(with_("photos") + _CELLS + ", o AS (SELECT 1 AS grp, 77 AS over UNION ALL SELECT 5, 88) SELECT path, coalesce(over, off) AS utc_offset, CASE WHEN over IS NULL THEN 'cell' ELSE 'drift' END AS source FROM r LEFT JOIN o USING (grp)")
def drift_override_j15(s):
    over = s.spark.sql("SELECT * FROM VALUES (1L, 77L), (5L, 88L) AS o(grp, over)")
    return _offsets(s).join(F.broadcast(over), "grp", "left").select("path", F.coalesce("over", "off").alias("utc_offset"), F.when(F.col("over").isNull(), "cell").otherwise("drift").alias("source"))


@query(with_("photos") + "SELECT grp, count(*) AS n, count(DISTINCT dest) AS dests, count(*) FILTER (native) AS with_gps, min(naive) AS first_naive, max(naive) AS last_naive FROM photos GROUP BY grp")
def camera_groups_a2(s):
    return s.photos().groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("dest").alias("dests"), F.count_if("native").alias("with_gps"), F.min("naive").alias("first_naive"), F.max("naive").alias("last_naive"))


@query(with_("photos") + "SELECT dest, count(*) AS n, count(DISTINCT grp) AS groups, sum(CASE WHEN native THEN 0 ELSE 1 END)::BIGINT AS without_gps FROM photos GROUP BY dest")
def dest_facts_a3(s):
    return s.photos().groupBy("dest").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"), F.count_if(~F.col("native")).alias("without_gps"))


@query(with_("photos") + "SELECT DISTINCT grp, CASE WHEN grp IN (0, 1) THEN 'phone' WHEN grp IN (1, 2, 3) THEN 'camera' ELSE 'unknown' END AS device FROM photos")
def device_class_f11(s):
    return s.photos().select("grp").distinct().select("grp", F.when(F.col("grp").isin(0, 1), "phone").when(F.col("grp").isin(1, 2, 3), "camera").otherwise("unknown").alias("device"))


@query(with_("photos") + "SELECT dest, grp, count(DISTINCT naive // 86400) AS days, min(naive) AS least FROM photos GROUP BY dest, grp HAVING count(DISTINCT naive // 86400) > 1")
def date_buckets_a14(s):
    return s.photos().groupBy("dest", "grp").agg(F.count_distinct(F.floor(F.col("naive") / 86400)).alias("days"), F.min("naive").alias("least")).where("days > 1")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def naive_parse_x7(s):
    text = F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit(".25"))
    return s.events.select("event_id", F.date_format(scalar.naive_time(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT event_id, CASE WHEN user_id % 4 = 3 THEN NULL ELSE (CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) * ((user_id % 12) * 3600 + 1800) END AS off FROM events")
def iso_offset_x10(s):
    text = F.expr("CASE WHEN user_id % 4 = 3 THEN '+0230' ELSE concat(CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END, lpad(cast(user_id % 12 AS STRING), 2, '0'), ':30:59') END")
    return s.events.select("event_id", scalar.iso_offset(text).cast("long").alias("off"))


@query("SELECT event_id, strftime(timezone('UTC', timezone(CASE WHEN user_id % 2 = 0 THEN 'Europe/Brussels' ELSE 'Asia/Tokyo' END, date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def tz_to_utc_x11(s):
    zone = F.expr("CASE WHEN user_id % 2 = 0 THEN 'Europe/Brussels' ELSE 'Asia/Tokyo' END")
    return s.events.select("event_id", F.date_format(scalar.local_to_utc(F.col("ts"), zone), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("SELECT event_id, strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y-%m-%d--%H-%M-%S') AS stamp FROM events")
def local_stamp_x13(s):
    return s.events.select("event_id", scalar.utc_to_stamp(F.col("ts"), F.lit("Asia/Tokyo")).alias("stamp"))


# --- files -----------------------------------------------------------------------------------

_CLASS = "CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'jpg' THEN 'image' WHEN 'tif' THEN 'image' WHEN 'arw' THEN 'raw' WHEN 'mp4' THEN 'video' ELSE 'other' END"


@query(with_("files") + f"SELECT path, {_CLASS} AS class FROM files")
def scan_classify_f1(s):
    return s.files().select("path", scalar.media_class(F.col("path"), CLASSES).alias("class"))


@query(with_("files") + f", l AS (SELECT path AS base, path || CASE WHEN doc_id % 5 = 0 THEN '_original' ELSE '' END AS p FROM files) SELECT p AS path, base FROM l WHERE ends_with(p, '_original') AND {_CLASS.replace('path', 'base')} <> 'other'")
def leftover_split_f2(s):
    p = s.files().select(F.concat("path", F.when(F.col("doc_id") % 5 == 0, "_original").otherwise("")).alias("path"))
    base = F.regexp_extract("path", r"^(.*?)(_exiftool_tmp|_original)$", 1)
    return p.select("path", base.alias("base")).where((F.col("base") != "") & (scalar.media_class(F.col("base"), CLASSES) != "other"))


_REASON = "CASE WHEN c_size IS NULL THEN 'new' WHEN c_size <> size THEN 'size' WHEN engine <> 2 THEN 'engine' ELSE 'fresh' END"


def _cached(s):
    return s.files().join(s.cache(), "path", "left")


@query(with_("files", "cache") + "SELECT path, size, c_size, engine FROM files LEFT JOIN cache USING (path)")
def cache_left_join_j1(s):
    return _cached(s).select("path", "size", "c_size", "engine")


@query(with_("files", "cache") + "SELECT path, (c_size IS NOT DISTINCT FROM size AND c_fp IS NOT DISTINCT FROM fp AND engine IS NOT DISTINCT FROM 2) AS fresh FROM files LEFT JOIN cache USING (path)")
def freshness_gate_f8(s):
    return _cached(s).select("path", (F.col("c_size").eqNullSafe(F.col("size")) & F.col("c_fp").eqNullSafe(F.col("fp")) & F.col("engine").eqNullSafe(2)).alias("fresh"))


@query(with_("files", "cache") + f"SELECT path, {_REASON} AS reason FROM files LEFT JOIN cache USING (path)")
def rehash_reason_f10(s):
    return _cached(s).select("path", F.expr(_REASON).alias("reason"))


@query(with_("files", "cache") + f"SELECT {_REASON} AS reason, count(*) AS n, min(path) AS sample FROM files LEFT JOIN cache USING (path) GROUP BY 1")
def rehash_summary_a5(s):
    return _cached(s).groupBy(F.expr(_REASON).alias("reason")).agg(F.count("*").alias("n"), F.min("path").alias("sample"))


@query(with_("files", "cache") + "SELECT cache.path FROM cache ANTI JOIN (SELECT path FROM files WHERE doc_id % 13 <> 0) f USING (path)")
def ghost_prune_j2(s):
    return s.cache().join(s.files().where("doc_id % 13 <> 0"), "path", "left_anti").select("path")


_MOVES = """WITH o AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey % 2 = 1),
o1 AS (SELECT p_size, p_brand, min(p_partkey) AS k FROM o GROUP BY ALL HAVING count(*) = 1), n1 AS (SELECT p_size, p_brand, min(p_partkey) AS k FROM n GROUP BY ALL HAVING count(*) = 1),
m AS (SELECT p_size, p_brand, o1.k AS old_path, n1.k AS new_path FROM o1 JOIN n1 USING (p_size, p_brand))"""


def _moves(s):
    p = s.part.select(F.col("p_partkey").alias("path"), "p_size", "p_brand")
    return p, relational.bijective(p.where("path % 2 = 0"), p.where("path % 2 = 1"), ["p_size", "p_brand"])


@query(_MOVES + "SELECT p_size, p_brand, old_path, new_path FROM m")
def bijective_move_j3(s):
    return _moves(s)[1]


@query(_MOVES + "SELECT p_partkey AS path FROM n WHERE p_partkey NOT IN (SELECT new_path FROM m)")
def set_diff_u3(s):
    p, moved = _moves(s)
    return p.where("path % 2 = 1").join(moved.select(F.col("new_path").alias("path")), "path", "left_anti").select("path")


@query(with_("files") + "SELECT path, fp, first(path) OVER w AS retained, path = first(path) OVER w AS kept FROM files WINDOW w AS (PARTITION BY fp ORDER BY prio, path)")
def dedup_keep_first_w1(s):
    return relational.keep_first(s.files(), ["fp"], [F.col("prio"), F.col("path")]).select("path", "fp", "retained", "kept")


@query(with_("files") + f"SELECT fp, {_CLASS} AS class, count(*) AS n, min(path) AS least FROM files GROUP BY ALL HAVING count(*) > 1")
def content_groups_a1(s):
    return s.files().groupBy("fp", scalar.media_class(F.col("path"), CLASSES).alias("class")).agg(F.count("*").alias("n"), F.min("path").alias("least")).where("n > 1")


@query(with_("files") + "SELECT sum(size)::BIGINT AS bytes, count(*) AS n, count(DISTINCT prio) AS folders, min(path) AS least, max(path) AS most FROM files WHERE prio > 2")
def footprint_a9(s):
    return s.files().where("prio > 2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.count_distinct("prio").alias("folders"), F.min("path").alias("least"), F.max("path").alias("most"))


@query(with_("files") + "SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, min(path) AS sample FROM files GROUP BY 1")
def ext_sample_a10(s):
    return s.files().groupBy(scalar.extension(F.col("path")).alias("ext")).agg(F.min("path").alias("sample"))


@query(with_("files") + f"SELECT count(*) AS n, count(*) FILTER ({_CLASS} = 'image') AS images, count(*) FILTER ({_CLASS} = 'raw') AS raws, count(*) FILTER ({_CLASS} = 'video') AS videos, count(DISTINCT fp) AS contents FROM files")
def run_report_a4(s):
    c = scalar.media_class(F.col("path"), CLASSES)
    return s.files().agg(F.count("*").alias("n"), F.count_if(c == "image").alias("images"), F.count_if(c == "raw").alias("raws"), F.count_if(c == "video").alias("videos"), F.count_distinct("fp").alias("contents"))


@query(with_("files", "cache") + ", d AS (SELECT path, size AS c_size, fp AS c_fp, 3 AS engine FROM files WHERE doc_id % 5 = 0) SELECT * FROM d UNION ALL SELECT path, c_size, c_fp, engine FROM cache ANTI JOIN d USING (path)")
def upsert_k3(s):
    delta = s.files().where("doc_id % 5 = 0").selectExpr("path", "size AS c_size", "fp AS c_fp", "3 AS engine")
    return relational.upsert(s.cache(), delta, "path")


@query(with_("files", "cache") + ", d AS (SELECT path, size AS c_size, fp AS c_fp, 3 AS engine FROM files WHERE doc_id % 5 = 0) SELECT path, c_size, c_fp, engine FROM cache UNION ALL SELECT * FROM d ANTI JOIN cache USING (path)")
def first_write_wins_k6(s):
    delta = s.files().where("doc_id % 5 = 0").selectExpr("path", "size AS c_size", "fp AS c_fp", "3 AS engine")
    return relational.first_write_wins(s.cache(), delta, "path")


@query(with_("files", "cache") + ", w AS (SELECT path AS dep, c_size AS was FROM cache), n AS (SELECT path AS dep, size AS now FROM files WHERE doc_id % 13 <> 0) SELECT coalesce(w.dep, n.dep) AS dep, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS reason FROM w FULL JOIN n ON w.dep = n.dep WHERE was IS DISTINCT FROM now")
def staleness_j18(s):
    return relational.stale(s.cache().selectExpr("path AS dep", "c_size AS fp"), s.files().where("doc_id % 13 <> 0").selectExpr("path AS dep", "size AS fp"))


@query(with_("files") + ", b AS (SELECT substr(sha256(path), 1, 2) AS b, sha256(string_agg(sha256(path || ' ' || fp), chr(10) ORDER BY sha256(path || ' ' || fp))) AS h FROM files GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint, count(*) AS buckets FROM b")
def index_fingerprint_a16(s):
    return relational.index_fingerprint(s.files(), F.col("path"), F.concat_ws(" ", "path", "fp"))


# --- names -----------------------------------------------------------------------------------

_STEM = "regexp_replace(name, '\\.[^.]*$', '')"


@query(with_("names") + f"SELECT p_partkey, regexp_replace({_STEM}, '-[0-9]{{3,}}$', '') AS root FROM names")
def suffix_root_x16(s):
    return s.names().select("p_partkey", scalar.suffix_root(F.regexp_replace("name", r"\.[^.]*$", "")).alias("root"))


@query(with_("names") + f"SELECT dir, lower(regexp_replace({_STEM}, '-[0-9]{{3,}}$', '')) AS root, max(coalesce(nullif(regexp_extract({_STEM}, '-([0-9]{{3,}})$', 1), '')::INT, 0)) AS top FROM names GROUP BY ALL")
def max_suffix_a19(s):
    return naming.max_suffix(s.names())


#: Incoming files want their brand's name; the library holds the files of names() whose key is even.
@query(with_("names") + f""", lib AS (SELECT DISTINCT dir, lower(regexp_replace({_STEM}, '-[0-9]{{3,}}$', '')) AS root, coalesce(nullif(regexp_extract({_STEM}, '-([0-9]{{3,}})$', 1), '')::INT, 0) AS slot FROM names WHERE p_partkey % 2 = 0),
i AS (SELECT 'd' || (p_size % 7) AS dir, p_partkey AS path, p_brand AS base, row_number() OVER (PARTITION BY p_size % 7, p_brand ORDER BY p_partkey) AS r FROM part),
free AS (SELECT dir, root, slot, row_number() OVER (PARTITION BY dir, root ORDER BY slot) AS r FROM (SELECT dir, lower(base) AS root, unnest(range(0, count(*) + 60)) AS slot FROM i GROUP BY 1, 2) ANTI JOIN lib USING (dir, root, slot))
SELECT i.dir, path, base || CASE WHEN slot = 0 THEN '' ELSE '-' || lpad(slot::VARCHAR, greatest(3, length(slot::VARCHAR))::INT, '0') END || '.jpg' AS name FROM i JOIN free f ON f.dir = i.dir AND f.root = lower(base) AND f.r = i.r""")
def suffix_alloc_w2(s):
    i = s.part.selectExpr("concat('d', p_size % 7) AS dir", "lpad(cast(p_partkey AS STRING), 12, '0') AS path", "p_brand AS base", "'jpg' AS ext")
    return naming.allocate_names(i, s.names().where("p_partkey % 2 = 0").select("dir", "name")).select("dir", F.col("path").cast("long").alias("path"), "name")


@query("SELECT p_partkey, coalesce(nullif(concat_ws('|', trim(p_brand), trim(p_type), CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END), ''), 'unknown') AS camera FROM part")
def camera_key_x17(s):
    return s.part.select("p_partkey", scalar.camera_key(F.col("p_brand"), F.col("p_type"), F.expr("CASE WHEN p_size % 2 = 0 THEN cast(p_size AS STRING) END")).alias("camera"))


# --- plans, journals, logs -------------------------------------------------------------------

_TYPES = {"A": "move", "N": "rename", "R": "quarantine"}


@query("SELECT l_orderkey % 100 AS dest, count(*) FILTER (l_returnflag = 'A') AS move, count(*) FILTER (l_returnflag = 'N') AS rename, count(*) FILTER (l_returnflag = 'R') AS quarantine FROM lineitem GROUP BY 1")
def op_counts_a7(s):
    return s.lineitem.groupBy((F.col("l_orderkey") % 100).alias("dest")).agg(*[F.count_if(F.col("l_returnflag") == k).alias(n) for k, n in _TYPES.items()])


@query("SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'total' ELSE l_returnflag END AS kind, count(*) AS n, min(l_orderkey) AS least FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def exec_totals_rollup_a8(s):
    r = s.lineitem.rollup("l_returnflag").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("least"), F.grouping("l_returnflag").alias("g"))
    return r.select(F.when(F.col("g") == 1, "total").otherwise(F.col("l_returnflag")).alias("kind"), "n", "least")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderkey % 3 = 0) USING (l_orderkey)")
def resume_anti_j27(s):
    journal = s.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return s.lineitem.join(journal, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, substr(sha256(l_returnflag || chr(10) || l_orderkey || chr(10) || l_linenumber), 1, 16) AS op_id FROM lineitem")
def op_id_x21(s):
    return s.lineitem.select("l_orderkey", "l_linenumber", scalar.op_id(F.col("l_returnflag"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("op_id"))


@query(with_("photos") + "SELECT path, 'write_time' AS op FROM photos UNION ALL SELECT path, 'write_gps' FROM photos WHERE NOT native UNION ALL SELECT path, 'rename' FROM photos WHERE grp <> 5")
def op_explode_x22(s):
    ops = F.array(F.lit("write_time"), F.when(~F.col("native"), F.lit("write_gps")), F.when(F.col("grp") != 5, F.lit("rename")))
    return s.photos().select("path", F.explode(F.filter(ops, lambda x: x.isNotNull())).alias("op"))


@query("WITH m AS (SELECT l_partkey AS path, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS delta FROM lineitem), h AS (SELECT path, seq, sum(delta) OVER (PARTITION BY path ORDER BY seq, delta ROWS UNBOUNDED PRECEDING)::BIGINT AS held FROM m) SELECT path, seq, held FROM h WHERE held > 1")
def clobber_sim_w8(s):
    moves = s.lineitem.selectExpr("l_partkey AS path", "l_orderkey * 10 + l_linenumber AS seq", "cast(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS BIGINT) AS delta")
    return relational.clobbers(moves)


@query("SELECT conv_id, count(*) AS steps, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS journey FROM conversations GROUP BY conv_id")
def journey_log_k12(s):
    steps = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return s.conversations.groupBy("conv_id").agg(F.count("*").alias("steps"), F.array_join(F.transform(steps, lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), ",").alias("journey"))


@query(with_("files", "cache") + "SELECT f.path, coalesce(c.c_fp, 'regenerated') AS decision FROM files f LEFT JOIN cache c ON c.path = f.path AND c.engine = 1")
def decision_carry_j19(s):
    prior = s.cache().where("engine = 1").select("path", "c_fp")
    return s.files().join(prior, "path", "left").select("path", F.coalesce("c_fp", F.lit("regenerated")).alias("decision"))


@query(with_("files") + ", e AS (SELECT path, 'accepted' AS edit FROM files WHERE doc_id % 17 = 0) SELECT path, coalesce(edit, 'pending') AS decision FROM files LEFT JOIN e USING (path)")
def apply_edits_j20(s):
    edits = s.files().where("doc_id % 17 = 0").select("path", F.lit("accepted").alias("edit"))
    return s.files().join(edits, "path", "left").select("path", F.coalesce("edit", F.lit("pending")).alias("decision"))


@query(with_("files", "cache") + "SELECT path, 'not_in_handoff' AS reason FROM files ANTI JOIN cache USING (path) UNION ALL SELECT path, 'not_on_disk' FROM cache ANTI JOIN (SELECT path FROM files WHERE doc_id % 13 <> 0) f USING (path)")
def reprep_pending_j4(s):
    new = s.files().join(s.cache(), "path", "left_anti").select("path", F.lit("not_in_handoff").alias("reason"))
    return new.union(s.cache().join(s.files().where("doc_id % 13 <> 0"), "path", "left_anti").select("path", F.lit("not_on_disk")))


@query(with_("photos", "track") + "SELECT grp, bool_or(native AND EXISTS (SELECT 1 FROM track k WHERE k.t = photos.t)) AS anchored FROM photos GROUP BY grp")
def anchor_exists_j21(s):
    times = s.track().select("t").distinct().withColumn("on_track", F.lit(True))
    return s.photos().join(times, "t", "left").groupBy("grp").agg(F.bool_or(F.col("native") & F.coalesce("on_track", F.lit(False))).alias("anchored"))


# --- segments, tracks as texts, and further scalars ------------------------------------------

_R = "6371000.0"


@query(_NEAR + f""", s AS (SELECT * FROM (SELECT t AS at_, file, idx, lat AS alat, lon AS alon, lead(t) OVER w AS bt, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon FROM track WINDOW w AS (ORDER BY t, file, idx)) WHERE bt - at_ BETWEEN 1 AND 1800),
xy AS (SELECT f.path, f.t, s.*, radians(blon - alon) * cos(radians(alat)) * {_R} AS bx, radians(blat - alat) * {_R} AS b_y, radians(f.lon - alon) * cos(radians(alat)) * {_R} AS px, radians(f.lat - alat) * {_R} AS py
  FROM f JOIN s ON s.at_ BETWEEN f.t - 174600 AND f.t + 172800 WHERE f.path NOT IN (SELECT path FROM near)),
sh AS (SELECT *, CASE WHEN bx * bx + b_y * b_y = 0 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * bx + py * b_y) / (bx * bx + b_y * b_y))) END AS share FROM xy),
d AS (SELECT *, sqrt(power(px - share * bx, 2) + power(py - share * b_y, 2)) AS metres, at_ + share * (bt - at_) AS at_frame FROM sh),
best AS (SELECT * FROM d WHERE metres <= 200 AND abs(at_frame - t) <= 172800 QUALIFY row_number() OVER (PARTITION BY path, t ORDER BY metres, at_, file, idx) = 1)
SELECT path, round(metres, 2) AS metres, round_even(at_frame - t, 0)::BIGINT AS offset_s, bt - at_ AS duration_s, idx AS point FROM best""")
def nearest_segment_j6(s):
    frames, track = s.photos().where("native"), s.track()
    left = frames.join(spatial.nearest_point(frames, track).select("path"), "path", "left_anti")
    return spatial.nearest_segment(left, track, reach=200)


#: Points of one text of the test tables (each text holds so many events, not a user's whole series).
_GPX_POINTS = 50


@query(f"""SELECT event_id // {_GPX_POINTS} AS file, (event_id % {_GPX_POINTS})::INT AS idx, floor(epoch(ts))::BIGINT - CASE WHEN event_id % 13 = 0 THEN 9000 ELSE 0 END AS t, user_id % 91 + 0.5 AS lat, value / 100 AS lon
FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND user_id % 91 + 0.5 <= 90 AND value / 100 <= 180""")
def gpx_points_s4(s):
    stamp = "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), CASE WHEN event_id % 13 = 0 THEN '+02:30' WHEN event_id % 11 = 0 THEN '.5Z' ELSE 'Z' END)"
    stamp = f"CASE WHEN event_id % 13 = 0 AND event_id % 11 = 0 THEN '2024-01-01T00:00:00' ELSE {stamp} END"
    point = f"concat('<trkpt lat=\"', user_id % 91 + 0.5, '\" lon=\"', value / 100, '\">', CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('<time> ', {stamp}, '</time>') END, '</trkpt>', CASE WHEN event_id % 5 = 0 THEN '</trkseg><trkseg>' ELSE '' END)"
    block = s.events.selectExpr(f"event_id div {_GPX_POINTS} AS file", "event_id", f"{point} AS point").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("event_id", "point"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["point"]), "")
    texts = block.select("file", F.concat(F.lit("<gpx><trk/><trk><trkseg>"), body, F.lit("</trkseg></trk></gpx>")).alias("text"))
    return gpx.parse(texts).select("file", "idx", F.unix_seconds("time_utc").alias("t"), "lat", "lon")


@query("SELECT event_id, round(CASE WHEN user_id % 3 = 0 THEN user_id ELSE value + (user_id - value) * (17 / (user_id % 3)::DOUBLE) END, 6) AS at_17 FROM events")
def extrapolate_x5(s):
    span = F.col("user_id") % 3
    return s.events.select("event_id", scalar.extrapolate(F.col("value"), F.col("user_id").cast("double"), F.lit(0).cast("long"), span, F.lit(17)).alias("at_17"))


@query("SELECT event_id, round_even((event_id % 19 - 9) / 2.0::DOUBLE, 0)::BIGINT AS offset_s FROM events")
def candidate_offset_x6(s):
    return s.events.select("event_id", scalar.whole_seconds((F.col("event_id") % 19 - 9) / F.lit(2.0)).alias("offset_s"))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS bucket FROM events")
def naive_date_x8(s):
    text = F.when(F.col("user_id") % 5 == 0, "0000:00:00 00:00:00").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return s.events.select("event_id", scalar.naive_date(text).alias("bucket"))


_ZONE = "CASE user_id % 3 WHEN 0 THEN 'Europe/Brussels' WHEN 1 THEN 'Asia/Kolkata' ELSE 'America/St_Johns' END"


@query(f"SELECT event_id, (epoch(timezone('UTC', timezone({_ZONE}, date_trunc('second', ts)))) - epoch(date_trunc('second', ts)))::BIGINT AS off FROM events")
def zone_offset_x12(s):
    return s.events.select("event_id", scalar.zone_offset(F.col("ts").cast("timestamp_ntz"), F.expr(_ZONE)).alias("off"))


@query(f"""WITH l AS (SELECT event_id, date_trunc('second', ts) AS utc, timezone({_ZONE}, timezone('UTC', date_trunc('second', ts))) AS local FROM events),
o AS (SELECT *, ((epoch(local) - epoch(utc)) / 60)::BIGINT AS m FROM l)
SELECT event_id, strftime(local, '%Y:%m:%d %H:%M:%S') AS local_time, CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad((abs(m) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(m) % 60)::VARCHAR, 2, '0') AS zone_text FROM o""")
def local_text_x14(s):
    text, offset = scalar.utc_to_text(F.col("ts").cast("timestamp_ntz"), F.expr(_ZONE))
    return s.events.select("event_id", text.alias("local_time"), offset.alias("zone_text"))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN user_id % 4 = 1 THEN NULL WHEN user_id % 4 = 2 THEN '2001-02-03 04:05:06' ELSE NULL END AS taken FROM events")
def file_time_x19(s):
    own = F.expr("CASE user_id % 4 WHEN 0 THEN date_format(ts, 'yyyy:MM:dd HH:mm:ss') WHEN 1 THEN 'unknown' END")
    created = F.expr("CASE WHEN user_id % 4 IN (1, 2) THEN '2001:02:03 04:05:06' END")
    return s.events.select("event_id", F.date_format(scalar.taken_at(own, created, F.lit(None).cast("string")), "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("SELECT event_id, coalesce(abs(user_id * 4000 - 100000) <= 86400, false) AS offset_ok, user_id * 2 - 50 BETWEEN -90 AND 90 AND value BETWEEN -180 AND 180 AS place_ok FROM events")
def validators_f7(s):
    return s.events.select("event_id", scalar.valid_offset(F.col("user_id") * 4000 - 100_000).alias("offset_ok"), scalar.valid_coordinates(F.col("user_id") * 2 - 50, F.col("value")).alias("place_ok"))


@query(with_("files") + "SELECT path, CASE prio WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS priority FROM files")
def dedup_priority_f6(s):
    return s.files().select("path", scalar.priority(F.col("path"), ["f3", "f1", "f0"]).cast("int").alias("priority"))


from . import queries_geotag, queries_prep, queries_scalar, queries_state  # they register their own
