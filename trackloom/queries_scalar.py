"""Queries of scalar rules, small filters, orders and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .adapters import with_
from .functions import rules, scalar
from .registry import query
from .sources import gpx

# --- times and places ------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE floor(epoch(ts))::BIGINT - CASE WHEN event_id % 4 = 1 THEN 7200 ELSE 0 END END AS t FROM events")
def iso_utc_x9(s):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\") WHEN 2 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") ELSE 'soon' END")
    return s.events.select("event_id", F.unix_seconds(rules.utc_of(text)).alias("t"))


@query(with_("track") + "SELECT idx, round(radians(lon - 4) * cos(radians(50.0::DOUBLE)) * 6371000.0, 4) AS x, round(radians(lat - 50) * 6371000.0, 4) AS y FROM track")
def equirect_x2(s):
    x, y = scalar.equirect(F.col("lat"), F.col("lon"), F.lit(50.0), F.lit(4.0))
    return s.track().select("idx", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("SELECT event_id, round(CASE WHEN user_id % 3 = 0 THEN value ELSE value + (user_id - value) * (2.5::DOUBLE / (user_id % 3)) END, 6) AS at FROM events")
def interpolate_x4(s):
    return s.events.select("event_id", F.round(scalar.interpolate(F.col("value"), F.col("user_id").cast("double"), F.lit(0), F.col("user_id") % 3, F.lit(2.5)), 6).alias("at"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN floor(epoch(ts))::BIGINT WHEN 1 THEN floor(epoch(ts))::BIGINT + 5400 ELSE NULL END AS t FROM events")
def gpx_time_x15(s):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'.500-01:30'\") WHEN 2 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'.5Z'\") ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") END")
    return s.events.select("event_id", F.unix_seconds(scalar.gpx_time(text)).alias("t"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def sha256_x20(s):
    return s.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT event_id, round((epoch(date_trunc('second', ts)) - 1700000000 + value) , 0)::BIGINT AS off FROM (SELECT event_id, ts, floor(value) + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 0.25 END AS value FROM events)")
def scrub_offset_x27(s):
    moved = F.floor("value") + F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(0.25)
    track_ms = (F.unix_seconds(F.col("ts").cast("timestamp")) + moved) * 1000
    return s.events.select("event_id", rules.scrub_offset(track_ms, F.lit(1_700_000_000_000)).alias("off"))


@query("SELECT event_id, epoch_ms(date_trunc('second', ts))::BIGINT AS naive_ms, CASE WHEN event_id % 2 = 0 THEN epoch_ms(date_trunc('minute', ts))::BIGINT END AS local_ms, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS field FROM events")
def editor_times_x28(s):
    ts = F.col("ts").cast("timestamp_ntz")
    naive = rules.naive_ms(F.date_format(ts, "yyyy:MM:dd HH:mm:ss"))
    local = rules.field_ms(F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm")).otherwise("x"))
    return s.events.select("event_id", naive.alias("naive_ms"), local.alias("local_ms"), rules.ms_field(naive).alias("field"))


@query("""SELECT event_id, CASE WHEN user_id % 9 = 0 THEN '—' ELSE CASE WHEN o < 0 THEN '−' ELSE '+' END || (abs(o) // 3600) || 'h ' || lpad((abs(o) % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((abs(o) % 60)::VARCHAR, 2, '0') || 's' END AS shown,
  day::VARCHAR || ' ' || ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][mon] || ' ' || yr AS day FROM (SELECT event_id, user_id, user_id * 977 - 20000 AS o, day(ts) AS day, month(ts) AS mon, year(ts) AS yr FROM events)""")
def editor_format_x29(s):
    o = F.when(F.col("user_id") % 9 != 0, F.col("user_id") * 977 - 20000)
    return s.events.select("event_id", rules.shown_offset(o).alias("shown"), rules.shown_date(F.date_format("ts", "yyyy-MM-dd")).alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 AND user_id - 50 <= 90 THEN (user_id - 50)::DOUBLE END AS lat, CASE WHEN event_id % 3 <> 2 AND user_id - 50 <= 90 THEN 4.5::DOUBLE END AS lon, event_id % 2 = 0 OR event_id % 3 = 0 AS whole FROM events")
def editor_pair_x30(s):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN concat(user_id - 50, ', 4.5') WHEN 1 THEN concat('  ', user_id - 50, '.0 , +4.50 ') ELSE 'here' END")
    lat, lon = rules.parse_pair(text)
    a = F.when(F.col("event_id") % 2 == 0, "1").otherwise("")
    b = F.when((F.col("event_id") % 2 == 0) | (F.col("event_id") % 3 != 0), F.lit("2"))
    b = F.when(F.col("event_id") % 2 != 0, F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("2"))).otherwise(b)
    return s.events.select("event_id", lat.alias("lat"), lon.alias("lon"), rules.both_or_neither(a, b).alias("whole"))


@query("""SELECT p.event_id, coalesce(s.idx, 0)::BIGINT AS idx FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_id % 50 = 0) p
LEFT JOIN (SELECT a.event_id, arg_min(b.idx, (abs(b.t - a.t), b.idx)) AS idx FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_id % 50 = 0) a
  JOIN (SELECT user_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events WHERE event_type = 'view') b USING (user_id) GROUP BY a.event_id) s USING (event_id)""")
def nearest_index_w10(s):
    """The track here is a user's views; a frame is every fiftieth event (the frames that an editor shows)."""
    e = s.events.withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    track = e.where("event_type = 'view'").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "t"))).alias("points"))
    frames = e.where("event_id % 50 = 0").join(track, "user_id", "left")
    return frames.select("event_id", rules.nearest_index(F.col("points"), F.col("t")).alias("idx"))


@query("SELECT DISTINCT 'd' || (o_custkey % 7) AS grp, o_orderkey AS item FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey % 7) AS n FROM orders) WHERE pos BETWEEN least(5, n) AND n // 2 + 3 OR pos = least(5, n)")
def contiguous_range_w13(s):
    """From the fifth item of each list to the middle one and three more, as a shifted click selects."""
    rows = s.orders.select(F.concat(F.lit("d"), F.col("o_custkey") % 7).alias("grp"), F.col("o_orderkey").alias("item"))
    listed = rows.groupBy("grp").agg(F.array_sort(F.collect_list("item")).alias("order"))
    n = F.size("order")
    anchor, target = F.element_at("order", F.least(F.lit(5), n)), F.element_at("order", F.least(n, F.floor(n / 2).cast("int") + 3))
    return listed.select("grp", F.explode(rules.contiguous(F.col("order"), anchor, target)).alias("item"))


@query(f"SELECT event_id // 50 AS file, event_id, (event_id % 50)::INT AS idx FROM events WHERE event_id % 7 <> 0 AND user_id % 91 + 0.5 <= 90")
def document_order_w6(s):
    """Points of a text keep their place in it, also when points before them are dropped."""
    point = "concat('<trkpt lat=\"', user_id % 91 + 0.5, '\" lon=\"', event_id / 1000000D, '\">', CASE WHEN event_id % 7 = 0 THEN '' ELSE '<time>2024-01-01T00:00:00Z</time>' END, '</trkpt>')"
    block = s.events.selectExpr("event_id div 50 AS file", "event_id", f"{point} AS point").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("event_id", "point"))).alias("p"))
    texts = block.select("file", F.concat(F.lit("<gpx><trk><trkseg>"), F.array_join(F.transform("p", lambda x: x["point"]), "</trkseg><trkseg>"), F.lit("</trkseg></trk></gpx>")).alias("text"))
    return gpx.parse(texts).select("file", F.round(F.col("lon") * 1_000_000).cast("long").alias("event_id"), "idx")


# --- paths, states, texts --------------------------------------------------------------------


@query(with_("inv") + "SELECT path, 'video under ' || top AS reason FROM inv WHERE top IN ('by-date', 'by-dest') AND class = 'video' UNION ALL SELECT path, class || ' under videos' FROM inv WHERE top = 'videos' AND class IN ('image', 'raw')")
def band_misplaced_f4(s):
    return rules.misplaced(s.rel("inv"), photo_bands=["by-date", "by-dest"], video_band="videos")


@query(with_("inv") + """, r(role, folder) AS (VALUES ('sources', 'sources'), ('photos_by_date', 'by-date'), ('photos_by_dest', 'by-dest'), ('videos', 'videos'), ('missing', 'missing'), ('jpgs', 'jpgs'))
SELECT coalesce(top, folder) AS folder, CASE WHEN role IS NULL THEN 'not managed' WHEN top IS NULL THEN 'missing' ELSE role END AS state FROM (SELECT DISTINCT top FROM inv) FULL JOIN r ON folder = top""")
def folder_roles_f5(s):
    roles = s.values("('sources', 'sources'), ('photos_by_date', 'by-date'), ('photos_by_dest', 'by-dest'), ('videos', 'videos'), ('missing', 'missing'), ('jpgs', 'jpgs')", "role, folder")
    return rules.folder_states(s.rel("inv"), roles)


@query("SELECT event_id, user_id % 4 IN (0, 1) AS zone_ok FROM events")
def zone_valid_f7(s):
    zone = F.expr("CASE user_id % 4 WHEN 0 THEN 'Europe/Brussels' WHEN 1 THEN 'Asia/Tokyo' WHEN 2 THEN 'Mars/Base' END")
    rows = s.events.select("event_id", zone.alias("zone"))
    return rows.join(F.broadcast(rules.zones(s.spark)).withColumn("ok", F.lit(True)), "zone", "left").select("event_id", F.coalesce("ok", F.lit(False)).alias("zone_ok"))


@query("""SELECT conv_id, turn, '{"a":{"keep":' || turn || ',"list":[{"x":1},2]},"role":"' || role || '"}' AS kept FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL""")
def volatile_keys_f19(s):
    rows = s.conversations.where("conv_id is not null and role is not null")
    text = F.format_string('{"run_metadata":{"a":1},"a":{"keep":%s,"diagnostics":[1],"list":[{"x":1,"cache_freshness":2},2]},"role":"%s"}', F.col("turn").cast("string"), F.col("role"))
    return rows.select("conv_id", "turn", rules.without_keys(text).alias("kept"))


@query(with_("ops", "results") + """, c AS (SELECT dest, count(*) FILTER (result = 'applied') AS applied, count(*) FILTER (result = 'skipped') AS skipped, count(*) FILTER (result = 'failed') AS failed, count(*) FILTER (result = 'mismatch') AS mismatch FROM ops JOIN results USING (op) GROUP BY dest)
SELECT dest, CASE WHEN failed + mismatch = 0 THEN 'success' WHEN mismatch > 0 OR applied > 0 OR skipped > 0 THEN 'partial' ELSE 'failed' END AS geotag, CASE WHEN failed = 0 THEN 'success' WHEN applied + skipped + mismatch > 0 THEN 'partial' ELSE 'failed' END AS merge FROM c""")
def terminal_status_f20(s):
    n = s.rel("ops").join(s.rel("results"), "op").groupBy("dest").agg(*[F.count_if(F.col("result") == k).alias(k) for k in ("applied", "skipped", "failed", "mismatch")])
    zero = F.lit(0)
    return n.select("dest", rules.geotag_status(F.col("applied"), F.col("skipped"), F.col("failed"), F.col("mismatch"), zero).alias("geotag"), rules.merge_status(F.col("applied") + F.col("skipped") + F.col("mismatch"), F.col("failed")).alias("merge"))


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS inside FROM pages")
def containment_f21(s):
    path = F.expr("CASE page_id % 6 WHEN 0 THEN concat('a/', page_id) WHEN 1 THEN concat('a/./b/../', page_id) WHEN 2 THEN concat('../', page_id) WHEN 3 THEN '/etc' WHEN 4 THEN 'a/../../b' ELSE '' END")
    return s.pages.select("page_id", rules.contained(path).alias("inside"))


_CONFIGS = "('a', 'gap', '1800'), ('a', 'speed', '-5'), ('a', 'zone', 'Mars/Base'), ('a', 'format', 'photo'), ('b', 'gap', 'x'), ('b', 'zone', ''), ('b', 'format', '%Y-%m-%d--%H-%M-%S'), ('b', 'gap', '60'), ('c', 'other', '1'), ('c', 'speed', '150'), ('c', 'flag', 'maybe')"


@query("""SELECT * FROM (VALUES ('a', 'speed', 'out of range'), ('a', 'zone', 'unknown zone'), ('a', 'format', 'does not vary'), ('b', 'gap', 'not a number'), ('b', 'gap', 'set twice'), ('c', 'other', 'unknown key'), ('c', 'flag', 'not a boolean')) AS v(config, key, problem)""")
def config_problems_f22(s):
    return rules.config_problems(s.values(_CONFIGS, "config, key, value"), {"gap": "seconds", "speed": "positive", "zone": "zone", "format": "strftime", "flag": "boolean"}, rules.zones(s.spark))


@query(with_("files", "cache") + "SELECT count(*) FILTER (c_size IS NULL OR c_size <> size) = 0 AND (SELECT count(*) FROM cache ANTI JOIN files USING (path)) = 0 AS nothing_to_do FROM files LEFT JOIN cache USING (path)")
def nothing_to_do_f28(s):
    return rules.nothing_to_do(s.files().select("path", "size"), s.cache().select("path", F.col("c_size").alias("size")))


_STATES = "SELECT o_orderkey AS cell, o_orderkey % 3 = 0 AS needs, o_orderkey % 4 = 0 AS stale, o_orderkey % 5 = 0 AS auto, o_orderkey % 2 = 0 AS fallback, CASE WHEN o_orderkey % 7 < 4 THEN 'x' END AS effective FROM {orders}"


@query(f"WITH c AS ({_STATES.replace('{orders}', 'orders')}) SELECT cell, CASE WHEN needs THEN 'needs' WHEN stale THEN 'stale' WHEN auto THEN 'auto' WHEN fallback AND effective IS NULL THEN 'none' ELSE 'ok' END AS status FROM c")
def cell_status_f29(s):
    c = s.spark.sql(_STATES, orders=s.orders)
    return c.select("cell", rules.cell_status(F.col("needs"), F.col("stale"), F.col("auto"), F.col("fallback"), F.col("effective")).alias("status"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS sealed, c_custkey % 3 = 0 AS library, CASE WHEN c_custkey % 5 = 0 THEN 'reader,hasher' WHEN c_custkey % 5 = 1 THEN 'hasher' ELSE '' END AS missing FROM customer")
def lifecycle_f32(s):
    marks = F.expr("filter(array(CASE WHEN c_custkey % 2 = 0 THEN 'sealed' END, CASE WHEN c_custkey % 3 = 0 THEN 'library' END, 'other'), x -> x IS NOT NULL)")
    tools = F.expr("filter(array(CASE WHEN c_custkey % 5 <> 0 THEN 'reader' END, CASE WHEN c_custkey % 5 > 1 THEN 'hasher' END), x -> x IS NOT NULL)")
    sealed, library, missing = rules.lifecycle(marks, tools, ["reader", "hasher"])
    return s.customer.select("c_custkey", sealed.alias("sealed"), library.alias("library"), missing.alias("missing"))


@query("""WITH w AS (SELECT c_custkey AS ws, c_custkey % 2 = 0 AS sealed, c_custkey % 3 <> 0 AS initialised, c_custkey % 5 = 0 AS stale, c_custkey % 7 = 0 AS busy, c_custkey % 11 <> 0 AS planned FROM customer)
SELECT ws, c.command, CASE WHEN busy THEN 'a job is running' WHEN sealed THEN 'sealed' WHEN c.command <> 'prep' AND NOT initialised THEN 'not initialised' WHEN c.command = 'execute' AND NOT planned THEN 'no plan' WHEN c.command = 'execute' AND stale THEN 'stale plan' END AS blocked_by FROM w, (VALUES ('prep'), ('plan'), ('execute')) AS c(command)""")
def affordances_f27(s):
    w = s.customer.selectExpr("c_custkey AS ws", "c_custkey % 2 = 0 AS sealed", "c_custkey % 3 <> 0 AS initialised", "c_custkey % 5 = 0 AS stale", "c_custkey % 7 = 0 AS busy", "c_custkey % 11 <> 0 AS planned")
    return rules.affordances(w)


@query("SELECT strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || event_id AS plan_id, floor(epoch(ts))::BIGINT AS t, ts < TIMESTAMP '2024-01-15' AS old FROM events UNION ALL SELECT 'plan-' || event_id, NULL, false FROM events WHERE event_id % 10 = 0")
def plan_age_x25(s):
    ids = s.events.select(F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.col("event_id").cast("string")).alias("plan_id"))
    ids = ids.union(s.events.where("event_id % 10 = 0").select(F.concat(F.lit("plan-"), F.col("event_id").cast("string"))))
    t = rules.plan_time(F.col("plan_id"))
    return ids.select("plan_id", F.unix_seconds(t).alias("t"), F.coalesce(t < F.lit("2024-01-15 00:00:00").cast("timestamp"), F.lit(False)).alias("old"))


@query("""SELECT event_id, user_id % 3 <> 0 AND event_id % 2 = 0 AS present, CASE WHEN user_id % 3 <> 0 AND event_id % 2 = 0 THEN user_id::VARCHAR ELSE '' END AS lat_tag, CASE WHEN user_id % 3 <> 0 AND event_id % 2 = 0 THEN value::VARCHAR ELSE '' END AS lon_tag,
  CASE WHEN user_id % 3 <> 0 AND event_id % 2 = 0 AND event_id % 4 = 0 THEN 'receiver' ELSE '' END AS method_tag FROM (SELECT event_id, user_id, floor(value)::BIGINT AS value FROM events)""")
def revert_tags_x23_x26(s):
    lat, lon = F.expr("CASE WHEN user_id % 3 <> 0 THEN user_id END"), F.expr("CASE WHEN event_id % 2 = 0 THEN floor(value) END")
    pre = rules.pre_state(lat, lon, F.expr("CASE WHEN event_id % 4 = 0 THEN 'receiver' END"))
    rows = s.events.select("event_id", pre.alias("pre"))
    tags = rules.revert_tags(F.col("pre"))
    return rows.select("event_id", F.col("pre.present").alias("present"), tags["GPSLatitude"].alias("lat_tag"), tags["GPSLongitude"].alias("lon_tag"), tags["GPSProcessingMethod"].alias("method_tag"))


@query("SELECT event_id, '{\"type\":\"' || event_type || '\",\"n\":' || user_id || ',\"done\":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS line FROM events")
def event_line_x33(s):
    return s.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("n"), (F.col("event_id") % 2 == 0).alias("done"))).alias("line"))


# --- sets and orders -------------------------------------------------------------------------


@query(with_("inv", "rows") + "SELECT fp, bool_or(src = 'now') AS now, bool_or(src = 'then') AS earlier FROM (SELECT fp, 'now' AS src FROM inv UNION ALL SELECT fp, 'then' FROM rows UNION ALL SELECT md_fp, 'meta' FROM rows UNION ALL SELECT fp, 'lib' FROM inv WHERE top = 'by-dest') WHERE fp IS NOT NULL GROUP BY fp")
def union_of_keys_u2(s):
    now, rows = s.rel("inv"), s.rel("rows")
    keys = now.select("fp", F.lit("now").alias("src")).union(rows.select("fp", F.lit("then"))).union(rows.select("md_fp", F.lit("meta"))).union(now.where("top = 'by-dest'").select("fp", F.lit("lib")))
    return keys.where("fp is not null").groupBy("fp").agg(F.bool_or(F.col("src") == "now").alias("now"), F.bool_or(F.col("src") == "then").alias("earlier"))


@query(with_("inv") + "SELECT path, false AS fixed FROM inv WHERE top <> 'by-dest' UNION ALL SELECT path, true FROM inv WHERE top = 'by-dest'")
def concat_u4(s):
    inv = s.rel("inv")
    return inv.where("top <> 'by-dest'").select("path", F.lit(False).alias("fixed")).unionByName(inv.where("top = 'by-dest'").select("path", F.lit(True).alias("fixed")))


@query(with_("names") + "SELECT dir, lower(name) AS name FROM names UNION SELECT 'd' || (p_size % 7), lower(p_brand || '.JPG') FROM part")
def occupied_u5(s):
    incoming = s.part.selectExpr("concat('d', p_size % 7) AS dir", "concat(p_brand, '.JPG') AS name")
    return s.names().select("dir", "name").union(incoming).select("dir", F.lower("name").alias("name")).distinct()


@query("SELECT p_type AS kind, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT DISTINCT p_type, p_brand AS k FROM part UNION SELECT p_type, 'Brand#known' FROM part) GROUP BY p_type")
def merge_keys_u7(s):
    found = s.part.groupBy("p_type").agg(F.collect_set("p_brand").alias("found"))
    return found.select(F.col("p_type").alias("kind"), F.array_join(F.array_sort(F.array_union(F.array(F.lit("Brand#known")), F.col("found"))), ",").alias("keys"))


@query(with_("track") + "SELECT row_number() OVER (ORDER BY t, file, idx) AS position, idx FROM track")
def track_order_o1(s):
    """The place of every point in the series: its place in its bucket and the rows of the buckets before."""
    from .operators.asof import bucketed

    rows = bucketed(s.track(), s.track().select("t"))
    before = rows.groupBy("bucket").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = rows.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("t", "file", "idx"))).join(before, "bucket")
    return place.select((F.col("r") + F.col("before")).alias("position"), "idx")


@query(with_("inv") + "SELECT reason, path FROM (SELECT class AS reason, path, row_number() OVER (PARTITION BY class ORDER BY path) AS r FROM inv) WHERE r <= 5")
def first_examples_o7(s):
    """The first five of each class."""
    return rules.first_examples(s.rel("inv").select(F.col("class").alias("reason"), "path"), "reason", "path", 5)


@query(with_("inv") + "SELECT path, size FROM inv WHERE size > 0 ORDER BY size DESC, path LIMIT 20")
def top_sizes_o6(s):
    """A report of the twenty largest files."""
    return s.rel("inv").where("size > 0").orderBy(F.desc("size"), "path").limit(20).select("path", "size")


@query(with_("inv") + "SELECT path FROM inv ORDER BY path")
def sorted_output_o2(s):
    return s.rel("inv").select("path").orderBy("path")
