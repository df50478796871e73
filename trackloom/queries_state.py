"""Queries of sources, of state that runs write, and of the merge plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sinks
from .adapters import CLASSES, with_
from .functions import scalar
from .operators import naming, relational
from .plans import gates, merge
from .registry import query
from .session import cut, folder
from .sources import gpx, workspace

# --- the merge plan --------------------------------------------------------------------------

_FINAL = with_("handoff", "renames", "library") + """, entries AS (SELECT h.fp, regexp_replace(h.folder, '^[^/]*/?', '') AS lib_dest, coalesce(new_name, string_split(path, '/')[-1]) AS name, folder || '/' || coalesce(new_name, string_split(path, '/')[-1]) || '#' || doc_id AS path FROM handoff h LEFT JOIN renames r ON r.fp = h.fp)"""
#: The sequential rule, an entry at a time in the order of paths: what a name's entries before have claimed decides.
_MERGE = _FINAL.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT e.*, row_number() OVER (PARTITION BY e.lib_dest, lower(e.name) ORDER BY path) AS turn, l.name IS NOT NULL AS there, l.fp AS lib_fp, l.readable, EXISTS (SELECT 1 FROM library x WHERE x.lib_dest = e.lib_dest AND lower(x.name) = lower(e.name)) AS clash
  FROM entries e LEFT JOIN library l ON l.lib_dest = e.lib_dest AND l.name = e.name),
walk AS (SELECT lib_dest, lower(name) AS low, 0::BIGINT AS turn, bool_or(clash) AS claimed, NULL::VARCHAR AS path, NULL::VARCHAR AS outcome, NULL::VARCHAR AS collision FROM n GROUP BY 1, 2
  UNION ALL SELECT w.lib_dest, w.low, n.turn, w.claimed OR (NOT n.there) OR coalesce(n.lib_fp = n.fp, false), n.path,
    CASE WHEN n.there THEN CASE WHEN NOT n.readable THEN 'blocked' WHEN n.lib_fp = n.fp THEN 'already_present' ELSE 'renamed_incoming' END WHEN w.claimed THEN 'renamed_incoming' ELSE 'placed_new' END,
    CASE WHEN n.there THEN CASE WHEN NOT n.readable THEN 'unreadable' WHEN n.lib_fp = n.fp THEN NULL ELSE 'content' END WHEN w.claimed THEN 'case' END FROM walk w JOIN n ON n.lib_dest = w.lib_dest AND lower(n.name) = w.low AND n.turn = w.turn + 1),
out0 AS (SELECT e.path, e.lib_dest, e.name, outcome, collision, regexp_replace(regexp_replace(e.name, '\\.[^.]*$', ''), '-[0-9]{3,}$', '') AS root, regexp_extract(e.name, '\\.([^.]*)$', 1) AS ext FROM walk w JOIN entries e ON e.path = w.path WHERE w.turn > 0),
mx AS (SELECT lib_dest, lower(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '-[0-9]{3,}$', '')) AS root, max(coalesce(nullif(regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), '-([0-9]{3,})$', 1), '')::INT, 0)) AS top FROM (SELECT lib_dest, name FROM library UNION ALL SELECT lib_dest, name FROM entries) GROUP BY 1, 2),
merged AS (SELECT path, o.lib_dest, name, outcome, o.lib_dest || '/' || CASE WHEN outcome = 'renamed_incoming' THEN o.root || '-' || lpad((top + row_number() OVER (PARTITION BY o.lib_dest, lower(o.root), outcome ORDER BY path))::VARCHAR, 3, '0') || '.' || ext ELSE name END AS target, collision
  FROM out0 o JOIN mx ON mx.lib_dest = o.lib_dest AND mx.root = lower(o.root))"""


def _entries(s):
    """Finalised photos; a path is told from others of its name by the photo's number."""
    h = s.rel("handoff")
    own = merge.finalised(h.withColumn("path", F.col("path")), s.rel("renames"))
    ids = h.select("fp", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("own"), "doc_id").join(s.rel("renames"), "fp", "left")
    name = F.coalesce("new_name", "own")
    return ids.select("fp", F.regexp_replace("folder", "^[^/]*/?", "").alias("lib_dest"), name.alias("name"), F.concat(F.concat_ws("/", "folder", name), F.lit("#"), F.col("doc_id").cast("string")).alias("path")), own


@query(_FINAL + "SELECT fp, lib_dest, name, regexp_replace(path, '#[0-9]*$', '') AS path FROM entries")
def finalised_j11(s):
    return _entries(s)[1]


@query(with_("inv", "handoff", "renames") + "SELECT path FROM inv WHERE top = 'by-dest' AND class IN ('image', 'raw') AND path NOT IN (SELECT folder || '/' || coalesce(new_name, string_split(path, '/')[-1]) FROM handoff LEFT JOIN renames USING (fp))")
def unrecorded_j12(s):
    on_disk = s.rel("inv").where("top = 'by-dest' AND class IN ('image', 'raw')").select("path")
    return merge.unrecorded(on_disk, _entries(s)[1])


@query(_MERGE + " SELECT path, lib_dest, name, outcome, target, collision FROM merged")
def merge_plan_c7(s):
    return merge.plan(_entries(s)[0], s.rel("library"))


@query(_MERGE + " SELECT path, outcome AS disposition FROM merged")
def merge_disposition_f26(s):
    return merge.plan(_entries(s)[0], s.rel("library")).select("path", F.col("outcome").alias("disposition"))


@query(_FINAL + "SELECT e.path, l.name IS NOT NULL AS exact, EXISTS (SELECT 1 FROM library x WHERE x.lib_dest = e.lib_dest AND lower(x.name) = lower(e.name)) AS taken FROM entries e LEFT JOIN library l ON l.lib_dest = e.lib_dest AND l.name = e.name")
def library_match_j13(s):
    d = merge._disposed(_entries(s)[0], s.rel("library"))
    return d.select("path", F.coalesce("there", F.lit(False)).alias("exact"), F.coalesce("clash", F.lit(False)).alias("taken"))


@query(_MERGE + " SELECT " + ", ".join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in merge.OUTCOMES) + " FROM merged")
def merge_totals_a15(s):
    return merge.totals(merge.plan(_entries(s)[0], s.rel("library")))


@query(_MERGE + ", done AS (SELECT path FROM merged WHERE length(path) % 2 = 0) SELECT path, CASE WHEN outcome = 'already_present' THEN 'merged_as_present' ELSE 'merged' END AS action, target AS value FROM merged JOIN done USING (path) WHERE outcome <> 'blocked'")
def merge_log_k12(s):
    p = cut(merge.plan(_entries(s)[0], s.rel("library")))
    return merge.journey(p, p.where(F.length("path") % 2 == 0))


@query(_MERGE + ", r AS (SELECT m.*, length(path) % 2 = 0 AS done FROM merged m) SELECT lib_dest, count(*) AS files, count(*) FILTER (outcome <> 'blocked' AND NOT done) AS newly, count(*) FILTER (outcome <> 'blocked' AND done) AS resumed, count(*) FILTER (outcome = 'blocked') AS blocked, CASE WHEN count(*) FILTER (outcome = 'blocked') = 0 THEN 'success' WHEN count(*) FILTER (outcome <> 'blocked') > 0 THEN 'partial' ELSE 'failed' END AS status FROM r GROUP BY lib_dest")
def merge_summary_c10(s):
    """What a merge reports when a journal has confirmed some of its files before."""
    from .functions.rules import merge_status

    p = cut(merge.plan(_entries(s)[0], s.rel("library")))
    journal = p.where(F.length("path") % 2 == 0).select("path", F.lit(True).alias("done"))
    r = p.join(journal, "path", "left").withColumn("ok", F.col("outcome") != "blocked").withColumn("done", F.coalesce("done", F.lit(False)))
    n = r.groupBy("lib_dest").agg(F.count("*").alias("files"), F.count_if(F.col("ok") & ~F.col("done")).alias("newly"), F.count_if(F.col("ok") & F.col("done")).alias("resumed"), F.count_if(~F.col("ok")).alias("blocked"))
    return n.withColumn("status", merge_status(F.col("files") - F.col("blocked"), F.col("blocked")))


@query(with_("inv", "rows") + "SELECT i.path, r.fp AS cached FROM inv i LEFT JOIN rows r ON r.path = i.path AND r.size = i.size AND r.mtime_ns = i.mtime_ns WHERE top = 'by-dest'")
def cached_fingerprints_s17(s):
    return merge.reuse(s.rel("inv").where("top = 'by-dest'").select("path", "size", "mtime_ns"), s.rel("rows")).select("path", "cached")


@query(with_("names") + "SELECT dir, path, base || '-' || lpad((top + r)::VARCHAR, greatest(3, length((top + r)::VARCHAR))::INT, '0') || '.jpg' AS name FROM (SELECT 'd' || (p_size % 7) AS dir, p_partkey AS path, p_brand AS base, row_number() OVER (PARTITION BY p_size % 7, p_brand ORDER BY p_partkey) AS r FROM part) JOIN (SELECT dir, lower(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '-[0-9]{3,}$', '')) AS root, max(coalesce(nullif(regexp_extract(name, '-([0-9]{3,})\\.', 1), '')::INT, 0)) AS top FROM names GROUP BY ALL) t USING (dir) WHERE root = lower(base)")
def append_suffix_a19(s):
    i = s.part.selectExpr("concat('d', p_size % 7) AS dir", "lpad(cast(p_partkey AS STRING), 12, '0') AS path", "concat(p_brand, '.jpg') AS name")
    return naming.append_names(i, s.names().select("dir", "name")).select("dir", F.col("path").cast("long").alias("path"), "name")


# --- sources ---------------------------------------------------------------------------------


def _folder(s):
    """A workspace on disk: a file per page, named by it; some hidden, some set aside."""
    at = folder(s.spark)
    name = F.expr("concat(CASE page_id % 5 WHEN 0 THEN 'sources/a' WHEN 1 THEN 'by-dest/b' WHEN 2 THEN '.hidden' WHEN 3 THEN 'strays/x' ELSE 'by-dest/c' END, '/')")
    rows = s.pages.select(name.alias("dir"), "page_id").groupBy("dir").agg(F.array_sort(F.collect_list("page_id")).alias("ids"))
    fs = s.spark._jvm.org.apache.hadoop.fs
    # A fixture of at most five small files, one a folder, so that the reader lists real files.
    for r in rows.select("dir", F.size("ids").alias("n")).collect():
        p = fs.Path(f"{at}/{r.dir}{'.dot' if r.dir.startswith('by-dest/c') else 'IMG'}_{r.n}.jpg")
        out = p.getFileSystem(s.spark._jsc.hadoopConfiguration()).create(p)
        out.writeBytes("x" * r.n)
        out.close()
    return at


_DISK = "WITH d AS (SELECT CASE page_id % 5 WHEN 0 THEN 'sources/a' WHEN 1 THEN 'by-dest/b' WHEN 2 THEN '.hidden' WHEN 3 THEN 'strays/x' ELSE 'by-dest/c' END AS dir, count(*) AS n FROM pages GROUP BY 1), f AS (SELECT dir || '/' || CASE WHEN dir = 'by-dest/c' THEN '.dot' ELSE 'IMG' END || '_' || n || '.jpg' AS path, n AS size FROM d) "


@query(_DISK + "SELECT path, size FROM f WHERE path NOT LIKE '.%' AND path NOT LIKE '%/.%' AND path NOT LIKE 'strays/%'")
def inventory_s1(s):
    return workspace.visible(workspace.inventory(s.spark, _folder(s))).select("path", "size")


@query(_DISK + "SELECT path FROM f WHERE path LIKE '.%' OR path LIKE '%/.%'")
def hidden_files_s2(s):
    return workspace.hidden(workspace.listed(s.spark, _folder(s))).select("path")


@query(_DISK + "SELECT path, 'image' AS class FROM f WHERE path LIKE 'by-dest/b/%'")
def folder_media_s12(s):
    return workspace.media(workspace.inventory(s.spark, _folder(s)), "by-dest", CLASSES)


@query(_DISK + "SELECT regexp_replace(path, '/[^/]*$', '') AS dir, string_split(path, '/')[-1] AS name FROM f")
def library_listing_s13(s):
    return workspace.listing(workspace.listed(s.spark, _folder(s)))


@query(_DISK + "SELECT string_split(path, '/')[-1] AS name, path, sha256(repeat('x', size::INT)) AS sha256, size FROM f WHERE path NOT LIKE '.%' AND path NOT LIKE '%/.%'")
def archive_manifest_k13(s):
    return sinks.manifest(workspace.inventory(s.spark, _folder(s), content=True))


@query("SELECT * FROM (VALUES ('none', 'disabled', 0), ('nowhere', 'missing', 0), ('void', 'empty', 0), ('tracks', 'usable', 3)) AS v(folder, status, points)")
def track_folder_s3(s):
    """A folder of tracks that is not named, is not there, holds no usable point, or three."""
    at, fs = folder(s.spark), s.spark._jvm.org.apache.hadoop.fs
    for name, points in (("void", 0), ("tracks", 3)):
        p = fs.Path(f"{at}/{name}/A.GPX")
        out = p.getFileSystem(s.spark._jsc.hadoopConfiguration()).create(p)
        out.writeBytes("<gpx><trk><trkseg>" + "".join(f'<trkpt lat="1" lon="{i}"><time>2024-01-01T00:00:0{i}Z</time></trkpt>' for i in range(points)) + "</trkseg></trk></gpx>")
        out.close()
    rows = []
    for name, root in (("none", None), ("nowhere", f"{at}/nowhere"), ("void", f"{at}/void"), ("tracks", f"{at}/tracks")):
        status, points = gpx.index(s.spark, root)
        rows.append((name, status, points.count() if points is not None else 0))
    return s.spark.createDataFrame(rows, "folder string, status string, points int")


def _dumps(s):
    """Metadata dumps: a folder a user; every tenth user's is broken."""
    tags = F.format_string(
        '{"SourceFile":"f%s.jpg","Make":%s,"Model":" M%s ","DateTimeOriginal":%s,"CreateDate":%s%s}', F.col("event_id").cast("string"), F.expr("CASE WHEN event_id % 3 = 0 THEN '\"Acme\"' ELSE 'null' END"), (F.col("user_id") % 4).cast("string"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN concat('\"', date_format(ts, 'yyyy:MM:dd HH:mm:ss'), '\"') ELSE 'null' END"), F.expr("CASE WHEN event_id % 5 < 3 THEN '\"2020:01:01 00:00:00\"' ELSE '\"\"' END"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN ',\"GPSLatitude\":50.5,\"GPSLongitude\":4.25' WHEN event_id % 7 = 1 THEN ',\"GPSLatitude\":50.5' ELSE '' END"),
    )
    rows = s.events.where("user_id % 10 <> 9 OR event_id % 2 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("folder"), F.col("user_id"), F.struct("event_id", tags.alias("t")).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["t"]), ",")
    return rows.groupBy("folder", "user_id").agg(body.alias("b")).select("folder", F.when(F.col("user_id") % 10 == 9, F.concat(F.lit("oops "), "b")).otherwise(F.concat(F.lit("["), F.col("b"), F.lit("]"))).alias("text"))


@query("""SELECT 'f' || event_id || '.jpg' AS file, CASE WHEN event_id % 3 = 0 THEN 'Acme|' ELSE '' END || 'M' || (user_id % 4) AS camera, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') WHEN event_id % 5 < 3 THEN '2020:01:01 00:00:00' END AS taken,
  CASE WHEN event_id % 2 = 0 THEN 'DateTimeOriginal' WHEN event_id % 5 < 3 THEN 'CreateDate' END AS taken_tag, event_id % 7 = 0 AS has_gps, event_id % 2 = 0 OR event_id % 5 < 3 AS has_time, 'extracted_ok' AS status FROM events WHERE user_id % 10 <> 9""")
def metadata_records_s6_x18(s):
    return workspace.metadata(_dumps(s))[0].select(F.col("SourceFile").alias("file"), "camera", "taken", "taken_tag", "has_gps", "has_time", "status")


@query("SELECT DISTINCT 'u' || user_id AS folder, 'folder_metadata_extraction_failed' AS reason FROM events WHERE user_id % 10 = 9 AND event_id % 2 = 0")
def failed_folders_s5(s):
    return workspace.metadata(_dumps(s))[1]


@query(with_("inv") + """SELECT path, folder AS dest, size, mtime_ns, fp, class, 'cam' || (doc_id % 4) AS camera, taken, doc_id % 3 = 0 AS native, CASE WHEN doc_id % 3 = 0 THEN 50.5::DOUBLE END AS lat, CASE WHEN doc_id % 3 = 0 THEN 4.25::DOUBLE END AS lon FROM inv WHERE top = 'by-dest' AND class IN ('image', 'raw')""")
def handoff_model_s9(s):
    """Handoff documents of the inventory, a document a band, read back as the photos to calibrate."""
    parsed = F.to_json(F.struct(F.concat(F.lit("cam"), F.col("doc_id") % 4).alias("camera"), "taken", (F.col("doc_id") % 3 == 0).alias("has_gps"), F.lit(50.5).alias("lat"), F.lit(4.25).alias("lon")))
    hashed = F.when(F.col("fp").isNotNull(), F.to_json(F.struct(F.col("fp").alias("value"), F.col("status").alias("status"))))
    one = F.struct(F.col("path").alias("relative_path"), F.col("top").alias("folder_class"), F.col("class").alias("media_class"), "size", "mtime_ns", hashed.alias("content_hash"), F.struct(parsed.alias("parsed")).alias("metadata"))
    text = s.rel("inv").groupBy("top", (F.col("doc_id") % 16).alias("part")).agg(F.to_json(F.struct(F.collect_list(one).alias("files"))).alias("text"))
    return workspace.handoff(text)


@query(with_("rows") + "SELECT path, size, fp, extractor_version FROM rows WHERE extractor_version IS NOT NULL")
def table_scans_s10(s):
    """Files and metadata as two stored tables, read back and joined by path."""
    files, meta = cut(s.rel("rows").select("path", "size", "fp")), cut(s.rel("rows").select("path", "extractor_version"))
    return files.join(meta, "path")


@query(with_("rows") + "SELECT fp, min(path) AS path FROM rows WHERE fp IS NOT NULL GROUP BY fp ORDER BY fp")
def ledger_scan_s11(s):
    return s.rel("rows").where("fp IS NOT NULL").groupBy("fp").agg(F.min("path").alias("path")).orderBy("fp")


@query(with_("inv") + "SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'accepted' WHEN doc_id % 4 = 1 THEN 'manual' ELSE 'open' END AS decision FROM inv")
def prior_decisions_s14(s):
    """Authored values read back from the last version of an artifact, onto what this run decides about."""
    t = sinks.Table(s.spark, folder(s.spark))
    inv = s.rel("inv")
    t.write(inv.where("doc_id % 4 = 0").select("path", F.lit("manual").alias("said")))
    t.write(inv.where("doc_id % 4 < 2").select("path", F.when(F.col("doc_id") % 4 == 0, "accepted").otherwise("manual").alias("said")))
    return inv.select("path").join(t.read(), "path", "left").select("path", F.coalesce("said", F.lit("open")).alias("decision"))


@query("""WITH g AS (SELECT 'w' || (n_nationkey % 5) AS workspace, CASE n_nationkey % 5 WHEN 0 THEN 'gap_s' WHEN 1 THEN 'speed_kmh' WHEN 2 THEN 'reach_s' ELSE 'unknown_key' END AS key, (n_nationkey % 5 * 7)::VARCHAR AS value FROM nation GROUP BY ALL),
d(key, value) AS (VALUES ('direct_s', '60'), ('gap_s', '1800'), ('distance_m', '1000'), ('speed_kmh', '150'), ('reach_s', '300')), f AS (SELECT w.workspace, d.key, coalesce(g.value, d.value) AS value FROM (SELECT DISTINCT workspace FROM g) w CROSS JOIN d LEFT JOIN g ON g.workspace = w.workspace AND g.key = d.key)
SELECT workspace, key, value, sha256(string_agg(key || '=' || value, chr(10) ORDER BY key) OVER (PARTITION BY workspace ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS digest FROM f""")
def config_s15(s):
    key = F.expr("CASE n_nationkey % 5 WHEN 0 THEN 'gap_s' WHEN 1 THEN 'speed_kmh' WHEN 2 THEN 'reach_s' ELSE 'unknown_key' END")
    given = s.nation.select(F.concat(F.lit("w"), F.col("n_nationkey") % 5).alias("workspace"), key.alias("key"), (F.col("n_nationkey") % 5 * 7).cast("string").alias("value")).distinct()
    return workspace.config(given)


@query(with_("inv") + "SELECT lower(ext) AS ext, min(path) AS sample, min(path) LIKE '%.txt' AS text FROM inv WHERE class = 'other' AND top = 'sources' GROUP BY 1")
def extension_probe_s16(s):
    """One sample for each extension that no class lists; the probe sees the sample alone."""
    some = s.rel("inv").where("class = 'other' AND top = 'sources'").groupBy(F.lower("ext").alias("ext")).agg(F.min("path").alias("sample"))
    return some.withColumn("text", F.col("sample").endswith(".txt"))


_JPEG = "unhex('FFD8'), unhex('FFE1'), unhex(lpad(hex(octet_length(encode(cast(doc_id AS STRING), 'UTF-8')) + 2), 4, '0')), encode(cast(doc_id AS STRING), 'UTF-8'), unhex('FFDB0004AABB'), unhex('FFDA0002'), encode(text, 'UTF-8'), unhex('FFD9')"


@query("SELECT doc_id, 'valid' AS status, sha256(unhex('FFDB0004AABBFFDA0002') || encode(text) || unhex('FFD9')) AS value FROM documents WHERE text IS NOT NULL")
def image_fingerprints_s7(s):
    """Texts as the scans of JPEG files whose application segment holds the id; equal scans have equal fingerprints."""
    rows = s.documents.where("text IS NOT NULL").selectExpr("doc_id", f"concat({_JPEG}) AS content")
    return rows.select("doc_id", workspace.fingerprint(F.col("content")).alias("f")).select("doc_id", "f.*")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'failed' ELSE 'valid' END AS status, CASE WHEN doc_id % 4 <> 3 THEN sha256(encode(text)) END AS value FROM documents WHERE text IS NOT NULL")
def video_fingerprints_s8(s):
    """Texts as the media box of MP4 files with other boxes around it; some bytes are no video."""
    size = "unhex(lpad(hex({}), 8, '0'))"
    body = "encode(text, 'UTF-8')"
    box = f"concat({size.format(16)}, encode('ftypisom0001', 'UTF-8'), {size.format('octet_length(encode(cast(doc_id AS STRING), ' + chr(39) + 'UTF-8' + chr(39) + ')) + 8')}, encode('free', 'UTF-8'), encode(cast(doc_id AS STRING), 'UTF-8'), {size.format(f'octet_length({body}) + 8')}, encode('mdat', 'UTF-8'), {body})"
    rows = s.documents.where("text IS NOT NULL").selectExpr("doc_id", f"CASE WHEN doc_id % 4 = 3 THEN encode('none', 'UTF-8') ELSE {box} END AS content")
    return rows.select("doc_id", workspace.fingerprint(F.col("content")).alias("f")).select("doc_id", "f.*")


# --- state -----------------------------------------------------------------------------------


@query(with_("inv") + "SELECT '{\"class\":\"' || class || '\",\"path\":\"' || path || '\",\"size\":' || size || '}' AS line FROM inv")
def json_artifact_k1(s):
    at = folder(s.spark)
    sinks.lines(s.rel("inv").select("path", "class", "size"), ["path"], at)
    return s.spark.read.text(at).select(F.col("value").alias("line"))


@query("SELECT * FROM (VALUES (1, true, 1), (2, false, 1), (3, true, 2)) AS v(step, written, versions)")
def versioned_write_k2(s):
    """A write, the same rows in another order, and other rows: two versions."""
    t, rows, out = sinks.Table(s.spark, folder(s.spark)), s.rel("inv").select("path", "size"), []
    for step, df in enumerate((rows, rows.repartition(5).select("size", "path"), rows.where("size > 300")), 1):
        out.append((step, t.write(df), len(t.versions())))
    return s.spark.createDataFrame(out, "step int, written boolean, versions int")


@query(with_("rows") + "SELECT CASE WHEN doc_id % 6 = 1 THEN 'new/' || doc_id ELSE path END AS path, size FROM rows WHERE doc_id % 6 <> 0")
def delete_rename_k4(s):
    rows = s.rel("rows").select("doc_id", "path", "size")
    left = sinks.remove(rows, rows.where("doc_id % 6 = 0"), "path")
    changes = rows.where("doc_id % 6 = 1").select(F.col("path").alias("old"), F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("new"))
    return sinks.rename(left, changes, "path").select("path", "size")


@query(with_("photos") + "SELECT path, naive FROM photos WHERE native")
def replace_all_k5(s):
    """The cache of resolved times holds the last run's rows alone."""
    t = sinks.Table(s.spark, folder(s.spark))
    t.write(s.photos().select("path", "naive"))
    t.write(s.photos().where("native").select("path", "naive"))
    return t.read()


@query(with_("rows") + ", a AS (SELECT path, size + 1 AS size FROM rows WHERE doc_id % 3 = 0 UNION ALL SELECT path, size FROM rows WHERE doc_id % 3 = 1) SELECT path, size, 2 AS versions FROM a")
def batch_k7(s):
    """An upsert and a removal as one version."""
    rows = s.rel("rows").select("doc_id", "path", "size")
    t = sinks.Table(s.spark, folder(s.spark))
    t.write(rows.select("path", "size"))
    delta = rows.where("doc_id % 3 = 0").select("path", (F.col("size") + 1).alias("size"))
    t.batch(lambda df: relational.upsert(df, delta, "path"), lambda df: sinks.remove(df, rows.where("doc_id % 3 = 2"), "path"))
    return t.read().withColumn("versions", F.lit(len(t.versions())))


@query(with_("rows") + "SELECT true AS same, count(*) AS n FROM rows")
def snapshot_k8(s):
    at = folder(s.spark)
    same = sinks.snapshot(s.rel("rows"), at)
    return s.spark.read.parquet(at).agg(F.count("*").alias("n")).select(F.lit(same).alias("same"), "n")


@query(with_("inv") + "SELECT 'p' || (doc_id % 2) AS plan, path FROM inv WHERE doc_id % 5 = 0")
def quarantine_log_k9(s):
    at, rows = folder(s.spark), s.rel("inv").where("doc_id % 5 = 0").select(F.concat(F.lit("p"), F.col("doc_id") % 2).alias("plan"), "path")
    sinks.append(rows.where("plan = 'p0'"), at)
    return sinks.append(rows.where("plan = 'p1'"), at)


@query(with_("ops", "results") + "SELECT op, kind FROM ops WHERE op NOT IN (SELECT op FROM results WHERE result IN ('applied', 'skipped'))")
def journal_k10(s):
    """A journal kept in two appends; what a resumed run still has to do."""
    at, r = folder(s.spark), s.rel("results").where("result IN ('applied', 'skipped')").select("op", "result")
    sinks.append(r.where("result = 'applied'"), at)
    journal = sinks.append(r.where("result = 'skipped'"), at)
    return s.rel("ops").join(journal, "op", "left_anti").select("op", "kind")


@query(with_("inv") + "SELECT 'files' AS part, count(*) AS n, sum(size)::BIGINT AS bytes FROM inv UNION ALL SELECT 'folder:' || top, count(*), sum(size)::BIGINT FROM inv GROUP BY top")
def handoff_document_k11(s):
    """The parts of the document that hands a run over, stored and read back."""
    inv = s.rel("inv")
    n = [F.count("*").alias("n"), F.sum("size").alias("bytes")]
    return cut(inv.agg(*n).select(F.lit("files").alias("part"), "*").union(inv.groupBy("top").agg(*n).select(F.concat(F.lit("folder:"), "top"), "n", "bytes")))


@query("SELECT * FROM (VALUES ('guard', true, false), ('library', true, false), ('sealed', true, true)) AS v(mark, there, final)")
def markers_k14(s):
    """Marks of a workspace as empty files, seen by their names."""
    at, fs = folder(s.spark), s.spark._jvm.org.apache.hadoop.fs
    for name in ("guard", "library", "sealed"):
        p = fs.Path(f"{at}/{name}")
        p.getFileSystem(s.spark._jsc.hadoopConfiguration()).create(p).close()
    found = workspace.listed(s.spark, at).select(F.col("path").alias("mark"))
    return found.select("mark", F.lit(True).alias("there"), (F.col("mark") == "sealed").alias("final"))


@query(with_("rows") + "SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE fp END AS fp FROM rows")
def library_cache_k17(s):
    rows = s.rel("rows").select("doc_id", "path", "fp")
    return relational.upsert(rows.select("path", "fp"), rows.where("doc_id % 4 = 0").select("path", F.lit("new").alias("fp")), "path")


_FP = "(SELECT sha256(string_agg(h, chr(10) ORDER BY b)) FROM (SELECT substr(sha256(path), 1, 2) AS b, sha256(string_agg(sha256(path || ' ' || size), chr(10) ORDER BY sha256(path || ' ' || size))) AS h FROM {} GROUP BY 1))"


@query(with_("inv", "rows") + f"SELECT 'inventory' AS dep, {_FP.format('inv')} AS fp UNION ALL SELECT 'recorded', {_FP.format('(SELECT path, size FROM rows)')}")
def dependencies_f31(s):
    parts = {"inventory": s.rel("inv").select("path", "size"), "recorded": s.rel("rows").select("path", "size")}
    return sinks.dependencies(parts, "path", F.concat_ws(" ", "path", "size"))


@query(with_("inv", "rows") + f"SELECT 'resolved' AS name, {_FP.format('(SELECT path, size FROM inv WHERE size > 5)')} AS fp")
def subset_fingerprint_a16(s):
    rows = s.rel("inv").where("size > 5").select("path", "size")
    return relational.index_fingerprint(rows, F.col("path"), F.concat_ws(" ", "path", "size")).select(F.lit("resolved").alias("name"), F.col("fingerprint").alias("fp"))


@query(with_("inv") + "SELECT d.dest, count(*) AS n FROM (SELECT DISTINCT folder AS dest FROM inv WHERE top = 'by-dest') d JOIN inv i ON starts_with(i.path, d.dest || '/') WHERE i.doc_id % 2 = 0 GROUP BY d.dest")
def evidence_under_j25(s):
    """Evidence whose retained file lies under a destination: joined by the file's own ancestors, not by prefixes."""
    inv = s.rel("inv")
    dests = inv.where("top = 'by-dest'").select(F.col("folder").alias("dest")).distinct()
    up = inv.where("doc_id % 2 = 0").select("path", F.explode(scalar.ancestors(F.col("path"))).alias("dest"))
    return up.join(dests, "dest").groupBy("dest").agg(F.count("*").alias("n"))


@query(with_("ops") + "SELECT dest, count(*) AS done FROM ops GROUP BY dest")
def counters_a20(s):
    return s.rel("ops").groupBy("dest").agg(F.count("*").alias("done"))


@query(with_("inv", "rows") + "SELECT 'stale' AS gate, 'changed since planning' AS reason, count(*) AS n, min(path) AS example FROM inv JOIN rows USING (path) WHERE inv.size <> rows.size HAVING count(*) > 0 UNION ALL SELECT 'sources', 'sources are not empty', count(*), min(path) FROM inv WHERE top = 'sources' HAVING count(*) > 0 UNION ALL SELECT 'by-date', 'photos are left by date', count(*), min(path) FROM inv WHERE top = 'by-date' AND class IN ('image', 'raw') HAVING count(*) > 0 UNION ALL SELECT 'by-dest', 'not only photos', count(*), min(path) FROM inv WHERE top = 'by-dest' AND class NOT IN ('image', 'raw') HAVING count(*) > 0 UNION ALL SELECT 'library', 'photos are not in the record', count(*), min(path) FROM inv WHERE top = 'by-dest' AND class IN ('image', 'raw') AND path NOT IN (SELECT path FROM rows) HAVING count(*) > 0")
def gates_f23_f24(s):
    return gates.failed(gates.workspace(s.rel("inv"), s.rel("rows")))
