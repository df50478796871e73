"""Queries of the preparation plan, and of counts over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .adapters import with_
from .functions import scalar
from .operators import relational
from .plans import prep
from .registry import query
from .session import cut

_INV = with_("inv", "rows")
_FRESH = "(w.path IS NOT NULL AND w.md_size IS NOT DISTINCT FROM i.size AND w.md_mtime_ns IS NOT DISTINCT FROM i.mtime_ns AND (w.fp IS NULL OR w.md_fp IS NOT DISTINCT FROM w.fp) AND w.extractor = 'reader' AND w.extractor_version = '12.2' AND w.field_set = 3 AND w.options = 'o1' AND w.schema_version = 1 AND w.key_version = 2)"
_HASH = "(NOT coalesce(i.class IN ('image', 'raw') AND w.status = 'valid' AND w.engine <> '7', false))"
_CARRIED = _INV + """, gone AS (SELECT r.* , lower(string_split(path, '/')[-1]) AS name FROM rows r WHERE path NOT IN (SELECT path FROM inv)),
fresh_ AS (SELECT i.*, lower(stem || '.' || ext) AS name FROM inv i WHERE top = 'by-dest' AND path NOT IN (SELECT path FROM rows)),
carried AS (SELECT n.path, g.path AS source FROM (SELECT *, count(*) OVER (PARTITION BY size, mtime_ns, name) AS c FROM fresh_) n JOIN (SELECT *, count(*) OVER (PARTITION BY size, mtime_ns, name) AS c FROM gone) g
  ON n.size = g.size AND n.mtime_ns = g.mtime_ns AND n.name = g.name AND n.c = 1 AND g.c = 1)"""
_STATES = _CARRIED + f""", states AS (SELECT i.*, c.source, w.fp AS w_fp, w.path IS NOT NULL AS known, w.size AS w_size, w.mtime_ns AS w_mtime, {_FRESH} AS md_ok, CASE WHEN c.path IS NOT NULL THEN 'carried'
  WHEN w.size = i.size AND w.mtime_ns = i.mtime_ns AND {_FRESH} AND {_HASH} THEN 'reused' WHEN i.class = 'other' THEN 'not_applicable' WHEN w.path IS NULL AND i.top = 'by-dest' THEN 'moved-unmatched' WHEN w.path IS NULL THEN 'new'
  WHEN w.size <> i.size THEN 'size-changed' WHEN w.mtime_ns <> i.mtime_ns THEN 'mtime-changed' WHEN NOT {_FRESH} THEN 'metadata-stale' ELSE 'engine-changed' END AS state
  FROM inv i LEFT JOIN rows w USING (path) LEFT JOIN carried c USING (path))"""


@query(_INV + f"SELECT path, {_FRESH} AS fresh FROM inv i LEFT JOIN rows w USING (path)")
def metadata_freshness_f8(s):
    return prep.recorded(s.rel("inv"), s.rel("rows")).select("path", prep.metadata_fresh().alias("fresh"))


@query(_INV + f"SELECT path, {_HASH} AS fresh FROM inv i LEFT JOIN rows w USING (path)")
def hash_freshness_f9(s):
    return prep.recorded(s.rel("inv"), s.rel("rows")).select("path", prep.hash_fresh("7").alias("fresh"))


@query(_CARRIED + "SELECT path, source FROM carried")
def carried_moves_j3(s):
    return prep.carried(s.rel("inv"), s.rel("rows"))


@query(_STATES + "SELECT path, state FROM states")
def rehash_reasons_f10(s):
    return prep.decisions(s.rel("inv"), s.rel("rows")).select("path", "state")


@query(_STATES + """, t AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY path) AS r FROM states WHERE state NOT IN ('carried', 'reused', 'not_applicable'))
SELECT state, state = 'new' AS expected, count(*) AS n, string_agg(path, ' ' ORDER BY path) FILTER (r <= 5) AS examples FROM t GROUP BY state""")
def rehash_report_a5(s):
    from .functions.rules import first_examples

    read = prep.decisions(s.rel("inv"), s.rel("rows")).where("state NOT IN ('carried', 'reused', 'not_applicable')").select("state", "path")
    some = first_examples(read, "state", "path", 5).groupBy("state").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("examples"))
    return read.groupBy("state").agg((F.col("state") == "new").alias("expected"), F.count("*").alias("n")).join(some, "state")


@query(_INV + "SELECT path, path IN (SELECT path FROM inv) AS keep FROM rows WHERE path NOT IN (SELECT path FROM inv)")
def ghost_rows_j2(s):
    return prep.ghosts(s.rel("inv"), s.rel("rows")).withColumn("keep", F.lit(False))


# --- the plan's stages -----------------------------------------------------------------------

_MANAGED = "('sources', 'strays', 'missing', 'jpgs', 'videos', 'by-date', 'by-dest')"
_ONE = with_("inv") + f""", s1 AS (SELECT *, CASE WHEN top IN {_MANAGED} THEN path ELSE 'sources/' || path END AS path1 FROM inv),
s2 AS (SELECT *, regexp_replace(path1, '/[^/]*$', '') || '/' || stem || '.' || lower(ext) AS path2 FROM s1)"""
_TWO = _ONE + """, g AS (SELECT regexp_replace(path2, '/[^/]*$', '') AS f, stem AS gstem, bool_or(class = 'raw') AND bool_or(class = 'image' AND lower(path) LIKE '%.jpg') AS pair FROM s2 GROUP BY 1, 2),
s3 AS (SELECT s2.*, coalesce(pair, false) AND class = 'image' AS paired, CASE WHEN pair AND class = 'image' AND path2 LIKE 'sources/%' THEN 'jpgs/' || stem || '.' || lower(ext) ELSE path2 END AS path3
  FROM s2 JOIN g ON g.f = regexp_replace(path2, '/[^/]*$', '') AND gstem = s2.stem)"""
_PRIO = "CASE split_part(path3, '/', 1) WHEN 'by-dest' THEN 0 WHEN 'by-date' THEN 1 WHEN 'videos' THEN 2 WHEN 'jpgs' THEN 3 WHEN 'missing' THEN 4 ELSE 5 END"
_THREE = _TWO + f""", d AS (SELECT doc_id, top, first(path3) OVER w AS retained, row_number() OVER w AS r FROM s3 WHERE class <> 'other' AND status = 'valid' AND NOT paired WINDOW w AS (PARTITION BY fp, class ORDER BY {_PRIO}, path)),
s4 AS (SELECT s3.*, d.retained FROM s3 LEFT JOIN d ON d.doc_id = s3.doc_id AND d.r > 1 AND d.top <> 'by-dest')"""
_FOUR = _THREE + """, p AS (SELECT *, split_part(path3, '/', 1) AS ptop, string_split(path3, '/')[-1] AS name, taken IS NOT NULL AS timed, replace(substr(taken, 1, 10), ':', '-') AS day FROM s4 WHERE retained IS NULL AND top <> 'by-dest'),
m AS (SELECT *, ptop IN ('missing', 'jpgs', 'by-dest') OR coalesce(ptop IN ('by-date', 'videos') AND len(string_split(path3, '/')) = 3 AND split_part(path3, '/', 2) = day, false) AS stays FROM p WHERE class <> 'other'),
occ AS (SELECT DISTINCT lower(regexp_replace(name, '-[0-9]{3}(\\.[^.]*)$', '\\1')) AS bare, coalesce(nullif(regexp_extract(name, '-([0-9]{3})\\.[^.]*$', 1), '')::INT, 0) AS slot FROM m WHERE stays UNION SELECT lower(name), 0 FROM m WHERE stays),
w AS (SELECT doc_id, path, CASE WHEN timed THEN day || '--' || replace(substr(taken, 12), ':', '-') ELSE 'UNKN_' || regexp_replace(name, '\\.[^.]*$', '') END AS base, regexp_extract(name, '\\.([^.]*)$', 1) AS e,
  CASE WHEN NOT timed THEN 'missing' WHEN class = 'video' THEN 'videos/' || day ELSE 'by-date/' || day END AS dir FROM m WHERE NOT stays),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(base), lower(e) ORDER BY path || '|' || doc_id) AS r FROM w),
free AS (SELECT bare, slot, row_number() OVER (PARTITION BY bare ORDER BY slot) AS r FROM (SELECT lower(base || '.' || e) AS bare, unnest(range(0, count(*) + 200)) AS slot FROM w GROUP BY 1) ANTI JOIN occ USING (bare, slot)),
placed AS (SELECT doc_id, dir || '/' || base || CASE WHEN slot = 0 THEN '' ELSE '-' || lpad(slot::VARCHAR, 3, '0') END || '.' || e AS path4 FROM n JOIN free f ON f.bare = lower(base || '.' || e) AND f.r = n.r
  UNION ALL SELECT doc_id, 'strays/' || substr(path3, 9) FROM p WHERE class = 'other' AND ptop = 'sources'),
plan AS (SELECT s4.*, path4, CASE WHEN retained IS NOT NULL THEN 'quarantine/' || path3 ELSE coalesce(path4, path3) END AS final,
  CASE WHEN retained IS NOT NULL THEN 'quarantine' WHEN path4 LIKE 'strays/%' THEN 'stray' WHEN path4 IS NOT NULL THEN 'organise' WHEN path3 <> path2 THEN 'separate' WHEN path2 <> path1 THEN 'normalise' WHEN path1 <> path THEN 'initialise' ELSE 'keep' END AS step
  FROM s4 LEFT JOIN placed USING (doc_id)),
opsof AS (SELECT doc_id, 0 AS seq, 'initialise' AS action, path AS source, path1 AS destination FROM plan WHERE path1 <> path UNION ALL SELECT doc_id, 1, 'normalise', path1, path2 FROM plan WHERE path2 <> path1
  UNION ALL SELECT doc_id, 2, 'separate', path2, path3 FROM plan WHERE path3 <> path2 UNION ALL SELECT doc_id, 3, CASE WHEN path4 LIKE 'strays/%' THEN 'stray' ELSE 'organise' END, path3, path4 FROM plan WHERE path4 <> path3
  UNION ALL SELECT doc_id, 4, 'quarantine', path3, final FROM plan WHERE retained IS NOT NULL)"""


@query(_ONE + "SELECT path, path1, path2 FROM s2")
def init_and_case_w12(s):
    return prep.normalised(s.rel("inv")).select("path", "path1", "path2")


@query(_TWO + "SELECT path, path3 FROM s3 WHERE paired")
def pairs_a12(s):
    f = prep.normalised(s.rel("inv"))
    return prep.paired(f).join(f.select("doc_id", "path"), "doc_id").select("path", "path3")


@query(_TWO + "SELECT fp, class, count(*) AS n, min(path) AS least FROM s3 WHERE NOT paired AND class <> 'other' AND status = 'valid' GROUP BY ALL HAVING count(*) > 1")
def copies_a1(s):
    f = prep.normalised(s.rel("inv"))
    return prep.content_groups(f, prep.paired(f)).groupBy("fp", "class").agg(F.count("*").alias("n"), F.min("path").alias("least")).where("n > 1")


@query(_TWO + "SELECT path, coalesce(status, 'none') AS status FROM s3 WHERE class <> 'other' AND top <> 'by-dest' AND status IS DISTINCT FROM 'valid' AND NOT paired")
def hash_failures_a1(s):
    f = prep.normalised(s.rel("inv"))
    return prep.hash_failures(f, prep.paired(f))


@query(_FOUR + "SELECT path, retained, final AS quarantine_path FROM plan WHERE step = 'quarantine'")
def quarantine_w1(s):
    return prep.plan(s.rel("inv")).where("step = 'quarantine'").select("path", "retained", F.col("final").alias("quarantine_path"))


@query(_FOUR + "SELECT path, path4 FROM plan WHERE path4 IS NOT NULL")
def organise_w11(s):
    return prep.plan(s.rel("inv")).where("path4 IS NOT NULL").select("path", "path4")


@query(_FOUR + "SELECT path, final, step FROM plan")
def prep_plan_c1(s):
    return prep.plan(s.rel("inv")).select("path", "final", "step")


@query(_FOUR + "SELECT o.doc_id, o.action, o.source, o.destination FROM opsof o")
def prep_operations_c1(s):
    return prep.operations(prep.plan(s.rel("inv"))).drop("seq")


@query(_FOUR + ", k AS (SELECT doc_id, count(*) AS moves, string_agg(action, '>' ORDER BY seq) AS chain FROM opsof GROUP BY doc_id) SELECT path AS origin, final AS ends, coalesce(moves, 0) AS moves, coalesce(chain, '') AS chain FROM plan LEFT JOIN k USING (doc_id)")
def path_chain_w7(s):
    p = prep.plan(s.rel("inv"))
    k = prep.operations(p).groupBy("doc_id").agg(F.count("*").alias("moves"), F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("c"))
    joined = p.join(k, "doc_id", "left")
    return joined.select(F.col("path").alias("origin"), F.col("final").alias("ends"), F.coalesce("moves", F.lit(0)).alias("moves"), F.coalesce(F.array_join(F.transform("c", lambda x: x["action"]), ">"), F.lit("")).alias("chain"))


@query(_FOUR + f""", {_CARRIED.split('gone AS', 1)[1].join(['rows AS (' + _INV.split('rows AS (', 1)[1].rstrip() + ', gone AS', ''])}
SELECT path, 'upsert' AS action FROM plan i LEFT JOIN rows w USING (path) LEFT JOIN carried c USING (path) WHERE step = 'keep' AND c.path IS NULL AND NOT coalesce(w.size = i.size AND w.mtime_ns = i.mtime_ns AND {_FRESH} AND w.fp IS NOT DISTINCT FROM i.fp, false)
UNION ALL SELECT path, 'carry' FROM carried UNION ALL SELECT path, 'remove' FROM rows WHERE path NOT IN (SELECT path FROM inv)""")
def cache_effects_c5(s):
    inv, rows = s.rel("inv"), s.rel("rows")
    return prep.cache_effects(inv, rows, prep.plan(inv))


@query(_FOUR + """, b AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder FROM plan),
a AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(final, '/'))), lambda i: array_to_string(string_split(final, '/')[1:i], '/'))) AS folder FROM plan) SELECT folder FROM b ANTI JOIN a USING (folder)""")
def emptied_folders_c12(s):
    return prep.emptied(prep.plan(s.rel("inv")))


@query(_FOUR + "SELECT 'plan-7' AS plan_id, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, min(final) AS first_path, string_agg(DISTINCT class, ',' ORDER BY class) AS classes FROM plan WHERE step = 'quarantine'")
def quarantine_artifacts_c6(s):
    q = prep.plan(s.rel("inv")).where("step = 'quarantine'")
    return q.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("final").alias("first_path"), F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes")).select(F.lit("plan-7").alias("plan_id"), "*")


@query(_FOUR + "SELECT action, count(*) AS n FROM opsof GROUP BY action")
def plan_summary_a15(s):
    return prep.operations(prep.plan(s.rel("inv"))).groupBy("action").agg(F.count("*").alias("n"))


_REPORT = {
    "media_operations": "(SELECT count(*) FROM opsof WHERE action <> 'stray')", "cache_written": "(SELECT count(*) FROM states WHERE state NOT IN ('reused', 'carried'))", "cache_removed": "(SELECT count(*) FROM rows WHERE path NOT IN (SELECT path FROM inv))",
    "already_correct": "(SELECT count(*) FROM plan WHERE step = 'keep')", "recognised_moves": "(SELECT count(*) FROM states WHERE state = 'carried')", "by_dest_scanned": "(SELECT count(*) FROM inv WHERE top = 'by-dest')",
    "by_dest_changed": "(SELECT count(*) FROM plan WHERE top = 'by-dest' AND step IN ('quarantine', 'organise'))", "copies_of_by_dest": "(SELECT count(*) FROM plan WHERE retained LIKE 'by-dest/%')", "copies_of_others": "(SELECT count(*) FROM plan WHERE retained NOT LIKE 'by-dest/%')",
    "metadata_reused": "(SELECT count(*) FROM states WHERE state = 'reused')", "metadata_read": "(SELECT count(*) FROM states WHERE state NOT IN ('reused', 'carried', 'not_applicable'))", "not_applicable": "(SELECT count(*) FROM states WHERE state = 'not_applicable')",
    "without_time": "(SELECT count(*) FROM inv WHERE taken IS NULL)", "images": "(SELECT count(*) FROM inv WHERE class = 'image')", "raws": "(SELECT count(*) FROM inv WHERE class = 'raw')", "videos": "(SELECT count(*) FROM inv WHERE class = 'video')", "strays": "(SELECT count(*) FROM plan WHERE step = 'stray')",
    "contents": "(SELECT count(DISTINCT fp) FROM inv)", "quarantined_bytes": "(SELECT coalesce(sum(size), 0)::BIGINT FROM plan WHERE step = 'quarantine')", "bands": "(SELECT count(DISTINCT top) FROM inv)",
}
_BOTH = _FOUR + ", rows AS (" + _STATES.split("rows AS (", 1)[1]


@query(_BOTH + "SELECT " + ", ".join(f"{q} AS {n}" for n, q in _REPORT.items()))
def run_report_full_a4(s):
    inv, rows = s.rel("inv"), s.rel("rows")
    p = prep.plan(inv)
    n = lambda c: F.count_if(F.expr(c))
    of_plan = p.agg(
        n("step = 'keep'").alias("already_correct"), n("top = 'by-dest' AND step IN ('quarantine', 'organise')").alias("by_dest_changed"), n("retained LIKE 'by-dest/%'").alias("copies_of_by_dest"), n("retained NOT LIKE 'by-dest/%'").alias("copies_of_others"), n("step = 'stray'").alias("strays"),
        F.coalesce(F.sum(F.when(F.col("step") == "quarantine", F.col("size"))), F.lit(0)).alias("quarantined_bytes"), n("top = 'by-dest'").alias("by_dest_scanned"), n("taken IS NULL").alias("without_time"), n("class = 'image'").alias("images"), n("class = 'raw'").alias("raws"), n("class = 'video'").alias("videos"),
        F.count_distinct("fp").alias("contents"), F.count_distinct("top").alias("bands"),
    )
    of_states = prep.decisions(inv, rows).agg(
        n("state NOT IN ('reused', 'carried')").alias("cache_written"), n("state = 'carried'").alias("recognised_moves"), n("state = 'reused'").alias("metadata_reused"), n("state NOT IN ('reused', 'carried', 'not_applicable')").alias("metadata_read"), n("state = 'not_applicable'").alias("not_applicable"),
    )
    moved = prep.operations(p).agg(n("action <> 'stray'").alias("media_operations"))
    gone = prep.ghosts(inv, rows).agg(F.count("*").alias("cache_removed"))
    # One row each.
    return of_plan.crossJoin(of_states).crossJoin(moved).crossJoin(gone).select(*_REPORT)


_MOVES = """SELECT op AS seq, CASE WHEN op % 17 = 0 THEN 'delete' ELSE kind END AS kind, 'p/' || cast(item % 400 AS STRING) AS source, CASE WHEN op % 23 = 0 THEN 'by-dest/x' ELSE 'q/' || cast(op % 3000 AS STRING) END AS destination, op % 5 AS size FROM {ops}"""
_THERE = "SELECT 'p/' || cast(p_partkey AS STRING) AS path, p_partkey % 5 AS size FROM {part} WHERE p_partkey < 390"


@query(with_("ops") + f""", m AS ({_MOVES.replace('{ops}', 'ops')}), f AS ({_THERE.replace('{part}', 'part')}), a AS (SELECT destination AS source, min(seq) AS made FROM m GROUP BY 1),
c AS (SELECT m.*, f.size AS is_, made, min(seq) OVER (PARTITION BY m.source) AS first FROM m LEFT JOIN f ON f.path = m.source LEFT JOIN a USING (source)),
e AS (SELECT lower(path) AS path, -1 AS seq, 1 AS d FROM f UNION ALL SELECT lower(source), seq, -1 FROM m UNION ALL SELECT lower(destination), seq, 1 FROM m),
h AS (SELECT path, seq, sum(d) OVER (PARTITION BY path ORDER BY seq, d ROWS UNBOUNDED PRECEDING) AS held FROM e)
SELECT DISTINCT seq, problem FROM (SELECT seq, CASE WHEN kind NOT IN ('move', 'rename', 'quarantine') THEN 'unknown kind' WHEN source LIKE 'by-dest/%' OR destination LIKE 'by-dest/%' THEN 'by-dest is fixed'
  WHEN seq = first AND (made IS NULL OR made >= seq) AND is_ IS NULL THEN 'source is missing' WHEN seq = first AND (made IS NULL OR made >= seq) AND is_ <> size THEN 'source has changed' END AS problem FROM c
  UNION ALL SELECT seq, 'target is taken' FROM h WHERE held > 1 AND seq >= 0) WHERE problem IS NOT NULL""")
def plan_preflight_f25(s):
    moves = s.spark.sql(_MOVES, ops=s.rel("ops"))
    return prep.problems(moves, s.spark.sql(_THERE, part=s.part))


@query(_INV + "SELECT path, reason FROM (SELECT * FROM (SELECT path, 'not_in_handoff' AS reason FROM inv WHERE top = 'by-dest' AND path NOT IN (SELECT path FROM rows) ORDER BY path LIMIT 1) UNION ALL SELECT * FROM (SELECT path, 'not_on_disk' FROM rows WHERE path LIKE 'by-date/%' AND path NOT IN (SELECT path FROM inv) ORDER BY path LIMIT 1)) ORDER BY reason LIMIT 1")
def reprep_trigger_j4(s):
    """The first file that calls for another run, if any: one under by-dest that is not recorded, else a recorded dated one that is gone."""
    inv, rows = s.rel("inv"), s.rel("rows")
    new = inv.where("top = 'by-dest'").join(rows.select("path"), "path", "left_anti").agg(F.min("path").alias("path")).select("path", F.lit("not_in_handoff").alias("reason"))
    gone = rows.where("path LIKE 'by-date/%'").join(inv.select("path"), "path", "left_anti").agg(F.min("path").alias("path")).select("path", F.lit("not_on_disk"))
    return new.union(gone).where("path IS NOT NULL").orderBy("reason").limit(1)


@query(with_("inv") + "SELECT path FROM inv WHERE lower(ext) IN ('xmp', 'dop', 'pp3') UNION ALL SELECT path || '.xmp' FROM inv WHERE doc_id % 8 = 0 UNION ALL SELECT path || '.PP3' FROM inv WHERE doc_id % 9 = 0")
def sidecars_f3(s):
    inv = s.rel("inv").select("doc_id", "path")
    more = inv.where("doc_id % 8 = 0").select("doc_id", F.concat("path", F.lit(".xmp"))).union(inv.where("doc_id % 9 = 0").select("doc_id", F.concat("path", F.lit(".PP3")))).union(inv.select("doc_id", F.concat("path", F.lit(".txt"))))
    return inv.union(more).where(scalar.extension(F.col("path")).isin("xmp", "dop", "pp3")).select("path")


@query(_INV + "SELECT fp, count(*) AS n, min(path) AS path FROM inv WHERE doc_id % 4 = 0 AND fp IS NOT NULL GROUP BY fp")
def consume_k6(s):
    """Entries taken out of a first-write-wins ledger: what is left are the others."""
    inv = s.rel("inv").where("fp IS NOT NULL")
    ledger = relational.first_write_wins(inv.where("doc_id % 4 = 0").groupBy("fp").agg(F.count("*").alias("n"), F.min("path").alias("path")), inv.where("doc_id % 4 = 1").groupBy("fp").agg(F.count("*").alias("n"), F.min("path").alias("path")), "fp")
    pinned = inv.where("doc_id % 4 = 0").select("fp").distinct()
    return ledger.join(ledger.join(pinned, "fp", "left_anti").select("fp"), "fp", "left_anti")


@query(_FOUR + "SELECT final AS path, size, mtime_ns, fp FROM plan WHERE step <> 'stray'")
def prep_execution_c8(s):
    inv = s.rel("inv")
    return prep.executed(inv, s.rel("rows"), cut(prep.plan(inv)))
