"""The preparation plan: what changed since the last run, and where every file of an inventory goes.

An inventory has ``doc_id, path, folder, top, stem, ext, class, size, mtime_ns, fp, status, taken``; the recorded rows
have the same file's facts and the versions they were taken with.  Stages are columns and tables, not a replay: a
file's path after a stage is a column of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import naming, relational
from ..session import cut

MANAGED = ("sources", "strays", "missing", "jpgs", "videos", "by-date", "by-dest")
#: Order in which a group's file is kept.
RETAIN = ["by-dest", "by-date", "videos", "jpgs", "missing"]
#: What the metadata now is read with.
CONTEXT = {"extractor": "reader", "extractor_version": "12.2", "field_set": 3, "options": "o1", "schema_version": 1, "key_version": 2}


def recorded(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files with the row of their path as a struct ``was`` (null where there is none)."""
    r = rows.select(F.col("path").alias("_path"), F.struct("*").alias("was"))
    return files.join(r, F.col("path") == F.col("_path"), "left").drop("_path")


def metadata_fresh(context: dict = CONTEXT) -> Column:
    """Whether the recorded metadata still holds: size, time, content and the six versions, nulls equal to nulls."""
    was = F.col("was")
    same = was["md_size"].eqNullSafe(F.col("size")) & was["md_mtime_ns"].eqNullSafe(F.col("mtime_ns"))
    same &= was["fp"].isNull() | was["md_fp"].eqNullSafe(was["fp"])
    for name, now in context.items():
        same &= was[name].eqNullSafe(F.lit(now))
    return was.isNotNull() & same


def hash_fresh(engine: str) -> Column:
    """Whether a recorded content hash is of the engine that runs now; only a valid image's hash depends on it."""
    was = F.col("was")
    return ~F.coalesce(F.col("class").isin("image", "raw") & (was["status"] == "valid") & was["engine"].isNotNull() & (was["engine"] != engine), F.lit(False))


def carried(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``(path, source)``: files new under by-dest that are the one missing row of their size, time and name."""
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    key = ["size", "mtime_ns", "name"]
    gone = rows.join(files.select("path"), "path", "left_anti").select("path", "size", "mtime_ns", name(F.col("path")).alias("name"))
    new = files.where("top = 'by-dest'").join(rows.select("path"), "path", "left_anti").select("path", "size", "mtime_ns", name(F.col("path")).alias("name"))
    return relational.bijective(gone, new, key).select(F.col("new_path").alias("path"), F.col("old_path").alias("source"))


def decisions(files: DataFrame, rows: DataFrame, engine: str = "7") -> DataFrame:
    """Every file with ``state``: carried, reused, or why it is read again (the first reason that holds)."""
    moved = carried(files, rows)
    was = F.col("was")
    both = recorded(files, rows).join(moved, "path", "left")
    fresh = was.isNotNull() & (was["size"] == F.col("size")) & (was["mtime_ns"] == F.col("mtime_ns")) & metadata_fresh() & hash_fresh(engine)
    why = (
        F.when(F.col("source").isNotNull(), "carried").when(fresh, "reused").when(F.col("class") == "other", "not_applicable")
        .when(was.isNull() & (F.col("top") == "by-dest"), "moved-unmatched").when(was.isNull(), "new")
        .when(was["size"] != F.col("size"), "size-changed").when(was["mtime_ns"] != F.col("mtime_ns"), "mtime-changed")
        .when(~metadata_fresh(), "metadata-stale").otherwise("engine-changed")
    )
    return both.withColumn("state", why)


def ghosts(files: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(files.select("path"), "path", "left_anti").select("path")


def normalised(files: DataFrame) -> DataFrame:
    """Files with ``path1`` (after the move of loose folders into sources) and ``path2`` (extension in lower case, a
    suffix where another file has that name, case aside)."""
    path1 = F.when(F.col("top").isin(*MANAGED), F.col("path")).otherwise(F.concat(F.lit("sources/"), F.col("path")))
    f = files.withColumn("path1", path1)
    folder = F.regexp_replace("path1", "/[^/]*$", "")
    upper = F.col("ext") != F.lower("ext")
    change = f.where(upper).select(folder.alias("dir"), F.col("path1").alias("path"), F.col("stem").alias("base"), F.lower("ext").alias("ext"))
    stay = f.where(~upper).select(folder.alias("dir"), F.element_at(F.split("path1", "/"), -1).alias("name"))
    named = naming.allocate_names(change, stay).select(F.col("path").alias("path1"), F.concat_ws("/", "dir", "name").alias("new"))
    return f.join(named, "path1", "left").withColumn("path2", F.coalesce("new", "path1")).drop("new")


def paired(files: DataFrame, path: str = "path2") -> DataFrame:
    """``(doc_id, path3)``: the images beside a raw file and a .jpg of one folder and stem; those in sources go to the JPG band."""
    folder, name = F.regexp_replace(path, "/[^/]*$", ""), F.element_at(F.split(path, "/"), -1)
    f = files.withColumn("_folder", folder).withColumn("_stem", F.regexp_replace(name, r"\.[^.]*$", ""))
    pair = f.groupBy("_folder", "_stem").agg(F.bool_or(F.col("class") == "raw").alias("raw"), F.bool_or((F.col("class") == "image") & F.lower("path").endswith(".jpg")).alias("jpg")).where("raw AND jpg")
    images = f.where("class = 'image'").join(pair, ["_folder", "_stem"], "left_semi")
    to = F.when(F.col(path).startswith("sources/"), F.concat(F.lit("jpgs/"), F.element_at(F.split(path, "/"), -1))).otherwise(F.col(path))
    return images.select("doc_id", to.alias("path3"))


def content_groups(files: DataFrame, without: DataFrame) -> DataFrame:
    """Media with a valid hash that are no paired image: the files that may be each other's copies."""
    return files.where("class <> 'other' AND status = 'valid'").join(without.select("doc_id"), "doc_id", "left_anti")


def hash_failures(files: DataFrame, without: DataFrame) -> DataFrame:
    """Media outside by-dest without a valid hash: each blocks the plan."""
    bad = files.where("class <> 'other' AND top <> 'by-dest' AND (status IS NULL OR status <> 'valid')")
    return bad.join(without.select("doc_id"), "doc_id", "left_anti").select("path", F.coalesce("status", F.lit("none")).alias("status"))


def duplicates(files: DataFrame, path: str = "path3") -> DataFrame:
    """``(doc_id, retained)`` of the files that go to quarantine: all of a group but the first by band and original path; by-dest stays."""
    named = files.withColumn("_p", F.col(path)).withColumn("original", F.col("path"))
    order = [scalar.priority(F.col("_p"), RETAIN), F.col("original")]
    kept = relational.keep_first(named.withColumn("path", F.col("_p")), ["fp", "class"], order)
    return kept.where("NOT kept AND top <> 'by-dest'").select("doc_id", "retained")


def organised(files: DataFrame, path: str = "path3") -> DataFrame:
    """``(doc_id, path4)`` of the files that are not where they belong: strays, dated files and files without a time.

    A dated file belongs in ``band/YYYY-MM-DD/`` under its time's name; names of files that stay are taken.
    """
    p = F.col(path)
    t = scalar.naive_time(F.col("taken"))
    parts = F.split(p, "/")
    top = parts[0]
    day = F.date_format(t, "yyyy-MM-dd")
    f = files.withColumn("_top", top).withColumn("_name", F.element_at(parts, -1)).withColumn("_day", day)
    stray = f.where("class = 'other' AND _top = 'sources'").select("doc_id", F.concat(F.lit("strays/"), F.expr(f"substr({path}, 9)")).alias("path4"))
    media = f.where("class <> 'other'")
    in_band = F.col("_top").isin("by-date", "videos")
    stays = F.col("_top").isin("missing", "jpgs", "by-dest") | F.coalesce(in_band & (F.size(parts) == 3) & (parts[1] == F.col("_day")), F.lit(False))
    taken = media.where(stays).select(F.lit("").alias("dir"), F.col("_name").alias("name"))
    band = F.when(F.col("class") == "video", "videos").otherwise("by-date")
    goes = media.where(~stays).withColumn("_dir", F.when(t.isNull(), "missing").otherwise(F.concat_ws("/", band, "_day")))
    base = F.when(t.isNull(), F.concat(F.lit("UNKN_"), F.regexp_replace("_name", r"\.[^.]*$", ""))).otherwise(F.date_format(t, "yyyy-MM-dd--HH-mm-ss"))
    wanted = goes.select(F.lit("").alias("dir"), F.concat_ws("|", F.col("path"), F.col("doc_id").cast("string")).alias("path"), base.alias("base"), F.regexp_extract("_name", r"\.([^.]*)$", 1).alias("ext"))
    named = naming.allocate_names(wanted, taken).select(F.element_at(F.split("path", r"\|"), -1).cast("long").alias("doc_id"), "name")
    return stray.union(goes.select("doc_id", "_dir").join(named, "doc_id").select("doc_id", F.concat_ws("/", "_dir", "name")))


def plan(files: DataFrame) -> DataFrame:
    """Every file's way (eager: stages are written in between): ``doc_id, path, path1 .. path4, final, step`` (the last stage that moved it, or ``keep``)."""
    f = cut(normalised(files))
    pairs = paired(f)
    f = cut(f.join(pairs.withColumn("paired", F.lit(True)), "doc_id", "left").withColumn("path3", F.coalesce("path3", "path2")))
    dup = duplicates(content_groups(f, f.where("paired")))
    f = cut(f.join(dup, "doc_id", "left"))
    placed = organised(f.where("retained IS NULL AND top <> 'by-dest'"))
    f = f.join(placed, "doc_id", "left")
    final = F.when(F.col("retained").isNotNull(), F.concat(F.lit("quarantine/"), F.col("path3"))).otherwise(F.coalesce("path4", "path3"))
    step = (
        F.when(F.col("retained").isNotNull(), "quarantine").when(F.col("path4").startswith("strays/"), "stray").when(F.col("path4").isNotNull(), "organise")
        .when(F.col("path3") != F.col("path2"), "separate").when(F.col("path2") != F.col("path1"), "normalise").when(F.col("path1") != F.col("path"), "initialise").otherwise("keep")
    )
    return f.select("doc_id", "path", "path1", "path2", "path3", "path4", "retained", final.alias("final"), step.alias("step"), "class", "size", "mtime_ns", "fp", "top", "taken")


def operations(planned: DataFrame) -> DataFrame:
    """``(doc_id, seq, action, source, destination)``: a row per stage that moves the file, in order."""
    steps = [("initialise", "path", "path1"), ("normalise", "path1", "path2"), ("separate", "path2", "path3"), ("organise", "path3", "path4")]
    each = [F.when(F.col(a) != F.col(b), F.struct(F.lit(i).alias("seq"), F.when(F.col(b).startswith("strays/"), "stray").otherwise(name).alias("action"), F.col(a).alias("source"), F.col(b).alias("destination"))) for i, (name, a, b) in enumerate(steps)]
    each.append(F.when(F.col("retained").isNotNull(), F.struct(F.lit(4).alias("seq"), F.lit("quarantine").alias("action"), F.col("path3").alias("source"), F.col("final").alias("destination"))))
    return planned.select("doc_id", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("o")).select("doc_id", "o.*")


def cache_effects(files: DataFrame, rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``(path, action)``: rows to write for files that stay and differ from their row, rows that a recognised move
    carries over, and rows to remove; a moved file's row is written by its own operation."""
    state = decisions(files, rows)
    was = F.col("was")
    stays = planned.where("step = 'keep'").select("doc_id")
    same = was.isNotNull() & (was["size"] == F.col("size")) & (was["mtime_ns"] == F.col("mtime_ns")) & metadata_fresh() & was["fp"].eqNullSafe(F.col("fp"))
    write = state.where(F.col("source").isNull() & ~same).join(stays, "doc_id", "left_semi").select("path", F.lit("upsert").alias("action"))
    carry = state.where("source IS NOT NULL").select("path", F.lit("carry").alias("action"))
    return write.union(carry).union(ghosts(files, rows).select("path", F.lit("remove").alias("action")))


def emptied(planned: DataFrame) -> DataFrame:
    """Folders that hold nothing any more, with all below them, once the plan is done."""
    above = lambda c: F.explode(scalar.ancestors(F.col(c)))
    before, after = planned.select(above("path").alias("folder")).distinct(), planned.select(above("final").alias("folder")).distinct()
    return before.join(after, "folder", "left_anti")


def problems(moves: DataFrame, files: DataFrame) -> DataFrame:
    """``(seq, problem)`` of an ordered list of moves ``(seq, kind, source, destination, size)`` against an inventory:
    unknown kinds, moves in or out of by-dest, sources that are missing or changed, and targets that are taken.

    A path's history is its file at the start and the arrivals and departures in order; a target is taken if another
    file is there then.
    """
    known = F.col("kind").isin("move", "rename", "quarantine")
    fixed = F.col("source").startswith("by-dest/") | F.col("destination").startswith("by-dest/")
    first = moves.withColumn("first", F.min("seq").over(relational.by("source")))
    here = files.select(F.col("path").alias("source"), F.col("size").alias("is"))
    arrives = moves.groupBy(F.col("destination").alias("source")).agg(F.min("seq").alias("made"))
    checked = first.join(here, "source", "left").join(arrives, "source", "left")
    own = (F.col("seq") == F.col("first")) & (F.col("made").isNull() | (F.col("made") >= F.col("seq")))
    simple = checked.select("seq", F.when(~known, "unknown kind").when(fixed, "by-dest is fixed").when(own & F.col("is").isNull(), "source is missing").when(own & (F.col("is") != F.col("size")), "source has changed").alias("problem"))
    events = files.select(F.lower("path").alias("path"), F.lit(-1).cast("long").alias("seq"), F.lit(1).alias("delta"))
    events = events.union(moves.select(F.lower("source"), "seq", F.lit(-1))).union(moves.select(F.lower("destination"), "seq", F.lit(1)))
    taken = relational.clobbers(events).where("seq >= 0").select("seq", F.lit("target is taken").alias("problem"))
    return simple.where("problem IS NOT NULL").union(taken).distinct()


def executed(files: DataFrame, rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The recorded rows ``(path, size, mtime_ns, fp)`` once the plan is carried out: rows of vanished and moved files go, a
    moved file's row stands at its end (strays are not recorded), and what changed in place is written anew."""
    facts = ["size", "mtime_ns", "fp"]
    effects = cache_effects(files, rows, planned)
    gone = effects.where("action = 'remove'").select("path").union(planned.where("step <> 'keep'").select("path"))
    moved = planned.where("step NOT IN ('keep', 'stray')").select(F.col("final").alias("path"), *facts)
    written = files.join(effects.where("action <> 'remove'").select("path"), "path", "left_semi").join(planned.where("step = 'keep'").select("path"), "path", "left_semi").select("path", *facts)
    left = rows.select("path", *facts).join(gone, "path", "left_anti")
    return relational.upsert(left, moved.union(written), "path")
