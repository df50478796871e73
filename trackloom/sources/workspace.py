"""Workspace folders, handoff documents, metadata dumps, configuration and media bytes as relations.

Folders are listed by Spark's own reader, so any store it reads will do; contents are read only where a column asks for them.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

#: Fields that name a camera, in this order; fixed.
IDENTITY = ("Make", "Model", "BodySerialNumber", "OwnerName")
TIMES = ("DateTimeOriginal", "CreateDate", "ModifyDate")
_FIELDS = "SourceFile string, DateTimeOriginal string, CreateDate string, ModifyDate string, OffsetTimeOriginal string, Make string, Model string, BodySerialNumber string, OwnerName string, GPSLatitude double, GPSLongitude double, GPSProcessingMethod string, Error string"
DEFAULTS = {"direct_s": "60", "gap_s": "1800", "distance_m": "1000", "speed_kmh": "150", "reach_s": "300"}


def inventory(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """``(path, size, modified[, content])`` of every file below ``root`` that is neither hidden nor empty, paths relative to it."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.substring("path", F.lit(len(base) + 2), F.length("path"))
    return found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *[F.col("content")] * content)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size)`` of every file below ``root``, also hidden and empty ones, which Spark's reader leaves out.

    The names are listed on the driver, as the reader's are; contents are not read."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    n = len(fs.makeQualified(base).toString().rstrip("/")) + 1
    found, rows = fs.listFiles(base, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString()[n:], f.getLen()))
    return spark.createDataFrame([r for r in rows if not r[0].endswith(".crc")], "path string, size long")


def hidden(files: DataFrame) -> DataFrame:
    """Files with a part of their path that begins with a dot."""
    return files.where(F.col("path").rlike(r"(^|/)\."))


def visible(files: DataFrame, skip: tuple[str, ...] = ("strays", "tracks")) -> DataFrame:
    """What an inventory covers: no hidden file, and none of the folders that are set aside."""
    return files.where(~F.col("path").rlike(r"(^|/)\.")).where(~F.split("path", "/")[0].isin(*skip))


def media(files: DataFrame, folder: str, classes: dict[str, str]) -> DataFrame:
    """``(path, class)`` of a folder's files."""
    return files.where(F.col("path").startswith(f"{folder}/")).select("path", scalar.media_class(F.col("path"), classes).alias("class"))


def listing(files: DataFrame) -> DataFrame:
    """``(dir, name)``: the names in every folder."""
    return files.select(F.when(F.instr("path", "/") == 0, "").otherwise(F.regexp_replace("path", "/[^/]*$", "")).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"))


def metadata(dumps: DataFrame, text: str = "text", folder: str = "folder") -> tuple[DataFrame, DataFrame]:
    """Metadata records of JSON dumps, one dump (an array of records) a folder; and the folders whose dump is none.

    Records have the fixed fields, ``camera`` (the identity fields that are set, trimmed, by a pipe), ``taken`` and
    ``taken_tag`` (the first time that is set), ``has_gps, has_time`` and ``status``.
    """
    parsed = dumps.select(F.col(folder).alias("folder"), F.from_json(text, f"array<struct<{_FIELDS.replace(' string', ': string').replace(' double', ': double')}>>", {"mode": "PERMISSIVE"}).alias("records"), F.col(text).alias("raw"))
    failed = parsed.where("records IS NULL OR size(filter(records, x -> x.SourceFile IS NOT NULL)) = 0").select("folder", F.lit("folder_metadata_extraction_failed").alias("reason"))
    r = parsed.select("folder", F.explode("records").alias("r")).where("r.SourceFile IS NOT NULL").select("folder", "r.*")
    set_ = lambda c: F.nullif(F.col(c), F.lit(""))
    tag = F.coalesce(*[F.when(set_(c).isNotNull(), F.lit(c)) for c in TIMES])
    status = F.when(tag.isNotNull() | set_("Make").isNotNull() | set_("Model").isNotNull(), "extracted_ok").otherwise("extracted_empty")
    r = r.withColumns({"camera": scalar.camera_key(*[F.col(c) for c in IDENTITY]), "taken": F.coalesce(*[set_(c) for c in TIMES]), "taken_tag": tag, "has_gps": F.col("GPSLatitude").isNotNull() & F.col("GPSLongitude").isNotNull(), "has_time": tag.isNotNull(), "status": status})
    return r, failed


HANDOFF = "files array<struct<relative_path: string, folder_class: string, media_class: string, size: bigint, mtime_ns: bigint, content_hash: string, metadata: struct<camera: string, has_gps: boolean, parsed: string>>>"


def handoff(documents: DataFrame, text: str = "text", folder: str = "by-dest") -> DataFrame:
    """The photos of handoff documents under ``folder``: ``path, dest, size, mtime_ns, fp, class, camera, taken, native, lat, lon``."""
    f = documents.select(F.explode(F.from_json(text, HANDOFF)["files"]).alias("f")).select("f.*").where((F.col("folder_class") == folder) & F.col("media_class").isin("image", "raw"))
    p = F.from_json("metadata.parsed", "camera string, taken string, has_gps boolean, lat double, lon double")
    f = f.withColumn("p", p)
    native = F.coalesce("metadata.has_gps", "p.has_gps", F.lit(False))
    return f.select(
        F.col("relative_path").alias("path"), F.regexp_replace("relative_path", "/[^/]*$", "").alias("dest"), "size", "mtime_ns", F.get_json_object("content_hash", "$.value").alias("fp"), F.col("media_class").alias("class"),
        F.coalesce("metadata.camera", "p.camera", F.lit("unknown")).alias("camera"), F.col("p.taken").alias("taken"), native.alias("native"), F.when(native, F.col("p.lat")).alias("lat"), F.when(native, F.col("p.lon")).alias("lon"),
    )


def config(given: DataFrame, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """``(workspace, key, value, digest)``: a workspace's own value where it has one, else the default, and the digest of the whole."""
    spark = given.sparkSession
    keys = spark.createDataFrame(sorted(defaults.items()), "key string, value string")
    every = given.select("workspace").distinct().crossJoin(F.broadcast(keys))  # some ten keys
    own = given.select("workspace", "key", F.col("value").alias("own"))
    full = every.join(own, ["workspace", "key"], "left").select("workspace", "key", F.coalesce("own", "value").alias("value"))
    digest = full.groupBy("workspace").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda x: F.concat_ws("=", x["key"], x["value"])), "\n"), 256).alias("digest"))
    return full.join(digest, "workspace")


def signature(data: bytes) -> tuple[str, str | None]:
    """Status and fingerprint of media bytes that rewritten metadata leave as they are.

    A JPEG's is over its segments without those of applications and comments; an AVI's or MP4's over its media
    lists and boxes alone; any other bytes have none.
    """
    h = hashlib.sha256()
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xDA:
                h.update(data[at:])
                return "valid", h.hexdigest()
            if not (0xE0 <= marker <= 0xEF or marker == 0xFE):
                h.update(data[at : at + 2 + size])
            at += 2 + size
        return "failed", None
    big = data[4:8] == b"ftyp"
    if big or data[:4] == b"RIFF":
        at, found = (0, False) if big else (12, False)
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big") if big else int.from_bytes(data[at + 4 : at + 8], "little") + 8
            name = data[at + 4 : at + 8] if big else data[at + 8 : at + 12] if data[at : at + 4] == b"LIST" else data[at : at + 4]
            if name in (b"mdat", b"movi"):
                h.update(data[at + 8 : at + size])
                found = True
            if size < 8:
                break
            at += size + (0 if big else size & 1)
        return ("valid", h.hexdigest()) if found else ("failed", None)
    return "failed", None


def _signatures(content: pd.Series) -> pd.DataFrame:
    rows = [signature(bytes(c)) if c is not None else ("failed", None) for c in content]
    return pd.DataFrame(rows, columns=["status", "value"])


def fingerprint(content: Column) -> Column:
    """``{status, value}`` of media bytes; reading a byte format is beyond SQL functions."""
    return F.pandas_udf(_signatures, "status string, value string")(content)


def document(value: object) -> str:
    """A document's text: keys sorted, two blanks a level, a line's end at the end."""
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
