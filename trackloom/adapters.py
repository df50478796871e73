"""The driver's tables as the domain's relations, for Spark and (as CTEs) for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import ship

CLASSES = {"jpg": "image", "tif": "image", "arw": "raw", "mp4": "video"}

_SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rel(self, name: str) -> DataFrame:
        """One of ``RELATIONS``."""
        text = RELATIONS[name]
        return self.spark.sql(text, **{n: self.rel(n) if n in RELATIONS else getattr(self, n) for n in _uses(text)})

    def values(self, text: str, columns: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM (VALUES {text}) AS v({columns})")

    def _events(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id", "user_id", "event_type", f"{_SECONDS} AS t", "50 + value / 5000 AS lat",
            "4 + cast(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT) / 25000D AS lon",
        )

    def track(self) -> DataFrame:
        return self._events().where("event_type = 'view'").selectExpr("t", "lat", "lon", "concat('t', user_id % 3) AS file", "event_id AS idx")

    def photos(self) -> DataFrame:
        return self._events().where("event_type IN ('click', 'purchase')").selectExpr(
            "concat('root/c', user_id % 5, '/s', user_id % 15) AS dest", "concat('root/c', user_id % 5, '/s', user_id % 15, '/', event_id) AS path",
            "user_id % 6 AS grp", "t", "t - (user_id % 6 * 1800 - 3600) AS naive", "event_id % 3 = 0 AS native", "lat", "lon",
        )

    def files(self) -> DataFrame:
        return self.documents.selectExpr(
            "doc_id", "doc_id % 6 AS prio", "coalesce(n_chars, 0) AS size", "sha2(text, 256) AS fp",
            "concat('f', doc_id % 6, '/', source, '/', doc_id, '.', CASE lang WHEN 'en' THEN 'JPG' WHEN 'fr' THEN 'arw' WHEN 'de' THEN 'mp4' ELSE 'txt' END) AS path",
        )

    def cache(self) -> DataFrame:
        return self.files().where("doc_id % 10 <> 0").selectExpr("path", "CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS c_size", "fp AS c_fp", "CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 2 END AS engine")

    def names(self) -> DataFrame:
        return self.part.selectExpr("p_partkey", "concat('d', p_size % 7) AS dir", "concat(p_brand, CASE WHEN p_partkey % 4 = 0 THEN concat('-', lpad(cast(p_partkey % 50 + 1 AS STRING), 3, '0')) ELSE '' END, '.jpg') AS name")


#: Relations whose SQL both engines read; ``{name}`` stands for a table or another of them.
RELATIONS = {
    # An inventory of files in bands (folders of the top level), some paired, some already in place.
    "inv": """SELECT doc_id, folder || '/' || stem || '.' || ext AS path, folder, split_part(folder, '/', 1) AS top, stem, ext,
  CASE lower(ext) WHEN 'jpg' THEN 'image' WHEN 'tif' THEN 'image' WHEN 'arw' THEN 'raw' WHEN 'mp4' THEN 'video' ELSE 'other' END AS class, size, mtime_ns, fp, status, taken
FROM (SELECT doc_id, coalesce(cast(n_chars AS BIGINT), 0) AS size, 1700000000000000000 + doc_id % 1000 AS mtime_ns, md5(text) AS fp, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 41 = 0 THEN 'failed' ELSE 'valid' END AS status,
  CASE WHEN doc_id % 6 = 5 THEN NULL ELSE '2024:01:' || lpad(cast(1 + doc_id % 20 AS STRING), 2, '0') || ' 10:' || lpad(cast(cast(floor(doc_id / 40) AS BIGINT) % 5 AS STRING), 2, '0') || ':00' END AS taken,
  'IMG_' || cast(cast(floor(doc_id / 18) AS BIGINT) AS STRING) AS stem,
  CASE WHEN doc_id % 18 >= 9 THEN CASE WHEN doc_id % 5 = 0 THEN 'JPG' ELSE 'jpg' END WHEN doc_id % 4 = 0 THEN 'arw' WHEN doc_id % 4 = 1 THEN 'TIF' WHEN doc_id % 4 = 2 THEN 'mp4' ELSE 'txt' END AS ext,
  CASE doc_id % 9 WHEN 3 THEN 'by-date/2024-01-' || CASE WHEN doc_id % 4 = 0 THEN '31' ELSE lpad(cast(1 + doc_id % 20 AS STRING), 2, '0') END WHEN 4 THEN 'by-date'
    WHEN 5 THEN 'by-dest/c' || cast(doc_id % 5 AS STRING) || '/s' || cast(doc_id % 3 AS STRING) WHEN 6 THEN 'videos/2024-01-' || lpad(cast(1 + doc_id % 20 AS STRING), 2, '0')
    WHEN 7 THEN 'missing' WHEN 8 THEN 'Dump' || cast(doc_id % 2 AS STRING) ELSE 'sources/d' || cast(doc_id % 3 AS STRING) END AS folder FROM {documents}) AS d""",
    # What was recorded of them before: some changed since, some moved, some gone.
    "rows": """SELECT doc_id, CASE WHEN top = 'by-dest' AND doc_id % 4 = 1 THEN 'by-date/old/' || stem || '.' || ext WHEN doc_id % 29 = 0 THEN 'sources/gone/' || stem || '.' || ext ELSE path END AS path,
  CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 13 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns, class, fp, status, CASE WHEN doc_id % 11 = 0 THEN '6' ELSE '7' END AS engine,
  'reader' AS extractor, CASE WHEN doc_id % 17 = 0 THEN '12.1' ELSE '12.2' END AS extractor_version, 3 AS field_set, 'o1' AS options, 1 AS schema_version, CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 2 END AS key_version,
  CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS md_size, CASE WHEN doc_id % 13 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS md_mtime_ns, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE fp END AS md_fp FROM {inv} WHERE doc_id % 10 <> 0""",
    # Photos of the handoff, renames that were planned for them, and a library that holds some of their targets.
    "handoff": "SELECT doc_id, path, folder, fp, class, size, mtime_ns FROM {inv} WHERE top = 'by-dest' AND class IN ('image', 'raw') AND fp IS NOT NULL",
    "renames": "SELECT fp, max('2024-01-' || lpad(cast(1 + cast(floor(doc_id / 45) AS BIGINT) % 12 AS STRING), 2, '0') || CASE WHEN doc_id % 7 < 4 THEN '.jpg' ELSE '.JPG' END) AS new_name FROM {handoff} WHERE doc_id % 5 <> 0 GROUP BY fp",
    "library": """SELECT lib_dest, name, max(fp) AS fp, min(readable) AS readable FROM (
  SELECT substr(h.folder, 9) AS lib_dest, CASE WHEN h.doc_id % 8 = 0 THEN upper(coalesce(r.new_name, h.path)) ELSE coalesce(r.new_name, element_at(split(h.path, '/'), -1)) END AS name,
    CASE WHEN h.doc_id % 8 = 2 THEN h.fp ELSE 'other' END AS fp, h.doc_id % 8 <> 6 AS readable FROM {handoff} AS h LEFT JOIN {renames} AS r ON r.fp = h.fp WHERE h.doc_id % 2 = 0) AS x GROUP BY lib_dest, name""",
    # Operations of a plan, what a journal says of them, and their order.
    "ops": """SELECT l_orderkey * 10 + l_linenumber AS op, l_partkey AS item, l_orderkey % 100 AS dest, CASE l_returnflag WHEN 'A' THEN 'move' WHEN 'N' THEN 'rename' ELSE 'quarantine' END AS kind, l_linestatus AS state FROM {lineitem}""",
    "results": """SELECT op, CASE WHEN op % 7 = 0 THEN 'failed' WHEN op % 5 = 0 THEN 'skipped' WHEN op % 11 = 0 THEN 'mismatch' ELSE 'applied' END AS result FROM {ops} WHERE op % 13 <> 0""",
}


def _uses(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


CTE = {
    "ev": """ev AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS t, 50 + value / 5000 AS lat,
  4 + regexp_extract(props, '"k": *(-?[0-9]+)', 1)::INT / 25000::DOUBLE AS lon FROM events)""",
    "track": "track AS (SELECT t, lat, lon, 't' || (user_id % 3) AS file, event_id AS idx FROM ev WHERE event_type = 'view')",
    "photos": """photos AS (SELECT 'root/c' || (user_id % 5) || '/s' || (user_id % 15) AS dest, 'root/c' || (user_id % 5) || '/s' || (user_id % 15) || '/' || event_id AS path,
  user_id % 6 AS grp, t, t - (user_id % 6 * 1800 - 3600) AS naive, event_id % 3 = 0 AS native, lat, lon FROM ev WHERE event_type IN ('click', 'purchase'))""",
    "files": """files AS (SELECT doc_id, doc_id % 6 AS prio, coalesce(n_chars, 0) AS size, sha256(text) AS fp,
  'f' || (doc_id % 6) || '/' || source || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'JPG' WHEN 'fr' THEN 'arw' WHEN 'de' THEN 'mp4' ELSE 'txt' END AS path FROM documents)""",
    "cache": """cache AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS c_size, fp AS c_fp, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 2 END AS engine
  FROM files WHERE doc_id % 10 <> 0)""",
    "names": """names AS (SELECT p_partkey, 'd' || (p_size % 7) AS dir, p_brand || CASE WHEN p_partkey % 4 = 0 THEN '-' || lpad((p_partkey % 50 + 1)::VARCHAR, 3, '0') ELSE '' END || '.jpg' AS name FROM part)""",
    "bracket": """bracket AS (SELECT p.*, b.t AS bt, b.lat AS blat, b.lon AS blon, b.idx AS bidx, a.t AS at_, a.lat AS alat, a.lon AS alon, a.idx AS aidx
  FROM photos p ASOF LEFT JOIN track b ON b.t <= p.t ASOF LEFT JOIN track a ON a.t > p.t)""",
}
_NEEDS = {"track": ["ev"], "photos": ["ev"], "cache": ["files"], "bracket": ["track", "photos"]}


def with_(*names: str) -> str:
    """``WITH`` and the CTEs named, with those they need."""
    order: dict[str, str] = {}

    def add(n: str) -> None:
        if n in RELATIONS:
            for x in _uses(RELATIONS[n]):
                if x in RELATIONS:
                    add(x)
            text = RELATIONS[n].replace("element_at(split(h.path, '/'), -1)", "string_split(h.path, '/')[-1]")
            order.setdefault(n, f"{n} AS ({re.sub('[{}]', '', text)})")
        else:
            for x in _NEEDS.get(n, []):
                add(x)
            order.setdefault(n, CTE[n])

    for n in names:
        add(n)
    return "WITH " + ",\n".join(order.values()) + "\n"
