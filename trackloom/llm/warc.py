"""WARC: a Spark-side writer and a Python data source that reads archives.

Writing: one record per page.  Pages with equal payloads of at least
``least_bytes`` bytes share a digest; the one with the smallest id is a
``response``, the others are ``revisit`` records that name it.  Groups are found
by a plain aggregation on the digest; records are text, so Spark's own text
writer stores them in any file system, with the record's closing CRLF CRLF as
line separator, in files of bounded size.

Reading (``spark.read.format("warc")``) takes any WARC file, plain or with
gzipped records.  The driver lists files and plans partitions by size: small
files are packed together, a plain file of more than ``splitBytes`` is read by
several tasks (each hops over the records before its range by their lengths,
without reading payloads, so a record belongs to the range it begins in).  A
gzipped file is one task's, as a stream.  Filters on record type, record id,
digest, url and date are pushed down; a reader parses a record's headers first and
skips the payload, undecoded, when a filter rejects the record or the payload is
not asked for.

Columns: ``record_id, record_type, date, url, content_type, payload_digest
(without its algorithm), block_bytes, payload_bytes, refers_to, headers (names in
lower case), payload``.  The payload of a record with an HTTP head is what
follows that head; of any other the whole block; of a revisit null.  Its bytes
are counted from the payload where that is read; else they are the length that
the writer put in ``X-Payload-Length``, or null.

Defined cases: a null payload is empty; a null url is written without target
and read back as null; a page without id gets a random record id and
is never a group's response unless all of the group's are without; repeated rows
are records of their own, equal ids with equal payloads both being responses.
An empty table writes an empty archive.  What is no WARC record raises
ValueError with its place.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from .common import scratch_path, small_or_shuffled

SEPARATOR = "\r\n\r\n"
SCHEMA = (
    "record_id string, record_type string, date string, url string, content_type string, payload_digest string, block_bytes long, payload_bytes long, "
    "refers_to string, headers map<string,string>, payload binary"
)
#: Bytes of payload of one file that is written, about.
FILE_BYTES = 128_000_000


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """``(page_id, url, payload, digest, bytes, refers_to)``; refers_to is null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    # Only digests that stand more than once are joined back; payloads are shuffled only where those are too many to broadcast.
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select(F.unhex("digest").alias("d"), "first")
    joined = rows.join(small_or_shuffled(groups, "digests"), F.unhex(rows.digest) == F.col("d"), "left")
    return joined.select("page_id", "url", "payload", "digest", "bytes", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write(records: DataFrame, path: str, date: str | None = None) -> None:
    """Write planned records as uncompressed WARC/1.1 files under ``path``; ``date`` is their capture time (now, if none is given)."""
    stamp = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    crlf, revisit = F.lit("\r\n"), F.col("refers_to").isNotNull()

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, crlf)

    # A target URI must stay on its line.
    url = F.regexp_replace("url", "[\r\n]", " ")
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", stamp),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.coalesce(F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        crlf,
    )
    # A page's html is some 10 kB; a file of unusual ones is split when read.
    records.select(F.concat(head, body).alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", max(1, FILE_BYTES // 10_000)).text(path)


class WarcPartition(InputPartition):
    """Ranges of files: path, first byte, end."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(0)
        self.ranges = ranges


def _system(path: str):
    """File system and path: local by plain files, others through Arrow."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class Plain:
    """Bytes of a plain file by position; a window of it is held."""

    def __init__(self, f):
        self.f, self.size, self.base, self.held = f, f.size(), 0, b""

    def at(self, start: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``start`` on."""
        a = start - self.base
        if a < 0 or a + n > len(self.held) and self.base + len(self.held) < self.size:
            self.f.seek(start)
            self.base, self.held, a = start, self.f.read(max(n, 1 << 16)), 0
        return self.held[a : a + n]

    def more(self, start: int) -> bool:
        return start < self.size


class Unzipped:
    """Bytes of a gzipped file (of any number of members) by position, forward only; what lies behind is given up."""

    def __init__(self, f):
        self.f, self.base, self.held, self.rest = f, 0, bytearray(), b""
        self.z, self.end = zlib.decompressobj(31), False

    def _grow(self) -> None:
        data = self.rest or self.f.read(1 << 18)
        self.rest = b""
        if not data:
            self.end = True
            return
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        # At most so many bytes at once, however well they are compressed.
        self.held += self.z.decompress(data, 1 << 22)
        self.rest = self.z.unconsumed_tail or self.z.unused_data
        if self.z.eof:
            self.rest = self.rest.lstrip(b"\0")

    def at(self, start: int, n: int) -> bytes:
        while not self.end and self.base + len(self.held) < start + n:
            if self.base < start:
                gone = min(len(self.held), start - self.base)
                del self.held[:gone]
                self.base += gone
            self._grow()
        return bytes(self.held[start - self.base : start - self.base + n])

    def more(self, start: int) -> bool:
        return bool(self.at(start, 1))


#: First line of a response or a request.
_HTTP = re.compile(rb"HTTP/|[A-Z]+ \S+ HTTP/")
_ORDERED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b)}
_PUSHED = {("record_id",), ("record_type",), ("date",), ("url",), ("payload_digest",), ("refers_to",), ("content_type",)}


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = options["path"]
        self.target = int(options.get("partitionbytes", 32_000_000))
        self.split = int(options.get("splitbytes", 256_000_000))
        self.names = schema.fieldNames()
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) in _PUSHED and (type(f) in _ORDERED or isinstance(f, In)):
                self.filters.append((f.attribute[0], type(f), tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def wants(self, row: dict) -> bool:
        for name, kind, value in self.filters:
            has = row[name]
            if has is None or not (has in value if kind is In else _ORDERED[kind](has, value)):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        system, root = _system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        ranges = []
        for i in found:
            if i.type == fs.FileType.File and i.size and not os.path.basename(i.path).startswith(("_", ".")):
                parts = 1 if i.path.endswith(".gz") else -(-i.size // self.split)
                ranges += [(i.path, i.size * k // parts, i.size * (k + 1) // parts) for k in range(parts)]
        groups, size = [[]], 0
        for r in sorted(ranges, key=lambda r: (r[1] - r[2], r)):
            if groups[-1] and size + r[2] - r[1] > self.target:
                groups, size = [*groups, []], 0
            groups[-1].append(r)
            size += r[2] - r[1]
        return [WarcPartition(g) for g in groups]

    def read(self, partition):
        system, _ = _system(self.path)
        rows, held = [], 0
        for path, start, end in partition.ranges:
            with system.open_input_file(path) as f:
                zipped = f.read(2) == b"\x1f\x8b"
                f.seek(0)
                for row, size in self._records(Unzipped(f) if zipped else Plain(f), start, None if zipped else end, path):
                    rows.append(row)
                    held += size + 500
                    if held > 4_000_000:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _records(self, data, start: int, end: int | None, path: str):
        """Rows of the records that begin in the range, with their bytes."""
        want, at = "payload" in self.names, 0
        while (end is None or at < end) and data.more(at):
            # Headers first: enough bytes to hold them.
            need = 4096
            while True:
                some = data.at(at, need)
                close = some.find(b"\r\n\r\n")
                if close >= 0 or len(some) < need:
                    break
                need *= 4
            if not some.strip(b"\r\n"):
                return  # blank lines at the end
            if not some.startswith(b"WARC/") or close < 0:
                raise ValueError(f"no WARC record begins at byte {at} of {path}")
            # A line that begins with a blank goes on with the header before it.
            lines = re.sub(rb"\r\n[ \t]+", b" ", some[:close]).decode("utf-8", "replace").split("\r\n")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if not head.get("content-length", "").isdigit():
                raise ValueError(f"a record without a length at byte {at} of {path}")
            body, length = at + close + 4, int(head["content-length"])
            mine, at = at >= start, body + length + 4
            if not mine:
                continue
            kind = head.get("warc-type")
            row = {
                "record_id": head.get("warc-record-id", "").strip("<>") or None, "record_type": kind, "date": head.get("warc-date"), "url": head.get("warc-target-uri"),
                "content_type": head.get("content-type"), "payload_digest": head["warc-payload-digest"].partition(":")[2] if ":" in head.get("warc-payload-digest", "") else head.get("warc-payload-digest"),
                "block_bytes": length, "refers_to": head.get("warc-refers-to", "").strip("<>") or None, "headers": list(head.items()), "payload": None,
            }
            if not self.wants(row):
                continue
            row["payload_bytes"] = int(head["x-payload-length"]) if head.get("x-payload-length", "").isdigit() else None
            if want and kind != "revisit":
                block = data.at(body, length)
                if len(block) < length:
                    raise ValueError(f"{path} ends inside a record")
                if _HTTP.match(block) and (row["content_type"] or "").startswith("application/http"):
                    cut = block.find(b"\r\n\r\n")
                    block = block[cut + 4 :] if cut >= 0 else b""
                row["payload"], row["payload_bytes"] = block, len(block)
            yield row, len(row["payload"] or b"")

    def _batch(self, rows):
        kinds = {"payload_bytes": pa.int64(), "block_bytes": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in self.names], self.names)


class WarcDataSource(DataSource):
    """Options: ``path``; ``partitionBytes`` (32 MB) and ``splitBytes`` (256 MB); ``payload=false`` leaves payloads unread."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA if self.options.get("payload", "true") == "true" else SCHEMA.rpartition(",")[0]

    def reader(self, schema):
        return WarcReader(self.options, schema)


def read(spark: SparkSession, path: str, payload: bool = True, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).options(**options).load(path)


def page_of(urn: str) -> F.Column:
    """The page's id in a record id of this writer; null for others."""
    return F.nullif(F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")


def _verify(batches):
    """Digest and bytes of each payload as read."""
    for batch in batches:
        payload = batch.column("payload")
        digest = [hashlib.sha256(p.as_buffer()).hexdigest() for p in payload]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("payload_bytes"), pa.array(digest, pa.string()), batch.column("record_type"), batch.column("refers_to")], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and read the archives back: of responses the payloads, whose digests are
    computed from the bytes read; of revisits the headers alone."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(plan_records(pages), path)
    full = read(spark, path).where("record_type = 'response'").select(page_of("record_id").alias("page_id"), "payload_bytes", "payload", "record_type", page_of("refers_to").alias("refers_to"))
    full = full.mapInArrow(_verify, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    heads = read(spark, path, payload=False).where("record_type = 'revisit'")
    return full.union(heads.select(page_of("record_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to")))
