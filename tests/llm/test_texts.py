"""Packing, media, language, quality, HTML, URL filter and WARC."""

import gzip
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import entry, html_main, language, media, packing, quality, url_filter, warc

DOCS = "doc_id long, text string, lang string, n int"
ODD = ["", "it's we're ''s x'll y'd 'start a's's 12'th", "ÉCOLE ŒUVRE ß", "日本 <|endoftext|> x", "a b İ ſ", "don't \"'s\" o'clock 'S 'LL '", "ab 123 4.5", "'", " ' s", "'r", None, "x" * 9000, "a b " * 3000]


def test_packing(spark):
    tok = Tokenizer.from_file(entry.tokenizer_path())
    rows = [(i % 9, t, "en", 0) for i, t in enumerate(ODD * 3)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = packing.pack(docs, entry.tokenizer_path(), capacity=64, open_bins=3).collect()
    want = [tok.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _, _ in rows]
    pieces = [(d, p, p * 64, ids[p * 64 : p * 64 + 64]) for (d, *_), ids in zip(rows, want, strict=True) for p in range(-(-len(ids) // 64))]
    assert [(r.doc_id, r.piece, r.start, r.ids) for r in got] == pieces
    places = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in places.values():
        seq.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(seq, seq[1:], strict=False)) and seq[0][0] == 0 and sum(seq[-1]) <= 64
    assert packing.pack(spark.createDataFrame([], DOCS), entry.tokenizer_path()).collect() == []


def test_packer_is_best_fit_and_bounded():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [p.place(n) for n in (9, 8, 7, 1, 2)] == [(2, 0), (3, 0), (4, 0), (3, 8), (4, 7)]
    assert p.open <= 2


def payload(text):
    b = (text or "").encode()
    return b + b"\xff" * (-len(b) % 576 if b else 576)


def test_media_round_trip(spark):
    texts = [None, "", "abc", "abc", "é" * 900, "\x00\x7f߿" * 4000]
    rows = media.round_trip(spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], DOCS)).collect()
    for r, t in zip(rows, texts, strict=True):
        p = payload(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert tuple(rows[2])[1:] == tuple(rows[3])[1:] and tuple(rows[0])[1:] == tuple(rows[1])[1:]


def test_frames_with_ac_terms_and_errors():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (40, 576)).astype(np.uint8)
    colour, pixels = media.decode_frames(media.read_avi(media.write_avi(media.encode_frames(samples)))[0])
    assert (colour == samples).all() and not pixels
    # One block: DC 10, then the term after a run of one zero, then the end; quantiser 8.
    head = media.HEAD
    ac = bytes([0x10, 0, 2, *[0] * 14, 0x00, 0x13])
    at = head.index(b"\xff\xc4", head.index(b"\xff\xc4") + 2)
    size = int.from_bytes(head[at + 2 : at + 4], "big")
    frame_head = head[:at] + b"\xff\xc4" + (len(ac) + 2).to_bytes(2, "big") + ac + head[at + 2 + size :]
    sof = frame_head.index(b"\xff\xc0")
    frame_head = frame_head[: sof + 5] + (8).to_bytes(2, "big") * 2 + frame_head[sof + 9 :]
    bits = "0100" + "1010" + "01" + "101" + "00"
    bits += "1" * (-len(bits) % 8)
    frame = frame_head + int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\xff\xd9"
    _, pixels = media.decode_frames([frame])
    i = np.arange(8)
    want = 128 + 80 / 8 + 40 / (4 * np.sqrt(2)) * np.cos((2 * i + 1) * np.pi / 16)
    assert np.abs(pixels[0] - want[:, None]).max() <= 1 or np.abs(pixels[0] - want[None, :]).max() <= 1
    with pytest.raises(ValueError):
        media.read_avi(b"no media")
    with pytest.raises(ValueError):
        media.decode_frames([b"no frame"])


def test_shots_and_clips(spark):
    rng = np.random.default_rng(0)
    dark, light = rng.integers(0, 60, (20, 576)), rng.integers(180, 255, (15, 576))
    file = media.write_avi(media.encode_frames(np.concatenate((dark, light)).astype(np.uint8)))
    rows = media.clips(spark.createDataFrame([(1, bytearray(file)), (2, None)], "k long, m binary"), "k", "m").collect()
    assert [(r.id, r.clip, r.first_frame, r.frames, r.start_ms, r.end_ms) for r in rows] == [(1, 0, 0, 20, 0, 800), (1, 1, 20, 15, 800, 1400)]


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    held = language.identify(docs.where(language.held_out()), model, spans=False).join(docs, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    by = {r.lang: r.text for r in docs.where("n_chars > 400").collect()}
    mixed = by["en"][:300] + " " + by["de"][:300]
    rows = [(1, mixed, None, 0), (2, None, None, 0), (3, "", None, 0), (4, "12 34 !?", None, 0), (5, "—— €", None, 0), (6, by["fr"] * 30, None, 0)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, DOCS), model).collect()}
    assert {"en", "de"} <= {s.lang for s in got[1].spans} and got[1].spans[0].start == 0 and got[1].spans[-1].end <= len(mixed)
    assert [got[i].lang_pred for i in (2, 3, 4, 5, 6)] == ["und"] * 4 + ["fr"] and got[4].score == 0
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing, spans=False).collect()} == {"und"}


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        score = rng.normal(0, 3, (n + 3, 3)).astype(np.float32)
        got = language.viterbi(score, np.array([0, n, n, n + 3]), 2.0)
        for a, b in ((0, n), (n, n + 3)):
            paths = np.array(np.meshgrid(*[range(3)] * (b - a), indexing="ij")).reshape(b - a, -1).T
            value = [sum(score[a + t, s] for t, s in enumerate(p)) - 2.0 * np.count_nonzero(np.diff(p)) for p in paths]
            assert got[a:b].tolist() == paths[int(np.argmax(value))].tolist()


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()))
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    odd = {r.doc_id: r.score for r in quality.score(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], DOCS), model).collect()}
    assert odd[1] == odd[2] and 0 <= odd[1] <= 1
    empty = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(3), empty).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="main" class="content c%d"><article class="post-%d"><h1>The  Title</h1><p><b>First &amp; para<br>next.<p>Second &eacute; with <a href=x>link</a> in.</p><div class="ad ad-3">Buy</div>
<form><input>Sign</form><section class="comments"><p>Nice!</p></section></article></div><aside>side</aside><footer>&copy; x</footer></body></html>"""
MAIN = "The Title First & para next. Second é with link in."


def test_html(spark):
    other = "<html><body><div class='x'><p>Only this page is built so.</p></div></body></html>"
    rows = [(1, "http://a.org/1", PAGE % (1, 7)), (2, "http://a.org/2", PAGE % (2, 8)), (3, "http://a.org/3", other), (4, None, None), (5, "http://b.org/", ""), (6, "http://b.org/", "no tags"), (7, None, "<p>open <script> never closed")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {1: MAIN, 2: MAIN, 3: "Only this page is built so.", 4: "", 5: "", 6: "no tags", 7: "open"}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_consensus_outvotes_a_page(spark):
    """A page whose longest container is a teaser list still gives its host's article."""
    good = "<body><div class='story'><p>%s</p></div><div class='other'><p>x</p></div></body>"
    bad = "<body><div class='story'><p>Short.</p></div><div class='other'><p>%s</p></div></body>" % ("teaser " * 30)
    rows = [(i, "http://h.org/", good % ("words " * 40)) for i in range(5)] + [(9, "http://h.org/", bad)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Short."


def test_two_templates_and_lists(spark):
    """A host of two templates, the smaller with a teaser on the larger's path; and articles that are mostly lists."""
    one = "<body><div class='box'><p>%s</p></div></body>"
    two = "<body><div class='box'><p>Teaser.</p></div><main><div class='post'><h1>Title</h1><p>%s</p></div></main></body>"
    empty = "<body><div class='box'></div><section><p>Only here.</p></section></body>"
    listed = "<body><article><h1>Steps</h1><p>Do this.</p><ul><li>%s</li><li>then that</li></ul><p>Done.</p></article></body>"
    long_ = "words " * 39 + "end"
    rows = [(i, "http://h.org/", one % long_) for i in range(6)] + [(i, "http://h.org/", two % long_) for i in range(6, 9)] + [(9, "http://h.org/", empty)]
    rows += [(i, "http://l.org/", listed % long_) for i in range(10, 13)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: long_ for i in range(6)}, **{i: f"Title {long_}" for i in range(6, 9)}, 9: "Only here.", **{i: f"Steps Do this. {long_} then that Done." for i in range(10, 13)}}


def test_urls(spark):
    urls = {1: "http://x.org/a?b", 2: "http://example.org/es/1", 3: "http://www.EXAMPLE.org/en/12", 4: "http://a.com/fr/1", 5: "http://a.com/de/", 6: None, 7: "no url", 8: "http://blog.casino-win.example.net/es/1", 9: "http://blog.ththon.example.net/es/1", 10: "http://x.org", 11: "http://xorg/", 12: "ftp://h?q/", 13: "http://a.com/de\nx#y"}
    rows = spark.createDataFrame([(k, u) for k, u in urls.items()], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert got[1] == ("x.org", "/a", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[3][2:] == ("example.org/en/1", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[6][:3] == got[7][:3] == ("", "", None)
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow") and got[10][1:3] == ("", None) and got[11][:3] == ("xorg", "/", None)
    assert got[12][:2] == ("h", "") and got[13][:3] == ("a.com", "/de\nx", None)
    assert all((h, p) == url_filter._parts(urls[k] or "") for k, (h, p, _, _) in got.items())


def test_warc(spark, tmp_path):
    long_, other = "é" * 60 + "\r\n\r\nWARC/1.1\r\n", "z" * 200
    rows = [(5, "http://a/", long_), (3, None, long_), (9, "http://a\n/", long_), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (4, "u", other), (None, "u", other), (4, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(warc.plan_records(pages), path)
    got = {(r.page, i) if r.page == 4 else r.page: r for i, r in enumerate(warc.read(spark, path).withColumn("page", warc.page_of("record_id")).collect())}
    assert len(got) == 10 and len({r.record_id for r in got.values()}) == 9
    kinds = {5: ("revisit", "urn:page:3"), 3: ("response", None), 9: ("revisit", "urn:page:3"), **{k: ("response", None) for k in (1, 2, 7, 8, None)}}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if not isinstance(k, tuple)} == kinds
    assert bytes(got[3].payload).decode() == long_ and got[3].url is None and got[5].payload is None and got[5].payload_bytes == len(long_.encode())
    some = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    assert some.count() == 2 and "payload" not in some.columns
    digest = hashlib.sha256(other.encode()).hexdigest()
    assert warc.read(spark, path).where((F.col("payload_digest") == digest) & (F.col("record_id") == "urn:page:4")).count() == 2
    done = warc.round_trip(pages).collect()
    assert sorted((r.page_id or 0, r.payload_digest) for r in done) == sorted((p or 0, hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in rows)
    assert warc.round_trip(pages.limit(0)).collect() == []


def record(body: bytes, *lines: str) -> bytes:
    return "\r\n".join(["WARC/1.0", *lines, f"content-length:{len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def foreign() -> list[bytes]:
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    return [
        record(b"software: x\r\n\r\nmore", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"),
        record(http + b"hello\r\n\r\nWARC/1.0\r\n", "WARC-Type:response", "WARC-Record-ID:<urn:uuid:2>", "WARC-Target-URI: http://b/", "WARC-Date: 2020-01-02T00:00:00Z", "Content-Type: application/http;\r\n msgtype=response", "WARC-Payload-Digest: sha1:ABC"),
        record(b"plain payload", "WARC-Type: resource", "WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: http://c/", "WARC-Date: 2021-01-02T00:00:00Z", "Content-Type: text/plain"),
        record(b"no head at all", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: application/http"),
        record(b"", "WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:5>"),
    ]


@pytest.mark.parametrize("kind", ["plain", "split", "members", "whole"])
def test_foreign_archives(spark, tmp_path, kind):
    parts = foreign() * 7
    name, data = {"plain": ("a.warc", b"".join(parts)), "split": ("a.warc", b"".join(parts)), "members": ("a.warc.gz", b"".join(map(gzip.compress, parts))), "whole": ("a.warc.gz", gzip.compress(b"".join(parts)))}[kind]
    (tmp_path / name).write_bytes(data)
    rows = warc.read(spark, str(tmp_path), splitBytes=300 if kind == "split" else 10**9, partitionBytes=300).collect()
    want = {"urn:uuid:1": b"software: x\r\n\r\nmore", "urn:uuid:2": b"hello\r\n\r\nWARC/1.0\r\n", "urn:uuid:3": b"plain payload", "urn:uuid:4": b"no head at all", "urn:uuid:5": b""}
    assert sorted((r.record_id, bytes(r.payload)) for r in rows) == sorted((*want.items(),) * 7)
    second = next(r for r in rows if r.record_id == "urn:uuid:2")
    assert (second.payload_digest, second.url, second.headers["content-type"], second.payload_bytes) == ("ABC", "http://b/", "application/http; msgtype=response", 19)
    some = warc.read(spark, str(tmp_path)).where("date >= '2020-06-01' AND url = 'http://c/'")
    assert some.count() == 7 and warc.read(spark, str(tmp_path)).where("record_id IN ('urn:uuid:4', 'x')").count() == 7


def test_warc_reader_skips_unwanted_payloads(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull
    from pyspark.sql.types import StructType

    file = tmp_path / "a.warc"
    file.write_bytes(record(b"x" * 3_000_000, "WARC-Type: warcinfo") + record(b"HTTP/1.1 200 OK\r\n\r\nhello", "WARC-Type: response", "Content-Type: application/http", "WARC-Date: 2020"))
    reader = warc.WarcReader({"path": str(file)}, StructType.fromDDL(warc.SCHEMA))
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("date",), "2019"), IsNull(("url",))])) == [IsNull(("url",))]
    got, read = [], []

    class Counting(warc.Plain):
        def at(self, start, n):
            read.append(n)
            return super().at(start, n)

    with open(file, "rb") as f:
        f.size = lambda: 0
        data = Counting.__new__(Counting)
        data.f, data.size, data.base, data.held = f, file.stat().st_size, 0, b""
        got = [r["payload"] for r, _ in reader._records(data, 0, data.size, "a")]
    assert got == [b"hello"] and sum(read) < 20_000
    for bad in (b"no archive", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", record(b"abc", "WARC-Type: response")[:-6]):
        file.write_bytes(bad)
        with pytest.raises(ValueError):
            list(reader.read(reader.partitions()[0])) or reader.filters.clear() or list(warc.WarcReader({"path": str(file)}, StructType.fromDDL(warc.SCHEMA)).read(reader.partitions()[0]))


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", 5)], DOCS).withColumns({c: F.lit("clash") for c in ("score", "spans", "held_out", "piece", "key", "host", "component_id", "label", "bucket")})
    model = language.train(docs)
    assert language.identify(docs, model).columns == ["doc_id", "lang_pred", "score", "spans"]
    assert packing.pack(docs, entry.tokenizer_path(), ids=False).count() == media.round_trip(docs).count() == 1
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.lit("<p>x</p>").alias("html"), "host", "score", F.lit("q").alias("path"), F.lit("q").alias("text"), F.lit("q").alias("digest"))
    assert html_main.extract(pages).first().text == "x" and url_filter.judge(pages).first().host == "a.org" and warc.round_trip(pages).count() == 1
    assert pa.types.is_string(pa.string())
