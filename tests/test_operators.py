"""Operators against plain versions of their rules on generated cases."""

import itertools
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.functions import scalar
from trackloom.operators import asof, cluster, naming, relational, spatial
from trackloom.sources import gpx

TRACK = "t long, lat double, lon double, file string, idx int"
SHIFTS = {"direct": 7, "gap": 90, "distance": 400, "speed": 40, "reach": 50}


def metres(a, b):
    (la, oa), (lb, ob) = ((math.radians(x) for x in p) for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def placed_by_hand(track, t, direct, gap, distance, speed, reach):
    """A photo's place from a sorted list of points ``(t, file, idx, lat, lon)``."""
    before, after = [p for p in track if p[0] <= t], [p for p in track if p[0] > t]
    b, a = (before[-1] if before else None), (after[0] if after else None)
    near = min((p for p in (b, a) if p), key=lambda p: (abs(p[0] - t), p[0]), default=None)
    if near and abs(near[0] - t) <= direct:
        return "direct", near[3], near[4], near[1]

    def line(p, q):
        share = (t - p[0]) / (q[0] - p[0])
        return round(p[3] + share * (q[3] - p[3]), 6), round(p[4] + share * (q[4] - p[4]), 6)

    if b and a:
        far, span = metres(b[3:], a[3:]), a[0] - b[0]
        return ("interpolated", *line(b, a), b[1]) if span <= gap and far <= distance and far / span * 3.6 <= speed else ("blocked", None, None, None)
    end, beside = (track[-1], track[-2:-1]) if b else (track[0], track[1:2]) if a else (None, None)
    if end is None or abs(t - end[0]) > reach:
        return "blocked", None, None, None
    if not beside or beside[0][0] == end[0]:
        return "extrapolated", round(end[3], 6), round(end[4], 6), end[1]
    return ("extrapolated", *line(beside[0], end), end[1])


@pytest.mark.parametrize("seed", range(6))
def test_place_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    n = (0, 1, 2, 12, 40, 40)[seed]
    times = sorted(rng.choice((rng.randrange(900), rng.randrange(0, 900, 60))) for _ in range(n))
    points, lat, lon = [], 48.1234567, 11.7654321
    for i, t in enumerate(times):
        lat, lon = lat + rng.uniform(-0.002, 0.002), lon + rng.uniform(-0.002, 0.002)
        points.append((t, lat, lon, f"f{i % 3}", i))
    items = [(f"p{t}", t) for t in range(-80, 1000, 9)]
    track = spark.createDataFrame(points, TRACK)
    got = {r.path: (r.method, r.lat, r.lon, r.gpx_file) for r in asof.place(spark.createDataFrame(items, "path string, t long"), track, **SHIFTS).collect()}
    plain = sorted((t, f, i, la, lo) for t, la, lo, f, i in points)
    for path, t in items:
        want = placed_by_hand(plain, t, **SHIFTS)
        assert got[path][0] == want[0] and got[path][3] == want[3], (path, got[path], want)
        assert got[path][1:3] == (pytest.approx(want[1], abs=1.5e-6), pytest.approx(want[2], abs=1.5e-6)) if want[1] is not None else got[path][1:3] == (None, None)


def test_places_are_rounded_as_sql_does(spark):
    """Interpolated places that are a half, or nearly one, at the seventh place."""
    cases = [(50.076705, 50.054773, 80, 70), (50.034293, 50.099073, 200, 135), (50.054214, 50.096714, 80, 70), (50.095422, 50.043682, 80, 70), (50.063757, 50.001977, 80, 70)]
    for a, b, span, t in cases:
        track = spark.createDataFrame([(0, a, 4.0, "f", 0), (span, b, 4.0, "f", 1)], TRACK)
        got = asof.place(spark.createDataFrame([("p", t)], "path string, t long"), track, direct=5, distance=1e5, speed=1e4).first()
        want = duckdb.connect().execute(f"SELECT round({a}::DOUBLE + ({b}::DOUBLE - {a}::DOUBLE) * (({t} - 0) / ({span} - 0)), 6)").fetchone()[0]
        assert got.method == "interpolated" and got.lat == want


@pytest.mark.parametrize("rows", [3, 1000])
def test_brackets_and_segments_of_busy_days(spark, monkeypatch, rows):
    """Days are cut into buckets of three rows, or hardly; the result is that of one sorted list."""
    monkeypatch.setattr(asof, "BUCKET_ROWS", rows)
    rng = random.Random(rows)
    points = [(rng.choice((rng.randrange(90_000), 5_000_000 + rng.randrange(3))), 0.0, 0.0, "a", i) for i in range(60)]
    items = [("x", 500_000), ("y", -5), ("z", 9_000_000), *((f"i{k}", rng.randrange(90_000)) for k in range(40))]
    plain = sorted((t, f, i) for t, _, _, f, i in points)
    track = spark.createDataFrame(points, TRACK)
    got = {r.path: (r.before and r.before.idx, r.after and r.after.idx) for r in asof.bracket(spark.createDataFrame(items, "path string, t long"), track, rows_per_bucket=rows).collect()}
    want = {p: (max((x for x in plain if x[0] <= t), default=(0, 0, None))[2], min((x for x in plain if x[0] > t), default=(0, 0, None))[2]) for p, t in items}
    assert got == want
    pairs = sorted((r.a.idx, r.b.idx) for r in spatial.segments(track).collect())
    assert pairs == sorted((a[2], b[2]) for a, b in itertools.pairwise(plain))


def test_iso_offset(spark):
    rng = random.Random(1)
    texts = {f"{s}{h:02d}:{m:02d}{tail}": (1 if s == "+" else -1) * (h * 60 + m) * 60 for s in "+-" for tail in ("", ":17") for h, m in ((rng.randrange(15), rng.randrange(60)) for _ in range(6))}
    texts |= dict.fromkeys(["7:15", "+7:15", "Z", "--01:00", "+01-30", " +01:30", "UTC+01:30"])
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", scalar.iso_offset(F.col("text")).alias("s"))
    assert {r.text: r.s for r in rows.collect()} == texts


def test_haversine(spark):
    rng = random.Random(2)
    pairs = [tuple(rng.uniform(-x, x) for x in (89, 179, 89, 179)) for _ in range(30)]
    rows = spark.createDataFrame(pairs, "a double, b double, c double, d double").select("*", scalar.haversine(*map(F.col, "abcd")).alias("m")).collect()
    assert all(r.m == pytest.approx(metres((r.a, r.b), (r.c, r.d)), rel=1e-6) for r in rows)


def free_names(incoming, existing):
    """Every incoming item, in the order of paths, takes the first name of its own series that nobody has."""
    taken = {n.lower() for n in existing}
    wanted = {(b + ("." + e if e else "")).lower() for _, b, e in incoming}
    out = {}
    for path, base, ext in sorted(incoming):
        dot = "." + ext if ext else ""
        series = (f"{base}{'' if n == 0 else f'-{n:03d}'}{dot}" for n in itertools.count())
        own = (base + dot).lower()
        out[path] = next(x for x in series if x.lower() not in taken and (x.lower() == own or x.lower() not in wanted))
        taken.add(out[path].lower())
    return out


def test_names_against_a_plain_version(spark):
    rng = random.Random(3)
    for _ in range(4):
        bases, exts = ["Kiel", "kiel", "ulm", "ulm-004", "x-1", "y"], ["png", "PNG", ""]
        incoming = [(f"{i:03d}", rng.choice(bases), rng.choice(exts)) for i in range(70)]
        existing = [f"{rng.choice(bases)}{rng.choice(['', '-001', '-002', '-007', '-0003', '-12'])}{rng.choice(['.png', '', '.jpg'])}" for _ in range(12)]
        rows = spark.createDataFrame([("d", *r) for r in incoming], "dir string, path string, base string, ext string")
        names = spark.createDataFrame([("d", n) for n in existing] + [("other", "Kiel.png")], "dir string, name string")
        assert {r.path: r.name for r in naming.allocate_names(rows, names).collect()} == free_names(incoming, existing)


def test_many_items_of_one_name(spark):
    """A third of a million items want one name; the numbers taken before are skipped."""
    n = 300_000
    rows = spark.range(n).selectExpr("'d' AS dir", "lpad(cast(id AS STRING), 9, '0') AS path", "'a' AS base", "'b' AS ext")
    names = spark.range(0, 3 * n, 3).selectExpr("'d' AS dir", "concat('a-', lpad(cast(id AS STRING), greatest(3, length(cast(id AS STRING))), '0'), '.b') AS name")
    got = naming.allocate_names(rows, names).agg(F.count_distinct("name").alias("n"), F.max(F.struct("path", "name")).alias("m")).first()
    assert got.n == n and got.m.name == f"a-{(n - 1) + (n - 1) // 2}.b"


def test_suffixes(spark):
    rng = random.Random(4)
    names = [f"{rng.choice(['Rom', 'rom', 'bari-12'])}{rng.choice(['', '-003', '-1042', '-77'])}.png" for _ in range(30)]
    top = {}
    for n in names:
        root, number = re.fullmatch(r"(.*?)(?:-(\d{3,}))?", n.lower().removesuffix(".png")).groups()
        top[root] = max(top.get(root, 0), int(number or 0))
    rows = spark.createDataFrame([("d", n) for n in names], "dir string, name string")
    assert {r.root: r.top for r in naming.max_suffix(rows).collect()} == top
    new = naming.append_names(rows.limit(1).select("dir", F.lit("p").alias("path"), F.lit("ROM-003.gif").alias("name")), rows).first()
    assert new.name == f"ROM-{top['rom'] + 1:03d}.gif"


def test_keep_first_of_null_keys(spark):
    rows = spark.createDataFrame([("b", None, 1), ("a", None, 1), ("c", "k", 2), ("d", "k", 1)], "path string, fp string, prio int")
    got = {r.path: (r.retained, r.kept) for r in relational.keep_first(rows, ["fp"], [F.col("prio"), F.col("path")]).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("d", False), "d": ("d", True)}


def test_nearest_points_around_the_globe(spark):
    """Against all pairs, near the poles, at the date line and across cells."""
    rng = random.Random(5)
    spots = [(0.0, 0.0), (60.0, 179.9999), (60.0, -179.9999), (89.9995, 10.0), (-89.9995, -100.0), (51.0, 4.0)]
    around = lambda lat, lon: (max(-90.0, min(90.0, lat + rng.uniform(-0.0008, 0.0008))), (lon + rng.uniform(-0.001, 0.001) + 180) % 360 - 180)
    points = [(rng.randrange(4000), *around(*s), "f", 100 * k + i) for k, s in enumerate(spots) for i in range(25)]
    frames = [(f"p{k}-{i}", rng.randrange(4000), *around(*s)) for k, s in enumerate(spots) for i in range(25)]
    got = {r.path: (r.metres, r.point) for r in spatial.nearest_point(spark.createDataFrame(frames, "path string, t long, lat double, lon double"), spark.createDataFrame(points, TRACK), window=1000).collect()}
    want = {}
    for path, t, lat, lon in frames:
        near = min(((metres((lat, lon), p[1:3]), p[0], p[4]) for p in points if abs(p[0] - t) <= 1000), default=(99, 0, 0))
        if near[0] <= 50:
            want[path] = (pytest.approx(near[0], abs=0.02), near[2])
    assert len(want) > 30 and got == want


@pytest.mark.parametrize("at_once", [0, 10**9])
def test_nearest_points_of_copies(spark, capsys, at_once):
    """Copies have their original's answer, in one round and in several, and the pairs are not sorted."""
    rng = random.Random(9)
    points = [(rng.randrange(900), 51 + rng.randrange(30) * 3e-5, 4 + rng.randrange(30) * 5e-5, "fg"[i % 2], i) for i in range(60)]
    points += [(*p[:4], p[4] + 100) for p in points]
    frames = [(f"p{i}", rng.randrange(900), 51 + rng.randrange(40) * 3e-5, 4 + rng.randrange(40) * 5e-5) for i in range(60)]
    frames += [(f"q{i}", *f[1:]) for i, f in enumerate(frames)] + [("none", None, 51.0, 4.0), ("nowhere", 5, None, 4.0)]
    found = spatial.nearest_point(spark.createDataFrame(frames, "path string, t long, lat double, lon double"), spark.createDataFrame(points, TRACK), window=300, at_once=at_once)
    want = {}
    for path, t, lat, lon in frames[:-2]:
        near = min(((round(metres((lat, lon), p[1:3]), 6), p[0], p[3], p[4]) for p in points if abs(p[0] - t) <= 300), default=(99,))
        if near[0] <= 50:
            want[path] = (pytest.approx(near[0], abs=0.01), near[1] - t, near[3])
    assert len(want) > 60 and {r.path: (r.metres, r.offset_s, r.point) for r in found.collect()} == want
    found.explain()
    assert re.search(r"HashAggregate\(keys=\[[^]]*\], functions=\[partial_min\(metres", capsys.readouterr().out)


def test_bijective_needs_one_on_each_side(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "path string, k int")
    new = spark.createDataFrame([("x", 1), ("y", 2)], "path string, k int")
    assert [(r.old_path, r.new_path) for r in relational.bijective(rows, new, ["k"]).collect()] == [("a", "x")]


def test_consensus_against_a_plain_version(spark):
    rng = random.Random(6)
    rows = [(g, f"{g}{i:02d}", rng.choice(["point", "segment"]), round(rng.uniform(0, 40), 1), rng.choice([0, 60, 119, 121, 240, 5000]) + rng.randrange(3)) for g in "abcdef" for i in range(rng.randrange(1, 25))]
    want = {}
    for g in {r[0] for r in rows}:
        piles = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] != "point", r[3], r[1])):
            pile = next((p for p in piles if abs(p[0][4] - r[4]) <= 120), None)
            piles.append([r]) if pile is None else pile.append(r)
        best = max(piles, key=len)
        rest = sum(map(len, piles)) - len(best)
        want[g] = (best[0][4], len(best), rest, "review_required" if rest else "high" if len(best) > 1 or best[0][2] == "point" else "medium", best[0][1])
    df = spark.createDataFrame(rows, "grp string, path string, kind string, metres double, offset_s long")
    assert {r.grp: tuple(r)[1:] for r in cluster.consensus(df).collect()} == want
    assert cluster.consensus(df.limit(0)).collect() == []


def test_clobber(spark):
    moves = spark.createDataFrame([("p", 1, 1), ("p", 2, -1), ("p", 3, 1), ("p", 4, 1)], "path string, seq int, delta int")
    assert [(r.seq, r.held) for r in relational.clobbers(moves).collect()] == [(4, 2)]


def test_results_do_not_depend_on_partitioning(spark):
    rows = spark.range(500).selectExpr("cast(id AS string) AS path", "id % 7 AS k")
    one, many = (relational.index_fingerprint(x, F.col("path"), F.concat_ws(" ", "path", "k")).first() for x in (rows.coalesce(1), rows.repartition(13)))
    assert one == many


def test_gpx_folder(spark, tmp_path):
    """Status of a folder, document order across segments, dropped points and files that are not well-formed."""
    assert gpx.index(spark, None) == gpx.index(spark, "") == ("disabled", None)
    assert gpx.index(spark, str(tmp_path / "none")) == ("missing", None)
    folder = tmp_path / "tracks"
    (folder / "deep").mkdir(parents=True)
    (folder / "bad.gpx").write_text("<gpx><trk><trkseg><trkpt lat='1' lon='1'>")
    (folder / "bytes.gpx").write_bytes(b"<gpx>\xff\xfe</gpx>")
    (folder / "other.xml").write_text("<gpx/>")
    status, points = gpx.index(spark, str(folder))
    assert status == "empty" and points.collect() == []
    at = "<time>{}</time>"
    (folder / "deep" / "a b.GPX").write_text(
        "<?xml version='1.0'?><gpx xmlns='http://www.topografix.com/GPX/1/1'><trk/><trk><name>x</name><trkseg/><trkseg>"
        f"<trkpt lat='1.5' lon='-2'><ele>3</ele>{at.format('2024-01-01T00:00:05Z')}</trkpt>"
        f"<trkpt lat='91' lon='0'>{at.format('2024-01-01T00:00:06Z')}</trkpt><trkpt lat='1' lon='0'/><trkpt lon='0'>{at.format('2024-01-01T00:00:06Z')}</trkpt>"
        f"</trkseg><trkseg><trkpt lat='nan' lon='0'>{at.format('2024-01-01T00:00:06Z')}</trkpt><trkpt lat='1' lon='0'>{at.format('2024-01-01T00:00:06.5Z')}</trkpt>"
        f"<trkpt lat='1' lon='0'>{at.format('2024-01-01T00:00:06')}</trkpt><trkpt lat='-90' lon='180'>{at.format(' 2024-01-01T02:00:07.250000+02:00 ')}</trkpt>"
        f"<trkpt lat='x' lon='0'>{at.format('2024-01-01T00:00:06Z')}</trkpt><trkpt lat='1' lon='0'>{at.format('2024-13-01T00:00:06Z')}</trkpt></trkseg></trk></gpx>"
    )
    status, points = gpx.index(spark, str(folder))
    got = [(r.file, r.idx, r.t, r.lat, r.lon) for r in points.selectExpr("file", "idx", "unix_millis(time_utc) AS t", "lat", "lon").orderBy("idx").collect()]
    assert status == "usable" and got == [("deep/a b.GPX", 0, 1704067205000, 1.5, -2.0), ("deep/a b.GPX", 7, 1704067207250, -90.0, 180.0)]
    assert sorted(r.file for r in gpx.files(spark, str(folder)).collect()) == ["bad.gpx", "bytes.gpx", "deep/a b.GPX"]


def test_nearest_segments_of_copies(spark, capsys):
    """Copies of frames and of points change no answer, and the pairs are not sorted."""
    rng = random.Random(10)
    points = [(20 * i, 51 + rng.randrange(30) * 1e-4, 4 + rng.randrange(30) * 1e-4, "f", 3 * i) for i in range(40)]
    frames = [(f"p{i}", rng.randrange(800), 51 + rng.randrange(30) * 1e-4, 4 + rng.randrange(30) * 1e-4) for i in range(40)]
    run = lambda f, p: spatial.nearest_segment(spark.createDataFrame(f, "path string, t long, lat double, lon double"), spark.createDataFrame(p, TRACK), window=200)
    one = {r.path: (r.metres, r.offset_s, r.duration_s, r.point) for r in run(frames, points).collect()}
    twice = run(frames + [(f"q{f[0]}", *f[1:]) for f in frames], points + [(*p[:4], p[4] + 1) for p in points])
    got = {r.path: (r.metres, r.offset_s, r.duration_s, r.point - 1) for r in twice.collect()}
    assert len(one) > 10 and got == one | {f"q{k}": v for k, v in one.items()}
    twice.explain()
    assert re.search(r"HashAggregate\(keys=\[[^]]*\], functions=\[partial_min\(metres", capsys.readouterr().out)


def test_nearest_segment_bounds(spark):
    """A pause longer than the gap, a pause of no time and a segment out of reach give nothing."""
    track = [(0, 50.0, 4.0, "a", 0), (100, 50.0, 4.01, "a", 1), (100, 50.5, 4.0, "a", 2), (5000, 50.5, 4.1, "a", 3)]
    frames = [("on", 60, 50.0, 4.005), ("high", 60, 50.01, 4.005), ("pause", 60, 50.25, 4.005), ("late", 400_000, 50.0, 4.005), ("gap", 60, 50.5, 4.05)]
    t = spark.createDataFrame(track, "t long, lat double, lon double, file string, idx long")
    f = spark.createDataFrame(frames, "path string, t long, lat double, lon double")
    got = spatial.nearest_segment(f, t).collect()
    assert [(r.path, r.metres, r.offset_s, r.duration_s, r.point) for r in got] == [("on", 0.0, -10, 100, 0)]


def test_pins_need_no_names(spark, sf):
    """Only places are pinned: neither the renames nor the whole plan are written for them."""
    from trackloom import queries_geotag
    from trackloom.adapters import Tables

    kept, queries_geotag.Stages.kept = queries_geotag.Stages.kept, {}
    try:
        queries_geotag.pins_j23(Tables(spark, sf)).collect()
        (stages,) = queries_geotag.Stages.kept.values()
        assert "decided" in vars(stages)
        assert not {"renames", "operations"} & set(vars(stages))
    finally:
        queries_geotag.Stages.kept = kept


@pytest.fixture
def stages(spark):
    """Queries' stages of this test alone: those made so far are set aside."""
    from trackloom import queries_geotag

    kept, queries_geotag.Stages.kept = queries_geotag.Stages.kept, {}
    yield queries_geotag.Stages.kept
    queries_geotag.Stages.kept = kept


def equals_sql(spark, folder, name):
    from trackloom import queries

    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    cur = con.execute(queries.ORACLES[name])
    at = [got.columns.index(c[0]) for c in cur.description]
    return sorted((tuple(r[i] for i in at) for r in got.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


@pytest.fixture(scope="module")
def repeated(sf, tmp_path_factory):
    """Every event three times."""
    at = tmp_path_factory.mktemp("repeated")
    duckdb.connect().execute(f"COPY (SELECT e.* FROM '{sf}/events.parquet' AS e, range(3)) TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


def test_cells_of_repeated_rows(spark, repeated, stages):
    """A path that stands m times is m candidates of its bucket, not m times m."""
    assert equals_sql(spark, repeated, "offset_cells_f13")


def test_editor_rows_of_repeated_rows(spark, repeated, stages):
    assert equals_sql(spark, repeated, "editor_rows_a18")


@pytest.mark.parametrize("name", ["time_decisions_c2", "console_counts_a17"])
def test_zones_are_decided_once(spark, sf, stages, monkeypatch, name):
    from trackloom.plans import decisions

    made, zones = [], decisions.zones
    monkeypatch.setattr(decisions, "zones", lambda *a: made.append(a) or zones(*a))
    assert equals_sql(spark, sf, name)
    assert len(made) == 1


def test_drift_needs_no_resolved_photos(spark, sf, stages, monkeypatch):
    """A bucket's times follow from its frames and its offset."""
    from trackloom.plans import decisions

    monkeypatch.setattr(decisions, "resolve", None)
    assert equals_sql(spark, sf, "drift_cells_f14")


def test_reverts_need_no_other_photos(spark, sf, stages):
    assert equals_sql(spark, sf, "reverts_j16")
    (made,) = stages.values()
    assert not {"resolved", "decided", "operations"} & set(vars(made))


def test_names_need_no_whole_photos(spark, sf, stages):
    assert equals_sql(spark, sf, "rename_plan_w4")
    (made,) = stages.values()
    assert "renames" in vars(made) and "resolved" not in vars(made)


def test_shuffle_files_go_with_their_query(spark):
    """What a stage shuffled is not left on disk until the driver collects its garbage."""
    from pathlib import Path

    from trackloom.session import cut

    def shuffled():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}

    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = shuffled()
    df = cut(spark.range(100_000).selectExpr("id % 50000 AS k").groupBy("k").count())
    assert df.where("count = 2").count() == 50_000
    assert not {f for f in shuffled() - before if f.stat().st_size > 50_000}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_tables_on_the_way_are_deleted(spark):
    from urllib.parse import urlparse

    from trackloom.session import cut, settled

    made = []

    def make():
        made.append(cut(spark.range(10)))
        made.append(settled(spark, lambda: made[0].selectExpr("id + 1 AS id")))
        return made[1].selectExpr("id * 2 AS id")

    out = settled(spark, make)
    assert sorted(r.id for r in out.collect()) == list(range(2, 21, 2))
    folders = [os.path.dirname(urlparse(f).path) for df in made for f in df.inputFiles()]
    assert folders and not [f for f in folders if os.path.exists(f)]


@pytest.mark.parametrize("name", ["time_decisions_c2", "console_counts_a17"])
def test_decisions_keep_two_tables(spark, sf, stages, name):
    """What matching and cells wrote on their way is deleted; zones and cells stay, and are read again."""
    from pathlib import Path

    from trackloom import queries
    from trackloom.session import shared_dir

    at = Path(shared_dir(spark).removeprefix("file://")) / "trackloom" / spark.sparkContext.applicationId
    before = set(at.glob("*"))
    first = sorted(queries.QUERIES[name](spark, sf).collect())
    assert len(set(at.glob("*")) - before) == 2
    assert sorted(queries.QUERIES[name](spark, sf).collect()) == first


def test_nearest_point_in_wide_and_narrow_cells(spark, capsys):
    """Each narrowed search finds what brute force finds, at the poles' side, at the date line and at the cells' edges too."""
    random.seed(3)

    def around(n, kind):
        centres = [(50.0, 4.0), (-0.0005, 179.9999), (84.99, -180.0), (0.0, 0.0)]
        rows = []
        for i in range(n):
            lat, lon = centres[i % 4]
            lon = lon + random.uniform(-60, 60) / 111_000 / math.cos(math.radians(lat))
            rows.append((f"{kind}{i}", i, random.randrange(0, 900_000), lat + random.uniform(-60, 60) / 111_000, (lon + 180) % 360 - 180))
        return rows

    frames, points = around(240, "f"), around(400, "p")
    f = spark.createDataFrame([(p, t, la, lo) for p, _, t, la, lo in frames], "path string, t long, lat double, lon double")
    k = spark.createDataFrame([(t, la, lo, "t", i) for _, i, t, la, lo in points], "t long, lat double, lon double, file string, idx long")

    def metres(a, b):
        la, lo, lb, lob = map(math.radians, (a[3], a[4], b[3], b[4]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = {}
    for a in frames:
        near = [(metres(a, b), b[2], b[1]) for b in points if abs(a[2] - b[2]) <= 172_800 and metres(a, b) <= 50]
        if near:
            want[a[0]] = min(near)[2]
    assert len(want) > 50
    for at_once, staged in ((1, True), (10**9, False)):
        assert {r.path: r.point for r in spatial.nearest_point(f, k, at_once=at_once, staged=staged).collect()} == want
    # The least distances are written before they are searched for, so the two searches' shuffles are not one query's.
    spatial.nearest_point(f, k, staged=True).explain()
    assert "partial_min(metres" not in capsys.readouterr().out
