"""Brute-force versions of what the other tests only sample; empty tables, repeated rows, ties, long texts, clashing names."""

import collections
import itertools
import math
import resource
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_pairs import base_text, brute_leaks
from test_texts import payload
from tokenizers import Tokenizer

from trackloom.llm import common, decontaminate, entry, html_main, jaccard_join, language, media, packing, pii, quality, url_filter, warc

DOCS = "doc_id long, text string, lang string, n int"
PAGES = "page_id long, url string, html string"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, 0) for i, t in enumerate(texts)], DOCS)


# --- quality ---------------------------------------------------------------------------------


def plain_features(text):
    """Words are runs of one class; digits are alike; features are hashed words and pairs."""
    kinds = lambda b: 0 if b in (32, 9, 10, 11, 12, 13) else 1 if b >= 128 or 97 <= (b | 32) <= 122 and chr(b).isalpha() else 2 if 48 <= b <= 57 else 3
    data, found = text.encode(), []
    for kind, run in itertools.groupby(data, kinds):
        run = bytes(run)
        if kind:
            found.append(b"0" * len(run) if kind == 2 else bytes(b + 32 if 65 <= b <= 90 else b for b in run))
    with np.errstate(over="ignore"):
        h = [hash_of(w) for w in found]
        mixed = [int(quality.wh.mix(np.array([np.uint64(a) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b)], dtype=np.uint64))[0]) for a, b in itertools.pairwise(h)]
    counts = collections.Counter(x & ((1 << quality.BITS) - 1) for x in [*h, *mixed])
    value = {k: 1 + math.log(c) for k, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    return {k: v / norm for k, v in value.items()}


def hash_of(word):
    powers = quality.wh.powers(max(len(word), 1))
    total = sum((int(quality.wh._BYTE[b]) * int(p)) for b, p in zip(word, powers, strict=False)) + len(word) * 0x9E3779B97F4A7C15
    return int(quality.wh.mix(np.array([total % 2**64], dtype=np.uint64))[0])


def test_quality_by_brute_force(spark):
    texts = ["Good words, 12 good words!", "spam spam spam 99 99", "", None, "É é ÉCOLE x1y2", "Good words, 12 good words!"]
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32)
    model = quality.Model(weights, -0.25)
    got = {r.doc_id: r.score for r in quality.score(docs_of(spark, texts).withColumns({c: F.lit("clash") for c in ("score", "label", "bucket", "turn")}), model).collect()}
    for i, t in enumerate(texts):
        z = -0.25 + sum(float(weights[k]) * v for k, v in plain_features(t or "").items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    assert got[0] == got[5] and got[2] == got[3]
    assert quality.score(docs_of(spark, []), model).collect() == []


def test_ftrl_by_a_plain_version():
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(2)), np.sort(rng.choice(50, 6, replace=False)).astype(np.int32), rng.uniform(0.1, 1, 6)) for _ in range(40)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        if k == "bias":
            return -z[k] / ((beta + math.sqrt(n[k])) / alpha)
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(3):
        for y, at, x in rows:
            x = {**dict(zip(at.tolist(), x.tolist(), strict=True)), "bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    model = quality.ftrl(rows, epochs=3)
    assert model.intercept == pytest.approx(weight("bias"), abs=1e-9)
    assert np.allclose(model.weights[:50], [weight(k) for k in range(50)], atol=1e-6)


def test_quality_sample_is_bounded(spark):
    texts = [("good " if i % 2 else "bad ") * 50 + str(i) for i in range(200)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(200)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, max_bytes=4_000)
    scored = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(scored[i] for i in range(1, 200, 2)) > max(scored[i] for i in range(0, 200, 2))


# --- personal data ---------------------------------------------------------------------------


def test_marginals_by_enumeration():
    """On graphs without a loop message passing is exact: compared with the sum over all labellings."""
    rng = np.random.default_rng(3)
    labels = pii._LABELS
    for n, chain, skip in ((1, [], []), (2, [(0, 1)], []), (4, [(0, 1)], [(1, 2), (2, 3)]), (5, [(0, 1), (1, 2)], [(2, 4), (0, 3)])):
        model = pii.Model({str(i): i for i in range(n)}, rng.normal(size=(n + 1, labels)), rng.normal(size=(labels, labels)), rng.normal(size=(labels, labels)))
        model.chain, model.skip = model.chain + model.chain.T, model.skip + model.skip.T
        g = pii.Graph.__new__(pii.Graph)
        g.span, g.shape, g.chain, g.skip, g.anchor = [(i, i + 1) for i in range(n)], [str(i) for i in range(n)], chain, skip, [(0, 2)]
        g.label = [0] * n
        if n > 3:
            g.label[3] = 4
        want = np.zeros((n, labels))
        for y in itertools.product(range(labels), repeat=n):
            if any(f and y[i] != f for i, f in enumerate(g.label)):
                continue
            score = sum(model.node[i, y[i]] for i in range(n) if not g.label[i]) + sum(model.chain[y[a], y[b]] for a, b in chain) + sum(model.skip[y[a], y[b]] for a, b in skip) + (pii.ANCHOR if y[0] == 2 else 0)
            for i in range(n):
                want[i, y[i]] += math.exp(score)
        want /= want.sum(1, keepdims=True)
        assert np.allclose(pii.marginals(g, model), want, atol=2e-3)


def test_outlines_are_whole():
    long_ = "a1-" * 40
    assert pii._shape(long_) != pii._shape(long_ + "b") and len(pii._shape(long_)) == 32 and pii._shape("a1-b") == "a91-a"


# --- language --------------------------------------------------------------------------------


def test_three_hundred_languages(spark):
    """Each language has letters of its own; a rare one is learned from its one row."""
    alphabet = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    rng = np.random.default_rng(4)
    text = lambda i: " ".join("".join(rng.choice([alphabet[i], alphabet[i + 300]], 4)) for _ in range(30))
    rows = [(i, text(i), f"l{i:03d}", 0) for i in range(300)] + [(1000 + i, text(0), "l000", 0) for i in range(500)]
    model = language.train(spark.createDataFrame(rows, DOCS), max_rows=600)
    assert len(model.langs) == 300
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame([(i, text(i), None, 0) for i in range(300)], DOCS), model, spans=False).collect()}
    assert got == {i: f"l{i:03d}" for i in range(300)}


def test_viterbi_of_long_texts_is_that_of_one_pass(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(language, "PART", 16)
    for k in (1, 2, 4):
        score = rng.normal(0, 9, (900, k)).astype(np.float32)
        first = np.array([0, 0, 3, 500, 500, 890, 900])
        assert (language.viterbi(score, first, 4.0) == language._in_step(score, first, 4.0)).all()
        assert k == 1 or len(language._parts(score, first, 4.0)[1]) > 10


def test_language_ties_and_training_counts(spark):
    same = "lorem ipsum dolor"
    docs = spark.createDataFrame([(1, same, "xx", 0), (2, same, "aa", 0), (3, "", "zz", 0), (4, None, "aa", 0), (5, same, None, 0)], DOCS)
    model = language.train(docs)
    assert model.langs == ["aa", "xx"] or model.langs == ["aa", "xx", "zz"]
    got = [(r.lang_pred, r.score) for r in language.identify(spark.createDataFrame([(1, same, None, 0)] * 3, DOCS), model, spans=False).collect()]
    assert got == [("aa", 1.0)] * 3
    grams = collections.Counter()
    for w in same.split():
        b = f" {w} ".encode()
        for x, y, z in zip(b, b[1:], b[2:], strict=False):
            grams[((x * 65599 + y) * 65599 + z) * 2654435761 % 2**32 >> (32 - language.BITS)] += 1
    total = sum(grams.values())
    for bucket, n in grams.items():
        assert model.score[bucket, 0] == pytest.approx(math.log((n + 0.5) / (total + 0.5 * (1 << language.BITS))), abs=1e-5)
    with pytest.raises(ValueError):
        language.train(spark.range(language.MOST + 1).selectExpr("id AS doc_id", "'a' AS text", "cast(id AS string) AS lang"))


# --- HTML ------------------------------------------------------------------------------------


def page_text(html):
    page = html_main.Page(html)
    return page.text(html_main.most(page.score, page.score))


ARTICLE = "<article><h1>Title</h1><p>Words of the article stand here.</p></article>"


@pytest.mark.parametrize("around", [
    '<div class="layout with-sidebar">{}</div>', '<div id="no-header" class="page">{}</div>', '<div class="text-social-history">{}</div>', '<form id="all">{}</form>', '<div class="sidebar-layout">{}<aside class="related"><article><p>A teaser.</p></article></aside></div>',
    '{}<section id="comments"><article class="comment"><p>' + "I have a long opinion. " * 40 + "</p></article></section>", '<div class="widget"><div class="page">{}</div></div>', '<div class="ad">' + "Buy this now. " * 3 + "</div>{}",
])
def test_what_holds_the_article_stays(around):
    html = f"<body><nav>Menu <a href=x>one</a></nav>{around.format(ARTICLE)}<footer>Imprint</footer></body>"
    assert page_text(html) == "Title Words of the article stand here."


def test_nothing_else_is_dropped():
    html = "<article><p>So <math><mi>E</mi>=<mi>m</mi></math>, <svg><title>icon</title></svg> <noscript>plain</noscript> <object>none</object><iframe>frame</iframe>.<script>x()</script><button>Go</button></p><template>t</template><p>End &amp; out</p></article>"
    assert page_text(html) == "So E=m, icon plain noneframe. End & out"


def test_random_pages_against_a_plain_version(spark):
    """Pages of one template: what is inside the article, by a plain walk over the tree that made them."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 8))))
    some = lambda n: " ".join(word() for _ in range(int(n)))
    rows, want = [], {}
    for i in range(120):
        parts, texts = [], []
        for _ in range(int(rng.integers(1, 9))):
            kind, text = rng.choice(["p", "h2", "li", "blockquote", "pre", "ad", "script", "aside", "comment"]), some(rng.integers(3, 30))
            if kind in ("p", "h2", "pre"):
                parts.append(f"<{kind}>{text}  \n <b>bold</b>&eacute;</{kind}>")
                texts.append(f"{text} boldé")
            elif kind in ("li", "blockquote"):
                parts.append(f"<ul><li>{text}<li>second</ul>" if kind == "li" else f"<blockquote>{text}<p>second</p></blockquote>")
                texts += [text, "second"]
            else:
                parts.append({"ad": f"<div class='ad'>{text[:20]}</div>", "script": f"<script>var x='{text}'</script>", "aside": f"<aside>{text}</aside>", "comment": f"<!-- {text} -->"}[kind])
        rows.append((i, "http://one.example/", f"<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><a href=/>{some(5)}</a></nav><article class='n{i}'><h1>Head {i}</h1>{''.join(parts)}</article><footer>{some(12)}</footer></body></html>"))
        want[i] = " ".join([f"Head {i}", *texts])
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_long_pages_cost_in_proportion():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert page_text("<div>" * 40_000 + "deep") == "deep"
    assert page_text("<div class=a>" * 20_000 + "</section>" * 20_000 + "x") == "x"
    assert page_text("<select>" * 20_000 + "y") == "y"
    big = page_text("<article>" + "<p>some words in a paragraph</p>" * 40_000 + "</article>")
    assert len(big) == 40_000 * 26 - 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_pages_empty_repeated_and_tied(spark):
    assert html_main.extract(spark.createDataFrame([], PAGES)).collect() == []
    tie = "<body><section><p>Same length.</p></section><div><p>Same length.</p></div></body>"
    rows = [(1, "http://t.example/", tie)] * 3 + [(2, "http://u.example/", tie)]
    assert {(r.page_id, r.text) for r in html_main.extract(spark.createDataFrame(rows, PAGES)).collect()} in ({(1, "Same length."), (2, "Same length.")}, {(1, "Same length. Same length."), (2, "Same length. Same length.")})


def test_rare_paths_of_a_large_host_have_no_say(spark):
    """Two pages of 3,000 share a path that wins on both: too few to be the host's; they keep their own text all the same."""
    rows = spark.range(3000).selectExpr("id AS page_id", "'http://big.example/' AS url", "CASE WHEN id < 2 THEN '<body><div class=rare><p>Rare words here.</p></div></body>' ELSE concat('<body><article><p>Page ', id, '</p></article></body>') END AS html")
    won = html_main.consensus(rows).collect()
    assert len(won) == 1 and won[0].voted == [won[0].path] and won[0].outvoted == []
    got = {r.page_id: r.text for r in html_main.extract(rows).where("page_id < 3").collect()}
    assert got == {0: "Rare words here.", 1: "Rare words here.", 2: "Page 2"}


# --- urls, media, archives -------------------------------------------------------------------


def test_url_model_takes_gradient_steps():
    """One step from zero equals minus the rate times the numeric gradient of the loss; and unseen urls are told apart."""
    at = url_filter._buckets("casino.example", "/win")
    x = collections.Counter(at)

    def loss(w, b):
        z = b + sum(w.get(k, 0.0) * c for k, c in x.items()) / math.sqrt(len(at))
        return math.log1p(math.exp(-z))

    weights, intercept = url_filter.train([("http://casino.example/win", 1)], epochs=1, rate=0.2, l2=0.0)
    for k in x:
        gradient = (loss({k: 1e-5}, 0.0) - loss({k: -1e-5}, 0.0)) / 2e-5
        assert weights[k] == pytest.approx(-0.2 * gradient, abs=1e-5)
    assert intercept == pytest.approx(-0.02 * (loss({}, 1e-5) - loss({}, -1e-5)) / 2e-5, abs=1e-5)
    assert url_filter.holdout() >= 0.85 and len(set(url_filter.labelled_urls())) == len(url_filter.labelled_urls()) <= 200


def test_urls_empty_and_repeated(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES)).collect() == []
    rows = [tuple(r) for r in url_filter.judge(spark.createDataFrame([(1, "http://pills.example/buy", "")] * 3, PAGES)).collect()]
    assert len(rows) == 3 and len(set(rows)) == 1


def plain_feature(text):
    """Histograms of a text's frames and adaptive cuts, frame by frame."""
    p = payload(text)
    hist = []
    for a in range(0, len(p), 576):
        h = [0] * 16
        for b in p[a : a + 576]:
            h[b // 16] += 1
        hist.append([x / 576 for x in h])
    cuts, diffs = [0], []
    for t in range(1, len(hist)):
        d = sum(abs(a - b) for a, b in zip(hist[t], hist[t - 1], strict=True)) / 2
        mean = sum(diffs) / len(diffs) if diffs else 0.0
        spread = math.sqrt(sum((x - mean) ** 2 for x in diffs) / len(diffs)) if diffs else 0.0
        if d > 0.12 and d > mean + 3 * spread:
            cuts.append(t)
            diffs = []
        else:
            diffs.append(d)
    return f"frames={len(hist)};shots={len(cuts)};cuts={','.join(map(str, cuts))}"


def test_media_features_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    texts = [None, "", "a" * 3000, "".join(rng.choice(list("abc XYZ09é"), 5000)), "a" * 2000 + "\x01" * 2000 + "zé" * 900]
    want = [plain_feature(t) for t in texts]
    assert [r.feature for r in media.round_trip(docs_of(spark, texts)).collect()] == want
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    whole = [r for b in media._round_trip([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(media, "BLOCK", 1200)
    assert [r for b in media._round_trip([batch]) for r in b.to_pylist()] == whole
    assert media.round_trip(docs_of(spark, [])).collect() == []


def test_unreadable_media_are_rows(spark):
    good = media.write_avi(media.encode_frames(np.zeros((3, 576), np.uint8)))
    bad = [b"", b"no media", good[:60], good.replace(b"\xff\xc0", b"\xff\xc2"), good[: len(good) // 2], b"RIFF\0\0\0\0AVI "]
    rows = [(0, bytearray(good))] + [(i, bytearray(b)) for i, b in enumerate(bad, 1)]
    got = media.clips(spark.createDataFrame(rows, "k long, m binary"), "k", "m").collect()
    assert [r.id for r in got if r.error is None] == [0] and {r.id for r in got if r.error is not None} == set(range(1, len(bad) + 1))


def test_colour_frames():
    """Frames of three components, the first with two by two blocks a unit: the luma comes out row by row."""
    luma = np.array([[10, 60, 200, 255], [0, 90, 128, 31], [5, 6, 7, 8], [250, 240, 230, 220]])
    bits, pred = "", [0, 0, 0]

    def code(part, value):
        nonlocal bits
        d = value - 128 - pred[part]
        pred[part] += d
        n = int(abs(d)).bit_length()
        bits += format(n, "04b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"

    for y, x in itertools.product((0, 2), (0, 2)):
        for dy, dx in itertools.product((0, 1), (0, 1)):
            code(0, int(luma[y + dy, x + dx]))
        code(1, 77 + y), code(2, 150 - x)
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg, head = media._segment, media.HEAD
    tables = head[head.index(b"\xff\xc4") : head.index(b"\xff\xda")]
    frame = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8] * 64) + bytes([1]) + bytes([8] * 64)) + seg(0xC0, bytes([8, 0, 32, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])) + tables + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    colour, pixels = media.decode_frames([frame, frame])
    assert not pixels and (colour.reshape(2, 4, 4) == luma).all()


def test_archives_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


# --- long texts and pairs --------------------------------------------------------------------


def test_long_texts_with_any_characters(monkeypatch):
    tok = Tokenizer.from_file(entry.tokenizer_path())
    monkeypatch.setattr(packing, "PART", 500)
    words = packing.Words(entry.tokenizer_path())
    rng = np.random.default_rng(8)
    for _ in range(20):
        text = "".join(rng.choice(list("ab c.d\n\t日本é'́ <|endoftext|> 12"), 6000))
        assert words.parts(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_long_texts_in_joins(spark):
    long_ = base_text(60_000, 20)
    rows = [(1, long_), (2, long_ + " more"), (3, base_text(200, 21)), (4, f"{base_text(30_000, 22)} {base_text(30, 23)} {base_text(30_000, 24)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    items = spark.createDataFrame([(9, base_text(30, 23))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start_word) for r in decontaminate.contaminated(docs, items).collect()] == [(4, 9, 30_000)]


def test_equal_items_are_searched_once(spark, monkeypatch):
    """Forty equal items would not fit a block; each is reported, with the weights of all forty."""
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    a, b = base_text(20, 30), base_text(20, 31)
    items = [(i, a) for i in range(40)] + [(40, b), (41, f"{b} end"), (42, base_text(25, 32))]
    docs = [(1, f"x {a} y"), (2, f"{base_text(9, 33)} {b}"), (3, base_text(90, 34))]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == brute_leaks(docs, items)


def test_recall_is_whole():
    """300 items, each copied with one to three words changed: every pair that all windows give is found."""
    rng = np.random.default_rng(9)
    items = [(i, base_text(int(rng.integers(20, 70)), 100 + i)) for i in range(300)]
    docs = []
    for i, text in items:
        word = text.split()
        for at in rng.integers(0, len(word), int(rng.integers(1, 4))):
            word[at] = f"q{rng.integers(10**6)}"
        docs.append((i, f"{base_text(10, 500 + i)} {' '.join(word)} {base_text(5, 900 + i)}"))
    want = {}
    for (d, text), item in zip(docs, items, strict=True):
        want |= brute_leaks([(d, text)], [item])
    with np.errstate(over="ignore"):
        index = decontaminate.build([i for i, _ in items], pa.array([t for _, t in items]), 5)
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for b in decontaminate._search([batch], index, 5, 0.75) for r in b.to_pylist()}
    assert got == want and len(want) > 60


def test_scratch_tables_go_with_their_scope(spark):
    with common.scope(spark) as made:
        kept, path = common.saved(spark.range(3), "kept")
        common.saved(spark.range(3), "gone")
        assert len(made) == 2
        made.remove(path)
        gone = made[0]
    files = spark._jvm.org.apache.hadoop.fs
    there = lambda p: files.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(files.Path(p))
    assert kept.count() == 3 and there(path) and not there(gone)


def test_pack_crc_of_a_long_text(spark):
    text = "word " * 5000 + "日"
    tok = Tokenizer.from_file(entry.tokenizer_path())
    ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
    rows = packing.pack(docs_of(spark, [text]), entry.tokenizer_path(), ids=False).orderBy("piece").collect()
    assert [(r.start, r.length, r.ids_crc32) for r in rows] == [(a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for a in range(0, len(ids), 2048) for x in [ids[a : a + 2048]]]


# --- memory of workers -----------------------------------------------------------------------


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * resource.getpagesize() / 1e6


def test_kernels_give_memory_back():
    """200 MB of small blocks below one that stays: the C library keeps them unless it is told to trim."""
    stays = []

    def kernel(batches):
        for batch in batches:
            blocks = [bytearray(b"x" * 50_000) for _ in range(4000)]
            stays.append(bytearray(b"x" * 50_000))
            del blocks
            yield batch

    batch = pa.record_batch({"x": [1]})
    before = resident()
    assert list(common.on_batches(kernel)(iter([batch, batch]))) == [batch, batch]
    assert resident() - before < 60
