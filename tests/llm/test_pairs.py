"""Jaccard join, decontamination and personal data against brute force."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import common, decontaminate, jaccard_join, pii

DOCS = "doc_id long, text string, n int, key string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def shingles(text, k=5):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def brute_links(rows):
    sets = [(d, frozenset(shingles(t))) for d, t in rows]
    return {d: sum(100 * len(a & b) >= 75 * len(a | b) for j, (_, b) in enumerate(sets) if j != i) if a else 0 for i, (d, a) in enumerate(sets)}


def brute_components(rows):
    sets = {d: frozenset(shingles(t)) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def base_text(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def test_components_edge_cases(spark):
    long_ = base_text(400, 1)
    near = [" ".join([*long_.split()[:i], "Changed", *long_.split()[i + 1 :]]) for i in range(30, 330, 20)]
    texts = [None, "", "  \t\n", "one", "ONE", "a b c", "A b  c", "a b c d e", "a b c d e f", "q r s t u v w", "q r s t u v w x", "é É é É é", long_, long_.upper(), long_ + " tail", *near, base_text(60, 2), base_text(60, 3)]
    rows = [(i, t, i, "x") for i, t in enumerate(texts, 5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components([r[:2] for r in rows])


def near_copies(groups, each, words_, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = base_text(words_, 10 + g).split()
        for _ in range(each):
            w = list(base[: words_ - rng.integers(0, words_ // 3)])
            for i in rng.integers(0, len(w), rng.integers(0, 4)):
                w[i] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w), 0, "k"))
    return rows


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df}, {r.doc_id: r.n_links for r in df}


def test_links_by_brute_force(spark):
    rows = near_copies(6, 40, 80)
    rows += [(len(rows) + i, rows[3 * i][1], 0, "k") for i in range(30)]
    got, links = result(jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_components([r[:2] for r in rows]) and links == brute_links([r[:2] for r in rows])


@pytest.mark.parametrize(("cell", "members", "fragment"), [(400, 8, 100), (10_000, 16, 500)])
def test_large_groups_are_cut_without_loss(spark, monkeypatch, cell, members, fragment):
    for name, value in {"CELL": cell, "MEMBERS": members, "FRAGMENT": fragment, "QUERIES": 3, "STEP": 50}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(3, 25, 80)
    got, links = result(jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_components([r[:2] for r in rows]) and links == brute_links([r[:2] for r in rows])


def test_a_group_of_many_sets(spark):
    """20,000 unlike texts around one: each differs from it in its last words, so all link with all."""
    base = base_text(40, 4)
    rows = spark.range(20_000).selectExpr("id AS doc_id", f"concat('{base}', ' v', id, ' u', id) AS text")
    got = jaccard_join.jaccard_components(rows).groupBy("n_shingles", "component_id", "n_links").count().collect()
    assert [tuple(r) for r in got] == [(38, 0, 19_999, 20_000)]


def test_hot_shingles_are_found_from_all_texts(spark):
    """A passage in 0.3 % of 30,000 texts, in no block more than a few times, and one in two texts."""
    rows = [" ".join(f"w{x}" for x in r) for r in np.random.default_rng(3).integers(0, 10**6, (30_000, 12))]
    for i in range(0, 30_000, 333):
        rows[i] += " the passage of five words"
    with np.errstate(over="ignore"):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["doc_id", "text"])
        found = [(r["hot"], r["texts"]) for b in jaccard_join._scan([batch], 5) for r in b.to_pylist() if r["hot"] is not None]
        values = jaccard_join._sets(pa.array(["the passage of five words"]), 5)[0]
    assert dict(found).get(int(values.view(np.int64)[0]), 0) >= 30_000 * jaccard_join.HOT_SHARE and len(found) < 50


def test_a_text_without_id_links_others(spark):
    w = base_text(50, 9).split()
    rows = [(7, " ".join(w), 0, "k"), (None, " ".join([*w, *"abcdefgh"]), 0, "k"), (5, " ".join([*w, *"abcdefghijklmnop"]), 0, "k")]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {7: (5, 1), None: (5, 2), 5: (5, 1)}


def test_hot_shingles(spark):
    """A passage in all texts, and a third of the rows near copies of one text."""
    line, base = base_text(12, 5), base_text(60, 6).split()
    rows = [(i, f"{line} {base_text(40, 100 + i)}", 0, "k") for i in range(80)]
    rows += [(100 + i, " ".join([*base[: i % 50], f"z{i}", *base[i % 50 + 1 :]]), 0, "k") for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components([r[:2] for r in rows])


def test_components_on_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_no_rows_null_ids_and_repeated_rows(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e f", 1, "x"), (3, "a b c d e f", 1, "x"), (3, "a b c d e f", 1, "x")]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [(3, 2, 3, 2), (3, 2, 3, 2), (None, 2, 3, 2)]


@pytest.mark.parametrize("nodes", [0, 10**6])
def test_graph_components(spark, monkeypatch, nodes):
    monkeypatch.setattr(common, "NODES", nodes)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_leaks(docs, items, least=0.75):
    holders = collections.Counter(x for _, t in items for x in set(shingles(t)))
    weight = lambda x: 1 / holders[x] if x in holders else 1.0
    out = {}
    for d, text in docs:
        w = words(text)
        for i, t in items:
            n, want = len(words(t)), collections.Counter(shingles(t))
            for a in range(max(1, len(w) - n + 1)) if n and w else ():
                has = collections.Counter(shingles(" ".join(w[a : a + n])))
                both = has.keys() | want.keys()
                s = sum(weight(x) * min(has[x], want[x]) for x in both) / sum(weight(x) * max(has[x], want[x]) for x in both)
                if s >= least - 1e-12 and s > out.get((d, i), 0):
                    out[d, i] = s
    return {k: round(v, 6) for k, v in out.items()}


def test_leaks(spark):
    items = [(1, base_text(20, 1)), (2, base_text(40, 2)), (3, "only four words here"), (4, None), (5, ""), (6, base_text(20, 1) + " more"), (7, base_text(59, 7))]
    edited = base_text(40, 2).split()
    edited[0], edited[39] = "new", "end"
    middle = base_text(59, 7).split()
    middle[30] = "other"
    texts = [None, "", base_text(100, 9), f"{base_text(30, 8)} {items[0][1].upper()} {base_text(30, 10)}", " ".join(edited), f"x {items[2][1]} y", "only four words there", f"{' '.join(middle)} {items[1][1]}", " ".join(items[1][1].split()[:20]), items[1][1][:60]]
    docs = [(i, t, i, "k") for i, t in enumerate(texts)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == brute_leaks([d[:2] for d in docs], items)
    assert decontaminate.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_of_templated_items():
    """Most of an item's shingles are held by nine others, so few shingles make its fingerprint."""
    rng = np.random.default_rng(8)
    template = base_text(104, 90).split()
    items = [(i, " ".join([*template, *base_text(6, 91 + i).split()])) for i in range(10)]
    docs = []
    for d in range(150):
        word = items[d % 10][1].split()
        word[:4] = [f"z{x}" for x in rng.integers(0, 10**6, 4)]
        docs.append((d, " ".join(word)))
    want = brute_leaks(docs, items)
    with np.errstate(over="ignore"):
        index = decontaminate.build([i for i, _ in items], pa.array([t for _, t in items]), 5)
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
        got = [r for b in decontaminate._search([batch], index, 5, 0.75) for r in b.to_pylist()]
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == want
    assert len(want) > 50


def test_leaks_off_alignment(spark):
    """The item's halves in swapped order: the window over both is aligned with no shingle."""
    items = [(1, base_text(36, 31)), (2, base_text(45, 32)), (3, "a b c d e f g " * 4)]
    docs = [(i, f"{base_text(30, 33 + i)} {' '.join([*t.split()[len(t.split()) // 2 :], *t.split()[: len(t.split()) // 2]])} {base_text(30, 43 + i)}") for i, t in items]
    docs += [(9, "a b c d e f g " * 9), (10, f"{items[0][1]} {' '.join(items[0][1].split()[5:])} {items[1][1]}")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == want
    assert {(1, 1), (2, 2), (9, 3), (10, 1), (10, 2)} <= set(want)


def test_leaks_in_blocks_weigh_as_in_one(spark, monkeypatch):
    """Items that share a template, split into blocks of about two."""
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    template = base_text(24, 40)
    items = [(i, f"{template} {base_text(9, 50 + i)}") for i in range(8)]
    docs = [(i, f"{base_text(10, 60 + i)} {template} {' '.join(base_text(9, 50 + i).split()[: 9 - i])} {base_text(12, 80 + i)}") for i in range(8)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == want
    assert 0 < len(want) < 8


def test_leaks_on_data(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 1500][:60]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs += [(10_000 + i, f"{base_text(20, i)} {t} {base_text(9, i)}") for i, t in items[:10]]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == brute_leaks(docs, items)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    index = decontaminate.build([1], __import__("pyarrow").array(["a b c d e f"]), 5)
    prints = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = prints[:100].copy()
    for i in range(100):
        for b in rng.choice(64, i % 24, replace=False):
            near[i] ^= np.uint64(1 << int(b))
    index.prints = prints
    index.blocks, shift = [], 0
    for width in decontaminate.WIDTHS:
        value = (prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        index.blocks.append((np.searchsorted(value[order], np.arange((1 << width) + 1)), order))
        shift += width
    for found, p in zip(decontaminate.probe(index, near), near, strict=True):
        assert found.tolist() == np.flatnonzero(np.bitwise_count(prints ^ p) <= decontaminate.RADIUS).tolist()


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_random():
    rng = np.random.default_rng(1)
    alphabet = list("0123456789" * 3 + "..@@--++  ()ab٣é,")
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("1" * 50_000, "a" * 50_000 + "@", "1." * 20_000, "a@b." * 9_000, "x@y.z@u.v", "a@b.c4111 1111 1111 1111", "+1 (988) 555-2485", "256.1.1.1 0001.002.3.4"):
        assert pii.base_spans(text) == plain_spans(text) if len(text) < 99 else pii.base_spans(text) is not None


def test_field_adds_repeats_and_keeps_the_rest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(9000 + i, f"call +1 (900) 555-{1000 + i} or write ab{i}@mail.example.com from 10.0.0.{i} now") for i in range(60)], "doc_id long, text string")
    model = pii.train(docs.select("doc_id", "text").union(more))
    text = "Ring +1 (900) 555-7777 today, again 555-7777 please; page 12 of 2024."
    rows = [(1, text, 1, "k"), (2, None, 1, "k"), (3, "", 1, "k"), (1, text, 1, "k"), (4, "nothing here but 7 words", 1, "k")]
    got = [(r.doc_id, [(text[s.start : s.end], s.kind, s.base) for s in r.spans]) for r in pii.spans(spark.createDataFrame(rows, DOCS), model).collect()]
    assert got[0] == got[3]
    assert ("+1 (900) 555-7777", "phone", True) in got[0][1]
    assert ("555-7777", "phone", False) in got[0][1]
    assert all("2024" not in s[0] and s[0] != "12" for s in got[0][1])
    assert got[1][1] == got[2][1] == got[4][1] == []
    redacted = pii.redact(spark.createDataFrame(rows, DOCS), model).collect()
    assert redacted[0].text == "Ring <PHONE> today, again <PHONE> please; page 12 of 2024." and redacted[1].text is None and redacted[0].key == "k"


def test_field_reaches_every_repetition(spark, sf):
    """A number fixed once, then bare a hundred times, and once in spaced groups."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(9000 + i, f"call +1 (900) 555-{1000 + i} or write ab{i}@mail.example.com from 10.0.0.{i} now") for i in range(60)], "doc_id long, text string")
    model = pii.train(docs.select("doc_id", "text").union(more))
    for bare in ("555-7777", "5557777"):
        text = "Ring +1 (900) 555-7777 today" + f", again {bare} please" * 100 + "; page 12 of 2024, room 5558888."
        base, added = pii.find(text, model)
        assert len(base) == 1 and [text[a:b] for a, _, b in added] == [bare] * 100 and {k for _, k, _ in added} == {3}
    text = "Ring +1 (900) 555-7777 today, again 900 555 7777 please; page 12 of 2024, room 900 555 8888."
    base, added = pii.find(text, model)
    assert len(base) == 1 and [(text[a:b], k) for a, k, b in added] == [("900 555 7777", 3)]


def test_long_runs_and_many_spans_cost_one_pass():
    """Texts on which retrying at every character, or every pair of spans, would take minutes."""
    text = " ".join(f"u{i}@mail.example.com +1 (988) 555-{i % 9000 + 1000} or 555-{i % 9000 + 1000} by" for i in range(3000))
    model = pii.Model({}, np.array([[4.0, 0, 0, 0, 0]]), np.eye(5), np.eye(5) * 2)
    for odd in ("x" * 300_000, "-" * 100_000 + "5" + "-" * 100_000, "é" * 100_000 + "1" * 100_000):
        assert pii.find(odd, model) == ([], [])
    base, _ = pii.find(text, model)
    assert base == pii.base_spans(text) and len(base) == 6000
