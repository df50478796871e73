"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming
blocks, exact weighted-shingle similarity.

Candidate items of a document are found by two ways.  Windows of an item's number
of words, aligned with a shingle of the item, are fingerprinted: each window's
64-bit SimHash (of its weighted shingles) is looked up in a multi-index: the
fingerprint is cut into five blocks, and two fingerprints within ``RADIUS`` = 19
bits agree in some block up to 3 bits, so probing all values within 3 bits of
each block finds every item within the radius.  What fingerprints miss is
completed without loss: an item whose rarest shingles (so many that the others
weigh less than the threshold's share of it) are all absent cannot reach the
threshold; all items that share one of these are candidates.

For each candidate the item-sized window slides over the whole document by one
word, the overlap being kept as a running sum, and the best window is verified
exactly: sum of minimum over sum of maximum of the shingles' weights in window
and item, a shingle's weight being 1 over the number of items of the whole
benchmark that hold it.

The items go to the tasks, equal texts once (hits are joined back with the ids
that share the text); they are split into blocks of at most about ``ITEMS`` texts and
``ITEM_BYTES`` bytes, and the documents are read once for each block.  Shingles'
holders are counted over all items before; every block is sent the weights of all
shingles that two items or more hold (16 bytes each), so the split changes no result.

Texts are told apart by 64-bit hashes.

Defined cases: null and empty texts and items without words match nothing;
items shorter than a shingle are one shingle of all their words; repeated
documents and items match each; an item of null id is reported with null id;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import on_batches

BLOCK = 2_000_000
ITEMS, ITEM_BYTES = 20_000, 16_000_000
PAIRS = 1_000_000
RADIUS = 19
WIDTHS = (13, 13, 13, 13, 12)
_FLIPS = RADIUS // len(WIDTHS)
_LUT = 20


@dataclass
class Index:
    ids: list
    size: np.ndarray  # words of items
    shingles: list[dict[int, int]]  # with counts
    shared: tuple[np.ndarray, np.ndarray]  # shingles that several items of the whole benchmark hold, and their weights
    prints: np.ndarray  # uint64
    blocks: list[tuple[np.ndarray, np.ndarray]]  # of each block: offsets by value, items
    hit: dict[int, dict[int, list[tuple[int, int]]]]  # shingle length -> shingle -> (item's size, place in it)
    maybe: dict[int, np.ndarray]  # shingle length -> low bits that occur
    sets: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]  # of items: sorted shingles, counts, weights, weight in all
    rare: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # shingle length -> rare shingles, offsets, items that hold them


def simhash(shingles: np.ndarray, weight: np.ndarray) -> np.uint64:
    """Sign of the weighted sum of the shingles' bits."""
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8)).reshape(-1, 64)
    sign = (2.0 * bits - 1).T @ weight > 0
    return np.packbits(sign).view(">u8")[0].astype(np.uint64)


def weigh(shared: tuple[np.ndarray, np.ndarray], shingles: np.ndarray) -> np.ndarray:
    """1 over the number of items that hold a shingle; 1 too where none does."""
    keys, weight = shared
    if not len(keys):
        return np.ones(len(shingles))
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    return np.where(keys[at] == shingles, weight[at], 1.0)


def table_of(holders: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((x, n) for x, n in holders.items() if n > 1)
    return np.array([x for x, _ in rows], np.uint64), np.array([1.0 / n for _, n in rows], float)


def build(ids: list, texts: pa.Array, k: int, shared: tuple[np.ndarray, np.ndarray] | None = None, least: float = 0.75) -> Index:
    """Index of some items; ``shared`` are the whole benchmark's weights (else these items are all)."""
    w = wh.words(texts)
    h = w.hashes()
    size = w.counts
    shingles, hit, holders = [], defaultdict(lambda: defaultdict(list)), defaultdict(int)
    for i in range(len(size)):
        word = h[w.first[i] : w.first[i + 1]]
        length = min(k, len(word))
        s, _ = wh.shingle_hashes(word, np.array([0, len(word)]), k)
        counts: dict[int, int] = defaultdict(int)
        for at, x in enumerate(s.tolist()):
            counts[x] += 1
            if (len(word), at) not in hit[length][x]:
                hit[length][x].append((len(word), at))
        for x in counts:
            holders[x] += 1
        shingles.append(dict(counts))
    shared = table_of(holders) if shared is None else shared
    prints = np.array([simhash(x := np.array(list(c), np.uint64), weigh(shared, x) * list(c.values())) if c else 0 for c in shingles], np.uint64)
    blocks, shift = [], 0
    full = np.flatnonzero(size > 0)
    for width in WIDTHS:
        value = (prints[full] >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        blocks.append((np.searchsorted(value[order], np.arange((1 << width) + 1)), full[order]))
        shift += width
    maybe = {}
    for length, found in hit.items():
        maybe[length] = np.zeros(1 << _LUT, dtype=bool)
        maybe[length][np.array(list(found), np.uint64).astype(np.int64) & ((1 << _LUT) - 1)] = True
    sets, first = [], defaultdict(list)
    for i, c in enumerate(shingles):
        keys = np.sort(np.array(list(c), np.uint64))
        counts = np.array([c[x] for x in keys.tolist()], np.int64)
        weight = weigh(shared, keys)
        total = float(weight @ counts)
        sets.append((keys, counts, weight, total))
        # The rarest shingles, until those left cannot reach the threshold by themselves.
        order = np.argsort(-weight, kind="stable")
        left = total - np.cumsum((weight * counts)[order])
        first[min(k, int(size[i]))] += [(x, i) for x in keys[order[: int(np.count_nonzero(left >= least * total - 1e-9)) + 1]].tolist()]
    rare = {}
    for length, rows in first.items():
        if rows:
            rows.sort()
            keys, offsets = np.unique(np.array([x for x, _ in rows], np.uint64), return_index=True)
            rare[length] = keys, np.append(offsets, len(rows)), np.array([i for _, i in rows], np.int64)
    return Index(ids, size, shingles, shared, prints, blocks, {a: dict(b) for a, b in hit.items()}, maybe, sets, rare)


def probe(index: Index, prints: np.ndarray) -> list[np.ndarray]:
    """All items within the radius of each fingerprint."""
    out: list[list[np.ndarray]] = [[] for _ in prints]
    shift = 0
    for width, (offsets, items) in zip(WIDTHS, index.blocks, strict=True):
        flips = np.array([sum(1 << b for b in c) for n in range(_FLIPS + 1) for c in combinations(range(width), n)])
        value = (prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        shift += width
        for at in range(0, len(prints), 2048):
            near = value[at : at + 2048, None] ^ flips
            size = (offsets[near + 1] - offsets[near]).ravel()
            total = int(size.sum())
            spot = np.repeat(offsets[near].ravel() - (np.cumsum(size) - size), size) + np.arange(total)
            owner = np.repeat(np.repeat(np.arange(len(near)) + at, len(flips)), size)
            found = items[spot]
            close = np.bitwise_count(prints[owner] ^ index.prints[found]) <= RADIUS
            for o, i in zip(owner[close].tolist(), found[close].tolist(), strict=True):
                out[o].append(i)
    return [np.unique(x) for x in out]


def similarity(index: Index, window: dict[int, int], item: int) -> float:
    low = high = 0.0
    other = index.shingles[item]
    both = sorted(window.keys() | other.keys())
    for x, w in zip(both, weigh(index.shared, np.array(both, np.uint64)).tolist(), strict=True):
        a, b = window.get(x, 0), other.get(x, 0)
        low += w * min(a, b)
        high += w * max(a, b)
    return low / high if high else 0.0


def _sharing(index: Index, length: int, s: np.ndarray, at: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Rows ``(text, item)`` of all items that share a rare shingle with a text."""
    keys, offsets, items = index.rare[length]
    code = np.minimum(np.searchsorted(keys, s[hits]), len(keys) - 1)
    same = keys[code] == s[hits]
    text = np.searchsorted(at, hits[same], side="right") - 1
    seen = np.unique(text * len(keys) + code[same])
    text, code = seen // len(keys), seen % len(keys)
    size = offsets[code + 1] - offsets[code]
    total, out = np.cumsum(size), [np.zeros(0, np.int64)]
    i = 0
    while i < len(seen):
        j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + PAIRS, side="right")))
        n = size[i:j]
        spot = np.repeat(offsets[code[i:j]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(np.unique(np.repeat(text[i:j], n) * len(index.ids) + items[spot]))
        i = j
    pairs = np.unique(np.concatenate(out))
    return np.stack((pairs // len(index.ids), pairs % len(index.ids)), 1)


def best_window(index: Index, s: np.ndarray, weight: np.ndarray, n_words: int, item: int, least: float) -> tuple[float, int] | None:
    """Similarity and first word of the best of all item-sized windows of a text, if at ``least`` or more.

    ``s`` are the text's shingles of the item's shingle length, ``weight`` the running sum of their weights.
    """
    keys, counts, own, total = index.sets[item]
    size = int(index.size[item])
    code = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    q = np.flatnonzero(keys[code] == s)
    code = code[q]
    if own @ np.minimum(np.bincount(code, minlength=len(keys)), counts) < least * total - 1e-9:
        return None
    # A text shorter than the item is one window.
    m = size - (n_words - len(s)) if n_words >= size else len(s)
    last = len(s) - m
    # An occurrence adds to the windows that hold it and fewer than the item's count of it before.
    order = np.argsort(code, kind="stable")
    q, code = q[order], code[order]
    back = np.arange(len(q)) - counts[code]
    before = np.where((back >= 0) & (code[back] == code), q[back], -1)
    lo, hi = np.maximum(np.maximum(q - m, before) + 1, 0), np.minimum(q, last)
    ok = lo <= hi
    step = np.zeros(last + 2)
    np.add.at(step, lo[ok], own[code[ok]])
    np.add.at(step, hi[ok] + 1, -own[code[ok]])
    low = np.cumsum(step)[: last + 1]
    value = low / (weight[m:] - weight[: last + 1] + total - low)
    if value.max() < least - 1e-9:
        return None
    # Running sums are rounded; windows that may be the best are compared exactly.
    best, known = None, {}
    for a in np.flatnonzero(value >= value.max() - 1e-9).tolist():
        name = s[a : a + m].tobytes()
        if name not in known:
            x, n = np.unique(s[a : a + m], return_counts=True)
            known[name] = similarity(index, dict(zip(x.tolist(), n.tolist(), strict=True)), item)
        if known[name] >= least - 1e-12 and (best is None or known[name] > best[0]):
            best = known[name], a
    return best


def _search(batches, index: Index, k: int, least: float):
    names = ["doc_id", "item_id", "similarity", "start_word", "n_words"]
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j in wh.slices(batch.column(1), BLOCK):
                w = wh.words(batch.column(1).slice(i, j - i))
                h, count = w.hashes(), w.counts
                spots: set[tuple[int, int, int]] = set()  # text, first word, words
                runs, pairs = {}, set()
                for length, found in index.hit.items():
                    # Every run of so many words, whatever the text's length.
                    s, at = wh.shingle_hashes(h, w.first, length)
                    if length < k:
                        s = np.where(np.repeat(count, np.diff(at)) >= length, s, 0)
                    hits = np.flatnonzero(index.maybe[length][(s & np.uint64((1 << _LUT) - 1)).astype(np.int64)])
                    runs[length] = s, at
                    pairs.update(map(tuple, _sharing(index, length, s, at, hits).tolist()))
                    for p in hits.tolist():
                        if places := found.get(int(s[p])):
                            d = int(np.searchsorted(at, p, side="right")) - 1
                            word = p - int(at[d])
                            n = int(count[d])
                            for size, place in places:
                                first = max(0, min(word - place, n - size))
                                spots.add((d, first, size))
                if not spots:
                    continue
                todo = sorted(spots)
                prints = []
                for d, first, size in todo:
                    a = int(w.first[d]) + first
                    word = h[a : min(a + size, int(w.first[d + 1]))]
                    s, _ = wh.shingle_hashes(word, np.array([0, len(word)]), k)
                    x, n = np.unique(s, return_counts=True)
                    prints.append(simhash(x, weigh(index.shared, x) * n))
                for (d, _, size), items in zip(todo, probe(index, np.array(prints, np.uint64)), strict=True):
                    # A window is compared with items of its own size.
                    pairs.update((d, x) for x in items.tolist() if index.size[x] == size)
                rows, now = [], None
                for d, item in sorted(pairs):
                    length = min(k, int(index.size[item]))
                    if now != (d, length):
                        now = d, length
                        s, at = runs[length]
                        s = s[at[d] : at[d + 1]]
                        weight = np.concatenate(([0.0], np.cumsum(weigh(index.shared, s))))
                    if best := best_window(index, s, weight, int(count[d]), item, least):
                        rows.append((d, item, round(best[0], 6), best[1], min(int(index.size[item]), int(count[d]))))
                if rows:
                    doc = batch.column(0).slice(i, j - i).take(pa.array([r[0] for r in rows]))
                    yield pa.RecordBatch.from_arrays([doc, pa.array([index.ids[r[1]] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], y) for c, y in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))], names)


def _held(batches, k: int):
    """Each item's distinct shingles."""
    with np.errstate(over="ignore"):
        for batch in batches:
            w = wh.words(batch.column(0))
            h, out = w.hashes(), [np.zeros(0, np.uint64)]
            for i in range(len(w.counts)):
                word = h[w.first[i] : w.first[i + 1]]
                out.append(np.unique(wh.shingle_hashes(word, np.array([0, len(word)]), k)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["shingle"])


def weights(items: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the shingles that two items or more hold, counted over all items; any other shingle weighs 1."""
    t = items.select("text").mapInArrow(on_batches(_held, k=k), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    keys = t.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], 1.0 / t.column("n").to_numpy()[order]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, least: float = 0.75) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, n_words)``: the best window of every document and item at ``least`` or more."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("text is not null").withColumn("key", F.xxhash64("text"))
    texts = items.groupBy("key").agg(F.first("text").alias("text"))
    number, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Dealt by a hash, so blocks are planned for half.
    blocks = max(1, math.ceil(number / (ITEMS / 2)), math.ceil(size / (ITEM_BYTES / 2)))
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    shared = weights(items, k)
    out = None
    for b in range(blocks):
        part = texts.where(F.pmod(F.hash("key"), F.lit(blocks)) == b).toArrow()
        with np.errstate(over="ignore"):
            index = build(part.column("key").to_pylist(), part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string()), k, shared, least)
        found = rows.mapInArrow(on_batches(_search, index=index, k=k, least=least), "doc_id long, item_id long, similarity double, start_word long, n_words long")
        out = found if out is None else out.union(found)
    names = items.select("id", "key")
    return out.join(names, out.item_id == names.key).select("doc_id", F.col("id").alias("item_id"), "similarity", "start_word", "n_words")
