"""Language identification: script ranges, per-word scores, Viterbi spans.

A word is a run of letter bytes (A-Z, a-z and every non-ASCII byte).  The
script of its first character narrows the candidates to the languages that
use that script in training; its score in a language is the sum of
log-likelihoods of its hashed byte trigrams, edges included.  Viterbi over the
words, with a penalty for each change of language, labels spans; a document's
language is the one that covers most letter bytes.

A long text is cut, for Viterbi, at words whose best language beats every other
by more than twice the penalty: any best path has that language there, so the
parts are labelled side by side without changing the result.

Training counts trigrams on the executors, over at most about ``max_rows``
labelled rows: an equal share of them for every language (all rows of a
language that has fewer), chosen by a hash of the id.  One table of languages x
2^16 counts is gathered; a column of more than ``MOST`` distinct languages is
no language column and raises ValueError.

Defined cases: a text that is null or has no letter gets ``und`` and score 0;
ties go to the alphabetically first language.  Without any labelled row every
text gets ``und``.  Repeated rows are each labelled; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import on_batches

BLOCK = 2_000_000
BITS = 16
#: Distinct languages that a model may have (its table takes 256 kB a language).
MOST = 1024
#: Words of a text's part, at least, where it is cut for Viterbi.
PART = 1024
#: Script by the first byte of a character (fixed ranges of UTF-8): 0 Latin, 1 Greek, 2 Cyrillic, 3 Armenian or Hebrew,
#: 4 Arabic, 5 Indic and South-East Asian, 6 kana, CJK marks, 7 Han, 8 Hangul, 9 other planes.
_SCRIPT = np.zeros(256, dtype=np.int8)
for _from, _to, _id in ((0xCD, 0xCF, 1), (0xD0, 0xD3, 2), (0xD4, 0xD7, 3), (0xD8, 0xDF, 4), (0xE0, 0xE1, 5), (0xE2, 0xE3, 6), (0xE4, 0xE9, 7), (0xEA, 0xED, 8), (0xEE, 0xF7, 9)):
    _SCRIPT[_from : _to + 1] = _id
SCRIPTS = 10
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Model:
    langs: list[str]  # in alphabetical order
    score: np.ndarray  # (2^BITS, languages) log-likelihoods
    allowed: np.ndarray  # (SCRIPTS, languages)
    penalty: float = 8.0


def _trigrams(column: pa.Array):
    """Per letter byte its trigram's bucket; per word where its bytes begin; word offsets of texts, byte spans."""
    raw, at = wh.flat(column)
    data = wh.LOWER[raw]
    letter = _LETTER[data]
    body = np.where(letter, data, 32).astype(np.uint32)
    n = len(body)
    before, after = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    before[1:], after[:-1] = body[:-1], body[1:]
    inner = at[(at > 0) & (at < n)]
    before[inner], after[inner - 1] = 32, 32
    gram = ((before * 65599 + body) * 65599 + after) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    spot = np.flatnonzero(letter)
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    fresh = cut[spot].copy()
    if len(spot):
        fresh[0] = True
        fresh[1:] |= np.diff(spot) > 1
    begin = np.flatnonzero(fresh)
    return gram[spot], begin, spot, np.searchsorted(spot[begin], at), raw, at, data


def _count(batches, langs: None = None):
    """Counts of trigram buckets and scripts by language over a partition's labelled texts."""
    tables: dict[str, np.ndarray] = {}
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j in wh.slices(batch.column(1), BLOCK):
                text, lang = batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i).to_pylist()
                gram, begin, spot, first, _, at, data = _trigrams(text)
                size = np.diff(np.r_[begin, len(spot)])
                byte_of = np.searchsorted(spot, at)
                for d, name in enumerate(lang):
                    t = tables.setdefault(name, np.zeros((1 << BITS) + SCRIPTS, dtype=np.int64))
                    g = gram[byte_of[d] : byte_of[d + 1]]
                    np.add.at(t, g, 1)
                    w = slice(first[d], first[d + 1])
                    np.add.at(t, (1 << BITS) + _SCRIPT[data[spot[begin[w]]]].astype(np.int64), size[w])
    for name, t in tables.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])], ["lang", "bucket", "n"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000, penalty: float = 8.0) -> Model:
    """Learn from rows with text and language; about ``max_rows`` of them where there are more."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().limit(MOST + 1).collect()}
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages in {lang_col}")
    if sum(sizes.values()) > max_rows:
        # A language without a full share takes all its rows and leaves the rest of its share to the others.
        left, shares = max_rows, {}
        for i, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
            take = min(n, max(1, left // (len(sizes) - i)))
            shares[name] = math.ceil((1 << 20) * take / n)
            left -= take
        share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col(lang_col)]
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < share)
    counts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(on_batches(_count), "lang string, bucket int, n long")
    t = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(t.column("lang").to_pylist()))
    table = np.zeros(((1 << BITS) + SCRIPTS, len(langs)))
    where = {x: i for i, x in enumerate(langs)}
    if langs:
        np.add.at(table, (t.column("bucket").to_numpy(), np.array([where[x] for x in t.column("lang").to_pylist()])), t.column("n").to_numpy())
    gram, script = table[: 1 << BITS], table[1 << BITS :]
    score = np.log((gram + 0.5) / (gram.sum(0) + 0.5 * (1 << BITS)))
    allowed = script > 0.001 * np.maximum(script.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(langs, score.astype(np.float32), allowed, penalty)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; texts ``first[i]:first[i+1]`` advance in step, longest first.

    A tie goes to the language that comes first.
    """
    n, k = score.shape
    if not k:
        return np.zeros(n, dtype=np.int32)
    first, again = _parts(score, first, penalty)
    if len(again):
        # The word at which a text is cut stands in both parts; its second copy is dropped from the result.
        rows = np.sort(np.concatenate((np.arange(n), again)), kind="stable")
        copy = np.zeros(len(rows), dtype=bool)
        copy[1:] = rows[1:] == rows[:-1]
        return _in_step(score[rows], first, penalty)[~copy]
    return _in_step(score, first, penalty)


def _parts(score: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts' parts, counting the words at cuts twice, and those words."""
    k = score.shape[1]
    long_ = np.flatnonzero(np.diff(first) > 2 * PART)
    if not len(long_) or k < 2:
        return first, np.zeros(0, np.int64)
    cuts = []
    for d in long_.tolist():
        a, b = int(first[d]), int(first[d + 1])
        top = np.partition(score[a:b], k - 2, axis=1)[:, k - 2 :]
        sure = a + np.flatnonzero(top[:, 1] - top[:, 0] > 2 * penalty + 1e-3)
        at = a
        while True:
            i = int(np.searchsorted(sure, at + PART))
            if i == len(sure) or sure[i] >= b - 1:
                break
            at = int(sure[i])
            cuts.append(at)
    again = np.array(cuts, np.int64)
    # Part ends: every text's, and each cut's word (kept in the part before it).
    ends = np.concatenate((first[1:], again + 1))
    kind = np.concatenate((np.zeros(len(first) - 1, np.int64), np.ones(len(again), np.int64)))
    order = np.lexsort((kind, ends))
    ends, kind = ends[order], kind[order]
    return np.concatenate(([0], ends + np.cumsum(kind) - kind)), again


def _in_step(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    n, k = score.shape
    kind = np.uint8 if k <= 256 else np.uint16
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    back, own = np.zeros((n, k), dtype=kind), np.arange(k, dtype=kind)
    value = np.zeros((len(count), k), dtype=np.float32)
    steps = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(steps), side="left")  # texts longer than t
    for t in range(steps):
        m = live[t]
        at, v = begin[:m] + t, value[:m]
        best = v.argmax(1)
        change = (v[np.arange(m), best] - penalty)[:, None]
        stay = v >= change
        back[at] = np.where(stay, own, best[:, None].astype(kind))
        v = np.where(stay, v, change) + score[at]
        value[:m] = v - v.max(1, keepdims=True)
    label = np.zeros(n, dtype=np.int32)
    state = value.argmax(1)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        label[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return label


def _label(batches, model: Model, spans: bool, text_at: int, kept: list[int]):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    k = len(model.langs)
    score, allowed = model.score, np.where(model.allowed, 0, -1e6).astype(np.float32)
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j in wh.slices(batch.column(text_at), BLOCK * 8 // max(k, 8)):
                text, m = batch.column(text_at).slice(i, j - i), j - i
                gram, begin, spot, first, raw, at, data = _trigrams(text)
                w = len(begin)
                size = np.diff(np.r_[begin, len(spot)])
                each = np.empty((w, k), dtype=np.float32)
                for x in range(k):
                    each[:, x] = np.add.reduceat(score[gram, x], begin) if w else 0
                if w and k:
                    each += allowed[_SCRIPT[data[spot[begin]]]]
                label = viterbi(each, first, model.penalty)
                owner = np.repeat(np.arange(m), np.diff(first))
                cover = np.bincount(owner * max(k, 1) + label, weights=size, minlength=m * max(k, 1)).reshape(m, max(k, 1))
                total = cover.sum(1)
                top = cover.argmax(1)
                known = (total > 0) & (k > 0)
                # Bytes beyond ASCII need not be letters.
                ascii_ = np.r_[0, np.cumsum(data[spot] < 128)]
                to = np.searchsorted(spot, at)
                for d in np.flatnonzero(known & (ascii_[to[1:]] == ascii_[to[:-1]])):
                    known[d] = any(c.isalpha() for c in text[int(d)].as_py())
                lang = [model.langs[t] if ok else "und" for t, ok in zip(top.tolist(), known.tolist(), strict=True)]
                share = np.where(known, cover.max(1) / np.maximum(total, 1), 0.0)
                out = [*(batch.column(c).slice(i, m) for c in kept), pa.array(lang, pa.string()), pa.array(share)]
                if spans:
                    out.append(pa.array(_spans(label, first, begin, spot, size, raw, at, known, model.langs), kind))
                yield pa.RecordBatch.from_arrays(out, [*(batch.schema.names[c] for c in kept), "lang_pred", "score", *["spans"] * spans])


def _spans(label, first, begin, spot, size, raw, at, known, langs):
    """Runs of one language in code points, from the first word's start to the last word's end."""
    point = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    out = []
    for d in range(len(first) - 1):
        a, b = first[d], first[d + 1]
        if not known[d] or a == b:
            out.append([])
            continue
        head = a + np.flatnonzero(np.r_[True, label[a + 1 : b] != label[a : b - 1]])
        tail = np.r_[head[1:], b] - 1
        zero = point[at[d]]
        out.append([{"start": int(point[spot[begin[x]]] - zero), "end": int(point[spot[begin[y] + size[y] - 1] + 1] - zero), "lang": langs[label[x]]} for x, y in zip(head, tail, strict=True)])
    return out


def label(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", spans: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score`` (and spans) after them."""
    at = [docs.columns.index(c) for c in keep]
    schema = ", ".join(f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in at)
    schema += ", lang_pred string, score double" + ", spans array<struct<start: bigint, end: bigint, lang: string>>" * spans
    return docs.mapInArrow(on_batches(_label, model=model, spans=spans, text_at=docs.columns.index(text_col), kept=at), schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """``(doc_id, lang_pred, score[, spans])``; score is the share of letter bytes in spans of the language."""
    return label(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"], spans=spans)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2
