"""Personal data: base patterns, then a skip-chain conditional random field.

The base finds e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers by pattern.  The field adds spans that the patterns miss.  Its nodes
are the blank-separated tokens with a digit or an ``@``; neighbouring nodes
share a chain potential, and nodes whose normal form (digits alone, or the
lower-cased address) is the same or the end of one another share a skip
potential however far apart, each with the next such node, so a token repeated
n times adds n - 1 edges.  Nodes inside base spans are fixed to their label.  A
node that, alone or with neighbouring groups of digits, has a base span's normal
form or an end of it (7 digits or more) has that span's evidence directly, with
weight ``ANCHOR``, so it does not fade along the repetitions.  Loopy sum-product
message passing, until the messages settle (the rounds end at twice the nodes,
200 at least), gives the others' marginals; a label with probability
``least`` or more makes a span.

Weights are learned by pseudo-likelihood on the base labels of at most about
``max_rows`` texts chosen by a hash; the executors count equal cases (shape,
neighbours, label), and those counts (bounded by that sample) come to the driver.

Defined cases: null and empty texts have no spans; offsets are code points, the
end exclusive; overlapping base spans of different kinds all stay, added spans
never overlap a base span; repeated rows are each searched; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_batches

KINDS = ("email", "ip", "card", "phone")
_LABELS = len(KINDS) + 1  # 0 is none
#: Weight of a base span of the same normal form. It is set, not learned: the base labels call every repetition that the patterns miss none.
ANCHOR = 8.0
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Tried at a token's first character alone, so a long run without a blank is read once.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NODE = re.compile(r"[0-9@]")
_HEAD = re.compile(r"[^\w+(]*+")
_TAIL = re.compile(r"[^\w)]*+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, sorted."""
    out = []
    if "@" in text:
        last, at = 0, text.find("@")
        while at >= 0:
            a = at
            while a > last and text[a - 1] in _LOCAL_CHARS:
                a -= 1
            m = _DOMAIN.match(text, at) if a < at else None
            if m:
                out.append((a, 0, m.end()))
                last = m.end()
            at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _core(token: str) -> tuple[int, str]:
    """A token without the signs around it, and where that begins."""
    a = _HEAD.match(token).end()
    return a, token[a : len(token) - _TAIL.match(token[:a - 1 if a else None:-1]).end()]


def _shape(token: str) -> str:
    """A token's outline: runs of letters, digits (with their number) and signs; a long one by its hash."""
    out = []
    for run in re.findall(r"[0-9]+|[^\W0-9_]+|[\W_]", token):
        out.append(f"9{min(len(run), 20)}" if run[0].isdigit() else "a" if run[0].isalpha() else run[0])
    shape = "".join(out)
    return shape if len(shape) <= 64 else hashlib.md5(shape.encode()).hexdigest()


class Graph:
    """Nodes of a text and their edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.span, self.shape, self.label = [], [], []
        keys, ordinal = [], []
        ahead = 0
        for m in _TOKEN.finditer(text):
            a, core = _core(m.group())
            if not core:
                continue
            a += m.start()
            b = a + len(core)
            label = 0
            while ahead < len(base) and base[ahead][2] <= a:
                ahead += 1
            for at in range(ahead, len(base)):
                s, k, e = base[at]
                if s >= b:
                    break
                if e > a:
                    label = k + 1
                    break
            self.span.append((a, b))
            self.shape.append(_shape(core))
            self.label.append(label)
            keys.append(core.lower() if "@" in core else _NOT_DIGIT.sub("", core))
        n = len(self.span)
        self.chain = [(i, i + 1) for i in range(n - 1) if text[self.span[i][1] : self.span[i + 1][0]].strip(" ().,;:-+") == "" and self.span[i + 1][0] - self.span[i][1] <= 3]
        self.skip = []
        seen: dict[str, int] = {}
        for i, key in enumerate(keys):
            if len(key) >= 7:
                for form in {key, key[-7:]}:
                    if form in seen:
                        self.skip.append((seen[form], i))
                    seen[form] = i
        self.skip = sorted(set(self.skip))
        self.anchor = self._anchors(text, keys, base)

    def _anchors(self, text: str, keys: list[str], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """``(node, label)`` of free nodes that, alone or with the neighbouring digit groups after or before
        them, have a base span's normal form or an end of it."""
        free = [i for i, label in enumerate(self.label) if not label]
        if not free or not base:
            return []
        ends: dict[str, int] = {}
        for a, kind, b in base:
            form = text[a:b].lower() if kind == 0 else _NOT_DIGIT.sub("", text[a:b])
            for n in (len(form),) if kind == 0 else range(7, len(form) + 1):
                ends.setdefault(form[-n:], kind + 1)
        digits = [not any(c.isalpha() or c == "@" for c in text[a:b]) for a, b in self.span]
        joined = set(self.chain)
        out: dict[int, int] = {}
        for i in free:
            form, j = keys[i], i
            while True:
                if len(form) >= 7 and (label := ends.get(form)):
                    for x in range(i, j + 1):
                        out.setdefault(x, label)
                if not digits[j] or len(form) >= 19 or j + 1 == len(keys) or (j, j + 1) not in joined or self.label[j + 1] or not digits[j + 1]:
                    break
                j += 1
                form += keys[j]
        return sorted(out.items())


@dataclass
class Model:
    shapes: dict[str, int]
    node: np.ndarray  # (shapes + 1, labels); the last row is for unseen shapes
    chain: np.ndarray  # (labels, labels)
    skip: np.ndarray


def _cases(batches):
    counts: dict[tuple, int] = defaultdict(int)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text or not _NODE.search(text):
                continue
            g = Graph(text, base_spans(text))
            near, far = [[0] * _LABELS for _ in g.span], [[0] * _LABELS for _ in g.span]
            for edges, to in ((g.chain, near), (g.skip, far)):
                for a, b in edges:
                    to[a][g.label[b]] += 1
                    to[b][g.label[a]] += 1
            for i, shape in enumerate(g.shape):
                counts[shape, ",".join(map(str, near[i])), ",".join(map(str, far[i])), g.label[i]] += 1
    rows = list(counts.items())
    yield pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))] + [pa.array([v for _, v in rows], pa.int64())], ["shape", "near", "far", "label", "n"])


def train(docs: DataFrame, text_col: str = "text", max_rows: int = 20_000, steps: int = 150, rate: float = 0.5, l2: float = 0.1) -> Model:
    """Pseudo-likelihood fit; without any node the field adds nothing."""
    rows = docs.select(F.col(text_col).alias("text")).where("text is not null")
    n = docs.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    t = rows.mapInArrow(on_batches(_cases), "shape string, near string, far string, label int, n long").groupBy("shape", "near", "far", "label").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    t.sort(key=lambda r: (r["shape"], r["near"], r["far"], r["label"]))
    shapes = {s: i for i, s in enumerate(sorted({r["shape"] for r in t}))}
    node, chain, skip = np.zeros((len(shapes) + 1, _LABELS)), np.zeros((_LABELS, _LABELS)), np.zeros((_LABELS, _LABELS))
    if not t:
        node[:, 0] = 8.0
        return Model(shapes, node, chain, skip)
    at = np.array([shapes[r["shape"]] for r in t])
    near, far = (np.array([[int(x) for x in r[c].split(",")] for r in t], float) for c in ("near", "far"))
    y, c = np.array([r["label"] for r in t]), np.array([r["n"] for r in t], float)
    goal = np.eye(_LABELS)[y]
    total = [np.zeros_like(x) + 1e-8 for x in (node, chain, skip)]
    weight = np.bincount(at, weights=c, minlength=len(node))[:, None]
    for _ in range(steps):
        z = node[at] + near @ chain + far @ skip
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - goal) * c[:, None]
        gn = np.zeros_like(node)
        np.add.at(gn, at, g)
        for x, grad, sq in zip((node, chain, skip), (gn + l2 * node * (weight > 0), near.T @ g + l2 * chain, far.T @ g + l2 * skip), total, strict=True):
            sq += grad * grad
            x -= rate * grad / np.sqrt(sq)
    chain, skip = (chain + chain.T) / 2, (skip + skip.T) / 2
    node[-1] = 0
    node[-1, 0] = 4.0  # an outline never seen is none unless its neighbours say otherwise
    return Model(shapes, node, chain, skip)


def marginals(g: Graph, model: Model, rounds: int | None = None) -> np.ndarray:
    """Sum-product with fixed nodes until messages settle.

    Evidence goes one edge a round, so there are as many rounds as it takes to cross all nodes twice, and 200 at least;
    after 12 rounds messages move by half, so that loops do not swing.  Messages not settled then are taken as they are.
    """
    rounds = max(200, 2 * len(g.span)) if rounds is None else rounds
    own = np.exp(model.node[[model.shapes.get(s, len(model.shapes)) for s in g.shape]])
    for i, label in enumerate(g.label):
        if label:
            own[i] = np.eye(_LABELS)[label]
    pairs = np.array([*g.chain, *g.skip], dtype=np.int64).reshape(-1, 2)
    # Each edge carries a message either way; the way back is the neighbouring row.
    source, target = pairs.ravel(), pairs[:, ::-1].ravel()
    back = np.arange(len(source)) ^ 1
    chained = np.arange(len(source)) < 2 * len(g.chain)
    chain, skip = np.exp(model.chain), np.exp(model.skip)
    with np.errstate(divide="ignore"):
        own = np.log(own)
    for i, label in g.anchor:
        own[i, label] += ANCHOR
    message = np.full((len(source), _LABELS), 1 / _LABELS)
    for r in range(rounds):
        log = np.log(message)
        total = own.copy()
        np.add.at(total, target, log)
        out = total[source] - log[back]
        out = np.exp(out - out.max(1, keepdims=True, initial=-np.inf))
        fresh = np.where(chained[:, None], out @ chain, out @ skip)
        fresh /= fresh.sum(1, keepdims=True)
        moved = np.abs(fresh - message).max(initial=0)
        message = fresh if r < 12 else (fresh + message) / 2
        if moved < 1e-4:
            break
    np.add.at(own, target, np.log(message))
    out = np.exp(own - own.max(1, keepdims=True, initial=-np.inf))
    return out / out.sum(1, keepdims=True)


def find(text: str, model: Model, least: float = 0.8) -> tuple[list, list]:
    """Base spans and added spans, ``(start, kind, end)`` each."""
    if not text or not _NODE.search(text):
        return [], []
    base = base_spans(text)
    g = Graph(text, base)
    if all(g.label):
        return base, []
    p = marginals(g, model)
    added = []
    for (a, b), label, row in zip(g.span, g.label, p, strict=True):
        k = int(row.argmax())
        if not label and k and row[k] >= least:
            if added and added[-1][1] == k - 1 and text[added[-1][2] : a].strip(" ()-.") == "":
                added[-1] = (added[-1][0], k - 1, b)
            else:
                added.append((a, k - 1, b))
    return base, [s for s, clash in zip(added, _clashes(added, base), strict=True) if not clash]


def _clashes(added: list, base: list) -> list[bool]:
    """Which added spans overlap a base span; both lists are in order of their starts."""
    out, ahead, far = [], 0, 0  # far: the furthest end of the base spans that begin before
    for a, _, b in added:
        while ahead < len(base) and base[ahead][0] < b:
            far = max(far, base[ahead][2])
            ahead += 1
        out.append(far > a)
    return out


def _find(batches, model: Model, least: float):
    names = ["doc_id", "start", "end", "kind", "base"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            base, added = find(text or "", model, least)
            rows = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: s[:3])
            out.append([{"start": a, "end": b, "kind": KINDS[k], "base": f} for a, k, b, f in rows])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names[:1] + ["spans"])


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``(doc_id, spans)``: per document its spans ``(start, end, kind, base)`` in order."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(on_batches(_find, model=model, least=least), "doc_id long, spans array<struct<start: bigint, end: bigint, kind: string, base: boolean>>")


def _redact(batches, model: Model, least: float, at: int):
    for batch in batches:
        out = []
        for text in batch.column(at).to_pylist():
            base, added = find(text or "", model, least)
            if base or added:
                parts, last = [], 0
                for a, k, b in sorted(base + added):
                    if b <= last:
                        continue
                    if a >= last:
                        parts.append(text[last:a] + f"<{KINDS[k].upper()}>")
                    last = b
                text = "".join(parts) + text[last:]
            out.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def redact(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(on_batches(_redact, model=model, least=least, at=at), docs.schema)
