"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

A word here is a run of bytes of one class: letters (ASCII, lower-cased, or
non-ASCII), digits (all alike), or other signs.  Features are hashed words and
word pairs; a feature's value is 1 + log(count), scaled to unit length per
text.  Scores are sparse dot products through a sigmoid.

Training uses at most about ``max_rows`` labelled rows of at most about
``max_bytes`` of text in all, chosen by a hash of the
id; their features (at most 12 bytes a word or word pair) are brought to the
driver and visited in the order of that hash, ``epochs`` times.

Defined cases: null and empty texts have no features and get the score of the
intercept alone.  Rows with a null label are not learned from; without labels
every score is 0.5.  Repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh

BLOCK = 2_000_000
BITS = 18
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[wh.SPACE] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2
_FOLD = wh.LOWER.copy()
_FOLD[48:58] = 48


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of each text's features, and offsets of texts."""
    raw, at = wh.flat(column)
    data = _FOLD[raw]
    kind = _CLASS[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    solid = kind > 0
    start = np.flatnonzero(edge[:n] & solid)
    end = np.flatnonzero(edge[1:] & solid) + 1
    w = wh.Words(data, at, start, end, np.searchsorted(start, at))
    h, first, m = w.hashes(), w.first, len(w.first) - 1
    owner = np.repeat(np.arange(m), np.diff(first))
    pair = np.zeros(max(len(h) - 1, 0), dtype=np.uint64)
    both = owner[1:] == owner[:-1]
    if len(h) > 1:
        pair = wh.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[both]
    mask = np.uint64((1 << BITS) - 1)
    key = np.concatenate((owner << BITS | (h & mask).astype(np.int64), owner[1:][both] << BITS | (pair & mask).astype(np.int64)))
    key.sort()
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    count = np.diff(np.r_[head, len(key)])
    key = key[head]
    doc, bucket = key >> BITS, key & ((1 << BITS) - 1)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=m))
    return bucket.astype(np.int32), (value / norm[doc]).astype(np.float32), np.searchsorted(doc, np.arange(m + 1))


def _featurize(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j in wh.slices(batch.column(2), BLOCK):
                bucket, value, at = features(batch.column(2).slice(i, j - i))
                cut = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([bucket[c].tobytes() for c in cut], pa.binary()), pa.array([value[c].tobytes() for c in cut], pa.binary())], ["turn", "label", "bucket", "value"])


def ftrl(rows, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4) -> Model:
    """FTRL-proximal on ``(label, buckets, values)`` rows; the last coordinate is the intercept (not shrunk)."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)

    def solve(at):
        zi = z[at]
        out = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, out)

    for _ in range(epochs):
        for label, at, x in rows:
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            wi = solve(at)
            wi[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * wi
            n[at] += g * g
    w = solve(np.arange(size))
    return Model(w[:-1].astype(np.float32), float(-z[-1] / ((beta + np.sqrt(n[-1])) / alpha)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4_000, max_bytes: int = 32_000_000, epochs: int = 4) -> Model:
    """Learn from texts that have a label (0 or 1); ids with unlike labels count once per label."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, size = text.select("id", F.octet_length("text").cast("long").alias("size")).join(known, "id").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(max_rows / max(n, 1), max_bytes / max(size, 1))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) < int((1 << 20) * share))
    picked = text.join(known, "id").select(F.xxhash64("id").alias("turn"), "label", "text")
    got = picked.mapInArrow(_featurize, "turn long, label int, bucket binary, value binary").toArrow().sort_by([("turn", "ascending"), ("label", "ascending")])
    rows = [(y, np.frombuffer(a, np.int32), np.frombuffer(b, np.float32).astype(float)) for y, a, b in zip(got.column("label").to_pylist(), got.column("bucket").to_pylist(), got.column("value").to_pylist(), strict=True)]
    return ftrl(rows, epochs=epochs)


def _score(batches, model: Model):
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j in wh.slices(batch.column(1), BLOCK):
                bucket, value, at = features(batch.column(1).slice(i, j - i))
                doc = np.repeat(np.arange(j - i), np.diff(at))
                dot = np.bincount(doc, weights=model.weights[bucket] * value, minlength=j - i) + model.intercept
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], ["doc_id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``; the model goes along with the tasks (1 MB, whatever the data)."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(partial(_score, model=model), "doc_id long, score double")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0
