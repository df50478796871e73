"""Best-fit packing of tokenised documents into fixed-length sequences.

A document's tokens are the public tokenizer's ids, then the id 0.  Documents
longer than a sequence are cut into full pieces and a last, shorter one.
Pieces go to sequences by bounded-space online best fit: at most
``open_bins`` sequences are open; they are kept by free space, with a bitset of
the free spaces in use, so the tightest fit is the lowest set bit at or above a
piece's length.  When a piece fits nowhere a new sequence opens, and beyond the
bound the fullest one closes first.  Each input partition packs on its own in
one pass; a run of texts is taken longest first.

Tokens are found per distinct word: plain Latin texts are cut into words by
numpy exactly as the tokenizer's own splitting pattern cuts them, new words are
encoded once per worker, and texts with any other character go to the
tokenizer, a long one in parts cut between words (a run of 100,000 characters
and more without a blank stays whole).

Defined cases: a null or empty text is one piece holding the id 0 alone;
repeated rows are packed each (equal ids are told apart by sequence and offset);
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import on_batches

BLOCK = 1_000_000
#: Slots of a worker's table of known words, and ids it holds before it starts anew (results do not depend on either).
SLOTS, POOL = 1 << 20, 1 << 23
#: Anything but plain Latin letters, ASCII signs and blanks, or a special token's beginning.
_OTHER = "[^\\t\\n\\r -~À-ÖØ-öø-įı-ſ]|<\\|"
#: Characters of a part, about, of a text that goes to the tokenizer; where it may be cut.
PART = 100_000
_BLANK = re.compile(r"(?<=[!-~])[ \n](?=[!-~])")
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[wh.SPACE] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2
#: One-letter and two-letter endings that the tokenizer keeps with their apostrophe.
_SHORT, _LONG = b"stmd", (b"re", b"ve", b"ll")


class Words:
    """Ids of words by hash, in a table where each word has one slot; a displaced word is encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.key, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.held = np.zeros(POOL // 16, np.uint32), 0

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words back to back, and where each word's end."""
        chunks = [" ".join(words[i : i + 4000]) for i in range(0, len(words), 4000)]
        # One at a time: a batch's encodings would be held together, and by threads of their own.
        ids = np.concatenate([np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype=np.uint32) for c in chunks])
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != len(words):
            each = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=np.uint32) for w in words]
            ids, end = np.concatenate(each), np.cumsum([len(x) for x in each])
        return ids, end

    def parts(self, text: str) -> np.ndarray:
        """Ids of a text of any characters; a long one is cut at blanks between two plain signs, where no rule of the
        tokenizer (composition, its white space, its words, special tokens) looks across."""
        out, at = [np.zeros(0, np.uint32)], 0
        while at < len(text):
            m = _BLANK.search(text, at + PART) if len(text) - at > PART else None
            end = m.end() if m else len(text)
            out.append(np.array(self.tokenizer.encode(text[at:end], add_special_tokens=False).ids, dtype=np.uint32))
            at = end
        return np.concatenate(out)

    def find(self, h: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of every word; ``spell`` gives the words at positions."""
        if self.held > POOL:
            self.clear()
        slot = (h >> np.uint64(44)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            key, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            ids, end = self.encode(spell(miss[first]))
            many = np.diff(np.r_[0, end]).astype(np.int32)
            place = (end - many + self.held).astype(np.int32)
            if self.held + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)))
            self.pool[self.held : self.held + len(ids)] = ids
            self.held += len(ids)
            at[miss], size[miss] = place[back], many[back]
            s = slot[miss[first]]
            self.key[s], self.at[s], self.size[s] = key, place, many
            # Of words that meet in a slot the last written must be whole.
            lost = self.key[s] != key
            if lost.any():
                keep = np.flatnonzero(~lost)
                self.at[s[keep]], self.size[s[keep]] = place[keep], many[keep]
        return at, size


def _cut(data: np.ndarray, at: np.ndarray) -> wh.Words:
    """Words of lower-cased plain texts, cut as the tokenizer's pattern does."""
    kind = _KIND[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    edge[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quote = np.flatnonzero((data == 39) & edge[:n])
    if len(quote):
        room = at[np.searchsorted(at, quote, side="right")] - quote  # bytes left in the text
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(_SHORT, np.uint8)) & (room > 1)
        long_ = (room > 2) & np.logical_or.reduce([(one == x[0]) & (two == x[1]) for x in _LONG])
        edge[quote[short | long_] + 1] = False
        edge[quote[short] + 2] = True
        edge[quote[long_] + 3] = True
    solid = kind > 0
    start = np.flatnonzero(edge[:n] & solid)
    # A word ends where the next edge is.
    edges = np.flatnonzero(edge)
    end = edges[np.searchsorted(edges, start, side="right")] if len(start) else start
    return wh.Words(data, at, start, end, np.searchsorted(start, at))


def encode(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back (each closed by 0) and offsets of texts."""
    texts = texts.fill_null("")
    other = np.asarray(pc.match_substring_regex(texts, _OTHER))
    plain = pc.if_else(pa.array(other), "", texts) if other.any() else texts
    data, at = wh.flat(pc.utf8_lower(plain))
    w = _cut(data, at)
    h = w.hashes()

    def spell(at: np.ndarray) -> list[str]:
        raw = data.tobytes()
        return [raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]

    begin, size = words.find(h, spell) if len(h) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    size = size.astype(np.int64)
    per_text = np.add.reduceat(np.r_[size, 0], np.minimum(w.first[:-1], len(size))) * (np.diff(w.first) > 0)
    whole = {int(i): words.parts(texts[int(i)].as_py()) for i in np.flatnonzero(other)}
    for i, ids in whole.items():
        per_text[i] = len(ids)
    offsets = np.concatenate(([0], np.cumsum(per_text + 1)))
    out = np.zeros(int(offsets[-1]), dtype=np.uint32)
    total = int(size.sum())
    shift = np.cumsum(size) - size
    spot = np.arange(total) - np.repeat(shift, size)
    got = words.pool[np.repeat(begin, size) + spot]
    owner = np.repeat(np.arange(len(per_text)), np.diff(w.first))
    own = np.where(other, 0, per_text)
    text_shift = np.cumsum(own) - own
    out[np.arange(total) + np.repeat((offsets[:-1] - text_shift)[owner], size)] = got
    for i, ids in whole.items():
        out[offsets[i] : offsets[i] + len(ids)] = ids
    return out, offsets


class Packer:
    """Bounded-space online best fit."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for a piece."""
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            stack = self.bins[free]
            seq = stack.pop()
            if not stack:
                self.bits ^= 1 << free
        else:
            if self.open >= self.most:
                full = (self.bits & -self.bits).bit_length() - 1
                self.bins[full].pop()
                if not self.bins[full]:
                    self.bits ^= 1 << full
                self.open -= 1
            seq, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        offset, left = self.capacity - free, free - size
        if left:
            self.bins[left].append(seq)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return seq, offset


def _pack(batches, path: str, capacity: int, open_bins: int, ids: bool):
    words, packer = Words(path), Packer(capacity, open_bins)
    part = TaskContext.get().partitionId() << 40
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids]
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j in wh.slices(batch.column(1), BLOCK):
                doc = batch.column(0).slice(i, j - i)
                tokens, at = encode(batch.column(1).slice(i, j - i), words)
                size = np.diff(at)
                pieces = -(-size // capacity)
                owner = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[owner] - start, capacity)
                seq, offset = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
                for x in np.argsort(-length, kind="stable").tolist():
                    seq[x], offset[x] = packer.place(int(length[x]))
                view = memoryview(tokens.astype("<u4").tobytes())
                begin = at[owner] + start
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                out = [doc.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(seq + part), pa.array(offset)]
                if ids:
                    out.append(pa.array([tokens[a:b].tolist() for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, open_bins: int = 2048, ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * ids
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(on_batches(_pack, path=tokenizer, capacity=capacity, open_bins=open_bins, ids=ids), schema)
