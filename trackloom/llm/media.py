"""Media columns: AVI motion-JPEG written, read back and cut into shots.

A payload becomes 8-bit grey samples, 24 x 24 to a frame.  Each sample is the
constant colour of one 8 x 8 block of a baseline JPEG: with quantiser 8 a
block's DC term is its colour less 128, exactly, so any decoder gives the bytes
back.  Frames stand in an AVI file's ``movi`` list and in its ``idx1`` index.

Reading parses the RIFF chunks and the index, undoes byte stuffing and decodes
the Huffman codes of many frames in step (DC and AC terms, any tables), so the
cost per symbol is a few numpy operations over all frames of a batch.  Shots end where the
difference of neighbouring frames' histograms stands out from the shot so far.

Defined cases: a null text is empty; the payload is at least one frame; long
texts are many frames of one file.  Of bytes that are no AVI, or frames that
are not baseline JPEG, ``clips`` gives a row with the reason.  Colour frames are
decoded by their first component (the luma), which is what histograms need.
Repeated rows give equal rows; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh

BLOCK = 1_500_000
SIDE = 24
CELL = SIDE * SIDE
FPS = 25
_DC_BITS = 4  # length of each of the nine DC codes
#: Fixed by the JPEG standard: the zig-zag order is the walk along anti-diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(cells: int = SIDE) -> bytes:
    dc = bytes([0]) + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
    ac = bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0])
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, cells * 8, cells * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, dc) + _segment(0xC4, ac)
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


HEAD, TAIL = _head(), b"\xff\xd9"


def _stuff(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A zero after every byte 255 of rows back to back."""
    full = np.flatnonzero(data == 255)
    at = np.cumsum(size)
    extra = np.bincount(np.searchsorted(at, full, side="right"), minlength=len(size))
    return np.insert(data, full + 1, 0), size + extra


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Per difference from -255 on: code, extra bits and the one-bit end of block, and their length."""
    diff = np.arange(-255, 256)
    size = np.array([int(d).bit_length() for d in np.abs(diff)])
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return ((size << size) | extra) << 1, _DC_BITS + size + 1


_VALUE, _LENGTH = _codes()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of ``(frames, 576)`` samples."""
    n = len(samples)
    dc = samples.astype(np.int16) - 128
    diff = np.diff(dc, axis=1, prepend=np.zeros((n, 1), np.int16)) + 255
    value, length = _VALUE[diff], _LENGTH[diff]
    to = np.cumsum(length, axis=1)
    width = (to[:, -1] + 7) // 8
    base = np.cumsum(width) - width
    bit = to - length + base[:, None] * 8
    word = value << (24 - length - (bit & 7))
    at = bit >> 3
    total = int(width.sum())
    out = np.zeros(total + 3)
    for k in range(3):
        out += np.bincount((at + k).ravel(), weights=((word >> (16 - 8 * k)) & 255).ravel(), minlength=total + 3)[: total + 3]
    data = out[:total].astype(np.uint8)
    # Unused bits of the last byte are ones.
    data[base + width - 1] |= ((1 << (width * 8 - to[:, -1])) - 1).astype(np.uint8)
    data, width = _stuff(data, width)
    raw, end = data.tobytes(), np.cumsum(width).tolist()
    return [HEAD + raw[a:b] + TAIL for a, b in zip([0, *end[:-1]], end, strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], side: int = SIDE * 8, fps: int = FPS) -> bytes:
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, most, 10_000, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """Frames by the file's index, and frames a second."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, index, micros, at = None, None, 1_000_000 // FPS, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl" and data[at + 12 : at + 16] == b"avih":
            micros = struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"idx1":
            index = (at + 8, size // 16)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    entries = np.frombuffer(data, dtype="<u4", count=index[1] * 4, offset=index[0]).reshape(-1, 4)
    out = []
    for _, _, off, size in entries[entries[:, 0] == int.from_bytes(b"00dc", "little")].tolist():
        at = movi + off + 8
        out.append(data[at : at + size])
    return out, 1e6 / micros


@dataclass
class Layout:
    """What a frame's head says."""

    quant: np.ndarray  # of the first component
    length: np.ndarray  # bits of each 16-bit prefix's code, table after table
    symbol: np.ndarray
    dc: np.ndarray  # of each block of a unit: where its DC table begins in the two above
    ac: np.ndarray
    part: np.ndarray  # and its component
    rows: int  # blocks of the first component, whole units
    cols: int
    units: int
    place: np.ndarray  # of the first component's blocks in the order of the scan: their place row by row
    begin: int  # where the scan's data begins


def _tables(frame: bytes) -> Layout:
    quant, codes, parts, at = {}, {}, None, 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("only quantisers of 8 bits are decoded")
                quant[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.int32), body[65:]
        elif marker == 0xC4:
            while body:
                length, symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
                code, k = 0, 17
                for bits in range(1, 17):
                    for _ in range(body[bits]):
                        lo = code << (16 - bits)
                        length[lo : lo + (1 << (16 - bits))], symbol[lo : lo + (1 << (16 - bits))] = bits, body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                codes[body[0]], body = (length, symbol), body[k:]
        elif marker == 0xC0:
            depth, h, w, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3):
                raise ValueError("only frames of 8 bits, grey or of three components, are decoded")
            # Identity, blocks across and down a unit, quantiser.
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD and int.from_bytes(body[:2], "big"):
            raise ValueError("frames with restart markers are not decoded")
        elif marker == 0xDA:
            if parts is None or body[0] != len(parts):
                raise ValueError("only frames of one scan are decoded")
            if len(parts) == 1:
                parts = [(parts[0][0], 1, 1, parts[0][3])]
            names = sorted(codes)
            if not all((body[2 + 2 * i] >> 4) in codes and (0x10 | body[2 + 2 * i] & 15) in codes for i in range(len(parts))):
                raise ValueError("a frame without its code tables")
            dc, ac, part = [], [], []
            for i, (_, x, y, _) in enumerate(parts):
                dc += [names.index(body[2 + 2 * i] >> 4) * 65536] * (x * y)
                ac += [names.index(0x10 | body[2 + 2 * i] & 15) * 65536] * (x * y)
                part += [i] * (x * y)
            x, y = parts[0][1], parts[0][2]
            wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
            across, down = -(-w // (8 * wide)), -(-h // (8 * high))
            unit = np.arange(across * down)[:, None]
            block = np.arange(x * y)[None, :]
            place = ((unit // across * y + block // x) * across * x + unit % across * x + block % x).ravel()
            return Layout(quant[parts[0][3]], np.concatenate([codes[c][0] for c in names]), np.concatenate([codes[c][1] for c in names]), np.array(dc), np.array(ac), np.array(part), down * y, across * x, across * down, place, at)
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only baseline frames are decoded")
    raise ValueError("a JPEG frame without a scan")


def _head_of(frame: bytes) -> bytes:
    """A frame's bytes up to the scan's data."""
    at = 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        at += 2 + size
        if marker == 0xDA:
            return frame[:at]
    raise ValueError("a JPEG frame without a scan")


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, dict]:
    """DC colour of every block of the first component ``(frames, blocks)`` and ``{frame: pixels}`` of those with AC terms.

    All frames must have the first one's tables (their bytes up to the scan).
    """
    if not frames:
        return np.zeros((0, 0), np.uint8), {}
    lay = _tables(frames[0])
    begin, head = lay.begin, frames[0][: lay.begin]
    if any(f[:begin] != head for f in frames):
        raise ValueError("frames of one call share their tables")
    per = len(lay.part)
    blocks, n = lay.units * per, len(frames)
    raw = np.frombuffer(b"".join(f[begin:-2] for f in frames), np.uint8)
    size = np.array([len(f) - begin - 2 for f in frames])
    # Byte stuffing off.
    stuffed = np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0)) + 1
    size = size - np.bincount(np.searchsorted(np.cumsum(size), stuffed, side="right"), minlength=len(size))
    raw = np.delete(raw, stuffed)
    base = (np.cumsum(size) - size) * 8
    padded = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint64)
    window = np.zeros(len(raw) + 3, np.uint64)  # 40 bits from each byte on
    for k in range(5):
        window = (window << np.uint64(8)) | padded[k : k + len(window)]
    window = window.view(np.int64)
    # As long as every block of all frames is a DC term and the end of block, both are read in one step.
    bit, pred, dc = base.astype(np.int64), np.zeros((n, 3), np.int64), np.zeros((blocks, n), dtype=np.int32)
    both, mask = lay.length | lay.symbol << 8, (1 << np.arange(17)) - 1
    at = 0
    while at < blocks:
        i = at % per
        bits = window[bit >> 3] >> (8 - (bit & 7)) & 0xFFFFFFFF
        entry = both[(bits >> 16) + lay.dc[i]]
        more = entry >> 8
        used = (entry & 31) + more
        if more.max() > 11 or (entry & 31).min() == 0:
            break
        most = mask[more]
        extra = bits >> (32 - used) & most
        value = extra - most * (extra <= most >> 1)
        entry = both[((bits << used & 0xFFFFFFFF) >> 16) + lay.ac[i]]
        if not ((entry & 31) - 1 & 0xFFFF < 32 - used).all() or (entry >> 8).any():
            break
        pred[:, lay.part[i]] += value
        dc[at] = pred[:, lay.part[i]]
        bit += used + (entry & 31)
        if at % 64 == 0 and (bit > base + size * 8).any():
            raise ValueError("a frame ends before its blocks")
        at += 1
    dc = np.ascontiguousarray(dc.T)
    block, k = np.full(n, at), np.zeros(n, np.int64)
    ac: list[tuple] = []
    live = np.flatnonzero(block < blocks)
    last = base + size * 8
    while len(live):
        b = bit[live]
        if (b >= last[live]).any():
            raise ValueError("a frame ends before its blocks")
        i = block[live] % per
        bits = window[b >> 3] >> (8 - (b & 7)) & 0xFFFFFFFF  # 32 bits from here on
        is_dc = k[live] == 0
        entry = (bits >> 16) + np.where(is_dc, lay.dc[i], lay.ac[i])
        used, sym = lay.length[entry], lay.symbol[entry]
        if not used.all():
            raise ValueError("a code outside the tables")
        more = sym & 15
        extra = (bits >> (32 - used - more)) & ((1 << more) - 1)
        value = np.where((more > 0) & (extra < (1 << np.maximum(more - 1, 0))), extra - (1 << more) + 1, extra)
        bit[live] = b + used + more
        d, part = live[is_dc], lay.part[i[is_dc]]
        pred[d, part] += value[is_dc]
        dc[d, block[d]] = pred[d, part]
        k[d] = 1
        if not is_dc.all():
            a, s, v, part = live[~is_dc], sym[~is_dc], value[~is_dc], lay.part[i[~is_dc]]
            end, real = s == 0, (s & 15) > 0
            k[a] += s >> 4
            if (k[a[real]] > 63).any():
                raise ValueError("a block of more than 64 terms")
            kept = real & (part == 0)
            if kept.any():
                ac.append((a[kept], block[a[kept]], k[a[kept]], v[kept]))
            k[a] = np.where(end, 64, k[a] + 1)
            done = a[k[a] >= 64]
            block[done] += 1
            k[done] = 0
            live = live[block[live] < blocks]
    # The first component's blocks, row by row.
    own = np.flatnonzero(lay.part[np.arange(blocks) % per] == 0)
    where = np.zeros(blocks, np.int64)
    where[own] = lay.place
    luma = np.empty((n, len(own)), np.int32)
    luma[:, lay.place] = dc[:, own]
    # A block of a DC term alone has the constant colour 128 + DC / 8.
    colour = np.clip(128 + (luma * lay.quant[0] + 4) // 8, 0, 255).astype(np.uint8)
    return colour, _pixels(luma, [(f, where[b], k, v) for f, b, k, v in ac], lay.quant, lay.rows, lay.cols)


def _pixels(dc, ac, quant, rows, cols) -> dict:
    """Inverse transform of the frames that have AC terms."""
    if not ac:
        return {}
    f, b, k, v = (np.concatenate(x) for x in zip(*ac, strict=True))
    i = np.arange(8)
    basis = np.cos((2 * i[:, None] + 1) * i[None, :] * np.pi / 16) * np.where(i == 0, np.sqrt(1 / 8), 0.5)
    out = {}
    for frame in np.unique(f):
        term = np.zeros((rows * cols, 64))
        term[:, 0] = dc[frame] * quant[0]
        m = f == frame
        term[b[m], ZIGZAG[k[m]]] = v[m] * quant[k[m]]
        plane = basis @ term.reshape(-1, 8, 8) @ basis.T + 128
        out[int(frame)] = np.clip(np.rint(plane), 0, 255).astype(np.uint8).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
    return out


def histograms(colour: np.ndarray, pixels: dict, bins: int = 16) -> np.ndarray:
    n = len(colour)
    out = np.bincount((np.arange(n)[:, None] * bins + (colour >> 4)).ravel(), minlength=n * bins).reshape(n, bins) / max(colour.shape[1], 1)
    for f, p in pixels.items():
        out[f] = np.bincount(p.ravel() >> 4, minlength=bins) / p.size
    return out


def shots(hist: np.ndarray, floor: float = 0.12, spread: float = 3.0) -> list[int]:
    """First frames of shots: a histogram difference above the floor and above the mean of the shot's
    differences so far by ``spread`` of their deviations ends a shot."""
    diff = (np.abs(np.diff(hist, axis=0)).sum(1) / 2).tolist()
    cuts, n, mean, m2 = [0], 0, 0.0, 0.0
    for t, d in enumerate(diff, 1):
        if d > floor and d > mean + spread * (m2 / n if n else 0.0) ** 0.5:
            cuts.append(t)
            n, mean, m2 = 0, 0.0, 0.0
        else:
            n += 1
            gap = d - mean
            mean += gap / n
            m2 += gap * (d - mean)
    return cuts


def clips_of(media: bytes) -> list[dict]:
    """Timed clips of one AVI file."""
    frames, fps = read_avi(media)
    if not frames:
        return []
    hist, at = [], 0
    while at < len(frames):
        # Frames that share their tables are decoded together, so many bytes at a time.
        head = _head_of(frames[at])
        to, held = at + 1, len(frames[at])
        while to < len(frames) and held < BLOCK and frames[to].startswith(head) and _head_of(frames[to]) == head:
            held += len(frames[to])
            to += 1
        hist.append(histograms(*decode_frames(frames[at:to])))
        at = to
    cuts = shots(np.concatenate(hist))
    return [{"clip": i, "first_frame": a, "frames": b - a, "start_ms": round(1000 * a / fps), "end_ms": round(1000 * b / fps)} for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(frames)], strict=True))]


def _clips(batches):
    kinds = {"clip": pa.int32(), "first_frame": pa.int64(), "frames": pa.int64(), "start_ms": pa.int64(), "end_ms": pa.int64(), "error": pa.string()}
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                rows = clips_of(data.as_py()) if data.is_valid else []
            except (ValueError, KeyError, IndexError, struct.error) as reason:  # bytes that are no such file
                rows = [{"error": str(reason)}]
            rows = [dict.fromkeys(kinds) | r for r in rows]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), *(pa.array([r[c] for r in rows], t) for c, t in kinds.items())], ["id", *kinds])


def clips(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Timed clip rows of a column of AVI files; a null file has none, and a file that cannot be decoded
    has one row that gives the reason in ``error`` (null else)."""
    rows = media.select(F.col(id_col).cast("long"), F.col(media_col))
    return rows.mapInArrow(_clips, "id long, clip int, first_frame long, frames long, start_ms long, end_ms long, error string")


def payload_frames(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples ``(frames, 576)`` of padded texts, frame offsets of texts, bytes of texts."""
    raw, at = wh.flat(column)
    size = np.diff(at)
    frames = np.maximum(1, -(-size // CELL))
    first = np.concatenate(([0], np.cumsum(frames)))
    out = np.full(int(first[-1]) * CELL, 255, dtype=np.uint8)
    out[np.arange(len(raw)) + np.repeat(first[:-1] * CELL - at[:-1], size)] = raw
    return out.reshape(-1, CELL), first, size


def _round_trip(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    step = BLOCK // CELL
    for batch in batches:
        for i, j in wh.slices(batch.column(1), BLOCK):
            samples, first, size = payload_frames(batch.column(1).slice(i, j - i))
            # A long text's frames are coded, and decoded, so many at a time.
            jpegs = [x for a in range(0, len(samples), step) for x in encode_frames(samples[a : a + step])]
            del samples
            files = [write_avi(jpegs[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            del jpegs
            stored = [x for f in files for x in read_avi(f)[0]]
            colour, hist = np.empty((len(stored), CELL), np.uint8), np.empty((len(stored), 16))
            for a in range(0, len(stored), step):
                some, pixels = decode_frames(stored[a : a + step])
                colour[a : a + step], hist[a : a + step] = some, histograms(some, pixels)
            del stored
            rows = {n: [] for n in names[1:]}
            for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                payload = colour[a:b].tobytes()
                cuts = shots(hist[a:b])
                values = (int(size[d]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(files[d]), hashlib.sha256(files[d]).hexdigest(), f"frames={b - a};shots={len(cuts)};cuts={','.join(map(str, cuts))}")
                for n, v in zip(names[1:], values, strict=True):
                    rows[n].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for v in rows.values())], names)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an AVI file, read it back, and describe payload, file and shots."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(_round_trip, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
