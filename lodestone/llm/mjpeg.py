"""AVI files with motion-JPEG video: written, parsed, decoded, cut into shots.

Reading. A RIFF walk finds the headers and the frame index (idx1; where it is missing or broken, the movi list itself). Frames
are baseline JPEG images; a frame's restart intervals are independent, and the intervals of all frames of a batch
that have the same headers are decoded in step: each step reads one Huffman symbol of every interval. Shots are
found on the luma block means of the frames: where the difference of neighbouring histograms exceeds both a floor and what
the shot so far lets expect (mean and spread of its differences), a new shot begins.

Writing. Bytes are stored losslessly as flat tiles: each byte is an 8 x 8 block whose one coefficient, the mean, is quantised
to exactly that grey value. A frame has 16 rows of 64 tiles, each row a restart interval; any player shows it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.types as S
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textarrays as T

TILES, ROWS, FPS = 64, 16, 25
FRAME = TILES * ROWS
CHUNK_BYTES = 256 << 10
#: Frames that are encoded or decoded at once.
GROUP = 1024
#: A cut: a histogram difference over FLOOR and over mean + SPREAD deviations of the shot's last MEMORY differences.
FLOOR, SPREAD, MEMORY, LEVELS = 0.2, 3.0, 12, 16

#: Where the coefficients of a block in scan order stand in the 8 x 8 block, row by row.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, by_length: dict[int, list[int]]) -> bytes:
    return bytes([kind, *(len(by_length.get(n, ())) for n in range(1, 17))]) + bytes(s for n in range(1, 17) for s in by_length.get(n, ()))


#: Tiles: mean quantised by 8, so that a step is one grey level. Nine 4-bit codes for the means' size classes, one 1-bit code
#: for the end of the block.
FRAME_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, *[8] * 64])) + _segment(0xC0, struct.pack(">BHHB3B", 8, ROWS * 8, TILES * 8, 1, 1, 0x11, 0)) + _segment(0xC4, _table(0x00, {4: [*range(9)]})) + _segment(0xC4, _table(0x10, {1: [0]})) + _segment(0xDD, struct.pack(">H", TILES)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _tile_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and its length for each difference of means, -255 to 255."""
    d = np.arange(-255, 256)
    size = np.array([int(abs(x)).bit_length() for x in d])
    extra = np.where(d >= 0, d, d + (1 << size) - 1)
    return ((size << size | extra) << 1).astype(np.int32), (size + 5).astype(np.int32)


_CODE, _LENGTH = _tile_codes()


def encode_tiles(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG scans for rows of tiles (n, TILES), n a multiple of ROWS: their bytes, and where each frame's begin."""
    n = len(rows)
    level = rows.astype(np.int32) - 128
    level[:, 1:] -= level[:, :-1].copy()
    level += 255
    length = _LENGTH[level]
    bits = length.sum(axis=1)
    row_bytes = (bits + 7) // 8
    row_begin = np.cumsum(row_bytes) - row_bytes
    begin = (row_begin * 8)[:, None] + np.cumsum(length, axis=1) - length
    # A code has 13 bits at most, so with its place in a byte it touches three bytes; codes share bytes but no bits.
    at, code = begin.ravel(), _CODE[level].ravel()
    code = code << (24 - length.ravel() - (at & 7))
    at >>= 3
    size = int(row_bytes.sum())
    total = np.zeros(size + 3)
    for k in range(3):
        total[k : k + size + 1] += np.bincount(at, weights=(code >> (16 - 8 * k)) & 255, minlength=size + 1)[: size + 1]
    packed = total[:size].astype(np.uint8)
    packed[np.cumsum(row_bytes) - 1] |= ((1 << (row_bytes * 8 - bits)) - 1).astype(np.uint8)  # rows end in ones
    full = packed == 255  # a zero byte follows these
    shift = np.cumsum(full) - full
    row = np.repeat(np.arange(n), row_bytes)
    place = np.arange(len(packed)) + shift + 2 * row
    stuffed = np.zeros(len(packed) + int(full.sum()) + 2 * n, np.uint8)
    stuffed[place] = packed
    last = np.cumsum(row_bytes) - 1
    mark = place[last] + 1 + full[last]
    stuffed[mark] = 255
    in_frame = np.arange(n) % ROWS
    stuffed[mark + 1] = np.where(in_frame == ROWS - 1, 0xD9, 0xD0 + in_frame % 8)
    return stuffed, np.concatenate(([0], mark[ROWS - 1 :: ROWS] + 2))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, note: str = "", fps: int = FPS) -> bytes:
    largest = max(map(len, frames), default=0)
    main = struct.pack("<10I16x", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 10000, 0, 0, 0, width, height)
    image = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", note.encode() + b"\0"))
    body, index, at = [], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


class Video(NamedTuple):
    frame_us: int
    width: int
    height: int
    frames: list[tuple[int, int]]
    """Place and size of each frame."""
    note: str


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, place of the body, size) of the chunks between at and end; a chunk that is cut short ends there."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> Video:
    """Raises ValueError where data is no AVI file with one motion-JPEG video stream."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frame_us = width = height = 0
    kind, note, movi, index = b"", "", None, None
    stack = [(12, len(data))]
    while stack:
        for name, at, size in _walk(data, *stack.pop()):
            if name == b"LIST":
                if data[at : at + 4] == b"movi":
                    movi = movi or (at, size)
                else:
                    stack.append((at + 4, at + size))
            elif name == b"avih" and size >= 40:
                frame_us, width, height = *struct.unpack_from("<I", data, at), *struct.unpack_from("<II", data, at + 32)
            elif name == b"strf" and size >= 20:
                kind = kind or data[at + 16 : at + 20]
            elif name == b"ICMT":
                note = data[at : at + size].split(b"\0")[0].decode("utf-8", "replace")
            elif name == b"idx1":
                index = (at, size)
    if movi is None or kind.upper() != b"MJPG":
        raise ValueError("no motion-JPEG stream")
    at, size = movi
    frames = []
    if index:
        for name, _, off, n in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]):
            if name[2:] in (b"dc", b"db"):
                for base in (at, 0):  # offsets count from the list's name, or from the file's beginning
                    if data[base + off : base + off + 4] == name and base + off + 8 + n <= len(data):
                        frames.append((base + off + 8, n))
                        break
                else:
                    frames = []
                    break
    if not frames:
        frames = [(a, n) for name, a, n in _walk(data, at + 4, at + size) if name[2:] in (b"dc", b"db")]
    return Video(frame_us or 1_000_000 // FPS, width, height, [f for f in frames if f[1]], note)


class Head(NamedTuple):
    height: int
    width: int
    parts: tuple[tuple[int, int, int, int, int], ...]
    """Components of the scan: width and height in blocks per unit, tables for quantising, means and other coefficients."""
    interval: int
    quant: dict[int, np.ndarray]
    lookup: np.ndarray
    """(8, 65536): length << 8 | symbol by the next 16 bits; rows 0 to 3 are tables for means, 4 to 7 the others."""
    scan: int
    """Where the scan begins."""


def read_head(frame: bytes) -> Head:
    """Markers up to the scan. Raises ValueError where the frame is no baseline JPEG image with its own tables."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, interval, size, comps = 2, 0, None, {}
    quant: dict[int, np.ndarray] = {}
    lookup = np.zeros((8, 65536), np.uint16)
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            bits, height, width, count = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("unusual size")
            size = (height, width)
            comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while body:
                row, symbols, code = (body[0] >> 4) * 4 + (body[0] & 3), 17, 0
                for length in range(1, 17):
                    for _ in range(body[length]):
                        lookup[row, code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | body[symbols]
                        code, symbols = code + 1, symbols + 1
                    code <<= 1
                body = body[symbols:]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if size is None:
                raise ValueError("the scan comes before the frame")
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            if len(chosen) != len(comps):
                raise ValueError("several scans")
            parts = tuple((*(comps[c][:2] if len(chosen) > 1 else (1, 1)), comps[c][2], t >> 4, t & 15) for c, t in chosen)
            return Head(*size, parts, interval, quant, lookup, at)
    raise ValueError("no scan")


class Planes(NamedTuple):
    means: np.ndarray
    """Luma block means of all frames (frames, rows, columns), 0 to 255."""
    pixels: np.ndarray | None
    ok: np.ndarray
    """Frames decoded to their end."""


def decode_scans(head: Head, scans: list[bytes], pixels: bool = False) -> Planes:
    """All frames of one head; scans are the bytes after the head. A scan that ends early gives zeros and ok = False."""
    data = np.frombuffer(b"".join(scans), np.uint8)
    ends = np.cumsum([len(s) for s in scans])
    keep = np.ones(len(data), bool)
    lead = np.flatnonzero(data[:-1] == 255) if len(data) else np.zeros(0, np.int64)
    after = data[lead + 1]
    keep[lead[after == 0] + 1] = False
    marks = lead[(after >= 0xD0) & (after <= 0xD9)]
    keep[marks] = keep[np.minimum(marks + 1, len(keep) - 1)] = False
    to = np.cumsum(keep)  # kept bytes up to and with each byte
    frame_begin = ends - [len(s) for s in scans]
    restart = marks[(data[marks + 1] <= 0xD7)] + 1
    begins = np.sort(np.concatenate((frame_begin, restart + 1)))
    frame = np.searchsorted(ends, begins, "right")
    start = np.where(begins > 0, to[np.minimum(np.maximum(begins - 1, 0), len(to) - 1)], 0) if len(to) else np.zeros(len(begins), np.int64)
    many = len(head.parts) > 1
    wide, high = max(p[0] for p in head.parts), max(p[1] for p in head.parts)
    cols, rows = -(-head.width // (8 * wide)), -(-head.height // (8 * high))
    unit = [c for c, p in enumerate(head.parts) for _ in range(p[0] * p[1])]
    per = len(unit)
    interval = head.interval or cols * rows
    number = np.arange(len(begins)) - np.searchsorted(frame, frame)  # of the interval in its frame
    units = np.clip(cols * rows - number * interval, 0, interval)
    real = units > 0
    frame, number, start, units = frame[real], number[real], start[real], units[real]
    kept = np.concatenate((data[keep], np.zeros(8, np.uint8))).astype(np.int64)
    window = kept[:-4] << 32 | kept[1:-3] << 24 | kept[2:-2] << 16 | kept[3:-1] << 8 | kept[4:]
    tables = head.lookup.ravel()
    mean_of = np.array([head.parts[c][3] for c in unit], np.int64) * 65536
    other_of = (np.array([head.parts[c][4] for c in unit], np.int64) + 4) * 65536
    n = len(start)
    values = np.zeros((n, interval * per), np.int32)
    rest: list[tuple[np.ndarray, ...]] = []
    bad = np.zeros(n, bool)
    live, bit, block, k, total = np.arange(n), start * 8, np.zeros(n, np.int64), np.zeros(n, np.int64), units * per
    limit = (len(window) - 1) * 8
    single = per == 1
    while len(live):
        look = (window[bit >> 3] >> (8 - (bit & 7))) & 0xFFFFFFFF
        if single and not k.any():  # all at a mean: read it, and the end of the block if that follows at once
            entry = tables[mean_of[0] + (look >> 16)].astype(np.int64)
            length, size = entry >> 8, entry & 15
            extra = (look >> (32 - length - size)) & ((1 << size) - 1)
            values[live, block] = extra - ((1 << size) - 1) * ((extra << 1) < (1 << size))
            bit = bit + length + size
            wrong = (length == 0) | (bit > limit)
            then = tables[other_of[0] + (((window[np.minimum(bit >> 3, len(window) - 1)] >> (8 - (bit & 7))) >> 16) & 0xFFFF)].astype(np.int64)
            ends_here = ((then & 255) == 0) & (then > 0)
            bit += np.where(ends_here, then >> 8, 0)
            block = block + ends_here
            k = 1 - ends_here.astype(np.int64)
            if wrong.any() or (block >= total).any():
                bad[live[wrong]] = True
                on = (block < total) & ~wrong & (bit <= limit)
                live, bit, block, k, total = live[on], bit[on], block[on], k[on], total[on]
            continue
        table = np.where(k == 0, mean_of[0], other_of[0]) if single else np.where(k == 0, mean_of[block % per], other_of[block % per])
        entry = tables[table + (look >> 16)].astype(np.int64)
        length, size, run = entry >> 8, entry & 15, (entry >> 4) & 15
        extra = (look >> (32 - length - size)) & ((1 << size) - 1)
        value = np.where(extra >> np.maximum(size - 1, 0), extra, extra - (1 << size) + 1)
        bit += length + size
        first = k == 0
        at = np.flatnonzero(first)
        values[live[at], block[at]] = np.where(size[at] > 0, value[at], 0)
        k = np.where(first, 1, np.where((size == 0) & (run < 15), 64, k + run))
        put = np.flatnonzero(~first & (size > 0) & (k < 64))
        if len(put) and pixels:
            rest.append((live[put], block[put], k[put], value[put]))
        k += ~first & (k < 64)
        done = k >= 64
        block += done
        k[done] = 0
        wrong = (length == 0) | (bit > limit)
        bad[live[wrong]] = True
        on = (block < total) & ~wrong
        if not on.all():
            live, bit, block, k, total = live[on], bit[on], block[on], k[on], total[on]
    ok = np.ones(len(scans), bool)
    ok[frame[bad]] = False
    ok &= np.bincount(frame, weights=units, minlength=len(scans)) >= cols * rows
    # Means are differences to the block before of the same component, anew in each interval.
    luma = [j for j, c in enumerate(unit) if c == 0]
    by_unit = values.reshape(n, interval, per)[:, :, luma].reshape(n, interval * len(luma))
    level = np.cumsum(by_unit, axis=1).reshape(n, interval, len(luma))
    w, h = head.parts[0][:2] if many else (1, 1)
    q = head.quant[head.parts[0][2]]
    frames = np.zeros((len(scans), rows * h, cols * w), np.int32)
    place = number[:, None] * interval + np.arange(interval)
    inside = np.arange(interval) < units[:, None]
    f = np.broadcast_to(frame[:, None], place.shape)[inside]
    row, col = place[inside] // cols, place[inside] % cols
    for j in range(len(luma)):
        frames[f, row * h + j // w, col * w + j % w] = level[:, :, j][inside]
    means = np.clip((frames * int(q[0]) + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return Planes(means, _pixels(head, frames, rest, frame, number, interval, per, luma, q, cols, w, h) if pixels else None, ok)


def _pixels(head: Head, frames: np.ndarray, rest: list, frame: np.ndarray, number: np.ndarray, interval: int, per: int, luma: list[int], q: np.ndarray, cols: int, w: int, h: int) -> np.ndarray:
    """The luma planes: dequantised coefficients through the inverse cosine transform."""
    n, rows, columns = frames.shape
    coef = np.zeros((n, rows, columns, 64))
    coef[..., 0] = frames
    for live, block, k, value in rest:
        j = np.searchsorted(luma, block % per)
        own = np.isin(block % per, luma)
        unit = number[live] * interval + block // per
        f, row, col = frame[live], unit // cols * h + j // w, unit % cols * w + j % w
        coef[f[own], row[own], col[own], k[own]] = value[own]
    square = np.zeros_like(coef)
    square[..., ZIGZAG] = coef * q
    blocks = np.einsum("uy,nrcuv,vx->nrcyx", _COS, square.reshape(n, rows, columns, 8, 8), _COS)
    plane = blocks.transpose(0, 1, 3, 2, 4).reshape(n, rows * 8, columns * 8)[:, : head.height, : head.width]
    return np.clip(np.rint(plane) + 128, 0, 255).astype(np.uint8)


def decode_frames(frames: list[bytes], pixels: bool = False) -> list[tuple[np.ndarray, np.ndarray | None] | None]:
    """For each frame its luma block means (and pixels), or None where it can't be decoded."""
    out: list = [None] * len(frames)
    groups: dict[bytes, tuple[Head, list[int]]] = {}
    last: tuple[bytes, tuple[Head, list[int]]] | None = None
    for i, f in enumerate(frames):
        if last and len(f) > len(last[0]) and f.startswith(last[0]):
            last[1][1].append(i)
            continue
        try:
            head = read_head(f)
        except (ValueError, IndexError, KeyError, struct.error):
            continue
        if len(f) <= head.scan:
            continue
        key = bytes(f[: head.scan])
        last = (key, groups.setdefault(key, (head, [])))
        last[1][1].append(i)
    for head, which in groups.values():
        planes = decode_scans(head, [frames[i][head.scan :] for i in which], pixels)
        for j, i in enumerate(which):
            if planes.ok[j]:
                out[i] = (planes.means[j], planes.pixels[j] if pixels else None)
    return out


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot; histograms (frames, levels) as shares."""
    n = len(histograms)
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    out, begin, seen = [], 0, []
    for t, d in enumerate(change.tolist(), 1):
        recent = seen[-MEMORY:]
        expected = np.mean(recent) + SPREAD * np.std(recent) if len(recent) >= 2 else 0.0
        if d > max(FLOOR, expected):
            out.append((begin, t - begin))
            begin, seen = t, []
        else:
            seen.append(d)
    return [*out, (begin, n - begin)] if n else []


def histogram(means: np.ndarray) -> np.ndarray:
    return np.bincount(means.ravel() >> 4, minlength=LEVELS) / max(1, means.size)


def clips(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, clip, first_frame, n_frames, start_s, end_s, mean_luma, error): a row for each shot of each file.

    A file that is null, no AVI file or has no frame gives one row with an error; frames that can't be decoded are left out of
    the histograms' comparison (they count as the frame before). Times come from the file's frame duration.
    """
    schema = S.StructType([S.StructField(id_col, media.schema[id_col].dataType), *[S.StructField(c, t) for c, t in (("clip", S.IntegerType()), ("first_frame", S.IntegerType()), ("n_frames", S.IntegerType()), ("start_s", S.DoubleType()), ("end_s", S.DoubleType()), ("mean_luma", S.DoubleType()), ("error", S.StringType()))]])

    def of(data: bytes | None) -> list[tuple]:
        try:
            video = read_avi(data or b"")
        except (ValueError, struct.error) as e:
            return [(None, None, None, None, None, None, str(e))]
        decoded = decode_frames([data[a : a + n] for a, n in video.frames])
        if all(d is None for d in decoded):
            return [(None, None, None, None, None, None, "no frame can be decoded")]
        means, last = [], next(d for d in decoded if d)[0]
        for d in decoded:
            last = d[0] if d else last
            means.append(last)
        step = video.frame_us / 1e6
        return [(i, a, n, a * step, (a + n) * step, float(np.mean([m.mean() for m in means[a : a + n]])), None) for i, (a, n) in enumerate(shots(np.array([histogram(m) for m in means])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [of(x) for x in b.column(media_col).to_pylist()]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            cols = zip(*(r for rows in found for r in rows), strict=True) if len(at) else [[]] * 7
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(at), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=schema.names)

    return media.select(id_col, media_col).mapInArrow(run, schema)


def store(chunk: T.Chunk) -> list[bytes]:
    """An AVI file for each text: its bytes, zeros up to a positive multiple of 64, one tile each. The length is in the comment."""
    size = np.diff(chunk.offsets)
    lines = np.maximum(-(-size // TILES), 1)
    n_frames = -(-lines // ROWS)
    first = (np.cumsum(n_frames) - n_frames) * ROWS
    tiles = np.zeros(int(n_frames.sum()) * FRAME, np.uint8)
    tiles[np.arange(len(chunk.data)) + np.repeat(first * TILES - chunk.offsets[:-1], size)] = chunk.data
    frames: list[bytes] = []
    for begin in range(0, len(tiles), GROUP * FRAME):  # a very long text is worked on in parts
        scans, at = encode_tiles(tiles[begin : begin + GROUP * FRAME].reshape(-1, TILES))
        raw, at = scans.tobytes(), at.tolist()
        frames += [FRAME_HEAD + raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    out, f = [], 0
    for n, count in zip(lines.tolist(), n_frames.tolist(), strict=True):
        out.append(write_avi(frames[f : f + count], TILES * 8, ROWS * 8, f"payload={n * TILES}"))
        f += count
    return out


def load(files: list[bytes]) -> list[tuple[bytes, list[np.ndarray]]]:
    """The payload and the frames' block means of files that store() made."""
    videos = [read_avi(f) for f in files]
    frames = [f[a : a + n] for f, v in zip(files, videos, strict=True) for a, n in v.frames]
    decoded = [d for i in range(0, len(frames), GROUP) for d in decode_frames(frames[i : i + GROUP])]
    out, i = [], 0
    for v in videos:
        means = [d[0] for d in decoded[i : i + len(v.frames)]]
        i += len(v.frames)
        out.append((np.concatenate([m.ravel() for m in means]).tobytes()[: int(v.note.partition("payload=")[2])], means))
    return out


def feature(means: list[np.ndarray]) -> str:
    found = shots(np.array([histogram(m) for m in means])) if len(means) > 1 else [(0, len(means))]
    mean = sum(int(m.sum(dtype=np.int64)) for m in means) / sum(m.size for m in means)
    return f"frames={len(means)};shots={len(found)};luma={mean:.3f};clips=" + ",".join(f"{a / FPS:.2f}-{(a + n) / FPS:.2f}" for a, n in found)


def media_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) for each row of docs.

    Each text is stored as an AVI file, and all that follows is computed from what is read back from that file's bytes.
    A null text is an empty one, whose file holds 64 zeros; equal texts have equal files, whatever their ids. A text of
    any length is one file; the arrays around it are worked on GROUP frames at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c in T.chunks(b.column("text"), CHUNK_BYTES):
                files = store(c)
                for n, file, (payload, means) in zip(np.diff(c.offsets).tolist(), files, load(files), strict=True):
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(means)))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return few.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def as_media(docs: DataFrame) -> DataFrame:
    """(id, media): the AVI file of each text of docs (doc_id, text); a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [f for c in T.chunks(b.column("text"), CHUNK_BYTES) for f in store(c)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(files, pa.binary())], names=["id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "id long, media binary")
