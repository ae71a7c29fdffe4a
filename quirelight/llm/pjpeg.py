"""Media columns: progressive JPEG, from scans to full-resolution RGB tensors.

``decode_batch`` reads progressive JPEG files (SOF2, Huffman coding, 1 or 3 components with sampling factors 1 or 2,
with or without restart intervals). Spectral-selection and successive-approximation scans are accumulated into one
array of coefficients (blocks, 64, zigzag order). ``tensors`` multiplies them by the quantisation tables, applies the
inverse transform as an exact integer matrix product, lays the blocks out, repeats chroma to full resolution and
converts to RGB (bytes, height x width x 3).

Entropy decoding is bound to be one symbol after another within a restart segment, so segments of all scans and all
files of a batch are decoded side by side, a symbol of each at a time. In refinement scans only symbols are decoded
that way; correction bits, nearly all of the data, are located by prefix sums and applied at once.

``encode_batch`` stores bytes losslessly, a coefficient each, common bytes of texts as small values (``BYTE_OF``), so
that the file is smaller than the text: first scans with the lowest bit left out
(DC, then AC of each component, luminance in two bands), then a refinement scan for each. The payload's length is in a
comment segment. Chroma is sampled 2 x 2. Equal payloads give equal files.

Cases: null and empty texts are 64 zero bytes; very long texts give large images (up to 65,535 pixels a side: over 6
GB); broken files raise ValueError; repeated rows get a row each; an empty table gives an empty result; other columns
are ignored. Memory is bounded by ``BATCH_BYTES`` of payload, or one file if that is larger.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, remembered, table, unlike

BATCH_BYTES = 1 << 19
RESTART = 8
SCALE = 20

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
NATURAL = np.argsort(ZIGZAG)
#: Scans as written: component (-1 for all), first and last coefficient, bit before, bit now.
SCANS = ((-1, 0, 0, 0, 1), (0, 1, 5, 0, 1), (0, 6, 63, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1), (-1, 0, 0, 1, 0), (0, 1, 63, 1, 0), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0))
BITS = np.array([0, *(int(i).bit_length() for i in range(1, 1 << 12))], np.uint8)
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT counts and symbols, and codes and lengths by symbol, of a prefix code with the lengths given."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes = np.zeros(256, np.uint64), np.zeros(256, np.uint8)
    code = last = 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    counts = bytes(sum(n == i for n in lengths.values()) for i in range(1, 17))
    return counts + bytes(order), codes, sizes


#: Bytes that texts are mostly made of, most frequent first: letters of Latin scripts, UTF-8's lead byte, padding, points.
COMMON = b" enitarsdlouchm\xc3g\x00fpbw.y,vkqz\nxj"


def _byte_of() -> np.ndarray:
    """The byte of each coefficient value (from -128): by magnitude from 2 on, then those whose first bit is in the refinement."""
    values = sorted(range(-128, 128), key=lambda v: (abs(v) < 2 or v == -128, abs(v), v))
    out = np.empty(256, np.uint8)
    out[np.array(values) + 128] = np.frombuffer(bytes(dict.fromkeys(COMMON + bytes(range(33, 256)) + bytes(range(33)))), np.uint8)
    return out


BYTE_OF = _byte_of()
VALUE_OF = (np.argsort(BYTE_OF) - 128).astype(np.int16)

# Code lengths: short for the sizes that texts have, 11 bits for every other symbol of AC scans.
DC_TABLE = canonical({s: 4 for s in range(12)})
_LENGTHS = {r << 4 | s: 11 for r in range(16) for s in range(11)} | {0x00: 5, 0x01: 2, 0x02: 2, 0x03: 3, 0x04: 4, 0x05: 5, 0x06: 5, 0x07: 6}
AC_TABLE = canonical(_LENGTHS)


@remembered
def lookup(spec: bytes) -> np.ndarray:
    """For each 16 bits that a code may start, its length * 256 + its symbol; 0 where there is no code."""
    out = np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for s in spec[at : at + spec[n - 1]]:
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
            code += 1
        at += spec[n - 1]
        code <<= 1
    return out


# ---------------------------------------------------------------- encoder


def geometry(blocks: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units (6 blocks each) that hold so many blocks."""
    units = max(1, -(-blocks // 6))
    columns = isqrt(units - 1) + 1
    return columns, -(-units // columns)


@remembered
def interleaved(columns: int, rows: int, sampling: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in the order of an interleaved scan, numbered component after component, and their components."""
    out, comp, base = [], [], 0
    my, mx = np.divmod(np.arange(columns * rows), columns)
    for c, (h, v) in enumerate(sampling):
        for y in range(v):
            for x in range(h):
                out.append(base + (my * v + y) * (columns * h) + mx * h + x)
                comp.append(c)
        base += columns * rows * h * v
    return np.stack(out, 1).ravel(), np.tile(np.array(comp), columns * rows)


def _pack(values: np.ndarray, sizes: np.ndarray, segment: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of n segments, each filled up with ones, and the segments' lengths."""
    off = np.cumsum(sizes, dtype=np.int64)
    counts = np.bincount(segment, minlength=n)
    ends = np.concatenate([[0], off])[np.cumsum(counts)]
    bits = np.diff(ends, prepend=0)
    length = (bits + 7) >> 3
    first = np.concatenate([[0], np.cumsum(length)])
    off += np.repeat(first[:-1] * 8 - (ends - bits), counts) - sizes
    word = off >> 6
    end = (off & 63) + sizes
    over = np.flatnonzero(end > 64)
    high = values << np.maximum(64 - end, 0).astype(np.uint64)
    high[over] = values[over] >> (end[over] - 64).astype(np.uint64)
    out = np.zeros((int(first[-1]) >> 3) + 2, np.uint64)
    if len(word):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[heads]] = np.bitwise_or.reduceat(high, heads)
        out[word[over] + 1] |= values[over] << (128 - end[over]).astype(np.uint64)
    data = out.byteswap().view(np.uint8)[: first[-1]]
    some = length > 0
    data[first[1:][some] - 1] |= ((1 << (length * 8 - bits)[some]) - 1).astype(np.uint8)
    return data, length


def _extra(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category of values and the bits that tell them apart in it."""
    s = BITS[np.abs(v)].astype(np.int32)
    return s, (v + (v >> 31 & ((1 << s) - 1))).astype(np.uint64)


def _coded(table: tuple, symbols: np.ndarray, extra: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return table[1][symbols] << bits.astype(np.uint64) | extra, table[2][symbols] + bits


def _dc_first(x: np.ndarray, comp: np.ndarray, segment: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = x[:, 0].astype(np.int32) >> al
    diff = v.copy()
    for c in range(3):
        own = np.flatnonzero(comp == c)
        same = segment[own][1:] == segment[own][:-1]
        diff[own[1:]] -= np.where(same, v[own[:-1]], 0)
    s, extra = _extra(diff)
    return *_coded(DC_TABLE, s, extra, s), segment


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items (order, value, size) of all parts in order."""
    parts = [p for p in parts if len(p[0])]
    key, value, size = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(parts) > 1:
        order = np.argsort(key, kind="stable")
        key, value, size = key[order], value[order], size[order]
    return key, value, size


def _fixed(key: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return key, np.full(len(key), AC_TABLE[1][symbol], np.uint64), np.full(len(key), int(AC_TABLE[2][symbol]), np.int32)


def _ac_first(x: np.ndarray, segment: np.ndarray, ss: int, se: int, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    band = x[:, ss : se + 1].astype(np.int32)
    w = band.shape[1]
    v = (band + (band >> 31 & ((1 << al) - 1))) >> al  # towards zero
    at = np.flatnonzero(v)
    block = (at // w).astype(np.int32)
    k = (at - block * np.int64(w)).astype(np.int32)
    run = np.diff(at, prepend=-1).astype(np.int32) - 1
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    run[heads] = k[heads]
    s, extra = _extra(v.ravel()[at])
    value, size = _coded(AC_TABLE, (run & 15) << 4 | s, extra, s)
    ends = np.flatnonzero(v[:, -1] == 0)
    if not len(ends) and not (run > 15).any():
        return value, size, segment[block]
    key = block.astype(np.int64) * 256 + k * 2 + 1
    long = np.repeat(key - 1, run >> 4)
    key, value, size = _merged([(key, value, size), _fixed(long, 0xF0), _fixed(ends * 256 + 255, 0x00)])
    return value, size, segment[key >> 8]


def _dc_refine(x: np.ndarray, segment: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (x[:, 0].astype(np.int64) >> al & 1).astype(np.uint64), np.ones(len(x), np.int64), segment


def _ac_refine(x: np.ndarray, segment: np.ndarray, ss: int, se: int, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corrections of a stretch follow its symbol, so every item's order is the end of its stretch, then its kind."""
    band = x[:, ss : se + 1].astype(np.int32)
    mag = np.abs(band) >> al
    w = band.shape[1]
    old, new = mag > 1, mag == 1
    block, k = np.nonzero(new)
    some, line = np.unique(block, return_inverse=True)
    skipped = np.cumsum(~old[some], axis=1)[line, k] - 1  # coefficients without history before, in the block
    run = np.diff(skipped, prepend=-1) - 1
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    run[heads] = skipped[heads]
    if (run > 15).any():
        return _ac_refine_long(band, mag, old, new, segment)
    value, size = _coded(AC_TABLE, run << 4 | 1, (band[block, k] > 0).astype(np.uint64), np.ones(len(k), np.int32))
    at = np.flatnonzero(old)
    ob = at // w
    # The stretch of each coefficient: up to the next new one of its block, else to its end.
    ahead = np.full(len(at), w)
    if len(k):
        to = np.full((len(some), w), w)
        to[line, k] = k
        to = np.minimum.accumulate(to[:, ::-1], axis=1)[:, ::-1]
        mixed = np.flatnonzero(np.isin(ob, some))
        ahead[mixed] = to[np.searchsorted(some, ob[mixed]), at[mixed] - ob[mixed] * w]
    fix = (ob * 4096 + ahead * 32 + 2, (mag.ravel()[at] & 1).astype(np.uint64), np.ones(len(at), np.int32))
    tail = np.flatnonzero(~new[:, -1])
    key, value, size = _merged([(block * 4096 + k * 32 + 1, value, size), _fixed(tail * 4096 + w * 32 + 1, 0x00), fix])
    return value, size, segment[key >> 12]


def _ac_refine_long(band: np.ndarray, mag: np.ndarray, old: np.ndarray, new: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for blocks with runs over 15, symbol by symbol."""
    values, sizes, segs = [], [], []

    def put(symbol, fixes, sign=None):
        v, n = int(AC_TABLE[1][symbol]), int(AC_TABLE[2][symbol])
        items = [(v, n)] + ([(sign, 1)] if sign is not None else []) + [(f, 1) for f in fixes]
        for v, n in items:
            values.append(v)
            sizes.append(n)
            segs.append(segment[b])

    for b in range(len(band)):
        run, fixes = 0, []
        left = int(new[b].sum())
        for k in range(band.shape[1]):
            if old[b, k]:
                fixes.append(int(mag[b, k]) & 1)
            elif new[b, k]:
                put(run << 4 | 1, fixes, int(band[b, k] > 0))
                run, fixes, left = 0, [], left - 1
            elif left and run == 15:
                put(0xF0, fixes)
                run, fixes = 0, []
            else:
                run += 1
        if not new[b, -1]:
            put(0x00, fixes)
    return np.array(values, np.uint64), np.array(sizes, np.int64), np.array(segs, np.int64)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body


HEAD = (
    _segment(0xDB, b"\x00" + b"\x01" * 64),
    _segment(0xC4, b"\x00" + DC_TABLE[0] + b"\x10" + AC_TABLE[0]) + _segment(0xDD, RESTART.to_bytes(2, "big")),
)
SOS = [_segment(0xDA, (b"\x03\x01\x00\x02\x00\x03\x00" if c < 0 else bytes((1, c + 1, 0))) + bytes((ss, se, ah << 4 | al))) for c, ss, se, ah, al in SCANS]
SAMPLING = ((2, 2), (1, 1), (1, 1))


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload (of a positive multiple of 64 bytes)."""
    shapes = [geometry(len(p) // 64) for p in payloads]
    units = np.array([c * r for c, r in shapes])
    base = np.concatenate([[0], np.cumsum(units * 6)])
    coef = np.zeros((int(base[-1]), 64), np.int16)
    flat = coef.reshape(-1)
    for b, p in zip(base, payloads):
        flat[b * 64 : b * 64 + len(p)] = VALUE_OF[np.frombuffer(p, np.uint8)]
    streams = []
    for c, ss, se, ah, al in SCANS:
        if c < 0:
            laid = [interleaved(*s, SAMPLING) for s in shapes]
            order = np.concatenate([o + b for (o, _), b in zip(laid, base)])
            comp = np.concatenate([x for _, x in laid])
            per, count = 6, units
        else:
            count = units * 4 if c == 0 else units
            from_ = base[:-1] + (0, 4, 5)[c] * units
            order = np.repeat(from_ - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            per = 1
        segments = -(-count // RESTART)
        first = np.concatenate([[0], np.cumsum(segments)])
        place = np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        segment = np.repeat(np.repeat(first[:-1], count) + place // RESTART, per)
        x = coef[order]
        if c < 0:
            items = _dc_refine(x, segment, al) if ah else _dc_first(x, comp, segment, al)
        else:
            items = (_ac_refine if ah else _ac_first)(x, segment, ss, se, al)
        data, length = _pack(*items, int(first[-1]))
        ends = np.cumsum(length)
        stuffed = np.flatnonzero(data == 0xFF) + 1
        number = np.arange(first[-1]) - np.repeat(first[:-1], segments)
        inner = np.flatnonzero(number < np.repeat(segments, segments) - 1)
        marks = np.stack([np.full(len(inner), 0xFF), 0xD0 + number[inner] % 8], 1).ravel().astype(np.uint8)
        at = np.concatenate([stuffed, np.repeat(ends[inner], 2)])
        sort = np.argsort(at, kind="stable")
        out = np.insert(data, at[sort], np.concatenate([np.zeros(len(stuffed), np.uint8), marks])[sort]).tobytes()
        cut = np.concatenate([[0], ends])[first]
        cut = cut + np.searchsorted(at[sort], cut, side="right")
        cut[0] = 0
        streams.append((out, cut.tolist()))
    files = []
    for i, ((columns, rows), p) in enumerate(zip(shapes, payloads)):
        frame = b"\x08" + (rows * 16).to_bytes(2, "big") + (columns * 16).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        parts = [b"\xff\xd8", _segment(0xFE, b"payload-bytes %d" % len(p)), HEAD[0], _segment(0xC2, frame), HEAD[1]]
        for sos, (out, cut) in zip(SOS, streams):
            parts += [sos, out[cut[i] : cut[i + 1]]]
        files.append(b"".join([*parts, b"\xff\xd9"]))
    return files


# ---------------------------------------------------------------- decoder


class Image:
    """Header of a file: frame, tables, scans with their entropy-coded bytes."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.comment, self.quant, self.scans, self.restart = b"", {}, [], 0
        tables: dict[int, bytes] = {}
        self.comps: list[tuple[int, int, int, int]] = []
        at = 2
        while True:
            if data[at : at + 1] != b"\xff":
                raise ValueError("no marker where one is due")
            kind = data[at + 1]
            if kind == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xFE:
                self.comment = body
            elif kind == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.quant[body[0] & 15] = body[1 : 1 + 64 * wide], wide
                    body = body[1 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif kind == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif kind == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.comps = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif kind == 0xDA:
                n = body[0]
                which = {c[0]: i for i, c in enumerate(self.comps)}
                comps = [which[body[1 + 2 * i]] for i in range(n)]
                ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
                codes = [body[2 + 2 * i] for i in range(n)]
                specs = [tables.get(t >> 4) if ss == 0 else tables.get(0x10 | t & 15) for t in codes]
                m = MARKER.search(data, at)
                if not m:
                    raise ValueError("scan without an end")
                self.scans.append((tuple(comps), ss, se, approx >> 4, approx & 15, tuple(specs), self.restart, data[at : m.start()]))
                at = m.start()
            elif 0xC0 <= kind <= 0xCF:
                raise ValueError("not a progressive JPEG file with Huffman coding")
        if not self.comps:
            raise ValueError("no frame")
        self.sampling = tuple((h, v) for _, h, v, _ in self.comps)
        self.hmax, self.vmax = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        self.columns, self.rows = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.shapes = [(self.rows * v, self.columns * h) for h, v in self.sampling]
        self.blocks = sum(r * c for r, c in self.shapes)


@remembered
def _own_blocks(sampling: tuple, c: int, columns: int, rows: int, width: int, height: int) -> np.ndarray:
    """Blocks of a component in the order of a scan of its own: those that hold pixels."""
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    base = sum(columns * rows * h * v for h, v in sampling[:c])
    h, v = sampling[c]
    across, down = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
    return base + (np.arange(down)[:, None] * (columns * h) + np.arange(across)[None]).ravel()


class Streams:
    """Restart segments of scans, one column of arrays each: where their bits start, their blocks, their scan."""

    def __init__(self, images: list[Image], bases: np.ndarray, want, luts: dict[bytes, int]):
        raw, order, comp = [], [], []
        at = blocks = 0
        scan_start, info = [], []
        for image, base in zip(images, bases):
            for comps, ss, se, ah, al, specs, restart, data in want(image):
                if len(comps) > 1 or len(image.comps) == 1 and ss == 0 and image.sampling[0] == (1, 1):
                    o, c = interleaved(image.columns, image.rows, image.sampling)
                    units, per = image.columns * image.rows, len(c) // (image.columns * image.rows)
                else:
                    o = _own_blocks(image.sampling, comps[0], image.columns, image.rows, image.width, image.height)
                    c, units, per = np.full(len(o), comps[0]), len(o), 1
                table = [luts.setdefault(s, len(luts)) if s is not None else 0 for s in specs]
                by_comp = [0, 0, 0, 0]
                for x, t in zip(comps, table):
                    by_comp[x] = t
                info.append((ss, se, al, blocks, units, per, restart or units, by_comp))
                scan_start.append(at)
                raw.append(data)
                order.append(o + base)
                comp.append(c)
                at += len(data)
                blocks += len(o)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.comp = np.concatenate(comp) if comp else np.zeros(0, np.int64)
        buf = np.frombuffer(b"".join(raw) + bytes(2), np.uint8)
        ff = np.flatnonzero(buf[:-1] == 0xFF)
        after = buf[ff + 1]
        rst = ff[(after & 0xF8) == 0xD0]
        keep = np.ones(len(buf), bool)
        keep[ff[after == 0] + 1] = False
        keep[rst] = keep[rst + 1] = False
        self.bytes = np.concatenate([buf[keep], np.zeros(16, np.uint8)])
        moved = np.concatenate([[0], np.cumsum(keep)])
        starts = np.sort(np.concatenate([np.array(scan_start, np.int64), rst + 2]))
        scan = np.searchsorted(np.array(scan_start, np.int64), starts, side="right") - 1
        number = np.arange(len(starts)) - np.searchsorted(scan, scan)
        cols = [np.array(x, np.int64) for x in zip(*(i[:7] for i in info))] if info else [np.zeros(0, np.int64)] * 7
        ss, se, al, first, units, per, restart = (c[scan] for c in cols)
        self.tables = np.array([i[7] for i in info], np.int64).reshape(-1, 4)[scan]
        self.ss, self.se, self.al, self.bit = ss, se, al, moved[starts] * 8
        self.lo = first + number * restart * per
        self.hi = first + np.minimum((number + 1) * restart, units) * per
        if info and not (len(starts) == (-(-cols[4] // cols[6])).sum()):
            raise ValueError("restart markers don't fit the scans")
        #: Eight bytes from any byte on.
        self.window = np.ndarray((len(self.bytes) - 8,), ">u8", self.bytes.data, strides=(1,))

    def look(self, bit: np.ndarray) -> np.ndarray:
        """The next bits, at the top of 64; 57 of them hold."""
        return self.window[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)

    def bits_at(self, bit: np.ndarray) -> np.ndarray:
        return self.bytes[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1


def _signed(extra: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(extra < (1 << s >> 1), extra - (1 << s) + 1, extra)


def _decode_dc_first(st: Streams, luts: np.ndarray, coef: np.ndarray) -> None:
    pred = np.zeros((len(st.bit), 4), np.int64)
    bit, at, live = st.bit.copy(), st.lo.copy(), np.arange(len(st.bit))
    while True:
        live = live[at[live] < st.hi[live]]
        if not len(live):
            return
        win, c = st.look(bit[live]), st.comp[at[live]]
        e = luts[st.tables[live, c], (win >> np.uint64(48)).astype(np.int64)]
        n, s = e >> 8, e & 15
        extra = (win << n.astype(np.uint64) >> np.uint64(1) >> (63 - s).astype(np.uint64)).astype(np.int64)
        pred[live, c] += _signed(extra, s)
        coef[st.order[at[live]], 0] = pred[live, c] << st.al[live]
        bit[live] += n + s
        at[live] += 1


def _decode_dc_refine(st: Streams, coef: np.ndarray) -> None:
    n = st.hi - st.lo
    seg = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    got = st.bits_at(st.bit[seg] + place).astype(np.int16)
    coef[st.order[st.lo[seg] + place], 0] |= got << st.al[seg].astype(np.int16)


def _decode_ac_first(st: Streams, luts: np.ndarray, coef: np.ndarray) -> None:
    flat = coef.reshape(-1)
    lut = luts.reshape(-1)
    base = np.take_along_axis(st.tables, st.comp[st.lo][:, None], 1)[:, 0] << 16 if len(st.lo) else st.lo
    bit, at, hi, ss, se, al = st.bit.copy(), st.lo.copy(), st.hi, st.ss, st.se, st.al
    k, one = ss.copy(), np.uint64(1)
    block = st.order[np.minimum(at, len(st.order) - 1)] << 6 if len(at) else at
    while len(bit):
        win = st.look(bit)
        e = lut[base + (win >> np.uint64(48)).astype(np.int64)]
        n, r, s = e >> 8, e >> 4 & 15, e & 15
        if not n.all():
            raise ValueError("no such code")
        rest = win << n.astype(np.uint64)
        extra = (rest >> one >> (63 - s).astype(np.uint64)).astype(np.int64)
        odd = s == 0
        k += r
        if odd.any():
            put = np.flatnonzero(~odd)
            flat[np.minimum(block[put] + k[put], len(flat) - 1)] = _signed(extra[put], s[put]) << al[put]
            end = np.flatnonzero(odd & (r < 15))
            skip = (1 << r[end]) + (rest[end] >> one >> (63 - r[end]).astype(np.uint64)).astype(np.int64) - 1
            at[end] += skip
            bit[end] += r[end]
            k[end] = 64
        else:
            flat[np.minimum(block + k, len(flat) - 1)] = _signed(extra, s) << al
        bit += n + s
        k += 1
        over = k > se
        if over.any():
            at += over
            k = np.where(over, ss, k)
            more = at < hi
            if not more.all():
                bit, at, hi, ss, se, al, k, base = (x[more] for x in (bit, at, hi, ss, se, al, k, base))
            block = st.order[at] << 6


def _decode_ac_refine(st: Streams, luts: np.ndarray, coef: np.ndarray) -> None:
    if not len(st.bit):
        return
    flat, lut = coef.reshape(-1), luts.reshape(-1)
    rows = coef[st.order]
    seg = np.repeat(np.arange(len(st.lo)), st.hi - st.lo)
    line = np.arange(64)[None]
    band = (line >= st.ss[seg][:, None]) & (line <= st.se[seg][:, None])
    old = (rows != 0) & band
    before = np.concatenate([[0], np.cumsum(old.ravel())])  # corrections before a place
    zeros = np.flatnonzero(((rows == 0) & band).ravel())
    ahead = np.concatenate([[0], np.cumsum(((rows == 0) & band).ravel())])
    base = np.take_along_axis(st.tables, st.comp[st.lo][:, None], 1)[:, 0] << 16
    bit, at, k, live = st.bit.copy(), st.lo.copy(), st.ss.copy(), np.arange(len(st.bit))
    stretches, placed = [], []
    one = np.uint64(1)
    while len(live):
        b, a, kk = bit[live], at[live], k[live]
        win = st.look(b)
        e = lut[base[live] + (win >> np.uint64(48)).astype(np.int64)]
        n, r, s = e >> 8, e >> 4 & 15, e & 15
        if not n.all() or (s > 1).any():
            raise ValueError("no such code in a refinement scan")
        rest = win << n.astype(np.uint64)
        from_ = a * 64 + kk
        ends = (s == 0) & (r < 15)
        take = np.where(ends, r, s)
        extra = (rest >> one >> (63 - take).astype(np.uint64)).astype(np.int64)
        b = b + n + take
        run = (1 << np.where(ends, r, 0)) + np.where(ends, extra, 0)
        target = zeros[np.minimum(ahead[from_] + r, max(len(zeros) - 1, 0))] if len(zeros) else np.full(len(live), -1)
        inside = ~ends & (target >> 6 == a) & (target >= from_)
        to = np.where(ends, (a + run) * 64, np.where(inside, target, (a + 1) * 64))
        stretches.append((from_, to, b))
        new = np.flatnonzero(inside & (s == 1))
        placed.append((target[new], np.where(extra[new] == 1, 1, -1) << st.al[live[new]]))
        b = b + before[to] - before[from_]
        kk = np.where(inside, (target & 63) + 1, 64)
        over = kk > st.se[live]
        at[live] = np.where(ends, a + run, a + over)
        k[live] = np.where(ends | over, st.ss[live], kk)
        bit[live] = b
        live = live[at[live] < st.hi[live]]
    from_, to, start = (np.concatenate(x) for x in zip(*stretches))
    sort = np.argsort(from_, kind="stable")
    from_, to, start = from_[sort], to[sort], start[sort]
    count = before[to] - before[from_]
    nz = np.flatnonzero(old.ravel())
    if count.sum() != len(nz):
        raise ValueError("refinement scan doesn't reach all coefficients")
    got = st.bits_at(np.repeat(start - before[from_], count) + np.arange(len(nz)))
    hit = nz[got == 1]
    where = (st.order[hit >> 6] << 6) + (hit & 63)
    flat[where] += (np.sign(flat[where]) << st.al[seg[hit >> 6]]).astype(np.int16)
    target, value = (np.concatenate(x) for x in zip(*placed))
    flat[(st.order[target >> 6] << 6) + (target & 63)] = value


def decode_batch(files: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """Headers, coefficients of all files (blocks, 64, zigzag) and each file's first block.

    A file's first scans are decoded first, then its refinements in order: rounds of scans of one kind, over all files.
    """
    images = [Image(f) for f in files]
    bases = np.concatenate([[0], np.cumsum([i.blocks for i in images])]).astype(np.int64)
    coef = np.zeros((int(bases[-1]), 64), np.int16)
    deepest = max((s[3] for i in images for s in i.scans), default=0)
    for ah in (0, *range(deepest, 0, -1)):
        for dc in (True, False):
            luts: dict[bytes, int] = {}
            st = Streams(images, bases, lambda i: [s for s in i.scans if s[3] == ah and (s[1] == 0) == dc], luts)
            tables = np.stack([lookup(s) for s in luts]) if luts else np.zeros((1, 1 << 16), np.int64)
            if dc:
                _decode_dc_refine(st, coef) if ah else _decode_dc_first(st, tables, coef)
            else:
                (_decode_ac_refine if ah else _decode_ac_first)(st, tables, coef)
    return images, coef, bases


def stored_payload(image: Image, coef: np.ndarray) -> bytes:
    """The bytes that encode_batch() put into a file."""
    m = re.fullmatch(rb"payload-bytes (\d+)", image.comment)
    if not m:
        raise ValueError("no payload in this file")
    return BYTE_OF[coef.reshape(-1)[: int(m[1])] + 128].tobytes()


@remembered
def _inverse() -> np.ndarray:
    """Zigzag coefficients to pixels, times 2 ** SCALE, in whole numbers: sums are exact in any order."""
    x, u = np.arange(8)[:, None], np.arange(8)[None]
    d = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    both = np.einsum("yv,xu->vuyx", d, d).reshape(64, 64)
    return np.rint(both[ZIGZAG] * (1 << SCALE))


def tensors(images: list[Image], coef: np.ndarray, bases: np.ndarray) -> Iterator[np.ndarray]:
    """Full-resolution RGB of each file: uint8 arrays (height, width, 3)."""
    basis = _inverse()
    for image, base in zip(images, bases):
        planes, at = [], int(base)
        for (rows, columns), (_, h, v, q) in zip(image.shapes, image.comps):
            data, wide = image.quant[q]
            quant = np.frombuffer(data, ">u2" if wide == 2 else np.uint8).astype(np.float64)
            n = rows * columns
            pix = (coef[at : at + n] * quant) @ basis
            pix = np.floor((pix + ((1 << SCALE - 1) + (128 << SCALE))) * 2.0**-SCALE)
            plane = np.clip(pix, 0, 255).astype(np.int32).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
            if image.vmax // v > 1:
                plane = plane.repeat(image.vmax // v, 0)
            if image.hmax // h > 1:
                plane = plane.repeat(image.hmax // h, 1)
            planes.append(plane[: image.height, : image.width])
            at += n
        if len(planes) == 1:
            yield np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
            continue
        y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
        half = 1 << 15
        k = [round(c * 65536) for c in (1.402, 0.344136, 0.714136, 1.772)]
        rgb = np.stack([y + k[0] * cr + half, y - k[1] * cb - k[2] * cr + half, y + k[3] * cb + half], -1) >> 16
        yield np.clip(rgb, 0, 255).astype(np.uint8)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def batches(texts: list[str | None], limit: int = BATCH_BYTES) -> Iterator[list[str | None]]:
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t or "") + 64
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def _with(df: DataFrame, made: Column, fields: list[str]) -> DataFrame:
    """df with the fields of a struct as columns; they replace columns of their names, in any letter case."""
    name = free_name(df, "_made")
    kept = [F.col(f"`{c}`") for c in unlike(df.columns, fields)]
    return df.withColumn(name, made).select(*kept, *(F.col(name)[x].alias(x) for x in fields))


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns n_bytes and media: each text's padded bytes as a progressive JPEG file."""

    @F.pandas_udf("struct<n_bytes: bigint, media: binary>")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            sizes, files = [], []
            for some in batches(s.tolist()):
                ready = [padded(t) for t in some]
                sizes += [n for n, _ in ready]
                files += encode_batch([p for _, p in ready])
            yield pd.DataFrame({"n_bytes": np.array(sizes, np.int64), "media": files})

    return _with(docs, of(text), ["n_bytes", "media"])


def _file_batches(files: list[bytes]) -> Iterator[list[bytes]]:
    some, held = [], 0
    for f in files:
        some.append(f)
        held += len(f)
        if held >= BATCH_BYTES:
            yield some
            some, held = [], 0
    if some:
        yield some


def decode(media: DataFrame, column: str = "media") -> DataFrame:
    """media with height, width and rgb (the full-resolution tensor's bytes)."""

    @F.pandas_udf("struct<height: int, width: int, rgb: binary>")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = []
            for some in _file_batches(s.tolist()):
                images, coef, bases = decode_batch(some)
                rows += [(i.height, i.width, t.tobytes()) for i, t in zip(images, tensors(images, coef, bases))]
            yield pd.DataFrame(rows, columns=["height", "width", "rgb"])

    return _with(media, of(column), ["height", "width", "rgb"])


def digests(media: DataFrame, column: str = "media") -> DataFrame:
    """media with what is read back: payload digests, the file's digest and features of the RGB tensor."""
    fields = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    @F.pandas_udf("struct<payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string>")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = []
            for some in _file_batches(s.tolist()):
                images, coef, bases = decode_batch(some)
                for f, image, lo, hi, rgb in zip(some, images, bases, bases[1:], tensors(images, coef, bases)):
                    p = stored_payload(image, coef[lo:hi])
                    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
                    feature = f"{image.height}x{image.width}:{sums[0]},{sums[1]},{sums[2]}:{zlib.crc32(rgb):08x}"
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=fields)

    return _with(media, of(column), fields)


def op5(spark, sf_dir: str) -> DataFrame:
    stored = materialise(store(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pjpeg-media", "zstd")
    return digests(stored).drop("media")
