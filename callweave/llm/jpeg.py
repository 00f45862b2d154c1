"""Baseline JPEG in numpy: marker parsing, Huffman decoding of many scans in step, DC-only luminance thumbnails.

Decoding works on restart segments: the n-th symbol of all segments of a batch is decoded at once, each with its own bit
position. Images without restart markers are one segment. Any baseline image is read (8-bit, Huffman, one to four
components with sampling factors); progressive, lossless and arithmetic ones raise `Unsupported`.

`payload_images` stores bytes losslessly as greyscale images. The unit is the quantised coefficient: 64 bytes are one
block in zigzag order, a byte's coefficient is one of -128..-1 and 1..128, the likeliest bytes of text having the least
magnitudes, so that they take few bits. Three blocks are a restart segment. A comment holds the payload's length.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

from .common import ranges

UNIT = 192
PER_SEGMENT = 3
MOST_ROWS = 8191
#: Bytes by their likelihood in text; the rest follow in ascending order.
_LIKELY = b"etaonisrhldu\xc3cmgpfywb.v,\n" + "éèêüöäßñóíçàáúâîô".encode("latin-1").translate(bytes((c & 0x3F) | 0x80 for c in range(256))) + b"-kTEIAONSRHLDqxjz0123456789"
ORDER = bytes(dict.fromkeys(b" " + _LIKELY + bytes(range(256))))
_VALUES = np.array([(r // 2 + 1) * (1 - 2 * (r % 2)) for r in range(256)], np.int16)
TO_COEFFICIENT = np.zeros(256, np.int16)
TO_COEFFICIENT[np.frombuffer(ORDER, np.uint8)] = _VALUES
TO_BYTE = np.zeros(512, np.uint8)
TO_BYTE[_VALUES + 256] = np.frombuffer(ORDER, np.uint8)
#: Code lengths of (run 0, size) for sizes 1 to 8, and of DC sizes 0 to 9.
_AC_LENGTHS = {1: 2, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7}
_DC_LENGTHS = {3: 3, 4: 3, 5: 2, 2: 3, 1: 4, 0: 5, 6: 4, 7: 5, 8: 6, 9: 7}


class Unsupported(ValueError):
    """Not a baseline JPEG."""


@dataclass
class Image:
    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, horizontal, vertical, quantisation table
    scan: list[tuple[int, int, int]]  # index of component, DC table, AC table
    quant: dict[int, np.ndarray]
    tables: dict[tuple[int, int], tuple[bytes, bytes]]  # (class, number): counts of lengths, symbols
    interval: int
    comments: list[bytes]
    data: bytes  # entropy-coded, with stuffing and restart markers
    extra: dict = field(default_factory=dict)

    @property
    def mcu_grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        if len(self.scan) == 1:  # not interleaved: an MCU is one block of the component
            across, down = self.blocks_of(self.scan[0][0])
            return across, down
        h = max(c[1] for c in self.components)
        v = max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks_of(self, component: int) -> tuple[int, int]:
        """Blocks across and down that hold samples of a component."""
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        _, own_h, own_v, _ = self.components[component]
        return -(-(-(-self.width * own_h // h)) // 8), -(-(-(-self.height * own_v // v)) // 8)

    def layout(self) -> tuple:
        """What images must share to be decoded in step."""
        if len(self.scan) == 1:
            program = [(0, *self.scan[0][1:])]
        else:
            program = [(i, dc, ac) for i, (c, dc, ac) in enumerate(self.scan) for _ in range(self.components[c][1] * self.components[c][2])]
        return tuple((i, self.tables[0, dc], self.tables[1, ac]) for i, dc, ac in program)


def parse(data: bytes) -> Image:
    """Read markers up to the first scan's end."""
    if data[:2] != b"\xff\xd8":
        raise Unsupported("no start of image")
    at, quant, tables, comments, interval, frame = 2, {}, {}, [], 0, None
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise Unsupported("no scan")
        marker = data[at + 1]
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        if marker == 0xD9:
            raise Unsupported("no scan")
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                quant[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not height or not width:
                raise Unsupported("not 8-bit")
            frame = width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Unsupported(f"frame type {marker:x}")
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xDA:
            if frame is None:
                raise Unsupported("scan before frame")
            ids = [c[0] for c in frame[2]]
            scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = at
            while True:  # the scan's end: a marker that is neither stuffing nor a restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            return Image(*frame, scan, quant, tables, interval, comments, data[at:end])


def _codes(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes, bytes]:
    """Canonical codes (code, length) of symbols, and the table as a marker has it."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = bytearray(16), {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = code, last
        counts[last - 1] += 1
        code += 1
    return codes, bytes(counts), bytes(order)


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: the code's length in the upper byte, its symbol in the lower; 0 for no code."""
    out = np.zeros(1 << 16, np.uint16)
    code, i = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            lo = code << (16 - n)
            out[lo : lo + (1 << (16 - n))] = n << 8 | symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    return out


def _segments(images: list[Image]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scans joined without stuffing and restart markers; each segment's first byte; and each image's segments."""
    joined = np.frombuffer(b"".join(i.data + b"\xff\xd0" for i in images), np.uint8)  # a restart marker ends each scan
    mark = np.flatnonzero(joined[:-1] == 0xFF)
    after = joined[mark + 1]
    drop = np.zeros(len(joined), bool)
    drop[mark[after == 0] + 1] = True
    ends = mark[(after >= 0xD0) & (after <= 0xD7)]
    drop[ends] = drop[ends + 1] = True
    kept_before = np.cumsum(~drop)
    stops = kept_before[ends]  # kept bytes up to each segment's end
    starts = np.concatenate(([0], stops[:-1]))
    image_ends = np.cumsum([len(i.data) + 2 for i in images])
    number = np.diff(np.searchsorted(ends, image_ends, side="left"), prepend=0)
    return joined[~drop], starts, number


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """For each image the quantised coefficients, blocks in scan order x 64 in zigzag order."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, image in enumerate(images):
        groups[image.layout(), image.interval].append(i)
    for (layout, interval), members in groups.items():
        own = [images[i] for i in members]
        data, starts, number = _segments(own)
        mcus = np.array([x * y for x, y in (i.mcu_grid for i in own)], np.int64)
        each = np.minimum(mcus, interval) if interval else mcus
        expect = -(-mcus // np.maximum(each, 1))
        if not np.array_equal(expect, number):
            raise Unsupported("restart markers do not match the frame")
        owner = np.repeat(np.arange(len(own)), number)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        blocks = np.minimum(each[owner], mcus[owner] - nth * each[owner]) * len(layout)
        flat = _decode(data, starts, blocks, layout)
        per_image = np.cumsum(mcus * len(layout))
        for i, hi, n in zip(members, per_image.tolist(), (mcus * len(layout)).tolist(), strict=True):
            out[i] = flat[hi - n : hi]
    return out


def _decode(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, layout: tuple) -> np.ndarray:
    """All blocks of all segments, in order: each step decodes one symbol of every segment that has not ended."""
    padded = np.concatenate((data, np.full(16, 0xFF, np.uint8))).astype(np.uint64)
    m = len(data) + 8
    window = np.zeros(m, np.uint64)
    for j in range(8):
        window = window << np.uint64(8) | padded[j : j + m]
    dc_tables = {x[1]: _lookup(*x[1]) for x in layout}
    ac_tables = {x[2]: _lookup(*x[2]) for x in layout}
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    first = np.cumsum(blocks) - blocks
    bit = starts.astype(np.int64) * 8
    predicted = np.zeros((max(x[0] for x in layout) + 1, len(starts)), np.int32)

    def symbol(table: np.ndarray, at: np.ndarray, take_run: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of segments: runs, sizes and values of their next symbol."""
        b = bit[at]
        byte = b >> 3
        if len(byte) and int(byte.max()) >= m:
            raise Unsupported("a scan is too short")
        w = window[byte] << (b & 7).astype(np.uint64)
        got = table[(w >> np.uint64(48)).astype(np.int64)]
        length = (got >> 8).astype(np.uint64)
        if not length.all():
            raise Unsupported("no such code")
        size = (got & (15 if take_run else 255)).astype(np.uint64)
        value = ((w << length) >> np.uint64(32)) >> (np.uint64(32) - size)
        value = value.astype(np.int32)
        n = size.astype(np.int32)
        low = value < (1 << np.maximum(n - 1, 0))
        value = np.where(low & (n > 0), value - (1 << n) + 1, value)
        bit[at] = b + (length + size).astype(np.int64)
        return ((got >> 4) & 15).astype(np.int64), n, value

    for k in range(int(blocks.max(initial=0))):
        component, dc, ac = layout[k % len(layout)]
        at = np.flatnonzero(blocks > k)
        row = first[at] + k
        _, _, value = symbol(dc_tables[dc], at, False)
        predicted[component, at] += value
        out[row, 0] = predicted[component, at]
        pos = np.ones(len(at), np.int64)
        table = ac_tables[ac]
        while len(at):
            run, size, value = symbol(table, at, True)
            some = size > 0
            pos = pos + np.where(some, run, 0)
            if some.all():
                if int(pos.max()) > 63:
                    raise Unsupported("a run passes its block")
                out[row, pos] = value
                pos = pos + 1
            else:
                if some.any():
                    if int(pos[some].max()) > 63:
                        raise Unsupported("a run passes its block")
                    out[row[some], pos[some]] = value[some]
                pos = np.where(some, pos + 1, np.where(run == 15, pos + 16, 64))
            if int(pos.max()) > 63:
                left = pos < 64
                at, row, pos = at[left], row[left], pos[left]
    return out


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The luminance of each block's mean: the DC coefficients of the first component, one pixel for a block."""
    component = image.scan[0][0]
    across, down = image.blocks_of(component)
    dc = blocks[:, 0].astype(np.int32) * int(image.quant[image.components[component][3]][0])
    if len(image.scan) > 1:
        _, h, v, _ = image.components[component]
        per = sum(image.components[c][1] * image.components[c][2] for c, _, _ in image.scan)
        x, y = image.mcu_grid
        dc = dc.reshape(y, x, per)[:, :, : h * v].reshape(y, x, v, h).transpose(0, 2, 1, 3).reshape(y * v, x * h)
    else:
        dc = dc.reshape(down, across)
    return np.clip(dc[:down, :across] // 8 + 128, 0, 255).astype(np.uint8)


def mean_hash(pixels: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid of means are lighter than their mean."""
    h, w = pixels.shape
    grid = pixels.astype(np.float64)
    for axis, n in ((0, h), (1, w)):
        cells = np.arange(8) * n // 8
        if n >= 8:
            sizes = np.diff(np.append(cells, n))
            grid = np.add.reduceat(grid, cells, axis=axis) / (sizes[:, None] if axis == 0 else sizes[None, :])
        else:
            grid = grid.take(cells, axis=axis)
    return int.from_bytes(np.packbits(grid > grid.mean()).tobytes(), "big")


_DC_CODES, _DC_COUNTS, _DC_SYMBOLS = _codes(_DC_LENGTHS)
_AC_CODES, _AC_COUNTS, _AC_SYMBOLS = _codes(_AC_LENGTHS)


def _code_tables(codes: dict[int, tuple[int, int]], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For coefficients: code with extra bits, and length of both."""
    bits, lengths = np.zeros(len(values), np.uint64), np.zeros(len(values), np.int64)
    for i, v in enumerate(values.tolist()):
        size = abs(v).bit_length()
        if size in codes:
            code, n = codes[size]
            bits[i], lengths[i] = code << size | (v if v > 0 else v + (1 << size) - 1), n + size
    return bits, lengths


_DC_BITS, _DC_SIZES = _code_tables(_DC_CODES, np.arange(-512, 512))
_AC_BITS, _AC_SIZES = _code_tables(_AC_CODES, TO_COEFFICIENT)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = _segment(0xDB, b"\0\x08" + b"\1" * 63) + _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS) + _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS) + _segment(0xDD, struct.pack(">H", PER_SEGMENT))
_SCAN = _segment(0xDA, b"\1\1\0\0\x3f\0")


def payload_images(payloads: list[bytes]) -> list[bytes]:
    """Baseline JPEGs whose coefficients are these bytes; a payload is a positive multiple of UNIT bytes."""
    grids, padded = [], []
    for p in payloads:
        groups = len(p) // UNIT
        across = -(-groups // MOST_ROWS) * PER_SEGMENT
        down = -(-groups * PER_SEGMENT // across)
        grids.append((across, down))
        padded.append(p + b" " * (across * down * 64 - len(p)))
    data = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, PER_SEGMENT, 64)
    bits, sizes = _AC_BITS[data], _AC_SIZES[data]
    dc = TO_COEFFICIENT[data[:, :, 0]].astype(np.int64)
    step = np.diff(dc, axis=1, prepend=0) + 512
    bits[:, :, 0], sizes[:, :, 0] = _DC_BITS[step], _DC_SIZES[step]
    n = len(data)
    bits, sizes = bits.reshape(n, -1), sizes.reshape(n, -1)
    ends = np.cumsum(sizes, axis=1)
    total = ends[:, -1]
    words = int(total.max()) // 32 + 2
    at = ends - sizes
    where = (np.arange(n)[:, None] * words + (at >> 5)).ravel()
    value = (bits << (64 - (at & 31) - sizes).astype(np.uint64)).ravel()
    # bits of one word do not overlap: sums below 2 ** 32 are exact
    packed = np.bincount(where, (value >> np.uint64(32)).astype(np.float64), n * words) + np.bincount(where + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n * words)
    body = packed.astype(np.uint32).astype(">u4").view(np.uint8).reshape(n, -1)
    length = (total + 7) >> 3
    rest = total & 7
    body[np.arange(n), length - 1] |= np.where(rest > 0, 0xFF >> rest, 0).astype(np.uint8)  # the last byte ends in ones
    flat = body.ravel()[ranges(np.arange(n) * body.shape[1], length)]
    # stuffing after each 0xFF, and a restart marker after each segment
    full = flat == 0xFF
    segment = np.repeat(np.arange(n), length)
    place = np.arange(len(flat)) + np.cumsum(full) - full + 2 * segment
    out = np.zeros(len(flat) + int(full.sum()) + 2 * n, np.uint8)
    out[place] = flat
    stops = place[np.cumsum(length) - 1] + 1 + full[np.cumsum(length) - 1]
    per = np.array([a * d // PER_SEGMENT for a, d in grids])
    image_end = np.cumsum(per)
    nth = np.arange(n) - np.repeat(image_end - per, per)
    out[stops], out[stops + 1] = 0xFF, (0xD0 + nth % 8).astype(np.uint8)
    raw = out.tobytes()
    images, begin = [], 0
    for p, (across, down), last in zip(payloads, grids, stops[image_end - 1].tolist(), strict=True):
        frame = struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\1\x11\0"
        images.append(b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + _TABLES + _segment(0xC0, frame) + _SCAN + raw[begin:last] + b"\xff\xd9")
        begin = last + 2
    return images


def payloads(images: list[Image], blocks: list[np.ndarray]) -> list[bytes]:
    """The bytes of images made by `payload_images`."""
    out = []
    for image, own in zip(images, blocks, strict=True):
        size = next((int(c.split()[1]) for c in image.comments if c.startswith(b"payload ")), None)
        if size is None:
            raise Unsupported("no payload")
        out.append(TO_BYTE[own.ravel() + 256].tobytes()[:size])
    return out
