"""Media columns: lossless WebP (VP8L) decoding to pixel arrays, after the public bitstream specification.

decode() reads the prefix codes (simple and normal, one group or several by an entropy image), literals, back-references with
their two-dimensional distances, and the colour cache, and undoes the predictor, cross-colour, subtract-green and palette
transforms (pixels bundled in a byte included).  encode() writes such streams with any combination of these features; it makes
the media column that the tables lack.

Defined results: a null value has the status "null", a broken, truncated or empty one "invalid", a lossy or animated one
"unsupported", each with null pixels; a picture of any size is decoded whole; repeated rows give equal results; every row is
kept, also without id; columns other than the two named ones are ignored; an empty table gives no rows.

Scale: one narrow pass, no shuffle; a picture is decoded by one task, Arrow's batches bound the bytes in flight.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_HASH = 0x1E35A7BD
_OPAQUE = 0xFF000000
#: Pixels of a front from which it is worth a numpy operation.
FRONT = 12


def _near():
    """The 120 short distances (x, y), nearest first, in the specification's order."""
    text = (
        "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 "
        "3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 "
        "6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 "
        "8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
    )
    return [tuple(map(int, x.split(","))) for x in text.split()]


NEAR = _near()


class Broken(ValueError):
    pass


class Unsupported(ValueError):
    pass


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.have = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        # zeros follow the end, as many as one symbol may ask for in advance; more is an error
        if not part:
            self.at += 8
            if self.at > len(self.data) + 32:
                raise Broken("the data end early")
            self.have += 64
            return
        self.held |= int.from_bytes(part, "little") << self.have
        self.at += 8
        self.have += 64

    def read(self, n: int) -> int:
        if self.have < n:
            self.fill()
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.have -= n
        return out


class Code:
    """A canonical prefix code as a table indexed by the next `bits` bits; an entry is symbol << 4 | length."""

    def __init__(self, lengths: dict[int, int]):
        used = sorted((n, s) for s, n in lengths.items() if n)
        if not used:
            used = [(0, 0)]
        if len(used) == 1:
            self.bits, self.table = 0, [used[0][1] << 4]
            return
        if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise Broken("a prefix code is not complete")
        self.bits = used[-1][0]
        table = [0] * (1 << self.bits)
        code, last = 0, used[0][0]
        for n, symbol in used:
            code <<= n - last
            last = n
            low = int(format(code, f"0{n}b")[::-1], 2)
            for k in range(low, len(table), 1 << n):
                table[k] = symbol << 4 | n
            code += 1
        self.table = table

    def read(self, bits: Bits) -> int:
        if bits.have < 15:
            bits.fill()
        entry = self.table[bits.held & ((1 << self.bits) - 1)]
        n = entry & 15
        bits.held >>= n
        bits.have -= n
        return entry >> 4


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths = {first: 1}
        if two:
            lengths[bits.read(8)] = 1
        if max(lengths) >= size:
            raise Broken("a symbol beyond its alphabet")
        return Code(lengths)
    meta = {}
    for k in range(4 + bits.read(4)):
        meta[_ORDER[k]] = bits.read(3)
    code = Code(meta)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, at, before = {}, 0, 8
    while at < size and left > 0:
        left -= 1
        x = code.read(bits)
        if x < 16:
            lengths[at] = x
            before = x or before
            at += 1
        else:
            times = 3 + bits.read(2) if x == 16 else 3 + bits.read(3) if x == 17 else 11 + bits.read(7)
            if at + times > size:
                raise Broken("a run of code lengths beyond its alphabet")
            if x == 16:
                lengths.update(dict.fromkeys(range(at, at + times), before))
            at += times
    return Code(lengths)


def _extent(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _part(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels (ARGB, uint32) of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Broken("a colour cache that is too large")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, group_of, n_groups = 0, None, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        group_of = ((_read_image(bits, _part(width, shift), _part(height, shift), False) >> 8) & 0xFFFF).tolist()
        n_groups = max(group_of) + 1
    sizes = (280 + len(cache), 256, 256, 256, 40)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(n_groups)]
    total = width * height
    # four bytes a pixel, however large the picture
    out = array("I", bytes(4 * total))
    across = _part(width, shift)
    at = cached = run_end = 0
    down = 32 - cache_bits
    data, size, next_byte, held, have = bits.data, len(bits.data), bits.at, bits.held, bits.have
    group = None
    try:
        while at < total:
            if at >= run_end:
                # the codes stay the same to the end of a block's row
                if group_of is None:
                    run_end, now = total, groups[0]
                else:
                    y, x = divmod(at, width)
                    block = x >> shift
                    run_end, now = y * width + min(width, (block + 1) << shift), groups[group_of[(y >> shift) * across + block]]
                if now is not group:
                    group = now
                    (green, gm), (red, rm), (blue, bm), (alpha, am), (distance, dm) = ((c.table, len(c.table) - 1) for c in group)
            # a pixel takes 60 bits at most, a back-reference's symbols and extra bits too
            if have < 64:
                held |= int.from_bytes(data[next_byte : next_byte + 16], "little") << have
                next_byte += 16
                have += 128
                if next_byte > size + 32:
                    raise Broken("the data end early")
            e = green[held & gm]
            n = e & 15
            held >>= n
            have -= n
            s = e >> 4
            if s < 256:
                e = red[held & rm]
                n = e & 15
                held >>= n
                pixel = (e >> 4) << 16 | s << 8
                e = blue[held & bm]
                have -= n
                n = e & 15
                held >>= n
                pixel |= e >> 4
                e = alpha[held & am]
                have -= n
                n = e & 15
                held >>= n
                have -= n
                out[at] = pixel | (e >> 4) << 24
                at += 1
            elif s < 280:
                s -= 256
                if s < 4:
                    length = s + 1
                else:
                    n = (s - 2) >> 1
                    length = ((2 + (s & 1)) << n) + (held & ((1 << n) - 1)) + 1
                    held >>= n
                    have -= n
                e = distance[held & dm]
                n = e & 15
                held >>= n
                have -= n
                s = e >> 4
                if s < 4:
                    d = s + 1
                else:
                    n = (s - 2) >> 1
                    d = ((2 + (s & 1)) << n) + (held & ((1 << n) - 1)) + 1
                    held >>= n
                    have -= n
                if d > 120:
                    d -= 120
                else:
                    dx, dy = NEAR[d - 1]
                    d = max(1, dx + dy * width)
                if d > at or at + length > total:
                    raise Broken("a back-reference outside the picture")
                if d >= length:
                    out[at : at + length] = out[at - d : at - d + length]
                else:
                    out[at : at + length] = (out[at - d : at] * (length // d + 1))[:length]
                at += length
            else:
                for k in range(cached, at):
                    cache[(_HASH * out[k] & 0xFFFFFFFF) >> down] = out[k]
                cached = at
                if s - 280 >= len(cache):
                    raise Broken("a colour outside the cache")
                out[at] = cache[s - 280]
                at += 1
    finally:
        bits.at, bits.held, bits.have = next_byte, held, have
    if 8 * next_byte - have > 8 * size + 64:
        raise Broken("the data end early")
    return np.frombuffer(out, np.uint32)


def _average(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _channels(a: int) -> tuple[int, int, int, int]:
    return a >> 24, a >> 16 & 255, a >> 8 & 255, a & 255


def _select(left: int, top: int, corner: int) -> int:
    c = _channels(corner)
    to_left = sum(abs(t - z) for t, z in zip(_channels(top), c))
    to_top = sum(abs(x - z) for x, z in zip(_channels(left), c))
    return left if to_left < to_top else top


def _packed(values) -> int:
    out = 0
    for x in values:
        out = out << 8 | (0 if x < 0 else 255 if x > 255 else x)
    return out


def _half(a: int, b: int) -> int:
    # the difference is halved towards zero
    return _packed(x + (abs(x - y) // 2 if x > y else -(abs(x - y) // 2)) for x, y in zip(_channels(a), _channels(b)))


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The predicted pixel; right is the pixel above and to the right."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _packed(x + y - z for x, y, z in zip(_channels(left), _channels(top), _channels(corner)))
        case 13:
            return _half(_average(left, top), corner)
    return _OPAQUE


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _neighbours(pixels: list[int], at: int, width: int, mode: int) -> int:
    """The prediction for pixel `at` from the ones before it."""
    y, x = divmod(at, width)
    if not at:
        return _OPAQUE
    if not y:
        return pixels[at - 1]
    if not x:
        return pixels[at - width]
    # above and to the right of the last pixel of a row lies the first of the same row
    return predict(mode, pixels[at - 1], pixels[at - width], pixels[at - width - 1], pixels[at - width + 1])


def _undo_predictor(image: np.ndarray, width: int, height: int, shift: int, data: np.ndarray) -> np.ndarray:
    """By slanted fronts x + 2 y = t, whose pixels depend on earlier fronts only; where fronts are short, pixel by pixel."""
    if min(width // 2, height) < FRONT:
        modes = ((data >> 8) & 15).tolist()
        out, across = image.tolist(), _part(width, shift)
        for at in range(width * height):
            y, x = divmod(at, width)
            out[at] = _add(out[at], _neighbours(out, at, width, modes[(y >> shift) * across + (x >> shift)]))
        return np.array(out, np.uint32)
    mode = _spread((data >> 8) & 15, width, height, shift).astype(np.uint8).reshape(height, width)
    mode[0], mode[1:, 0], mode[0, 0] = 1, 2, 0
    mode = mode.ravel()
    out = image.astype("<u4").view(np.uint8).reshape(-1, 4)
    opaque = np.array([0, 0, 0, 255], np.int16)
    for t in range(width + 2 * height - 2):
        y = np.arange(max(0, -((width - 1 - t) // 2)), min(height - 1, t // 2) + 1)
        at = y * width + t - 2 * y
        own = mode[at]
        for k in np.flatnonzero(np.bincount(own, minlength=16)).tolist():
            here = at[own == k]
            part = lambda back: out[here - back].astype(np.int16)
            out[here] = (out[here] + (opaque if k in (0, 14, 15) else _predicted(k, part, width))).astype(np.uint8)
    return out.view("<u4").ravel().astype(np.uint32)


def _predicted(mode: int, part, width: int) -> np.ndarray:
    """predict() for the channels (n, 4) of many pixels; part(back) has the pixels so many places before them."""
    left, top, corner, right = 1, width, width + 1, width - 1
    if mode in (1, 2, 3, 4):
        return part((left, top, right, corner)[mode - 1])
    if mode == 5:
        return (((part(left) + part(right)) >> 1) + part(top)) >> 1
    if mode in (6, 7, 8, 9):
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return (part(a) + part(b)) >> 1
    if mode == 10:
        return (((part(left) + part(corner)) >> 1) + ((part(top) + part(right)) >> 1)) >> 1
    x, y, z = part(left), part(top), part(corner)
    if mode == 11:
        nearer = np.abs(y - z).sum(axis=1) < np.abs(x - z).sum(axis=1)
        return np.where(nearer[:, None], x, y)
    if mode == 12:
        return np.clip(x + y - z, 0, 255)
    mean = (x + y) >> 1
    gap = mean - z
    return np.clip(mean + np.sign(gap) * (np.abs(gap) >> 1), 0, 255)


def _spread(data: np.ndarray, width: int, height: int, shift: int) -> np.ndarray:
    """Each pixel's element of a block image."""
    grid = data.reshape(-1, _part(width, shift))
    return grid[(np.arange(height) >> shift)[:, None], (np.arange(width) >> shift)[None, :]].ravel()


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5


def _cross(image: np.ndarray, element: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (sign -1) what green says about red, and green and red about blue."""
    red, green, blue = (image >> 16) & 255, (image >> 8) & 255, image & 255
    new_red = (red.astype(np.int32) + sign * _delta(element & 255, green)) & 255
    real_red = new_red if sign > 0 else red
    new_blue = (blue.astype(np.int32) + sign * (_delta((element >> 8) & 255, green) + _delta((element >> 16) & 255, real_red))) & 255
    return (image & np.uint32(0xFF00FF00)) | new_red.astype(np.uint32) << 16 | new_blue.astype(np.uint32)


def _green(image: np.ndarray, sign: int) -> np.ndarray:
    g = ((image >> 8) & 255).astype(np.int64)
    red, blue = (((image >> 16) & 255) + sign * g) & 255, ((image & 255) + sign * g) & 255
    return (image & np.uint32(0xFF00FF00)) | (red << 16 | blue).astype(np.uint32)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(image: np.ndarray, packed: int, width: int, height: int, table: np.ndarray) -> np.ndarray:
    bits = _bundle(len(table))
    index = ((image >> 8) & 255).reshape(height, packed)
    if bits:
        each = 8 >> bits
        x = np.arange(width)
        index = (index[:, x >> bits] >> ((x & ((1 << bits) - 1)) * each)) & ((1 << each) - 1)
    full = np.zeros(256, np.uint32)  # an index beyond the table is transparent black
    full[: len(table)] = table
    return full[index.ravel()]


def _sums(table: np.ndarray, axis: int = 0) -> np.ndarray:
    bytes_ = table.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.cumsum(bytes_, axis=axis, dtype=np.uint8).reshape(-1).view("<u4").astype(np.uint32)


def payload(data: bytes) -> bytes:
    """The VP8L chunk of a RIFF container."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("not a WebP container")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size]
        if kind in (b"VP8 ", b"ANIM", b"ANMF"):
            raise Unsupported(kind.decode().strip())
        at += 8 + size + (size & 1)
    raise Broken("no picture in the container")


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB pixels row by row) of a lossless WebP file."""
    body = payload(data)
    if len(body) < 5 or body[0] != 0x2F:
        raise Broken("no lossless signature")
    bits = Bits(body[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3):
        raise Broken("an unknown version")
    steps, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Broken("a transform twice")
        seen.add(kind)
        if kind < 2:
            shift = bits.read(3) + 2
            steps.append((kind, now, shift, _read_image(bits, _part(now, shift), _part(height, shift), False)))
        elif kind == 2:
            steps.append((kind, now, 0, None))
        else:
            size = bits.read(8) + 1
            table = _sums(_read_image(bits, size, 1, False))
            steps.append((kind, now, 0, table))
            now = _part(now, _bundle(size))
    image = _read_image(bits, now, height, True)
    for kind, wide, shift, extra in reversed(steps):
        if kind == 0:
            image = _undo_predictor(image, wide, height, shift, extra)
        elif kind == 1:
            image = _cross(image, _spread(extra, wide, height, shift), 1)
        elif kind == 2:
            image = _green(image, 1)
        else:
            image = _undo_palette(image, _part(wide, _bundle(len(extra))), wide, height, extra)
    return width, height, image if alpha else image | np.uint32(_OPAQUE)


class _Out:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        while self.n >= 8:
            self.done.append(self.value & 255)
            self.value >>= 8
            self.n -= 8

    def bytes(self) -> bytes:
        return bytes(self.done) + (bytes([self.value]) if self.n else b"")


def _lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Huffman code lengths of at most `most` bits; flatter counts are tried until they fit."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    floor = 1
    while True:
        heap = [(max(n, floor), s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        length = Counter()
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            length.update(a[2] + b[2])
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(length.values()) <= most:
            return dict(length)
        floor *= 2


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits as written, number of bits); nothing is written for a lone symbol."""
    used = sorted((n, s) for s, n in lengths.items() if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, used[0][0] if used else 0
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code += 1
    return out


def _write_code(out: _Out, counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    symbols = sorted(counts) or [0]
    if len(symbols) <= 2 and symbols[-1] < 256:
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        out.put(wide, 1)
        out.put(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
        return _codes(dict.fromkeys(symbols, 1))
    lengths = _lengths(counts, 15)
    out.put(0, 1)
    tokens, at, before = [], 0, 8
    while at < size:
        x = lengths.get(at, 0)
        run = 1
        while at + run < size and lengths.get(at + run, 0) == x:
            run += 1
        at += run
        while run:
            if not x and run >= 3:
                k = min(run, 138)
                tokens.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            elif x and x == before and run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
            else:
                k = 1
                tokens.append((x, 0, 0))
                before = x or before
            run -= k
    meta = _lengths(Counter(t[0] for t in tokens), 7)
    last = max(k for k, s in enumerate(_ORDER) if meta.get(s))
    n = max(4, last + 1)
    out.put(n - 4, 4)
    for s in _ORDER[:n]:
        out.put(meta.get(s, 0), 3)
    out.put(0, 1)
    codes = _codes(meta)
    for s, extra, bits in tokens:
        out.put(*codes[s])
        out.put(extra, bits)
    return _codes(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * extra + 2 + (value >> extra & 1), value & ((1 << extra) - 1), extra


def _write_image(out: _Out, pixels: list[int], width: int, main: bool, cache_bits: int = 0, shift: int = 0) -> None:
    """Writes an entropy-coded image; with a shift (main image only) every block row gets prefix codes of its own."""
    height = len(pixels) // width
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    n_groups = 1
    group_of = lambda at: 0
    if main:
        out.put(bool(shift), 1)
        if shift:
            out.put(shift - 2, 3)
            rows, across = _part(height, shift), _part(width, shift)
            n_groups = min(rows, 4)
            _write_image(out, [((k // across) % n_groups) << 8 for k in range(rows * across)], across, False)
            group_of = lambda at: (at // width >> shift) % n_groups
    near = {}
    for k, (x, y) in enumerate(NEAR):
        near.setdefault(max(1, x + y * width), k + 1)
    cache = [None] * (1 << cache_bits)
    seen: dict[tuple, int] = {}
    events, at = [], 0
    while at < len(pixels):
        key = tuple(pixels[at : at + 3])
        back, length = seen.get(key), 0
        if back is not None and len(key) == 3:
            while at + length < len(pixels) and length < 4096 and pixels[back + length] == pixels[at + length]:
                length += 1
        slot = (_HASH * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            d = at - back
            events.append((at, 256, length, near.get(d, d + 120)))
        elif cache_bits and cache[slot] == pixels[at]:
            events.append((at, 280 + slot, 0, 0))
            length = 1
        else:
            events.append((at, -1, 0, 0))
            length = 1
        for k in range(at, at + length):
            seen[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[(_HASH * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        at += length
    counts = [[Counter() for _ in range(5)] for _ in range(n_groups)]
    for at, kind, length, d in events:
        c = counts[group_of(at)]
        if kind < 0:
            a, r, g, b = _channels(pixels[at])
            for k, x in enumerate((g, r, b, a)):
                c[k][x] += 1
        elif kind == 256:
            c[0][256 + _prefix(length)[0]] += 1
            c[4][_prefix(d)[0]] += 1
        else:
            c[0][kind] += 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_write_code(out, c, n) for c, n in zip(group, sizes)] for group in counts]
    for at, kind, length, d in events:
        c = codes[group_of(at)]
        if kind < 0:
            a, r, g, b = _channels(pixels[at])
            for k, x in enumerate((g, r, b, a)):
                out.put(*c[k][x])
        elif kind == 256:
            for k, value, base in ((0, length, 256), (4, d, 0)):
                s, extra, n = _prefix(value)
                out.put(*c[k][base + s])
                out.put(extra, n)
        else:
            out.put(*c[0][kind])


def encode(width: int, height: int, pixels: list[int], transforms: str = "", cache_bits: int = 0, shift: int = 0, first_mode: int = 0) -> bytes:
    """A lossless WebP file of ARGB pixels.  transforms: any of p (predictor), c (cross-colour), g (subtract green), i (palette, at
    most 256 colours), in the order in which they are applied; cache_bits: colour cache; shift: blocks with prefix codes of their own;
    first_mode: the predictor of the first block, those of the others follow."""
    out = _Out()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(any(p >> 24 != 255 for p in pixels), 1)
    out.put(0, 3)
    now = width
    for t in transforms:
        out.put(1, 1)
        out.put("pcgi".index(t), 2)
        if t == "p":
            size, blocks = 2, _part(now, 2) * _part(height, 2)
            out.put(size - 2, 3)
            modes = [(first_mode + k) % 14 for k in range(blocks)]
            _write_image(out, [m << 8 | _OPAQUE for m in modes], _part(now, size), False)
            across, plain = _part(now, size), pixels
            pixels = [_minus(p, _neighbours(plain, k, now, modes[(k // now >> size) * across + (k % now >> size)])) for k, p in enumerate(plain)]
        elif t == "c":
            size, blocks = 3, _part(now, 3) * _part(height, 3)
            out.put(size - 2, 3)
            elements = [_OPAQUE | (k * 37 + 9 & 255) << 16 | (k * 91 + 200 & 255) << 8 | (k * 53 + 17 & 255) for k in range(blocks)]
            _write_image(out, elements, _part(now, size), False)
            pixels = _cross(np.array(pixels, np.uint32), _spread(np.array(elements, np.uint32), now, height, size), -1).tolist()
        elif t == "g":
            pixels = _green(np.array(pixels, np.uint32), -1).tolist()
        else:
            table = sorted(set(pixels))
            out.put(len(table) - 1, 8)
            steps = [_minus(c, d) for c, d in zip(table, [0, *table])]
            _write_image(out, steps, len(table), False)
            place = {c: k for k, c in enumerate(table)}
            bits = _bundle(len(table))
            wide, each = _part(now, bits), 8 >> bits
            packed = [0] * (wide * height)
            for k, p in enumerate(pixels):
                y, x = divmod(k, now)
                packed[y * wide + (x >> bits)] |= place[p] << (x & ((1 << bits) - 1)) * each
            pixels, now = [_OPAQUE | v << 8 for v in packed], wide
    out.put(0, 1)
    _write_image(out, pixels, now, True, cache_bits, shift)
    body = b"\x2f" + out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _minus(a: int, b: int) -> int:
    return ((a | 0x00FF00FF) - (b & 0xFF00FF00)) & 0xFF00FF00 | ((a | 0xFF00FF00) - (b & 0x00FF00FF)) & 0x00FF00FF


def _decode(batches):
    for batch in batches:
        status, width, height, pixels = [], [], [], []
        for value in batch.column(1):
            w = h = p = None
            data = value.as_py()
            if data is None:
                state = "null"
            else:
                try:
                    w, h, image = decode(data)
                    state, p = "ok", image.view(np.int32)
                except Unsupported:
                    state = "unsupported"
                except (Broken, IndexError, ValueError):
                    state = "invalid"
            status.append(state)
            width.append(w)
            height.append(h)
            pixels.append(p)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.string()), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(pixels, pa.list_(pa.int32()))], names=["id", "status", "width", "height", "pixels"])


def pixels(media: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, status, width, height, pixels): ARGB as signed integers, row by row."""
    rows = media.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast("binary").alias("media"))
    return rows.mapInArrow(_decode, "id bigint, status string, width int, height int, pixels array<int>")


#: The features of the streams that make_media() writes, by vec_id modulo their number.
VARIANTS = (("", 4, 0), ("pcg", 0, 0), ("i", 0, 0), ("p", 5, 2), ("i", 2, 2), ("cg", 3, 2), ("gp", 0, 0), ("ip", 0, 0))


def _paint(batches):
    """An 8 x 8 picture of each 64-dimensional vector."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        files = []
        for k, vector in zip(ids, batch.column(1).to_pylist()):
            if k is None or vector is None or len(vector) != 64 or None in vector:
                files.append(None)
                continue
            v = np.array(vector, np.float32).astype(float)
            transforms, cache, shift = VARIANTS[k % len(VARIANTS)]
            level = np.clip(np.floor(v * 64 + 128), 0, 255).astype(np.int64)
            if k % len(VARIANTS) == 4:  # two colours: eight pixels a byte
                level = np.where(level >= 128, 255, 0)
                argb = 255 << 24 | level << 16 | level << 8 | level
            else:
                argb = 255 << 24 | level << 16 | np.roll(level, -1) << 8 | np.roll(level, -7)
            files.append(encode(8, 8, argb.tolist(), transforms, cache, shift, k // len(VARIANTS) % 14))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["vec_id", "media"])


def make_media(embeddings: DataFrame) -> DataFrame:
    """(vec_id, media): every vector as a lossless WebP file, all features of the format in turn."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(_paint, "vec_id bigint, media binary")


#: What lossless decoding must give back, straight from the vectors.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 64 + 128)))::BIGINT) AS q FROM embeddings)
SELECT vec_id AS id, 'ok' AS status, 8::INTEGER AS width, 8::INTEGER AS height,
  list_transform(range(64), lambda i: (CASE WHEN vec_id % 8 = 4
    THEN (CASE WHEN q[i + 1] >= 128 THEN 16777215 ELSE 0 END)
    ELSE q[i + 1] * 65536 + q[(i + 1) % 64 + 1] * 256 + q[(i + 7) % 64 + 1] END - 16777216)::INTEGER) AS pixels
FROM v"""
