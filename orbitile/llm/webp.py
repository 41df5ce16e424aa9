"""Lossless WebP (VP8L): reading and writing pixel arrays.

``decode`` reads any VP8L stream: prefix codes (simple and normal, meta prefix
images), back-references with the short-distance map, the colour cache, and the
predictor, cross-colour, subtract-green and palette transforms. Where all symbols of a
code are equally long, literals up to the next back-reference are read by numpy at once;
other streams are read pixel by pixel.

``encode`` writes a palette transform (with bundled pixels) where an image has up to 256
colours, prefix codes of the symbols that occur, and back-references for long runs. The
codes are of equal length within a channel, so a text of up to 64 different bytes takes
six bits a byte, and both ways stay array work.

Pixels are ``uint8`` arrays (height, width, 4) in the order alpha, red, green, blue.
"""

from __future__ import annotations

import struct

import numpy as np

MAX_SIDE = 16384
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
ALPHABET = (256 + 24, 256, 256, 256, 40)
#: Order in which the lengths of the code length code are stored (fixed values).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)


def _short_distances() -> list[tuple[int, int]]:
    """(dx, dy) of the distance codes 1 to 120: by Euclidean distance, then |dx|, then dx > 0 first."""
    spots = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0]
    spots.sort(key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
    return spots


SHORT = _short_distances()
REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)


class BitReader:
    """Bits of a stream, least significant first; ``at`` is the next bit."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first, self.at = self.at, self.at + n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return int.from_bytes(self.data[first >> 3 : (self.at + 7) >> 3], "little") >> (first & 7) & ((1 << n) - 1)

    def array(self, n: int) -> np.ndarray:
        """The next n bits as 0 and 1, without moving on; fewer where the stream ends."""
        raw = np.frombuffer(self.data, np.uint8, offset=self.at >> 3, count=min((self.at + n + 7 >> 3), len(self.data)) - (self.at >> 3))
        return np.unpackbits(raw, bitorder="little")[self.at & 7 :][:n]


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


class PrefixCode:
    """Canonical prefix code from code lengths; one used symbol takes no bits."""

    def __init__(self, lengths):
        self.lengths = np.asarray(lengths)
        self.used = np.flatnonzero(self.lengths)
        self.single = int(self.used[0]) if len(self.used) == 1 else (0 if len(self.used) == 0 else None)
        self.table: dict[tuple[int, int], int] | None = None
        if self.single is None and (1 << 15 >> self.lengths[self.used].astype(np.int64)).sum() != 1 << 15:
            raise ValueError("code lengths do not fill the code")

    def even(self) -> int | None:
        """Bits of every symbol if all have the same, else None."""
        if self.single is not None:
            return 0
        n = int(self.lengths[self.used[0]])
        return n if (self.lengths[self.used] == n).all() else None

    def read(self, bits: BitReader) -> int:
        if self.single is not None:
            return self.single
        if self.table is None:
            self.table, code, last = {}, 0, 0
            for n, s in sorted((int(self.lengths[s]), int(s)) for s in self.used):
                code <<= n - last
                self.table[(n, code)] = s
                code, last = code + 1, n
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.read(1)
            s = self.table.get((n, code))
            if s is not None:
                return s
        raise ValueError("no such code")


def read_code(bits: BitReader, size: int) -> PrefixCode:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        lengths = [0] * size
        for s in symbols:
            lengths[s] = 1
        return PrefixCode(lengths)
    meta = [0] * 19
    for i in range(4 + bits.read(4)):
        meta[LENGTH_ORDER[i]] = bits.read(3)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    code, lengths, last = PrefixCode(meta), [], 8
    if code.even() == 1 and max(code.used) < 16:  # a bit for each length
        of_bit = code.used[bits.array(min(left, size))]
        bits.at += len(of_bit)
        return PrefixCode(np.concatenate([of_bit, np.zeros(size - len(of_bit), np.int64)]))
    while len(lengths) < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    return PrefixCode(lengths + [0] * (size - len(lengths)))


def read_extra(bits: BitReader, prefix: int) -> int:
    """Length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as flat ARGB integers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_of, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        down = (height + (1 << block) - 1) >> block
        groups_of = (read_image(bits, across, down, False) >> 8) & 0xFFFF
    groups = []
    for _ in range(1 if groups_of is None else int(groups_of.max()) + 1):
        groups.append([read_code(bits, ALPHABET[k] + ((1 << cache_bits) if k == GREEN and cache_bits else 0)) for k in range(5)])
    n = width * height
    if groups_of is None and not cache_bits and all(c.even() is not None for c in groups[0][:4]):
        return read_even(bits, groups[0], width, n)
    out = [0] * n
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift, i = 32 - cache_bits, 0
    codes = groups[0]
    while i < n:
        if groups_of is not None:
            codes = groups[int(groups_of[(i // width >> block) * across + (i % width >> block)])]
        s = codes[GREEN].read(bits)
        if s < 256:
            red, blue, alpha = codes[RED].read(bits), codes[BLUE].read(bits), codes[ALPHA].read(bits)
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            fresh = range(i, i + 1)
        elif s < 280:
            length, far = read_reference(bits, codes, s, width)
            if far > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(i, i + length):
                out[k] = out[k - far]
            fresh = range(i, i + length)
        else:
            if cache is None:
                raise ValueError("no colour cache")
            out[i] = cache[s - 280]
            fresh = range(i, i + 1)
        if cache is not None:
            for k in fresh:
                cache[(0x1E35A7BD * out[k] & 0xFFFFFFFF) >> shift] = out[k]
        i = fresh.stop
    return np.array(out, np.int64)


def read_even(bits: BitReader, codes: list[PrefixCode], width: int, n: int) -> np.ndarray:
    """Pixels of a stream whose codes are even: runs of literals as arrays, back-references one by one."""
    sizes = [c.even() for c in codes[:4]]
    whole, out, i, chunk = sum(sizes), np.zeros(n, np.int64), 0, 1 << 12
    while i < n:
        take = min(n - i, chunk)
        if whole:
            raw = bits.array(take * whole)
            raw = raw[: len(raw) // whole * whole].reshape(-1, whole)
            if len(raw) == 0:
                return _copied(bits, codes, width, out, i)
        else:
            raw = np.zeros((take, 0), np.uint8)
        channels, at = [], 0
        for code, size in zip(codes, sizes, strict=False):
            value = np.zeros(len(raw), np.int64)
            for k in range(at, at + size):
                value = value << 1 | raw[:, k]
            channels.append(code.used[value] if size else np.full(len(raw), code.single))
            at += size
        green, red, blue, alpha = channels
        odd = green >= 256
        literal = int(odd.argmax()) if odd.any() else len(raw)
        part = slice(0, literal)
        out[i : i + literal] = alpha[part] << 24 | red[part] << 16 | green[part] << 8 | blue[part]
        bits.at += literal * whole
        i += literal
        chunk = min(2 * chunk, 1 << 20) if literal == len(raw) else 1 << 12
        if literal < len(raw):
            i = _copy(bits, codes, width, out, i)
    return out


def _copied(bits: BitReader, codes, width: int, out: np.ndarray, i: int) -> np.ndarray:
    """The rest of an image that ends in back-references shorter than a literal."""
    while i < len(out):
        i = _copy(bits, codes, width, out, i)
    return out


def _copy(bits: BitReader, codes, width: int, out: np.ndarray, i: int) -> int:
    """One back-reference read and carried out; returns the place after it."""
    s = codes[GREEN].read(bits)
    if s < 256:
        raise ValueError("the stream ends early")
    length, far = read_reference(bits, codes, s, width)
    if far > i or i + length > len(out):
        raise ValueError("a back-reference leaves the image")
    out[i : i + length] = np.resize(out[i - far : i], length)  # a copy of itself, as often as it takes
    return i + length


def read_reference(bits: BitReader, codes, symbol: int, width: int) -> tuple[int, int]:
    """Length and distance in pixels of a back-reference."""
    length = read_extra(bits, symbol - 256)
    far = read_extra(bits, codes[DISTANCE].read(bits))
    if far <= 120:
        dx, dy = SHORT[far - 1]
        return length, max(dx + dy * width, 1)
    return length, far - 120


def _average(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(parts) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predict(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    """One of the fourteen predictors of the format."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    sides = list(zip(_parts(left), _parts(top), _parts(top_left), strict=True))
    if mode == 11:
        toward_left = sum(abs(t - c) for _, t, c in sides)
        toward_top = sum(abs(x - c) for x, _, c in sides)
        return left if toward_left < toward_top else top
    if mode == 12:
        return _join(_clamp(x + t - c) for x, t, c in sides)
    if mode == 13:
        return _join(_clamp(m + int((m - c) / 2)) for m, c in ((((x + t) >> 1), c) for x, t, c in sides))
    return 0xFF000000


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def invert_predictor(pixels: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    out, across = pixels.tolist(), (width + (1 << block) - 1) >> block
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if y == 0:
                p = 0xFF000000 if x == 0 else out[i - 1]
            elif x == 0:
                p = out[i - width]
            else:
                mode = int(modes[(y >> block) * across + (x >> block)]) >> 8 & 15
                p = predict(mode, out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
            out[i] = _add(out[i], p)
    return np.array(out, np.int64)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).astype(np.int8).astype(np.int64)


def invert_cross_color(pixels: np.ndarray, width: int, height: int, block: int, elements: np.ndarray) -> np.ndarray:
    across = (width + (1 << block) - 1) >> block
    y, x = np.divmod(np.arange(width * height), width)
    e = elements[(y >> block) * across + (x >> block)]
    green = _signed(pixels >> 8 & 255)
    red = (pixels >> 16 & 255) + (_signed(e & 255) * green >> 5) & 255
    blue = (pixels & 255) + (_signed(e >> 8 & 255) * green >> 5) + (_signed(e >> 16 & 255) * _signed(red) >> 5) & 255
    return pixels & 0xFF00FF00 | red << 16 | blue


def invert_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & 0xFF00FF00 | ((pixels >> 16 & 255) + green & 255) << 16 | (pixels & 255) + green & 255


def invert_palette(pixels: np.ndarray, width: int, height: int, colors: np.ndarray) -> np.ndarray:
    bundle = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1 if len(colors) <= 16 else 0
    packed = (width + (1 << bundle) - 1) >> bundle
    y, x = np.divmod(np.arange(width * height), width)
    depth = 8 >> bundle
    index = (pixels[y * packed + (x >> bundle)] >> 8 & 255) >> ((x & ((1 << bundle) - 1)) * depth) & ((1 << depth) - 1)
    return np.where(index < len(colors), np.append(colors, 0)[np.minimum(index, len(colors))], 0)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of a lossless WebP file; ValueError if it is damaged."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    end = 20 + struct.unpack_from("<I", data, 16)[0]
    if len(data) < end:
        raise ValueError("the file ends early")
    bits = BitReader(data[21:end])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            block = bits.read(3) + 2
            own = read_image(bits, (now + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            undo.append((kind, now, block, own))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, now, 0, None))
        else:
            n = bits.read(8) + 1
            steps = read_image(bits, n, 1, False)
            colors = [0]
            for s in steps.tolist():
                colors.append(_add(colors[-1], s))
            undo.append((kind, now, 0, np.array(colors[1:], np.int64)))
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            now = (now + (1 << bundle) - 1) >> bundle
    pixels = read_image(bits, now, height, True)
    for kind, w, block, own in reversed(undo):
        if kind == PREDICTOR:
            pixels = invert_predictor(pixels, w, height, block, own)
        elif kind == CROSS_COLOR:
            pixels = invert_cross_color(pixels, w, height, block, own)
        elif kind == SUBTRACT_GREEN:
            pixels = invert_subtract_green(pixels)
        else:
            pixels = invert_palette(pixels, w, height, own)
    return pixels.astype(">u4").view(np.uint8).reshape(height, width, 4)


def write_code(bits: BitWriter, lengths) -> None:
    """Write code lengths: a two-symbol code length code where possible, else all 16."""
    lengths = list(lengths)
    bits.write(0, 1)
    kinds = sorted(set(lengths))
    if len(kinds) == 1:
        kinds = sorted({0, *kinds})
    depth = max(1, (len(kinds) - 1).bit_length())
    short = (1 << depth) - len(kinds)  # so many symbols get one bit less
    meta = {k: depth - 1 if i < short else depth for i, k in enumerate(kinds)}
    last = max(LENGTH_ORDER.index(k) for k in kinds)
    bits.write(max(last + 1, 4) - 4, 4)
    for i in range(max(last + 1, 4)):
        bits.write(meta.get(LENGTH_ORDER[i], 0), 3)
    bits.write(0, 1)
    code = code_words([meta.get(k, 0) for k in range(19)])
    for n in lengths:
        bits.write(*code[n])


def code_words(lengths) -> dict[int, tuple[int, int]]:
    """Symbol to (bits in stream order, how many) of the canonical code."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in sorted((lengths[s], s) for s in used):
        code <<= n - last
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


def header(width: int, height: int) -> BitWriter:
    bits = BitWriter()
    bits.write(width - 1, 14)
    bits.write(height - 1, 14)
    bits.write(1, 1)
    bits.write(0, 3)
    return bits


def wrap(body: bytes) -> bytes:
    chunk = b"\x2f" + body
    padded = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", len(padded) + 12) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + padded


def extra_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol of a length or distance, and its extra bits: value and how many."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    half = v >> (high - 1) & 1
    return 2 * high + half, v & ((1 << (high - 1)) - 1), high - 1


#: Shortest run that becomes a back-reference, and the longest length of one.
LEAST_RUN, MOST_COPY = 64, 4096


def runs_of(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of at least LEAST_RUN equal pixels."""
    edge = np.flatnonzero(np.concatenate([[True], pixels[1:] != pixels[:-1], [True]]))
    size = np.diff(edge)
    long = size >= LEAST_RUN
    return edge[:-1][long], size[long]


def even_code(bits: BitWriter, symbols: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Writes a code of equal lengths for ``symbols``, unused ones filling it up; returns its symbols and their bits."""
    if len(symbols) == 1 and symbols[0] < 256:
        small = symbols[0] < 2
        bits.write(1, 1)  # a simple code of one symbol
        bits.write(0, 1)
        bits.write(0 if small else 1, 1)
        bits.write(int(symbols[0]), 1 if small else 8)
        return symbols, 0
    depth = max(1, int(len(symbols) - 1).bit_length())
    taken = np.zeros(size, bool)
    taken[symbols] = True
    taken[np.flatnonzero(~taken)[: (1 << depth) - len(symbols)]] = True
    bits.write(0, 1)
    # two code lengths occur, 0 and the depth, with a bit each
    last = max(LENGTH_ORDER.index(0), LENGTH_ORDER.index(depth))
    bits.write(last + 1 - 4, 4)
    for k in LENGTH_ORDER[: last + 1]:
        bits.write(1 if k in (0, depth) else 0, 3)
    upto = int(np.flatnonzero(taken)[-1]) + 1
    if upto < size and upto >= 2:
        wide = max(0, (max(upto - 2, 1).bit_length() + 1) // 2 - 1)
        bits.write(1, 1)
        bits.write(wide, 3)
        bits.write(upto - 2, 2 + 2 * wide)
    else:
        bits.write(0, 1)
        upto = size
    packed = np.packbits(taken[:upto], bitorder="little").tobytes()
    bits.write(int.from_bytes(packed, "little"), upto)
    return np.flatnonzero(taken), depth


def write_image(bits: BitWriter, pixels: np.ndarray, main: bool) -> bytes:
    """Writes an image of flat ARGB pixels: codes, literals and copies; what comes after is left to the caller."""
    start, size = runs_of(pixels)
    literal = np.ones(len(pixels), bool)
    copies: list[tuple[int, int]] = []
    for s, n in zip(start.tolist(), size.tolist(), strict=True):
        literal[s + 1 : s + n] = False
        copies += [(k, min(MOST_COPY, s + n - k)) for k in range(s + 1, s + n, MOST_COPY)]
    channels = [pixels >> shift & 255 for shift in (8, 16, 0, 24)]
    lengths = [extra_of(n) for _, n in copies]
    bits.write(0, 1)  # no colour cache
    if main:
        bits.write(0, 1)  # one group of codes
    codes = []
    for k, values in enumerate(channels):
        symbols = np.flatnonzero(np.bincount(values[literal], minlength=256))
        if k == GREEN:
            symbols = np.concatenate([symbols, np.unique([256 + p for p, _, _ in lengths]).astype(np.int64)])
        codes.append(even_code(bits, symbols, ALPHABET[k]))
    even_code(bits, np.array([1]), ALPHABET[DISTANCE])  # distance code 2, the pixel before
    columns = []
    for values, (symbols, depth) in zip(channels, codes, strict=True):
        place = np.zeros(256, np.int64)
        place[symbols[symbols < 256]] = np.flatnonzero(symbols < 256)
        value = place[values]
        columns += [(value >> (depth - 1 - k) & 1).astype(np.uint8) for k in range(depth)]
    table = np.stack(columns, axis=1) if columns else np.zeros((len(pixels), 0), np.uint8)
    parts, at = [], 0
    symbols, depth = codes[GREEN]
    for (k, n), (prefix, extra, width) in zip(copies, lengths, strict=True):
        parts.append(table[at:k][literal[at:k]].ravel())
        code = int(np.searchsorted(symbols, 256 + prefix))
        tail = [code >> (depth - 1 - b) & 1 for b in range(depth)] + [extra >> b & 1 for b in range(width)]
        parts.append(np.array(tail, np.uint8))
        at = k + n
    parts.append(table[at:][literal[at:]].ravel())
    flat = np.concatenate(parts)
    # the head is an integer of few bits, the pixels an array of many
    head = np.frombuffer(bits.value.to_bytes(bits.n // 8 + 1, "little"), np.uint8)
    return np.packbits(np.concatenate([np.unpackbits(head, bitorder="little")[: bits.n], flat]), bitorder="little").tobytes()


def encode(pixels: np.ndarray) -> bytes:
    """Lossless WebP file of pixels (height, width, 4)."""
    height, width, _ = pixels.shape
    if not 1 <= height <= MAX_SIDE or not 1 <= width <= MAX_SIDE:
        raise ValueError("an image side has 1 to 16384 pixels")
    argb = np.ascontiguousarray(pixels).view(">u4").astype(np.int64).ravel()
    colors, index = np.unique(argb, return_inverse=True)
    return _encoded(argb, colors, index, height, width)


def encode_samples(samples: np.ndarray) -> bytes:
    """Lossless WebP file of 8-bit samples (height, width), held in the green channel."""
    height, width = samples.shape
    if not 1 <= height <= MAX_SIDE or not 1 <= width <= MAX_SIDE:
        raise ValueError("an image side has 1 to 16384 pixels")
    values = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    place = np.zeros(256, np.int64)
    place[values] = np.arange(len(values))
    return _encoded(None, 0xFF000000 | values << 8, place[samples.ravel()], height, width)


def _encoded(argb, colors: np.ndarray, index: np.ndarray, height: int, width: int) -> bytes:
    bits = header(width, height)
    if len(colors) > 256:
        bits.write(0, 1)  # no transform
        return wrap(write_image(bits, argb, True))
    bits.write(1, 1)
    bits.write(PALETTE, 2)
    bits.write(len(colors) - 1, 8)
    _write_palette(bits, colors)
    bits.write(0, 1)  # no further transform
    bundle = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1 if len(colors) <= 16 else 0
    across, depth = 1 << bundle, 8 >> bundle
    packed = index.reshape(height, width)
    if bundle:
        wide = -(-width // across) * across
        full = np.zeros((height, wide), np.int64)
        full[:, :width] = packed
        packed = sum(full[:, k::across] << (k * depth) for k in range(across))
    return wrap(write_image(bits, 0xFF000000 | packed.ravel().astype(np.int64) << 8, True))


def _write_palette(bits: BitWriter, colors: np.ndarray) -> None:
    """The colours as an image of one row: differences to the colour before, channel by channel, all literals."""
    before = np.concatenate([[0], colors[:-1]])
    channels = [(colors >> s) - (before >> s) & 255 for s in (8, 16, 0, 24)]
    bits.write(0, 1)  # no colour cache
    codes = [even_code(bits, np.unique(c), ALPHABET[k]) for k, c in enumerate(channels)]
    even_code(bits, np.array([0]), ALPHABET[DISTANCE])
    columns = []
    for values, (symbols, depth) in zip(channels, codes, strict=True):
        value = np.searchsorted(symbols, values)
        columns += [(value >> (depth - 1 - k) & 1).astype(np.uint8) for k in range(depth)]
    if columns:
        flat = np.stack(columns, axis=1).ravel()
        bits.write(int.from_bytes(np.packbits(flat, bitorder="little").tobytes(), "little"), len(flat))
