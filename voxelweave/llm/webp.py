"""Media columns: lossless WebP images, decoded in full (prefix codes, back-references, colour cache, transforms)."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Sequence
from functools import lru_cache
from itertools import groupby

import numpy as np

#: Fixed values of the format: the order of code-length code lengths, the alphabets' sizes, the least runs and extra bits of
#: repeated code lengths, the near distances' offsets.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
REPEATS = ((3, 2), (3, 3), (11, 7))
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
BLACK = 0xFF000000


# ------------------------------------------------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, most: int = 12) -> np.ndarray:
    """Huffman code lengths of the counts, none above `most`; one symbol alone gets length 1, none get 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    c = counts[used].astype(np.int64)
    while True:
        heap = list(zip(c.tolist(), range(len(used))))
        heapq.heapify(heap)
        up, at = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i] = up[j] = at
            heapq.heapreplace(heap, (a + b, at))
            at += 1
        depth = [0] * at
        for i in range(at - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(used)]) <= most:
            out[used] = depth[: len(used)]
            return out
        c = (c + 1) // 2


#: Every 16-bit number with its bits in reverse.
FLIPPED = sum((np.arange(1 << 16) >> b & 1) << (15 - b) for b in range(16))


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the lengths, their bits reversed, as they go into a stream that starts at the low bits."""
    n = lengths.tolist()
    out, code, last = [0] * len(n), 0, 0
    used = [s for s, k in enumerate(n) if k]
    if len(used) > 1:  # a symbol alone has code 0
        for s in sorted(used, key=n.__getitem__):
            code <<= n[s] - last
            last = n[s]
            out[s] = code << (16 - last)
            code += 1
    return FLIPPED[out]


@lru_cache(maxsize=16)
def _flipped(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse."""
    return FLIPPED[: 1 << bits] >> (16 - bits)


class Table:
    """Decodes a prefix code by its next `bits` bits: symbol and length of each."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        self.bits, self._lists = 0, None
        if len(used) <= 1:
            self.symbol, self.length = np.array([used[0] if len(used) else 0]), np.zeros(1, np.int64)
            return
        n = lengths[used]
        self.bits = top = int(n.max())
        # canonical codes, left-aligned, count up by length and symbol: each takes 2^(top - length) places in a row
        order = np.argsort(n, kind="stable")
        n = n[order]
        places = 1 << (top - n)
        if int(places.sum()) != 1 << top:
            raise ValueError("not a complete prefix code")
        both = np.repeat(used[order] << 4 | n, places)[_flipped(top)]
        self.symbol, self.length = both >> 4, both & 15

    def lists(self) -> tuple[list[int], list[int]]:
        """symbol and length, for those who look up one at a time."""
        if self._lists is None:
            self._lists = self.symbol.tolist(), self.length.tolist()
        return self._lists


class Bits:
    """A bit stream read from the low bits of each byte on."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        lo, self.at = self.at, self.at + n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        part = self.data[lo >> 3 : (lo + n + 7) >> 3]
        return int.from_bytes(part, "little") >> (lo & 7) & (1 << n) - 1

    def symbol(self, t: Table) -> int:
        if not t.bits:
            return int(t.symbol[0])
        lo, (symbol, length) = self.at, t.lists()
        k = int.from_bytes(self.data[lo >> 3 : (lo >> 3) + 3], "little") >> (lo & 7) & (1 << t.bits) - 1
        self.at += length[k]
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return symbol[k]


class Writer:
    """Bits collected in pairs of value and length."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def pack(values: np.ndarray, lengths: np.ndarray, head: Writer) -> bytes:
    """head's bits and then the values' low bits, each of its length (22 at most), in a byte string."""
    ends = np.cumsum(lengths)
    total = head.n + (int(ends[-1]) if len(ends) else 0)
    words = np.zeros((total >> 6) + 2, np.uint64)
    if len(values):
        start = ends - lengths + head.n
        word, shift, v = start >> 6, (start & 63).astype(np.uint64), values.astype(np.uint64)
        # the bits that start in one word of 64 don't overlap; a word's last value may go on in the next one
        first = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
        words[word[first]] = np.bitwise_or.reduceat(v << shift, first)
        last = np.append(first[1:], len(v)) - 1
        words[word[last] + 1] |= v[last] >> np.uint64(1) >> (np.uint64(63) - shift[last])
    out = words.astype("<u8").view(np.uint8)[: (total + 7) // 8]
    front = np.frombuffer(head.bytes(), np.uint8)
    out[: len(front)] |= front
    return out.tobytes()


def _put_few(w: Writer, used: list[int]) -> None:
    """Writes a prefix code of one or two symbols below 256, or of none."""
    used = used or [0]
    w.put(1, 1)
    w.put(len(used) - 1, 1)
    w.put(int(used[0] > 1), 1)
    w.put(used[0], 8 if used[0] > 1 else 1)
    if len(used) == 2:
        w.put(used[1], 8)


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    """Writes a prefix code: as one or two symbols if it has no more, else by its lengths, runs of zeros shortened."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        return _put_few(w, used)
    tokens: list[tuple[int, int, int]] = []
    for v, same in groupby(lengths.tolist()):
        left = len(list(same))
        if v == 0:
            while left >= 3:
                k = min(left, 138)
                tokens.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                left -= k
        else:
            tokens.append((v, 0, 0))
            left -= 1
            while left >= 3:
                k = min(left, 6)
                tokens.append((16, k - 3, 2))
                left -= k
        tokens += [(v, 0, 0)] * left
    meta = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes, sizes = codes_of(meta).tolist(), meta.tolist()
    w.put(0, 1)
    w.put(15, 4)
    for s in LENGTH_ORDER:
        w.put(sizes[s], 3)
    w.put(0, 1)
    if np.count_nonzero(meta) == 1:  # a code alone takes no bits
        sizes = [0] * 19
    value = n = 0
    for s, extra, bits in tokens:
        value |= (codes[s] | extra << sizes[s]) << n
        n += sizes[s] + bits
    w.put(value, n)


def _get_code(b: Bits, size: int) -> np.ndarray:
    """The lengths of a prefix code of `size` symbols."""
    out = np.zeros(size, np.int64)
    if b.read(1):
        two = b.read(1)
        s = [b.read(8 if b.read(1) else 1)] + ([b.read(8)] if two else [])
        if max(s) >= size:
            raise ValueError("a symbol beyond the alphabet")
        out[s] = 1
        return out
    meta = np.zeros(19, np.int64)
    some = LENGTH_ORDER[: 4 + b.read(4)]
    each = b.read(3 * len(some))
    meta[list(some)] = [each >> 3 * k & 7 for k in range(len(some))]
    table = Table(meta)
    most = size if not b.read(1) else 2 + b.read(2 + 2 * b.read(3))
    symbol, length = table.lists()
    mask, i, last, got = (1 << table.bits) - 1, 0, 8, [0] * size
    # the bits to come as one number: a symbol takes 14 at most
    lo, at = b.at, 0
    v = int.from_bytes(b.data[lo >> 3 : (lo >> 3) + 2 * size + 2], "little") >> (lo & 7)
    while i < size and most > 0:
        most -= 1
        k = v & mask
        s, n = symbol[k], length[k]
        if s < 16:
            got[i] = s
            last = s or last
            i += 1
        else:
            least, bits = REPEATS[s - 16]
            run = least + (v >> n & (1 << bits) - 1)
            n += bits
            if i + run > size:
                raise ValueError("code lengths beyond the alphabet")
            if s == 16:
                got[i : i + run] = [last] * run
            i += run
        v >>= n
        at += n
    b.at = lo + at
    if b.at > 8 * len(b.data):
        raise ValueError("the stream ends early")
    return np.array(got, np.int64)


# ------------------------------------------------------------------------------------------------------- pixels


def _prefixed(s: int, b: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + b.read(extra) + 1


_SYMBOLS = np.arange(40)
#: Least value and extra bits of each prefix symbol of lengths and distances.
EXTRA_BITS = np.maximum(_SYMBOLS - 2, 0) >> 1
EXTRA_BASE = np.where(_SYMBOLS < 4, _SYMBOLS + 1, ((2 + (_SYMBOLS & 1)) << EXTRA_BITS) + 1)


@lru_cache(maxsize=64)
def _near_distances(width: int) -> np.ndarray:
    """The distance in scan order that each near distance code from 1 on stands for. Not to be written to."""
    return np.array([0, *[max(1, dx + dy * width) for dx, dy in NEAR]], np.int64)


@lru_cache(maxsize=64)
def _near_order(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The near distances in order, and their codes. Not to be written to."""
    near = _near_distances(width)
    order = np.argsort(near[1:], kind="stable") + 1
    return near[order], order


def _twice(step: np.ndarray, end: int) -> np.ndarray:
    """The bits that two steps in a row take, from each place before `end`; in blocks, so that indices take little."""
    out = step.copy()
    for lo in range(0, end, 1 << 18):
        hi = min(end, lo + (1 << 18))
        out[lo:hi] += step[np.arange(lo, hi) + step[lo:hi]]
    return out


def _greys(b: Bits, g: Table, dist: Table, n: int, width: int) -> np.ndarray:
    """n pixels of one varying channel that end the stream, in arrays: what a token that starts at any bit of the stream
    would take is found for all bits at once, then followed from token to token, and back-references are copied."""
    lo, skip = b.at >> 3, b.at & 7
    raw = np.frombuffer(b.data, np.uint8)[lo:]
    d = np.concatenate([raw, np.zeros(12, np.uint8)]).astype(np.uint32)
    w = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
    mask, end = np.uint32((1 << g.bits) - 1), 8 * len(raw)
    at_bit = lambda p: w[p >> 3] >> (p & 7).astype(np.uint32)
    # a token's bits, 15 at most, and 128 more for a reference; nothing moves beyond the end
    size = (g.length + 128 * (g.symbol >= 256)).astype(np.uint8)
    step = np.zeros(end + 256, np.uint8)
    for s in range(8):
        step[s:end:8] = size[w[: len(raw)] >> np.uint32(s) & mask]
    p = np.flatnonzero(step & 128)
    if len(p):
        k = at_bit(p) & mask
        long = g.length[k] + EXTRA_BITS[g.symbol[k] - 256]
        j = at_bit(p + long) & np.uint32((1 << dist.bits) - 1)
        step[p] = long + (dist.length + EXTRA_BITS[dist.symbol])[j]
    # no token has over 15 + 10 + 15 + 18 bits, so four at once stay below 256
    two = _twice(step, end)
    jump, p, at, left = _twice(two, end).tobytes(), skip, [], n
    add = at.append
    # every token is a pixel at least; those beyond the image are cut off below
    while p < end and left > 0:
        add(p)
        p += jump[p]
        left -= 4
    pos = np.empty((len(at), 4), np.int64)
    pos[:, 0] = at
    pos[:, 2] = pos[:, 0] + two[pos[:, 0]]
    pos[:, 1::2] = pos[:, ::2] + step[pos[:, ::2]]
    pos = pos.ravel()
    pos = pos[pos < end][:n]
    k = at_bit(pos) & mask
    sym = g.symbol[k]
    refs = np.flatnonzero(sym >= 256)
    counts = np.ones(len(sym), np.int64)
    if len(refs):
        which = sym[refs] - 256
        bits = EXTRA_BITS[which]
        q = pos[refs] + g.length[k[refs]]
        counts[refs] = EXTRA_BASE[which] + (at_bit(q) & (1 << bits).astype(np.uint32) - np.uint32(1))
    upto = np.cumsum(counts)
    last = int(np.searchsorted(upto, n))
    if last >= len(upto) or upto[last] != n:
        raise ValueError("the stream ends early, or a back-reference outside the image")
    b.at = (lo << 3) + int(pos[last]) + int(step[pos[last]])
    if b.at > 8 * len(b.data):
        raise ValueError("the stream ends early")
    refs = refs[refs <= last]
    if not len(refs):
        return sym[: last + 1]
    q = pos[refs] + g.length[k[refs]] + EXTRA_BITS[sym[refs] - 256]
    j = at_bit(q) & np.uint32((1 << dist.bits) - 1)
    which = dist.symbol[j]
    bits = EXTRA_BITS[which]
    far = EXTRA_BASE[which] + (at_bit(q + dist.length[j]) & (1 << bits).astype(np.uint32) - np.uint32(1))
    near = _near_distances(width)
    far = np.where(far < len(near), near[np.minimum(far, len(near) - 1)], far - len(NEAR))
    if (far > upto[refs] - counts[refs]).any():
        raise ValueError("a back-reference outside the image")
    plain = sym[: last + 1][sym[: last + 1] < 256].astype(np.uint8).tobytes()
    out, done = bytearray(), 0
    for i, (r, size, back) in enumerate(zip(refs.tolist(), counts[refs].tolist(), far.tolist(), strict=True)):
        out += plain[done : r - i]  # before token r there are i references, the rest are plain
        done = r - i
        start = len(out) - back
        out += out[start : start + size] if back >= size else (out[start:] * (size // back + 1))[:size]
    out += plain[done:]
    return np.frombuffer(bytes(out), np.uint8).astype(np.int64)


def _pixels(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The entropy-coded image at the stream's place, as width * height ARGB words."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    group, tile, across = None, 0, 0
    if main and b.read(1):
        tile = b.read(3) + 2
        across = -(-width >> tile)
        group = (_pixels(b, across, -(-height >> tile), False) >> 8) & 0xFFFF
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    groups = [[Table(_get_code(b, s)) for s in sizes] for _ in range(int(group.max()) + 1 if group is not None else 1)]
    n = width * height
    g, r, bl, a, _ = groups[0]
    if main and group is None and not cache_bits and not (r.bits or bl.bits or a.bits) and (g.bits or g.symbol[0] < 256):
        base = int(a.symbol[0]) << 24 | int(r.symbol[0]) << 16 | int(bl.symbol[0])
        green = _greys(b, g, groups[0][4], n, width) if g.bits else np.full(n, g.symbol[0])
        return green << 8 | base
    out = [0] * n
    cache, shift, stored, i = [0] * (1 << cache_bits), 32 - cache_bits, 0, 0
    while i < n:
        if group is not None:
            g, r, bl, a, dist = groups[group[(i // width >> tile) * across + (i % width >> tile)]]
        else:
            dist = groups[0][4]
        s = b.symbol(g)
        if s < 256:
            red, blue = b.symbol(r), b.symbol(bl)
            out[i] = b.symbol(a) << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 280:
            size = _prefixed(s - 256, b)
            far = _prefixed(b.symbol(dist), b)
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            if far > i or i + size > n:
                raise ValueError("a back-reference outside the image")
            for _ in range(size):
                out[i] = out[i - far]
                i += 1
        else:
            # the cache has every pixel so far
            while stored < i:
                cache[(out[stored] * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = out[stored]
                stored += 1
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.int64)


# ------------------------------------------------------------------------------------------------------- transforms


def _split(x: np.ndarray) -> np.ndarray:
    """Channels A, R, G, B of ARGB words, on a new last axis."""
    return np.stack([x >> 24 & 255, x >> 16 & 255, x >> 8 & 255, x & 255], axis=-1)


def _join(c: np.ndarray) -> np.ndarray:
    c = c & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, tr: np.ndarray, tl: np.ndarray) -> np.ndarray:
    """A pixel's channels from its neighbours', by the mode of its block."""
    half = lambda p, q: (p + q) >> 1
    if mode in (0, 14, 15):
        return _split(np.int64(BLACK))
    if mode == 5:
        return half(half(left, tr), top)
    if mode == 10:
        return half(half(left, tl), half(top, tr))
    if mode == 11:
        return left if np.abs(top - tl).sum() < np.abs(left - tl).sum() else top
    if mode == 12:
        return np.clip(left + top - tl, 0, 255)
    if mode == 13:
        m = half(left, top)
        d = m - tl
        return np.clip(m + np.sign(d) * (np.abs(d) >> 1), 0, 255)
    return {1: left, 2: top, 3: tr, 4: tl, 6: half(left, tl), 7: half(left, top), 8: half(tl, top), 9: half(top, tr)}[mode]


def _prediction(px: np.ndarray, flat: np.ndarray, i: int, y: int, x: int, modes: np.ndarray, bits: int) -> np.ndarray:
    width = px.shape[1]
    if y == 0:
        return _split(np.int64(BLACK)) if x == 0 else flat[i - 1]
    if x == 0:
        return flat[i - width]
    return _predict(int(modes[y >> bits, x >> bits]), flat[i - 1], flat[i - width], flat[i - width + 1], flat[i - width - 1])


def _unpredict(c: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Adds the predictions to residuals [H, W, 4], in scan order. The last column's top right is the next in memory."""
    px = c.copy()
    if (modes == 1).all() or (modes == 2).all():
        # one running sum along the first row or column, then one across: sums of bytes, taken modulo 256
        px[0, 0] += _split(np.int64(BLACK))
        first, across = (0, 1) if modes.flat[0] == 1 else (1, 0)
        edge = (slice(None), 0) if first == 0 else (0, slice(None))
        px[edge] = np.cumsum(px[edge], axis=0)
        return np.cumsum(px, axis=across) & 255
    flat, width = px.reshape(-1, 4), px.shape[1]
    for i in range(len(flat)):
        flat[i] = (flat[i] + _prediction(px, flat, i, i // width, i % width, modes, bits)) & 255
    return px


def _residuals(c: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    if (modes == 1).all() or (modes == 2).all():
        across = 1 if modes.flat[0] == 1 else 0
        out = np.diff(c, axis=across, prepend=0)
        edge = (slice(1, None), 0) if across == 1 else (0, slice(1, None))
        out[edge] = np.diff(c[:, 0] if across == 1 else c[0], axis=0)
        out[0, 0] = c[0, 0] - _split(np.int64(BLACK))
        return out & 255
    flat, width = c.reshape(-1, 4), c.shape[1]
    out = np.array([(flat[i] - _prediction(c, flat, i, i // width, i % width, modes, bits)) & 255 for i in range(len(flat))])
    return out.reshape(c.shape)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def _cross(c: np.ndarray, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what green says of red, and green and red of blue, by each block's factors."""
    h, w = c.shape[:2]
    f = _signed(factors[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits])
    to_red, to_blue, red_to_blue = f[..., 3], f[..., 2], f[..., 1]
    out = c.copy()
    green = _signed(c[..., 2])
    out[..., 1] = c[..., 1] + sign * (to_red * green >> 5) & 255
    red = _signed(out[..., 1] if sign > 0 else c[..., 1])
    out[..., 3] = c[..., 3] + sign * ((to_blue * green >> 5) + (red_to_blue * red >> 5)) & 255
    return out


def _bundle(size: int) -> int:
    """By how many halvings of its width an image of palette indices is bundled."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode_argb(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file as ARGB words [H, W] (int64)."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    b = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    full = width = b.read(14) + 1
    height = b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    todo: list[tuple] = []
    while b.read(1):
        kind = b.read(2)
        if kind in [t[0] for t in todo]:
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS):
            bits = b.read(3) + 2
            w, h = -(-width >> bits), -(-height >> bits)
            todo.append((kind, bits, _pixels(b, w, h, False).reshape(h, w), width))
        elif kind == GREEN:
            todo.append((kind, 0, None, width))
        else:
            n = b.read(8) + 1
            colours = np.cumsum(_split(_pixels(b, n, 1, False)), axis=0) & 255
            bits = _bundle(n)
            todo.append((kind, bits, colours, width))
            width = -(-width >> bits)
    x = _pixels(b, width, height, True).reshape(height, width)
    for kind, bits, what, wide in reversed(todo):
        if kind == PREDICTOR:
            x = _join(_unpredict(_split(x), what >> 8 & 15, bits))
        elif kind == CROSS:
            x = _join(_cross(_split(x), _split(what), bits, 1))
        elif kind == GREEN:
            c = _split(x)
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            x = _join(c)
        else:
            index = x >> 8 & 255
            if bits:
                per, each = 1 << bits, 8 >> bits
                index = (index[:, :, None] >> np.arange(per) * each & (1 << each) - 1).reshape(len(x), -1)[:, :wide]
            table = np.zeros(256, np.int64)
            table[: len(what)] = _join(what)
            x = table[index]
    return x.reshape(height, full)


# ------------------------------------------------------------------------------------------------------- encoder


#: The farthest distance that the format's 40 distance symbols name, less the near ones; the least length looked for.
FARTHEST, LEAST = (1 << 20) - 120, 8


def references(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of back-references in bytes g, from the first to the last, none overlapping.

    Every place's latest earlier place with the same 8 bytes is found by one sort; places in a row at one distance are
    one long reference. From the start on, the first that reaches 8 bytes beyond the last one is taken.
    """
    none = np.zeros(0, np.int64)
    if len(g) <= LEAST:
        return none, none, none
    # the 8 bytes from each place on as a number
    w = np.ndarray((len(g) - LEAST + 1,), np.uint64, g.tobytes(), 0, (1,)).copy()
    i = np.arange(len(w), dtype=np.uint64)
    # 40 bits of a hash and the place, at most 16000 rows of 576: equal windows in order of place
    placed = np.sort((w * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << 64) - (1 << 24)) | i)
    at = (placed & np.uint64((1 << 24) - 1)).astype(np.int64)
    same = np.flatnonzero(placed[1:] >> np.uint64(24) == placed[:-1] >> np.uint64(24))
    to, back = at[same + 1], at[same]
    ok = (w[to] == w[back]) & (to - back <= FARTHEST)
    # one zero more at both ends, so that every run is between two cuts
    far = np.zeros(len(w) + 2, np.int64)
    far[to[ok] + 1] = (to - back)[ok]
    cuts = np.flatnonzero(far[1:] != far[:-1])
    value = far[cuts[:-1] + 1] if len(cuts) else none
    runs = np.flatnonzero(value)
    starts, sizes, fars, p = [], [], [], 0
    for a, z, d in zip(cuts[runs].tolist(), (cuts[runs + 1] + LEAST - 1).tolist() if len(runs) else [], value[runs].tolist(), strict=True):
        if a < p:
            a = p
        n = z - a
        if n >= LEAST:
            p = z
            while n > 0:
                starts.append(a)
                sizes.append(min(n, 4096))
                fars.append(d)
                a += 4096
                n -= 4096
    return np.array(starts, np.int64), np.array(sizes, np.int64), np.array(fars, np.int64)


def _prefix_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of lengths or distance codes from 1 on."""
    symbol = np.searchsorted(EXTRA_BASE, v, side="right") - 1
    return symbol, v - EXTRA_BASE[symbol], EXTRA_BITS[symbol]


def _put_greys(w: Writer, flat: np.ndarray, width: int, main: bool, refs: bool) -> bytes:
    """Appends an image of one varying channel, in arrays; returns all bytes, and w is then spent."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    green = flat >> 8 & 255
    start, size, far = references(green.astype(np.uint8)) if refs else (np.zeros(0, np.int64),) * 3
    near, order = _near_order(width)
    hit = np.minimum(np.searchsorted(near, far), len(NEAR) - 1)
    code = np.where(near[hit] == far, order[hit], far + len(NEAR))
    (ls, le, lb), (ds, de, db) = _prefix_of(size), _prefix_of(code)
    inside = np.zeros(len(green) + 1, np.int64)
    inside[start] += 1  # no two start, and no two end, at one place
    inside[start + size] -= 1
    plain = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    lengths = code_lengths(np.bincount(green[plain], minlength=ALPHABETS[0]) + np.bincount(ls + 256, minlength=ALPHABETS[0]))
    apart = code_lengths(np.bincount(ds, minlength=ALPHABETS[4]))
    _put_code(w, lengths)
    for v in (int(flat[0]) >> 16 & 255, int(flat[0]) & 255, int(flat[0]) >> 24 & 255):
        _put_few(w, [v])
    _put_code(w, apart)
    # a code alone in its alphabet takes no bits
    lengths, apart = (np.where(np.count_nonzero(x) > 1, x, 0) for x in (lengths, apart))
    codes, dcodes = codes_of(lengths), codes_of(apart)
    # a plain pixel is one item, a reference four, in order of place
    item = 4 * np.arange(len(start)) + np.searchsorted(plain, start)
    ours = (item[:, None] + np.arange(4)).ravel()
    rest = np.ones(len(plain) + len(ours), bool)
    rest[ours] = False
    value, bits = np.empty((2, len(rest)), np.int64)
    value[rest], bits[rest] = codes[green[plain]], lengths[green[plain]]
    value[ours] = np.stack([codes[ls + 256], le, dcodes[ds], de], axis=1).ravel()
    bits[ours] = np.stack([lengths[ls + 256], lb, apart[ds], db], axis=1).ravel()
    return pack(value, bits, w)


def _put_pixels(w: Writer, x: np.ndarray, width: int, main: bool, cache_bits: int = 0, refs: bool = False, tile: int = 0) -> bytes | None:
    """Appends an entropy-coded image. Plain images of one varying channel are packed in arrays: their bytes are
    returned, and w is then spent. refs: back-references; tile: two groups of codes dealt by blocks."""
    flat = x.ravel().astype(np.int64)
    if main and not (cache_bits or tile) and not ((flat & 0xFFFF00FF) != (flat[0] & 0xFFFF00FF)).any():
        return _put_greys(w, flat, width, main, refs)
    px, n = flat.tolist(), len(flat)
    tokens: list[tuple] = []  # (place, green symbol, red, blue, alpha) or (place, symbol, extra, bits, distance symbol, extra, bits)
    cache, shift, i = {}, 32 - cache_bits, 0

    def prefix(v: int) -> tuple[int, int, int]:
        if v <= 4:
            return v - 1, 0, 0
        v -= 1
        top = v.bit_length() - 1
        return 2 * top + (v >> (top - 1) & 1), v & (1 << (top - 1)) - 1, top - 1

    seen: dict[tuple, int] = {}
    while i < n:
        run = far = 0
        if refs and i + 3 <= n and (j := seen.get(tuple(px[i : i + 3]))) is not None:
            far = i - j
            while i + run < n and px[i + run] == px[i + run - far] and run < 4096:
                run += 1
        if run >= 3:
            near = {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR)))}
            s, e, k = prefix(run)
            ds, de, dk = prefix(near.get(far, far + len(NEAR)))
            tokens.append((i, 256 + s, e, k, ds, de, dk))
        else:
            run = 1
            key = (px[i] * CACHE_FACTOR & 0xFFFFFFFF) >> shift if cache_bits else None
            if key is not None and cache.get(key) == px[i]:
                tokens.append((i, 280 + key))
            else:
                tokens.append((i, px[i] >> 8 & 255, px[i] >> 16 & 255, px[i] & 255, px[i] >> 24))
        for p in range(i, i + run):
            if cache_bits:
                cache[(px[p] * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = px[p]
            if p >= 2:
                seen[tuple(px[p - 2 : p + 1])] = p - 2
        i += run
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = 1
    of = lambda p: 0
    if main:
        w.put(int(tile > 0), 1)
        if tile:
            w.put(tile - 2, 3)
            across, down = -(-width >> tile), -(-(n // width) >> tile)
            groups = 2
            board = np.add.outer(np.arange(down), np.arange(across)) % 2
            if board.size == 1:
                groups = 1
            of = lambda p: int(board[p // width >> tile, p % width >> tile])
            _put_small(w, board << 8 | BLACK)
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(groups)]
    for t in tokens:
        c = counts[of(t[0])]
        c[0][t[1]] += 1
        if len(t) == 5:
            for k in (1, 2, 3):
                c[k][t[k + 1]] += 1
        elif len(t) == 7:
            c[4][t[4]] += 1
    lengths = [[code_lengths(c) for c in g] for g in counts]
    codes = [[codes_of(v) for v in g] for g in lengths]
    for g in lengths:
        for v in g:
            _put_code(w, v)

    def put(g: int, k: int, s: int) -> None:
        if np.count_nonzero(lengths[g][k]) > 1:
            w.put(int(codes[g][k][s]), int(lengths[g][k][s]))

    for t in tokens:
        g = of(t[0])
        put(g, 0, t[1])
        if len(t) == 5:
            for k in (1, 2, 3):
                put(g, k, t[k + 1])
        elif len(t) == 7:
            w.put(t[2], t[3])
            put(g, 4, t[4])
            w.put(t[5], t[6])
    return None


def _put_small(w: Writer, x: np.ndarray) -> None:
    """A sub-image of the stream: code tables, transform data or palette."""
    _put_pixels(w, x, x.shape[1], False, refs=True)


def encode_argb(x: np.ndarray, transforms: Sequence[int] = (), block: int = 2, modes: np.ndarray | None = None, factors: np.ndarray | None = None, cache_bits: int = 0, refs: bool = False, tile: int = 0) -> bytes:
    """ARGB words [H, W] as a lossless WebP file, with the transforms in the order given.

    modes: a predictor mode for each block of 2^block pixels a side; factors: cross-colour words, likewise.
    PALETTE needs 256 colours at most. Sides are 1 to 16384 pixels.
    """
    height, width = x.shape
    if not (1 <= height <= 16384 and 1 <= width <= 16384):
        raise ValueError("sides are 1 to 16384 pixels")
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int((x >> 24 != 255).any()), 1)
    w.put(0, 3)
    x = x.astype(np.int64)
    for t in transforms:
        w.put(1, 1)
        w.put(t, 2)
        h, wide = -(-x.shape[0] >> block), -(-x.shape[1] >> block)
        if t == PREDICTOR:
            m = np.resize(np.arange(14) if modes is None else modes, (h, wide))
            w.put(block - 2, 3)
            _put_small(w, m << 8 | BLACK)
            x = _join(_residuals(_split(x), m, block))
        elif t == CROSS:
            f = np.resize(np.array([0x10F8], np.int64) if factors is None else factors, (h, wide)) | BLACK
            w.put(block - 2, 3)
            _put_small(w, f)
            x = _join(_cross(_split(x), _split(f), block, -1))
        elif t == GREEN:
            c = _split(x)
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            x = _join(c)
        else:
            colours, index = np.unique(x, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("over 256 colours")
            w.put(len(colours) - 1, 8)
            c = _split(colours)
            _put_small(w, _join(np.diff(c, axis=0, prepend=0))[None, :])
            index, bits = index.reshape(x.shape), _bundle(len(colours))
            if bits:
                per, each = 1 << bits, 8 >> bits
                index = np.pad(index, ((0, 0), (0, -x.shape[1] % per))).reshape(len(x), -1, per)
                index = (index << np.arange(per) * each).sum(axis=2)
            x = index << 8 | BLACK
    w.put(0, 1)
    body = _put_pixels(w, x, x.shape[1], True, cache_bits, refs, tile)
    body = b"\x2f" + (w.bytes() if body is None else body)
    odd = b"\0" * (len(body) & 1)
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + odd
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# ------------------------------------------------------------------------------------------------------- bytes as media

SIDE = 576
MOST_ROWS = 16000


def _bits(counts: np.ndarray) -> float:
    """What symbols of these counts take by their entropy."""
    c = counts[counts > 0]
    return float((c * np.log2(c.sum() / c)).sum())


def _form(rows: np.ndarray) -> dict:
    """How an image of grey levels is stored: bundled by a palette where it has 16 levels or fewer, as differences to the
    left or upper pixel where these take fewer bits, else as it is; back-references in any case.

    One channel leaves nothing to the colour cache (a cached pixel's symbol says no less than its green), to subtracted
    green or to the cross-colour transform, so no grey image is smaller by them.
    """
    counts = np.bincount(rows.ravel(), minlength=256)
    if np.count_nonzero(counts) <= 16:
        return {"transforms": [PALETTE]}
    plain = _bits(counts)
    across, down = rows.copy(), rows.copy()
    across[:, 1:] -= rows[:, :-1]
    down[1:] -= rows[:-1]
    left, up = (_bits(np.bincount(d.ravel(), minlength=256)) for d in (across, down))
    if min(left, up) < 0.9 * plain:
        return {"transforms": [PREDICTOR], "modes": np.array([1 if left <= up else 2]), "block": 9}
    return {}


def store(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 576, as grey-level samples: lossless WebP files of 576 columns, end to end.

    A sample is the green channel of an opaque pixel. Each file holds at most 16000 rows, so memory is bounded.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    parts = (rows[a : a + MOST_ROWS] for a in range(0, len(rows), MOST_ROWS))
    return b"".join(encode_argb(x.astype(np.int64) << 8 | BLACK, refs=True, **_form(x)) for x in parts)


def load(media: bytes) -> np.ndarray:
    """The samples [rows, 576] of stored bytes, decoded."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append((decode_argb(media[at : at + n]) >> 8 & 255).astype(np.uint8))
        at += n
    return np.concatenate(out) if len(out) > 1 else out[0]


def features(px: np.ndarray) -> str:
    """Mean, deviation, entropy in bits and share of equal neighbours of 8-bit samples, to six digits."""
    n = np.bincount(px.ravel(), minlength=256)
    p = n[n > 0] / px.size
    v = np.arange(256)
    mean = float((n * v).sum()) / px.size
    dev = float(np.sqrt(max(0.0, float((n * v * v).sum()) / px.size - mean * mean)))
    same = np.count_nonzero(px[:, 1:] == px[:, :-1]) / (px.shape[0] * (px.shape[1] - 1))
    return f"{px.shape[0]}x{px.shape[1]} mean={mean:.6f} dev={dev:.6f} entropy={float(-(p * np.log2(p)).sum()):.6f} same={same:.6f}"
