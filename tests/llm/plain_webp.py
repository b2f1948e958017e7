"""A plain lossless WebP encoder, pixel by pixel, that writes every feature of the format: for tests of the decoder."""

import heapq

import numpy as np

from mnemosea.llm import webp
from mnemosea.llm.webp import CACHE_FACTOR, CODE_LENGTH_ORDER, CROSS_COLOUR, NEAR, PALETTE, PREDICTOR, SUBTRACT_GREEN, _blocks, _file, _per_byte, _predict, _reversed

#: Channels of a pixel array are red, green, blue, alpha; they are coded as green, red, blue, alpha.
_CODED = (1, 0, 2, 3)


def _residual(pixels: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    p = pixels.astype(np.int16)
    height, width, _ = p.shape
    out = p.copy()
    out[0, 0] -= np.array([0, 0, 0, 255], np.int16)
    out[0, 1:] -= p[0, :-1]
    for y in range(1, height):
        out[y, 0] -= p[y - 1, 0]
        for x in range(1, width):
            right = p[y - 1, x + 1] if x + 1 < width else p[y, 0]
            out[y, x] -= _predict(int(modes[y >> size_bits, x >> size_bits]), p[y, x - 1], p[y - 1, x], p[y - 1, x - 1], right)
    return (out & 255).astype(np.uint8)


class Out:
    """A writer of bits, lowest first."""

    def __init__(self):
        self.bits: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.bits.append(np.array([(value >> k) & 1 for k in range(n)], np.uint8))

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.bits), bitorder="little").tobytes()


def _head(out: Out, width: int, height: int) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)


def _put_lengths(out: Out, lengths: np.ndarray) -> None:
    """A normal code whose lengths are written one by one."""
    kinds = sorted(set(lengths.tolist()))
    if len(kinds) == 1:
        kinds.append(0 if kinds[0] else 1)
    inner_bits = max(1, (len(kinds) - 1).bit_length())
    inner = np.zeros(19, np.uint8)
    inner[kinds] = inner_bits
    spare = [k for k in range(16) if not inner[k]]
    for k in spare[: (1 << inner_bits) - len(kinds)]:
        inner[k] = inner_bits
    out.put(0, 1)
    out.put(15, 4)
    for k in CODE_LENGTH_ORDER:
        out.put(int(inner[k]), 3)
    last = int(np.flatnonzero(lengths)[-1]) + 1
    short = last >= 2
    out.put(int(short), 1)
    if short:
        out.put(3 if last - 2 < 1 << 8 else 5, 3)
        out.put(last - 2, 8 if last - 2 < 1 << 8 else 12)
    words = {int(s): k for k, s in enumerate(np.flatnonzero(inner))}
    turn = _reversed(inner_bits)
    rank = turn[[words[v] for v in lengths[: last if short else None].tolist()]]
    out.bits.append(((rank[:, None] >> np.arange(inner_bits)) & 1).astype(np.uint8).ravel())


def _lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code for the counts, 15 bits at most."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        used = np.append(used, [k for k in (0, 1) if k not in used])[:2] if len(used) else np.array([0, 1])
        out[used] = 1
        return out
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), int(s), None, None) for s in used]
        heapq.heapify(heap)
        n = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], n, a, b))
            n += 1
        todo = [(heap[0], 0)]
        while todo:
            (_, s, a, b), depth = todo.pop()
            if a is None:
                out[s] = depth
            else:
                todo += [(a, depth + 1), (b, depth + 1)]
        if out.max() <= 15:
            return out
        floor *= 2


def _words(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """Symbol to (code with its bits in reverse, length)."""
    used = np.flatnonzero(lengths)
    words, code, before = {}, 0, 0
    for s in used[np.lexsort((used, lengths[used]))].tolist():
        n = int(lengths[s])
        code <<= n - before
        words[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, before = code + 1, n
    return words


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number, of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _put_image(out: Out, pixels: np.ndarray, width: int, *, cache_bits: int = 0, references: bool = False, groups: np.ndarray | None = None, group_bits: int = 2, main: bool = False) -> None:
    """Pixels (n, 4) as an entropy-coded image."""
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0 if groups is None else 1, 1)
        if groups is not None:
            out.put(group_bits - 2, 3)
            image = np.zeros((groups.size, 4), np.uint8)
            image[:, 0], image[:, 1] = groups.ravel() >> 8, groups.ravel() & 255
            _put_image(out, image, groups.shape[1])
    number = [int(x) for x in (pixels[:, 3].astype(np.uint32) << 24 | pixels[:, 0].astype(np.uint32) << 16 | pixels[:, 1].astype(np.uint32) << 8 | pixels[:, 2])]
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width >= 1}
    cache: dict[int, int] = {}
    places: dict[tuple[int, ...], int] = {}
    steps: list[tuple] = []
    at, n = 0, len(number)
    while at < n:
        length = distance = 0
        if references and at + 3 <= n and (old := places.get(tuple(number[at : at + 3]))) is not None:
            distance = at - old
            while at + length < n and length < 4096 and number[at + length] == number[old + length]:
                length += 1
        slot = ((number[at] * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
        if length >= 3:
            steps.append((at, "copy", length, near.get(distance, distance + 120)))
        elif cache_bits and cache.get(slot) == number[at]:
            steps.append((at, "cache", slot, 0))
            length = 1
        else:
            steps.append((at, "pixel", 0, 0))
            length = 1
        for k in range(at, at + length):
            places[tuple(number[k : k + 3])] = k
            if cache_bits:
                cache[((number[k] * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits)] = number[k]
        at += length
    group_of = (lambda at: int(groups[(at // width) >> group_bits, (at % width) >> group_bits])) if groups is not None else (lambda at: 0)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(int(groups.max()) + 1 if groups is not None else 1)]
    symbols = []
    for at, kind, a, b in steps:
        c = counts[group_of(at)]
        if kind == "pixel":
            own = [(k, int(pixels[at, _CODED[k]]), 0, 0) for k in range(4)]
        elif kind == "cache":
            own = [(0, 280 + a, 0, 0)]
        else:
            length, distance = _prefix(a), _prefix(b)
            own = [(0, 256 + length[0], *length[1:]), (4, *distance)]
        for k, s, _, _ in own:
            c[k][s] += 1
        symbols.append((group_of(at), own))
    words = []
    for c in counts:
        lengths = [_lengths(x) for x in c]
        for x in lengths:
            _put_lengths(out, x)
        words.append([_words(x) for x in lengths])
    for g, own in symbols:
        for k, s, extra, n_extra in own:
            out.put(*words[g][k][s])
            out.put(extra, n_extra)


def encode(pixels: np.ndarray, *, transforms: tuple = (), size_bits: int = 2, cache_bits: int = 0, references: bool = True, groups: np.ndarray | None = None, group_bits: int = 2, seed: int = 0) -> bytes:
    """A WebP file of (height, width, 4) pixels with the transforms in the given order. Predictor
    modes and cross-colour factors are drawn by ``seed``: any choice is lossless."""
    height, width, _ = pixels.shape
    draw = np.random.default_rng(seed)
    out = Out()
    _head(out, width, height)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            out.put(size_bits - 2, 3)
            columns, rows = _blocks(width, size_bits), _blocks(height, size_bits)
            image = np.zeros((rows * columns, 4), np.uint8)
            image[:, 3] = 255
            if kind == PREDICTOR:
                image[:, 1] = draw.integers(0, 14, rows * columns)
                pixels = _residual(pixels, image[:, 1].reshape(-1, columns), size_bits)
            else:
                image[:, :3] = draw.integers(0, 256, (rows * columns, 3))
                own = np.repeat(np.repeat(image.reshape(-1, columns, 4), 1 << size_bits, 0), 1 << size_bits, 1)[:height, :width]
                pixels = webp._cross(pixels.reshape(-1, 4), own.reshape(-1, 4), -1).reshape(height, width, 4)
            _put_image(out, image, columns)
        elif kind == SUBTRACT_GREEN:
            pixels = pixels.copy()
            pixels[..., 0] -= pixels[..., 1]
            pixels[..., 2] -= pixels[..., 1]
        else:
            table, index = np.unique(pixels.reshape(-1, 4), axis=0, return_inverse=True)
            index = index.reshape(height, width)
            out.put(len(table) - 1, 8)
            _put_image(out, np.diff(table.astype(np.int16), axis=0, prepend=np.zeros((1, 4), np.int16)).astype(np.uint8), len(table))
            size = int(_per_byte(len(table)))
            wide = np.zeros((height, _blocks(width, size) << size), np.int64)
            wide[:, :width] = index
            parts = wide.reshape(height, -1, 1 << size)
            pixels = np.zeros((height, parts.shape[1], 4), np.uint8)
            pixels[..., 1] = sum(parts[..., k] << ((8 >> size) * k) for k in range(1 << size))
            pixels[..., 3] = 255
            width = parts.shape[1]
    out.put(0, 1)
    _put_image(out, pixels.reshape(-1, 4), width, cache_bits=cache_bits, references=references, groups=groups, group_bits=group_bits, main=True)
    return _file(out.bytes())


