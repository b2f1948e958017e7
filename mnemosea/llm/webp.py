"""Lossless WebP (VP8L): a decoder and an encoder that work on many images side by side, and a media column.

The decoder reads prefix codes (simple, normal, in groups by an entropy image), back-references and
the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.
It takes a batch of images and does each step for all of them at once: the next code of every image is
one table look-up over arrays, and the predictor goes through the diagonals of all images together.

The encoder of the media column gives an image of few colours a palette, and any other the
predictor and cross-colour transforms and a colour cache; all get back-references and prefix codes of
their own. A text's bytes are grey pixels, in images of at most 64 by 32, so that the
images of a batch are of like size however long a text is.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemosea.llm._common import read_table, sliced, text_bytes

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: (x, y) of the 120 short distance codes: that many columns to the left and rows up.
NEAR = [
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
]
_NEAR = np.array(NEAR)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
SIDE = 16384
CACHE_FACTOR = 0x1E35A7BD
#: Channels of a pixel array are red, green, blue, alpha; they are coded as green, red, blue, alpha.
_CODED = (1, 0, 2, 3)


class Damaged(ValueError):
    """The bytes are no lossless WebP image."""


def _reversed(n: int) -> np.ndarray:
    """The numbers below 2 ** n with their n bits in reverse."""
    v = np.arange(1 << n)
    return sum(((v >> k) & 1) << (n - 1 - k) for k in range(n)).astype(np.int64)


#: Bits that are looked up at once for several symbols.
_SEVERAL = 10
#: What such a look-up gives in one number: the bits in the lowest four, one _FOUND for each symbol, and where the symbols stand.
_FOUND, _SYMBOL_AT = 1 << 32, np.array([4, 16, 36])
_TAKEN = 3 * _FOUND | 15
#: Steps of _run between two in which references are read.
_WAIT = 4
_REVERSED_8, _REVERSED_15, _REVERSED_SEVERAL = _reversed(8), _reversed(15), _reversed(_SEVERAL)
_LONG = -1
#: Of the symbols of code lengths: extra bits, and the least run.
_RUN_BITS, _RUN_LEAST = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places begin[i] .. begin[i] + count[i] - 1 for each i in turn."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def _filled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all that is not zero."""
    return np.divmod(np.flatnonzero(rows), rows.shape[1])


class Codes:
    """Many prefix codes, from a row of code lengths each.

    A table of 256 entries for each code gives symbol and length of what begins with the next eight
    bits; longer codes are found among the first codes of each length.
    """

    def __init__(self, lengths: np.ndarray):
        m = len(lengths)
        used = (lengths > 0).sum(1)
        self.single = used <= 1
        alone = lengths.argmax(1)
        #: The row of ``first`` and ``place`` of each code, and what is told by the next eight bits.
        self.row = np.cumsum(~self.single) - 1
        self.table = np.empty((m, 256), np.int32)
        self.table[self.single] = (alone[self.single] << 4)[:, None]
        self.table = self.table.ravel()
        many = np.flatnonzero(~self.single)
        lengths = lengths[many]
        code, symbol = _filled(lengths)
        size = lengths[code, symbol].astype(np.int64)
        count = np.bincount(code * 16 + size, minlength=len(many) * 16).reshape(-1, 16)
        if ((count << (15 - np.arange(16))).sum(1) != 1 << 15).any():
            raise Damaged("a prefix code is not complete")
        order = _order(code * 16 + size)
        code, symbol, size = code[order], symbol[order], size[order]
        #: The first code of each length, filled up to 15 bits, and the place of its symbol.
        self.first = np.concatenate([np.zeros((len(many), 1), np.int64), np.cumsum(count << (15 - np.arange(16)), 1)[:, :-1]], 1)
        self.place = (np.cumsum(used[many]) - used[many])[:, None] + np.cumsum(count, 1) - count
        self.symbols, self.sizes, self.used = symbol, size, used[many]
        short = np.flatnonzero(size <= 8)
        table = np.full((len(many), 256), _LONG, np.int32)
        if len(short):
            # Codes of up to eight bits fill a row from its begin on.
            span = 1 << (8 - size[short])
            filled = np.bincount(code[short], span, len(many)).astype(np.int64)
            entry = np.repeat((symbol[short] * 16 + size[short]).astype(np.int32), span)
            if (filled == 256).all():
                table = entry.reshape(-1, 256)
            else:
                table[np.arange(256) < filled[:, None]] = entry
        self.table.reshape(m, 256)[many] = table[:, _REVERSED_8]

    def several(self, code: np.ndarray) -> np.ndarray:
        """For each code and each value of the next _SEVERAL bits, as _FOUND says: how many symbols (three at most), their bits, and the
        symbols, twelve bits each. A reference counts as none and takes no bits, but has its symbol, and its bits as a second one; a longer code has nothing."""
        out = np.empty((len(code), 1 << _SEVERAL), np.int64)
        for k in range(0, len(code), 64):  # so many tables stay in the processor's cache
            self._several(code[k : k + 64], out[k : k + 64].view(np.int32)[:, ::2], out[k : k + 64].view(np.int32)[:, 1::2])
        return out.ravel()

    def _several(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Fills the lower and upper halves of the numbers."""
        wide = 1 << _SEVERAL
        one = np.empty((len(code), wide), np.int32)
        single = self.single[code]
        one[single] = self.table.reshape(-1, 256)[code[single], :1]
        many = np.flatnonzero(~single)
        row = self.row[code[many]]
        # Codes of up to that many bits fill a row from its begin on.
        place, size = self.place[row, 0], self.used[row]
        at = _ragged(place, size)
        span = wide >> self.sizes[at]
        filled = np.bincount(np.repeat(np.arange(len(many)), size), span, len(many)).astype(np.int64)
        entry = np.repeat((self.symbols[at] * 16 + self.sizes[at]).astype(np.int32), span)
        table = np.full((len(many), wide), _LONG, np.int32)
        if len(many) and (filled == wide).all():
            table = entry.reshape(-1, wide)
        else:
            table[np.arange(wide) < filled[:, None]] = entry
        one[many] = table.take(_REVERSED_SEVERAL, 1)
        reference = (one < 0) | ((one >= 256 << 4) & (one < 280 << 4))
        literal = np.where(reference, 15, one)  # nothing but literals can follow, and they have fewer bits
        low[:] = np.where(reference, np.where(one < 0, 0, (one >> 4) << 4 | (one & 15) << 16), one)
        count = 1 - reference.astype(np.int32)
        used = literal & 15
        used[single] = 15
        base = (np.arange(len(code), dtype=np.int32) << _SEVERAL)[:, None]
        flat = literal.ravel()
        for k in (1, 2):
            next_one = flat.take(base + (np.arange(wide, dtype=np.int32) >> used))
            bits = next_one & 15
            total = used + bits
            good = total <= _SEVERAL
            low += np.where(good, bits + ((next_one >> 4) << 16) if k == 1 else bits, 0)
            count += np.where(good, 1 if k == 1 else 1 + (next_one ^ bits), 0)
            used = np.where(good, total, 15)
        high[:] = count

    def look(self, code: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length of what each window begins with; a code is given as 256 times its number."""
        entry = self.table.take(code + window.view(np.uint8)[::8])
        symbol, size = entry >> 4, entry & 15
        long = entry == _LONG
        if long.any():
            long = np.flatnonzero(long)
            c, x = self.row[code[long] >> 8], _REVERSED_15[window[long] & 32767]
            n = 9 + (x[:, None] >= self.first[c, 10:]).sum(1)
            symbol[long] = self.symbols[np.minimum(self.place[c, n] + ((x - self.first[c, n]) >> (15 - n)), len(self.symbols) - 1)]
            size[long] = n
        return symbol, size


def _expanded(kind: np.ndarray, value: np.ndarray, size: np.ndarray, count: np.ndarray, cache_bits: np.ndarray) -> np.ndarray:
    """All pixels of images of ``count`` pixels from their literals (kind 0, the colour), slots of the cache (1) and
    references (2, the distance): what is no literal points at an earlier pixel, in the end at a literal."""
    total = int(count.sum())
    start = np.cumsum(size) - size
    pointer = np.arange(total + 1, dtype=np.int32)
    colour = np.zeros(total + 1, np.uint32)
    colour[start] = value  # no pointer leads to what this says of others than literals
    some = np.flatnonzero(kind == 2)
    to = _ragged(start[some], size[some])
    pointer[to] = to - np.repeat(value[some].astype(np.int64), size[some])
    some = np.flatnonzero(kind == 1)
    spot = start[some]
    if len(spot):
        _follow(pointer, to)
        own = np.flatnonzero(cache_bits > 0)
        at = _ragged((np.cumsum(count) - count)[own], count[own])
        where = np.zeros(total + 1, np.int32)
        where[at] = np.arange(len(at), dtype=np.int32)
        image = np.repeat(np.arange(len(own)), count[own])
        slot = ((colour[at] * np.uint32(CACHE_FACTOR)) >> np.repeat((32 - cache_bits[own]).astype(np.uint32), count[own])).astype(np.int64)
        place = where[spot]
        slot[place] = value[some]
        before = _earlier((image << int(cache_bits.max())) | slot[where[pointer[at]]])[place]
        pointer[spot] = np.where(before < 0, total, at[before])  # a slot that nothing is in yet is 0
        to = np.concatenate([to, spot])
    _follow(pointer, to)
    colour[to] = colour[pointer[to]]
    return colour[:-1]


#: For each prefix code of a length or distance: its extra bits, and the least value, to which they are added.
_EXTRA = np.maximum(0, (np.arange(64) - 2) >> 1)
_LEAST = np.where(np.arange(64) < 4, np.arange(64) + 1, ((2 + (np.arange(64) & 1)) << _EXTRA) + 1)
_EXTRA_MASK = (1 << _EXTRA) - 1


def _number(prefix: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length or distance of a prefix code whose extra bits the window begins with, and their number."""
    return _LEAST[prefix] + (window & _EXTRA_MASK[prefix]), _EXTRA[prefix]


@functools.cache
def _starts() -> np.ndarray:
    """For the next _SEVERAL + 7 bits, the _SEVERAL bits from each of the first eight on."""
    return ((np.arange(1 << (_SEVERAL + 7))[:, None] >> np.arange(8)) & ((1 << _SEVERAL) - 1)).astype(np.uint16)


class Images:
    """VP8L streams that are read side by side: each step reads something of every image that has it."""

    def __init__(self, chunks: list[bytes]):
        sizes = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(sizes) - sizes
        data = b"".join(chunks)
        self.words = np.frombuffer(data + b"\0" * (16 + -len(data) % 8), "<u8")
        self.at, self.stop = begin * 8, (begin + sizes) * 8
        self.n = len(chunks)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 64 bits from each place on; shifted to the right, all but the highest stay right."""
        k = np.minimum(at >> 6, len(self.words) - 2)
        low = (at & 63).view(np.uint64)
        return ((self.words.take(k) >> low) | ((self.words.take(k + 1) << np.uint64(1)) << (np.uint64(63) - low))).view(np.int64)

    @functools.cached_property
    def starts(self) -> np.ndarray:
        """The _SEVERAL bits from each bit on."""
        data = self.words.view(np.uint8)
        three = data[:-2].astype(np.uint32)
        for k in (1, 2):
            three |= data[k : len(data) - 2 + k].astype(np.uint32) << np.uint32(8 * k)
        return _starts().take(three & np.uint32((1 << (_SEVERAL + 7)) - 1), 0).ravel()

    def read(self, own: np.ndarray, n) -> np.ndarray:
        """n bits (a number, or one for each image of ``own``)."""
        n = np.broadcast_to(np.asarray(n, np.int64), own.shape)
        value = self.window(self.at[own]) & ((1 << n) - 1)
        self.at[own] += n
        return value

    def check(self) -> None:
        if (self.at > self.stop).any():
            raise Damaged("the data end too early")

    def _lengths(self, own: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The code lengths of a prefix code over ``size`` symbols for each image of ``own``."""
        out = np.zeros((len(own), int(size.max())), np.uint8)
        simple = self.read(own, 1) == 1
        row = np.flatnonzero(simple)
        if len(row):
            two, wide = self.read(own[row], 1), self.read(own[row], 1)
            for some, bits in ((row, np.where(wide, 8, 1)), (row[two == 1], 8)):
                symbol = self.read(own[some], bits)
                if (symbol >= size[some]).any():
                    raise Damaged("a symbol is out of range")
                out[some, symbol] = 1
        row = np.flatnonzero(~simple)
        if not len(row):
            return out
        lane, most = own[row], size[row]
        inner, given = np.zeros((len(row), 19), np.uint8), 4 + self.read(lane, 4)
        for k in range(int(given.max())):
            some = np.flatnonzero(given > k)
            inner[some, CODE_LENGTH_ORDER[k]] = self.read(lane[some], 3)
        code = Codes(inner)
        left = most.copy()
        some = np.flatnonzero(self.read(lane, 1))
        if len(some):
            left[some] = 2 + self.read(lane[some], 2 + 2 * self.read(lane[some], 3))
        place, last = np.zeros(len(row), np.int64), np.full(len(row), 8)
        todo = np.arange(len(row))
        while len(todo):
            left[todo] -= 1
            window = self.window(self.at[lane[todo]])
            symbol, bits = code.look(todo << 8, window)
            window = window >> bits
            here = place[todo]
            literal = symbol < 16
            some = todo[literal]
            out[row[some], here[literal]] = symbol[literal]
            last[some] = np.where(symbol[literal] > 0, symbol[literal], last[some])
            extra = _RUN_BITS[symbol]
            run = _RUN_LEAST[symbol] + (window & ((1 << extra) - 1))
            if (here + run > most[todo]).any():
                raise Damaged("code lengths run over")
            again = np.flatnonzero(symbol == 16)
            if len(again):
                n = run[again]
                out[np.repeat(row[todo[again]], n), _ragged(here[again], n)] = np.repeat(last[todo[again]], n)
            self.at[lane[todo]] += bits + extra
            place[todo] += run
            todo = todo[(place[todo] < most[todo]) & (left[todo] > 0)]
        self.check()
        return out

    def pixels(self, own: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
        """The entropy-coded images of ``own``: pixels as alpha, red, green, blue in one number, one image after
        another, and where each begins."""
        count = width * height
        begin = np.cumsum(count) - count
        cache_bits = np.zeros(len(own), np.int64)
        some = np.flatnonzero(self.read(own, 1))
        cache_bits[some] = self.read(own[some], 4)
        if (cache_bits > 11).any():
            raise Damaged("the colour cache is too large")
        n_groups, group_bits = np.ones(len(own), np.int64), np.zeros(len(own), np.int64)
        group_of: tuple | None = None
        if main and len(some := np.flatnonzero(self.read(own, 1))):
            group_bits[some] = self.read(own[some], 3) + 2
            columns, rows = _blocks(width[some], group_bits[some]), _blocks(height[some], group_bits[some])
            image, edge = self.pixels(own[some], columns, rows, False)
            number = ((image >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
            n_groups[some] = np.maximum.reduceat(number, edge) + 1
            first, across = np.full(len(own), -1), np.ones(len(own), np.int64)
            first[some], across[some] = edge, columns
            group_of = number, first, across
        sizes = np.stack([280 + np.where(cache_bits > 0, 1 << cache_bits, 0), *np.full((3, len(own)), 256), np.full(len(own), 40)], 1)
        code_begin = (np.cumsum(n_groups) - n_groups) * 5
        lengths = np.zeros((int(n_groups.sum()) * 5, int(sizes.max())), np.uint8)
        for g in range(int(n_groups.max())):
            some = np.flatnonzero(n_groups > g)
            for k in range(5):
                found = self._lengths(own[some], sizes[some, k])
                lengths[code_begin[some] + 5 * g + k, : found.shape[1]] = found
        codes = Codes(lengths)
        # First the symbols, the next ones of each image at a time. Images that are done stand still until they are left out.
        slack = 16
        room = np.cumsum(count + slack) - count - slack
        others = code_begin[:, None] + np.arange(1, 4)
        plain = (n_groups == 1) & (codes.single[others].all(1))
        constant = np.where(plain, (codes.table.reshape(-1, 256)[others, 0] >> 4) @ np.array([1 << 16, 1, 1 << 24]), 0)
        widths, which = np.unique(width, return_inverse=True)
        near_of = np.maximum(1, _NEAR[:, 0] + _NEAR[:, 1] * widths[:, None])
        if main and bool(plain.all()) and len(self.words) < 1 << 26:
            image, symbols, size, value = self._run(own, codes, code_begin, count, slack, which, near_of, np.flatnonzero(count > 0))
            kind = np.where(symbols < 256, 0, np.where(symbols < 280, 2, 1)).astype(np.uint8)
            some = np.flatnonzero(kind == 0)
            value[some] = constant.astype(np.uint32)[image[some]] | symbols[some].astype(np.uint32) << np.uint32(8)
            some = np.flatnonzero(kind == 1)
            value[some] = symbols[some] - 280
            return _expanded(kind, value, size, count, cache_bits), begin
        symbols, size = np.zeros(int((count + slack).sum()), np.int16), np.zeros(int((count + slack).sum()), np.int16)
        lane = np.flatnonzero(count > 0)
        code, at, done, most, place = code_begin[lane] << 8, self.at[own[lane]], np.zeros(len(lane), np.int64), count[lane], room[lane]
        steps, copies, colours = 0, [], []
        all_plain = bool(plain.all())
        while len(lane):
            window = self.window(at)
            here = code
            if group_of is not None:
                number, first, across = group_of
                y, x = np.divmod(np.minimum(done, most - 1), width[lane])
                grouped = first[lane] >= 0
                here = code + 5 * 256 * np.where(grouped, number[np.where(grouped, first[lane] + (y >> group_bits[lane]) * across[lane] + (x >> group_bits[lane]), 0)], 0)
            symbol, n = codes.look(here, window)
            live = done < most
            length = live.astype(np.int16)
            far = np.flatnonzero((symbol >= 256) & (symbol < 280) & live)
            symbols[place + steps] = symbol
            if len(far):
                w = window[far] >> n[far]
                run, extra = _number(symbol[far].astype(np.int64) - 256, w)
                w = w >> extra
                s, used = codes.look(here[far] + 1024, w)
                d, more = _number(s.astype(np.int64), w >> used)
                d = np.where(d > 120, d - 120, near_of[which[lane[far]], np.minimum(d, 120) - 1])
                if (d > done[far]).any() or (done[far] + run > most[far]).any():
                    raise Damaged("a back-reference leaves the image")
                length[far] = run
                copies.append((place[far] + steps, d))
                n[far] += extra + used + more
            if not all_plain and len(more := np.flatnonzero((symbol < 256) & live & ~plain[lane])):
                c, w, value = here[more], window[more] >> n[more], symbol[more].astype(np.int64) << 8
                for j, shift in ((1, 16), (2, 0), (3, 24)):
                    got, used = codes.look(c + 256 * j, w)
                    value |= got.astype(np.int64) << shift
                    n[more] += used
                    w = w >> used
                colours.append((place[more] + steps, value))
            size[place + steps] = length
            at += n * live
            done += length
            steps += 1
            if steps % slack == 0 or not main:
                live = done < most
                if not live.all():
                    self.at[own[lane]] = at
                    lane, code, at, done, most, place = (x[live] for x in (lane, code, at, done, most, place))
        self.check()
        found = np.flatnonzero(size)
        symbols, size = symbols[found].astype(np.int64), size[found].astype(np.int64)
        image = np.repeat(np.arange(len(own)), count + slack)[found]
        kind = np.where(symbols < 256, 0, np.where(symbols < 280, 2, 1)).astype(np.uint8)
        value = np.where(kind == 0, constant[image] | symbols << 8, symbols - 280)
        for k, parts in ((2, copies), (0, colours)):
            if parts:
                spot, v = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                value[np.searchsorted(found, spot)] = v
        found = np.flatnonzero(size)
        kind, value, size = kind[found], value[found], size[found]
        start = np.cumsum(size) - size
        return _expanded(kind, value, size, count, cache_bits), begin

    def _run(self, own: np.ndarray, codes: Codes, code_begin: np.ndarray, count: np.ndarray, slack: int, which: np.ndarray, near_of: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, ...]:
        """The symbols of those images (numbered by ``lane``) of which only green differs: up to three that are no references are read in one
        look-up. Gives for each symbol its image, the symbol, its pixels, and the distance of a reference."""
        table, starts = codes.several(code_begin[lane]), self.starts
        every, base, total = lane, np.arange(len(lane)) << _SEVERAL, count[lane]
        # Where each image is read, in the lower half of a number, and the pixels it has, in the upper half.
        state = self.at[own[lane]]
        began = state.copy()
        blocks, copies, slow_bits, steps = [], [], [(np.zeros(0, np.int64),) * 3], 0
        row = np.arange(len(lane))
        last = np.zeros(len(lane), np.int64)
        while len(row):
            # Images that are done go on until the block of steps ends; what they read then is left out below.
            block = np.empty((slack, len(row)), np.int64)
            at, done, taken = state.view(np.uint32)[::2], state.view(np.uint32)[1::2], np.empty(len(row), np.int64)
            for s in range(slack):
                entry = block[s]
                table.take(base + starts.take(at, mode="clip"), out=entry, mode="clip")
                np.bitwise_and(entry, _TAKEN, out=taken)
                np.add(state, taken, out=state)
                # An image that meets a reference or a longer code stands still until they are read, for many images at a time.
                if s % _WAIT != _WAIT - 1 or not len(slow := np.flatnonzero((entry < _FOUND) & (done < total))):
                    continue
                c, window = code_begin[every[row[slow]]] << 8, self.window(at[slow].astype(np.int64))
                symbol, used = (entry[slow] >> 4) & 4095, entry[slow] >> 16
                if not symbol.all():  # codes that are longer than one look-up
                    symbol, used = (x.astype(np.int64) for x in codes.look(c, window))
                entry[slow] = _FOUND | symbol << 4
                pixels = np.ones(len(slow), np.int64)
                far = np.flatnonzero((symbol >= 256) & (symbol < 280))
                if len(far):
                    w = window[far] >> used[far]
                    run, extra = _number(symbol[far] - 256, w)
                    w = w >> extra
                    t, used_2 = codes.look(c[far] + 1024, w)
                    d, more = _number(t.astype(np.int64), w >> used_2)
                    lane = slow[far]
                    d = np.where(d > 120, d - 120, near_of[which[every[row[lane]]], np.minimum(d, 120) - 1])
                    if (d > done[lane]).any() or (run > total[lane] - done[lane]).any():
                        raise Damaged("a back-reference leaves the image")
                    pixels[far] = run
                    used[far] += extra + used_2 + more
                    copies.append((row[lane], np.full(len(lane), steps + s), run, d))
                slow_bits.append((row[slow], np.full(len(slow), steps + s), used))
                state[slow] += used + (pixels << 32)
            blocks.append((row, block))
            steps += slack
            last[row] = steps
            live = done < total
            if not live.all():
                row, base, state, total = (x[live] for x in (row, base, state, total))
        place = np.cumsum(last) - last
        stored = np.empty(int(last.sum()), np.int64)
        for k, (row, block) in enumerate(blocks):
            stored[(place[row] + k * slack)[:, None] + np.arange(slack)] = block.T
        del blocks
        found = np.flatnonzero(stored >= _FOUND)
        entry = stored[found]
        n = (entry >> 32) & 3
        edge = np.searchsorted(found, np.append(place, len(stored)))  # the look-ups of each image
        row = np.repeat(np.arange(len(every), dtype=np.int32), np.diff(edge))
        pixels = n.copy()
        far, step, run, d = (np.concatenate([c[k] for c in copies]) for k in range(4)) if copies else (np.zeros(0, np.int64),) * 4
        far = np.searchsorted(found, place[far] + step)
        pixels[far] = run
        before = np.cumsum(pixels) - pixels
        before -= np.repeat(before[edge[:-1]] - np.cumsum(count[every]) + count[every], np.diff(edge))
        n = np.clip(np.repeat(np.cumsum(count[every]), np.diff(edge)) - before, 0, n)  # what follows an image's end is no pixel
        used = entry & 15
        spot, step, bits = (np.concatenate([x[k] for x in slow_bits]) for k in range(3))
        used[np.searchsorted(found, place[spot] + step)] = bits
        used = np.append(0, np.cumsum(np.where(n > 0, used, 0)))
        self.at[own[every]] = began + np.diff(used[edge]) - _SEVERAL  # the last look-up may have gone beyond the image
        self.check()
        first = np.cumsum(n) - n
        inside = np.flatnonzero(n > 0)
        symbols = np.empty(int(n.sum()) + 2, np.int16)
        for k in (2, 1, 0):  # a look-up of fewer symbols is overwritten by the ones that follow
            symbols[first[inside] + k] = (entry[inside] >> _SYMBOL_AT[k]) & 4095
        symbols = symbols[:-2]
        size, value = np.ones(len(symbols), np.int32), np.zeros(len(symbols), np.uint32)
        size[first[far]], value[first[far]] = run, d
        return np.repeat(every[row], n), symbols, size, value

    def decoded(self, width: np.ndarray, height: np.ndarray) -> list[np.ndarray]:
        """The images from their transforms on: the pixels of each, alpha, red, green and blue in one number."""
        undo: list[tuple] = []
        seen, coded = np.zeros((self.n, 4), bool), width.copy()
        todo = np.arange(self.n)
        while len(todo := todo[self.read(todo, 1) == 1]):
            kind = self.read(todo, 2)
            if seen[todo, kind].any():
                raise Damaged("a transform comes twice")
            seen[todo, kind] = True
            for k in sorted(set(kind.tolist())):
                own = todo[kind == k]
                if k in (PREDICTOR, CROSS_COLOUR):
                    bits = self.read(own, 3) + 2
                    across = _blocks(coded[own], bits)
                    undo.append((k, own, bits, across, *self.pixels(own, across, _blocks(height[own], bits), False), coded[own]))
                elif k == PALETTE:
                    n = self.read(own, 8) + 1
                    table, edge = self.pixels(own, n, np.ones(len(own), np.int64), False)
                    bits = _per_byte(n)
                    undo.append((k, own, bits, n, table, edge, coded[own]))
                    coded[own] = _blocks(coded[own], bits)
                else:
                    undo.append((k, own, None, None, None, None, coded[own]))
        flat, begin = self.pixels(np.arange(self.n), coded, height, True)
        parts = [flat[b : b + n] for b, n in zip(begin.tolist(), (coded * height).tolist(), strict=True)]
        for kind, own, bits, across, image, edge, wide in reversed(undo):
            for own, bits, across, edge, wide in [(own, bits, across, edge, wide)] if kind != PALETTE else _apart(bits > 0, own, bits, across, edge, wide):
                now = np.concatenate([parts[i] for i in own.tolist()])
                count = np.array([len(parts[i]) for i in own.tolist()])
                if kind == PALETTE:
                    now, count = _unpalette(now.view(np.uint8)[1::4], count, bits, across, *_tables(image, edge, across), wide, height[own])
                else:
                    pixels = _channels(now)
                    if kind == SUBTRACT_GREEN:
                        pixels[:, 0] += pixels[:, 1]
                        pixels[:, 2] += pixels[:, 1]
                    else:
                        x, y, base = _places(count, wide)
                        block = np.repeat(edge, count) + (y >> np.repeat(bits, count)) * np.repeat(across, count) + (x >> np.repeat(bits, count))
                        if kind == PREDICTOR:
                            mode = ((image >> np.uint32(8)) & np.uint32(15)).astype(np.int64)[block]
                            pixels = _unpredict(pixels, _modes(mode, x, y), x, y, np.repeat(wide, count))
                        else:
                            pixels = _cross(pixels, _channels(image)[block], 1)
                    now = _numbers(pixels)
                for i, part in zip(own.tolist(), np.split(now, np.cumsum(count)[:-1]), strict=True):
                    parts[i] = part
        return parts


def _apart(which: np.ndarray, *arrays: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The arrays' rows where ``which`` is false, and those where it is true."""
    return [tuple(a[some] for a in arrays) for some in (~which, which) if some.any()]


def _tables(image: np.ndarray, edge: np.ndarray, colours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The colour differences of some images' tables, and where each table begins."""
    return _channels(image[_ragged(edge, colours)]), np.cumsum(colours) - colours


def _follow(pointer: np.ndarray, todo: np.ndarray) -> None:
    """Turns the pointers of some places to where they lead in the end; a place that points at itself is an end, and so are all others."""
    while len(todo):
        at = pointer[todo]
        on = pointer[at]
        moved = on != at
        todo = todo[moved]
        pointer[todo] = on[moved]


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers from 0 on, and the numbers in it."""
    most, bits = int(key.max(initial=0)), len(key).bit_length()
    if most >> 16 and not most >> (63 - bits):  # a number and its place in one
        both = (key.astype(np.int64) << bits) | np.arange(len(key))
        both.sort()
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    rest, most = key >> 16, most >> 16
    while most:
        order = order[np.argsort((rest & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        rest, most = rest >> 16, most >> 16
    return order, key[order]


def _order(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on."""
    return _sorted(key)[0]


def _earlier(key: np.ndarray) -> np.ndarray:
    """For each place the last earlier place with the same key, or -1."""
    order, own = _sorted(key)
    same = np.flatnonzero(own[1:] == own[:-1])
    out = np.full(len(key), -1, np.int32)
    out[order[same + 1]] = order[same]
    return out


def _channels(numbers: np.ndarray) -> np.ndarray:
    """Red, green, blue and alpha (n, 4) of alpha, red, green, blue in one number."""
    return numbers.view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].copy()


def _numbers(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels[:, [2, 1, 0, 3]]).view(np.uint32).ravel()


def _places(count: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column and row of each pixel of images one after another, and the begin of its image."""
    base = np.repeat(np.cumsum(count) - count, count)
    y, x = np.divmod(np.arange(len(base)) - base, np.repeat(width, count))
    return x, y, base


def _half(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, top_left, top_right):
    """The prediction of pixels from int16 neighbours (channels in the last axis)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode == 6:
        return _half(left, top_left)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(top_left, top)
    if mode == 9:
        return _half(top, top_right)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode == 11:
        nearer_left = np.abs(top - top_left).sum(-1) < np.abs(left - top_left).sum(-1)
        return np.where(nearer_left[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _half(left, top)
        difference = mean - top_left
        return np.clip(mean + (difference + (difference < 0)) // 2, 0, 255)
    return np.array([0, 0, 0, 255], np.int16)


def _modes(mode: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The mode of each pixel: what the block says, but left in the first row and top in the first column."""
    mode = np.where(y == 0, 1, np.where(x == 0, 2, mode))
    mode[(x == 0) & (y == 0)] = 0
    return mode


def _neighbours(pixels: np.ndarray, at: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
    """Left, top, top left and top right; a place before the first pixel gives the first."""
    return [pixels[np.maximum(at - d, 0)] for d in (1, width, width + 1, width - 1)]


def _unpredict(residual: np.ndarray, mode: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray) -> np.ndarray:
    """All pixels with the same x + 2 * y need only pixels with less of it, so they are done at once, in all images."""
    out = residual.astype(np.int16)
    mode = np.where(mode > 13, 0, mode)
    turn = np.where(mode == 0, 0, ((x + 2 * y) << 4) | mode)  # without a prediction from others all are done at once
    order = _order(turn)
    turn = turn[order]
    edge = np.append(np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1]])), len(turn))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        at = order[i:j]
        kind = int(turn[i] & 15)
        if kind <= 2:
            value = out[at - (1 if kind == 1 else width[at])] if kind else _predict(0, None, None, None, None)
        else:
            value = _predict(kind, *_neighbours(out, at, width[at]))
        out[at] = (out[at] + value) & 255
    return out.astype(np.uint8)


def _delta(factor: np.ndarray, channel: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * channel.astype(np.int8).astype(np.int32)) >> 5


def _cross(pixels: np.ndarray, own: np.ndarray, sign: int) -> np.ndarray:
    """Add (1) or take away (-1) what the factors of each pixel say; ``own`` has red_to_blue,
    green_to_blue and green_to_red as red, green and blue."""
    out = pixels.astype(np.int32)
    red = (out[:, 0] + sign * _delta(own[:, 2], pixels[:, 1])) & 255
    seen = red if sign > 0 else out[:, 0]
    out[:, 2] = (out[:, 2] + sign * (_delta(own[:, 1], pixels[:, 1]) + _delta(own[:, 0], seen.astype(np.uint8)))) & 255
    out[:, 0] = red
    return out.astype(np.uint8)


def _unpalette(packed: np.ndarray, count: np.ndarray, bits: np.ndarray, colours: np.ndarray, steps: np.ndarray, edge: np.ndarray, wide: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels, a number each, from packed indexes; ``steps`` has the differences of each table's colours."""
    total = np.cumsum(steps.astype(np.int64), 0)
    table = np.append(_numbers((total - np.repeat(total[edge] - steps[edge], colours, 0)).astype(np.uint8)), np.uint32(0))
    n = wide * height
    index = packed
    if bits.any():
        x, y, _ = _places(n, wide)
        each_bits, coded = np.repeat(bits, n), np.repeat(_blocks(wide, bits), n)
        base = np.repeat(np.cumsum(count) - count, n)
        index = packed[base + y * coded + (x >> each_bits)].astype(np.int64)
        each = 8 >> each_bits
        index = (index >> (each * (x & ((1 << each_bits) - 1)))) & ((1 << each) - 1)
    first, most = np.repeat(edge.astype(np.int32), n), np.repeat(colours.astype(np.int32), n)
    return table[np.where(index < most, first + index, len(table) - 1)], n


def _blocks(n, size_bits):
    return (n + (1 << size_bits) - 1) >> size_bits


def _per_byte(colours):
    """The power of two of the indexes that share a byte."""
    colours = np.asarray(colours)
    return np.where(colours <= 2, 3, np.where(colours <= 4, 2, np.where(colours <= 16, 1, 0)))


def files(data: bytes) -> list[bytes]:
    """The VP8L chunks of a run of lossless WebP files."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise Damaged("no lossless WebP file")
        riff, own = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (4, 16))
        if at + 8 + riff > len(data) or own + 12 > riff:
            raise Damaged("the file is cut short")
        out.append(data[at + 20 : at + 20 + own])
        at += 8 + riff + (riff & 1)
    return out


def _decoded(chunks: list[bytes]) -> tuple[list[np.ndarray], list[int], list[int]]:
    """The pixels of VP8L chunks as numbers, and widths and heights; they are read side by side."""
    images = Images(chunks)
    every = np.arange(images.n)
    if (images.read(every, 8) != 0x2F).any():
        raise Damaged("no signature")
    width, height = images.read(every, 14) + 1, images.read(every, 14) + 1
    images.read(every, 1)
    if images.read(every, 3).any():
        raise Damaged("an unknown version")
    images.check()
    return images.decoded(width, height), width.tolist(), height.tolist()


def decode(chunks: list[bytes]) -> list[np.ndarray]:
    """The pixels (height, width, 4) of VP8L chunks."""
    return [_channels(p).reshape(h, w, 4) for p, w, h in zip(*_decoded(chunks), strict=True)] if chunks else []


def images(data: bytes):
    """The lossless images in a run of WebP files, as (height, width, 4) arrays."""
    yield from decode(files(data))


class Bitstreams:
    """Bits for many images: each time something is put for some of them, in their order."""

    def __init__(self, n: int):
        self.n = n
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, own: np.ndarray, value, n) -> None:
        """n bits of value, lowest first, for each image of ``own``, which ascends; an image may come more than once."""
        value, n = (np.broadcast_to(np.asarray(x, t), own.shape) for x, t in ((value, np.uint64), (n, np.int64)))
        self.parts.append((own, value, n))

    def chunks(self) -> list[bytes]:
        ends = [np.concatenate([[0], np.cumsum(n)]) for _, _, n in self.parts]
        edges = [np.searchsorted(own, np.arange(self.n + 1)) for own, _, _ in self.parts]
        sizes = [end[edge[1:]] - end[edge[:-1]] for end, edge in zip(ends, edges, strict=True)]
        total = sum(sizes)
        words = (total + 63) >> 6
        begin = np.cumsum(words) - words
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        at = begin * 64
        for (own, value, _), end, edge, size in zip(self.parts, ends, edges, sizes, strict=True):
            place = end[:-1] + np.repeat(at - end[edge[:-1]], np.diff(edge))
            at = at + size
            low = (place & 63).view(np.uint64)
            word = place >> 6
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            if len(first):
                out[word[first]] |= np.bitwise_or.reduceat(value << low, first)
                out[word[first] + 1] |= np.bitwise_or.reduceat((value >> np.uint64(1)) >> (np.uint64(63) - low), first)
        raw = out.astype("<u8").tobytes()
        return [raw[b * 8 : b * 8 + ((t + 7) >> 3)] for b, t in zip(begin.tolist(), total.tolist(), strict=True)]


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code for each row of counts, ``most`` at most (all rows side by side).
    A row with one symbol gets length 1 for it."""
    used = (counts > 0).sum(1)
    out = (counts > 0).astype(np.uint8)
    todo = np.flatnonzero(used > 1)
    left = counts[todo]
    while len(todo):
        got = _huffman(left)
        out[todo] = got
        long = got.max(1) > most
        todo, left = todo[long], (left[long] + 1) >> 1
    return out


def _huffman(counts: np.ndarray) -> np.ndarray:
    row, symbol = _filled(counts)
    weight = counts[row, symbol]
    order = _order((row << 20) | np.minimum(weight, (1 << 20) - 1))
    row, symbol, weight = row[order], symbol[order], weight[order]
    used = np.bincount(row, minlength=len(counts))
    begin = np.cumsum(used) - used
    by_size = np.argsort(-used, kind="stable")
    sizes, base = used[by_size], begin[by_size]
    infinite = np.iinfo(np.int64).max
    leaf = np.append(weight, infinite)
    inner = np.full(len(weight) + 1, infinite)  # the sums made so far, at the places of the row's leaves
    up_leaf, up_inner = np.zeros(len(weight) + 1, np.int64), np.zeros(len(weight) + 1, np.int64)
    next_leaf, next_inner = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    steps = int(sizes[0]) - 1 if len(sizes) else 0
    live = len(sizes)
    for k in range(steps):
        live = int(np.searchsorted(-sizes[:live], -(k + 1), side="left"))
        total = np.zeros(live, np.int64)
        for _ in range(2):
            a = np.where(next_leaf[:live] < sizes[:live], base[:live] + next_leaf[:live], len(weight))
            b = base[:live] + next_inner[:live]
            b = np.where(next_inner[:live] < k, b, len(weight))
            take = leaf[a] <= inner[b]
            total += np.where(take, leaf[a], inner[b])
            up_leaf[np.where(take, a, len(weight))] = k
            up_inner[np.where(take, len(weight), b)] = k
            next_leaf[:live] += take
            next_inner[:live] += ~take
        inner[base[:live] + k] = total
    depth = np.zeros(len(weight) + 1, np.int64)
    for k in range(steps - 2, -1, -1):
        live = int(np.searchsorted(-sizes, -(k + 2), side="left"))
        at = base[:live] + k
        depth[at] = depth[base[:live] + up_inner[at]] + 1
    out = np.zeros(counts.shape, np.uint8)
    own = begin[row]
    out[row, symbol] = np.where(used[row] > 1, depth[own + up_leaf[:-1]] + 1, 1)
    return out


def _code_words(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol of each row, its first bit lowest."""
    row, symbol = _filled(lengths)
    size = lengths[row, symbol].astype(np.int64)
    count = np.bincount(row * 16 + size, minlength=len(lengths) * 16).reshape(-1, 16)
    first = np.cumsum(count << (15 - np.arange(16)), 1) - (count << (15 - np.arange(16)))
    order = np.argsort(row * 16 + size, kind="stable")
    key = (row * 16 + size)[order]
    rank = np.arange(len(key)) - (np.cumsum(count.ravel()) - count.ravel())[key]
    size, row, symbol = size[order], row[order], symbol[order]
    out = np.zeros(lengths.shape, np.uint64)
    out[row, symbol] = _REVERSED_15[first[row, size] + (rank << (15 - size))].astype(np.uint64)
    return out


def _put_codes(out: Bitstreams, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Write prefix codes, several for an image in the order of the rows. Gives the lengths in bits of each
    symbol's code, which are 0 where a code has one symbol."""
    used = (lengths > 0).sum(1)
    simple = np.flatnonzero(used <= 1)
    bits = lengths.copy()
    bits[simple] = 0
    # The order in which values are put is kept within an image, so all rows have to go through the same steps.
    rows = np.arange(len(own))
    single = np.zeros(len(own), np.int64)
    single[simple] = lengths[simple].argmax(1)
    many = np.flatnonzero(used > 1)
    r, s = _filled(lengths[many])
    value = lengths[many][r, s].astype(np.int64)
    before = np.concatenate([[0], s[:-1]]) + 1
    gap = s - np.where(np.concatenate([[True], r[1:] != r[:-1]]), 0, before)
    whole, rest = gap // 138, gap % 138
    # Steps of each used symbol: runs of 138 zeros, a run of the rest or zeros one by one, and its own length.
    n_rest = np.where(rest >= 3, 1, rest)
    n = whole + n_rest + 1
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.arange(len(r)), n)
    step_row = many[r[at]]
    kind = np.where(k < whole[at], 18, np.where(k < n[at] - 1, np.where(rest[at] >= 11, 18, np.where(rest[at] >= 3, 17, 0)), value[at]))
    extra = np.where(k < whole[at], 127, np.where(rest[at] >= 11, rest[at] - 11, rest[at] - 3))
    n_extra = np.where(kind == 18, 7, np.where(kind == 17, 3, 0))
    counts = np.bincount(step_row * 19 + kind, minlength=len(own) * 19).reshape(-1, 19)
    inner = code_lengths(counts, 7)
    words = _code_words(inner)
    inner_bits = inner.copy()
    inner_bits[(inner > 0).sum(1) <= 1] = 0
    steps = np.bincount(step_row, minlength=len(own))
    given = np.maximum(4, 19 - (inner[:, CODE_LENGTH_ORDER][:, ::-1] > 0).argmax(1))
    # Everything of a row, in its order: (row, place within the row, value, bits).
    pieces = [
        (simple, 0, 0b101 | (single[simple] << 3), 11),  # simple, one symbol, eight bits
        (many, 0, 0 | ((given[many] - 4) << 1), 5),
        *((many[given[many] > j], 1 + j, inner[many[given[many] > j], CODE_LENGTH_ORDER[j]], 3) for j in range(19)),
        (many, 20, 1 | (np.where(steps[many] - 2 < 256, 3, 4) << 1) | ((steps[many] - 2) << 4), np.where(steps[many] - 2 < 256, 12, 14)),
        (step_row, 21, words[step_row, kind] | (np.where(n_extra > 0, extra, 0).astype(np.uint64) << inner_bits[step_row, kind].astype(np.uint64)), inner_bits[step_row, kind] + n_extra),
    ]
    row = np.concatenate([p[0] for p in pieces])
    place = np.concatenate([np.full(len(p[0]), p[1]) for p in pieces])
    value = np.concatenate([np.asarray(p[2]).astype(np.uint64) for p in pieces])
    n = np.concatenate([np.broadcast_to(np.asarray(p[3]), p[0].shape) for p in pieces])
    order = np.argsort(row * 22 + place, kind="stable")
    out.put(own[rows][row[order]], value[order], n[order])
    return bits


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix codes, extra bits and their number, of lengths or distances."""
    v = np.maximum(value - 1, 1)
    top = np.frexp(v.astype(np.float64))[1] - 1
    extra = np.maximum(top - 1, 0)
    small = value <= 4
    return np.where(small, value - 1, 2 * top + ((v >> extra) & 1)), np.where(small, 0, v & ((1 << extra) - 1)), np.where(small, 0, extra)


def _references(green: np.ndarray, image: np.ndarray, base: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and distance of back-references of eight pixels or more, which do not overlap. They begin
    after a space or at every eighth pixel, and look back at the last such place with the same eight pixels. An image
    of which they would cover less than one pixel in PAYS has none: their own prefix code would cost more than they save."""
    n = len(green)
    stop = base + count
    gram = np.ndarray((n,), "<u8", np.append(green, np.zeros(8, np.uint8)), strides=(1,))  # the eight pixels from each place on
    begins = np.zeros(n, bool)
    begins[1:] = green[:-1] <= 32
    begins[::8] = True
    spot = np.flatnonzero(begins)
    spot = spot[spot + 8 <= stop[image[spot]]]
    own, key = image[spot].astype(np.uint64), gram[spot]
    old = _earlier(((key * np.uint64(0x9E3779B97F4A7C15) + own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64))
    good = np.flatnonzero((old >= 0) & (key == key[old]) & (own == own[old]))
    own, spot, old = own[good], spot[good], spot[old[good]]
    # Places of one longer match, which look equally far back and lie in each other's eight pixels, end where the last of them ends.
    last = np.ones(len(spot), bool)
    last[:-1] = (np.diff(spot) > 8) | (np.diff(spot - old) != 0) | (own[1:] != own[:-1])
    last = np.flatnonzero(last)
    end, back, left = spot[last] + 8, (spot - old)[last], stop[image[spot[last]]]
    todo = np.flatnonzero(end < left)
    while len(todo):
        at, most = end[todo], left[todo]
        differ = gram[at] ^ gram[at - back[todo]]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
        at = np.minimum(at + same, most)
        end[todo] = at
        todo = todo[(same == 8) & (at < most)]
    length = np.repeat(end, np.diff(last, prepend=-1)) - spot
    # Greedy: of each image the first reference, then the first one after its end, and so on.
    taken = np.zeros(len(spot), bool)
    edge = np.searchsorted(spot, stop)
    now = np.searchsorted(spot, base)
    live = now < edge
    now, edge = now[live], edge[live]
    while len(now):
        taken[now] = True
        now = np.searchsorted(spot, spot[now] + length[now])
        now, edge = now[now < edge], edge[now < edge]
    spot, length, apart = spot[taken], length[taken], (spot - old)[taken]
    covered = np.bincount(image[spot], length, len(count))
    pays = (covered * PAYS >= count)[image[spot]]
    return spot[pays], length[pays], apart[pays]


def _put_images(out: Bitstreams, own: np.ndarray, numbers: np.ndarray, count: np.ndarray, width: np.ndarray, *, cache_bits: int = 0, main: bool = False) -> None:
    """Write entropy-coded images, whose pixels (one number each) stand one image after another."""
    out.put(own, 1 | (cache_bits << 1) if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        out.put(own, 0, 1)  # one group of prefix codes
    n = len(numbers)
    image = np.repeat(np.arange(len(own), dtype=np.int32), count)
    base = np.cumsum(count) - count
    spot, length, apart = _references(numbers.view(np.uint8)[1::4], image, base, count) if main else (np.zeros(0, np.int64),) * 3
    inside = np.zeros(n + 1, np.int8)
    inside[spot + 1] += 1
    inside[spot + length] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
    far = np.searchsorted(at, spot)
    copied = np.zeros(len(at), bool)
    copied[far] = True
    hit = np.zeros(len(at), bool)
    if cache_bits:
        slot = ((numbers * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int32)
        before = _earlier((image << cache_bits) | slot)[at]
        hit = ~copied & (before >= 0) & (numbers[before] == numbers[at])
    plain = ~copied & ~hit
    im = image[at].astype(np.int64)
    pixel = numbers[at]
    green = ((pixel >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    if cache_bits:
        green = np.where(hit, 280 + slot[at], green)
    long_symbol, long_extra, long_bits = _prefixes(length)
    green[far] = 256 + long_symbol
    code = (apart + 120).astype(np.int64)
    wide = width[im[far]]
    for w in sorted(set(wide.tolist())):
        table = np.zeros(8 * w + 9, np.int64)
        for k, (x, y) in reversed(list(enumerate(NEAR))):
            if 0 < x + y * w < len(table):
                table[x + y * w] = k + 1
        some = np.flatnonzero((wide == w) & (apart < len(table)))
        code[some] = np.where(table[apart[some]] > 0, table[apart[some]], code[some])
    far_symbol, far_extra, far_bits = _prefixes(code)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    counts = np.zeros((len(own) * 5, size), np.int64)
    flat = counts.ravel()
    flat += np.bincount(im * 5 * size + green, minlength=counts.size)
    flat += np.bincount((im[far] * 5 + 4) * size + far_symbol, minlength=counts.size)
    some = np.flatnonzero(plain)
    rest = numbers & np.uint32(0xFFFF00FF)
    if n and rest.min() == rest.max():  # only green differs
        rest = int(rest[0])
        for k, shift in ((1, 16), (2, 0), (3, 24)):
            counts[k::5, (rest >> shift) & 255] = 1
    others = [(k, ((pixel[some] >> np.uint32(shift)) & np.uint32(255)).astype(np.int64)) for k, shift in ((1, 16), (2, 0), (3, 24))] if not isinstance(rest, int) else []
    for k, symbol in others:
        flat += np.bincount((im[some] * 5 + k) * size + symbol, minlength=counts.size)
    lengths = code_lengths(counts, _SEVERAL)  # such codes are found in one look-up
    bits = _put_codes(out, np.repeat(own, 5), lengths)
    words = _code_words(lengths)
    words[bits.max(1) == 0] = 0
    place = im * 5 * size + green
    value, n_bits = words.ravel()[place], bits.ravel()[place].astype(np.uint64)

    def add(at: np.ndarray, more: np.ndarray, n_more: np.ndarray) -> None:
        value[at] |= more.astype(np.uint64) << n_bits[at]
        n_bits[at] += n_more.astype(np.uint64)

    for k, symbol in others:
        row = im[some] * 5 + k
        if bits[row, symbol].any():
            add(some, words[row, symbol], bits[row, symbol])
    row = im[far] * 5 + 4
    add(far, long_extra, long_bits)
    add(far, words[row, far_symbol], bits[row, far_symbol])
    add(far, far_extra, far_bits)
    out.put(own[im], value, n_bits)


#: Predictor modes that the media column's encoder chooses from for each block, and bits of the block's side.
TRIED, SIZE_BITS = (0, 1, 2, 12), 5
CACHE_BITS = 5
#: References are used where they cover one pixel in so many.
PAYS = 16
#: An image of so many colours at most gets a palette.
FEW = 40
#: Columns, and rows at most, of a stored image; a byte is a grey pixel.
WIDE, HIGH = 64, 32
#: Pixels of the images that are coded side by side, and bytes of text that a worker holds.
PIXELS, TOGETHER = 1 << 21, 4 << 20


def _entropy(block: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Bits that the values of each block take with a code of their own."""
    count = np.bincount(block * 256 + value, minlength=n * 256).reshape(n, 256).astype(np.float32)
    total = count.sum(1)
    return total * np.log2(np.maximum(total, 1)) - (count * np.log2(np.maximum(count, 1))).sum(1)


def encode_images(grey: np.ndarray, height: np.ndarray) -> list[bytes]:
    """VP8L chunks of opaque grey images of WIDE columns, whose samples stand one image after another.

    An image of FEW colours at most gets a palette, and of 16 at most has several pixels in a byte. Any other gets
    the predictor transform, of the tried modes the one with the least entropy in each block, the
    cross-colour transform, its factors by least squares in each block (which takes red and blue
    away, since they are as green), and a colour cache. All have back-references and prefix codes
    made for the image. The choice depends on the image alone.
    """
    n = len(height)
    count = height * WIDE
    image = np.repeat(np.arange(n), count)
    out = Bitstreams(n)
    every = np.arange(n)
    out.put(every, 0x2F | (WIDE - 1) << 8 | (height - 1) << 22, 40)
    seen = np.zeros((n, 256), bool)
    seen.ravel()[(image << 8) | grey] = True
    colours = seen.sum(1)
    small = colours <= FEW

    for bundled in (False, True):
        own = np.flatnonzero(small & ((colours <= 16) == bundled))
        if not len(own):
            continue
        out.put(own, 1 | PALETTE << 1 | (colours[own] - 1) << 3, 11)
        of, value = np.nonzero(seen[own])
        first = np.concatenate([[True], of[1:] != of[:-1]])
        step = value - np.where(first, 0, np.concatenate([[0], value[:-1]]))
        _put_images(out, own, (step * 0x10101 | np.where(first, 0xFF000000, 0)).astype(np.uint32), colours[own], colours[own])
        at = _ragged(np.cumsum(count)[own] - count[own], count[own])
        row = np.repeat(np.arange(len(own), dtype=np.int32) << 8, count[own])
        packed = (np.cumsum(seen[own], 1, dtype=np.uint8) - np.uint8(1)).ravel()[row + grey[at]]
        bits, wide, coded = _per_byte(colours[own]), np.full(len(own), WIDE), count[own]
        if bundled:
            wide = _blocks(WIDE, bits)
            coded = wide * height[own]
            x, y, _ = _places(count[own], np.full(len(own), WIDE))
            b = np.repeat(bits, count[own])
            to = np.repeat(np.cumsum(coded) - coded, count[own]) + y * np.repeat(wide, count[own]) + (x >> b)
            packed = np.bincount(to, packed.astype(np.int64) << ((8 >> b) * (x & ((1 << b) - 1))), int(coded.sum()))
        out.put(own, 0, 1)
        _put_images(out, own, np.uint32(0xFF000000) | packed.astype(np.uint32) << np.uint32(8), coded, wide, main=True)

    own = np.flatnonzero(~small)
    if len(own):
        p = grey[~small[image]].astype(np.int16)
        x, y, _ = _places(count[own], np.full(len(own), WIDE))
        across = _blocks(WIDE, SIZE_BITS)
        rows = _blocks(height[own], SIZE_BITS)
        sizes = rows * across
        block = np.repeat(np.cumsum(sizes) - sizes, count[own]) + (y >> SIZE_BITS) * across + (x >> SIZE_BITS)
        near = _neighbours(p, np.arange(len(p)), WIDE)
        total = int(sizes.sum())
        best, cost, kept = np.zeros(total, np.int64), np.full(total, np.inf), np.zeros(len(p), np.uint8)
        for mode in TRIED:
            residual = (p - (_predict(mode, *near) if mode else np.int16(0))).astype(np.uint8)
            now = _entropy(block, residual, total)
            better = now < cost
            cost[better], best[better] = now[better], mode
            at = better[block]
            kept = np.where(at, residual, kept)
        for mode, at in ((1, (y == 0) & (x > 0)), (2, (y > 0) & (x == 0)), (0, (y == 0) & (x == 0))):
            at = np.flatnonzero(at)
            kept[at] = (p[at] - (near[mode - 1][at] if mode else 0)).astype(np.uint8)
        out.put(own, 1 | PREDICTOR << 1 | (SIZE_BITS - 2) << 3, 6)
        _put_images(out, own, np.uint32(0xFF000000) | best.astype(np.uint32) << np.uint32(8), sizes, np.full(len(own), across))
        # Red and blue are as green, so their least-squares factors on green are one (32 in the format's units), and red has nothing left for blue.
        factor = np.zeros((total, 4), np.uint8)
        factor[:, 1:] = 32, 32, 255
        out.put(own, 1 | CROSS_COLOUR << 1 | (SIZE_BITS - 2) << 3, 6)
        _put_images(out, own, _numbers(factor), sizes, np.full(len(own), across))
        out.put(own, 0, 1)
        _put_images(out, own, kept.astype(np.uint32) << np.uint32(8), count[own], np.full(len(own), WIDE), cache_bits=CACHE_BITS, main=True)
    return out.chunks()


def _file(chunk: bytes) -> bytes:
    body = b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def _groups(size: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of images of like many pixels in all, about PIXELS at most, or of one image. A small rest makes the others larger: what all
    images of a range do side by side takes as many steps for a few images as for many."""
    out, i, ends = [], 0, np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    most = -(-total // max(1, -(-(total - PIXELS // 4) // PIXELS)))
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most + HIGH * WIDE, side="right")))
        out.append((i, j))
        i = j
    return out


def encode_payloads(payloads: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Bytes (payload k is edges[k] to edges[k + 1], a positive multiple of 64), a grey pixel each, as
    one WebP file or, beyond HIGH rows, several in a row."""
    rows = np.diff(edges) // WIDE
    n = -(-rows // HIGH)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    height = np.minimum(HIGH, np.repeat(rows, n) - k * HIGH)
    first = np.concatenate([[0], np.cumsum(height) * WIDE])
    chunks = [c for i, j in _groups(height * WIDE) for c in encode_images(payloads[first[i] : first[j]], height[i:j])]
    at = np.cumsum(n).tolist()
    return [b"".join(map(_file, chunks[i:j])) for i, j in zip([0, *at[:-1]], at, strict=True)]


def decode_payloads(media: list[bytes]) -> list[np.ndarray]:
    """The bytes of each of the media; all their images are read side by side."""
    chunks = [files(m) for m in media]
    every = [c for own in chunks for c in own]
    size = np.array([((v & 0x3FFF) + 1) * ((v >> 14 & 0x3FFF) + 1) for v in (int.from_bytes(c[1:5], "little") for c in every)], np.int64)
    grey = [x.view(np.uint8)[1::4] for i, j in _groups(size) for x in _decoded(every[i:j])[0]]
    at = np.cumsum([len(c) for c in chunks]).tolist()
    return [np.concatenate(grey[i:j]) for i, j in zip([0, *at[:-1]], at, strict=True)]


#: Texts are filled up with zero bytes to a positive multiple of this.
UNIT = 64


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media: each text's bytes as lossless WebP.

    Null texts are empty, and empty ones are 64 zero bytes. Repeated rows stay, equal texts
    get equal media, an empty table gives no rows. Only doc_id and text are read.
    """

    def run(batches):
        for batch in sliced(batches, "text", TOGETHER):
            data, edge = text_bytes(batch.column("text"))
            size = np.diff(edge)
            edges = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // UNIT)) * UNIT)])
            payloads = np.zeros(int(edges[-1]), np.uint8)
            payloads[np.arange(len(data)) + np.repeat(edges[:-1] - edge[:-1], size)] = data
            media = encode_payloads(payloads, edges)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edge)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and figures of the pixels that the stored bytes decode to."""

    def run(batches):
        for batch in sliced(batches, "media", TOGETHER):
            out = []
            media = batch.column("media").to_pylist()
            for m, payload in zip(media, decode_payloads(media), strict=True):
                change = int(np.abs(np.diff(payload.astype(np.int16))).sum(dtype=np.int64))
                feature = f"{len(payload) // WIDE}x{WIDE} sum {int(payload.sum(dtype=np.int64))} change {change} values {int((np.bincount(payload, minlength=256) > 0).sum())}"
                raw = payload.tobytes()
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_webp(spark, sf_dir):
    """All documents stored as lossless WebP and read back."""
    return read_media(to_media(read_table(spark, sf_dir, "documents")))
