"""Resamples of whole groups, counted as arrays in a task.

A draw is an MD5, so a resample of n rows costs n of them; here many are worked out side by
side in NumPy, only as far as their first four bytes, and once for all groups of a task:
draw j of resample r has the same digest in each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
LANES = 32_768  # digests that are worked out at once: their arrays stay in the core's cache
SUMS = ["n", "sa", "sb", "saa", "sbb", "sab"]


def _first_word(words: list, shape: tuple[int, int]) -> np.ndarray:
    """The first four bytes of the MD5 of one block, as a big-endian number. ``words`` has the
    16 words of the block: a number if all messages have the same, or an array."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f = np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps change other words only
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[k], int):
            f += np.uint32((_SINES[i] + words[k]) & 0xFFFFFFFF)
        else:
            f += words[k]
            f += np.uint32(_SINES[i])
        by = _SHIFTS[i // 16][i % 4]
        np.left_shift(f, np.uint32(by), out=a)
        f >>= np.uint32(32 - by)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(_START[0])
    return b.byteswap()


def _digits(start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Parts of a range of numbers of 0 or more that have equally many digits."""
    while start < stop:
        end = min(stop, 10 ** len(str(start)))
        yield start, end
        start = end


class Digests:
    """``hash32`` of ``seed|r|j`` for resamples r and draws j."""

    def __init__(self, seed: int):
        self.seed = seed
        self.kept: dict[tuple[int, int, int], dict[int, np.ndarray]] = {}
        self.length = -1

    def _numbers(self, at: int, start: int, stop: int) -> dict[int, np.ndarray]:
        """The words that the digits of draws fill when they begin at byte ``at``."""
        if at != self.length:  # resamples come in order: another length is not seen again
            self.kept.clear()
            self.length = at
        words = self.kept.get((at, start, stop))
        if words is None:
            words, j, n = {}, np.arange(start, stop, dtype=np.uint32), len(str(start))
            for k in range(n):
                place = at + k
                digit = (j // np.uint32(10 ** (n - 1 - k)) % np.uint32(10) + np.uint32(48)) << np.uint32(8 * (place % 4))
                words[place // 4] = words[place // 4] | digit if place // 4 in words else digit
            self.kept[at, start, stop] = words
        return words

    def of(self, resamples: range, n: int) -> np.ndarray:
        """One row per resample (all of equally many digits), one column per draw."""
        heads = [f"{self.seed}|{r}|".encode() for r in resamples]
        at, out = len(heads[0]), np.empty((len(heads), n), np.uint32)
        width = max(1, LANES // len(heads))
        for low, high in _digits(0, n):
            size = at + len(str(low))
            if size > 55:
                raise ValueError("the text of a draw is longer than a block")
            rest = bytes(size - at) + b"\x80"
            blocks = np.array([np.frombuffer((head + rest).ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4") for head in heads])
            same = [int(w[0]) if (w == w[0]).all() else w[:, None] for w in blocks.T]
            for start in range(low, high, width):
                stop = min(high, start + width)
                words = list(same)
                for k, digits in self._numbers(at, start, stop).items():
                    words[k] = np.bitwise_or(np.asarray(words[k], np.uint32), digits[None, :])
                out[:, start:stop] = _first_word(words, (len(heads), stop - start))
        return out


class Group:
    """Values of one group, by place; equal pairs of values are one cell."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n = len(a)
        # Largest first; a value that is not a number is larger than all.
        (_, a_code), (distinct, b_code) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        cells, cell = np.unique((a_code.max() - a_code) * len(distinct) + (len(distinct) - 1 - b_code), return_inverse=True)
        self.cell, self.cells = cell.astype(np.int32), len(cells)
        self.a_code, self.b_code = (x.astype(np.int32) for x in (cells // len(distinct), cells % len(distinct)))
        self.by_b = np.argsort(self.b_code, kind="stable").astype(np.int32)
        self.a_starts, self.b_starts = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (self.a_code, self.b_code[self.by_b]))

    def sums(self, digests: np.ndarray) -> list[np.ndarray]:
        """Per row of digests the ``SUMS`` over its draws' ranks, tied ones averaged."""
        rows = len(digests)
        drawn = self.cell[digests[:, : self.n] % np.uint32(self.n)]
        if rows > 1:
            drawn = drawn + (np.arange(rows) * self.cells)[:, None]
        counts = np.bincount(drawn.ravel(), minlength=rows * self.cells).reshape(rows, self.cells)
        out, ranks = [np.full(rows, self.n)], []
        for c, starts in ((counts, self.a_starts), (counts[:, self.by_b], self.b_starts)):
            c = np.add.reduceat(c, starts, axis=1)
            rank = np.cumsum(c, axis=1) - (c - 1) / 2.0
            ranks.append((c, rank))
        weighed = [c * rank for c, rank in ranks]
        out += [w.sum(axis=1) for w in weighed]
        out += [(w * rank).sum(axis=1) for w, (_, rank) in zip(weighed, ranks, strict=True)]
        both = counts * ranks[0][1][:, self.a_code]
        both *= ranks[1][1][:, self.b_code]
        return [*out, both.sum(axis=1)]


def resampled(groups: list[Group], seed: int, resamples: range) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(group's number, resamples, ``SUMS``) for all groups and resamples, some at a time.
    Groups of like sizes share their digests."""
    classes: dict[int, list[int]] = {}
    for i, group in enumerate(groups):
        classes.setdefault(group.n.bit_length() // 4, []).append(i)
    for members in classes.values():
        most = max(groups[i].n for i in members)
        digests, step = Digests(seed), max(1, 2 * LANES // most)
        for low, high in _digits(resamples.start, resamples.stop):
            for start in range(low, high, step):
                some = range(start, min(high, start + step))
                drawn = digests.of(some, most)
                for i in members:
                    yield i, np.arange(some.start, some.stop), groups[i].sums(drawn)


def resample_table(table: pa.Table, by: list[str], seed: int, resamples: int) -> pa.Table:
    """Sums per group and resample from packed rows (``by``, ``__block``, arrays ``__a`` and
    ``__b`` in the order of places) of whole groups; ``__slice`` of ``__slices`` says which
    resamples to draw."""
    part, parts = table.column("__slice")[0].as_py(), table.column("__slices")[0].as_py()
    some = range(part * resamples // parts, (part + 1) * resamples // parts)
    keys = [repr(list(row.values())) for row in table.select(by).to_pylist()] if by else [""] * len(table)
    blocks: dict[str, list[tuple[int, int]]] = {}
    for i, (key, block) in enumerate(zip(keys, table.column("__block").to_pylist(), strict=True)):
        blocks.setdefault(key, []).append((block, i))
    groups, firsts = [], []
    for found in blocks.values():
        order = [i for _, i in sorted(found)]
        a, b = (np.concatenate([table.column(c)[i].values.to_numpy() for i in order]) for c in ("__a", "__b"))
        groups.append(Group(a, b))
        firsts.append(order[0])
    owners, numbers, sums = [], [], [[] for _ in SUMS]
    for i, r, values in resampled(groups, seed, some):
        owners.append(np.full(len(r), firsts[i]))
        numbers.append(r)
        for into, value in zip(sums, values, strict=True):
            into.append(value)
    rows = table.select(by).take(pa.array(np.concatenate(owners))) if by else None
    kinds = [pa.int64(), *[pa.float64()] * (len(SUMS) - 1)]
    columns = [pa.array(np.concatenate(numbers), pa.int64()), *[pa.array(np.concatenate(s), kind) for s, kind in zip(sums, kinds, strict=True)]]
    return pa.table([*(rows.columns if by else []), *columns], [*by, "__r", *SUMS])
