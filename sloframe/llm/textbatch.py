"""Whole texts of Arrow batches as byte arrays, cut into documents, words and spans.

All of it works on UTF-8 bytes: the white space ``[\\x20\\x09-\\x0D]`` and ``A-Z`` are
ASCII, so byte positions never split a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

WHITE = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 21

_is_white = np.zeros(256, bool)
_is_white[list(WHITE)] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A"): ord("Z") + 1] += 32

# One random 64-bit value per byte value, and an odd base: spans hash to
# sum(value[byte] * base ** place) mod 2 ** 64.
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse for i up to ``n``."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column as binary with nulls as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.fill_null("").cast(pa.large_binary())


@dataclass
class Slice:
    """Consecutive rows ``start`` to ``stop`` of a batch; ``offsets`` cut ``data`` into texts."""

    start: int
    stop: int
    data: np.ndarray
    offsets: np.ndarray
    sums: dict[bool, np.ndarray] = field(default_factory=dict, repr=False)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]: self.offsets[i + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each maximal run of ``inside`` within a text."""
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (edge[:-1] | ~before))
        ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each word ``[^\\x20\\x09-\\x0D]+``."""
        return self.spans(~_is_white[self.data])

    def _sums(self, lower: bool) -> np.ndarray:
        """Running sums that spans are hashed from; kept for the next call."""
        if lower not in self.sums:
            n = len(self.data)
            self.sums[lower] = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUE[_lower[self.data] if lower else self.data] * powers(n)[0][:n], out=self.sums[lower][1:])
        return self.sums[lower]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of the bytes of each span; equal bytes give equal hashes anywhere."""
        total = self._sums(lower)
        return mix((total[ends] - total[starts]) * powers(len(self.data))[1][starts])

    def gram_hashes(self, size: int) -> np.ndarray:
        """``hashes`` of all spans of ``size`` bytes, in order of their starts."""
        total, n = self._sums(False), len(self.data) - size + 1
        return mix((total[size:] - total[:-size]) * powers(len(self.data))[1][:n])


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch into runs of whole texts of about ``limit`` bytes (one longer text is
    a run of its own), so that working arrays stay small however large the batch is."""
    column = text_column(batch, name)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield Slice(start, stop, data[offsets[start]: offsets[stop]], offsets[start: stop + 1] - offsets[start])
        start = stop


def run_starts(keys: np.ndarray) -> np.ndarray:
    """First place of each run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
