"""A run-length index of a text: a run-compressed Burrows-Wheeler transform with the text
positions of run ends, which streams matching statistics of many patterns at once."""

from __future__ import annotations

import numpy as np

from sloframe.llm.textbatch import run_starts


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first ``depth`` bytes (by prefix doubling)."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(7):  # bytes are at most 8 bits and 0 only ends the text
        key = (key << np.uint64(8)) | padded[k: k + n]
    known = 7
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])).astype(np.uint64)
        if known >= depth or rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.uint64)
        after[: max(0, n - known)] = rank[known:]
        key = (rank << np.uint64(32)) | after
        known *= 2


class RunIndex:
    """Index of ``text`` (bytes 1 to 255; byte 0 is put at its end). Suffixes are sorted by
    ``depth`` bytes at least, so matches are found up to that length."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text = np.append(text, 0).astype(np.uint8)
        self.depth = depth
        order = suffix_order(self.text, depth + 1)
        bwt = self.text[order - 1]
        starts = run_starts(bwt)
        self.starts, self.chars = starts, bwt[starts].astype(np.int64)
        lengths = np.diff(np.append(starts, len(bwt)))
        self.first, self.last = order[starts], order[np.append(starts[1:], len(bwt)) - 1]
        by_char = np.argsort(self.chars, kind="stable")
        self.keys = self.chars[by_char] * len(starts) + by_char  # runs by character, then place
        self.by_char = by_char
        # Where a run goes in the first column: after all smaller characters and the same
        # character's earlier runs.
        self.goes = np.empty(len(starts), np.int64)
        self.goes[by_char] = np.cumsum(np.append(0, lengths[by_char]))[:-1]

    def _agreement(self, patterns: np.ndarray, rows: np.ndarray, place: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes by which the text from ``at`` agrees with the patterns from ``place``."""
        out = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        for a in range(0, int(most.max(initial=0)), 16):
            step = np.arange(a, a + 16)
            x = self.text[np.minimum(at[left, None] + step, len(self.text) - 1)]
            y = patterns[rows[left, None], np.minimum(place[left, None] + step, patterns.shape[1] - 1)]
            equal = x == y
            good = np.where(equal.all(axis=1), 16, equal.argmin(axis=1))
            out[left] += good
            left = left[(good == 16) & (most[left] > a + 16)]
            if not len(left):
                break
        return np.minimum(out, most)

    def matching_statistics(self, patterns: np.ndarray) -> np.ndarray:
        """For each place of each row, how long a match starts there (``depth`` at most).

        Rows are read from their ends. While the byte before the match is the byte of the
        transform, the match grows by it; else it moves to the nearest run of that byte
        above or below, whichever keeps more of the match, found by the run's sample.
        """
        count, width = patterns.shape
        out = np.zeros((count, width), np.int32)
        place = np.zeros(count, np.int64)  # in the transform
        length = np.zeros(count, np.int64)
        runs = len(self.starts)
        for i in range(width - 1, -1, -1):
            c = patterns[:, i].astype(np.int64)
            run = np.searchsorted(self.starts, place, side="right") - 1
            off = np.flatnonzero(self.chars[run] != c)
            if len(off):
                wanted = c[off]
                below = np.searchsorted(self.keys, wanted * runs + run[off])
                up, down = np.maximum(below - 1, 0), np.minimum(below, runs - 1)
                up, down = self.by_char[up], self.by_char[down]
                has_up, has_down = self.chars[up] == wanted, self.chars[down] == wanted
                after = np.full(len(off), i + 1)
                most = np.minimum(length[off], self.depth)
                by_up = np.where(has_up, self._agreement(patterns, off, after, self.last[up], np.where(has_up, most, 0)), -1)
                by_down = np.where(has_down, self._agreement(patterns, off, after, self.first[down], np.where(has_down, most, 0)), -1)
                take_up = by_up >= by_down
                run[off] = np.where(take_up, up, down)
                place[off] = np.where(take_up, self.starts[np.minimum(up + 1, runs - 1)] - 1, self.starts[down])
                last_run = take_up & (up == runs - 1)
                place[off[last_run]] = len(self.text) - 1
                length[off] = np.maximum(by_up, by_down)
            place = self.goes[run] + place - self.starts[run]
            length = length + 1
            gone = np.flatnonzero(length == 0)  # a byte that the text doesn't have
            place[gone] = 0
            length = np.minimum(length, self.depth)
            out[:, i] = length
        return out
