"""Importance resampling towards a target distribution over hashed n-grams.

Every document is weighed by how much likelier its n-grams are in a target corpus than in
the whole one; a noisy draw without replacement then takes the heaviest share. Within a
task, n-grams are interned in an open-addressed NumPy table: their xxhash64 picks the slot,
equal hashes are told apart by their bytes, and each slot carries a bucket and a count, so
that a bucket is worked out once per distinct n-gram and an occurrence is a slot number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.llm.store import stored
from sloframe.llm.textbatch import Slice, slices
from sloframe.operators.ordered import add_positions

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (  # fixed values of the xxhash64 definition
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

# Bytes of words after lower-casing A-Z: digits, letters and all of non-ASCII characters.
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A"): ord("Z") + 1] += 32
_in_word = np.zeros(256, bool)
_in_word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SLICE_BYTES = 1 << 23  # text that one table is made for
_masks = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Spans:
    """Byte spans of one buffer: hashed, compared and read together."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self._data = data
        self._words = np.lib.stride_tricks.as_strided(padded.view(), (len(data) + 1, 8), (1, 1))
        self.starts, self.lengths = starts, ends - starts

    def lane(self, which: np.ndarray, i: int) -> np.ndarray:
        """Bytes ``8 i`` to ``8 i + 8`` of the spans, as little-endian numbers, 0 beyond their ends."""
        left = np.clip(self.lengths[which] - 8 * i, 0, 8)
        at = np.minimum(self.starts[which] + 8 * i, len(self._words) - 1)
        return np.ascontiguousarray(self._words[at]).view("<u8").ravel() & _masks[left]

    def hashes(self) -> np.ndarray:
        """xxhash64 of each span with seed 0. Spans of under 32 bytes go through NumPy, 8 bytes
        at a time over all; the few longer ones through the xxhash library."""
        out = np.empty(len(self.starts), np.uint64)
        short = np.flatnonzero(self.lengths < 32)
        n = self.lengths[short]
        h = _P5 + n.astype(np.uint64)
        for i in range(int(n.max() // 8) if len(n) else 0):
            on = np.flatnonzero(n >= 8 * (i + 1))
            k = _rotated(self.lane(short[on], i) * _P2, 31) * _P1
            h[on] = _rotated(h[on] ^ k, 27) * _P1 + _P4
        # The last 0 to 7 bytes: four at once if there are as many, the rest one by one.
        for lanes in range(int(n.max() // 8) + 1 if len(n) else 0):
            on = np.flatnonzero((n // 8 == lanes) & (n % 8 > 0))
            tail, left = self.lane(short[on], lanes), n[on] % 8
            four = np.flatnonzero(left >= 4)
            x = (tail[four] & np.uint64(0xFFFFFFFF)) * _P1
            h[on[four]] = _rotated(h[on[four]] ^ x, 23) * _P2 + _P3
            tail[four] >>= np.uint64(32)
            left[four] -= 4
            for j in range(3):
                one = np.flatnonzero(left > j)
                x = ((tail[one] >> np.uint64(8 * j)) & np.uint64(0xFF)) * _P5
                h[on[one]] = _rotated(h[on[one]] ^ x, 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[short] = h ^ (h >> np.uint64(32))
        if len(short) < len(out):
            import xxhash

            long = np.flatnonzero(self.lengths >= 32)
            out[long] = [xxhash.xxh64_intdigest(x) for x in self.read(long)]
        return out

    def read(self, which: np.ndarray) -> Iterator[bytes]:
        body, starts = self._data.tobytes(), self.starts[which]
        return (body[a:b] for a, b in zip(starts.tolist(), (starts + self.lengths[which]).tolist(), strict=True))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans ``a`` and ``b`` have the same bytes."""
        same = self.lengths[a] == self.lengths[b]
        same &= (a == b) | (self.lane(a, 0) == self.lane(b, 0))
        on, i = np.flatnonzero(same & (a != b) & (self.lengths[a] > 8)), 1
        while len(on):
            differ = self.lane(a[on], i) != self.lane(b[on], i)
            same[on[differ]] = False
            i += 1
            on = on[~differ & (self.lengths[a[on]] > 8 * i)]
        return same


@dataclass
class Interned:
    """The table of one slice: ``slot`` of each occurrence; ``owner`` is the span that a slot
    was taken for (-1: free), with ``bucket`` and ``count`` beside it."""

    slot: np.ndarray
    owner: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def interned(spans: Spans, buckets: int, hashes: np.ndarray | None = None) -> Interned:
    """Find or take a slot for every span, all at once and by linear probing: at each step
    every open span looks at its slot, takes it if it is free (one of those that meet there
    wins), stays if the slot's owner has its hash and its bytes, and else moves on by one.
    The table has at least twice as many slots as there are spans, so it is never full."""
    hashes = spans.hashes() if hashes is None else hashes
    size = 1 << max(4, int(2 * len(hashes)).bit_length())
    mask = size - 1
    owner = np.full(size, -1, np.int64)
    slot = np.empty(len(hashes), np.int64)
    open_ = np.arange(len(hashes))
    at = (hashes & np.uint64(mask)).astype(np.int64)
    while len(open_):
        free = owner[at] < 0
        owner[at[free]] = open_[free]
        holder = owner[at]
        same = hashes[holder] == hashes[open_]
        same[same] = spans.equal(holder[same], open_[same])
        slot[open_[same]] = at[same]
        open_, at = open_[~same], (at[~same] + 1) & mask
    taken = np.flatnonzero(owner >= 0)
    bucket = np.zeros(size, np.int64)
    bucket[taken] = np.array([zlib.crc32(x) for x in spans.read(owner[taken])], np.int64) % buckets
    return Interned(slot, owner, bucket, np.bincount(slot, minlength=size))


def grams(part: Slice, longest: int) -> tuple[Spans, np.ndarray, np.ndarray]:
    """Spans of all runs of 1 to ``longest`` words over the slice's words joined by single
    spaces, the text of each span, and the number of words of each text."""
    lower = _lower[part.data]
    inside = _in_word[lower]
    starts, ends, text = part.spans(inside)
    keep = inside.copy()
    # The byte after a word stands for the space; a word that ends the slice needs none.
    keep[ends[ends < len(keep)]] = True
    data = np.where(inside, lower, np.uint8(32))[keep]
    # A word that begins right where another text's word ends has no byte between the two.
    place = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    starts, ends = place[starts], place[ends]
    words = np.bincount(text, minlength=part.stop - part.start)
    all_starts, all_ends, owners = [], [], []
    for n in range(1, longest + 1):
        if len(starts) < n:
            break
        whole = text[: len(text) - n + 1] == text[n - 1:]
        all_starts.append(starts[: len(starts) - n + 1][whole])
        all_ends.append(ends[n - 1:][whole])
        owners.append(text[: len(text) - n + 1][whole])
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return Spans(data, join(all_starts), join(all_ends)), join(owners), words


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """``bucket``, ``n``: occurrences of the n-grams of all texts per bucket (crc32 of the
    UTF-8 bytes modulo ``buckets``). A task emits each bucket at most once, so at most
    ``buckets`` rows of it are shuffled. Buckets without occurrences are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                spans, _, _ = grams(part, longest)
                table = interned(spans, buckets)
                np.add.at(total, table.bucket, table.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) per bucket, from counts of the
    corpus (s, in all S) and of the target (t, in all T). The driver holds ``buckets``
    numbers, a parameter, whatever the size of the corpus."""

    def filled(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for bucket, n in counts.select("bucket", "n").collect():  # at most `buckets` rows
            out[bucket] = n
        return out

    s, t = filled(raw), filled(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_features`` (n-grams, repeats counted) and ``weight``, the
    floored mean of its n-grams' gains (0 without any)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = [], [], []
            for part in slices(batch, "text", SLICE_BYTES):
                spans, owners, n_words = grams(part, longest)
                table = interned(spans, len(gain))
                rows = part.stop - part.start
                n = np.bincount(owners, minlength=rows)
                total = np.zeros(rows, np.int64)
                np.add.at(total, owners, gain[table.bucket][table.slot])
                words.append(n_words)
                features.append(n)
                weight.append(total // np.maximum(n, 1))
            join = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), join(words), join(features), join(weight)], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(weigh, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("id", id)


def noise(id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
    seed: str = "2024", id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: id, ``n_features``, ``weight``, ``score`` and ``rank``.

    The score is the weight plus the id's noise. Of the N rows with at least ``least_words``
    words, the floor(``percent`` N / 100) of highest score are drawn and ranked from 1, ties
    going to the smaller id (a null id last, and hashed as an empty text); all other rows
    have a null rank. Scores are whole numbers, so the cutting score comes from a count per
    score, and positions are carried from score to score and from block to block of ids: no
    task sorts the drawn rows whole.

    A null or empty text has no features and weight 0. Rows that repeat an id count as rows
    of their own, with the same noise; among equal scores and ids more features come first.
    An empty target gives gains towards rare buckets; an empty table gives an empty result.
    Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, longest, buckets, text), bucket_counts(target, longest, buckets, target_text), buckets)
    scored = weights(docs, gain, longest, id, text)
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col(id), seed)), "importance")
    able = F.col("n_words") >= least_words
    counts = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    wanted = scored.filter(able).count() * percent // 100
    # One row per distinct score: whole thousandths of a log ratio plus noise of 32 bits.
    reached, cut = 0, None
    for score, n in counts.orderBy(F.desc("score")).toLocalIterator() if wanted else ():
        reached += n
        if reached >= wanted:
            cut = score
            break
    columns = [F.col(id), "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = able & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last(id), F.desc("n_features"), F.desc("weight")]
    numeric = scored.schema[id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    block = F.coalesce(F.floor(F.col(id) / 65_536), F.lit((1 << 62))) if numeric else F.lit(0)
    placed = add_positions(scored.filter(near), [], [-F.col("score"), block], order, "place")
    rank = F.when(F.col("place") < wanted, F.col("place") + 1).cast("long")
    return placed.select(*columns, rank.alias("rank")).unionByName(scored.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
