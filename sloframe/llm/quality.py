"""Quality rules: fixed counts per text and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are compared: one of trusted documents (the
target), one of the whole corpus. A text's score is its log-likelihood ratio per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloframe.llm.textbatch import Slice, mix, slices

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
SCALE = 1 << 20  # ratios are kept as whole multiples of 1 / SCALE, so sums are exact
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
THRESHOLD = -0.4  # nats per n-gram

_is_symbol = np.zeros(256, bool)
_is_symbol[list(SYMBOLS)] = True


@dataclass
class RatioModel:
    """Fixed-point log ratio of each bucket."""

    ratios: np.ndarray


def _grams(s: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and bucket of the n-grams of each order that lie within one text."""
    n = len(s.data)
    left = np.repeat(s.offsets[1:], np.diff(s.offsets)) - np.arange(n)  # bytes to the text's end
    packed = s.data.astype(np.uint32)
    for order in range(2, max(ORDERS) + 1):
        if n < order:
            return
        packed = (packed[:-1] << np.uint32(8)) | s.data[order - 1:]
        if order in ORDERS:
            buckets = ((packed + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
            at = np.flatnonzero(left[: len(packed)] >= order)
            yield at, buckets[at]


def trusted_sample(labels: DataFrame, id: str = "doc_id", good: str = "quality = 1 AND toxic = 0", most: int = 20_000) -> list:
    """Ids of trusted documents: the ``most`` labelled rows that are ``good`` and whose
    hashed id is smallest. The bound is this parameter; nulls and repeats are left out."""
    ids = labels.filter(good).filter(F.col(id).isNotNull()).select(F.col(id).alias("id")).distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64("id"), "id").limit(most).collect()]


def ratio_model(docs: DataFrame, trusted: list, id: str = "doc_id", text: str = "text", smoothing: float = 1.0) -> RatioModel:
    """Count n-grams of all documents, and of the trusted ones, and compare them.

    Each task sums its counts before the shuffle; what reaches the driver is a row per
    bucket, whatever the size of the corpus. Without trusted documents or text every
    ratio is 0.
    """
    spark = docs.sparkSession
    chosen = spark.sparkContext.broadcast(frozenset(trusted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = np.array([x in chosen.value for x in batch.column(0).to_pylist()], bool)
            for s in slices(batch, "text"):
                own = np.repeat(good[s.start: s.stop], np.diff(s.offsets))
                for at, buckets in _grams(s):
                    raw += np.bincount(buckets, minlength=BUCKETS)
                    target += np.bincount(buckets[own[at]], minlength=BUCKETS)
        found = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(raw[found]), pa.array(target[found])], ["bucket", "raw", "target"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counted.collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return RatioModel(np.zeros(BUCKETS, np.int64))
    share = lambda x: np.log((x + smoothing) / (x.sum() + smoothing * BUCKETS))
    return RatioModel(np.rint((share(target) - share(raw)) * SCALE).astype(np.int64))


def _repeat_words(s: Slice, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per text, words in 3-word windows that the text has twice or more."""
    covered = np.zeros(len(words), np.int64)
    if len(words) > 2:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        odd = np.uint64(0xD6E8FEB86659FD93)
        window = mix((words[at] * odd + words[at + 1]) * odd + words[at + 2]) + mix(owner[at].astype(np.uint64))
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = 1
    return np.bincount(owner, weights=covered, minlength=len(s.offsets) - 1).astype(np.int64)


def _repeat_lines(s: Slice) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line."""
    starts, ends, owner = s.spans(s.data != ord("\n"))
    solid = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum((s.data != 32) & ((s.data < 9) | (s.data > 13)), out=solid[1:])
    has_word = solid[ends] > solid[starts]
    starts, ends, owner = starts[has_word], ends[has_word], owner[has_word]
    _, first = np.unique(s.hashes(starts, ends) + mix(owner.astype(np.uint64)), return_index=True)
    n = len(s.offsets) - 1
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


def _measure(s: Slice, model: RatioModel, threshold: float) -> dict[str, np.ndarray]:
    starts, ends, owner = s.words()
    n = len(s.offsets) - 1
    character = (s.data & 0xC0) != 0x80
    white = (s.data == 32) | ((s.data >= 9) & (s.data <= 13))
    out = {
        "n_words": np.bincount(owner, minlength=n), "word_chars": s.per_text(character & ~white), "n_symbols": s.per_text(_is_symbol[s.data]),
        "n_dup_lines": _repeat_lines(s), "n_repeat_words": _repeat_words(s, s.hashes(starts, ends), owner),
    }
    total, grams = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at, buckets in _grams(s):
        value, one = np.zeros(len(s.data), np.int64), np.zeros(len(s.data), np.int64)
        value[at], one[at] = model.ratios[buckets], 1
        total += s.per_text(value)
        grams += s.per_text(one)
    out["score"] = total / np.maximum(grams, 1) / SCALE
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (total >= np.ceil(threshold * SCALE) * grams)
    return out


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "score": "double", "base_failed": "boolean", "kept": "boolean"}


def judge_documents(docs: DataFrame, model: RatioModel, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id, the base counts, ``score``, ``base_failed`` and ``kept``.

    A text fails the base with fewer than 50 words, or if more than half of its words lie
    in 3-word windows it has twice. Else it is kept if its log-likelihood ratio per n-gram
    is at least ``threshold`` (0: as likely in trusted text as in the corpus; somewhat less
    likely is let pass, for clean texts with odd words stay near 0). Ratios are whole numbers, so a verdict does not depend on how rows are batched. A null or empty
    text has no words and fails. Rows are independent; null and repeated ids are kept as
    they are; other columns are ignored.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text"):
                found = _measure(s, shared.value, threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, s.stop - s.start), *(pa.array(found[c]) for c in COLUMNS)], ["id", *COLUMNS])

    schema = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return rows.mapInArrow(judge, f"id {rows.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id)


def keep_documents(docs: DataFrame, model: RatioModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge_documents`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_measure(s, shared.value, threshold)["kept"] for s in slices(batch, text)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(keep, docs.schema)
