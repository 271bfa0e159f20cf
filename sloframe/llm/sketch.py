"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text becomes a set of 64-bit paragraph digests, and the set a sketch: every digest is added
to one cell of each of three parts, and a cell holds a count, the sum of its digests and the
sum of their check values (all modulo 2 ** 64). The sketches of two versions subtract cell by
cell, so that what they share cancels; a cell that then holds a single digest gives it away,
and taking it out of its other cells opens more. If some cells stay closed, both versions are
sketched again with twice the cells and other hashes, until the difference is recovered.

A paragraph is a run of words within a line that ends at the line's end or at a word whose
hash is 0 modulo ``EVERY``; an edit therefore changes only the paragraphs around it, in texts
of few and long lines too. A paragraph's second occurrence in a text has a digest of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloframe.llm.textbatch import Slice, mix, run_starts, text_column

EVERY = 4
HASHES = 3
#: Cells of each of the three parts in a fingerprint, that is in the smallest sketch; a power of 2.
PART = 8
SLICE_BYTES = 1 << 21
#: Paragraphs that are sketched together at one size.
GROUP = 1 << 18
BLOCK_BYTES = 8 << 20
MOST_BLOCKS = 20_000
_CELL = np.dtype([("count", "<i4"), ("keys", "<u8"), ("checks", "<u8")])
_ODD = 0x9E3779B97F4A7C15  # spreads small numbers over 64 bits


@dataclass
class Digests:
    """Paragraph digests of several texts; text ``i`` has ``keys[first[i]: first[i + 1]]``."""

    keys: np.ndarray
    first: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All digests of the named texts, and for each the place of its text among them."""
        n = self.sizes()[texts]
        owner = np.repeat(np.arange(len(texts)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return self.keys[self.first[texts][owner] + offset], owner


def _grouped(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal digests of one owner stand together, and where each run begins."""
    both = mix(keys + owner.astype(np.uint64) * np.uint64(_ODD))
    order = np.argsort(both)
    return order, run_starts(both[order])


def digests(part: Slice, every: int = EVERY) -> Digests:
    """Paragraph digests of the texts of a slice."""
    starts, ends, text = part.words()
    n_texts = part.stop - part.start
    if not len(starts):
        return Digests(np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64))
    lines = np.cumsum(part.data == 10)
    last = np.ones(len(starts), bool)
    last[:-1] = (text[1:] != text[:-1]) | (lines[starts[1:]] != lines[starts[:-1]])
    closes = last | (part.hashes(starts, ends) % np.uint64(every) == 0)
    opens = np.ones(len(starts), bool)
    opens[1:] = closes[:-1]
    keys, owner = part.hashes(starts[opens], ends[closes]), text[opens]
    # Number the occurrences of equal paragraphs of a text.
    order, begin = _grouped(keys, owner)
    nth = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
    keys[order] += mix(nth.astype(np.uint64) * np.uint64(_ODD))
    first = np.zeros(n_texts + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n_texts), out=first[1:])
    return Digests(keys, first)


def _places(keys: np.ndarray, owner: np.ndarray, level: int) -> list[np.ndarray]:
    """Cell of each digest in each part of its text's sketch, with ``PART << level`` cells a part."""
    part = PART << level
    base = owner.astype(np.int64) * (HASHES * part)
    salts = [np.uint64((HASHES * level + i + 1) * _ODD % 2**64) for i in range(HASHES)]
    return [base + i * part + (mix(keys + salt) & np.uint64(part - 1)).astype(np.int64) for i, salt in enumerate(salts)]


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))


@dataclass
class Cells:
    """The cells of several sketches of one size, one after the other."""

    count: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    def __sub__(self, other: Cells) -> Cells:
        return Cells(self.count - other.count, self.keys - other.keys, self.checks - other.checks)


def sketches(texts: Digests, which: np.ndarray, level: int) -> Cells:
    """Sketches of the named texts with ``3 * PART << level`` cells each."""
    keys, owner = texts.of(which)
    n = len(which) * HASHES * (PART << level)
    cells = Cells(np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint64))
    check = _check(keys)
    for at in _places(keys, owner, level):
        np.add.at(cells.count, at, np.int32(1))
        np.add.at(cells.keys, at, keys)
        np.add.at(cells.checks, at, check)
    return cells


def peeled(cells: Cells, n: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Take digests out of ``n`` subtracted sketches: the digests, their sketches, their signs
    (1: in the first version only), and which sketches were emptied. ``cells`` is used up."""
    size = HASHES * (PART << level)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    near = np.arange(len(cells.count))
    # Each round takes out at least one digest, unless a false one comes and goes.
    for _ in range(64 + size):
        sign = cells.count[near]
        near = near[np.abs(sign) == 1]
        sign = cells.count[near]
        key = np.where(sign > 0, cells.keys[near], np.uint64(0) - cells.keys[near])
        check = _check(key)
        pure = cells.checks[near] == np.where(sign > 0, check, np.uint64(0) - check)
        near, sign, key, check = near[pure], sign[pure], key[pure], check[pure]
        if not len(near):
            break
        # A digest may stand alone in several of its cells: take it once.
        owner = near // size
        order, begin = _grouped(key, owner)
        order = order[begin]
        key, owner, sign, check = key[order], owner[order], sign[order], check[order]
        signed = np.where(sign > 0, key, np.uint64(0) - key), np.where(sign > 0, check, np.uint64(0) - check)
        found.append((key, owner, sign))
        places = _places(key, owner, level)
        for at in places:
            np.subtract.at(cells.count, at, sign)
            np.subtract.at(cells.keys, at, signed[0])
            np.subtract.at(cells.checks, at, signed[1])
        near = np.concatenate(places)
    closed = ((cells.count != 0) | (cells.keys != 0) | (cells.checks != 0)).reshape(n, size).any(axis=1)
    join = lambda i, kind: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)
    return join(0, np.uint64), join(1, np.int64), join(2, np.int32), ~closed


@dataclass
class Difference:
    """What two versions of each of several texts do not share: digests, the texts that they
    belong to and 1 for removed or -1 for added ones; per text the size of the sketch that
    gave them, and the shared part of all paragraphs."""

    keys: np.ndarray
    owner: np.ndarray
    sign: np.ndarray
    cells: np.ndarray
    likeness: np.ndarray

    def listed(self, sign: int) -> pa.Array:
        """The digests of one sign as a list per text, ascending."""
        on = np.flatnonzero(self.sign == sign)
        on = on[np.lexsort((self.keys[on], self.owner[on]))]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(self.owner[on], minlength=len(self.cells)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.keys[on].view(np.int64), pa.int64()))


def differences(old: Digests, new: Digests) -> Difference:
    """Subtract and peel text by text, and again with larger sketches for those that stay closed.

    The share of cells that a subtracted sketch left at 0 tells how many digests differ; a
    sketch of far too few cells for them is not peeled, and the next one is made large enough
    for them at once. Without a cell at 0 the next one is four times as large.
    """
    n = len(old.first) - 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    cells_of = np.zeros(n, np.int64)
    size_old, size_new = old.sizes(), new.sizes()
    wanted = np.zeros(n, np.int64)  # the level at which each text is tried next; -1: done
    level = 0
    while len(open_ := np.flatnonzero(wanted == level)) or (wanted > level).any():
        size = HASHES * (PART << level)
        load = np.cumsum(size + size_old[open_] + size_new[open_])
        for which in np.split(open_, np.flatnonzero(np.diff(load // GROUP)) + 1):
            cells = sketches(old, which, level) - sketches(new, which, level)
            zero = np.count_nonzero(((cells.count == 0) & (cells.keys == 0)).reshape(len(which), size), axis=1)
            differ = -np.log(np.maximum(zero, 0.05) / size) * (size / HASHES)
            hopeless = differ > size
            if hopeless.any():
                need = np.where(zero > 0, np.log2(1.4 * differ / (HASHES * PART)), level + 1.5)
                wanted[which[hopeless]] = np.maximum(level + 1, np.ceil(need[hopeless]))
                stay = np.repeat(~hopeless, size)
                cells, which = Cells(cells.count[stay], cells.keys[stay], cells.checks[stay]), which[~hopeless]
            keys, owner, sign, done = peeled(cells, len(which), level)
            whole = done[owner]
            found.append((keys[whole], which[owner[whole]], sign[whole]))
            cells_of[which] = size
            wanted[which] = np.where(done, -1, level + 1)
        level += 1
    keys, owner, sign = (np.concatenate(x) for x in zip(*found, strict=True))
    gone, come = (np.bincount(owner[sign == s], minlength=n) for s in (1, -1))
    union = size_old + come
    likeness = np.where(union > 0, (size_old - gone) / np.maximum(union, 1), 1.0)
    return Difference(keys, owner, sign, cells_of, likeness)


def serialised(texts: Digests) -> list[str]:
    """The smallest sketch of each text as base64: cells of count, digests and checks."""
    n = len(texts.first) - 1
    cells = sketches(texts, np.arange(n), 0)
    packed = np.empty(len(cells.count), _CELL)
    packed["count"], packed["keys"], packed["checks"] = cells.count, cells.keys, cells.checks
    body, step = packed.tobytes(), HASHES * PART * _CELL.itemsize
    return [base64.b64encode(body[i * step: (i + 1) * step]).decode() for i in range(n)]


def _cut(column: pa.Array, start: int, stop: int) -> Slice:
    part = column.slice(start, stop - start)
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset: part.offset + len(part) + 1]
    body = part.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return Slice(start, stop, data[offsets[0]: offsets[-1]], offsets - offsets[0])


def _pieces(columns: Sequence[pa.Array]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``SLICE_BYTES`` of text in all columns."""
    n = len(columns[0])
    if n:
        sizes = sum(np.diff(np.frombuffer(c.buffers()[1], np.int64)[c.offset: c.offset + n + 1]) for c in columns)
        bounds = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1).tolist(), n]
        yield from zip(bounds, bounds[1:])


def _compared(columns: Sequence[pa.Array], every: int, recovered: bool) -> list[pa.Array]:
    """Result columns of the first text column against each other one; see ``compare_versions``."""
    own, *rest = (digests(_cut(c, 0, len(c)), every) for c in columns)
    arrays: list[pa.Array] = [pa.array(own.sizes(), pa.int64()), pa.array(serialised(own), pa.string())]
    for other in rest:
        diff = differences(own, other)
        arrays += [pa.array(serialised(other), pa.string()), pa.array(diff.likeness, pa.float64()), pa.array(diff.cells, pa.int64())]
        arrays += [diff.listed(1), diff.listed(-1)] if recovered else []
    return arrays


def _fields(others: Sequence[str], recovered: bool) -> list[tuple[str, str]]:
    fields = [("n_paragraphs", "bigint"), ("fingerprint", "string")]
    for x in others:
        fields += [(f"{x}_fingerprint", "string"), (f"{x}_likeness", "double"), (f"{x}_cells", "bigint")]
        fields += [(f"{x}_removed", "array<bigint>"), (f"{x}_added", "array<bigint>")] if recovered else []
    return fields


def compare_versions(rows: DataFrame, text: str, others: Sequence[str], keep: Sequence[str] = (), every: int = EVERY, recovered: bool = True) -> DataFrame:
    """Compare the column ``text`` with each of the columns ``others``, row by row.

    Returns the columns ``keep``, ``n_paragraphs`` and ``fingerprint`` of ``text``, and for each
    other column X: ``X_fingerprint``; ``X_likeness``, shared paragraphs over all paragraphs of
    both (1 for two texts without any); ``X_cells``, the size of the sketch that gave them; and
    with ``recovered`` the digests ``X_removed`` and ``X_added``, ascending as unsigned numbers.
    Equal texts have equal fingerprints. A null is an empty text, whose sketch is empty.
    Digests are 64-bit hashes, so two different paragraphs pass for one with a probability of
    2 ** -64. One row's work grows with its texts, and no row waits for another.
    """
    kept = rows.select(*[F.col(c) for c in keep])
    fields = [(f.name, f.dataType.simpleString()) for f in kept.schema.fields] + _fields(others, recovered)
    names = ["__text", *[f"__other_{i}" for i in range(len(others))]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [text_column(batch, c) for c in names]
            for start, stop in _pieces(columns):
                cut = [c.slice(start, stop - start) for c in [batch.column(i) for i in range(len(keep))] + columns]
                yield pa.RecordBatch.from_arrays(cut[: len(keep)] + _compared(cut[len(keep):], every, recovered), [n for n, _ in fields])

    source = rows.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"), *[F.col(c).cast("string").alias(f"__other_{i}") for i, c in enumerate(others)])
    return source.mapInArrow(compare, ", ".join(f"`{n}` {t}" for n, t in fields))


_LEAST = -(1 << 63)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Ids, texts and next texts of the rows of an ordered block, piece by piece."""
    last: pa.RecordBatch | None = None  # the row whose follower is still to come
    for batch in batches:
        if not len(batch):
            continue
        texts = text_column(batch, "text")
        for start, stop in _pieces([texts]):
            piece = batch.slice(start, stop - start)
            whole = piece if last is None else pa.Table.from_batches([last, piece]).combine_chunks().to_batches()[0]
            n_own = int(np.count_nonzero(~whole.column("ahead").to_numpy(zero_copy_only=False)))
            n = min(n_own, len(whole) - 1)
            if n:
                ids = np.ma.masked_equal(whole.column("key").slice(0, n).to_numpy(), _LEAST)
                yield pa.array(ids, pa.int64(), from_pandas=True), whole.column("text").slice(0, n), whole.column("text").slice(1, n)
            last = whole.slice(n, 1) if n < n_own else None
            if n_own < len(whole):
                return


def _in_order(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Columns ``key``, ``text`` and ``ahead`` in the order and the blocks of ``with_next``."""
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_LEAST)).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = min(MOST_BLOCKS, n_bytes // BLOCK_BYTES + 1)
    cuts = rows.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks + 1)], max(10_000, 10 * blocks)).alias("cuts"), F.max("key").alias("most")).first()
    ids = np.unique(np.array([*(cuts["cuts"] or []), *([] if cuts["most"] is None else [cuts["most"]])], np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            block = np.searchsorted(ids, key)
            opens = np.flatnonzero(ids[block] == key) if len(key) else np.zeros(0, np.int64)
            own = np.zeros(len(key), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block, pa.int32()), pa.array(own)], ["key", "text", "block", "ahead"])
            if len(opens):
                taken = batch.take(pa.array(opens))
                # Ids fall, so the block before holds the ids above; the highest follow the lowest.
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array((block[opens] + 1) % len(ids), pa.int32()), pa.array(~own[opens])], ["key", "text", "block", "ahead"])

    dealt = rows.mapInArrow(deal, "key long, text string, block int, ahead boolean").repartitionById(max(1, len(ids)), F.col("block"))
    return dealt.sortWithinPartitions("ahead", F.desc("key"), "text").select("key", "text", "ahead")


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``id``, ``text`` and ``next_text``: the text of the row that follows by
    descending id, the first row's after the last. A null text is empty.

    ``id`` is an integer; a null id comes after all others, and rows that repeat an id follow
    each other by their texts. The ids' quantiles, actual ids, cut the order into blocks of
    about ``BLOCK_BYTES``, one task each (at most ``MOST_BLOCKS``; a task streams its sorted
    block, so a large one needs no more memory). The row that opens a block is also sent to
    the block before, whose last row it follows. Texts are shuffled once.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in _followed(batches):
            yield pa.RecordBatch.from_arrays(list(arrays), ["id", "text", "next_text"])

    return _in_order(docs, id, text).mapInArrow(follow, "id long, text string, next_text string").withColumnsRenamed({"id": id, "text": text})


def edited(text: str, other: str) -> str:
    """``text`` with its last half (floor of the code points) replaced by as many first code
    points of ``other``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprint_edits(docs: DataFrame, id: str = "doc_id", text: str = "text", recovered: bool = True) -> DataFrame:
    """Every row's text against its edited text and against the next one, see ``with_next``,
    ``edited`` and ``compare_versions``. Returns id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next`` and the columns
    that ``compare_versions`` adds. Other columns are ignored; an empty table gives an empty
    result, and a table of one row is its own next. The texts go to Python once, as the
    ordered block is read."""
    fields = [("id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), *_fields(["edited", "next"], recovered)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, others in _followed(batches):
            old, new = texts.to_pylist(), []
            for a, b in zip(old, others.to_pylist(), strict=True):
                new.append(edited(a, b).encode())
            arrays = [ids, pa.array([len(a) for a in old], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in new], pa.string())]
            binary = pa.large_binary()
            arrays += _compared([texts.cast(binary), pa.array(new, binary), others.cast(binary)], EVERY, recovered)
            yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])

    out = _in_order(docs, id, text).mapInArrow(compare, ", ".join(f"`{n}` {t}" for n, t in fields))
    return out.withColumnsRenamed({"id": id, "edited_likeness": "near_edited", "next_likeness": "near_next"})
