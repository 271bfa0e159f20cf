"""Scoring texts with a Brown class-based bigram model, and with a unigram base.

p(word | previous) = p(class | previous class) * p(word | class). Exchange clustering
assigns frequent words to classes on the driver; from these every other word that the
training text has twice or more gets its class by exchange in Spark. Words seen once are
a class, words outside the training text another, and the end of a text is one too.

Texts are read once, into blocks of some megabytes: a block lists its distinct words and
holds its texts as places in that list. Counts of all words are one distributed table;
only what a block's own words need from it goes back to the block. Blocks and table meet as
arrays, a part of all hashes at a time, and not as a row per word and block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloframe.llm.store import release, stored
from sloframe.llm.textbatch import run_starts, slices

BLOCK_BYTES = 1 << 23
CLASSES = 64  # of words seen twice or more
ONCE, UNSEEN, END = CLASSES, CLASSES + 1, CLASSES + 2
ALL = CLASSES + 3
SHARE = 5e-5  # a word with this share of the training tokens is frequent; so 20,000 at most
SWEEPS = 8
REST_SWEEPS = 2  # of the other words after their first, each of one half of them
PART_TERMS = 1 << 20  # listed terms of a part of the tables of words
LEAST_PARTS = 128
END_TERM = 0  # what the empty string hashes to


def _planes(values: np.ndarray) -> bytes:
    """32-bit values byte plane by byte plane, which compresses well when most are small."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def held_out(id) -> bool:
    """Whether a document is kept from training; a null id is an empty text."""
    return zlib.crc32(b"" if id is None else str(id).encode()) % 10 == 0


def read_blocks(docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per block: ``block``, ``ids``, ``held`` and ``lengths`` (tokens, ends included) of
    its documents, ``terms`` (distinct hashes), ``counts`` (in training texts) and
    ``tokens`` (places in terms, the end of each text included)."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
            tokens, lengths = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            apart = np.array([held_out(x) for x in ids.to_pylist()], bool)
            order = np.argsort(tokens, kind="stable")
            starts = run_starts(tokens[order])
            terms, n = tokens[order][starts], np.diff(np.append(starts, len(order)))
            rank = np.empty(len(terms), np.int64)
            common = np.argsort(-n, kind="stable")  # frequent terms get small places
            rank[common] = np.arange(len(terms))
            places = np.empty(len(tokens), np.int64)
            places[order] = np.repeat(rank, n)
            counts = np.bincount(places[np.repeat(~apart, lengths)], minlength=len(terms))
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            values = [apart.tobytes(), lengths.astype(np.int64).tobytes(), terms[common].tobytes(), counts.astype(np.int64).tobytes(), _planes(places)]
            return pa.RecordBatch.from_arrays([ids, *(pa.array([v], pa.binary()) for v in values)], ["ids", "held", "lengths", "terms", "counts", "tokens"])

        for batch in batches:
            for s in slices(batch, "text"):
                starts, ends, owner = s.words()
                n = s.stop - s.start
                lengths = np.bincount(owner, minlength=n) + 1
                tokens = np.full(lengths.sum(), END_TERM, np.uint64)
                tokens[np.arange(len(starts)) + owner] = s.hashes(starts, ends, lower=True)
                held.append((batch.column(0).slice(s.start, n), tokens, lengths))
                size += len(s.data) + n
                if size >= block_bytes:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    blocks = rows.mapInArrow(read, f"ids array<{kind}>, held binary, lengths binary, terms binary, counts binary, tokens binary")
    return stored(blocks.select(F.expr("xxhash64(uuid())").alias("block"), "*"), "blocks")


def _part_of(terms: np.ndarray, parts: int) -> np.ndarray:
    """The part of the table of words that has each term; ``_part`` is the same as a column."""
    return ((terms.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.uint32)


def _part(parts: int):
    return F.expr(f"cast(shiftrightunsigned(term, 20) % {parts} as int)")


def _parts_for(blocks: DataFrame) -> int:
    """So many parts that one holds about ``PART_TERMS`` of the terms that blocks list."""
    total = blocks.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    return max(LEAST_PARTS, -(-total // (8 * PART_TERMS)))


def _pieces(blocks: DataFrame, parts: int, counts: bool) -> DataFrame:
    """A row per block and part: ``part``, ``block``, ``terms`` and, if wanted, ``counts`` of the
    block's terms in that part, in their order."""
    names = ["part", "block", "terms", *(["counts"] if counts else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                terms = np.frombuffer(row[1].as_buffer(), np.uint64)
                part = _part_of(terms, parts)
                order = np.argsort(part, kind="stable")
                starts = run_starts(part[order])
                offsets = (8 * np.append(starts, len(order))).astype(np.int32)
                piece = lambda x: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x[order].tobytes())])
                values = [piece(terms), *([piece(np.frombuffer(row[2].as_buffer(), np.int64))] if counts else [])]
                yield pa.RecordBatch.from_arrays([pa.array(part[order][starts].astype(np.int32)), pa.array(np.full(len(starts), row[0].as_py())), *values], names)

    source = blocks.select("block", "terms", *(["counts"] if counts else []))
    return source.mapInArrow(cut, "part int, block long, terms binary" + (", counts binary" if counts else ""))


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of all rows of a binary column, one after the other."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def _word_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """(term, c) of the words of the training texts. A task adds up one part at a time."""

    def add(group: pa.Table) -> pa.Table:
        terms, n = _joined(group.column("terms"), np.int64), _joined(group.column("counts"), np.int64)
        order = np.argsort(terms)
        starts = run_starts(terms[order])
        c = np.add.reduceat(n[order], starts) if len(starts) else n
        terms = terms[order][starts]
        return pa.table({"term": pa.array(terms[c > 0]), "c": pa.array(c[c > 0])})

    return _pieces(blocks, parts, True).groupBy("part").applyInArrow(add, "term long, c long")


@dataclass
class Model:
    """Class bigram counts of the training text and what the classes emit."""

    tokens: int
    types: int
    frequent: np.ndarray  # sorted term hashes
    classes: np.ndarray  # of the frequent terms
    transitions: np.ndarray
    parts: int = 1  # of the tables of words

    def class_of(self, terms: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Class of each term; ``of`` has that of the terms that are not frequent."""
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, terms), len(self.frequent) - 1)
            of = np.where(self.frequent[at] == terms, self.classes[at], of)
        return np.where(terms == END_TERM, END, of)

    def log_transitions(self, smoothing: float = 0.1) -> np.ndarray:
        """log10 p(class | previous class). Unseen words are expected after a class as often
        as words that the training text has once."""
        n = self.transitions.astype(np.float64)
        n[:, UNSEEN] = n[:, ONCE]
        n += smoothing
        return np.log10(n / n.sum(axis=1, keepdims=True))

    def log_sizes(self) -> np.ndarray:
        """log10 of the training tokens of each class, of which a word's count is a share;
        0 for unseen words, each of which is one of as many as there are known."""
        out = np.log10(np.maximum(self.transitions.sum(axis=0), 1))
        out[UNSEEN] = 0
        return out


def gains(matrix: np.ndarray) -> np.ndarray:
    """What a neighbour of each class is worth to a word of each class, by class bigrams."""
    n = matrix + 0.5
    return np.log(n) - np.log(n.sum(axis=1))[:, None] - np.log(n.sum(axis=0))[None, :]


def exchange(left: np.ndarray, right: np.ndarray, matrix: np.ndarray, classes: np.ndarray, turn: int) -> np.ndarray:
    """One sweep: half of the words (even or odd places, by ``turn``) each move to the class
    that gains most likelihood under the class bigram counts ``matrix``. ``left`` and
    ``right`` count, per word, the classes before and after it."""
    gain = gains(matrix)
    best = (left @ gain + right @ gain.T)[:, :CLASSES].argmax(axis=1)
    moves = np.arange(len(classes)) % 2 == turn % 2
    return np.where(moves, best, classes)


def cluster(bigrams: DataFrame, counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the frequent words by exchange. ``bigrams`` has u, v (places of frequent
    words, or their number for any other neighbour) and n. A sweep reads it once and sums
    the classes around each word: at most words * classes numbers reach the driver."""
    size, spark = len(counts), bigrams.sparkSession
    classes = np.empty(size, np.int64)
    classes[np.argsort(-counts, kind="stable")] = np.arange(size) % CLASSES
    best, best_value, width = classes, -np.inf, CLASSES + 1
    for turn in range(sweeps + 1 if size else 0):
        shared = spark.sparkContext.broadcast(np.append(classes, CLASSES))

        def around(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of, total = shared.value, np.zeros(2 * (size + 1) * width, np.int64)
            for batch in batches:
                u, v, n = (c.to_numpy() for c in batch.columns)
                for key in (v * width + of[u], (size + 1 + u) * width + of[v]):
                    total += np.bincount(key, weights=n, minlength=len(total)).astype(np.int64)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["key", "n"])

        summed = bigrams.mapInArrow(around, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(2 * (size + 1) * width)
        total[summed.column("key").to_numpy()] = summed.column("n").to_numpy()
        left, right = total.reshape(2, size + 1, width)
        matrix = np.zeros((width, width))
        np.add.at(matrix, np.append(classes, CLASSES), right)
        value = (matrix * np.log(np.maximum(matrix, 1))).sum() - sum((m * np.log(np.maximum(m, 1))).sum() for m in (matrix.sum(axis=0), matrix.sum(axis=1)))
        if value > best_value:
            best, best_value = classes, value
        classes = exchange(left[:size], right[:size], matrix, classes, turn)
    return best


def _frequent_bigrams(blocks: DataFrame, frequent: np.ndarray) -> DataFrame:
    """u, v, n of neighbours in training texts of which at least one is frequent."""
    shared, size = blocks.sparkSession.sparkContext.broadcast(frequent), len(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, lengths, terms, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = np.frombuffer(terms, np.uint64)
                at = np.minimum(np.searchsorted(shared.value, terms), max(size - 1, 0))
                place = np.where(shared.value[at] == terms, at, size) if size else np.full(len(terms), 0)
                row = place[_unplaned(tokens)]
                train = np.repeat(~np.frombuffer(held, bool), np.frombuffer(lengths, np.int64))
                last = np.zeros(len(row), bool)
                last[np.cumsum(np.frombuffer(lengths, np.int64)) - 1] = True
                pair = train[:-1] & ~last[:-1] & ((row[:-1] < size) | (row[1:] < size))
                code, n = np.unique(row[:-1][pair] * (size + 1) + row[1:][pair], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code // (size + 1)), pa.array(code % (size + 1)), pa.array(n)], ["u", "v", "n"])

    pairs = blocks.select("held", "lengths", "terms", "tokens").mapInArrow(count, "u long, v long, n long")
    return pairs.groupBy("u", "v").agg(F.sum("n").alias("n"))


def _dealt(blocks: DataFrame, table: DataFrame, missing: int, kind: type, parts: int) -> DataFrame:
    """``of`` (a block) and ``known``: the values ``c`` that ``table`` has for its terms, part
    after part (``_in_order`` puts them back). Blocks and table meet part by part as arrays:
    a term that every block lists is one number in each, so no part grows beyond the others."""

    def look_up(pieces: pa.Table, words: pa.Table) -> pa.Table:
        terms, values = words.column("term").to_numpy(), words.column("c").to_numpy().astype(kind)
        order = np.argsort(terms)
        terms, values = np.append(terms[order], 0), np.append(values[order], missing).astype(kind)
        found = []
        for piece in pieces.column("terms"):
            wanted = np.frombuffer(piece.as_buffer(), np.int64)
            at = np.searchsorted(terms[:-1], wanted)
            found.append(np.where(terms[at] == wanted, values[at], kind(missing)) if len(terms) > 1 else np.full(len(wanted), missing, kind))
        return pa.table({"part": pieces.column("part"), "of": pieces.column("block"), "known": pa.array([x.astype(kind).tobytes() for x in found], pa.binary())})

    words = table.select(_part(parts).alias("part"), "term", F.col("c").cast("long").alias("c"))
    met = _pieces(blocks, parts, False).groupBy("part").cogroup(words.groupBy("part")).applyInArrow(look_up, "part int, of long, known binary")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for of, known in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and of != now:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["of", "known"])
                    held = []
                now = of
                held.append(known.as_py())
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["of", "known"])

    return met.repartition("of").sortWithinPartitions("of", "part").select("of", "known").mapInArrow(gather, "of long, known binary")


def _in_order(known: np.ndarray, terms: np.ndarray, parts: int) -> np.ndarray:
    """Values that came part after part, in the order of a block's terms."""
    out = np.empty_like(known)
    out[np.argsort(_part_of(terms, parts), kind="stable")] = known
    return out


def _with_counts(blocks: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """The blocks with ``known``: count and class of their terms, packed, part after part."""
    found = _dealt(blocks, known, UNSEEN, np.int64, parts)
    return blocks.join(found, F.col("block") == F.col("of")).select("ids", "held", "lengths", "terms", "tokens", "known")


def _with_classes(blocks: DataFrame, words: DataFrame | None, parts: int) -> DataFrame:
    """The training columns of the blocks with ``known``: the classes that ``words`` has for
    their terms, part after part; null without ``words``."""
    columns = ["held", "lengths", "terms", "tokens"]
    if words is None:
        return blocks.select(*columns, F.lit(None).cast("binary").alias("known"))
    found = stored(_dealt(blocks, words.withColumnRenamed("class", "c"), ONCE, np.uint8, parts), "places")
    release(blocks.sparkSession)
    return blocks.select("block", *columns).join(found, F.col("block") == F.col("of")).select(*columns, "known")


def _trained(row: dict, model: Model) -> tuple[np.ndarray, ...]:
    """terms of a block, their classes so far, its tokens, and which of these are learnt from."""
    numbers = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
    terms, lengths = numbers("terms", np.uint64), numbers("lengths", np.int64)
    of = _in_order(numbers("known", np.uint8), terms, model.parts).astype(np.int64) if row["known"].is_valid else np.full(len(terms), ONCE)
    return terms, model.class_of(terms, of), lengths, _unplaned(row["tokens"].as_buffer()), np.repeat(~numbers("held", bool), lengths)


def _matrix(classed: DataFrame, model: Model) -> np.ndarray:
    """Class bigram counts of the training texts."""
    shared = classed.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL * ALL, np.int64)
        for row in _rows(batches):
            _, of, lengths, tokens, train = _trained(row, shared.value)
            classes = of[tokens]
            total += np.bincount((_before(classes, lengths) * ALL + classes)[train], minlength=ALL * ALL)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    pairs = classed.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ALL * ALL, np.int64)
    out[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    return out.reshape(ALL, ALL)


def _around(classed: DataFrame, model: Model, turn: int | None) -> DataFrame:
    """(term, around) per block and word that is not frequent: a byte for the class before
    each of its training tokens and one, higher by ALL, for the class after it. With
    ``turn``, only of words that have a class and whose hash is even or odd as it is."""
    shared = classed.sparkSession.sparkContext.broadcast(model)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for row in _rows(batches):
            terms, of, lengths, tokens, train = _trained(row, model)
            wanted = (terms != END_TERM) & ~np.isin(terms, model.frequent)
            if turn is not None:
                wanted &= (of < CLASSES) & (terms & np.uint64(1) == turn % 2)
            classes = of[tokens]
            at = np.flatnonzero(train & wanted[tokens])
            at = at[np.argsort(tokens[at], kind="stable")]
            bytes_ = np.stack([_before(classes, lengths)[at], ALL + classes[at + 1]], axis=1).astype(np.uint8).reshape(-1)
            starts = run_starts(tokens[at])
            ends, term = np.append(starts[1:], len(at)), terms[tokens[at[starts]]].view(np.int64)
            for a in range(0, len(starts), 20_000):
                part = slice(a, a + 20_000)
                low, high = 2 * starts[a], 2 * ends[part][-1]
                offsets = (np.append(2 * starts[part], high) - low).astype(np.int32)
                around = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(bytes_[low:high].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(term[part]), around], ["term", "around"])

    return classed.mapInArrow(collect, "term long, around binary")


def _moved(around: DataFrame, gain: np.ndarray) -> DataFrame:
    """(term, class) of the words that occur twice or more: the class that gains most from
    all that stands around a word. Counts of one word at a time are held, whatever its rows."""
    shared = around.sparkSession.sparkContext.broadcast(gain)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, width = shared.value, 2 * ALL
        last, held = None, np.zeros((1, width), np.int64)

        def best(terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            often = n.sum(axis=1) > 2  # a token counts on both sides
            n = n[often]
            left, right = n[:, :ALL], n[:, ALL:]
            value = (left @ gain + right @ gain.T)[:, :CLASSES]
            top = value.max(axis=1, keepdims=True)
            tied = value >= top - 1e-9 * (1 + np.abs(top))  # classes still empty; words of like neighbours take the same
            pick = (left.argmax(axis=1) * ALL + right.argmax(axis=1)) % tied.sum(axis=1)
            classes = (tied.cumsum(axis=1) > pick[:, None]).argmax(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(terms[often]), pa.array(classes.astype(np.int8))], ["term", "class"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                rows, terms = part.column(1), part.column(0).to_numpy()
                offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset: rows.offset + len(rows) + 1]
                around = np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0]: offsets[-1]].astype(np.int64)
                starts = run_starts(terms)
                word = np.zeros(len(terms), np.int64)
                word[starts[1:]] = 1
                n = np.bincount(np.repeat(np.cumsum(word), np.diff(offsets)) * width + around, minlength=len(starts) * width).reshape(-1, width)
                terms = terms[starts]
                if last is not None and terms[0] == last:
                    n[0] += held[0]
                elif last is not None:
                    yield best(np.array([last]), held)
                if len(terms) > 1:
                    yield best(terms[:-1], n[:-1])
                last, held = terms[-1], n[-1:].copy()
        if last is not None:
            yield best(np.array([last]), held)

    return around.repartition("term").sortWithinPartitions("term").mapInArrow(move, "term long, class byte")


def cluster_rest(blocks: DataFrame, model: Model, sweeps: int = REST_SWEEPS) -> DataFrame:
    """(term, class) of all words that are not frequent and occur twice or more in training.

    The first sweep weighs a word's neighbours by the classes of frequent words; each later
    one moves the even or the odd half by the classes of all words. Tables hold the words;
    the driver sees class bigram counts only.
    """
    words = None
    for turn in range(sweeps + 1):
        classed = _with_classes(blocks, words, model.parts)
        gain = gains(_matrix(classed, model))
        release(blocks.sparkSession)
        moved = _moved(_around(classed, model, turn if turn else None), gain)
        if words is not None:
            moved = moved.unionByName(words.filter(F.col("term").bitwiseAND(F.lit(1)) != turn % 2))
        words = stored(moved, "words")
        del classed, moved
        release(blocks.sparkSession)
    return words


def _read(row: dict, parts: int) -> tuple[np.ndarray, ...]:
    """held, lengths, terms, counts, classes and tokens of a block with counts."""
    numbers = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
    known = _in_order(numbers("known", np.int64), numbers("terms", np.uint64), parts)
    return numbers("held", bool), numbers("lengths", np.int64), numbers("terms", np.uint64), known // 128, known % 128, _unplaned(row["tokens"].as_buffer())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def _before(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The class before each token; the end of a text before its first."""
    out = np.empty_like(classes)
    out[1:] = classes[:-1]
    out[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = END
    return out


def _classified(counted: DataFrame, model: Model, kind: str) -> DataFrame:
    """Per block: ids, held and lengths; per text ``known`` tokens, ``base`` score and
    ``emitted`` (what the counts of its words add to the score); the class of each token."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for row in _rows(batches):
            held, lengths, terms, counts, of, tokens = _read(row, model.parts)
            of = model.class_of(terms, of)
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            emitted = np.where(of == UNSEEN, -np.log10(model.types + 1), np.log10(np.maximum(counts, 1)))
            begin = np.cumsum(lengths) - lengths
            values = [held, lengths, np.add.reduceat((counts > 0)[tokens].astype(np.int64), begin), np.add.reduceat(base[tokens], begin), np.add.reduceat(emitted[tokens], begin), of[tokens].astype(np.uint8)]
            ids = row["ids"].values
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([v.tobytes()], pa.binary()) for v in values)]
            yield pa.RecordBatch.from_arrays(arrays, ["ids", "held", "lengths", "known", "base", "emitted", "classes"])

    return counted.mapInArrow(classify, f"ids array<{kind}>, held binary, lengths binary, known binary, base binary, emitted binary, classes binary")


def _sequence(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """held and lengths of a block's texts, and the classes of their tokens."""
    numbers = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
    return numbers("held", bool), numbers("lengths", np.int64), numbers("classes", np.uint8).astype(np.int64)


def _transitions(classified: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL * ALL, np.int64)
        for row in _rows(batches):
            held, lengths, classes = _sequence(row)
            pairs = (_before(classes, lengths) * ALL + classes)[np.repeat(~held, lengths)]
            total += np.bincount(pairs, minlength=ALL * ALL)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    return classified.select("held", "lengths", "classes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", share: float = SHARE, sweeps: int = SWEEPS, rest_sweeps: int = REST_SWEEPS) -> DataFrame:
    """Per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10 probabilities of the text).

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. Every text
    whose id has a CRC-32 that 10 does not divide is learnt from, whole. ``share`` bounds
    the frequent words (1 / share at most) that the driver clusters; the classes of all
    other words that occur twice or more follow from them by ``rest_sweeps`` more sweeps.
    Word counts, class transitions and emissions are of all training texts. A null or empty
    text is one end. Every row is a document; a null id is held out; other columns are
    ignored. Without training texts the base gives 0 and the model knows no word.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    blocks = read_blocks(docs, id, text)
    parts = _parts_for(blocks)
    known = stored(_word_counts(blocks, parts), "counts")
    release(spark)
    tokens, types = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = known.filter((F.col("c") >= F.lit(share * tokens)) & (F.col("term") != END_TERM)).toArrow()
    terms, n = often.column("term").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(terms)
    frequent, n = terms[order], n[order]
    classes = cluster(stored(_frequent_bigrams(blocks, frequent), "bigrams"), n, sweeps)
    release(spark)
    model = Model(tokens, types, frequent, classes, np.zeros((ALL, ALL), np.int64), parts)
    words = cluster_rest(blocks, model, rest_sweeps)
    packed = known.join(words, "term", "left").select("term", (F.col("c") * 128 + F.coalesce("class", F.lit(ONCE))).alias("c"))
    classified = stored(_classified(_with_counts(blocks, packed, parts), model, kind), "classes")
    release(spark)
    pairs = _transitions(classified).toArrow()
    model.transitions.reshape(-1)[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    shared = spark.sparkContext.broadcast((model.log_transitions(), model.log_sizes(), model.tokens))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, sizes, train = shared.value
        for row in _rows(batches):
            held, lengths, classes = _sequence(row)
            known, base, emitted = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("known", np.int64), ("base", np.float64), ("emitted", np.float64)))
            moved = np.add.reduceat(moves[_before(classes, lengths), classes] - sizes[classes], np.cumsum(lengths) - lengths)
            values = [held, lengths, known, np.full(len(lengths), train), base, moved + emitted]
            yield pa.RecordBatch.from_arrays([row["ids"].values, *(pa.array(v) for v in values)], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return classified.mapInArrow(score, schema).withColumnRenamed("id", id)
