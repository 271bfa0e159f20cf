"""Removal of bytes in strings that also start earlier, by run-length text indexes.

Every window of ``length`` bytes picks an anchor: of its 32-byte strings, the one that
hashes lowest. Equal windows pick equal anchors, so windows of which the anchor is found
once need no comparison, and the others need it only with windows of the same anchor. A
context is the stretch of text whose windows share an anchor; equal contexts are one
class, of which all but the first are removed whole. Where an anchor has several classes,
the first class of each anchor goes into a run-compressed index, against which the others
are streamed; windows that the index doesn't have are compared among themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloframe.llm.runindex import RunIndex
from sloframe.llm.store import release, stored
from sloframe.llm.textbatch import Slice, mix, run_starts, slices

LENGTH = 100
GRAM = 32
PART = 1 << 22  # window starts of a long text that are looked at together
SHARD_BYTES = 1 << 20
HOT = 4096  # classes of one anchor
_LOW = np.uint64((1 << 24) - 1)
_KEY = np.uint64(0xA0761D6478BD642F)


class Anchors:
    """Anchors of the texts of a slice, in order: ``owner`` (text), ``first`` and ``last``
    window start, ``anchor`` and ``context`` (hashes, signed), and ``repeated`` (the same
    context starts earlier in the same text)."""

    def __init__(self, s: Slice, length: int = LENGTH):
        parts = [self._part(s, a, b, length) for a, b in self._parts(s)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
        self.owner, self.first, self.last, self.anchor, self.context = columns
        same = _within(self.context, self.owner)
        order = np.argsort(same, kind="stable")
        self.repeated = np.ones(len(order), bool)
        self.repeated[order[run_starts(same[order])]] = False

    @staticmethod
    def _parts(s: Slice):
        """Byte ranges: whole slices, or one long text piece by piece."""
        n = len(s.data)
        if n <= PART:
            return [(0, n)] if n else []
        return [(a, min(a + PART, n)) for a in range(0, n, PART)]

    @staticmethod
    def _part(s: Slice, start: int, stop: int, length: int) -> tuple[np.ndarray, ...]:
        """Anchors of the windows that start in [start, stop)."""
        end = min(stop + length - 1, len(s.data))
        data = s.data[start: end]
        part = Slice(0, 0, data, np.unique(np.clip(s.offsets - start, 0, len(data))))
        left = np.repeat(part.offsets[1:], np.diff(part.offsets)) - np.arange(len(data))
        if end > stop:  # bytes after the part only complete its windows
            left[stop - start:] = 0
        windows = np.flatnonzero(left >= length)
        if not len(windows):
            return tuple([np.zeros(0, np.int64)] * 5)
        hashes = part.gram_hashes(GRAM)
        low = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        span, covered = length - GRAM + 1, 1
        while 2 * covered <= span:
            low = np.minimum(low[:-covered], low[covered:])
            covered *= 2
        if covered < span:
            low = np.minimum(low[: len(low) - (span - covered)], low[span - covered:])
        chosen = (low[windows] & _LOW).astype(np.int64)
        at = run_starts(chosen)
        first, last, anchor = windows[at], windows[np.append(at[1:], len(windows)) - 1], chosen[at]
        context = mix(part.hashes(first, last + length) + (anchor - first).astype(np.uint64) * _KEY)
        owner = np.searchsorted(s.offsets, first + start, side="right") - 1
        return owner, first + start, last + start, hashes[anchor].view(np.int64), context.view(np.int64)


def _within(context: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A context in a text as one number."""
    return mix(context.view(np.uint64) + mix(owner.astype(np.uint64)))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, context, id) of the contexts that don't repeat within their text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text"):
                a = Anchors(s, length)
                new = np.flatnonzero(~a.repeated)
                yield pa.RecordBatch.from_arrays([pa.array(a.anchor[new]), pa.array(a.context[new]), batch.column(0).take(pa.array(a.owner[new] + s.start))], ["anchor", "context", "id"])

    return docs.mapInArrow(find, f"anchor long, context long, id {docs.schema['id'].dataType.simpleString()}")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The text of the contexts in ``wanted`` (id, context): anchor, id, start, context,
    body. The anchor's place is the same in all contexts of a window, so it isn't needed."""
    listed = wanted.groupBy("id").agg(F.collect_list("context").alias("wanted")).withColumnRenamed("id", "of")
    rows = docs.join(listed, F.col("id") == F.col("of")).select("id", "text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            for s in slices(batch, "text"):
                a = Anchors(s, length)
                lists = wanted.slice(s.start, s.stop - s.start)
                asked = _within(lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()))
                found = np.flatnonzero(~a.repeated & np.isin(_within(a.context, a.owner), asked))
                body = [s.data[x: y + length].tobytes() for x, y in zip(a.first[found], a.last[found], strict=True)]
                start = a.first[found] - s.offsets[a.owner[found]]
                yield pa.RecordBatch.from_arrays([pa.array(a.anchor[found]), batch.column(0).take(pa.array(a.owner[found] + s.start)), pa.array(start), pa.array(a.context[found]), pa.array(body, pa.binary())], ["anchor", "id", "start", "context", "body"])

    return rows.mapInArrow(cut, f"anchor long, id {docs.schema['id'].dataType.simpleString()}, start long, context long, body binary")


def _judge(anchor: np.ndarray, bodies: list[bytes], length: int) -> np.ndarray:
    """For contexts sorted by anchor and then by place: which window (row, offset) has an
    equal one in an earlier context of the same anchor."""
    leads = np.zeros(len(bodies), bool)
    leads[run_starts(anchor)] = True
    sizes = np.array([len(b) for b in bodies])
    width = int(sizes.max())
    patterns = np.zeros((len(bodies), width), np.uint8)  # right-aligned: all rows end together
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    row = np.repeat(np.arange(len(bodies)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(width - sizes, sizes)
    patterns[row, column] = flat
    removed = np.zeros((len(bodies), width - length + 1), bool)
    # Byte 0 ends the index' text and fills the patterns; texts that hold it are moved up
    # by one and 255, which UTF-8 doesn't have, stays free.
    if flat.min() == 0:
        patterns[row, column] += 1
        flat = flat + np.uint8(1)
    rest = np.flatnonzero(~leads)
    if not len(rest):
        return removed
    text = np.concatenate([np.append(flat[a: a + n], 255) for a, n in zip((np.cumsum(sizes) - sizes)[leads], sizes[leads], strict=True)])
    found = RunIndex(text, length).matching_statistics(patterns[rest])[:, : width - length + 1] >= length
    inside = np.arange(width - length + 1)[None, :] >= (width - sizes)[:, None]
    removed[rest] = found & inside[rest]
    # Windows that no first context has: the first of equal ones stays.
    r, o = np.nonzero(inside & ~removed & ~leads[:, None])
    if len(r):
        spans = Slice(0, 0, patterns.reshape(-1), np.array([0, patterns.size]))
        begin = r * width + o
        key = spans.hashes(begin, begin + length) ^ mix(anchor[r].view(np.uint64))
        order = np.argsort(key, kind="stable")  # rows are in order of place, so are windows
        later = np.ones(len(order), bool)
        later[run_starts(key[order])] = False
        removed[r[order[later]], o[order[later]]] = True
    return removed


def _bits(removed: np.ndarray, sizes: np.ndarray, length: int) -> list[bytes]:
    """A bit per window of each context, from its first window on."""
    width = removed.shape[1] + length - 1
    return [np.packbits(removed[i, width - n:]).tobytes() for i, n in enumerate(sizes)]


def _shards(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(id, context, bits) of contexts of which some windows start earlier elsewhere."""
    kind = contexts.schema["id"].dataType.simpleString()
    parts = contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = contexts.repartition(int(parts), "anchor").sortWithinPartitions("anchor", "id", "start")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            place = np.stack([rows.column(k).to_numpy() for k in (0, 2, 3)])
            ids = rows.column(1).to_numpy()
            new = np.ones(len(ids), bool)  # a row given twice is one context
            new[1:] = (place[:, 1:] != place[:, :-1]).any(axis=0) | (ids[1:] != ids[:-1])
            rows = rows.filter(pa.array(new))
            anchor = rows.column(0).to_numpy()
            if len(run_starts(anchor)) == len(anchor):
                return
            bodies = rows.column(4).to_pylist()
            removed = _judge(anchor, bodies, length)
            some = np.flatnonzero(removed.any(axis=1))
            if len(some):
                sizes = np.array([len(bodies[i]) for i in some])
                picked = rows.take(pa.array(some)).combine_chunks()
                bits = pa.array(_bits(removed[some], sizes, length), pa.binary())
                yield pa.RecordBatch.from_arrays([picked.column(1).combine_chunks(), picked.column(3).combine_chunks(), bits], ["id", "context", "bits"])

        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                held.append(part)
                size += part.column(4).nbytes
                if size >= shard_bytes:  # all but the last anchor, which may go on
                    rows = pa.Table.from_batches(held)
                    anchor = rows.column(0).to_numpy()
                    cut = int(run_starts(anchor)[-1])
                    if cut:
                        yield from flush(rows.slice(0, cut))
                        held = rows.slice(cut).combine_chunks().to_batches()
                        size = sum(x.column(4).slice(0, len(x)).nbytes for x in held)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return dealt.mapInArrow(judge, f"id {kind}, context long, bits binary")


def _hot(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many classes: their windows are sorted by Spark's
    shuffle, with partial minima, so that no task holds an anchor whole."""
    kind = contexts.schema["id"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            sizes = pc.binary_length(column).to_numpy().astype(np.int64)
            for a in range(0, batch.num_rows, 2000):
                n = sizes[a: a + 2000] - length + 1
                bodies = column.slice(a, 2000).to_pylist()
                flat = np.frombuffer(b"".join(bodies), np.uint8)
                begins = np.cumsum([0, *map(len, bodies)])[:-1]
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                spans = Slice(0, 0, flat, np.array([0, len(flat)]))
                at = np.repeat(begins, n) + offset
                row = pa.array(np.repeat(np.arange(len(n)), n) + a)
                half = length // 2
                one, two = spans.hashes(at, at + length), spans.hashes(at, at + half)
                place = batch.column(2).to_numpy()[a: a + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column(1).take(row), batch.column(3).take(row), pa.array(np.repeat(place, n) + offset), pa.array(offset.astype(np.int32)), pa.array(np.repeat(n, n).astype(np.int32))],
                    ["one", "two", "id", "context", "start", "offset", "n"],
                )

    rows = contexts.select("anchor", "id", "start", "context", "body").mapInArrow(windows, f"one long, two long, id {kind}, context long, start long, offset int, n int")
    first = rows.groupBy("one", "two").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    first = stored(first, "windows")
    later = rows.join(first, ["one", "two"]).filter(F.struct("id", "start") > F.col("first"))
    grouped = later.groupBy("id", "context").agg(F.collect_list("offset").alias("offsets"), F.max("n").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for offsets, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                flags = np.zeros(n, bool)
                flags[offsets] = True
                bits.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["id", "context", "bits"])

    return grouped.mapInArrow(pack, f"id {kind}, context long, bits binary")


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary).

    Texts are UTF-8 bytes, null as empty. Each byte is removed that a string of ``length``
    bytes covers which also starts earlier: in a document of smaller id, or earlier in the
    same document. Strings are judged on the input, and no match crosses documents.

    Rows that repeat an id are one document given again, so one doesn't remove from the
    other. Rows without an id remove nothing elsewhere and lose only what they
    repeat themselves. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    named = rows.filter(F.col("id").isNotNull())

    found = _anchors(named, length)
    shared = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"), F.min("id").alias("first")).filter("n > 1")
    shared = stored(shared.select("anchor", "first", (F.col("low") < F.col("high")).alias("several")), "anchors")
    release(spark)
    places = stored(found.join(shared, "anchor"), "places")
    release(spark)
    several = places.filter("several")
    classes = stored(several.groupBy("anchor", "context").agg(F.min("id").alias("leader")), "classes")
    whole = places.filter("NOT several AND id > first").select("id", "context")
    whole = whole.union(several.select("anchor", "context", "id").join(classes, ["anchor", "context"]).filter("id > leader").select("id", "context"))
    contexts = stored(_contexts(named, classes.select(F.col("leader").alias("id"), "context"), length), "contexts")
    release(spark)
    crowded = stored(classes.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"), "hot")
    partly = stored(_shards(contexts.join(crowded, "anchor", "left_anti"), length, shard_bytes), "bits")
    release(spark)
    if not crowded.isEmpty():
        partly = partly.union(stored(_hot(contexts.join(crowded, "anchor", "left_semi"), length), "bits"))
        release(spark)
    marks = whole.withColumn("bits", F.lit(None).cast("binary")).union(partly)
    marks = marks.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("context", "bits")).alias("marks"))
    marked = rows.join(marks, F.col("id") == F.col("of"), "left").select("id", "text", F.col("marks.context").alias("contexts"), F.col("marks.bits").alias("bits"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text"):
                a, n = Anchors(s, length), s.stop - s.start
                lists, bits = batch.column(2).slice(s.start, n), batch.column(3).slice(s.start, n).flatten()
                counts = lists.value_lengths().fill_null(0).to_numpy()
                marked = _within(lists.flatten().to_numpy(), np.repeat(np.arange(n), counts))
                order = np.argsort(marked)
                own = _within(a.context, a.owner)
                at = np.minimum(np.searchsorted(marked, own, sorter=order), max(len(marked) - 1, 0))
                hit = (marked[order[at]] == own) & ~a.repeated if len(marked) else np.zeros(len(own), bool)
                partly = pc.is_valid(bits).to_numpy(zero_copy_only=False)
                some = np.flatnonzero(hit)
                some = some[partly[order[at[some]]]]
                whole = a.repeated | hit
                whole[some] = False
                edges = np.bincount(a.first[whole], minlength=len(s.data) + 1) - np.bincount(a.last[whole] + 1, minlength=len(s.data) + 1)
                starts = np.cumsum(edges)[: len(s.data)] > 0
                for k, raw in zip(some, bits.take(pa.array(order[at[some]])).to_pylist(), strict=True):
                    starts[a.first[k]: a.last[k] + 1] = np.unpackbits(np.frombuffer(raw, np.uint8), count=a.last[k] - a.first[k] + 1)
                # A byte is covered if one of the last ``length`` places starts a removed string.
                covered = np.zeros(len(s.data) + length, np.int64)
                np.cumsum(starts, out=covered[length:])
                gone = covered[length:] > covered[: len(s.data)]
                begins, _, owner = s.spans(gone)
                kept = [s.data[x:y][~gone[x:y]].tobytes() for x, y in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, n), pa.array(np.diff(s.offsets)), pa.array(s.per_text(gone)), pa.array(np.bincount(owner, minlength=n)), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id)


def kept_digest(out: DataFrame) -> DataFrame:
    """``kept`` as its SHA-256."""
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def remove_plainly(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by comparing all strings, for tests."""
    seen, out = set(), {}
    for key in sorted(texts):
        data = texts[key]
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p: p + length]
            if window in seen:
                gone[p: p + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)
        out[key] = (len(data), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out
