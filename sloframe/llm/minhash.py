"""MinHash near-dedup: universal hash minima, banding, verification on full sets, components.

Documents with equal shingle sets are one class, stood for by its smallest id. Classes
meet in the buckets of 32 bands of 4 minima; at a similarity of 0.75 a pair shares no
bucket with a probability of about 5 in a million. First each class is held against one
class of smaller id that it shares a bucket with, which joins nearly all of a group. Then
buckets that still hold several components are searched whole, in blocks: only pairs of
different components are compared, by their signatures and then by their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloframe.llm.components import components
from sloframe.llm.store import stored
from sloframe.llm.textbatch import Slice, mix, run_starts, slices

SHINGLE = 5
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
BLOCK = 256

_draw = np.random.default_rng(7)
_FACTOR = _draw.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _draw.integers(0, 2**32, MINIMA, dtype=np.uint32)


def shingle_sets(s: Slice, size: int = SHINGLE) -> list[np.ndarray]:
    """Per text, the sorted hashes of its distinct shingles of lower-cased words; of fewer
    words, the whole sequence as one."""
    starts, ends, owner = s.words()
    words = s.hashes(starts, ends, lower=True)
    counts = np.bincount(owner, minlength=len(s.offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    odd = np.uint64(0xD6E8FEB86659FD93)
    rolled = words[: max(0, len(words) - size + 1)].copy()
    for k in range(1, size):
        rolled = rolled * odd + words[k: k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for i, n in enumerate(counts.tolist()):
        a = first[i]
        if n >= size:
            out.append(np.unique(rolled[a: a + n - size + 1]))
        elif n:
            h = np.array([n], np.uint64)
            for k in range(a, a + n):
                h = mix(h * odd + words[k: k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 32-bit minima for each non-empty set."""
    sizes = np.array([len(x) for x in sets])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out, work = np.empty((len(sets), MINIMA), np.uint32), np.empty_like(values)
    for k in range(MINIMA):
        np.multiply(values, _FACTOR[k], out=work)
        np.add(work, _SHIFT[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def signatures(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Per row: id, n_shingles, ``same`` (128-bit hash of the set) and ``minima``, both
    null for an empty set."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text", 1 << 19):
                sets = shingle_sets(s)
                full = [i for i, x in enumerate(sets) if len(x)]
                same, low = [None] * len(sets), [None] * len(sets)
                for i, m in zip(full, minima([sets[i] for i in full]) if full else [], strict=True):
                    same[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    low[i] = m.tobytes()
                ids = batch.column(0).slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(low, pa.binary())], ["id", "n_shingles", "same", "minima"])

    return rows.mapInArrow(sign, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, same binary, minima binary")


def _sets_of(docs: DataFrame, ids: DataFrame, id: str, text: str) -> DataFrame:
    """``id`` and ``shingles`` (sorted hashes) of the documents in ``ids``."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(ids, "id", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, s.stop - s.start), pa.array([x.tobytes() for x in shingle_sets(s)], pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(build, f"id {rows.schema['id'].dataType.simpleString()}, shingles binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Of the pairs (u, v), those with 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    kind = pairs.schema["u"].dataType.simpleString()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                shared = _shared(x, y) if 100 * small >= percent * large else 0
                keep.append(100 * shared >= percent * (small + large - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(confirm, f"u {kind}, v {kind}")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that agree in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        starts = np.unique(np.concatenate([run_starts(c) for c in columns]))
        if held and any(held[-1].column(i)[held[-1].num_rows - 1] != batch.column(i)[0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two sorted sets have in common."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _open_links(hits: DataFrame, labels: DataFrame, signs: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links between different components of a bucket, enough to join what they join.

    A bucket's rows are dealt into blocks of about ``BLOCK`` rows and each two blocks meet
    in a group of their own, so no task holds a bucket whole and no pair is a row: a task
    compares signatures, confirms on the full sets what agrees in ``least`` of the minima,
    and skips what its own links have joined already.
    """
    labelled = hits.select("bucket", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "id"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high")
    open_ = stored(open_.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    rows = stored(labelled.join(open_, "bucket"), "open")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    known = stored(signs.join(sets, "id").join(rows.select("id").distinct(), "id", "left_semi").select("id", "minima", "shingles"), "open")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(known, "id")
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "minima", "shingles")
    kind = rows.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            own = group.column(3).to_numpy()
            component = np.unique(group.column(5).to_numpy(), return_inverse=True)[1]
            low = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint32).reshape(-1, MINIMA)
            full = [np.frombuffer(x, np.uint64) for x in group.column(7).to_pylist()]
            sizes = np.array([len(x) for x in full])
            first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
            u, v = [], []
            for a in first:
                others = second[second > a] if i == j else second
                near = np.minimum(sizes[others], sizes[a]) * 100 >= percent * np.maximum(sizes[others], sizes[a])
                others = others[near & (component[others] != component[a])]
                others = others[(low[others] == low[a]).mean(axis=1) >= least]
                for b in others:
                    if component[a] != component[b]:
                        shared = _shared(full[a], full[b])
                        if 100 * shared >= percent * (sizes[a] + sizes[b] - shared):
                            component[component == component[b]] = component[a]
                            u.append(a)
                            v.append(b)
            if u:
                ids = group.column(4).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v))], ["u", "v"])

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(compare, f"u {kind}, v {kind}").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75, least_agreement: float = 0.55) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    distinct 5-word shingles (A-Z lower-cased); a text of fewer words is one shingle. Links
    are confirmed on full sets. ``component_id`` is the smallest id reachable and ``kept``
    says whether it is the row's own. Pairs that agree in fewer than ``least_agreement``
    of 128 minima are not confirmed; at a similarity of 0.75 that is more than five
    standard deviations away.

    Null, empty and white texts are linked with nothing. Rows that repeat an id are one
    document: they are linked with each other. Rows without an id are linked with nothing,
    have no ``component_id`` and are kept. Other columns are ignored; an empty table gives
    an empty result.
    """
    signs = stored(signatures(docs, id, text), "signatures")
    named = signs.filter(F.col("id").isNotNull() & F.col("same").isNotNull())
    classes = stored(named.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first"), "classes")
    members = named.select("id", "same").join(classes, "same").filter("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    # A repeated id may lead with one text what it follows with another.
    followers = named.select("id", "same").join(classes, "same").filter("id <> first").select("id", "same")
    leaders = named.join(followers, ["id", "same"], "left_anti").select("id", "minima")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("minima", k * F.lit(4 * ROWS) + 1, F.lit(4 * ROWS))))
    banded = leaders.select("id", F.explode(band).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("bucket", "least")
    hits = stored(banded.join(buckets, "bucket"), "buckets")
    sets = stored(_sets_of(docs, hits.select("id").distinct(), id, text), "sets")

    nearest = hits.filter("id <> least").groupBy("id").agg(F.min("least").alias("v")).select(F.col("id").alias("u"), "v")
    links = stored(linked(nearest, sets, percent).distinct(), "links")
    labels = stored(components(links.union(members)), "labels")
    more = stored(_open_links(hits, labels, leaders, sets, least_agreement, percent), "links")
    if not more.isEmpty():
        between = more.join(labels.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(labels.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        roots = between.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        merged = stored(components(roots), "labels").select(F.col("node").alias("root"), F.col("component").alias("top"))
        known = labels.join(merged, F.col("component") == F.col("root"), "left").select("node", F.coalesce("top", "component").alias("component"))
        added = merged.join(labels.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("component"))
        labels = known.union(added)

    out = signs.select("id", "n_shingles").join(labels.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id)


def keep_representatives(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    gone = near_duplicates(docs, id, text).filter("NOT kept").select(F.col(id).alias("_gone_id"))
    return docs.join(gone, docs[f"`{id}`"] == gone["_gone_id"], "left_anti")
