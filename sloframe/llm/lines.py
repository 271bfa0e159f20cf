"""Line dedup: lines that many documents share are removed everywhere."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloframe.llm.store import stored
from sloframe.llm.textbatch import WHITE


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(batch.schema.names.index(name)).fill_null("").cast(pa.binary()).to_pylist()


def _key(line: bytes) -> bytes:
    """Normal form of a line; ``bytes.lower`` changes A-Z only."""
    return line.strip(WHITE).lower()


def _hash(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode()) >= chars)


def _keys(text: bytes, chars: int) -> set[bytes]:
    return {_hash(k) for k in {_key(x) for x in text.split(b"\n")} if _long_enough(k, chars)}


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, id: str | None = None) -> DataFrame:
    """``line`` (128-bit hash of the normal form) and ``n_docs`` of lines that at least
    ``min_docs`` documents hold. Counts are merged per Arrow batch and per task before the
    shuffle, so a line that every document holds is a few rows per task.

    With ``id``, rows that repeat an id are one document: their lines are counted once per
    id, from the distinct pairs of line and id of those rows alone. A null id is not
    repeated. Without ``id`` each row is a document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter()
            for t in _texts(batch):
                n.update(_keys(t, min_chars))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["line", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text"), *([F.col(id).alias("id")] if id else []))
    if id is None:
        counted = rows.mapInArrow(count, "line binary, n long")
    else:
        repeated = stored(rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
        counted = rows.join(repeated, "id", "left_anti").select("text").mapInArrow(count, "line binary, n long")
        again = _pairs(rows.join(repeated, "id", "left_semi").select("id", "text"), min_chars).distinct()
        counted = counted.union(again.groupBy("line").agg(F.count("*").alias("n")))
    return counted.groupBy("line").agg(F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def _pairs(rows: DataFrame, min_chars: int) -> DataFrame:
    """``id`` and ``line`` of the distinct lines of each row; ``rows`` has id and text."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, lines = [], []
            for i, t in enumerate(_texts(batch)):
                keys = _keys(t, min_chars)
                lines += keys
                place += [i] * len(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int32())), pa.array(lines, pa.binary())], ["id", "line"])

    return rows.mapInArrow(pairs, f"id {rows.schema['id'].dataType.simpleString()}, line binary")


def _split(texts: list[bytes], lost: pa.Array) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The lines of each text, and those that stay."""
    for t, gone in zip(texts, lost.to_pylist(), strict=True):
        lines = t.split(b"\n")
        gone = set(gone or ())
        yield lines, [x for x in lines if _hash(_key(x)) not in gone] if gone else lines


def _free_name(name: str, df: DataFrame) -> str:
    """``name``, or that with underscores before it, that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _with_lost(rows: DataFrame, id: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """``rows`` and, as last column, the hashes of their lines to drop."""
    pairs_of = rows.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    # Stored, so that both sides of the join are plain shuffles, which Spark can split.
    frequent = stored(frequent_lines(pairs_of, "text", min_docs, min_chars, "id").select("line"), "lines")
    lost = _pairs(pairs_of, min_chars).join(frequent, "line", "left_semi")
    lost = lost.groupBy("id").agg(F.collect_set("line").alias("_lost")).withColumnRenamed("id", "_lost_id")
    joined = rows.join(lost, rows[f"`{id}`"].eqNullSafe(lost["_lost_id"]), "left")
    return joined.select(*[rows[f"`{c}`"] for c in rows.columns], lost["_lost"].alias(_free_name("lost", rows)))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per row: the id, ``kept_text``, ``n_lines`` and ``n_dropped``.

    A text is split at ``\\n``; a line's normal form has white space stripped at both ends
    and A-Z lower-cased. Lines whose normal form has ``min_chars`` code points and is
    found in ``min_docs`` documents are dropped from every row; the others stay in place.

    Rows that repeat an id count as one document, rows without an id as documents of their
    own; each row has its own result. A null or empty text is one empty line, which is kept. Other columns are ignored, whatever their
    names; an empty table gives an empty result. No line's rows meet in one task: the
    counts are partial sums and the join that finds the lines to drop is one Spark splits
    when it is skewed. Ids with the same value share one list of dropped lines, which is
    right because whether a line is dropped depends on the line alone.
    """
    joined = _with_lost(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")), "id", "text", min_docs, min_chars).select("id", "text", "lost")
    id_type = joined.schema["id"].dataType.simpleString()

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            kept, total, dropped = [], [], []
            for lines, stay in _split(texts, batch.column(2)):
                kept.append(b"\n".join(stay))
                total.append(len(lines))
                dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], ["id", "kept_text", "n_lines", "n_dropped"])

    out = joined.mapInArrow(rebuild, f"id {id_type}, kept_text string, n_lines long, n_dropped long")
    return out.withColumnRenamed("id", id)


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the lines dropped from its texts; a null text stays null."""
    joined = _with_lost(docs, id, text, min_docs, min_chars)
    place = docs.columns.index(text)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b"\n".join(stay) for _, stay in _split(_texts(batch, text), batch.column(batch.num_columns - 1))]
            column = pa.array(kept, pa.binary(), mask=np.array(batch.column(place).is_null())).cast(pa.string())
            columns = [column if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(rebuild, docs.schema)
