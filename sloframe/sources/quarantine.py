"""Logs with damaged files: what can be read, and a table of the files that cannot.

A reader that meets a damaged compressed file either fails the job or silently keeps the lines
before the damage. Here each file is read to its end once, as bytes, and gets an outcome; rows
then come from the files that are whole.
"""

from __future__ import annotations

import bz2
import codecs
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloframe.sources.readers import read_jsonl

OUTCOMES = "path string, n_bytes bigint, status string, error string"
_CHUNK = 1 << 20


def _unpacked(path: str, content: memoryview) -> Iterator[bytes]:
    """The bytes that the file's name says it holds, in pieces; raises where it is damaged."""
    make = {"gz": lambda: zlib.decompressobj(31), "bz2": bz2.BZ2Decompressor}.get(path.rsplit(".", 1)[-1].lower())
    if make is None:
        for a in range(0, len(content), _CHUNK):
            yield bytes(content[a: a + _CHUNK])
        return
    unpack, open_ = make(), False
    for a in range(0, len(content), _CHUNK):
        piece = bytes(content[a: a + _CHUNK])
        while piece:
            open_ = True
            yield unpack.decompress(piece)
            piece = b""
            if unpack.eof:  # a file may hold several packed parts
                piece, unpack, open_ = unpack.unused_data, make(), False
    if open_:
        raise EOFError("the file ends before its packed data does")


def _error(path: str, content: memoryview) -> str | None:
    try:
        decode = codecs.getincrementaldecoder("utf-8")().decode
        for piece in _unpacked(path, content):
            decode(piece)
        decode(b"", final=True)
    except (zlib.error, OSError, EOFError, UnicodeDecodeError) as e:
        return f"{type(e).__name__}: {str(e)[:200]}"
    return None


def read_outcomes(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path``, ``n_bytes``, ``status`` (``ok`` or ``unreadable``) and ``error`` of every file under
    a folder. A file is unreadable if its gzip or bzip2 data is damaged or cut short, or its
    text is not UTF-8; empty files are not listed. Spark reads the bytes, so any file system will do; a task holds the
    packed bytes of a batch of files and one piece of what they hold."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = batch.column(0).to_pylist(), batch.column(1)
            errors = [_error(p, memoryview(c.as_buffer())) for p, c in zip(paths, batch.column(2), strict=True)]
            status = ["ok" if e is None else "unreadable" for e in errors]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), sizes.cast(pa.int64()), pa.array(status, pa.string()), pa.array(errors, pa.string())], ["path", "n_bytes", "status", "error"])

    return files.select(F.col("_metadata.file_path").alias("path"), "length", "content").mapInArrow(check, OUTCOMES)


def read_whole_logs(spark: SparkSession, root: str, schema: str, glob: str = "*.jsonl*", mode: str = "skip") -> tuple[DataFrame, DataFrame]:
    """The rows of all logs under a folder that can be read to their end, with ``source``, and the
    outcome of every file. Outcomes are kept, so both tables tell of the same state."""
    from sloframe.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    outcomes = read_outcomes(spark, root, glob).checkpoint()
    whole = outcomes.where("status = 'ok'").select(F.col("path").alias("source"))
    # Reading on past damage; the rows of damaged files go in the join.
    reader = spark.read.option("ignoreCorruptFiles", True)
    rows = read_jsonl(spark, root, schema, mode, True, glob, reader=reader).withColumn("source", F.col("_metadata.file_path"))
    return rows.join(whole, "source", "left_semi").select(*rows.columns), outcomes
