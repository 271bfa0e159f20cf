"""Whitening of embeddings with MLlib's distributed block matrices.

Entries become whole numbers, so that equal vectors are equal exactly and sums are exact. The
distinct vectors, centred, are dealt into row blocks of a ``BlockMatrix``; its transpose times
itself is the scatter matrix, whose eigenvectors are found on the driver (one matrix of
dimension x dimension); a second block product projects all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sloframe.llm.store import stored

SCALE = 64
SHIFT = 1_000_000
#: Rows of a block, and the blocks of which one task adds up the products.
BLOCK_ROWS = 2_048
BLOCKS_A_TASK = 4
#: Widest vectors: the driver holds matrices of this many rows and columns.
MOST_DIMENSIONS = 4_096
#: Components whose eigenvalue is below this share of the trace count as 0 and are left out.
LEAST_SHARE = 1e-12


def whole_entries(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``x``, floor(64 c) + 1000000 of each entry c as long, of the rows whose vector
    is whole: not null or empty, no null, NaN or infinite entry and none too large for a long.
    Vectors of another length than most are left out too (if tied, the shorter length wins)."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(1 << 56)))
    entries = F.col(vector).cast("array<double>")
    good = vectors.where(F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(entries, fits), F.lit(False)))
    rows = good.select(F.col(id).alias("id"), F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), "d").first()
    if usual is None:
        return rows
    if usual["d"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {usual['d']} entries; at most {MOST_DIMENSIONS} are supported")
    return rows.where(F.size("x") == usual["d"])


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, stored, with a dense 0-based ``row``: a task numbers its own rows, and the
    numbers of rows in the tasks before are added."""
    raw = F.monotonically_increasing_id()
    kept = stored(rows.withColumn("part", F.shiftright(raw, 33)).withColumn("place", raw.bitwiseAND((1 << 33) - 1)), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return kept.join(offsets, "part").withColumn("row", F.col("offset") + F.col("place")).drop("part", "place", "offset")


def block_matrix(rows: DataFrame, entries: Column, n: int, width: int, tall: int = BLOCK_ROWS) -> BlockMatrix:
    """Row blocks of ``tall`` rows of the array column ``entries``, in the order of ``row``."""
    frame = rows.select(F.col("row").alias("index"), array_to_vector(entries).alias("vector"))
    frame = MLUtils.convertVectorColumnsFromML(frame, "vector")
    return IndexedRowMatrix(frame, n, width).toBlockMatrix(tall, width)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times matrix. The middle dimension, that of the rows, is split: a task
    multiplies a few blocks, and the products are added pairwise. (Without the split all blocks
    would meet in the one task of the one result block. Python's ``multiply`` lacks the
    argument, so the method of the wrapped matrix is called.)"""
    splits = max(1, -(-blocks.numRows() // (BLOCK_ROWS * BLOCKS_A_TASK)))
    left = blocks.transpose()
    product = left._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def projected(spark, blocks: BlockMatrix, directions: np.ndarray) -> DataFrame:
    """``row`` and ``projected``, the rows times the columns of ``directions``."""
    width, k = directions.shape
    lines = spark.createDataFrame([(i, line.tolist()) for i, line in enumerate(directions)], "row long, entries array<double>")
    right = block_matrix(lines.coalesce(1), F.col("entries"), width, k, width)
    product = blocks.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)  # stays in the JVM
    return rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("projected"))


def whiten(vectors: DataFrame, components: int = 16, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.

    The model is fitted on the ``n`` distinct vectors of whole entries, see ``whole_entries``,
    and applied to every row that has one. Component 1 has the largest variance. ``whitened``
    is the centred vector projected on the component over the root of its variance,
    ``explained`` the component's share of all variance, ``deviation`` the exact sum of
    (n x - S) ** 2 over the dimensions (an arithmetic error if it is beyond a long), and
    ``identity_error`` the largest difference between the covariance of the whitened distinct
    vectors and the identity. Components without variance are left out, so there are fewer
    than ``components`` for few or narrow vectors, and no row at all if all vectors are equal
    or none is whole. Rows that repeat an id or a vector are kept as they are; ids may be null.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = numbered(whole_entries(vectors, id, vector), "vectors")
    fit = numbered(rows.select("x").distinct(), "distinct")
    schema = f"`{id}` {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = first["d"]
    # Sums are gathered as one row of `width` numbers.
    by_place = fit.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sums, n = [r["s"] for r in sorted(by_place, key=lambda r: r["place"])], by_place[0]["n"]
    n_rows = rows.count()
    s = F.array(*[F.lit(v).cast("long") for v in sums])
    # x - S / n is worked out as (n x - S) / n: whole numbers first, one rounding.
    spread = F.zip_with("x", s, lambda x, total: x * F.lit(n) - total)
    centred = F.transform(spread, lambda v: v.cast("double") / F.lit(float(n)))

    matrix = block_matrix(fit, centred, n, width)
    variance = scatter(matrix) / n
    values, columns = np.linalg.eigh((variance + variance.T) / 2)
    values, columns = values[::-1], columns[:, ::-1]
    trace = float(np.trace(variance))
    k = int(np.count_nonzero(values[:components] > max(LEAST_SHARE * trace, 0.0)))
    if not k:
        return spark.createDataFrame([], schema)
    directions = columns[:, :k] / np.sqrt(values[:k])

    white = stored(projected(spark, matrix, directions), "whitened")
    means = white.agg(*[F.avg(F.col("projected")[i]).alias(f"m{i}") for i in range(k)]).first()
    level = F.zip_with("projected", F.array(*[F.lit(m) for m in means]), lambda v, m: v - m)
    covariance = scatter(block_matrix(white, level, n, k)) / n
    error = float(np.abs(covariance - np.eye(k)).max())

    deviation = F.aggregate(spread, F.lit(0).cast("long"), lambda total, v: total + v * v)
    scores = projected(spark, block_matrix(rows, centred, n_rows, width), directions)
    facts = rows.select("row", F.col("id").alias(id), deviation.alias("deviation"))
    shares = F.array(*[F.lit(float(v / trace)) for v in values[:k]])
    out = facts.join(scores, "row").select(id, "deviation", F.posexplode("projected").alias("place", "whitened"))
    return out.select(id, (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))
