"""Manifests of line files as hash trees, and drift traced to a file and a range of lines.

A leaf is the digest of a block of ``fanout`` lines, a node above it that of ``fanout`` nodes
below; the top node of a file stands for all of its lines in their order. Each digest is made
from at most ``fanout`` others, so a file of any length is hashed by many tasks. Two manifests
are compared from the top: below a node that is the same nothing is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 1_000


def _digest(order: str, text: Column) -> Column:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda p: p["t"])
    return F.sha2(F.array_join(parts, ""), 256)


def line_tree(lines: DataFrame, file: str = "file", line: str = "line", text: str = "value", fanout: int = FANOUT) -> DataFrame:
    """Nodes of every file's tree: file, ``level`` (0: blocks of lines), ``node``, ``first_line``,
    ``last_line``, ``n_bytes`` and ``digest``.

    ``lines`` has a 1-based line number per file. The longest file says how many levels there
    are; a shorter one's top node is carried up unchanged in number but hashed once a level,
    so manifests made with equal ``fanout`` compare at every level.
    """
    rows = lines.select(F.col(file).alias("file"), F.col(line).cast("bigint").alias("line"), F.coalesce(text, F.lit("")).alias("text"))
    longest = rows.agg(F.max("line")).first()[0] or 1
    level = rows.groupBy("file", F.floor((F.col("line") - 1) / fanout).cast("bigint").alias("node")).agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum(F.octet_length("text")).alias("n_bytes"), _digest("line", F.md5("text")).alias("digest"),
    )
    out, depth, nodes = level.withColumn("level", F.lit(0)), 0, -(-longest // fanout)
    while nodes > 1:
        depth, nodes = depth + 1, -(-nodes // fanout)
        level = level.groupBy("file", F.floor(F.col("node") / fanout).cast("bigint").alias("up")).agg(
            F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("n_bytes").alias("n_bytes"), _digest("node", F.col("digest")).alias("digest"),
        ).withColumnRenamed("up", "node")
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out.select("file", "level", "node", "first_line", "last_line", "n_bytes", "digest")


def file_manifest(tree: DataFrame) -> DataFrame:
    """One row per file: lines, bytes and the digest of its top node."""
    top = F.struct("level", "last_line", "n_bytes", "digest")
    return tree.where("node = 0").groupBy("file").agg(F.max(top).alias("t")).select("file", F.col("t.last_line").alias("n_lines"), F.col("t.n_bytes").alias("n_bytes"), F.col("t.digest").alias("digest"))


def trace_drift(actual: DataFrame, expected: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Blocks of lines that differ between two trees: file, ``status`` (new, missing or changed),
    ``first_line`` and ``last_line`` in the longer of the two. Files that are the same on both
    sides give no row. The comparison goes down level by level and joins only the children of
    nodes that differ. Trees may have different heights: all files are compared from the
    highest level that both have."""
    heights = actual.agg(F.max("level")).first()[0], expected.agg(F.max("level")).first()[0]
    top = min((h for h in heights if h is not None), default=0)
    known = actual.select("file", F.lit(True).alias("a")).distinct().join(expected.select("file", F.lit(True).alias("e")).distinct(), "file", "full")
    files = known.select("file", F.when(F.col("e").isNull(), "new").when(F.col("a").isNull(), "missing").otherwise("changed").alias("status"))
    part = lambda tree, level, n: tree.where(F.col("level") == level).select("file", "node", F.col("digest").alias(f"{n}_digest"), F.col("first_line").alias(f"{n}_first"), F.col("last_line").alias(f"{n}_last"))
    changed = None
    for level in range(top, -1, -1):
        both = part(actual, level, "a").join(part(expected, level, "e"), ["file", "node"], "full")
        both = both.where(~F.col("a_digest").eqNullSafe(F.col("e_digest")))
        if changed is not None:
            up = changed.select("file", F.col("node").alias("up")).distinct()
            both = both.withColumn("up", F.floor(F.col("node") / fanout).cast("bigint")).join(up, ["file", "up"], "left_semi")
        changed = both
    out = changed.join(files, "file")
    return out.select("file", "status", F.least("a_first", "e_first").alias("first_line"), F.greatest("a_last", "e_last").alias("last_line"))


def require_no_trace(trace: DataFrame) -> None:
    """Raise, naming the first block that differs, unless there is none."""
    first = trace.orderBy("file", "first_line").limit(1).collect()
    if first:
        r = first[0]
        raise ValueError(f"{r['status']} file {r['file']}: lines {r['first_line']} to {r['last_line']} differ")
