"""Content fingerprints that do not depend on row order or file layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloframe.operators.ordered import attach


def row_text(columns: Sequence[str]) -> Column:
    """Row as text. A cell is written with its length, so no two rows share a text; NULL
    and the empty string differ."""
    text = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.lit("="), F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in text])


def table_fingerprint(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and two sums over row hashes, per group. Sums are decimal, so any
    number of rows fits, and partial sums merge in any order."""
    columns = list(columns or [c for c in df.columns if c not in by])
    # Entries of a map have no order of their own.
    maps = [c for c, kind in df.dtypes if c in columns and kind.startswith("map<")]
    df = df.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps}) if maps else df
    digest = F.md5(row_text(columns))
    word = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(20,0)")
    out = df.select(*by, word(1).alias("__a"), word(17).alias("__b")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("__a").alias("__a"), F.sum("__b").alias("__b")
    )
    text = F.concat_ws("-", F.col("n_rows").cast("string"), F.col("__a").cast("string"), F.col("__b").cast("string"))
    return out.select(*by, "n_rows", text.alias("fingerprint"))


def file_fingerprints(lines: DataFrame, file: str, text: str) -> DataFrame:
    """Records, bytes and fingerprint per file from its lines; blank lines are no records."""
    kept = lines.where(F.trim(text) != "").select(file, text)
    size = kept.groupBy(file).agg(F.sum(F.octet_length(text)).alias("n_bytes"))
    return attach(table_fingerprint(kept, [file], [text]), size, [file])


def small_file_hashes(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """sha256 and size of small whole files such as schemas."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def drift(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str = "fingerprint") -> DataFrame:
    """Full comparison of two fingerprint tables with a status per key."""
    a = actual.select(*keys, F.col(value).alias("actual"))
    e = expected.select(*keys, F.col(value).alias("expected"))
    status = (
        F.when(F.col("expected").isNull(), "new").when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("expected"), "same").otherwise("changed")
    )
    return a.join(e, list(keys), "full").select(*keys, "actual", "expected", status.alias("status"))


def require_no_drift(report: DataFrame) -> DataFrame:
    """The report, raising on the first key that is not ``same`` when it is read."""
    bad = F.col("status") != "same"
    return report.withColumn("status", F.when(bad, F.raise_error(F.concat(F.lit("fingerprint drift: "), "status")).cast("string")).otherwise(F.col("status")))


def snapshot(df: DataFrame, root: str, fingerprint: str) -> str:
    """Write to a content-addressed folder; an existing snapshot is kept."""
    target = f"{root.rstrip('/')}/fp={fingerprint}"
    df.write.mode("ignore").parquet(target)
    return target
