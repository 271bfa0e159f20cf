"""Writers for facts, summaries, series and small text tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).json(path) if partition_by else df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Columnar facts; partition by the keys that later filters use (model, task)."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _cells(df: DataFrame, formats: dict[str, str], missing: str) -> list[Column]:
    shown = lambda c: F.format_string(formats[c], F.col(c)) if c in formats else F.col(c).cast("string")
    return [F.when(F.col(c).isNull(), F.lit(missing)).otherwise(shown(c)) for c in df.columns]


def _line(df: DataFrame, style: str, formats: dict[str, str]) -> Column:
    if style == "series":
        return F.concat_ws(" ", *_cells(df, formats, "nan"))
    if style == "markdown":
        return F.concat(F.lit("| "), F.concat_ws(" | ", *_cells(df, formats, "")), F.lit(" |"))
    if style == "latex":
        escaped = [F.regexp_replace(c, r"([_%&#$])", r"\\$1") for c in _cells(df, formats, "")]
        return F.concat(F.concat_ws(" & ", *escaped), F.lit(r" \\"))
    raise ValueError(f"unknown table style {style!r}")


def series_lines(df: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    """``line`` per row, cells separated by one space (missing ones ``nan``)."""
    return df.select(_line(df, "series", formats or {}).alias("line"))


def markdown_lines(df: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    return df.select(_line(df, "markdown", formats or {}).alias("line"))


def latex_lines(df: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    """Table rows with the special characters of text cells escaped."""
    return df.select(_line(df, "latex", formats or {}).alias("line"))


def header_lines(columns: Sequence[str], style: str) -> list[str]:
    if style == "markdown":
        return ["| " + " | ".join(columns) + " |", "|" + "|".join("---" for _ in columns) + "|"]
    if style == "latex":
        return [" & ".join(columns).replace("_", r"\_") + r" \\"]
    return [" ".join(columns)]


def write_text_table(df: DataFrame, path: str, order: Sequence[str], style: str = "markdown", formats: dict[str, str] | None = None, mode: str = "errorifexists", most: int = 100_000) -> None:
    """One ordered text file from a report table. The table is an aggregate (models,
    tasks, tiers) and small, so its line numbers come from one window; one of more than
    ``most`` rows is refused."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a report of more than {most} rows does not belong in one text file")
    place = F.row_number().over(Window.orderBy(*order))
    cells = df.select(place.alias("__i"), _line(df, style, formats or {}).alias("line"))
    head = df.sparkSession.createDataFrame(list(enumerate(header_lines(df.columns, style), start=-9)), "__i int, line string")
    head.union(cells).repartition(1).sortWithinPartitions("__i").select("line").write.mode(mode).text(path)


def in_order(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> tuple[DataFrame, DataFrame]:
    """``df`` with its 0-based ``name`` in an order, kept in that order over its partitions, and
    a table of the partitions: ``part``, ``first`` and ``n``.

    Rows are dealt out by ranges of the order and sorted within; the partitions' counts, one
    number each, are added up to the places they start from. The result is checkpointed, as
    ranges are drawn anew whenever they are worked out again.
    """
    from sloframe.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    at = F.monotonically_increasing_id()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = dealt.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND((1 << 33) - 1)).checkpoint()
    counts = sorted(tuple(r) for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    first, total = {}, 0
    for part, n in counts:
        first[part], total = total, total + n
    offset = F.from_json(F.lit(json.dumps(first)), "map<string,bigint>")[F.col("__part").cast("string")]
    listing = spark.createDataFrame([(p, first[p], n) for p, n in counts], "part bigint, first bigint, n bigint")
    return kept.withColumn(name, offset + F.col("__at")).drop("__part", "__at"), listing


def write_ordered_lines(
    df: DataFrame, path: str, order: Sequence[str | Column], style: str = "series", formats: dict[str, str] | None = None, header: bool = True, mode: str = "errorifexists",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A text table of any size, in order over numbered part files, which several tasks write;
    the header is the first line of the first one. ``columns`` are all of them by default.
    Returns the listing of ``in_order``."""
    rows, listing = in_order(df, order, "__place")
    shown = df.select(*columns) if columns else df
    head = header_lines(shown.columns, style) if header else []
    line = _line(shown, style, formats or {})
    lines = F.when(F.col("__place") == 0, F.array(*[F.lit(h) for h in head], line)).otherwise(F.array(line))
    rows.select(F.explode(lines).alias("line")).write.mode(mode).text(path)
    if head and listing.isEmpty():
        df.sparkSession.createDataFrame([(h,) for h in head], "line string").coalesce(1).write.mode("append").text(path)
    return listing


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the part files that ``write_ordered_lines`` wrote, as ``number`` (from 1 over
    all files, by their names) and ``value``."""
    from sloframe.operators.ordered import attach
    from sloframe.sources.readers import read_numbered_lines

    lines = read_numbered_lines(spark, path, "part-*")
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    starts = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return attach(lines, starts, ["file"]).select((F.col("__start") + F.col("line")).alias("number"), "value")
