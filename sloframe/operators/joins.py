"""Joins and keyed reductions that evaluation logs need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloframe.functions.text import lower_trim


def keep_last(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Last row per key, reduced map-side (no sort of a key's rows). Rows without an order
    value come before all others."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order.isNotNull(), order)).alias("__r")).select(*keys, "__r.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """First row per key; rows without an order value come first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order.isNotNull(), order)).alias("__r")).select(*keys, "__r.*")


def pred_gold(pred: DataFrame, gold: DataFrame, key: str, order: Column) -> DataFrame:
    """Gold rows with their prediction; the last prediction of an id wins and a
    gold row without one has ``missing`` set."""
    last = keep_last(pred, [key], order).withColumn("__hit", F.lit(True))
    joined = gold.join(last, key, "left")
    return joined.withColumn("missing", F.col("__hit").isNull()).drop("__hit")


def positional(left: DataFrame, right: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Line-by-line join on explicit line numbers; the longer side is cut."""
    return left.join(right, [*keys, line], "inner")


def positional_many(logs: Sequence[DataFrame], keys: Sequence[str], line: str, value: str) -> DataFrame:
    """Any number of logs side by side: ``keys``, line and ``values``, one from each log in their
    order, of the lines that all logs have. One shuffle, whatever the number of logs; a line
    that a log holds twice has no place and is left out."""
    tagged = [log.select(*keys, line, F.lit(i).alias("__log"), F.col(value).alias("__v")) for i, log in enumerate(logs)]
    rows = tagged[0]
    for log in tagged[1:]:
        rows = rows.unionByName(log)
    met = rows.groupBy(*keys, line).agg(F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list(F.struct("__log", "__v"))).alias("__all"))
    whole = met.where((F.col("__n") == len(logs)) & (F.size(F.array_distinct("__all.__log")) == len(logs)))
    return whole.select(*keys, line, F.transform("__all", lambda x: x["__v"]).alias("values"))


def lengths_differ(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose two sides have different row counts."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_rows"))
    both = a.join(b, list(keys), "full")
    filled = both.na.fill(0, ["left_rows", "right_rows"])
    return filled.where("left_rows <> right_rows")


def lookup(df: DataFrame, dim: DataFrame, key: str, columns: Sequence[str], default: object = "unknown", keep_unknown: bool = True) -> DataFrame:
    """Dimension values by key. Unknown keys get the default (text columns) or
    are dropped. The join strategy is left to Spark's size estimates."""
    joined = df.join(dim.select(key, *columns), key, "left" if keep_unknown else "inner")
    if not keep_unknown:
        return joined
    types = dict(dim.dtypes)
    return joined.select(
        *[c for c in joined.columns if c not in columns],
        *[F.coalesce(F.col(c), F.lit(default)).alias(c) if types[c] == "string" else F.col(c) for c in columns],
    )


def unmatched(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not known yet (incremental runs, unknown schemas)."""
    return df.join(known.select(*keys), list(keys), "left_anti")


def matched(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(known.select(*keys), list(keys), "left_semi")


def text_labels(source: DataFrame, text: str, label: str, order: Column) -> DataFrame:
    """Label per normalised text; the first occurrence wins."""
    return (
        source.where(F.col(text).isNotNull() & F.col(label).isNotNull())
        .groupBy(lower_trim(F.col(text)).alias("__text"))
        .agg(F.min_by(label, order).alias("__label"))
        .where("__text <> ''")
    )


def relabel_by_text(df: DataFrame, text: str, label_id: str, labels: Sequence[str], table: DataFrame) -> DataFrame:
    """Label by text, else by numeric id in ``labels``. ``label_error`` marks ids
    outside the list (such rows have no label)."""
    joined = df.withColumn("__text", lower_trim(F.col(text))).join(table, "__text", "left").drop("__text")
    names = F.array(*[F.lit(x) for x in labels])
    by_id = F.when((F.col(label_id) >= 0) & (F.col(label_id) < len(labels)), F.element_at(names, (F.col(label_id) + 1).cast("int")))
    label = F.coalesce(F.col("__label"), by_id)
    return joined.withColumn("label", label).withColumn("label_error", label.isNull()).drop("__label")


def rename_keys(df: DataFrame, key: str, mapping: DataFrame, old: str, new: str, default: str = "?") -> DataFrame:
    """Replace keys by a map between two naming schemes."""
    pairs = mapping.select(F.col(old).alias(key), F.col(new).alias("__new"))
    return df.join(pairs, key, "left").withColumn(key, F.coalesce("__new", F.lit(default))).drop("__new")


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of logs whose columns differ; missing ones are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
