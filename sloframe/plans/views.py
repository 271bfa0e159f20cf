"""Views that give the driver tables the shape of evaluation logs, in Spark and SQL.

Each view has a Spark builder and a SQL text (``*_SQL``, usable as a CTE) with the
same columns, so every query can be checked by an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloframe.operators.ordered import add_positions


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def wide(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table."""
    t = table(spark, d, name)
    return t.select(*columns) if columns else t


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by their id before work that is heavy per row: a scan has no more tasks
    than the files have row groups. As many partitions as a shuffle has, or cores if more."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def episodes(spark: SparkSession, d: str, heavy: bool = False) -> DataFrame:
    """Requests as evaluation episodes; ``heavy`` deals them out first."""
    e = table(spark, d, "events")
    e = dealt(e, "event_id") if heavy else e
    k = F.get_json_object("props", "$.k").cast("bigint")
    eid = F.col("event_id")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        F.concat(F.lit("m"), F.col("user_id") % 13).alias("model"),
        F.col("event_type").alias("task"),
        F.concat_ws("|", "user_id", "event_type").alias("prompt_id"),
        (F.col("value") * 100).alias("latency_ms"),
        k.alias("k"),
        (eid % 97 != 0).alias("json_valid"),
        ((eid % 97 != 0) & (k >= 12)).alias("schema_valid"),
        (k >= 30).alias("task_correct"),
        F.col("props").alias("output_json"),
        F.concat(F.lit("d"), eid % 3).alias("decode_mode"),
        F.when(eid % 11 != 0, F.col("value") * 10).alias("ttft_ms"),
        (k * 3).alias("tokens_out"),
        (eid % 5 == 0).cast("int").alias("retry_count"),
        (eid % 7 == 0).cast("int").alias("repair_count"),
        (1 + eid % 3).cast("int").alias("candidate_count"),
        (k / 100.0).alias("faithfulness"),
        ((F.col("value") * 100 <= 5000) & (eid % 97 != 0) & (k >= 30)).cast("double").alias("success_at_slo"),
    )


EPISODES_SQL = """episodes AS (
  SELECT event_id, ts, user_id, 'm' || (user_id % 13) AS model, event_type AS task,
    user_id || '|' || event_type AS prompt_id, value * 100 AS latency_ms, k,
    event_id % 97 <> 0 AS json_valid, event_id % 97 <> 0 AND k >= 12 AS schema_valid, k >= 30 AS task_correct,
    props AS output_json, 'd' || (event_id % 3) AS decode_mode,
    CASE WHEN event_id % 11 <> 0 THEN value * 10 END AS ttft_ms, k * 3 AS tokens_out,
    CAST(event_id % 5 = 0 AS INT) AS retry_count, CAST(event_id % 7 = 0 AS INT) AS repair_count,
    CAST(1 + event_id % 3 AS INT) AS candidate_count, k / 100.0::DOUBLE AS faithfulness,
    CAST(value * 100 <= 5000 AND event_id % 97 <> 0 AND k >= 30 AS INT)::DOUBLE AS success_at_slo
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

TIERS_SQL = """tiers(tier, deadline_ms) AS (VALUES ('interactive', 2000.0::DOUBLE), ('standard', 5000.0::DOUBLE), ('batch', 30000.0::DOUBLE))"""

# Model dimension: key, size in billions, vendor, family. m12 has no row on purpose,
# so that lookups meet an unknown key.
MODELS = [
    (f"m{i}", size, f"v{i % 4}", f"f{i % 5}")
    for i, size in enumerate([1.0, 3.0, 3.0, 4.0, 3.8, 6.0, 7.0, 7.0, 8.0, 8.0, 9.0, 12.0])
]
MODEL_DIM_SQL = "model_dim(model, size_b, vendor, family) AS (VALUES " + ", ".join(
    f"('{m}', {s}::DOUBLE, '{v}', '{f}')" for m, s, v, f in MODELS
) + ")"


def model_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, size_b double, vendor string, family string")


def steps_raw(spark: SparkSession, d: str) -> DataFrame:
    """Training step rows without the step number; ``at`` orders a run."""
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("m"), F.col("o_custkey") % 11).alias("model"),
        F.when(F.col("o_custkey") % 6 == 5, F.lit("Mixed")).otherwise(F.concat(F.lit("T"), F.col("o_custkey") % 6 + 1)).alias("task"),
        F.floor(F.col("o_custkey") % 198 / 66).cast("int").alias("seed"),
        F.struct(F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("id")).alias("at"),
        (F.col("o_totalprice") / 99991).alias("reward"),
        (F.col("o_orderstatus") == "F").cast("int").alias("json_valid"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 99.991).alias("latency_ms"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") % 512).alias("tokens_out"),
    )


RUN = ["model", "task", "seed"]


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Step rows with a dense 0-based ``step`` per run."""
    raw = steps_raw(spark, d)
    return add_positions(
        raw,
        RUN,
        [F.col("at.day"), F.floor(F.col("at.id") / 1_048_576)],
        [F.col("at")],
        "step",
    )


STEPS_SQL = """steps AS (
  SELECT *, row_number() OVER (PARTITION BY model, task, seed ORDER BY day, id) - 1 AS step FROM (
    SELECT 'm' || (o_custkey % 11) AS model,
      CASE WHEN o_custkey % 6 = 5 THEN 'Mixed' ELSE 'T' || (o_custkey % 6 + 1) END AS task,
      CAST(o_custkey % 198 // 66 AS INT) AS seed, o_orderdate AS day, o_orderkey AS id,
      o_totalprice / 99991 AS reward, CAST(o_orderstatus = 'F' AS INT) AS json_valid,
      CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 99.991::DOUBLE END AS latency_ms,
      CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 512 END AS tokens_out
    FROM orders))"""
