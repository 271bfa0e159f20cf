"""Readers for evaluation logs, run folders, result documents and criteria."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from sloframe.operators.ordered import add_positions

MODES = {"strict": "FAILFAST", "skip": "DROPMALFORMED", "report": "PERMISSIVE"}
CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, mode: str = "strict", recursive: bool = False, glob: str | None = None, reader: DataFrameReader | None = None) -> DataFrame:
    """JSON lines with a declared schema. ``strict`` fails on a bad line, ``skip``
    drops it, ``report`` keeps its text in ``_corrupt``. Blank lines are ignored.
    ``reader`` brings further options."""
    reader = (reader or spark.read).option("mode", MODES[mode]).option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if mode == "report":
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        schema = f"{schema}, {CORRUPT} string"
    return reader.schema(schema).json(path if isinstance(path, str) else list(path))


def read_logs(spark: SparkSession, root: str, schema: str, glob: str = "*.jsonl", mode: str = "skip") -> DataFrame:
    """All logs under a folder as one table with their ``source`` path."""
    return read_jsonl(spark, root, schema, mode, True, glob).withColumn("source", F.col("_metadata.file_path"))


def with_run_keys(df: DataFrame, source: str = "source") -> DataFrame:
    """model, task, seed from ``.../model/task/seed_N/file``."""
    part = lambda i: F.regexp_extract(source, r"([^/]+)/([^/]+)/seed_(\d+)/[^/]+$", i)
    return df.withColumns({"model": part(1), "task": part(2), "seed": part(3).try_cast("int")})


def split_run_key(key: Column) -> Column:
    """Struct(model, task, seed) of ``model_task_seedN``; the model may hold ``_``."""
    part = lambda i: F.regexp_extract(key, r"^(.*)_([^_]+)_seed(\d+)$", i)
    return F.when(
        F.rlike(key, F.lit(r"^.*_[^_]+_seed\d+$")), F.struct(part(1).alias("model"), part(2).alias("task"), part(3).try_cast("int").alias("seed"))
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_numbered_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Text lines with ``file`` and 1-based ``line``. A line's place is counted
    inside its file split and the splits' counts are added up, so a large file is
    numbered by many tasks."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path if isinstance(path, str) else list(path)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id")
    )
    placed = add_positions(raw, ["file"], [F.col("__at")], [F.col("__id")], "line")
    return placed.select("file", (F.col("line") + 1).alias("line"), "value")


RESULT_SCHEMA = "models map<string, struct<tasks: map<string, map<string, double>>>>"


def read_result_document(spark: SparkSession, path: str) -> DataFrame:
    """Rows (model, task, metrics map) of a nested result document."""
    doc = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path)
    return flatten_results(doc)


def flatten_results(doc: DataFrame) -> DataFrame:
    models = doc.select(F.explode("models").alias("model", "m"))
    return models.select("model", F.explode("m.tasks").alias("task", "metrics"))


def attach_schema(df: DataFrame, schemas: DataFrame, path: str = "schema_path") -> DataFrame:
    """Records with the schema text of their path. The schema table holds one row
    per file; Spark broadcasts it while it is small and shuffles it otherwise."""
    return df.join(schemas.select(path, "schema_json"), path, "left")


def missing_schemas(df: DataFrame, schemas: DataFrame, path: str = "schema_path") -> DataFrame:
    """Paths without a schema and how many records use them."""
    used = df.groupBy(path).agg(F.count(F.lit(1)).alias("n"))
    return used.join(schemas.select(path), path, "left_anti")


# ---- criteria ---------------------------------------------------------------

# Default limits per family.
DEFAULT_CRITERIA: dict[str, dict[str, float]] = {
    "structure": {"json_valid_min": 0.99, "schema_valid_min": 0.98, "validation_retry_rate_max": 0.05, "output_repair_rate_max": 0.02},
    "accuracy": {"clinc_intent_macro_f1_min": 0.85, "clinc_intent_accuracy_min": 0.85, "hotpot_answer_exact_match_min": 0.65, "hotpot_answer_f1_min": 0.75},
    "faithfulness": {"hotpot_faithfulness_min": 0.80, "hotpot_contradiction_rate_max": 0.05},
    "tools": {"tool_success_rate_min": 0.90, "tool_argument_schema_valid_rate_min": 0.98, "tool_calls_p95_max": 4},
    "stability": {"disagreement_max": 0.10, "runs_per_prompt": 5},
    "slo": {"p95_ms_max": 1200.0, "p99_ms_max": 2000.0, "success_at_slo_min": 0.75, "on_time_budget_ms": 1200.0, "hard_timeout_ms": 5000.0},
}


def parse_criteria(text: str) -> dict:
    """Criteria from JSON, or YAML where a YAML parser is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as exc:
            raise ValueError("YAML criteria need a YAML parser; use JSON instead") from exc
        return yaml.safe_load(text)


def load_criteria(text: str, defaults: dict[str, dict[str, float]] = DEFAULT_CRITERIA) -> dict[str, dict[str, float]]:
    """Limits per family with defaults filled in; unknown families or limits raise."""
    given = parse_criteria(text)
    unknown = [f"{f}.{k}" for f, limits in given.items() for k in limits if k not in defaults.get(f, {})]
    if unknown:
        raise ValueError(f"unknown criteria: {sorted(unknown)}")
    return {family: {**limits, **given.get(family, {})} for family, limits in defaults.items()}


def first_present(limits: dict[str, float], names: Sequence[str], default: float | None = None) -> float | None:
    """Value of the first alias present."""
    return next((limits[n] for n in names if limits.get(n) is not None), default)


def criteria_hash(criteria: dict) -> str:
    return hashlib.sha256(json.dumps(criteria, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def criteria_thresholds(criteria: dict[str, dict[str, float]]) -> list[tuple[str, str, str, float]]:
    """(family, metric, operator, limit) for every ``_min`` and ``_max`` limit."""
    out = []
    for family, limits in criteria.items():
        for name, limit in limits.items():
            if name.endswith("_min"):
                out.append((family, name[:-4], ">=", float(limit)))
            elif name.endswith("_max"):
                out.append((family, name[:-4], "<=", float(limit)))
    return out
