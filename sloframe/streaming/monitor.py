"""Request and step monitoring. Every operator works on a stream or a static table;
the static form is the one that is checked against another engine."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sloframe.operators.ordered import CHUNK, add_positions, attach, decayed_baseline, exact_quantiles
from sloframe.session import ensure_checkpoint_dir


def tail_logs(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Stream of append-only log files with a declared schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def event_time(df: DataFrame, column: str, delay: str | None = None) -> DataFrame:
    """Column as a zoned timestamp (watermarks need one), with a watermark on streams."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, delay) if delay else out


def slo_windows(df: DataFrame, ts: str, keys: Sequence[str], deadline_ms: float, width: str, slide: str | None = None) -> DataFrame:
    """Success under the deadline per time window and key, with on-time share and the 95th
    percentile of latency.

    On a table the percentile is exact, however full a window is. On a stream it comes from a
    bounded sketch: its rank is off by at most 1 / 10,000 of the window's rows, so it is exact
    up to 10,000 rows.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    on_time = F.col("latency_ms") <= deadline_ms
    good = on_time & F.col("task_correct") & F.col("json_valid")
    n = F.count(F.lit(1))
    counts = [n.alias("n"), F.count_if(on_time).alias("on_time"), F.count_if(good).alias("success"), (100.0 * F.count_if(good) / n).alias("success_pct")]
    group = ["window_start", "window_end", *keys]
    if df.isStreaming:
        out = df.groupBy(window.alias("w"), *keys).agg(*counts, F.percentile_approx("latency_ms", 0.95, 10_000).alias("p95_latency_ms"))
        return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "on_time", "success", "success_pct", "p95_latency_ms")
    rows = df.withColumn("__w", window).withColumns({"window_start": F.col("__w.start"), "window_end": F.col("__w.end")})
    tail = exact_quantiles(rows, group, F.col("latency_ms"), {"p95_latency_ms": 0.95}, rule="discrete")
    return attach(rows.groupBy(*group).agg(*counts), tail, group)


def sessions_stream(df: DataFrame, ts: str, user: str, gap: str, value: str) -> DataFrame:
    """Session roll-up on a stream (native session windows)."""
    return (
        df.groupBy(F.session_window(ts, gap).alias("w"), user)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
    )


def sessions(df: DataFrame, ts: str, user: str, gap_seconds: int, value: str) -> DataFrame:
    """Session roll-up of a table, safe for one user with very many rows.

    Rows of one gap-wide time slot are always in the same session, so they are
    merged before any ordering; only slot summaries of a user are then ordered.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    slots = df.select(user, micros.alias("__t"), F.col(value).alias("__v")).groupBy(user, F.floor(F.col("__t") / gap).alias("__slot")).agg(
        F.min("__t").alias("__lo"), F.max("__t").alias("__hi"), F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__s")
    )
    w = Window.partitionBy(user).orderBy("__slot")
    starts = F.coalesce((F.col("__lo") - F.lag("__hi").over(w) > gap).cast("int"), F.lit(1))
    numbered = slots.withColumn("__new", starts).withColumn("__session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy(user, "__session")
        .agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.sum("__n").alias("n"), F.sum("__s").alias("total"))
        .select(
            user,
            F.timestamp_micros("__lo").alias("session_start"),
            F.timestamp_micros(F.col("__hi") + gap).alias("session_end"),
            "n",
            "total",
        )
    )


def drop_replays(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First row per id: within the watermark on a stream, overall on a table."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def late_rows(all_rows: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the full log that the stream's output does not contain."""
    return all_rows.join(seen.select(*keys), list(keys), "left_anti")


BASELINE_STATE = "run string, baseline double, last bigint"
BASELINE_TABLE = "run string, step bigint, reward double, baseline double, advantage double"
BASELINE_PENDING = "run string, step bigint, reward double"
BASELINE_REJECTED = "run string, step bigint, reason string, n bigint"


def _advance(batch: DataFrame, number: int, root: str, keep: float, delay: int | None) -> None:
    """Work on one micro-batch as a table; ``delay`` None lets everything go that waits."""
    spark = batch.sparkSession

    def before(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{root}/{name}/batch={number - 1}") if number > 0 else spark.createDataFrame([], schema)

    def written(df: DataFrame, name: str, schema: str) -> DataFrame:
        path = f"{root}/{name}/batch={number}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)

    state = before("state", BASELINE_STATE)
    # A step that waits already goes before its repeats; of repeats in one batch the least reward stays.
    rows = before("pending", BASELINE_PENDING).withColumn("__new", F.lit(0)).unionByName(
        batch.select("run", F.col("step").cast("bigint"), F.col("reward").cast("double")).withColumn("__new", F.lit(1))
    )
    merged = rows.groupBy("run", "step").agg(F.min(F.struct("__new", "reward")).alias("__first"), F.count(F.lit(1)).alias("n"))
    merged = attach(merged.select("run", "step", "__first.reward", "n"), state, ["run"])
    merged = written(merged.withColumnRenamed("baseline", "start"), "merged", "run string, step bigint, reward double, n bigint, start double, last bigint")
    late = F.col("step") <= F.coalesce("last", F.lit(-(1 << 62)))
    wrong = F.when(late | F.col("step").isNull(), F.lit("late")).when(F.col("n") > 1, F.lit("repeated"))
    rejected = merged.where(wrong.isNotNull()).select("run", "step", wrong.alias("reason"), (F.col("n") - (~F.coalesce(late, F.lit(True))).cast("int")).alias("n"))
    written(rejected, "rejected", BASELINE_REJECTED)
    fresh = merged.where(F.col("step").isNotNull() & ~late)
    if delay:
        fresh = attach(fresh, fresh.groupBy("run").agg((F.max("step") - delay).alias("__upto")), ["run"])
        written(fresh.where("step > __upto").select("run", "step", "reward"), "pending", BASELINE_PENDING)
        fresh = fresh.where("step <= __upto")
    else:
        written(spark.createDataFrame([], BASELINE_PENDING), "pending", BASELINE_PENDING)
    placed = add_positions(fresh, ["run"], [F.floor(F.col("step") / CHUNK)], [F.col("step")], "__pos")
    carried = F.coalesce("start", F.lit(0.0)) * F.pow(F.lit(keep), F.col("__pos"))
    out = decayed_baseline(placed, ["run"], "__pos", F.col("reward"), keep).withColumn("baseline", F.col("baseline") + carried)
    done = written(out.select("run", "step", "reward", "baseline", (F.col("reward") - F.col("baseline")).alias("advantage")), "table", BASELINE_TABLE)
    after = keep * F.col("baseline") + (1.0 - keep) * F.col("reward")
    new = done.groupBy("run").agg(F.max_by(after, "step").alias("baseline"), F.max("step").alias("last"))
    written(new.unionByName(state.join(new, "run", "left_anti")), "state", BASELINE_STATE)


def start_running_baseline(steps: DataFrame, root: str, keep: float = 0.9, delay: int = 0, **trigger) -> StreamingQuery:
    """Advantage of each step against its run's running baseline, from a stream with
    columns run, step, reward.

    Each micro-batch is worked on as a table: a run's steps are ordered block by
    block and joined with the run's state (baseline, last step) from the batch
    before, so one run with most of the rows still spreads over many tasks.

    Steps may come out of order: those less than ``delay`` steps behind a run's highest one
    wait, and go into the baseline in their order once the run has moved on (or by
    ``flush_running_baseline``, when no more will come). Nothing vanishes: a step at or
    before the last one let go, or without a number, is counted as ``late`` and a further
    copy of a waiting step as ``repeated`` in the table ``rejected``. Output, state, waiting
    and rejected steps are written per batch number and overwritten when a batch is replayed.
    """

    def advance(batch: DataFrame, number: int) -> None:
        _advance(batch, number, root, keep, delay)

    return steps.writeStream.foreachBatch(advance).option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def flush_running_baseline(spark: SparkSession, root: str, keep: float = 0.9) -> None:
    """Let the waiting steps go as one more batch. A stream that goes on afterwards starts from
    its own last batch again and overwrites this one."""
    last = spark.read.schema(BASELINE_STATE + ", batch bigint").parquet(f"{root}/state").select(F.max("batch")).first()[0]
    done = spark.read.schema(BASELINE_REJECTED + ", batch bigint").parquet(f"{root}/merged").select(F.max("batch")).first()[0]
    number = max(last or 0, done or 0)
    _advance(spark.createDataFrame([], BASELINE_PENDING), number + 1, root, keep, None)


def baseline_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(BASELINE_TABLE).parquet(f"{root}/table/*")


def rejected_steps(spark: SparkSession, root: str) -> DataFrame:
    """Run, step, reason and number of the steps that did not enter a baseline."""
    return spark.read.schema(BASELINE_REJECTED).parquet(f"{root}/rejected/*")


def running_baseline(steps: DataFrame, keep: float = 0.9, delay: int = 0) -> DataFrame:
    """Run ``start_running_baseline`` over what is available now; returns its table."""
    spark = steps.sparkSession
    root = run_folder(spark)
    start_running_baseline(steps, root, keep, delay).awaitTermination()
    if delay:
        flush_running_baseline(spark, root, keep)
    return baseline_table(spark, root)


class DroppedRows(StreamingQueryListener):
    """Counts, per query and batch, the rows that the engine itself dropped as later than the
    watermark. Use as a context manager around the queries to watch."""

    SCHEMA = "query string, batch bigint, input_rows bigint, dropped bigint"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: dict[tuple[str, int], tuple[int, int]] = {}
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def __enter__(self) -> DroppedRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        with self.changed:
            self.rows[str(p.runId), p.batchId] = (p.numInputRows, dropped)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def wait(self, queries: int, seconds: float = 60.0) -> None:
        """Until as many queries have ended as far as this listener was told: progress comes
        before that, but after the query itself has returned."""
        with self.changed:
            if not self.changed.wait_for(lambda: len(self.ended) >= queries, seconds):
                raise TimeoutError("the end of a watched query was not reported")

    def table(self) -> DataFrame:
        with self.changed:
            rows = [(q, b, n, d) for (q, b), (n, d) in sorted(self.rows.items())]
        return self.spark.createDataFrame(rows, self.SCHEMA)


def run_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", on_progress: Callable[[dict], None] | None = None, root: str | None = None) -> DataFrame:
    """Run a stream over what is available now into a table and read it back.

    ``append`` writes a parquet sink; ``complete`` rewrites the table per batch.
    Table and checkpoint lie in the session's checkpoint folder, or in ``root``: a stream
    that is drained there again goes on where it stopped.
    """
    spark = stream.sparkSession
    root = root or run_folder(spark)
    out, ckpt = f"{root}/table", f"{root}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        def rewrite(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = writer.foreachBatch(rewrite).start()
    query.awaitTermination()
    if on_progress:
        for progress in query.recentProgress:
            on_progress(progress if isinstance(progress, dict) else progress.__dict__)
    return spark.read.schema(stream.schema).parquet(out)
