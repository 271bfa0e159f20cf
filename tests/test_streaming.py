"""Steps that come late, twice or out of order, and the engine's own count of late rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sloframe.streaming import monitor

STEPS = "run string, step bigint, reward double"


def feed(spark, root, batches, delay):
    for rows in batches:
        spark.createDataFrame(rows, STEPS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        monitor.start_running_baseline(monitor.tail_logs(spark, f"{root}/in", STEPS, "parquet"), root, delay=delay).awaitTermination()


def plain(batches, delay):
    """Steps in the order they are let go, with baselines, and what is rejected."""
    waiting, last, base, out, rejected = {}, {}, Counter(), {}, Counter()

    def let_go(upto):
        for run, step in sorted(waiting, key=lambda k: (k[0] or "", k[1])):
            if step <= upto(run):
                r = waiting.pop((run, step))
                out[run, step] = base[run]
                base[run] = 0.9 * base[run] + 0.1 * r
                last[run] = step

    for rows in batches:
        fresh = Counter()
        for run, step, reward in sorted(rows, key=lambda x: x[2]):
            if step is None or step <= last.get(run, -(1 << 62)):
                rejected[run, step, "late"] += 1
            elif (run, step) in waiting or (run, step) in fresh:
                rejected[run, step, "repeated"] += 1
            else:
                fresh[run, step] = reward
        waiting.update(fresh)
        top = {run: max(s for r, s in waiting if r == run) for run, _ in waiting}
        let_go(lambda run: top[run] - delay)
    let_go(lambda run: 1 << 62)
    return out, rejected


@pytest.mark.parametrize("delay", [0, 7])
def test_baseline_over_batches(spark, delay):
    r = random.Random(delay)
    steps = [(run, s, r.random()) for run, n in (("hot", 60), ("b", 9), (None, 5)) for s in range(n)]
    batches = [[], [], []]
    for run, s, x in steps:
        at = min(2, s // 20 if run == "hot" else s // 4)
        batches[min(2, at + (r.random() < 0.2))].append((run, s, x))
        if r.random() < 0.2:
            batches[min(2, at + r.randrange(2))].append((run, s, r.random()))
    batches[1].append(("b", None, 0.5))
    root = monitor.run_folder(spark)
    feed(spark, root, batches, delay)
    monitor.flush_running_baseline(spark, root)
    want, rejected = plain(batches, delay)
    got = {(x.run, x.step): x.baseline for x in monitor.baseline_table(spark, root).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert Counter({(x.run, x.step, x.reason): x.n for x in monitor.rejected_steps(spark, root).collect()}) == rejected
    assert {k[2] for k in rejected} == {"late", "repeated"}
    # Every row that came is in one of the two tables.
    assert len(got) + rejected.total() == sum(map(len, batches))


def test_a_stream_goes_on_after_a_flush(spark):
    root = monitor.run_folder(spark)
    feed(spark, root, [[("a", 1, 1.0), ("a", 9, 1.0)]], 5)
    monitor.flush_running_baseline(spark, root)
    assert monitor.baseline_table(spark, root).count() == 2
    feed(spark, root, [[("a", 5, 1.0), ("a", 20, 1.0)]], 5)
    monitor.flush_running_baseline(spark, root)
    assert sorted(x.step for x in monitor.baseline_table(spark, root).collect()) == [1, 5, 9, 20]
    assert monitor.rejected_steps(spark, root).count() == 0


def test_dropped_rows_are_counted(spark):
    root = monitor.run_folder(spark)
    rows = lambda *at: spark.createDataFrame([(i, f"2024-01-{t:02d} 00:00:00") for i, t in at], "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    with monitor.DroppedRows(spark) as watched:
        for batch in (rows((1, 1), (2, 20)), rows((3, 2), (4, 3), (5, 21)), rows((6, 4))):
            batch.coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = monitor.event_time(monitor.tail_logs(spark, f"{root}/in", batch.schema, "parquet"), "ts", "1 day")
            seen = monitor.drain(monitor.drop_replays(stream, ["id"]), root=root)
        watched.wait(3)
    assert sorted(x.id for x in seen.collect()) == [1, 2, 5]
    table = watched.table()
    assert table.agg(F.sum("dropped"), F.sum("input_rows")).first()[:] == (3, 6)
    with pytest.raises(TimeoutError):
        watched.wait(4, 0.01)
