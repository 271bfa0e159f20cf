"""Ranks and resampled intervals at row grain against plain versions, with one hot group."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sloframe.operators import draws, ranking, resample


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(9)
    out = []
    for i in range(6000):
        g = "hot" if i % 10 < 7 else ("few" if i % 10 < 9 else None)
        a = None if i % 50 == 0 else float(r.integers(0, 40)) if g != "hot" else float(np.round(r.lognormal(3, 1), 2))
        out.append((i, g, a, float(r.integers(0, 9)) + (a or 0) / 50))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "i long, g string, a double, b double").repartition(7)


def plain_ranks(values, descending=True):
    order = sorted({v for v in values if v is not None}, reverse=descending) + ([None] if None in values else [])
    rank, at = {}, 0
    for v in order:
        n = sum(1 for x in values if x == v)
        rank[v] = at + (n + 1) / 2
        at += n
    return rank


@pytest.mark.parametrize("descending", [True, False])
def test_average_ranks(table, rows, descending):
    got = {r.i: r.r for r in resample.add_average_ranks(table, ["g"], {"r": "a"}, descending).collect()}
    assert len(got) == len(rows)
    for g in ("hot", "few", None):
        want = plain_ranks([r[2] for r in rows if r[1] == g], descending)
        assert all(got[r[0]] == want[r[2]] for r in rows if r[1] == g)


def test_average_ranks_equal_the_window_form(table):
    both = resample.add_average_ranks(table.where("a is not null"), ["g"], {"r": "a"}).withColumn("w", ranking.average_rank("a", ["g"]))
    assert both.where("r <> w").count() == 0


def test_no_window_sees_a_whole_group(table):
    plan = resample.add_average_ranks(table, ["g"], {"r": "a"})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    # Block sums of a group, and the rows of one (group, bin) cell.
    assert windows and all("__cell" in w or "__s___upto" in w for w in windows)


def test_spearman_rows(table, rows):
    got = {r.g: r for r in resample.spearman_rows(table, ["g"], "a", "b").collect()}
    for g in ("hot", "few", None):
        mine = [r for r in rows if r[1] == g and r[2] is not None]
        ra, rb = plain_ranks([r[2] for r in mine]), plain_ranks([r[3] for r in mine])
        want = np.corrcoef([ra[r[2]] for r in mine], [rb[r[3]] for r in mine])[0, 1]
        assert got[g].n == len(mine) and got[g].rho == pytest.approx(want)


def test_bootstrap_equals_the_model_grain_form(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(t, i, float(r.integers(0, 6)), float(r.integers(0, 6))) for t in ("x", "y") for i in range(14)], "t string, i long, a double, b double")
    old = {x.t: (x.n, x.rho, x.ci_lower, x.ci_upper, x.p_value) for x in ranking.bootstrap_spearman(df, ["t"], "i", "a", "b", resamples=60).collect()}
    for blocks in (None, [F.floor(F.col("i") / 4)]):
        new = resample.bootstrap_spearman_rows(df, ["t"], "i", "a", "b", resamples=60, blocks=blocks).collect()
        assert {x.t: (x.n, x.rho, x.ci_lower, x.ci_upper, x.p_value) for x in new} == {t: pytest.approx(v) for t, v in old.items()}


def weight(key, r):
    digest = hashlib.md5(f"17|{key}|{r // 8}".encode()).hexdigest()
    bits = int(digest[4 * (r % 8): 4 * (r % 8) + 4], 16)
    return sum(bits >= c for c in ranking.POISSON_CUTS)


def test_bootstrap_quantiles(table, rows):
    probs = {"low": 0.02, "mid": 0.5, "high": 0.99}
    got = {(r.g, r.quantile): r for r in resample.bootstrap_quantiles(table, ["g"], F.col("i"), F.col("a"), probs, resamples=20).collect()}
    for g in ("hot", "few", None):
        mine = sorted((r[2], r[0]) for r in rows if r[1] == g and r[2] is not None)
        values = np.array([v for v, _ in mine])
        for name, p in probs.items():
            found = []
            for s in range(20):
                run = np.cumsum([weight(i, s) for _, i in mine])
                found.append(values[np.searchsorted(run, max(1, math.ceil(p * run[-1])))])
            found.sort()
            x = got[g, name]
            assert (x.n, x.value) == (len(mine), values[math.ceil(p * len(mine)) - 1])
            assert (x.ci_lower, x.ci_upper) == (found[int(0.025 * 19)], found[int(0.975 * 19)])


def test_small_and_empty_groups(spark):
    one = spark.createDataFrame([("x", 1, 5.0), ("y", 2, None)], "g string, i long, v double")
    got = resample.bootstrap_quantiles(one, ["g"], F.col("i"), F.col("v"), {"p50": 0.5}, resamples=16).collect()
    assert [(r.g, r.n, r.value, r.ci_lower, r.ci_upper) for r in got] == [("x", 1, 5.0, 5.0, 5.0)]
    assert resample.bootstrap_quantiles(one.where("false"), ["g"], F.col("i"), F.col("v"), {"p50": 0.5}).collect() == []
    assert resample.spearman_rows(one.withColumn("w", F.col("v")).where("false"), ["g"], "v", "w").collect() == []


def test_resamples_are_counted_side_by_side(spark, monkeypatch):
    data = [(i, "g" if i % 3 else None, float(i % 50), float((i * 7) % 31)) for i in range(600)]
    df = spark.createDataFrame(data, "i long, g string, a double, b double")
    sizes, ranks = [], resample._tied_ranks
    monkeypatch.setattr(resample, "_tied_ranks", lambda counts, *rest: sizes.append(counts.count()) or ranks(counts, *rest))
    got = {r.g: r for r in resample.bootstrap_spearman_rows(df, ["g"], "i", "a", "b", resamples=19).collect()}
    # Two groups of at most 50 and 31 values, 19 resamples in three rows of a value; then the ranks themselves.
    assert max(sizes) <= 2 * 50 * 3
    assert set(got) == {"g", None}
    lo, hi = int(0.025 * 19), int(0.975 * 19)
    for g, n in (("g", 400), (None, 200)):
        rows = [(a, b) for _, key, a, b in data if key == g]
        rhos = []
        for r in range(19):
            at = [int(hashlib.md5(f"42|{r}|{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)]
            xs, ys = [rows[i][0] for i in at], [rows[i][1] for i in at]
            ra, rb = plain_ranks(xs), plain_ranks(ys)
            rhos.append(np.corrcoef([ra[x] for x in xs], [rb[y] for y in ys])[0, 1])
        rhos.sort()
        assert got[g].n == n and got[g].ci_lower == pytest.approx(rhos[lo]) and got[g].ci_upper == pytest.approx(rhos[hi])


def test_groups_in_tasks_equal_groups_in_shuffles(spark):
    r = np.random.default_rng(5)
    data = [(i, ("big" if i % 5 else "some") if i < 400 else None if i < 409 else f"tiny {i}", float(r.integers(0, 30)) if i % 17 else math.nan, float(r.integers(0, 200))) for i in range(413)]
    df = spark.createDataFrame(data, "i long, g string, a double, b double").repartition(5)
    got = []
    for whole in (100, 1, 1 << 22):  # one group by shuffles, all but the tiny ones, none
        rows = resample.bootstrap_spearman_rows(df, ["g"], "i", "a", "b", resamples=30, whole=whole, blocks=[F.floor(F.col("i") / 64)]).collect()
        got.append({x.g: (x.n, x.rho, x.ci_lower, x.ci_upper) for x in rows})
    assert len(got[0]) == 7 and got[0]["big"][0] == 320
    assert got[1] == got[2] == {g: pytest.approx(v) for g, v in got[0].items()}


def test_digests_equal_the_library():
    digests = draws.Digests(42)
    for resamples, n in ((range(7, 10), 1234), (range(10, 12), 70_000), (range(9_999, 10_000), 11)):
        got = digests.of(resamples, n)
        for k, r in enumerate(resamples):
            some = {*range(min(n, 120)), 999 % n, 1000 % n, n // 2, n - 1}
            assert all(got[k, j] == int(hashlib.md5(f"42|{r}|{j}".encode()).hexdigest()[:8], 16) for j in some)


def test_requests_are_drawn_ten_thousand_times(spark, tmp_path):
    from __spark_entry__ import queries

    n, r = 12, np.random.default_rng(8)
    data = [(i, "view", float(r.integers(0, 9)), f'{{"k": {r.integers(0, 6)}}}') for i in range(n)]
    spark.createDataFrame(data, "event_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    a, b = np.array([x[2] for x in data]), np.array([int(x[3][6:-1]) for x in data])
    rhos = []
    for s in range(10_000):
        at = [int(hashlib.md5(f"42|{s}|{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)]
        ra, rb = ((x[at][:, None] < x[at]).sum(1) + (x[at][:, None] == x[at]).sum(1) / 2 for x in (a, b))
        rhos.append(np.corrcoef(ra, rb)[0, 1] if np.ptp(ra) and np.ptp(rb) else 0)
    rhos.sort()
    (got,) = queries()["bootstrap_spearman_requests"](spark, str(tmp_path)).collect()
    assert (got.task, got.n) == ("view", n)
    assert (got.ci_lower, got.ci_upper) == (pytest.approx(rhos[250], abs=2e-6), pytest.approx(rhos[9750], abs=2e-6))
