"""Order-dependent operators against brute force, with one hot group."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sloframe.operators.ordered import (
    RULES, add_positions, decayed_baseline, exact_quantiles, first_rows, rolling_mean, running_totals, spread_counts,
)

N = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Group a holds most rows; values repeat in group b."""
    g = F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise(F.concat(F.lit("c"), F.col("id") % 400))
    v = F.when(g == "b", (F.col("id") % 5).cast("double")).otherwise((F.hash("id") % 100_000) / 7.0)
    return spark.range(N).select("id", g.alias("g"), v.alias("v")).cache()


def by_group(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(tuple(r[c] for c in cols))
    return out


def test_positions_and_totals(skewed):
    blocks = [F.floor(F.col("id") / 5000), F.floor(F.col("id") / 700)]
    got = by_group(add_positions(skewed, ["g"], blocks, [F.col("id")]), "id", "pos")
    for pairs in got.values():
        assert [p for _, p in sorted(pairs)] == list(range(len(pairs)))
    run = by_group(running_totals(skewed, ["g"], blocks, [F.col("id")], {"t": F.col("id")}), "id", "t")
    for pairs in run.values():
        ids = sorted(i for i, _ in pairs)
        assert [t for _, t in sorted(pairs)] == list(np.cumsum(ids))


def test_positions_with_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "g string, i int")
    got = {(r["g"], r["i"]): r["pos"] for r in add_positions(df, ["g"], [F.col("i")], [F.col("i")]).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("x", 3): 0}


def expected_rank(values, p, rule):
    s, n = sorted(values), len(values)
    if rule == "linear":
        return float(np.percentile(s, p * 100))
    if rule == "index_n":
        return s[int(p * n)] if int(p * n) < n else None
    if rule == "index_n_minus_1":
        return s[int(p * (n - 1))]
    if rule == "index_n_or_max_below_20":
        return s[int(p * n)] if n >= 20 else s[-1]
    if rule == "index_n_clamped":
        return s[min(int(p * n), n - 1)]
    return s[max(math.ceil(p * n) - 1, 0)]


@pytest.mark.parametrize("rule", RULES)
def test_exact_quantiles(skewed, rule):
    values = by_group(skewed, "v")
    got = exact_quantiles(skewed, ["g"], F.col("v"), {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}, rule)
    rows = got.collect()
    assert len(rows) == len(values)
    for r in rows:
        vals = [v for (v,) in values[r["g"]]]
        for name, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            want = expected_rank(vals, p, rule)
            assert r[name] == pytest.approx(want, rel=1e-12), (r["g"], name, rule)


def test_exact_quantiles_without_keys_and_without_rows(skewed):
    got = exact_quantiles(skewed, [], F.col("v"), {"p": 0.5}).collect()
    assert got[0]["p"] == pytest.approx(np.percentile([r["v"] for r in skewed.collect()], 50))
    assert exact_quantiles(skewed.where("id < 0"), [], F.col("v"), {"p": 0.5}).collect()[0]["p"] is None
    assert exact_quantiles(skewed.where("id < 0"), ["g"], F.col("v"), {"p": 0.5}).collect() == []


def test_rolling_mean_across_chunks(skewed):
    placed = add_positions(skewed, ["g"], [F.floor(F.col("id") / 1000)], [F.col("id")])
    got = by_group(rolling_mean(placed, ["g"], "pos", F.col("v"), 50, chunk=64), "pos", "v", "rolling")
    for trio in got.values():
        trio.sort()
        vals = [v for _, v, _ in trio]
        for i in range(0, len(vals), 37):
            assert trio[i][2] == pytest.approx(np.mean(vals[max(0, i - 49): i + 1]))
    assert sum(len(t) for t in got.values()) == N


def test_decayed_baseline_across_chunks(skewed):
    placed = add_positions(skewed, ["g"], [F.floor(F.col("id") / 1000)], [F.col("id")])
    got = by_group(decayed_baseline(placed, ["g"], "pos", F.col("v"), 0.9), "pos", "v", "baseline")
    for trio in got.values():
        b = 0.0
        for _, v, base in sorted(trio):
            assert base == pytest.approx(b, rel=1e-9, abs=1e-9)
            b = 0.9 * b + 0.1 * v


def test_first_rows_limits_before_the_shuffle(skewed):
    df = first_rows(skewed, ["g"], [F.col("id").desc()], 3)
    assert all(len(v) == 3 for v in by_group(df, "id").values())
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_spread_counts_in_blocks(spark):
    df = spark.createDataFrame([("a", 0), ("b", 5), ("c", 23)], "k string, n int")
    got = sorted((r["k"], r["draw"]) for r in spread_counts(df, F.col("n"), block=4).collect())
    assert got == [("b", i) for i in range(5)] + [("c", i) for i in range(23)]


@pytest.mark.parametrize("n", [1, 2, 10, 999, 3_000, 200_000])
@pytest.mark.parametrize("rule", RULES)
def test_quantiles_are_exact_for_groups_of_any_size(spark, n, rule):
    """Heavy ties, one huge outlier and infinities."""
    import numpy as np

    r = np.random.default_rng(n)
    values = np.sort(np.where(r.random(n) < 0.4, 5.0, r.normal(0, 1, n)))
    values[-1] = 1e12
    if n > 900:
        values[0], values[-2] = -np.inf, np.inf
        values = np.sort(values)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    probs = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99, "e": 0.999}
    got = exact_quantiles(df, [], F.col("v"), probs, rule).first()
    for name, p in probs.items():
        h = p * (n - 1)
        place = {
            "linear": None, "index_n": int(p * n), "index_n_minus_1": int(h), "index_n_or_max_below_20": int(p * n) if n >= 20 else n - 1,
            "index_n_clamped": min(int(p * n), n - 1), "discrete": max(int(np.ceil(p * n)) - 1, 0),
        }[rule]
        if place is None:
            low, high = values[int(np.floor(h))], values[int(np.ceil(h))]
            expected = low + (h - np.floor(h)) * (high - low) if low != high else low
        else:
            expected = values[place]
        assert got[name] == pytest.approx(expected, rel=1e-12), (name, n)
