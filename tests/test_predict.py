"""Logistic models of all folds at once against plain fits."""

import numpy as np
import pytest

from sloframe.operators import predict

NAMES = ("a", "b")


def plain_fit(x, y):
    """Newton steps on the penalised mean log loss; None without rows, the class if there is one."""
    if not len(y):
        return None
    if len(set(y)) == 1:
        return float(y[0])
    x1, lean = np.column_stack([x, np.ones(len(y))]), np.array([predict.PENALTY, predict.PENALTY, 0.0])
    w = np.zeros(3)
    for _ in range(predict.STEPS):
        p = 1 / (1 + np.exp(-x1 @ w))
        step = np.linalg.solve((x1.T * (p * (1 - p))) @ x1 / len(y) + np.diag(lean), x1.T @ (p - y) / len(y) + lean * w)
        w = w - step * min(1, predict.LONGEST_STEP / np.linalg.norm(step))
    return w


def plain_probability(model, x):
    if model is None or isinstance(model, float):
        return model
    return 1 / (1 + np.exp(-(model[:2] @ x + model[2])))


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(4)
    rows = []
    for i in range(90):
        a, b = np.round(r.normal(size=2), 1)
        rows.append((i, "xyz"[i % 3] if i % 10 else None, float(a), float(b), float(a + 0.5 * b + r.normal() > 0)))
    rows += [(100 + i, "x", 0.5, -0.5, float(i % 2)) for i in range(8)]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame(points, "id int, g string, a double, b double, label double").repartition(5)


def against(df, points, train):
    got = {r.id: r for r in df.collect()}
    assert len(got) == len(points)
    for p in points:
        rest = [q for q in points if train(q, p)]
        model = plain_fit(np.array([q[2:4] for q in rest]), np.array([q[4] for q in rest]))
        want = plain_probability(model, np.array(p[2:4]))
        assert got[p[0]].probability == pytest.approx(want, abs=1e-9) and got[p[0]].prediction == float(want >= 0.5)


def test_in_sample(table, points):
    against(predict.in_sample(table, NAMES), points, lambda q, p: True)


def test_leave_group_out(table, points):
    against(predict.leave_group_out(table, "g", NAMES), points, lambda q, p: q[1] != p[1])


def test_leave_one_out_is_exact(table, points, monkeypatch):
    against(predict.leave_one_out(table, NAMES), points, lambda q, p: q[0] != p[0])
    monkeypatch.setattr(predict, "FOLDS_AT_ONCE", 30)  # several blocks of folds
    against(predict.leave_one_out(table, NAMES), points, lambda q, p: q[0] != p[0])


def test_folds_by_hash(table, points):
    out = predict.leave_fold_out(table, ["id"], 4, NAMES)
    assert out.where("prediction is null").count() == 0 and out.columns[: len(table.columns)] == table.columns


def test_passes_do_not_grow_with_folds(spark, table, monkeypatch):
    calls = []
    sums = predict._sums
    monkeypatch.setattr(predict, "_sums", lambda *a: calls.append(1) or sums(*a))
    predict.leave_one_out(table, NAMES)
    predict.leave_group_out(table, "g", NAMES)
    assert len(calls) == 2 * predict.STEPS


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, g string, a double, b double, label double")
    one_group = predict.leave_group_out(make([(1, "x", 1.0, 2.0, 1.0), (2, "x", 2.0, 1.0, 0.0)]), "g", NAMES).collect()
    assert [(r.probability, r.prediction) for r in one_group] == [(None, None)] * 2
    one_class = predict.leave_group_out(make([(1, "x", 1.0, 2.0, 1.0), (2, "y", 2.0, 1.0, 0.0), (3, "y", 5.0, 1.0, 0.0)]), "g", NAMES).collect()
    assert {r.id: r.prediction for r in one_class} == {1: 0.0, 2: 1.0, 3: 1.0}
    missing = predict.in_sample(make([(1, "x", None, 2.0, 1.0), (2, "y", 2.0, 1.0, 0.0), (3, "y", -2.0, 1.0, 1.0), (4, "y", 2.0, 1.0, None)]), NAMES).collect()
    assert {r.id: r.prediction for r in missing} == {1: None, 2: 0.0, 3: 1.0, 4: 0.0}
    split = predict.in_sample(make([(i, "x", float(i), 0.0, float(i > 3)) for i in range(8)]), NAMES).collect()
    assert all(r.prediction == r.label for r in split)  # separated classes, finite weights
    for f in (predict.in_sample, predict.leave_one_out):
        assert f(make([]), NAMES).collect() == []
    assert predict.leave_group_out(make([]), "g", NAMES).collect() == []
