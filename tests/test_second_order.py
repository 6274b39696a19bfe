"""The quasi-Newton fits: known optima, few jobs, and the support-vector regressor on one feature."""

import numpy as np
from pyspark.sql import functions as F

from twinframe.operators import models as md


def _rows(spark, x, y):
    data = [(i, [float(v) for v in np.atleast_1d(a)], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row_id long, features array<double>, label double").repartition(3).persist()


def test_least_squares_is_met_in_few_jobs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)) * [1, 30, 0.1, 1, 5, 1]
    y = x @ [1, 2, 3, -1, 0.5, 0] + rng.normal(size=300)

    def gradient(w, a, b):
        gap = a @ w - b
        return (gap**2).sum() / 2, a.T @ gap

    w, losses, jobs = md._minimise(_rows(spark, x, y), np.zeros(6), gradient, 60, 0.0)
    exact = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(w - exact).max() < 1e-2 and jobs < 40
    assert all(b <= a for a, b in zip(losses, losses[1:]))


def test_support_vectors_on_one_feature(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, 120)
    y = 1.5 * x + 0.7 + rng.standard_t(2, 120) * 0.3
    rows = _rows(spark, x, y)
    ends = spark.createDataFrame([(0, [0.0], 0.0), (1, [1.0], 0.0)], "row_id long, features array<double>, label double")
    at = {r.row_id: r.prediction for r in md.svr(rows, ends, C=1.0, epsilon=0.1, kernel="linear").collect()}
    value = lambda w, b: w * w / 2 + np.maximum(np.abs(y - w * x - b) - 0.1, 0).sum()
    grid = min(value(w, b) for w in np.linspace(1.2, 1.8, 301) for b in np.linspace(0.4, 1.0, 301))
    assert value(at[1] - at[0], at[0]) <= 1.002 * grid


def test_networks_fit_what_lines_cannot(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, size=(400, 2))
    rows = _rows(spark, x, np.abs(x[:, 0]) - x[:, 1] ** 2)
    mse = md.regression_metrics(md.mlp_regressor(rows, rows, max_iter=60)).first()
    assert mse["r2"] > 0.9
    classes = _rows(spark, x, (x[:, 0] * x[:, 1] > 0).astype(float))
    assert md.classification_metrics(md.mlp_classifier(classes, classes, max_iter=60)).first()["accuracy"] > 0.9
