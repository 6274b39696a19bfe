"""Queries that run the whole job: no reduced steps, trees, trials, shadows or draws are passed."""

from twinframe import catalog
from twinframe.catalog import utility as ut
from twinframe.operators import models as md
from twinframe.operators import search as se
from twinframe.plans import jobs

catalog.load()


def _parts(spark, monkeypatch):
    rows = spark.range(0, 30, 1, 1).selectExpr("id AS row_id", "array(id / 30D, (id % 7) / 7D) AS features", "double(id % 2) AS label")
    monkeypatch.setattr(ut, "encoded", lambda *_: (rows, rows, rows))
    return rows


def _seen(monkeypatch, module, name, out=None):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *args, **named: calls.append((args, named)) or (real(*args, **named) if out is None else out))
    return calls


def test_search_of_vector_regression_takes_all_trials_and_steps(spark, sf, monkeypatch):
    _parts(spark, monkeypatch)
    fits = []
    monkeypatch.setitem(se.REGRESSORS, "svr", lambda train, test, **params: fits.append(params) or test.selectExpr("row_id", "label", "label AS prediction"))
    assert catalog.QUERIES["J3_tune_svr"](spark, sf).count() == 50
    assert len(fits) == 50 and all(set(params) == {"C", "epsilon"} for params in fits)


def test_passes_of_a_fit_read_blocks_of_rows(spark):
    rows = spark.range(0, 60, 1, 3).selectExpr("array(id / 60D, 1D) AS features", "double(id) AS label")
    blocks = md._as_blocks(rows).collect()
    assert [len(y) // 8 for _, y in blocks] == [20, 20, 20] and all(len(x) == 2 * len(y) for x, y in blocks)
    assert md._as_blocks(rows.where("label < 0")).isEmpty()


def test_sums_added_up_in_the_cluster_are_those_of_the_driver(spark, monkeypatch):
    rows = spark.range(0, 60, 1, 3).selectExpr("id AS row_id", "array(id / 60D, 1D) AS features", "double(id) AS label")
    one = md.svr(rows, rows, kernel="linear", max_iter=5).orderBy("row_id").collect()
    monkeypatch.setattr(md, "SUM_BYTES", 0)
    other = md.svr(rows, rows, kernel="linear", max_iter=5).orderBy("row_id").collect()
    assert max(abs(a["prediction"] - b["prediction"]) for a, b in zip(one, other)) < 1e-6


def test_vector_classes_take_all_steps(spark, sf, monkeypatch):
    _parts(spark, monkeypatch)
    fits = _seen(monkeypatch, md, "LinearSVC")
    assert catalog.QUERIES["I6_svc"](spark, sf).count() == 30
    assert [named["maxIter"] for _, named in fits] == [50]


def test_report_of_numbers_takes_the_defaults_of_all_models(spark, sf, monkeypatch):
    _parts(spark, monkeypatch)
    fits = []
    for models in (md.REGRESSORS, md.CLASSIFIERS):
        for key in models:
            fit = lambda train, test, key=key, **params: fits.append((key, params)) or test.selectExpr("row_id", "label", "label AS prediction")
            monkeypatch.setitem(models, key, fit)
    assert catalog.QUERIES["I11_regression_report"](spark, sf).count() == 8
    assert len(fits) == 4 and not any(params for _, params in fits)


def test_report_of_classes_takes_the_defaults_of_all_models(spark, sf, monkeypatch):
    _parts(spark, monkeypatch)
    fits = []
    for models in (md.REGRESSORS, md.CLASSIFIERS):
        for key in models:
            fit = lambda train, test, key=key, **params: fits.append((key, params)) or test.selectExpr("row_id", "label", "label AS prediction")
            monkeypatch.setitem(models, key, fit)
    assert catalog.QUERIES["I12_classification_report"](spark, sf).count() == 8
    assert len(fits) == 4 and not any(params for _, params in fits)


def test_report_without_setup_takes_all_shadows_and_draws(spark, sf, monkeypatch):
    calls = _seen(monkeypatch, jobs, "full_report", spark.range(1))
    catalog.QUERIES["M4_report_without_setup"](spark, sf)
    ((args, named),) = calls
    assert len(args) == 2 and set(named) == {"meta", "skip_setup"}
