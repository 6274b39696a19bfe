"""Utility (I), parameter search and trial tables (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.operators import models as md
from twinframe.operators import search as se
from twinframe.operators.encode import fit_features
from twinframe.operators.rows import two_stage_split
from twinframe.session import cut_lineage

OF = fx.ORDER_FACTS


def encoded(spark, sf, task):
    """(train, val, test) of the parts table, encoders fitted on the training rows."""
    target = "p_retailprice" if task == "regression" else "p_type"
    num = [c for c in fx.PART_NUM if c != target]
    cat = [c for c in fx.PART_CAT if c != target]
    split = two_stage_split(fx.parts(spark, sf), target, task)
    coder = fit_features(split.where("split = 'train'"), num, cat, target, task)
    rows = cut_lineage(coder.spread(split).select("row_id", "split", coder.features().alias("features"), coder.label().alias("label")))
    return tuple(rows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))


SMALL = {
    "svr": {"max_iter": 30},
    "mlpr": {"max_iter": 30},
    "rfr": {"n_estimators": 10, "max_depth": 6},
    "rfc": {"n_estimators": 10, "max_depth": 6},
    "mlpc": {"max_iter": 30},
    "svc": {"max_iter": 10},
}


def _model(name, key, task, **params):
    fit = md.REGRESSORS[key] if task == "regression" else md.CLASSIFIERS[key]

    @query(name)
    def _(spark, sf):
        """Fitted on training and validation rows; the vector machines and the network for numbers at their defaults."""
        train, val, test = encoded(spark, sf, task)
        reduced = {} if key in ("svr", "mlpr", "svc") else SMALL.get(key, {})
        return fit(train.unionByName(val), test, **{**reduced, **params})


_model("I1_ridge", "ridge", "regression", alpha=2.0)
_model("I2_svr", "svr", "regression")
_model("I3_forest_regressor", "rfr", "regression")
_model("I4_mlp_regressor", "mlpr", "regression")
_model("I5_logistic", "logistic", "classification")
_model("I6_svc", "svc", "classification", kernel="rbf")
_model("I7_forest_classifier", "rfc", "classification")
_model("I8_mlp_classifier", "mlpc", "classification")


@query(
    "I9_regression_metrics",
    f"WITH {OF}, p AS (SELECT o_totalprice / 1000 AS y, (o_totalprice + 5 * c_acctbal) / 1000 AS p FROM order_facts) SELECT "
    "round(avg(power(y - p, 2)), 5) AS mse, round(1 - sum(power(y - p, 2)) / sum(power(y - (SELECT avg(y) FROM p), 2)), 6) AS r2 FROM p",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf).select(
        (F.col("o_totalprice") / 1000).alias("label"), ((F.col("o_totalprice") + 5 * F.col("c_acctbal")) / 1000).alias("prediction")
    )
    return md.regression_metrics(df).select(F.round("mse", 5).alias("mse"), F.round("r2", 6).alias("r2"))


GUESS = "CASE WHEN {u} < 0.6 THEN o_orderstatus WHEN {u} < 0.8 THEN 'F' ELSE 'X' END"


@query(
    "I10_classification_metrics",
    f"WITH {OF}, p AS (SELECT o_orderstatus AS y, {GUESS.format(u=fx.sql_rnd('guess', 'row_id'))} AS p FROM order_facts), "
    "k AS (SELECT y AS c FROM p UNION SELECT p FROM p), s AS (SELECT c, (SELECT count(*) FROM p WHERE y = c) AS support, "
    "(SELECT count(*) FROM p WHERE p.p = c) AS said, (SELECT count(*) FROM p WHERE y = c AND p.p = c) AS hit FROM k) "
    "SELECT round(sum(2.0 * hit / (support + said) * support) / sum(support), 6) AS f1, round(sum(hit) / sum(support), 6) AS accuracy FROM s",
)
def _(spark, sf):
    u = fx.rnd("guess", F.col("row_id"))
    guess = F.when(u < 0.6, F.col("o_orderstatus")).when(u < 0.8, "F").otherwise("X")
    df = fx.order_facts(spark, sf).select(F.col("o_orderstatus").alias("label"), guess.alias("prediction"))
    return md.classification_metrics(df).select(F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


def _report(name, task):
    @query(name)
    def _(spark, sf):
        """All four models at their defaults."""
        train, val, test = encoded(spark, sf, task)
        return md.utility_report(train.unionByName(val), test, task, dataset="parts")


_report("I11_regression_report", "regression")
_report("I12_classification_report", "classification")


def parts_meta(task):
    from twinframe.operators.profile import Metadata

    if task == "regression":
        return Metadata(("p_size",), tuple(fx.PART_CAT), "p_retailprice", task, 0, 4, 0.0)
    return Metadata(tuple(fx.PART_NUM), ("p_brand",), "p_type", task, 0, 4, 0.0)


@query("I13_train_real_test_real")
def _(spark, sf):
    from twinframe.plans.jobs import train_real_test_real

    meta = parts_meta("regression")
    split = two_stage_split(fx.parts(spark, sf), meta.target_column, meta.task)
    return train_real_test_real(split, meta, SMALL)


@query("I14_train_synthetic_test_real")
def _(spark, sf):
    from twinframe.operators.copula import fit_copula, sample_copula
    from twinframe.plans.jobs import train_synthetic_test_real

    meta = parts_meta("regression")
    split = two_stage_split(fx.parts(spark, sf), meta.target_column, meta.task)
    models = fit_copula(split.where("split <> 'test'").drop("split"), fx.PART_NUM, fx.PART_CAT, default_distribution="norm")
    synthetic = cut_lineage(sample_copula(models, models.rows[0]["n"]).drop("syn_id"))
    return train_synthetic_test_real(synthetic, split.where("split = 'test'").drop("split"), meta, SMALL)


def sql_result(source: str) -> str:
    return fx.sql_union(
        [
            f"SELECT o_orderstatus AS model, '{m}' AS metric, round({e}, 3) AS value FROM {source} GROUP BY o_orderstatus"
            for m, e in (("mean_price", "avg(o_totalprice)"), ("mean_balance", "avg(c_acctbal)"))
        ]
    )


@query(
    "I15_utility_gap",
    f"WITH {OF}, {fx.sql_pair('order_facts')}, x AS ({sql_result('real')}), y AS ({sql_result('syn')}) SELECT model, metric, "
    "x.value AS real, y.value AS synthetic, round(y.value - x.value, 3) AS gap FROM x JOIN y USING (model, metric)",
)
def _(spark, sf):
    def result(df):
        wide = df.groupBy("o_orderstatus").agg(
            F.round(F.avg("o_totalprice"), 3).alias("mean_price"), F.round(F.avg("c_acctbal"), 3).alias("mean_balance")
        )
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mean_price", "mean_balance")])
        return wide.select(F.col("o_orderstatus").alias("model"), F.explode(cells).alias("e")).select("model", "e.*")

    real, syn = fx.pair(fx.order_facts(spark, sf))
    return md.utility_gap(result(real), result(syn)).withColumn("gap", F.round("gap", 3))


# ---- J: search and trials

NARROW = {
    "rfr": {"n_estimators": ("int", 5, 10), "max_depth": ("int", 4, 6), "min_samples_split": ("int", 2, 8), "min_samples_leaf": ("int", 1, 8)},
}
NARROW["rfc"] = NARROW["rfr"]


def _search(name, keys, task, trials=2, whole=False):
    @query(name)
    def _(spark, sf):
        train, val, _test = encoded(spark, sf, task)
        out = None
        for key in keys:
            fixed = {"max_iter": SMALL[key]["max_iter"]} if key in ("svr", "svc", "mlpr", "mlpc") and not whole else {}
            runs = se.tune(key, train, val, trials, space=None if whole else NARROW.get(key), fixed=fixed)
            part = runs.select(F.lit(key).alias("model"), "number", "value")
            out = part if out is None else out.unionByName(part)
        return out


_search("J1_tune_ridge", ["ridge"], "regression", 4)
_search("J2_tune_logistic", ["logistic"], "classification")
_search("J3_tune_svr", ["svr"], "regression", 50, whole=True)
_search("J4_tune_svc", ["svc"], "classification")
_search("J5_tune_forest_regressor", ["rfr"], "regression")
_search("J5_tune_forest_classifier", ["rfc"], "classification")
_search("J6_tune_mlp_regressor", ["mlpr"], "regression")
_search("J6_tune_mlp_classifier", ["mlpc"], "classification")


@query("J7_tune_on_real")
def _(spark, sf):
    from twinframe.plans.jobs import tune_on_real

    meta = parts_meta("regression")
    split = two_stage_split(fx.parts(spark, sf), meta.target_column, meta.task)
    return tune_on_real(split, meta, ["ridge"], n_trials=3)


@query("J8_tune_on_synthetic")
def _(spark, sf):
    from twinframe.operators.copula import fit_copula, sample_copula
    from twinframe.plans.jobs import tune_on_synthetic

    df = fx.parts(spark, sf)
    models = fit_copula(df, fx.PART_NUM, fx.PART_CAT, default_distribution="norm")
    synthetic = cut_lineage(sample_copula(models, models.rows[0]["n"]).drop("syn_id"))
    return tune_on_synthetic(synthetic, parts_meta("regression"), ["ridge"], n_trials=3)


def trials(spark, sf):
    """The events table read as a log of trials."""
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1e6).cast("long"))
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("number"),
        F.col("event_type").alias("worker"),
        "value",
        F.col("ts").cast("timestamp").alias("datetime_start"),
        end.alias("datetime_complete"),
    )


def sql_best(order: str, label: str) -> str:
    return (
        f"SELECT '{label}' AS direction, worker, number, value FROM (SELECT event_type AS worker, event_id AS number, value, row_number() "
        f"OVER (PARTITION BY event_type ORDER BY value {order}, event_id) AS k FROM events) WHERE k = 1"
    )


@query("J9_best_trial", f"{sql_best('', 'minimise')} UNION ALL {sql_best('DESC', 'maximise')}")
def _(spark, sf):
    df = trials(spark, sf)
    pick = lambda d: se.best_trial(df, d, ["worker"]).withColumn("direction", F.lit(d))
    return pick("minimise").unionByName(pick("maximise"))


@query(
    "J11_merge_trials",
    "SELECT event_type AS worker, event_id AS number, value, row_number() OVER (ORDER BY event_type, event_id) - 1 AS study_number FROM events",
)
def _(spark, sf):
    return se.merge_trials(trials(spark, sf).select("worker", "number", "value"))


@query(
    "J12_timeline",
    "WITH t AS (SELECT event_id AS number, epoch_us(ts) / 1e6 AS s, (epoch_us(ts) + CAST(round(value * 1e6) AS BIGINT)) / 1e6 "
    "AS e FROM events), b AS (SELECT min(s) AS t0, max(e) - min(s) AS span FROM t), u AS (SELECT t0, CASE WHEN span >= 3600 "
    "THEN 3600.0 WHEN span >= 60 THEN 60.0 ELSE 1.0 END AS size, CASE WHEN span >= 3600 THEN 'h' WHEN span >= 60 THEN 'm' "
    "ELSE 's' END AS unit FROM b) SELECT number, round((s - t0) / size, 5) AS start, round((e - s) / size, 5) AS duration, "
    "unit FROM t, u",
)
def _(spark, sf):
    return se.timeline(trials(spark, sf)).withColumns({c: F.round(c, 5) for c in ("start", "duration")})


@query(
    "J13_loss_per_epoch",
    'SELECT CAST(day(ts) AS INTEGER) AS "Epoch", round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, '
    "round(stddev_samp(value), 6) AS std FROM events GROUP BY 1",
)
def _(spark, sf):
    log = fx.table(spark, sf, "events").select(F.dayofmonth("ts").alias("Epoch"), F.col("value").alias("Loss"))
    return se.loss_per_epoch(log).withColumns({c: F.round(c, 6) for c in ("mean", "std")})
