"""What must hold of results that SQL cannot compute: counts, ranges, label sets, closed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinframe.catalog import fixtures as fx
from twinframe.catalog import query
from twinframe.catalog.rows import sql_split
from twinframe.catalog.utility import SMALL, encoded, parts_meta
from twinframe.operators import copula as cp
from twinframe.operators import dependence as dp
from twinframe.operators import models as md
from twinframe.operators import privacy as pv
from twinframe.operators import search as se
from twinframe.operators.encode import fit_joint
from twinframe.operators.neighbours import nearest_distances
from twinframe.operators.rows import two_stage_split
from twinframe.session import scratch_path

CUSTOMERS = f"WITH {fx.CUSTOMERS}"
TEST_ROWS = f"WITH {fx.PARTS}, {sql_split('parts')} SELECT count(*) AS n_rows, true AS holds FROM split_rows WHERE split = 'test'"


def holds(condition) -> list:
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bool_and(condition), F.lit(False)).alias("holds")]


# ---- constant columns

CONSTANT_CELLS = fx.sql_union(
    [
        f"SELECT '{a}' AS a, '{b}' AS b, "
        + ("CAST(NULL AS DOUBLE)" if "fixed" in (a, b) else "CAST(1 AS DOUBLE)" if a == b else "round(corr(o_totalprice, c_acctbal), 5)")
        + " AS corr FROM order_facts"
        + (" GROUP BY ALL" if "fixed" in (a, b) or a == b else "")
        for a in (*fx.ORDER_NUM, "fixed")
        for b in (*fx.ORDER_NUM, "fixed")
    ]
)


def with_fixed(df):
    return df.withColumn("fixed", F.lit(5.0))


@query("H4_constant_column", f"WITH {fx.ORDER_FACTS} SELECT DISTINCT a, b, corr FROM ({CONSTANT_CELLS})")
def _(spark, sf):
    """A column that does not vary correlates with nothing: its cells are null."""
    cells = dp.correlation_long(with_fixed(fx.order_facts(spark, sf)), [*fx.ORDER_NUM, "fixed"])
    return cells.withColumn("corr", F.round("corr", 5))


@query("G8_constant_column", f"WITH {fx.ORDER_FACTS} SELECT CAST(0 AS DOUBLE) AS avg_change FROM order_facts LIMIT 1")
def _(spark, sf):
    df = with_fixed(fx.order_facts(spark, sf))
    change = dp.mean_correlation_change(df, df, [*fx.ORDER_NUM, "fixed"])
    return change.select(F.round("avg_change", 9).alias("avg_change"))


@query("I9_constant_label", "SELECT CAST(4 AS DOUBLE) AS mse, CAST(0 AS DOUBLE) AS r2 FROM part LIMIT 1")
def _(spark, sf):
    rows = fx.parts(spark, sf).select(F.lit(1.0).alias("label"), F.lit(3.0).alias("prediction"))
    return md.regression_metrics(rows)


@query("K2_constant_column", f"{CUSTOMERS} SELECT count(*) AS n_rows, true AS holds FROM customers")
def _(spark, sf):
    """A constant column is sampled as its constant under every marginal."""
    df = with_fixed(fx.customers(spark, sf)).select("row_id", "c_acctbal", "fixed")
    n = df.count()
    out = None
    for family in cp.FAMILIES:
        models = cp.fit_copula(df, ["c_acctbal", "fixed"], [], {"fixed": family}, default_distribution="norm")
        part = cp.sample_copula(models, n, seed=4).select("row_id", (F.col("fixed") == 5.0).alias("same"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("row_id").agg(F.bool_and("same").alias("same")).agg(*holds(F.col("same")))


# ---- types


@query("L5_retyped_categories", f"{CUSTOMERS} SELECT row_id, CAST(0 AS DOUBLE) AS distance FROM customers")
def _(spark, sf):
    """A twin that stores an integer category as double is still the same table."""
    real = fx.customers(spark, sf)
    twin = real.withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    out = nearest_distances(real, twin, fit_joint(real, ["c_nationkey", "c_mktsegment"]))
    return out.withColumn("distance", F.round("distance", 9))


@query("E13_retyped_categories", f"{CUSTOMERS} SELECT count(*) AS n_rows, true AS holds FROM customers")
def _(spark, sf):
    real = fx.customers(spark, sf).select("row_id", "c_nationkey")
    joint = fit_joint(real, ["c_nationkey"])
    twin = joint.typed(real.withColumn("c_nationkey", F.col("c_nationkey").cast("double")))
    ones = F.aggregate(joint.dense(), F.lit(0.0), lambda s, v: s + v)
    return twin.select((ones == 1.0).alias("one")).agg(*holds(F.col("one")))


@query("K2_typed_categories", f"{CUSTOMERS} SELECT count(*) AS n_rows, true AS holds, 'bigint' AS kind FROM customers")
def _(spark, sf):
    """A sampled integer category is an integer that the table has."""
    df = fx.customers(spark, sf).select("row_id", "c_acctbal", "c_nationkey")
    models = cp.fit_copula(df, ["c_acctbal"], ["c_nationkey"], default_distribution="norm")
    sample = cp.sample_copula(models, df.count(), seed=5)
    known = sample.join(df.select("c_nationkey").distinct().withColumn("known", F.lit(True)), "c_nationkey", "left")
    return known.agg(*holds(F.col("known").isNotNull())).withColumn("kind", F.lit(dict(sample.dtypes)["c_nationkey"]))


# ---- tables without a key


@query(
    "A1_keyless_csv",
    "SELECT count(*) AS n_rows, count(*) AS n_ids, true AS same_ids FROM supplier",
)
def _(spark, sf):
    """Ids of a table without a key are unique and do not change with the files it is kept in."""
    from twinframe.sources.tables import read_table, with_row_id, write_table

    rows = fx.table(spark, sf, "supplier")
    once, twice = scratch_path(spark, "keyless") + ".csv", scratch_path(spark, "keyless") + ".csv"
    write_table(rows.coalesce(1), once, "csv")
    write_table(rows.repartition(7), twice, "csv")
    a, b = (with_row_id(read_table(spark, p, schema=rows.schema)) for p in (once, twice))
    ids = a.select("row_id").withColumn("a", F.lit(1)).join(b.select("row_id").withColumn("b", F.lit(1)), "row_id", "full")
    return ids.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("row_id").alias("n_ids"),
        F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same_ids"),
    )


# ---- models


@query(
    "I1_ridge_closed_form",
    f"WITH {fx.ORDER_FACTS}, d AS (SELECT row_id, c_acctbal / 1000 AS x, o_totalprice / 1000 AS y FROM order_facts), m AS (SELECT "
    "avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM d) "
    "SELECT row_id, round(my + sxy / (sxx + 2000.0) * (x - mx), 2) AS prediction FROM d, m",
)
def _(spark, sf):
    rows = fx.order_facts(spark, sf).select(
        "row_id", F.array(F.col("c_acctbal") / 1000).alias("features"), (F.col("o_totalprice") / 1000).alias("label")
    )
    return md.ridge(rows, rows, alpha=2000.0).select("row_id", F.round("prediction", 2).alias("prediction"))


def _regressor(name, key):
    @query(name, TEST_ROWS)
    def _(spark, sf):
        """Finite predictions that are no worse than twice the variance of the labels."""
        train, _val, test = encoded(spark, sf, "regression")
        out = md.REGRESSORS[key](train, test, **SMALL.get(key, {}))
        spread = F.var_pop("label") * 2 + F.lit(1e-9)
        return out.agg(
            F.count("prediction").alias("n_rows"),
            ((F.avg((F.col("label") - F.col("prediction")) ** 2) <= spread) & F.bool_and(~F.isnan("prediction"))).alias("holds"),
        )


def _classifier(name, key, **params):
    @query(name, TEST_ROWS)
    def _(spark, sf):
        """Every predicted class is one of the training labels."""
        train, _val, test = encoded(spark, sf, "classification")
        out = md.CLASSIFIERS[key](train, test, **{**SMALL.get(key, {}), **params})
        known = train.select(F.col("label").cast("double").alias("prediction")).distinct().withColumn("known", F.lit(True))
        return out.join(known, "prediction", "left").agg(*holds(F.col("known").isNotNull()))


_regressor("I2_svr_facts", "svr")
_regressor("I3_forest_facts", "rfr")
_regressor("I4_mlp_facts", "mlpr")
_classifier("I5_logistic_facts", "logistic")
_classifier("I6_svc_facts", "svc", kernel="rbf")
_classifier("I7_forest_facts", "rfc")
_classifier("I8_mlp_facts", "mlpc")


def _numbers_sum() -> Column:
    """A target that the features decide: twice the first one, less the second, plus the last."""
    return F.get("features", F.lit(0)) * 2 - F.get("features", F.lit(1)) + F.element_at("features", -1)


def _learns_number(name, key):
    @query(name, TEST_ROWS)
    def _(spark, sf):
        """A target made from the table's features is told better than by any constant: a tenth off the variance at least."""
        train, _val, test = (rows.withColumn("label", _numbers_sum()) for rows in encoded(spark, sf, "regression"))
        out = md.REGRESSORS[key](train, test, **SMALL.get(key, {}))
        error = F.avg((F.col("label") - F.col("prediction")) ** 2)
        return out.agg(F.count("prediction").alias("n_rows"), (error < 0.9 * F.var_pop("label")).alias("holds"))


def _learns_class(name, key, **params):
    @query(name, TEST_ROWS)
    def _(spark, sf):
        """Classes made from the table's features are told more often than the most frequent one occurs."""
        sides = (rows.withColumn("label", (F.get("features", F.lit(0)) > 0.0).cast("double")) for rows in encoded(spark, sf, "classification"))
        train, _val, test = sides
        out = md.CLASSIFIERS[key](train, test, **{**SMALL.get(key, {}), **params})
        right, ones = F.avg((F.col("label") == F.col("prediction")).cast("double")), F.avg("label")
        return out.agg(F.count("prediction").alias("n_rows"), (right > F.greatest(ones, 1 - ones) + 0.05).alias("holds"))


_learns_number("I1_ridge_learns", "ridge")
_learns_number("I2_svr_learns", "svr")
_learns_number("I3_forest_learns", "rfr")
_learns_number("I4_mlp_learns", "mlpr")
_learns_class("I5_logistic_learns", "logistic")
_learns_class("I6_svc_learns", "svc", kernel="rbf")
_learns_class("I6_sigmoid_learns", "svc", kernel="sigmoid")
_learns_class("I7_forest_learns", "rfc")
_learns_class("I8_mlp_learns", "mlpc")


@query(
    "I8_penalty",
    f"WITH {fx.PARTS}, {sql_split('parts')} SELECT count(*) AS n_rows, true AS holds FROM split_rows WHERE split = 'test'",
)
def _(spark, sf):
    """A penalty beyond all measure leaves one class for every row."""
    train, _val, test = encoded(spark, sf, "classification")
    out = md.mlp_classifier(train, test, alpha=1e4, max_iter=60)
    return out.agg(F.count("prediction").alias("n_rows"), (F.count_distinct("prediction") == 1).alias("holds"))


# ---- search


@query(
    "J9_best_params",
    "SELECT event_type AS worker, min_by(event_id, struct_pack(a := value, b := event_id)) AS number, "
    "min_by('slot' || (event_id % 7), struct_pack(a := value, b := event_id)) AS slot FROM events GROUP BY event_type",
)
def _(spark, sf):
    """The best trial brings its parameters along."""
    trials = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("number"),
        F.col("event_type").alias("worker"),
        "value",
        F.create_map(F.lit("slot"), F.concat(F.lit("slot"), (F.col("event_id") % 7).cast("string"))).alias("params"),
    )
    best = se.best_trial(trials, "minimise", ["worker"])
    return best.select("worker", "number", F.col("params")["slot"].alias("slot"))


@query(
    "J1_trial_facts",
    "SELECT range AS number, true AS in_range FROM range(6)",
)
def _(spark, sf):
    """Trials are numbered from 0, draw within their ranges and record what a fixed value put in place."""
    train, val, _test = encoded(spark, sf, "regression")
    trials = se.tune("ridge", train, val, 6, fixed={"fit_intercept": True})
    alpha = F.col("params")["alpha"].cast("double")
    return trials.select("number", (alpha.between(0.0, 10.0) & (F.col("params")["fit_intercept"] == "True") & (F.col("value") >= 0)).alias("in_range"))


# ---- copula and privacy


@query(
    "K1_mixed_facts",
    "SELECT a.c AS a, b.c AS b, a.c = b.c AS is_one, true AS in_range FROM "
    + " , ".join(f"(SELECT unnest(['" + "','".join([*fx.ORDER_NUM, *fx.ORDER_CAT]) + f"']) AS c) {t}" for t in ("a", "b")),
)
def _(spark, sf):
    models = cp.fit_copula(fx.order_facts(spark, sf), fx.ORDER_NUM, fx.ORDER_CAT, {"o_totalprice": "gamma", "c_acctbal": "uniform"})
    return models.correlation().select("a", "b", (F.col("corr") > 0.999999).alias("is_one"), F.col("corr").between(-1, 1.0000001).alias("in_range"))


@query("K4_moments", f"WITH {fx.PARTS} SELECT 'truncnorm' AS marginals, true AS holds FROM parts LIMIT 1")
def _(spark, sf):
    """Truncated normals keep the mean within 2 % and the deviation within 8 % of the table's."""
    df = fx.parts(spark, sf)
    models = cp.fit_copula(df, fx.PART_NUM, [], default_distribution="truncnorm")
    sample = cp.sample_copula(models, 50_000, seed=3)
    near = F.lit(True)
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in fx.PART_NUM for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    for c in fx.PART_NUM:
        near = near & (F.abs(F.avg(c) / F.lit(ends[f"m_{c}"]) - 1) < 0.02) & (F.abs(F.stddev_pop(c) / F.lit(ends[f"s_{c}"]) - 1) < 0.08)
    return sample.agg(F.lit("truncnorm").alias("marginals"), near.alias("holds"))


@query(
    "L3_shadow_facts",
    f"WITH {fx.PARTS} SELECT CAST(range AS BIGINT) AS shadow_id, CAST(16 AS BIGINT) AS n_cells, true AS in_range FROM range(20)",
)
def _(spark, sf):
    df = fx.parts(spark, sf)
    models = pv.fit_shadows(df, pv.memberships(df, 20), fx.PART_NUM, fx.PART_CAT)
    cells = models.correlation().groupBy("shadow_id")
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.bool_and(F.col("corr").between(-1, 1.0000001)).alias("in_range"))


@query(
    "L4_raw_draws",
    f"WITH {fx.PARTS} SELECT CAST(s.range AS BIGINT) AS shadow_id, CAST(d.range AS BIGINT) AS syn_id, (SELECT count(*) // 2 FROM parts) AS n_rows "
    "FROM range(20) s, range(5) d",
)
def _(spark, sf):
    """Every shadow and draw has exactly half as many rows as the table."""
    df = fx.parts(spark, sf)
    models = pv.fit_shadows(df, pv.memberships(df, 20), fx.PART_NUM, fx.PART_CAT)
    return cp.sample_copula(models, df.count() // 2, 5).groupBy("shadow_id", "syn_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("I13_report_facts", "SELECT unnest(['ridge', 'svr', 'rfr', 'mlpr']) AS model, CAST(2 AS BIGINT) AS n_metrics")
def _(spark, sf):
    """One report has both metrics of all four models."""
    from twinframe.plans.jobs import train_real_test_real

    meta = parts_meta("regression")
    split = two_stage_split(fx.parts(spark, sf), meta.target_column, meta.task)
    report = train_real_test_real(split, meta, SMALL).where(~F.isnan("value"))
    return report.groupBy("model").agg(F.count(F.lit(1)).alias("n_metrics"))


@query("I14_gap_facts", "SELECT unnest(['ridge', 'svr', 'rfr', 'mlpr']) AS model, CAST(2 AS BIGINT) AS n_metrics")
def _(spark, sf):
    """Models fitted on one half as the twin are scored on the test rows of the other, with both metrics of each."""
    from twinframe.plans.jobs import train_synthetic_test_real

    meta = parts_meta("regression")
    real, twin = fx.pair(fx.parts(spark, sf))
    split = two_stage_split(real, meta.target_column, meta.task)
    report = train_synthetic_test_real(twin, split.where("split = 'test'").drop("split"), meta, SMALL).where(~F.isnan("value"))
    return report.groupBy("model").agg(F.count(F.lit(1)).alias("n_metrics"))
