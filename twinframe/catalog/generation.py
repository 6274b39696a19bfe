"""Synthetic rows (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.catalog.fidelity import LINE_NUM, sql_corr_cells
from twinframe.operators import copula as cp


@query(
    "K1_copula_fit",
    f"SELECT a, b, round(c, 5) AS corr FROM ({sql_corr_cells(LINE_NUM, 'lineitem')})",
)
def _(spark, sf):
    """With normal marginals the fitted correlation is the one of the raw columns."""
    df = fx.table(spark, sf, "lineitem")
    models = cp.fit_copula(df, LINE_NUM, [], default_distribution="norm", row_id="l_orderkey")
    return models.correlation().withColumn("corr", F.round("corr", 5))


MIXED = {"o_totalprice": "gamma", "c_acctbal": "uniform"}


@query("K1_copula_fit_mixed")
def _(spark, sf):
    models = cp.fit_copula(fx.order_facts(spark, sf), fx.ORDER_NUM, fx.ORDER_CAT, MIXED)
    return models.correlation().withColumn("corr", F.round("corr", 5))


@query("K2_copula_sample")
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    models = cp.fit_copula(df, fx.ORDER_NUM, fx.ORDER_CAT, MIXED)
    return cp.sample_copula(models, df.count(), seed=7).drop("syn_id")


@query(
    "K2_sample_shape",
    f"WITH {fx.ORDER_FACTS} SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS n_status, "
    "count(DISTINCT o_orderpriority) AS n_priority, count(DISTINCT c_mktsegment) AS n_segment, true AS in_range FROM order_facts",
)
def _(spark, sf):
    """Row count, category sets and ranges of a sample are those of the training table."""
    df = fx.order_facts(spark, sf)
    sample = cp.sample_copula(cp.fit_copula(df, fx.ORDER_NUM, fx.ORDER_CAT, MIXED), df.count(), seed=7)
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in fx.ORDER_NUM for n, f in (("lo", F.min), ("hi", F.max))]).first()
    inside = F.lit(True)
    for c in fx.ORDER_NUM:
        inside = inside & F.col(c).between(F.lit(ends[f"lo_{c}"]), F.lit(ends[f"hi_{c}"]))
    return sample.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("o_orderstatus").alias("n_status"),
        F.count_distinct("o_orderpriority").alias("n_priority"),
        F.count_distinct("c_mktsegment").alias("n_segment"),
        F.bool_and(inside).alias("in_range"),
    )


@query("K3_train_job")
def _(spark, sf):
    from twinframe.operators.rows import two_stage_split
    from twinframe.plans.jobs import train_synthesiser
    from twinframe.session import scratch_path
    from twinframe.sources.tables import read_table

    split = two_stage_split(fx.order_facts(spark, sf), "o_totalprice", "regression")
    path = scratch_path(spark, "sample")
    train_synthesiser(split, fx.ORDER_NUM, fx.ORDER_CAT, path, MIXED)
    return read_table(spark, path)


@query("K4_default_marginals")
def _(spark, sf):
    df = fx.parts(spark, sf)
    n = df.count()
    out = None
    for family in ("truncnorm", "gamma"):
        models = cp.fit_copula(df, fx.PART_NUM, fx.PART_CAT, default_distribution=family)
        part = cp.sample_copula(models, n, seed=3).drop("syn_id").withColumn("marginals", F.lit(family))
        out = part if out is None else out.unionByName(part)
    return out
