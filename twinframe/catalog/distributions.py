"""Distribution comparison (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.catalog.fidelity import CAT, LINE_NUM, LINE_PAIR, NUM, PAIR, halves, line_halves, sql_corr_cells, sql_proportions
from twinframe.operators import dependence as dp
from twinframe.operators import distribution as db

BOTH = {"real": "real", "synthetic": "syn"}


def labelled(spark, sf):
    real, syn = halves(spark, sf)
    return db.label_tables({"real": real, "synthetic": syn})


@query("H1_category_proportions", f"{PAIR} {sql_proportions(CAT, BOTH)}")
def _(spark, sf):
    return db.category_proportions(labelled(spark, sf), CAT).withColumn("proportion", F.round("proportion", 6))


@query(
    "H2_category_counts",
    f"{PAIR} "
    + fx.sql_union(
        [
            f"SELECT '{label}' AS dataset, '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {t} GROUP BY {c}"
            for label, t in BOTH.items()
            for c in CAT
        ]
    ),
)
def _(spark, sf):
    return db.category_counts(labelled(spark, sf), CAT)


def sql_density(columns: list[str], tables: dict[str, str]) -> str:
    def one(label, t, c):
        return (
            f"SELECT '{label}' AS dataset, '{c}' AS \"column\", k, round(x, 3) AS x, round(1000 * avg(exp(-0.5 * ((x - v) / bw) * "
            "((x - v) / bw))) / (bw * sqrt(2 * pi())), 6) AS density FROM (SELECT k, lo - 3 * bw + k * (hi + 3 * bw - (lo - 3 "
            "* bw)) / 199 AS x, bw FROM (SELECT min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS bw FROM "
            f"(SELECT {c} AS v FROM {t})), range(200) g(k)), (SELECT {c} AS v FROM {t}) GROUP BY k, x, bw"
        )

    return fx.sql_union([one(label, t, c) for label, t in tables.items() for c in columns])


@query("H3_kernel_density", f"{PAIR} {sql_density(NUM, BOTH)}")
def _(spark, sf):
    out = db.kernel_density(labelled(spark, sf), NUM)
    return out.withColumns({"x": F.round("x", 3), "density": F.round(F.col("density") * 1000, 6)})


@query(
    "H4_correlation_matrix",
    f"SELECT a, b, round(c, 6) AS corr FROM ({sql_corr_cells(LINE_NUM, 'lineitem')})",
)
def _(spark, sf):
    return dp.correlation_long(fx.table(spark, sf, "lineitem"), LINE_NUM).withColumn("corr", F.round("corr", 6))


@query(
    "H5_compare_correlation",
    f"WITH {LINE_PAIR}, x AS ({sql_corr_cells(LINE_NUM, 'real')}), y AS ({sql_corr_cells(LINE_NUM, 'syn')}) SELECT a, b, "
    "round(x.c, 6) AS first, round(y.c, 6) AS second, round(x.c - y.c, 6) AS delta FROM x JOIN y USING (a, b)",
)
def _(spark, sf):
    out = dp.compare_correlation(*line_halves(spark, sf), LINE_NUM)
    return out.withColumns({c: F.round(c, 6) for c in ("first", "second", "delta")})


NO_NULL = " AND ".join(f"{c} IS NOT NULL" for c in fx.ORDER_COLS)
COLS = ", ".join(fx.ORDER_COLS)


@query(
    "H6_compare_distributions",
    f"WITH {fx.ORDER_FACTS}, {fx.sql_pair('order_facts')}, {fx.sql_nulls('syn', fx.ORDER_COLS, 'holes')}, "
    f"{fx.sql_duplicates('syn', fx.ORDER_COLS, 'doubled')}, "
    f"c0 AS (SELECT DISTINCT {COLS} FROM real), c1 AS (SELECT DISTINCT {COLS} FROM holes WHERE {NO_NULL}), "
    f"c2 AS (SELECT DISTINCT {COLS} FROM doubled), bars AS ("
    + sql_proportions(CAT, {"real": "c0", "holes": "c1", "doubled": "c2"})
    + "), curves AS ("
    + sql_density(NUM, {"real": "c0", "holes": "c1", "doubled": "c2"})
    + ") SELECT dataset, \"column\", 'proportion' AS kind, value AS point, proportion AS value FROM bars UNION ALL SELECT "
    "dataset, \"column\", 'density', CAST(k AS VARCHAR), density FROM curves",
)
def _(spark, sf):
    real, syn = halves(spark, sf)
    out = db.compare_distributions(real, {"holes": fx.with_nulls(syn), "doubled": fx.with_duplicates(syn)}, NUM, CAT)
    scaled = F.when(F.col("kind") == "density", F.col("value") * 1000).otherwise(F.col("value"))
    return out.withColumn("value", F.round(scaled, 6))
