"""Fidelity (G): distances and dependence between a real table and its twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.operators import dependence as dp
from twinframe.operators import distance as ds
from twinframe.operators import distribution as db

OF = fx.ORDER_FACTS
PAIR = f"WITH {OF}, {fx.sql_pair('order_facts')}"
NUM, CAT = fx.ORDER_NUM, fx.ORDER_CAT


def halves(spark, sf):
    return fx.pair(fx.order_facts(spark, sf))


def sql_gower(x: str, y: str, source: str = "order_facts") -> str:
    parts = [
        f"abs({x}.{c} - {y}.{c}) / (SELECT max({c}) - min({c}) FROM {source})" for c in NUM
    ] + [f"CASE WHEN {x}.{c} = {y}.{c} THEN 0.0 ELSE 1.0 END" for c in CAT]
    return "(" + " + ".join(parts) + f") / {len(parts)}"


ALIGNED = (
    f"{PAIR}, x AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS position FROM real), "
    "y AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS position FROM syn)"
)


@query(
    "G1_gower_aligned",
    f"{ALIGNED} SELECT position, x.row_id AS x_row_id, y.row_id AS y_row_id, round({sql_gower('x', 'y')}, 6) AS gower "
    "FROM x JOIN y USING (position)",
)
def _(spark, sf):
    return ds.gower_aligned(*halves(spark, sf), NUM, CAT).withColumn("gower", F.round("gower", 6))


@query(
    "G1_gower_row_means",
    f"{PAIR}, w AS (SELECT max(o_totalprice) - min(o_totalprice) AS w1, max(c_acctbal) - min(c_acctbal) AS w2 FROM "
    "order_facts) SELECT r.row_id, round(avg((abs(r.o_totalprice - s.o_totalprice) / w1 + abs(r.c_acctbal - s.c_acctbal) "
    "/ w2 + "
    + " + ".join(f"CASE WHEN r.{c} = s.{c} THEN 0.0 ELSE 1.0 END" for c in CAT)
    + ") / 5), 6) AS mean_gower FROM real r, syn s, w GROUP BY r.row_id",
)
def _(spark, sf):
    out = ds.gower_row_means(*halves(spark, sf), NUM, CAT)
    return out.withColumn("mean_gower", F.round("mean_gower", 6))


@query(
    "G2_mean_gower",
    f"{PAIR}, w AS (SELECT max(o_totalprice) - min(o_totalprice) AS w1, max(c_acctbal) - min(c_acctbal) AS w2 FROM "
    "order_facts) SELECT round(avg((abs(r.o_totalprice - s.o_totalprice) / w1 + abs(r.c_acctbal - s.c_acctbal) / w2 + "
    + " + ".join(f"CASE WHEN r.{c} = s.{c} THEN 0.0 ELSE 1.0 END" for c in CAT)
    + ") / 5), 6) AS mean_gower FROM real r, syn s, w",
)
def _(spark, sf):
    return ds.mean_gower(*halves(spark, sf), NUM, CAT).select(F.round("mean_gower", 6).alias("mean_gower"))


def sql_wasserstein(columns: list[str], weight: str = "1.0", real: str = "real", syn: str = "syn", digits: int = 4) -> str:
    def one(c):
        return (
            f"SELECT '{c}' AS \"column\", round(sum(abs(f - g) * gap), {digits}) AS wasserstein FROM (SELECT "
            "sum(r) OVER o / sum(r) OVER () AS f, sum(s) OVER o / sum(s) OVER () AS g, "
            "coalesce(lead(v) OVER o - v, 0) AS gap FROM (SELECT v, sum(r) AS r, sum(s) AS s FROM ("
            f"SELECT CAST({c} AS DOUBLE) AS v, {weight} AS r, 0.0 AS s FROM {real} UNION ALL SELECT CAST({c} AS DOUBLE), 0.0, "
            f"{weight} FROM {syn}) GROUP BY v) WINDOW o AS (ORDER BY v))"
        )

    return fx.sql_union([one(c) for c in columns])


@query("G6_wasserstein_1d", f"{PAIR} {sql_wasserstein(NUM)}")
def _(spark, sf):
    out = ds.wasserstein_1d(*halves(spark, sf), NUM)
    return out.withColumn("wasserstein", F.round("wasserstein", 4))


WEIGHT = f"(1 + {fx.sql_rnd('w', 'row_id')})"


@query("G6_wasserstein_1d_weighted", f"{PAIR} {sql_wasserstein(NUM, WEIGHT)}")
def _(spark, sf):
    weighted = [df.withColumn("w", 1 + fx.rnd("w", F.col("row_id"))) for df in halves(spark, sf)]
    out = ds.wasserstein_1d(*weighted, NUM, "w", "w")
    return out.withColumn("wasserstein", F.round("wasserstein", 4))


LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_PAIR = (
    f"real AS (SELECT * FROM lineitem WHERE {fx.sql_rnd('pair', 'l_orderkey')} < 0.5), "
    f"syn AS (SELECT * FROM lineitem WHERE {fx.sql_rnd('pair', 'l_orderkey')} >= 0.5)"
)


def line_halves(spark, sf):
    df = fx.table(spark, sf, "lineitem")
    side = fx.rnd("pair", F.col("l_orderkey"))
    return df.where(side < 0.5), df.where(side >= 0.5)


def sql_corr_cells(columns: list[str], source: str) -> str:
    return fx.sql_union(
        [f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c FROM {source}" for a in columns for b in columns]
    )


CORR_PAIR = f"x AS ({sql_corr_cells(LINE_NUM, 'real')}), y AS ({sql_corr_cells(LINE_NUM, 'syn')})"


@query(
    "G8_correlation_change",
    f"WITH {LINE_PAIR}, {CORR_PAIR} SELECT round(avg(m), 6) AS avg_change FROM (SELECT b, avg(abs(x.c - y.c)) AS m FROM x "
    "JOIN y USING (a, b) GROUP BY b)",
)
def _(spark, sf):
    out = dp.mean_correlation_change(*line_halves(spark, sf), LINE_NUM)
    return out.select(F.round("avg_change", 6).alias("avg_change"))


SCALED = (
    "w AS (SELECT min(o_totalprice) AS a1, max(o_totalprice) - min(o_totalprice) AS w1, min(c_acctbal) AS a2, "
    "max(c_acctbal) - min(c_acctbal) AS w2 FROM real), "
    "x AS (SELECT (o_totalprice - a1) / w1 AS p, (c_acctbal - a2) / w2 AS q FROM real, w), "
    "y AS (SELECT (o_totalprice - a1) / w1 AS p, (c_acctbal - a2) / w2 AS q FROM syn, w)"
)


def sql_kernel(a: str, b: str) -> str:
    return f"(SELECT avg(exp(-((s.p - t.p) * (s.p - t.p) + (s.q - t.q) * (s.q - t.q)))) FROM {a} s, {b} t)"


@query(
    "G9_mmd_rbf",
    f"{PAIR}, {SCALED} SELECT round(1000 * ({sql_kernel('x', 'x')} - 2 * {sql_kernel('x', 'y')} + {sql_kernel('y', 'y')}), 6) "
    "AS mmd_milli",
)
def _(spark, sf):
    from twinframe.operators.encode import fit_scaler

    real, syn = halves(spark, sf)
    scaler = fit_scaler(real, NUM, "minmax")
    vector = lambda df: df.select(F.array(*[scaler.transform(c) for c in NUM]).alias("x"))
    out = ds.mmd_rbf(vector(real), vector(syn), "x", gamma=1.0, tolerance=1e-12)
    return out.select(F.round(F.col("mmd") * 1000, 6).alias("mmd_milli"))


@query("G9_mmd_rbf_embeddings")
def _(spark, sf):
    df = fx.table(spark, sf, "embeddings")
    side = fx.rnd("pair", F.col("vec_id"))
    return ds.mmd_rbf_features(df.where(side < 0.5), df.where(side >= 0.5), "embedding", gamma=1.0)


def sql_chi2(c: str) -> str:
    """Statistic, p-value and degrees of freedom of one column; here always an even number of them."""
    return (
        f"SELECT '{c}' AS \"column\", round(stat, 6) AS chi2, round(exp(-stat / 2) * (SELECT sum(pow(stat / 2, k) / "
        "factorial(CAST(k AS INTEGER))) FROM range(64) g(k) WHERE k < dof // 2), 6) AS p_value, dof FROM (SELECT "
        "n * (sum(o * o / (r * c)) - 1) AS stat, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof FROM "
        "(SELECT a, b, CAST(o AS DOUBLE) AS o, CAST(sum(o) OVER (PARTITION BY a) AS DOUBLE) AS r, CAST(sum(o) OVER (PARTITION BY b) AS DOUBLE) AS c, CAST(sum(o) OVER () AS DOUBLE) AS n FROM "
        f"(SELECT x.{c} AS a, y.{c} AS b, count(*) AS o FROM x JOIN y USING (position) GROUP BY 1, 2)) GROUP BY n)"
    )


@query(
    "G10_chi2",
    f"{ALIGNED} {sql_chi2('o_orderstatus')}",
)
def _(spark, sf):
    out = dp.chi2(*halves(spark, sf), ["o_orderstatus"])
    return out.withColumns({c: F.round(c, 6) for c in ("chi2", "p_value")})


@query(
    "G10_expected",
    f"{ALIGNED}, cells AS (SELECT x.o_orderpriority AS a, y.o_orderpriority AS b FROM x JOIN y USING (position)), "
    "n AS (SELECT count(*) AS n FROM cells), r AS (SELECT a, count(*) AS r FROM cells GROUP BY a), c AS (SELECT b, count(*) "
    "AS c FROM cells GROUP BY b) SELECT r.a AS x, c.b AS y, (SELECT count(*) FROM cells k WHERE k.a = r.a AND k.b = c.b) AS "
    "observed, round(r * c / n, 6) AS expected FROM r, c, n",
)
def _(spark, sf):
    out = dp.expected_counts(*halves(spark, sf), "o_orderpriority")
    return out.withColumn("expected", F.round("expected", 6))


@query("G11_chi2_score", f"{ALIGNED} {fx.sql_union([sql_chi2(c) for c in CAT])}")
def _(spark, sf):
    out = dp.chi2_score(*halves(spark, sf), CAT)
    return out.withColumns({c: F.round(c, 6) for c in ("chi2", "p_value")})


def sql_aligned_corr(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", round(corr(x.{c}, y.{c}), 6) AS corr FROM x JOIN y USING (position)"


@query("G12_aligned_correlation", f"{ALIGNED} {fx.sql_union([sql_aligned_corr(c) for c in NUM])}")
def _(spark, sf):
    return dp.aligned_correlation(*halves(spark, sf), NUM).withColumn("corr", F.round("corr", 6))


@query(
    "G13_correlation_report",
    f"{ALIGNED}, num AS ({fx.sql_union([sql_aligned_corr(c) for c in NUM])}), cat AS "
    f"({fx.sql_union([sql_chi2(c) for c in CAT])}) SELECT 'numerical' AS kind, \"column\", 'corr' AS statistic, corr AS value "
    "FROM num UNION ALL SELECT 'categorical', \"column\", 'chi2', chi2 FROM cat UNION ALL SELECT 'categorical', \"column\", "
    "'p_value', p_value FROM cat",
)
def _(spark, sf):
    return dp.correlation_report(*halves(spark, sf), CAT).withColumn("value", F.round("value", 6))


def sql_proportions(columns: list[str], tables: dict[str, str]) -> str:
    return fx.sql_union(
        [
            f"SELECT '{label}' AS dataset, '{c}' AS \"column\", {c} AS value, round(count(*) / (SELECT count(*) FROM {t}), 6) "
            f"AS proportion FROM {t} GROUP BY {c}"
            for label, t in tables.items()
            for c in columns
        ]
    )


REPORT = (
    f"{PAIR}, num AS ({sql_wasserstein(NUM)}), prop AS ({sql_proportions(CAT, {'real': 'real', 'syn': 'syn'})}), "
    "cat AS (SELECT \"column\", round(sum(abs(p - q)) / 2, 5) AS v FROM (SELECT \"column\", value, "
    "sum(CASE WHEN dataset = 'real' THEN proportion ELSE 0 END) AS p, sum(CASE WHEN dataset = 'syn' THEN proportion ELSE 0 "
    "END) AS q FROM prop GROUP BY 1, 2) GROUP BY 1) SELECT \"column\", 'wasserstein' AS metric, wasserstein AS value FROM "
    "num UNION ALL SELECT \"column\", 'total_variation', v FROM cat"
)


@query("entry_column_report", REPORT)
def column_report(spark, sf):
    """The flagship: every column of a real table against the same column of its twin."""
    real, syn = halves(spark, sf)
    numbers = ds.wasserstein_1d(real, syn, NUM).select(
        "column", F.lit("wasserstein").alias("metric"), F.round("wasserstein", 4).alias("value")
    )
    shares = db.category_proportions(db.label_tables({"real": real, "syn": syn}), CAT)
    side = lambda name: F.sum(F.when(F.col("dataset") == name, F.round("proportion", 6)).otherwise(0.0))
    cells = shares.groupBy("column", "value").agg(side("real").alias("p"), side("syn").alias("q"))
    cats = cells.groupBy("column").agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 5).alias("value"))
    return numbers.unionByName(cats.select("column", F.lit("total_variation").alias("metric"), "value"))


# ---- transport: intervals from a solver, so only rows are compared


@query("G3_wasserstein_gower")
def _(spark, sf):
    from twinframe.operators.transport import wasserstein_gower

    return wasserstein_gower(*fx.pair(fx.parts(spark, sf)), fx.PART_NUM, fx.PART_CAT)


@query("G3_transport_bounds")
def _(spark, sf):
    from twinframe.operators.transport import sorted_coupling

    return sorted_coupling(*halves(spark, sf), NUM, CAT)


@query(
    "G3_marginal_lower_bound",
    f"{PAIR}, num AS ({sql_wasserstein(NUM, digits=9)}), scaled AS (SELECT avg(wasserstein / CASE \"column\" "
    + " ".join(f"WHEN '{c}' THEN (SELECT max({c}) - min({c}) FROM order_facts)" for c in NUM)
    + f" END) AS v FROM num), prop AS ({sql_proportions(CAT, {'real': 'real', 'syn': 'syn'})}), cells AS (SELECT \"column\", "
    "value, sum(CASE WHEN dataset = 'real' THEN proportion ELSE -proportion END) AS gap FROM prop GROUP BY 1, 2) SELECT "
    f"round((SELECT v FROM scaled) * {len(NUM)} / 5 + (SELECT sum(abs(gap)) / 2 FROM cells) / 5, 4) AS lower",
)
def _(spark, sf):
    by_column = ds.gower_by_column(*halves(spark, sf), NUM, CAT)
    return by_column.agg(F.round(F.avg("lower_transport"), 4).alias("lower"))


@query("G4_wasserstein_numeric")
def _(spark, sf):
    from twinframe.operators.encode import fit_scaler, scale
    from twinframe.operators.transport import wasserstein_numeric

    real, syn = fx.pair(fx.parts(spark, sf))
    scaler = fit_scaler(real, fx.PART_NUM)
    return wasserstein_numeric(scale(real, scaler), scale(syn, scaler), fx.PART_NUM)


@query("G5_fidelity_score")
def _(spark, sf):
    """The mean of the draws that tuning uses."""
    from twinframe.operators.transport import TUNE_SAMPLE, cal_fidelity

    return cal_fidelity(*halves(spark, sf), NUM, CAT, sample=TUNE_SAMPLE)


_FLOOR_SQL = (
    f"{PAIR}, num AS ({sql_wasserstein(NUM, digits=9)}), scaled AS (SELECT avg(wasserstein / CASE \"column\" "
    + " ".join(f"WHEN '{c}' THEN (SELECT max({c}) - min({c}) FROM order_facts)" for c in NUM)
    + f" END) AS v FROM num), prop AS ({sql_proportions(CAT, {'real': 'real', 'syn': 'syn'})}), cells AS (SELECT \"column\", "
    "value, sum(CASE WHEN dataset = 'real' THEN proportion ELSE -proportion END) AS gap FROM prop GROUP BY 1, 2) SELECT "
    f"round((SELECT v FROM scaled) * {len(NUM)} / 5 + (SELECT sum(abs(gap)) / 2 FROM cells) / 5, 4) AS floor"
)


@query("G5_whole_tables", f"{_FLOOR_SQL}, true AS above_floor, true AS below_sorted, true AS narrow")
def _(spark, sf):
    """The score of all rows, between the bound of the columns and the cost of the sorted matching."""
    from twinframe.operators.transport import cal_fidelity, sorted_coupling

    real, syn = halves(spark, sf)
    floor = ds.gower_by_column(real, syn, NUM, CAT).agg(F.avg("lower_transport").alias("floor"))
    above = sorted_coupling(real, syn, NUM, CAT).select(F.col("upper").alias("sorted"))
    score = F.broadcast(cal_fidelity(real, syn, NUM, CAT).select("lower", "upper"))  # one row, as the others
    return score.join(F.broadcast(floor)).join(F.broadcast(above)).select(
        F.round("floor", 4).alias("floor"),
        (F.col("lower") >= F.col("floor") - 1e-9).alias("above_floor"),
        (F.col("upper") <= F.col("sorted") + 1e-9).alias("below_sorted"),
        (F.col("upper") - F.col("lower") <= 0.05 * F.col("upper")).alias("narrow"),
    )


SHIFT = 7.0


@query(
    "G3_shifted_twin",
    f"WITH {fx.PARTS} SELECT count(*) AS n_rows, true AS holds FROM parts",
)
def _(spark, sf):
    """Against itself moved by c in one column, the cost is c over the common range over the columns."""
    from twinframe.operators.transport import wasserstein_gower

    real = fx.parts(spark, sf)
    moved = real.withColumn("p_retailprice", F.col("p_retailprice") + SHIFT)
    ends = real.agg(F.max("p_retailprice").alias("hi"), F.min("p_retailprice").alias("lo"), F.count(F.lit(1)).alias("n")).first()
    exact = SHIFT / (ends["hi"] + SHIFT - ends["lo"]) / len(fx.PART_COLS)
    bounds = wasserstein_gower(real, moved, fx.PART_NUM, fx.PART_CAT)
    held = (F.col("lower") <= exact + 1e-6) & (F.col("upper") >= exact - 1e-6) & (F.col("upper") - F.col("lower") <= 0.1 * exact)
    return bounds.select(F.lit(ends["n"]).alias("n_rows"), held.alias("holds"))


@query(
    "G4_shifted_numbers",
    f"WITH {fx.PARTS} SELECT count(*) AS n_rows, true AS holds FROM parts",
)
def _(spark, sf):
    """Squared cost of a table against itself moved by c is c squared, for any c."""
    from twinframe.operators.transport import wasserstein_numeric

    real = fx.parts(spark, sf)
    moved = real.withColumn("p_retailprice", F.col("p_retailprice") + SHIFT)
    bounds = wasserstein_numeric(real, moved, fx.PART_NUM)
    exact = SHIFT * SHIFT
    held = (F.col("lower") <= exact + 1e-4) & (F.col("upper") >= exact - 1e-4) & (F.col("upper") - F.col("lower") <= 0.1 * exact)
    return bounds.select(F.lit(real.count()).alias("n_rows"), held.alias("holds"))


@query("G7_penalised_score")
def _(spark, sf):
    from twinframe.operators.transport import penalised_score

    return penalised_score(*fx.pair(fx.parts(spark, sf)), fx.PART_NUM, fx.PART_CAT)


@query("G14_fidelity_job")
def _(spark, sf):
    from twinframe.operators.profile import Metadata
    from twinframe.plans.jobs import fidelity_job

    meta = Metadata(("p_size",), tuple(fx.PART_CAT), "p_retailprice", "regression", 0, 4, 0.0)
    return fidelity_job(*fx.pair(fx.parts(spark, sf)), meta)
