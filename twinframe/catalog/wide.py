"""Columns with many categories: sparse encodings (E2, E16, E18, E19, E21, I1) and marginals as tables (K1, K2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.catalog.codecs import DUMMIES, NAMED_CAT, SCORES, named
from twinframe.operators import copula as cp
from twinframe.operators import models as md
from twinframe.operators import sparse as sp
from twinframe.operators.encode import Scaler

# Lines with the order as a category: an order that has only large lines is not seen while fitting.
LINE_CAT = ["l_orderkey", "l_returnflag"]
SEEN = "l_quantity <= 35"
LINES = (
    "lines AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_orderkey, l_returnflag, l_quantity, l_extendedprice "
    "FROM lineitem), "
    + ", ".join(
        f"codes_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v "
        f"FROM lines WHERE {SEEN}))"
        for c in LINE_CAT
    )
)


def lines(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), *LINE_CAT, "l_quantity", "l_extendedprice"
    )


@query(
    "E2_one_hot_places",
    f"WITH {LINES} SELECT row_id, a.code AS order_place, (SELECT count(*) FROM codes_l_orderkey) + b.code AS flag_place, "
    "(SELECT count(*) FROM codes_l_orderkey) + (SELECT count(*) FROM codes_l_returnflag) AS width FROM lines LEFT JOIN "
    "codes_l_orderkey a ON a.v = CAST(l_orderkey AS VARCHAR) LEFT JOIN codes_l_returnflag b ON b.v = l_returnflag",
)
def _(spark, sf):
    df = lines(spark, sf)
    blocks = sp.fit_blocks(df.where(SEEN), LINE_CAT)
    return blocks.places(df).select(
        "row_id",
        F.col("places")[0].alias("order_place"),
        F.col("places")[1].alias("flag_place"),
        F.lit(blocks.width).cast("long").alias("width"),
    )


@query(
    "E16_dummy_places",
    f"{DUMMIES} SELECT row_id, round(c_acctbal, 2) AS c_acctbal, max(CASE WHEN block = 0 THEN place - 1 END) AS nation_place, "
    "max(CASE WHEN block = 1 THEN place - 1 END) AS segment_place FROM named JOIN places ON replace(CASE WHEN col = 'n_name' "
    "THEN n_name ELSE c_mktsegment END, '_', '#') = v GROUP BY row_id, c_acctbal",
)
def _(spark, sf):
    df = named(spark, sf)
    out = sp.sparse_dummies(df, sp.fit_blocks(df, NAMED_CAT, rename=True))
    at = lambda i: F.col("places")[i]
    return out.select("row_id", F.round("c_acctbal", 2).alias("c_acctbal"), at(0).alias("nation_place"), at(1).alias("segment_place"))


def scored(spark, sf):
    df = named(spark, sf)
    blocks = sp.fit_blocks(df, NAMED_CAT, rename=True)
    score = lambda k: F.floor(fx.rnd("soft", F.col("row_id"), k) * 4) / 4
    return df.withColumn("soft", F.transform(F.sequence(F.lit(1), F.lit(blocks.width)), score)), blocks


@query(
    "E18_winning_places",
    f"{SCORES} SELECT row_id, CAST(place - 1 AS BIGINT) AS place FROM won WHERE w",
)
def _(spark, sf):
    df, blocks = scored(spark, sf)
    return df.select("row_id", F.explode(blocks.winners("soft")).alias("place"))


@query(
    "E19_decode_places",
    f"WITH {LINES} SELECT row_id, CASE WHEN CAST(l_orderkey AS VARCHAR) IN (SELECT v FROM codes_l_orderkey) THEN "
    "CAST(l_orderkey AS VARCHAR) END AS l_orderkey, l_returnflag, round(l_quantity, 2) AS l_quantity FROM lines",
)
def _(spark, sf):
    df = lines(spark, sf)
    blocks = sp.fit_blocks(df.where(SEEN), LINE_CAT, rename=True)
    back = sp.sparse_categories(sp.sparse_dummies(df, blocks), blocks)
    return back.select("row_id", *LINE_CAT, F.round("l_quantity", 2).alias("l_quantity"))


@query(
    "E21_place_weights",
    f"WITH {LINES}, total AS (SELECT count(*) AS t FROM lines), dummies AS ("
    + fx.sql_union(
        [
            f"SELECT '{c}_' || CAST({c} AS VARCHAR) AS name, sqrt(count(*) / any_value(t) * (1 - count(*) / any_value(t))) AS s "
            f"FROM lines, total GROUP BY {c}"
            for c in LINE_CAT
        ]
    )
    + "), encoded AS (SELECT name, s * (SELECT count(*) FROM dummies) / (SELECT sum(s) FROM dummies) AS w FROM dummies UNION ALL "
    "SELECT 'l_quantity', 2 * stddev_pop(l_quantity) / (stddev_pop(l_quantity) + stddev_pop(l_extendedprice)) FROM lines UNION ALL "
    "SELECT 'l_extendedprice', 2 * stddev_pop(l_extendedprice) / (stddev_pop(l_quantity) + stddev_pop(l_extendedprice)) FROM "
    "lines) SELECT name, round(w * (SELECT count(*) FROM encoded) / (SELECT sum(w) FROM encoded), 6) AS weight FROM encoded",
)
def _(spark, sf):
    df = lines(spark, sf)
    out = sp.place_weights(df, [*LINE_CAT, "l_quantity", "l_extendedprice"], LINE_CAT)
    return out.select("name", F.round("weight", 6).alias("weight"))


@query(
    "I1_ridge_wide",
    f"WITH {LINES}, fit AS (SELECT l_orderkey, sum(l_quantity) / (count(*) + 2.0) AS w FROM lines WHERE {SEEN} GROUP BY "
    "l_orderkey) SELECT count(*) AS n, round(avg((l_quantity - coalesce(w, 0)) * (l_quantity - coalesce(w, 0))), 3) AS mse "
    "FROM lines LEFT JOIN fit USING (l_orderkey)",
)
def _(spark, sf):
    """Ridge without intercept over the order alone: shrunken means, which SQL can tell."""
    df = lines(spark, sf)
    blocks = sp.fit_blocks(df.where(SEEN), ["l_orderkey"])
    coder = sp.SparseEncoder(Scaler({}, {}), blocks, "l_quantity", Scaler({"l_quantity": 0.0}, {"l_quantity": 1.0}), None)
    scored = md.ridge(coder.transform(df.where(SEEN)), coder.transform(df), alpha=2.0, fit_intercept=False)
    error = F.col("label") - F.col("prediction")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(error * error), 3).alias("mse"))


def line_models(spark, sf):
    df = lines(spark, sf).select("row_id", "l_orderkey", "l_returnflag", "l_quantity")
    return df, cp.fit_copula(df, ["l_quantity"], LINE_CAT)


@query(
    "K1_wide_intervals",
    f"WITH {LINES}, counted AS (SELECT CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lines GROUP BY 1), cumulated AS "
    "(SELECT value, n, sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM "
    "counted) SELECT value, round((upto - n) / total, 9) AS low, round(upto / total, 9) AS high FROM cumulated",
)
def _(spark, sf):
    _, models = line_models(spark, sf)
    return models.intervals("l_orderkey").select("value", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(
    "K2_wide_sample",
    "SELECT count(*) AS n, count(*) AS known, true AS every_second_order FROM lineitem",
)
def _(spark, sf):
    """As many rows as lines: all orders are known ones, and at least half of the orders are drawn."""
    df, models = line_models(spark, sf)
    known = df.select("l_orderkey").distinct().withColumn("known", F.lit(1))
    drawn = cp.sample_copula(models, df.count(), seed=3).join(known, "l_orderkey", "left")
    orders = known.agg(F.count("known").alias("orders"))
    found = drawn.agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"), F.count_distinct("l_orderkey").alias("drawn"))
    # One row of counts each.
    return found.join(F.broadcast(orders)).select("n", "known", (F.col("drawn") * 2 >= F.col("orders")).alias("every_second_order"))
