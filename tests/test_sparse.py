"""Sparse encodings against the dense forms and plain loops, with tables beyond the broadcast limit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import codec as cd
from twinframe.operators import encode as en
from twinframe.operators import models as md
from twinframe.operators import sparse as sp
from twinframe.operators.ordering import look_up, ranks_within

WIDE = 50_000


@pytest.fixture(scope="module")
def wide(spark):
    """150,000 rows; a third share one of 50,000 categories, and some have none."""
    row = F.col("row_id")
    value = F.when(row % 3 == 0, F.lit("v7")).when(row % 1000 == 1, F.lit(None)).otherwise(F.concat(F.lit("v"), row % WIDE))
    return spark.range(150_000).withColumnRenamed("id", "row_id").select(
        "row_id", value.alias("c"), F.when(row % 2 == 0, "x").otherwise("y").alias("d"), (row % 11).cast("double").alias("y")
    )


@pytest.fixture(scope="module")
def blocks(wide):
    return sp.fit_blocks(wide, ["c", "d"])


def test_ranks_beyond_the_limit_equal_sorting(spark):
    rows = [(g, f"{g}{(i * 7919) % 4001}") for g in ("a", "b") for i in range(4001)]
    df = spark.createDataFrame(rows, "g string, k string").repartition(5)
    got = {(r.g, r.k): r.at for r in ranks_within(df, "g", "k", "at", limit=100).collect()}
    for g in ("a", "b"):
        assert [k for _, k in sorted((at, k) for (h, k), at in got.items() if h == g)] == sorted(k for h, k in rows if h == g)
        assert sorted(at for (h, _), at in got.items() if h == g) == list(range(4001))


def test_look_up_keeps_every_row(spark):
    table = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    key = lambda i: None if i % 10 == 0 else "hot" if i % 10 == 1 else "k5" if i % 3 == 0 else f"k{i % 25_000}"
    rows = [(i, key(i)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "row_id long, c string")
    got = {r.row_id: r.v for r in look_up(df, F.col("c"), table, "v").collect()}
    expected = lambda c: int(c[1:]) if c and c.startswith("k") and int(c[1:]) < 20_000 else None
    assert got == {i: expected(c) for i, c in rows}


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, c string")
    blocks = sp.fit_blocks(df, ["c"])
    assert blocks.width == 0 and blocks.places(df).count() == 0
    other = spark.createDataFrame([(1, "a")], "row_id long, c string")
    assert blocks.places(other).first()["places"] == [None]


def test_wide_places_and_back(wide, blocks):
    values = sorted({r["c"] for r in wide.select("c").distinct().collect() if r["c"] is not None})
    assert blocks.widths == {"c": len(values), "d": 2} and len(values) > 40_000
    at = {v: i for i, v in enumerate(values)}
    placed = blocks.places(wide)
    for r in placed.where("row_id < 5000").collect():
        assert r["places"] == [at.get(r["c"]), len(values) + (0 if r["d"] == "x" else 1)]
    back = blocks.decode(placed.select("row_id", "y", "places")).select(*wide.columns[:1], "c", "d", "y")
    assert back.exceptAll(wide.select("row_id", "c", "d", "y")).isEmpty() and back.count() == wide.count()


def test_equal_to_the_dense_forms(spark):
    rows = [(i, float(i), "a_b" if i % 3 else "c", f"q{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, n double, c string, e string")
    dense, blocks = cd.fit_dummies(df, ["c", "e"]), sp.fit_blocks(df, ["c", "e"], rename=True)
    ones = {r["row_id"]: [i for i, v in enumerate(r["onehot"]) if v] for r in cd.dummies(df, dense).collect()}
    sparse = sp.sparse_dummies(df, blocks)
    assert {r["row_id"]: r["places"] for r in sparse.collect()} == ones
    assert sorted(map(tuple, sp.sparse_categories(sparse, blocks).select("row_id", "n", "c", "e").collect())) == rows
    soft = df.withColumn("soft", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: (k * F.col("row_id")) % 4))
    hard = soft.select("row_id", dense.harden("soft").alias("h"), blocks.winners("soft").alias("w"))
    assert all([i for i, v in enumerate(r["h"]) if v] == r["w"] for r in hard.collect())
    weights = {r["name"]: r["weight"] for r in sp.place_weights(df, ["n", "c", "e"], ["c", "e"]).collect()}
    expected = dict(cd.encoded_importance(df, dense))
    assert weights.keys() == expected.keys() and all(math.isclose(weights[k], expected[k]) for k in expected)


def test_vectors_equal_the_dense_features(spark):
    rows = [(i, float(i % 7), f"q{i % 5}", "u" if i % 2 else "v") for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, n double, c string, t string")
    new = spark.createDataFrame([(90, 1.0, "other", "u"), (91, 2.0, None, "v")], df.schema)
    dense = en.fit_features(df, ["n"], ["c"], "t", "classification")
    sparse = sp.fit_sparse_features(df, ["n"], ["c"], "t", "classification")
    both = df.unionByName(new)
    a = {r["row_id"]: (r["features"], r["label"]) for r in dense.transform(both).collect()}
    b = {r["row_id"]: (list(r["features"].toArray()), r["label"]) for r in sparse.transform(both).collect()}
    assert a == b and sparse.width == 6


def test_ridge_over_a_wide_column_is_the_closed_form(spark, wide, blocks):
    known = wide.where("c IS NOT NULL")
    coder = sp.SparseEncoder(en.Scaler({}, {}), sp.Blocks(("c",), {"c": blocks.widths["c"]}, blocks.codes), "y", en.Scaler({"y": 0.0}, {"y": 1.0}), None)
    rows = coder.transform(known)
    got = md.ridge(rows, rows, alpha=2.0, fit_intercept=False)
    closed = known.groupBy("c").agg((F.sum("y") / (F.count("y") + 2.0)).alias("w"))
    off = got.join(known.join(closed, "c").select("row_id", "w"), "row_id").agg(F.max(F.abs(F.col("prediction") - F.col("w"))), F.count("w")).first()
    assert off[1] == known.count() and off[0] < 1e-3


def test_wide_ridge_keeps_weights_and_descriptions_off_the_driver(spark, monkeypatch):
    """Rows with repeated ids, missing and unseen categories, against the normal equations."""
    category = lambda i: None if i % 17 == 0 else f"q{i % 5}" if i % 3 else "hot"
    rows = [(i // 2, float((i * 7) % 13) / 4, category(i), f"z{(i * i) % 9}", float((i * 31) % 23)) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, n double, c string, e string, y double")
    coder = sp.fit_sparse_features(df.where("c <> 'q1'"), ["n"], ["c", "e"], "y", "regression")
    listed = lambda t: sorted((r["row_id"], r["label"], list(r["features"].toArray())) for r in t.collect())
    described = listed(coder.transform(df))
    monkeypatch.setattr(sp, "ONE_HOT_LIMIT", 5, raising=False)
    monkeypatch.setattr(md, "WIDE", 5, raising=False)
    wide = coder.transform(df)
    assert not wide.schema["features"].metadata and listed(wide) == described
    monkeypatch.setattr(md, "LinearRegression", None)  # its weights lie on the driver
    x, y = np.array([r[2] for r in described]), np.array([r[1] for r in described])
    w = np.linalg.solve(x.T @ x + 2.0 * np.eye(x.shape[1]), x.T @ y)
    centred = x - x.mean(axis=0)
    v = np.linalg.solve(centred.T @ centred + 2.0 * np.eye(x.shape[1]), centred.T @ y)
    for fit_intercept, expected in ((False, x @ w), (True, centred @ v + y.mean())):
        got = md.ridge(wide, wide, alpha=2.0, fit_intercept=fit_intercept).collect()
        told = sorted((r["row_id"], r["label"], round(r["prediction"], 7)) for r in got)
        assert told == sorted((r[0], r[1], round(float(p), 7)) for r, p in zip(described, expected))
