"""Plans and blocks that keep their size when the tables grow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from twinframe.catalog import privacy
from twinframe.catalog.encoding import pair_unseen
from twinframe.operators import encode
from twinframe.operators import models as md
from twinframe.operators import neighbours as nb
from twinframe.operators import privacy as pv
from twinframe.operators.ordering import look_up


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_memberships_are_not_sent_whole(spark):
    df = spark.range(50).selectExpr("id AS row_id", "id % 7 AS x")
    members = pv.memberships(df, 4)
    for joined in (pv.shadow_tables(df, members), pv.score_shadows(df, members.selectExpr("shadow_id", "0 AS syn_id", "row_id % 7 AS x"), members, [])):
        last = plan_of(joined).split("Join", 1)[0]
        assert "BroadcastHash" not in last and "SortMerge" in last
    assert pv.shadow_tables(df, members).count() == 100


def test_long_entries_of_frequent_keys_stay_out_of_the_shuffle(spark):
    rows = spark.range(40).selectExpr("id", "CASE WHEN id = 39 THEN NULL ELSE id % 8 END AS c")
    table = spark.range(6).selectExpr("id AS k", "array_repeat(id, 100) AS v")
    often = spark.range(3).selectExpr("id AS _k")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = look_up(rows, F.col("c"), table, "v", hot_share=4, limit=2, often=often)
        lines = plan_of(out).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    shuffled = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning" in line]
    assert shuffled and not any("_hot_v" in line for line in shuffled)
    found = {r["id"]: r["v"] for r in out.collect()}
    assert len(found) == 40 and all(
        v == ([i % 8] * 100 if i != 39 and i % 8 < 6 else None) for i, v in found.items()
    )


def test_wide_features_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(encode, "TASK_BYTES", 1000)
    rows = spark.range(0, 60, 1, 1).selectExpr("id AS row_id", "double(id) AS x", "string(id % 9) AS c", "double(id % 5) AS y")
    coder = encode.fit_features(rows, ["x"], ["c"], "y", "regression")
    out = coder.transform(rows)
    assert out.rdd.getNumPartitions() == 5  # of 60 rows of 10 numbers of 8 bytes
    assert out.count() == 60


def test_products_of_one_hot_blocks_are_kept_without_zeros(spark):
    rows = spark.range(40).selectExpr(
        "id AS row_id", "transform(sequence(0, 11), k -> IF(k = id % 12, 1D, 0D)) AS features", "double(id % 2) AS label"
    )
    packed = md._packed(md.as_vectors(rows))
    assert packed.first()["features"].__class__.__name__ == "SparseVector"
    assert [r["features"].toArray().tolist() for r in packed.orderBy("row_id").collect()] == [
        r["features"] for r in rows.orderBy("row_id").collect()
    ]
    assert md.svc(rows, rows, kernel="poly", max_iter=2).count() == 40


def test_blocks_of_targets_and_the_frames_of_them_are_bounded(monkeypatch):
    monkeypatch.setattr(nb, "PIECE", 1000)
    rng = np.random.default_rng(1)
    goes = rng.random((1024, 40)) < 0.5
    goes[:, 7] = False
    a, t, nodes = rng.random((1024, 3)), np.arange(1024), np.arange(100, 140)
    blocks = list(nb._emit(2, nodes, goes, t, t / 2.0, a))
    assert max(len(b[2]) for b in blocks) <= nb.SENT
    met = {(int(i), b[1]) for b in blocks for i in b[2]}
    assert met == {(int(i), 100 + int(j)) for i, j in zip(*np.nonzero(goes))} and sum(len(b[2]) for b in blocks) == len(met)
    assert all((b[4].reshape(-1, 3) == a[b[2]]).all() and (b[3] == b[2] / 2.0).all() and b[0] == 2 for b in blocks)
    frames = list(nb._pieces(iter(blocks)))
    assert sum(len(f) for f in frames) == len(blocks)
    assert max(f["tids"].map(len).sum() for f in frames) < 1000 + nb.SENT
    assert not list(nb._emit(0, nodes, np.zeros((5, 40), dtype=bool), t[:5], t[:5], a[:5]))


def test_rows_are_dealt_out_by_the_width_of_the_kernel_map(spark, monkeypatch):
    monkeypatch.setattr(md, "TASK_BYTES", 20_000, raising=False)
    rows = spark.range(0, 60, 1, 1).selectExpr("id AS row_id", "array(id / 60D, (id % 7) / 7D) AS features", "double(id % 2) AS label")
    seen = []
    minimise = md._minimise
    monkeypatch.setattr(md, "_minimise", lambda train, *rest: seen.append(train.rdd.getNumPartitions()) or minimise(train, *rest))
    assert md.svr(rows, rows, max_iter=2).count() == 60
    assert seen == [7]  # of 60 rows of 256 numbers of 8 bytes


def test_targets_of_a_category_unknown_to_the_other_side_meet_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(nb, "LEAF_ROWS", 4)
    kept, write = {}, nb.written
    monkeypatch.setattr(nb, "written", lambda df, name, *rest: kept.setdefault(name, write(df, name, *rest)))
    rng = np.random.default_rng(5)
    x, y = rng.random((200, 2)), rng.random((3000, 2))
    codes = rng.choice([-1.0, 0.0, 2.0], 3000)
    targets = spark.createDataFrame([(i, [*v.tolist(), 1.0]) for i, v in enumerate(x)], "row_id long, vec array<double>")
    candidates = spark.createDataFrame([([*v.tolist(), c],) for v, c in zip(y, codes.tolist())], "vec array<double>")
    got = {r["row_id"]: r["distance"] for r in nb.nearest(targets, candidates, 2, 1).collect()}
    squared = ((x[:, None] - y[None]) ** 2).sum(-1) + np.where(codes < 0, 1.0, 2.0)[None]
    assert np.allclose([got[i] for i in range(200)], np.sqrt(squared.min(axis=1)))
    # Of the 16 leaves with rows of the unknown category, those next to the target and those that hold two categories.
    visits = kept["bounds"].where("node >= 0").agg(F.sum(F.size("tids"))).first()[0]
    assert visits <= 5 * 200


def test_joined_orders_are_written_before_they_are_searched(spark, sf):
    both = lambda pair: [sorted(map(str, side.collect())) for side in pair]
    pair = privacy.written_pair(spark, sf)
    assert not any("Join" in plan_of(side) for side in pair)
    assert both(pair) == both(pair_unseen(spark, sf))
