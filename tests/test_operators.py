import math

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.catalog import fixtures as fx
from twinframe.operators import clean as cl
from twinframe.operators import codec as cd
from twinframe.operators import copula as cp
from twinframe.operators import dependence as dp
from twinframe.operators import distance as ds
from twinframe.operators import encode as en
from twinframe.operators import models as md
from twinframe.operators import neighbours as nb
from twinframe.operators import ordering as od
from twinframe.operators import privacy as pv
from twinframe.operators import profile as pf
from twinframe.operators import rows as rw
from twinframe.operators import search as se
from twinframe.operators import transport as tr
from twinframe.operators.impute import donors, impute
from twinframe.operators.neighbours import nearest


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_totals_with_a_hot_value_and_few_rows(spark):
    values = [5.0] * 400 + [float(v) for v in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["v"]: (r["cum_n"], r["all_n"], r["next_v"]) for r in od.running_totals(df, "v", ["n"], buckets=16).collect()}
    ordered = sorted(set(values))
    for i, v in enumerate(ordered):
        assert got[v] == (sum(x <= v for x in values), len(values), ordered[i + 1] if i + 1 < len(ordered) else None)


def test_dense_index_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id") - 50 * F.col("id")).alias("row_id")).distinct()
    a = as_set(od.dense_index(df, "row_id").select("row_id", "row_index"))
    b = as_set(od.dense_index(df.repartition(7), "row_id", buckets=5).select("row_id", "row_index"))
    assert a == b and [i for _, i in a] == list(range(len(a)))


def test_splits_are_exact_disjoint_and_order_free(spark, sf):
    df = fx.order_facts(spark, sf)
    for target, task in (("o_totalprice", "regression"), ("o_orderstatus", "classification")):
        split = rw.two_stage_split(df, target, task)
        assert as_set(split) == as_set(rw.two_stage_split(df.repartition(5), target, task))
        n = df.count()
        sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
        assert sizes["test"] == math.ceil(n * 0.2)
        assert sizes["val"] == math.ceil((n - sizes["test"]) * 0.2)
        assert sum(sizes.values()) == n == split.select("row_id").distinct().count()


def test_sample_with_replacement_has_exact_size(spark, sf):
    df = fx.parts(spark, sf)
    sizes = rw.sample_with_replacement(df, 137, "s", draws=3).groupBy("draw").count().collect()
    assert {r["draw"]: r["count"] for r in sizes} == {0: 137, 1: 137, 2: 137}
    assert rw.sample_half(df, 3).count() == df.count() // 2


def test_clean_on_repeated_and_incomplete_rows(spark):
    rows = [(9, 1.0, "a"), (3, 1.0, "a"), (4, None, "b"), (5, float("nan"), "b"), (7, 2.0, "c")]
    df = spark.createDataFrame(rows, "row_id long, x double, y string")
    assert as_set(cl.clean(df)) == [(0, 1.0, "a"), (1, 2.0, "c")]
    with pytest.raises(ValueError):
        cl.fill_missing(df, ["x"], ["y"], dropna=True, fillna=True)
    filled = {r["row_id"]: r["x"] for r in cl.fill_missing(df, ["x"], ["y"]).collect()}
    assert math.isclose(filled[4], 4 / 3) and math.isclose(filled[5], 4 / 3)


def test_schema_checks(spark, sf):
    df = fx.parts(spark, sf)
    with pytest.raises(ValueError):
        pf.check_compatible(df, df.drop("p_type"))
    with pytest.raises(ValueError):
        pf.check_compatible(df, df.withColumnRenamed("p_type", "kind"))
    with pytest.raises(ValueError):
        pf.require_no_nulls(fx.with_nulls(df))
    with pytest.raises(ValueError):
        pf.describe(df, "nothing")


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0)], "row_id long, x double")
    for kind in ("standard", "minmax"):
        assert {r["x"] for r in en.scale(df, en.fit_scaler(df, ["x"], kind)).collect()} == {0.0}


def test_ordinal_codes_keep_nulls_and_mark_unseen(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    new = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "row_id long, c string")
    codes = en.categories(fit, ["c"])
    got = lambda **k: {r["row_id"]: r["c"] for r in en.ordinal_encode(new, ["c"], codes, **k).collect()}
    assert got() == {1: 0, 2: -1, 3: -1}
    assert got(keep_null=True) == {1: 0, 2: -1, 3: None}


def test_bit_codec_round_trip(spark, sf):
    df = fx.parts(spark, sf)
    codec = cd.fit_bits(df, fx.PART_NUM, fx.PART_CAT)
    back = codec.decode(codec.split_bits(codec.join_bits(codec.encode(df))))
    both = df.join(back.select("row_id", *[F.col(c).alias(f"b_{c}") for c in fx.PART_COLS]), "row_id")
    for r in both.collect():
        assert all(r[c] == r[f"b_{c}"] for c in fx.PART_CAT)
        for c in fx.PART_NUM:
            assert abs(r[c] - r[f"b_{c}"]) <= (codec.high[c] - codec.low[c]) / (2**32 - 1) * 1.01


def test_label_codec_refuses_unseen_labels(spark):
    df = spark.createDataFrame([("a",), ("b",)], "y string")
    codec = cd.fit_label(df, "y", "classification")
    assert codec.n_classes == 2
    with pytest.raises(Exception, match="not seen"):
        codec.transform(spark.createDataFrame([("c",)], "y string")).collect()


def test_one_dimensional_distance_identities(spark, sf):
    df = fx.order_facts(spark, sf)
    same = ds.wasserstein_1d(df, df.repartition(3), fx.ORDER_NUM).collect()
    assert all(abs(r["wasserstein"]) < 1e-12 for r in same)
    moved = df.withColumn("c_acctbal", F.col("c_acctbal") + 12.5)
    assert math.isclose(ds.wasserstein_1d(df, moved, ["c_acctbal"]).first()["wasserstein"], 12.5, rel_tol=1e-9)


def test_mean_gower_is_the_mean_of_its_rows(spark, sf):
    real, syn = fx.pair(fx.order_facts(spark, sf))
    rows = ds.gower_row_means(real, syn, fx.ORDER_NUM, fx.ORDER_CAT).agg(F.avg("mean_gower")).first()[0]
    whole = ds.mean_gower(real, syn, fx.ORDER_NUM, fx.ORDER_CAT).first()[0]
    assert math.isclose(rows, whole, rel_tol=1e-9)


def test_mmd_against_all_pairs(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    side = fx.rnd("pair", F.col("vec_id"))
    real, syn = df.where(side < 0.5), df.where(side >= 0.5)
    x, y = (np.array([r[0] for r in t.select("embedding").collect()], dtype=float) for t in (real, syn))

    def brute(a, b, gamma):
        k = lambda p, q: np.exp(-gamma * ((p[:, None] - q[None]) ** 2).sum(-1)).mean()
        return k(a, a) - 2 * k(a, b) + k(b, b)

    out = ds.mmd_rbf_features(real, syn, "embedding").first()
    assert abs(out["mmd"] - brute(x, y, 1.0)) < 5 * out["standard_error"]
    short = lambda t: t.select(F.slice("embedding", 1, 3).alias("v"))
    exact = ds.mmd_rbf(short(real), short(syn), "v", gamma=0.7).first()
    assert abs(exact["mmd"] - brute(x[:, :3], y[:, :3], 0.7)) < 1e-8


def test_chi2_with_one_degree_is_corrected(spark):
    a = ["x"] * 30 + ["z"] * 20
    b = ["p"] * 18 + ["q"] * 12 + ["p"] * 5 + ["q"] * 15
    left = spark.createDataFrame(list(enumerate(a)), "row_id long, c string")
    right = spark.createDataFrame(list(enumerate(b)), "row_id long, c string")
    row = dp.chi2(left, right, ["c"]).first()
    table = np.array([[18, 12], [5, 15]], dtype=float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / 50
    stat = ((np.abs(table - expected) - 0.5) ** 2 / expected).sum()
    assert math.isclose(row["chi2"], stat, rel_tol=1e-9) and row["dof"] == 1
    assert math.isclose(row["p_value"], math.erfc(math.sqrt(stat / 2)), rel_tol=1e-6)
    with pytest.raises(ValueError):
        dp.chi2_score(left, right, ["missing"])


@pytest.mark.parametrize("n_num,n_cat", [(2, 2), (1, 0), (0, 2), (3, 1)])
def test_nearest_against_all_pairs(spark, n_num, n_cat):
    rng = np.random.default_rng(n_num + 10 * n_cat)

    def table(n, unseen):
        nums = rng.normal(size=(n, n_num)) ** 3
        return np.hstack([nums, rng.integers(-1 if unseen else 0, 4, (n, n_cat))]).astype(float)

    x, sets = table(300, False), [table(500, True), table(5, True)]
    x[200:] = x[0]  # a third of the targets are copies
    frame = lambda rows: spark.createDataFrame(rows, "row_id long, vec array<double>")
    targets = frame([(i, v.tolist()) for i, v in enumerate(x)])
    candidates = spark.createDataFrame(
        [(s, v.tolist()) for s, rows in enumerate(sets) for v in rows], "syn_id long, vec array<double>"
    )
    got = {(r["row_id"], r["syn_id"]): r["distance"] for r in nearest(targets, candidates, n_num, n_cat, ["syn_id"]).collect()}
    for s, rows in enumerate(sets):
        d = ((x[:, None, :n_num] - rows[None, :, :n_num]) ** 2).sum(-1)
        for k in range(n_num, n_num + n_cat):
            a, b = x[:, None, k], rows[None, :, k]
            d = d + np.where(a == b, 0, np.where((a < 0) | (b < 0), 1, 2))
        best = np.sqrt(d.min(axis=1))
        assert all(math.isclose(got[(i, s)], best[i], abs_tol=1e-9) for i in range(len(x)))
    assert len(got) == 600


@pytest.mark.parametrize("n_num,n_cat", [(2, 0), (1, 2), (0, 5)])
def test_nearest_through_a_high_tree(spark, monkeypatch, n_num, n_cat):
    for name, value in {"LEAF_ROWS": 4, "FAN": 3, "MAX_TOPS": 3, "SUMMARY_ROWS": 2}.items():
        monkeypatch.setattr(nb, name, value)
    rng = np.random.default_rng(7)
    table = lambda n: np.hstack([rng.normal(size=(n, n_num)) ** 3, rng.integers(0, 9, (n, n_cat))]).astype(float)
    x, sets = table(150), [table(700), table(40), table(1)]
    sets[0][:200, :n_num] = sets[0][0, :n_num]  # a hot packing key
    targets = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>")
    rows = [(s, v.tolist()) for s, part in enumerate(sets) for v in part]
    candidates = spark.createDataFrame(rows, "syn_id long, vec array<double>")
    got = {(r["row_id"], r["syn_id"]): r["distance"] for r in nearest(targets, candidates, n_num, n_cat, ["syn_id"]).collect()}
    assert len(got) == 450
    for s, part in enumerate(sets):
        d = ((x[:, None, :n_num] - part[None, :, :n_num]) ** 2).sum(-1)
        d = d + 2.0 * (x[:, None, n_num:] != part[None, :, n_num:]).sum(-1)
        assert all(math.isclose(got[(i, s)], best, abs_tol=1e-9) for i, best in enumerate(np.sqrt(d.min(axis=1))))


def test_leaves_and_sent_boxes_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(nb, "MAX_TOPS", 16)
    heights = []
    for n in (1_000, 10_000, 100_000):
        rows = spark.range(n).selectExpr("array(rand(3), rand(5)) AS vec", "0 AS only_set")
        tree = nb.BoxTree(rows, 2, 0, ["only_set"])
        sizes = tree.blocks.agg(F.max(F.size("block")), F.sum(F.size("block"))).first()
        assert sizes[0] == 2 * nb.LEAF_ROWS and sizes[1] == 2 * n
        assert sum(len(nodes) for nodes, *_ in tree.tops) <= 17
        heights.append(len(tree.inner))
    assert heights == [0, 1, 2]


def test_nearest_of_no_rows(spark):
    frame = lambda ids: spark.createDataFrame([(i, [float(i), 1.0]) for i in ids], "row_id long, vec array<double>")
    assert nearest(frame([1, 2]), frame([]).select("vec"), 1, 1).isEmpty()
    assert nearest(frame([]), frame([1]).select("vec"), 1, 1).isEmpty()


@pytest.mark.parametrize("shadows", [2, 5, 6])
def test_memberships_are_balanced(spark, sf, shadows):
    df = fx.parts(spark, sf)
    per_row = pv.memberships(df, shadows).groupBy("row_id").agg(F.count_if("is_member").alias("n"), F.count("*").alias("m"))
    assert {(r["n"], r["m"]) for r in per_row.collect()} == {(shadows // 2, shadows)}


def test_copula_sample_follows_its_marginals(spark, sf):
    df = fx.order_facts(spark, sf)
    families = {"o_totalprice": "truncnorm", "c_acctbal": "gamma"}
    models = cp.fit_copula(df, fx.ORDER_NUM, fx.ORDER_CAT, families)
    sample = cp.sample_copula(models, 4000, seed=1).drop("syn_id")
    assert sample.count() == 4000
    moments = lambda t: t.agg(*[f(c) for c in fx.ORDER_NUM for f in (F.avg, F.stddev, F.min, F.max)]).first()
    a, b = moments(df), moments(sample)
    for i in (0, 4):
        assert abs(a[i] - b[i]) < 0.1 * a[i + 1]
        assert b[i + 2] >= a[i + 2] and b[i + 3] <= a[i + 3]
    for c in fx.ORDER_CAT:
        share = lambda t: {r[c]: r["count"] / n for n in [t.count()] for r in t.groupBy(c).count().collect()}
        x, y = share(df), share(sample)
        assert set(x) == set(y) and all(abs(x[k] - y[k]) < 0.04 for k in x)
    assert as_set(sample) == as_set(cp.sample_copula(models, 4000, seed=1).drop("syn_id").repartition(3))
    with pytest.raises(ValueError):
        cp.fit_copula(df, fx.ORDER_NUM, [], {"c_acctbal": "beta"})


def test_copula_keeps_correlation(spark):
    base = spark.range(4000).select(F.col("id").alias("row_id"), fx.rnd("a", F.col("id")).alias("x"), fx.rnd("b", F.col("id")).alias("e"))
    df = base.select("row_id", "x", (F.col("x") + 0.5 * F.col("e")).alias("y"))
    models = cp.fit_copula(df, ["x", "y"], [], default_distribution="norm")
    got = cp.sample_copula(models, 4000).agg(F.corr("x", "y")).first()[0]
    assert abs(got - df.agg(F.corr("x", "y")).first()[0]) < 0.05


@pytest.mark.parametrize("resolution", [30, 10_000])
def test_transport_interval_holds_the_sorted_distance(spark, resolution):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=400), rng.normal(size=400) + 0.4
    frame = lambda v: spark.createDataFrame([(i, float(t)) for i, t in enumerate(v)], "row_id long, x double")
    exact = np.abs(np.sort(x) - np.sort(y)).mean()
    got = tr.wasserstein_numeric(frame(x), frame(y), ["x"], "euclidean", resolution).first()
    assert got["lower"] - 1e-5 <= exact <= got["upper"] + 1e-5
    assert got["upper"] - got["lower"] < (0.1 if resolution > 400 else 1.0) * exact


@pytest.mark.parametrize("kind", ["gower", "l1", "euclidean", "sqeuclidean"])
def test_sparse_plan_and_scan_enclose_the_best_matching(kind):
    """Against every matching of seven rows; scans and solutions alternate as the solver does."""
    rng = np.random.default_rng(5)
    for near in (1, 3):
        x = np.column_stack([rng.normal(size=(7, 2)), rng.integers(0, 3, 7)])
        y = np.column_stack([rng.normal(size=(7, 2)), rng.integers(0, 3, 7)])
        cost, mass = tr.cost_block(x, y, 2, kind), np.full(7, 1 / 7)
        exact = min(cost[range(7), p].mean() for p in itertools.permutations(range(7)))
        f, g = tr.coarse_duals((x, mass), (y, mass), 2, kind)
        i, j, low, high, eps = np.zeros(0, int), np.zeros(0, int), 0.0, np.inf, 0.0
        for _ in range(4):
            reduced = cost - g
            low = max(low, float(reduced.min(axis=1) @ mass + g @ mass))
            i = np.concatenate([i, np.repeat(np.arange(7), near), np.argsort(cost - f[:, None], axis=0)[:near].T.ravel()])
            j = np.concatenate([j, np.argsort(reduced, axis=1)[:, :near].ravel(), np.repeat(np.arange(7), near)])
            f, g, upper, eps = tr.sparse_plan((x, mass), (y, mass), i, j, f, g, 2, kind, 8 * eps, 0.004)
            high = min(high, upper)
        assert low - 1e-9 <= exact <= high + 1e-9
        assert high - low < 0.05 * exact


def test_plan_along_the_order_keeps_the_margins():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(5)
    a, b = a / a.sum(), b / b.sum()
    i, j, mass = tr.in_order(a, b)
    assert np.allclose(np.bincount(i, mass, 9), a) and np.allclose(np.bincount(j, mass, 5), b)


@pytest.mark.parametrize("kind, exact", [("sqeuclidean", 0.25), ("euclidean", 0.5), ("l1", 0.5)])
def test_transport_of_a_near_twin_is_narrow(spark, kind, exact):
    """The answer is far below the largest cost; a twin that is the table itself costs nothing."""
    rows = [(i, float(37 * i % 1009), float(i * i % 97)) for i in range(300)]
    real = spark.createDataFrame(rows, "row_id long, x double, y double")
    moved = real.withColumn("x", F.col("x") + 0.5)
    got = tr.wasserstein_numeric(real, moved, ["x", "y"], kind).first()
    assert got["lower"] - 1e-6 <= exact <= got["upper"] + 1e-6 and got["upper"] - got["lower"] < 0.05 * exact
    same = tr.wasserstein_numeric(real, real, ["x", "y"], kind).first()
    assert same["lower"] == 0.0 and same["upper"] < 1e-9


def test_transport_bounds_enclose_each_other(spark, sf):
    real, syn = fx.pair(fx.parts(spark, sf))
    tight = tr.wasserstein_gower(real, syn, fx.PART_NUM, fx.PART_CAT).first()
    loose = tr.sorted_coupling(real, syn, fx.PART_NUM, fx.PART_CAT).first()["upper"]
    assert 0 < tight["lower"] <= tight["estimate"] <= tight["upper"] <= loose + 1e-6
    same = tr.sorted_coupling(real, real, fx.PART_NUM, fx.PART_CAT).first()["upper"]
    assert abs(same) < 1e-12
    drawn = tr.cal_fidelity(real, syn, fx.PART_NUM, fx.PART_CAT, sample=(50, 3)).first()
    assert drawn["draws"] == 3 and drawn["lower"] <= drawn["wasserstein_gower"] <= drawn["upper"]


def test_imputation_fills_gaps_only(spark, sf):
    holes = fx.with_nulls(fx.parts(spark, sf))
    done = {r["row_id"]: r for r in impute(holes, fx.PART_NUM, fx.PART_CAT, num_iter=1).collect()}
    for r in holes.collect():
        for c in fx.PART_COLS:
            assert done[r["row_id"]][c] is not None
            assert r[c] is None or done[r["row_id"]][c] == r[c]


def test_donors_against_brute_force(spark):
    """Each gap gets the value of one of the five nearest predictions; ties and missing sides included."""
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 4 == 0 else float(i), float(rng.integers(0, 40)) + (0.5 if i % 4 == 0 else 0.0)) for i in range(200)]
    rows += [(900, None, -1e9), (901, None, 1e9)]
    found = {r["tid"]: r["donated"] for r in donors(spark.createDataFrame(rows, "tid long, value double, p double").repartition(5), "s").collect()}
    known = [(v, p) for _, v, p in rows if v is not None]
    assert set(found) == {t for t, v, _ in rows if v is None}
    for t, v, p in rows:
        if v is None:
            reach = sorted(abs(p - q) for _, q in known)[4]
            assert any(w == found[t] and abs(p - q) <= reach for w, q in known)
    nothing = spark.createDataFrame([(1, None, 0.0)], "tid long, value double, p double")
    assert donors(nothing, "s").count() == 0


def test_imputation_keeps_the_correlation(spark):
    """Filled cells are observed values and follow the other columns as the observed cells do."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=800)
    y = 2 * x + rng.normal(scale=0.5, size=800)
    rows = [(i, float(x[i]), None if i % 5 == 0 else float(y[i])) for i in range(800)]
    done = impute(spark.createDataFrame(rows, "row_id long, x double, y double"), ["x", "y"], [], num_iter=1).toPandas()
    assert set(done["y"]) <= {r[2] for r in rows if r[2] is not None}
    gaps = done[done["row_id"] % 5 == 0]
    assert abs(np.corrcoef(gaps["x"], gaps["y"])[0, 1] - np.corrcoef(x, y)[0, 1]) < 0.05


def planted(spark, n=600):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = x @ [2.0, -1.0, 0.5] + 0.3
    return spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "row_id long, features array<double>, label double")


def test_ridge_matches_its_closed_form(spark):
    df = planted(spark)
    rows = df.orderBy("row_id").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 50.0 * np.eye(3), xc.T @ yc)
    want = (x - x.mean(0)) @ w + y.mean()
    got = np.array([r["prediction"] for r in md.ridge(df, df, alpha=50.0).orderBy("row_id").collect()])
    assert np.allclose(got, want, atol=1e-3)


def test_gradient_models_recover_a_planted_line(spark):
    df = planted(spark)
    for fit, kwargs in ((md.svr, {"max_iter": 80, "epsilon": 0.01}), (md.mlp_regressor, {"max_iter": 80})):
        assert md.regression_metrics(fit(df, df, **kwargs)).first()["r2"] > 0.8


def test_search_is_reproducible_and_fails_loudly(spark):
    assert se.draw(se.SPACES["rfr"], 3) == se.draw(se.SPACES["rfr"], 3)
    trials = se.run_trials(spark, {"x": ("float", 0.0, 1.0)}, lambda p: (p["x"] - 0.5) ** 2, 5)
    best = se.best_trial(trials).first()
    assert best["value"] == min(r["value"] for r in trials.collect())

    def broken(params):
        raise RuntimeError("no score")

    with pytest.raises(RuntimeError):
        se.run_trials(spark, {"x": ("float", 0.0, 1.0)}, broken, 2)


def test_svc_kernels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.4).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "row_id long, features array<double>, label double")
    score = lambda **k: md.classification_metrics(md.svc(df, df, C=10.0, **k)).first()["accuracy"]
    assert score(kernel="rbf") > 0.9 and score(kernel="poly") > 0.9
    with pytest.raises(ValueError):
        md.svc(df, df, kernel="cosine")
    sides = df.withColumn("label", F.expr("CAST(features[0] > features[1] AS DOUBLE)"))
    assert md.classification_metrics(md.svc(sides, sides, C=10.0, kernel="sigmoid")).first()["accuracy"] > 0.9


def test_landmarks_give_the_kernel(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>").repartition(3)
    rbf = lambda a, b: np.exp(-0.5 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    sigmoid = lambda a, b: np.tanh(0.4 * a @ b.T)

    def gram(kernel, landmarks):
        (out,) = md.landmark_features(df, [df], kernel, landmarks)
        z = np.array([r["features"] for r in out.orderBy("row_id").collect()])
        return z @ z.T, z.shape[1]

    whole, _ = gram(rbf, 60)
    assert np.allclose(whole, rbf(x, x), atol=1e-6)
    part, width = gram(rbf, 20)
    assert width == 20 and 0 < np.abs(part - rbf(x, x)).max() < 1
    # A kernel with negative eigenvalues: the same eigenvectors, all eigenvalues by their size.
    values, vectors = np.linalg.eigh(sigmoid(x, x))
    assert values.min() < -1e-3
    flipped, _ = gram(sigmoid, 60)
    assert np.allclose(flipped, (vectors * np.abs(values)) @ vectors.T, atol=1e-4)


def test_all_kernels_are_drawn():
    drawn = {se.draw(se.SPACES["svc"], number)["kernel"] for number in range(50)}
    assert drawn == {"linear", "poly", "rbf", "sigmoid"}


def test_scratch_is_removed(spark):
    from twinframe.session import clear_scratch, scratch_path

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_params_come_back_typed():
    from twinframe.operators.search import SPACES, draw, typed_params

    for space in SPACES.values():
        params = draw(space, 3)
        assert typed_params(space, {k: str(v) for k, v in params.items()}) == params


@pytest.mark.parametrize("dof", [1500, 2001, 4000, 20_001])
def test_wide_chi_squared_against_the_sum(spark, dof):
    from twinframe.functions import special

    stats = spark.createDataFrame([(float(dof + k * (2 * dof) ** 0.5),) for k in (-3.0, -1.0, -0.01, 0.0, 0.02, 1.0, 3.0)], "s double")
    out = stats.select(special.chi2_sf(F.col("s"), F.lit(dof)).alias("p"), special._chi2_sf_sum(F.col("s"), F.lit(dof)).alias("q"))
    assert all(abs(r.p - r.q) < 1e-6 for r in out.collect())
