import hashlib
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from twinframe.functions.hashing import fast_normal, rnd
from twinframe.functions.special import add_norm_ppf, chi2_sf, gamma_cdf, norm_cdf
from twinframe.operators.rows import drawn_position


def test_rnd_is_the_md5_prefix(spark):
    row = spark.range(7, 8).select(rnd(42, F.col("id")).alias("r")).first()
    assert row["r"] == int(hashlib.md5(b"42|7").hexdigest()[:13], 16) / 2**52


def test_draws_reach_every_position_of_a_large_table(spark):
    """Positions alone, no such table: 32 bits would only reach multiples of 256 of 2^40."""
    u = rnd("large", F.col("id"))
    rows = spark.range(4000).select(drawn_position(u, 2**40).alias("p"), u.alias("u")).collect()
    assert len({r["p"] for r in rows}) > 3990 and {r["p"] % 256 for r in rows} >= set(range(200))
    assert all(r["p"] == int(r["u"] * 2**40) for r in rows)


def test_rnd_takes_a_column_as_seed(spark):
    row = spark.range(7, 8).select(rnd(F.lit(3), F.col("id")).alias("a"), rnd("3", F.col("id")).alias("b")).first()
    assert row["a"] == row["b"]


def test_normal_functions_agree_with_the_standard_library(spark):
    xs = [-8.0, -7.2, -3.0, -1.0, -0.1, 0.0, 0.2, 1.5, 6.9, 7.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert math.isclose(r["p"], 0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-15)
    ps = [1e-8, 1e-4, 0.02, 0.3, 0.5, 0.8, 0.999, 1 - 1e-7]
    out = add_norm_ppf(spark.createDataFrame([(p,) for p in ps], "p double"), {"z": "p"})
    for r in out.collect():
        assert math.isclose(r["z"], NormalDist().inv_cdf(r["p"]), abs_tol=1e-8)


def test_chi2_tail_at_even_odd_and_many_degrees(spark):
    def simpson(stat, dof):
        xs = np.linspace(1e-9, stat, 200_001)
        logs = (dof / 2 - 1) * np.log(xs) - xs / 2 - dof / 2 * math.log(2) - math.lgamma(dof / 2)
        ys = np.exp(logs)
        h = xs[1] - xs[0]
        return 1 - h / 3 * (ys[0] + ys[-1] + 4 * ys[1:-1:2].sum() + 2 * ys[2:-1:2].sum())

    cases = [(3.0, 2), (5.0, 4), (7.5, 3), (30.0, 16), (11.0, 9), (2100.0, 2000)]
    df = spark.createDataFrame(cases, "s double, d long").select("s", "d", chi2_sf(F.col("s"), F.col("d")).alias("p"))
    for r in df.collect():
        assert math.isclose(r["p"], simpson(r["s"], r["d"]), abs_tol=1e-5)
    one = spark.createDataFrame([(3.841458820694124, 1)], "s double, d long")
    assert math.isclose(one.select(chi2_sf(F.col("s"), F.col("d")).alias("p")).first()["p"], 0.05, abs_tol=1e-9)


def test_gamma_cdf_special_cases():
    x = np.array([0.1, 1.0, 5.0])
    assert np.allclose(gamma_cdf(1.0, x), 1 - np.exp(-x))
    assert np.allclose(gamma_cdf(0.5, x), [math.erf(math.sqrt(v)) for v in x])


def test_fast_normal_moments(spark):
    row = spark.range(50_000).select(fast_normal(1, F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03
