"""Normal and gamma probabilities as column expressions and DataFrame steps, so they stay inside generated code."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (Hart 1968, algorithm 5666).
HART_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]

# Wichura's AS241 (PPND16) approximation of the normal quantile.
AS241_A = [
    3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
    45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727,
]
AS241_B = [
    1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
    21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610,
]
AS241_C = [
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640,
]
AS241_D = [
    1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
    0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324,
]
AS241_E = [
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
    0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 0.000000201033439929228813265,
]
AS241_F = [
    1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
    0.000786869131145613259100, 0.0000184631831751005468180, 0.000000142151175831644588870, 0.00000000000000204426310338993978564,
]


SUM_TERMS = 1000  # longest sum in a chi-squared probability


def _horner(x: Column, high_first: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), high_first[1:], F.lit(high_first[0]))


def norm_cdf(x: Column) -> Column:
    """P(Z <= x) for a standard normal Z. x occurs often in it: pass a plain column."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2.0)
    near = bell * _horner(a, HART_NUM) / _horner(a, HART_DEN)
    fraction = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + F.lit(0.65)))))
    far = bell / fraction / F.lit(math.sqrt(2.0 * math.pi))
    tail = F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    flip = F.when(x > 0.0, F.lit(1.0)).otherwise(F.lit(0.0))
    return flip + (1.0 - 2.0 * flip) * tail


def add_norm_cdf(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the normal probability of each source column, as {new name: source}."""
    return df.withColumns({out: norm_cdf(F.col(source)) for out, source in columns.items()})


def add_norm_ppf(df: DataFrame, columns: dict[str, str], edge: float = 1e-9) -> DataFrame:
    """Adds the normal quantile of each source column, as {new name: source}.

    Probabilities are clipped to [edge, 1 - edge]. The two arguments of the rational functions
    are columns of their own, so each is computed once per row.
    """
    if not columns:
        return df
    clipped = {f"_p_{out}": F.greatest(F.least(F.col(s), F.lit(1.0 - edge)), F.lit(edge)) for out, s in columns.items()}
    staged = df.withColumns(clipped)
    staged = staged.withColumns(
        {
            **{f"_m_{out}": F.lit(0.180625) - (F.col(f"_p_{out}") - 0.5) * (F.col(f"_p_{out}") - 0.5) for out in columns},
            **{f"_r_{out}": F.sqrt(-F.log(F.least(F.col(f"_p_{out}"), 1.0 - F.col(f"_p_{out}")))) for out in columns},
        }
    )

    def quantile(out):
        q, mid, r = F.col(f"_p_{out}") - 0.5, F.col(f"_m_{out}"), F.col(f"_r_{out}")
        centre = q * _horner(mid, AS241_A[::-1]) / _horner(mid, AS241_B[::-1])
        inner, outer = r - 1.6, r - 5.0
        tail = F.when(r <= 5.0, _horner(inner, AS241_C[::-1]) / _horner(inner, AS241_D[::-1])).otherwise(
            _horner(outer, AS241_E[::-1]) / _horner(outer, AS241_F[::-1])
        )
        return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * tail)

    done = staged.withColumns({out: quantile(out) for out in columns})
    return done.drop(*[f"_{k}_{out}" for out in columns for k in "pmr"])


def chi2_sf(stat: Column, dof: Column) -> Column:
    """P(X > stat) for a chi-squared X with whole degrees of freedom.

    Finite sums in closed form up to a thousand terms, kept as logarithms so that they do not
    underflow. Beyond, where a sum per row would grow with the table, Temme's uniform expansion
    with two terms is exact to better than 1e-7.
    """
    closed = _chi2_sf_sum(stat, F.least(dof, F.lit(2 * SUM_TERMS)))
    a, ratio = dof / 2.0, stat / dof
    off = ratio - 1.0
    eta = F.signum(off) * F.sqrt(2.0 * F.greatest(off - F.log(F.greatest(ratio, F.lit(1e-300))), F.lit(0.0)))
    near = F.abs(off) < 1e-2
    # Its leading coefficient 1 / off - 1 / eta, as a series where both are large.
    series = F.lit(-1 / 3) + eta / 12.0 - eta * eta * F.lit(2 / 135)
    lead = F.when(near, series).otherwise(F.try_divide(F.lit(1.0), off) - F.try_divide(F.lit(1.0), eta))
    expanded = norm_cdf(-eta * F.sqrt(a)) + F.exp(-a * eta * eta / 2.0) / F.sqrt(2.0 * math.pi * a) * lead
    wide = F.greatest(F.least(expanded, F.lit(1.0)), F.lit(0.0))
    return F.when(stat <= 0, F.lit(1.0)).when(dof <= 2 * SUM_TERMS, closed).otherwise(wide)


def _chi2_sf_sum(stat: Column, dof: Column) -> Column:
    half = stat / 2.0
    safe = F.greatest(half, F.lit(1e-300))
    odd = dof % 2 == 1
    terms = F.floor(dof / 2).cast("int")
    # even: sum over k < dof/2 of h^k / k!, odd: sum over k of h^(k+1/2) / Gamma(k+3/2)
    first = F.when(odd, -half + 0.5 * F.log(safe) - F.lit(math.lgamma(1.5))).otherwise(-half)
    shift = F.when(odd, F.lit(1.5)).otherwise(F.lit(1.0))
    summed = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0.0).alias("total"), first.alias("term")),
        lambda acc, k: F.struct(
            (acc["total"] + F.exp(acc["term"])).alias("total"),
            (acc["term"] + F.log(safe) - F.log(k.cast("double") + shift)).alias("term"),
        ),
        lambda acc: acc["total"],
    )
    head = F.when(odd, 2.0 * (1.0 - norm_cdf(F.sqrt(F.greatest(stat, F.lit(0.0)))))).otherwise(F.lit(0.0))
    return F.when(stat <= 0, F.lit(1.0)).otherwise(F.least(head + summed, F.lit(1.0)))


def gamma_cdf(shape: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(shape, x) by its power series.

    Works on a short array: fitting a marginal tabulates it once, rows then interpolate.
    """
    x = np.asarray(x, dtype=float)
    safe = np.maximum(x, 1e-300)
    term = np.full_like(safe, 1.0 / shape)
    total = term.copy()
    for k in range(1, 20_000):
        term = term * safe / (shape + k)
        total += term
        if np.all(term <= 1e-16 * total):
            break
    out = np.exp(-safe + shape * np.log(safe) - math.lgamma(shape)) * total
    return np.where(x <= 0, 0.0, np.clip(out, 0.0, 1.0))
