"""Distances between two tables that need no pair of rows to be formed.

The Gower cost is a sum over columns, so its mean over all pairs splits into one-dimensional
parts. Each part follows from the two cumulative distributions of a column: the work is one
shuffle of distinct values, not rows times rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.operators.ordering import running_totals
from twinframe.operators.rows import align

MAX_TERMS = 20_000  # monomials of the kernel expansion, per row and in the result


def unpivot(df: DataFrame, columns: list[str], as_type: str = "double", extra: list[str] | None = None) -> DataFrame:
    """(extra..., column, value) rows of the listed columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value")) for c in columns])
    return df.select(*(extra or []), F.explode(cells).alias("_e")).select(*(extra or []), "_e.column", "_e.value")


def two_sided_counts(
    real: DataFrame,
    synthetic: DataFrame,
    columns: list[str],
    as_type: str = "double",
    real_weight: str | None = None,
    synthetic_weight: str | None = None,
) -> DataFrame:
    """(column, value, r, s): weight of each distinct value on both sides; combined on the map side."""
    whole = F.lit(1).cast("long")

    def side(df, weight, name, other):
        w = F.col(weight).cast("double") if weight else whole
        zero = (F.lit(0.0) if weight else F.lit(0).cast("long")).alias(other)
        return unpivot(df.withColumn(name, w), columns, as_type, [name]).withColumn(other, zero)

    both = side(real, real_weight, "r", "s").unionByName(side(synthetic, synthetic_weight, "s", "r"))
    return both.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))


def cumulative(real: DataFrame, synthetic: DataFrame, columns: list[str], **weights) -> DataFrame:
    """Both empirical distribution functions at every distinct value, and the gap to the next one."""
    counts = two_sided_counts(real, synthetic, columns, **weights)
    placed = running_totals(counts, "value", ["r", "s"], groups=["column"])
    return placed.select(
        "column",
        "value",
        (F.col("cum_r") / F.col("all_r")).alias("fr"),
        (F.col("cum_s") / F.col("all_s")).alias("fs"),
        F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0)).alias("gap"),
    )


def wasserstein_1d(
    real: DataFrame,
    synthetic: DataFrame,
    columns: list[str],
    real_weight: str | None = None,
    synthetic_weight: str | None = None,
) -> DataFrame:
    """(column, wasserstein): exact order-1 distance of each numeric column, optionally weighted."""
    table = cumulative(real, synthetic, columns, real_weight=real_weight, synthetic_weight=synthetic_weight)
    return table.groupBy("column").agg(F.sum(F.abs(F.col("fr") - F.col("fs")) * F.col("gap")).alias("wasserstein"))


def _category_shares(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    counts = two_sided_counts(real, synthetic, columns, as_type="string")
    totals = counts.groupBy("column").agg(F.sum("r").alias("_all_r"), F.sum("s").alias("_all_s"))
    # One row per column of the table.
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", (F.col("r") / F.col("_all_r")).alias("p"), (F.col("s") / F.col("_all_s")).alias("q")
    )


def gower_by_column(real: DataFrame, synthetic: DataFrame, num_cols: list[str], cat_cols: list[str]) -> DataFrame:
    """(column, mean_gower, lower_transport): per column, over all pairs and over the best coupling.

    mean_gower is E|x-y| / range or P(x != y). lower_transport is the one-dimensional transport
    cost in the same units: their mean is a lower bound of the joint transport cost.
    """
    parts = []
    if num_cols:
        f, g = F.col("fr"), F.col("fs")
        table = cumulative(real, synthetic, num_cols)
        width = F.sum("gap")
        scaled = lambda total: F.when(width > 0, F.sum(total * F.col("gap")) / width).otherwise(F.lit(0.0))
        parts.append(
            table.groupBy("column").agg(
                scaled(f * (1 - g) + g * (1 - f)).alias("mean_gower"), scaled(F.abs(f - g)).alias("lower_transport")
            )
        )
    if cat_cols:
        shares = _category_shares(real, synthetic, cat_cols)
        parts.append(
            shares.groupBy("column").agg(
                (1 - F.sum(F.col("p") * F.col("q"))).alias("mean_gower"),
                (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("lower_transport"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mean_gower(real: DataFrame, synthetic: DataFrame, num_cols: list[str], cat_cols: list[str]) -> DataFrame:
    """Mean Gower distance over all pairs of rows, in closed form."""
    by_column = gower_by_column(real, synthetic, num_cols, cat_cols)
    return by_column.agg(F.avg("mean_gower").alias("mean_gower"))


def gower_row_means(
    real: DataFrame, synthetic: DataFrame, num_cols: list[str], cat_cols: list[str], row_id: str = "row_id"
) -> DataFrame:
    """(row_id, mean_gower): mean of each row of the distance matrix, without the matrix.

    For a number x: E|x - Y| = x (2 G(x) - 1) + mean(Y) - 2 E[Y; Y <= x], read off the running
    totals of the synthetic side at x. For a category: 1 - share on the synthetic side.
    """
    d = len(num_cols) + len(cat_cols)
    pieces = []
    if num_cols:
        counts = two_sided_counts(real, synthetic, num_cols).withColumn("sv", F.col("s") * F.col("value"))
        placed = running_totals(counts, "value", ["s", "sv"], groups=["column"])
        ends = counts.groupBy("column").agg((F.max("value") - F.min("value")).alias("_width"))
        x, g = F.col("value"), F.col("cum_s") / F.col("all_s")
        mean_gap = x * (2 * g - 1) + (F.col("all_sv") - 2 * F.col("cum_sv")) / F.col("all_s")
        at_value = placed.join(F.broadcast(ends), "column").select(
            "column", "value", F.when(F.col("_width") > 0, mean_gap / F.col("_width")).otherwise(0.0).alias("part")
        )
        pieces.append(unpivot(real, num_cols, "double", [row_id]).join(at_value, ["column", "value"]))
    if cat_cols:
        shares = _category_shares(real, synthetic, cat_cols).select("column", "value", (1 - F.col("q")).alias("part"))
        pieces.append(unpivot(real, cat_cols, "string", [row_id]).join(shares, ["column", "value"]))
    long = pieces[0].select(row_id, "part")
    for piece in pieces[1:]:
        long = long.unionByName(piece.select(row_id, "part"))
    return long.groupBy(row_id).agg((F.sum("part") / d).alias("mean_gower"))


def ranges(tables: list[DataFrame], columns: list[str]) -> dict[str, float]:
    """max - min of each numeric column over all given tables."""
    if not columns:
        return {}
    both = tables[0].select(*columns)
    for t in tables[1:]:
        both = both.unionByName(t.select(*columns))
    row = both.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def gower_expr(x: str, y: str, num_cols: list[str], cat_cols: list[str], width: dict[str, float]) -> Column:
    """Gower distance of two rows whose columns carry the prefixes x and y."""
    parts = [
        F.abs(F.col(f"{x}{c}").cast("double") - F.col(f"{y}{c}").cast("double")) / F.lit(width[c])
        if width[c]
        else F.lit(0.0)
        for c in num_cols
    ] + [F.when(F.col(f"{x}{c}").eqNullSafe(F.col(f"{y}{c}")), 0.0).otherwise(1.0) for c in cat_cols]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total / len(parts)


def gower_aligned(
    real: DataFrame, synthetic: DataFrame, num_cols: list[str], cat_cols: list[str], row_id: str = "row_id"
) -> DataFrame:
    """(position, x_row_id, y_row_id, gower): distance of the rows at the same position."""
    width = ranges([real, synthetic], num_cols)
    both = align(real, synthetic, row_id)
    return both.select(
        "position", f"x_{row_id}", f"y_{row_id}", gower_expr("x_", "y_", num_cols, cat_cols, width).alias("gower")
    )


# ---- kernel two-sample statistic


def _expansion(dims: int, reach: float, gamma: float, tolerance: float) -> tuple[np.ndarray, float]:
    """Exponents of all monomials needed, and the bound of what is left out.

    exp(2 gamma x.y) is its power series; with |x|, |y| <= reach the terms beyond degree K are
    at most sum over k > K of (2 gamma reach^2)^k / k!.
    """
    t = 2.0 * gamma * reach**2
    degree, term = 0, 1.0
    while True:
        left = term * math.exp(t) * t / (degree + 1)
        if 4 * left <= tolerance:
            break
        degree += 1
        term *= t / degree
        if math.comb(dims + degree, degree) > MAX_TERMS:
            raise ValueError("too many terms: use mmd_rbf_features for many columns or a sharp kernel")
    exponents = [
        np.bincount(np.array(combo, dtype=int), minlength=dims) if combo else np.zeros(dims, dtype=int)
        for k in range(degree + 1)
        for combo in itertools.combinations_with_replacement(range(dims), k)
    ]
    return np.array(exponents), 4 * left


def _feature_means(tagged: DataFrame, features) -> DataFrame:
    """(term, real, synthetic): mean of each feature on both sides; partial sums leave the tasks."""

    def partial(batches):
        totals: dict[bool, np.ndarray] = {}
        sizes: dict[bool, int] = {}
        for batch in batches:
            for is_real, part in batch.groupby("is_real"):
                x = np.stack(part["x"].to_numpy())
                for start in range(0, len(x), 256):
                    block = features(x[start : start + 256]).sum(axis=0)
                    totals[is_real] = totals.get(is_real, 0.0) + block
                sizes[is_real] = sizes.get(is_real, 0) + len(x)
        for is_real, total in totals.items():
            yield pd.DataFrame({"is_real": is_real, "term": np.arange(len(total)), "total": total, "n": sizes[is_real]})

    sums = tagged.mapInPandas(partial, "is_real boolean, term long, total double, n long")
    mean = lambda side: F.sum(F.when(F.col("is_real") == side, F.col("total"))) / F.sum(
        F.when(F.col("is_real") == side, F.col("n"))
    )
    return sums.groupBy("term").agg(mean(True).alias("real"), mean(False).alias("synthetic"))


def _tagged(real: DataFrame, synthetic: DataFrame, vector: str) -> DataFrame:
    as_side = lambda df, flag: df.select(F.lit(flag).alias("is_real"), F.col(vector).cast("array<double>").alias("x"))
    return as_side(real, True).unionByName(as_side(synthetic, False))


def mmd_rbf(real: DataFrame, synthetic: DataFrame, vector: str, gamma: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """Biased MMD with kernel exp(-gamma |x-y|^2), all pairs included, in one pass over the rows.

    The kernel is expanded around the middle of the data into products of monomials, so each
    side is summed up on its own; the neglected rest is bounded by `tolerance`.
    """
    both = _tagged(real, synthetic, vector)
    dims = len(real.select(vector).first()[0])
    ends = both.agg(
        *[F.min(F.col("x")[i]).alias(f"lo{i}") for i in range(dims)],
        *[F.max(F.col("x")[i]).alias(f"hi{i}") for i in range(dims)],
    ).first()
    low = np.array([ends[f"lo{i}"] for i in range(dims)])
    high = np.array([ends[f"hi{i}"] for i in range(dims)])
    centre, reach = (low + high) / 2, float(np.sqrt((((high - low) / 2) ** 2).sum()))
    exponents, error = _expansion(dims, reach, gamma, tolerance)
    degree = int(exponents.max())
    logs = np.array(
        [0.5 * (e.sum() * math.log(2 * gamma) - sum(math.lgamma(k + 1) for k in e)) for e in exponents]
    )
    factors = np.exp(logs)

    def features(x):
        z = x - centre
        powers = z[:, :, None] ** np.arange(degree + 1)
        out = np.exp(-gamma * (z**2).sum(axis=1))[:, None] * factors
        for i in range(dims):
            out = out * powers[:, i, exponents[:, i]]
        return out

    means = _feature_means(both, features)
    return means.agg(
        F.sum(F.pow(F.col("real") - F.col("synthetic"), F.lit(2))).alias("mmd"), F.lit(error).alias("error_bound")
    )


def mmd_rbf_features(
    real: DataFrame, synthetic: DataFrame, vector: str, gamma: float = 1.0, n_features: int = 4096, seed: int = 0
) -> DataFrame:
    """The same statistic for many dimensions by random Fourier features (Rahimi and Recht 2007).

    Every row is used; the result is an unbiased estimate of the kernel sums, and its standard
    error over the random features is reported beside it.
    """
    both = _tagged(real, synthetic, vector)
    dims = len(real.select(vector).first()[0])
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(scale=math.sqrt(2 * gamma), size=(dims, n_features))

    def features(x):
        angle = x @ frequencies
        return np.hstack([np.cos(angle), np.sin(angle)])

    means = _feature_means(both, features)
    squares = means.groupBy((F.col("term") % n_features).alias("k")).agg(
        F.sum(F.pow(F.col("real") - F.col("synthetic"), F.lit(2))).alias("part")
    )
    return squares.agg(
        F.avg("part").alias("mmd"), (F.stddev_samp("part") / math.sqrt(n_features)).alias("standard_error")
    )
