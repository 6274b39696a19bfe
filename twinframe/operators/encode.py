"""Scaling and encoding: state is fitted on one table, then applied to any other.

Fitted numbers are plain values (one row of aggregates). Fitted categories are a small table
(column, value, code); tables beyond a size limit are joined by shuffle instead of broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.special import add_norm_ppf
from twinframe.operators.ordering import as_small, look_up, ranks_within, running_totals
from twinframe.session import spread

# Most categories one column may have in a dense one-hot array.
ONE_HOT_LIMIT = 10_000
TASK_BYTES = 16 << 20  # of encoded features in one task


@dataclass(frozen=True)
class Scaler:
    """x -> (x - shift) / scale per column."""

    shift: dict[str, float]
    scale: dict[str, float]

    def transform(self, c: str) -> Column:
        return (F.col(c).cast("double") - F.lit(self.shift[c])) / F.lit(self.scale[c])

    def inverse(self, c: str) -> Column:
        return F.col(c) * F.lit(self.scale[c]) + F.lit(self.shift[c])


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "standard") -> Scaler:
    """Mean and population deviation, or minimum and range; a constant column gets scale 1."""
    if kind == "standard":
        shift, width = F.avg, F.stddev_pop
    elif kind == "minmax":
        shift, width = F.min, lambda c: F.max(c) - F.min(c)
    else:
        raise ValueError(f"scaler must be standard or minmax, not {kind!r}")
    if not columns:
        return Scaler({}, {})
    row = df.agg(
        *[shift(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(columns)],
        *[width(F.col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    at = lambda p, i, default: float(row[f"{p}{i}"]) if row[f"{p}{i}"] else default
    return Scaler(
        {c: at("a", i, 0.0) for i, c in enumerate(columns)},
        {c: at("b", i, 1.0) for i, c in enumerate(columns)},
    )


def scale(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: scaler.transform(c) for c in scaler.shift})


def normalise(df: DataFrame, num_features: list[str], scaler: str = "standard") -> DataFrame:
    """Numbers scaled and moved to the front, all other columns unchanged behind them."""
    fitted = fit_scaler(df, num_features, scaler)
    others = [c for c in df.columns if c not in num_features]
    return df.select(*[fitted.transform(c).alias(c) for c in num_features], *others)


# ---- categories


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): sorted distinct non-null values of each column, coded from 0.

    The columns are unpivoted and counted in one shuffle; copies of a value collapse on the
    map side, and codes are ranked within a column over distinct values only, by ranges if they are many.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    distinct = df.select(F.explode(cells).alias("e")).select("e.*").where(F.col("value").isNotNull()).distinct()
    return ranks_within(distinct, "column", "value", "code")


def ordinal_encode(
    df: DataFrame, columns: list[str], codes: DataFrame, unknown: int | None = -1, keep_null: bool = False
) -> DataFrame:
    """Category codes; unseen values get `unknown`. With keep_null, missing cells stay missing."""
    out = df
    for c in columns:
        entries = codes.where(F.col("column") == c).select(F.col("value").alias("k"), F.col("code").alias("v"))
        out = look_up(out, F.col(c).cast("string"), entries, "_code")
        coded = F.coalesce("_code", F.lit(unknown).cast("long")) if unknown is not None else F.col("_code")
        if keep_null:
            coded = F.when(F.col(c).isNotNull(), coded)
        out = out.withColumn(c, coded).drop("_code")
    return out.select(*df.columns)


def ordinal_decode(df: DataFrame, columns: list[str], codes: DataFrame) -> DataFrame:
    """Codes back to categories; the code is cut to a whole number first, unknown codes give null."""
    out = df
    for c in columns:
        entries = codes.where(F.col("column") == c).select(F.col("code").alias("k"), F.col("value").alias("v"))
        out = look_up(out, F.col(c).cast("long"), entries, "_value")
        out = out.withColumn(c, F.col("_value")).drop("_value")
    return out.select(*df.columns)


@dataclass(frozen=True)
class TableCoder:
    """Ordinal coder of a whole table: numbers pass, categories and a class label are coded."""

    num_features: tuple[str, ...]
    cat_features: tuple[str, ...]
    label: str
    task: str
    codes: DataFrame

    @property
    def coded(self) -> list[str]:
        return [*self.cat_features, *([self.label] if self.task == "classification" else [])]

    @property
    def order(self) -> list[str]:
        return [*self.num_features, *self.cat_features, self.label]

    def transform(self, df: DataFrame, keep_null: bool = False, row_id: str = "row_id") -> DataFrame:
        return ordinal_encode(df, self.coded, self.codes, keep_null=keep_null).select(row_id, *self.order)

    def inverse(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        return ordinal_decode(df, self.coded, self.codes).select(row_id, *self.order)


def fit_table_coder(df: DataFrame, cat_features: list[str], label: str, task: str, row_id: str = "row_id") -> TableCoder:
    nums = tuple(c for c in df.columns if c not in cat_features and c not in (label, row_id))
    coded = [*cat_features, *([label] if task == "classification" else [])]
    return TableCoder(nums, tuple(cat_features), label, task, as_small(categories(df, coded)))


# ---- one-hot and assembled features


def category_lists(codes: DataFrame, columns: list[str], limit: int = ONE_HOT_LIMIT) -> dict[str, list[str]]:
    """Sorted categories per column on the driver; the size is checked first."""
    rows = codes.where(F.col("column").isin(columns)).take(limit * max(len(columns), 1) + 1)
    out: dict[str, list] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: r["code"]):
        out[r["column"]].append(r["value"])
    too_long = [c for c, v in out.items() if len(v) > limit]
    if too_long:
        raise ValueError(f"too many categories for one-hot arrays: {too_long}")
    return out


def one_hot(c: str, values: list[str]) -> Column:
    """0/1 array over the fitted categories; an unseen value gives all zeros."""
    text = F.col(c).cast("string")
    return F.transform(F.array(*[F.lit(v) for v in values]), lambda v: F.when(text == v, 1.0).otherwise(0.0))


@dataclass(frozen=True)
class FeatureEncoder:
    """Scaled numbers followed by one-hot blocks; every other column is dropped."""

    scaler: Scaler
    levels: dict[str, list[str]]
    target: str
    task: str
    target_scaler: Scaler
    classes: tuple[str, ...]

    @property
    def width(self) -> int:
        return len(self.scaler.shift) + sum(len(v) for v in self.levels.values())

    def features(self) -> Column:
        nums = F.array(*[self.scaler.transform(c) for c in self.scaler.shift]).cast("array<double>")
        return F.concat(nums, *[one_hot(c, v) for c, v in self.levels.items()])

    def label(self) -> Column:
        if self.task == "regression":
            return self.target_scaler.transform(self.target)
        position = F.array_position(F.array(*[F.lit(v) for v in self.classes]), F.col(self.target).cast("string"))
        return position.cast("double") - 1.0

    def spread(self, df: DataFrame) -> DataFrame:
        """The rows in tasks of about TASK_BYTES of features each; a table of fewer stays as it is.

        Narrow rows of a few files become rows of a number for each category, and all that follows
        would run in as few tasks as there are files.
        """
        tasks = math.ceil(df.count() * self.width * 8 / TASK_BYTES)
        return spread(df, tasks) if tasks > 1 else df

    def transform(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        return self.spread(df).select(row_id, self.features().alias("features"), self.label().alias("label"))


def fit_features(
    df: DataFrame, num_features: list[str], cat_features: list[str], target: str, task: str
) -> FeatureEncoder:
    discrete = [*cat_features, *([target] if task == "classification" else [])]
    levels = category_lists(categories(df, discrete), discrete) if discrete else {}
    return FeatureEncoder(
        fit_scaler(df, list(num_features)),
        {c: levels[c] for c in cat_features},
        target,
        task,
        fit_scaler(df, [target]) if task == "regression" else Scaler({}, {}),
        tuple(levels[target]) if task == "classification" else (),
    )


# ---- joint numeric matrix for distances


@dataclass(frozen=True)
class JointEncoder:
    """Min-max numbers and one-hot categories fitted on the real table, in column order."""

    columns: tuple[str, ...]
    scaler: Scaler
    levels: dict[str, list[str]]
    types: dict[str, T.DataType]

    def typed(self, df: DataFrame) -> DataFrame:
        """The columns cast to the types of the real table, so that a category 3.0 is the category 3."""
        return df.select(*[F.col(c).try_cast(self.types[c]).alias(c) if c in self.types else F.col(c) for c in df.columns])

    @property
    def n_features(self) -> int:
        return len(self.columns)

    def dense(self) -> Column:
        blocks = [
            one_hot(c, self.levels[c]) if c in self.levels else F.array(self.scaler.transform(c))
            for c in self.columns
        ]
        return F.concat(*blocks)

    def numbers(self) -> Column:
        nums = [c for c in self.columns if c not in self.levels]
        return F.array(*[self.scaler.transform(c) for c in nums]).cast("array<double>")

    def codes(self) -> Column:
        """One code per category column in place of its one-hot block; -1 for an unseen value."""
        code = lambda c: F.array_position(
            F.array(*[F.lit(v) for v in self.levels[c]]), F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
        )
        return F.array(*[(code(c) - 1).cast("double") for c in self.columns if c in self.levels]).cast("array<double>")


def fit_joint(real: DataFrame, discrete: list[str], row_id: str = "row_id") -> JointEncoder:
    columns = tuple(c for c in real.columns if c != row_id)
    cats = [c for c in columns if c in discrete]
    nums = [c for c in columns if c not in discrete]
    levels = category_lists(categories(real, cats), cats) if cats else {}
    types = {f.name: f.dataType for f in real.schema if f.name in columns}
    return JointEncoder(columns, fit_scaler(real, nums, "minmax"), levels, types)


# ---- quantile transform


def exact_quantiles(df: DataFrame, column: str, n_quantiles: int) -> DataFrame:
    """(k, quantile) for k = 0..n-1: linearly interpolated order statistics of a whole column.

    Works on distinct values with their counts: each value knows which ranks it covers, so the
    grid points that fall on it are computed without sorting the rows in one place.
    """
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts, "x", ["n"])
    total, step = F.col("all_n"), F.lit(float(n_quantiles - 1))
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    # grid positions k * (N - 1) / (n_quantiles - 1) whose whole part lies in [first, last]
    low = F.ceil(first * step / F.greatest(total - 1, F.lit(1)) - 1e-9)
    high = F.least(F.ceil((last + 1) * step / F.greatest(total - 1, F.lit(1)) - 1e-9) - 1, step)
    spread = placed.where(low <= high).withColumn(
        "k", F.explode(F.sequence(low.cast("long"), high.cast("long")))
    )
    position = F.col("k") * (total - 1) / step
    part = F.greatest(position - F.floor(position + 1e-9), F.lit(0.0))
    beyond = F.when(F.floor(position + 1e-9) + 1 <= last, F.col("x")).otherwise(F.coalesce("next_x", "x"))
    return spread.select("k", (F.col("x") + part * (beyond - F.col("x"))).alias("quantile"))


def quantile_count(n: int) -> int:
    return max(min(n // 30, 1000), 10)


def quantile_to_normal(df: DataFrame, column: str, grid: np.ndarray, out: str) -> DataFrame:
    """Place of each value on the fitted quantile grid, mapped to the normal distribution.

    Ties on the grid are resolved by averaging the lowest and the highest matching place. The
    grid has at most 1,000 points.
    """
    probs = np.linspace(0.0, 1.0, len(grid))

    @F.pandas_udf(T.DoubleType())
    def place(x: pd.Series) -> pd.Series:
        values = x.to_numpy(dtype=float)
        up = np.interp(values, grid, probs)
        down = np.interp(-values, -grid[::-1], -probs[::-1])
        return pd.Series(np.where(np.isnan(values), np.nan, 0.5 * (up - down)))

    placed = df.withColumn("_place", place(F.col(column).cast("double")))
    # Fixed value: places are clipped this far inside (0, 1) before the normal quantile.
    return add_norm_ppf(placed, {out: "_place"}, edge=1e-7).drop("_place")


def fit_quantile_grid(df: DataFrame, column: str) -> np.ndarray:
    n = quantile_count(df.count())
    rows = exact_quantiles(df, column, n).orderBy("k").collect()
    return np.array([r["quantile"] for r in rows])
