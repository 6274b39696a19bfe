"""Codecs that turn rows into generator input and back: dummy blocks and fixed-width bits."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from twinframe.operators.encode import (
    ONE_HOT_LIMIT,
    Scaler,
    categories,
    category_lists,
    fit_scaler,
    ordinal_decode,
    ordinal_encode,
)
from twinframe.operators.ordering import as_small, ranks_within

# Numbers are coded in 32 bits, and "_" in a category is written "#".
NUMBER_BITS = 32
SEPARATOR, STAND_IN = "_", "#"


# ---- generator input


def fit_generator_scaler(df: DataFrame, columns: list[str], transformation: str | None = "standardize") -> Scaler:
    """Stored shift and scale for standardize or min_max; None leaves the numbers as they are."""
    if transformation is None:
        return Scaler({c: 0.0 for c in columns}, {c: 1.0 for c in columns})
    return fit_scaler(df, columns, {"standardize": "standard", "min_max": "minmax"}[transformation])


def generator_input(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: scaler.transform(c) for c in scaler.shift})


def generator_output(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: scaler.inverse(c) for c in scaler.shift})


def type_output(df: DataFrame, integer: list[str], continuous: list[str]) -> DataFrame:
    """Integer columns rounded half to even and cast to int, continuous ones cast to float."""
    return df.withColumns(
        {
            **{c: F.bround(c).cast("int") for c in integer},
            **{c: F.col(c).cast("float") for c in continuous},
        }
    )


# ---- dummy blocks


@dataclass(frozen=True)
class DummyCodec:
    """Categories as blocks of 0/1 places; each place is known by its (column, value) pair."""

    columns: tuple[str, ...]
    cat_columns: tuple[str, ...]
    levels: dict[str, list[str]]

    @property
    def cont_columns(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.cat_columns)

    @property
    def places(self) -> list[tuple[str, str]]:
        return [(c, v) for c in self.cat_columns for v in self.levels[c]]

    def names(self) -> list[str]:
        return [f"{c}{SEPARATOR}{v}" for c, v in self.places]

    def end_indices(self) -> list[int]:
        ends, at = [], 0
        for c in self.cat_columns:
            at += len(self.levels[c])
            ends.append(at)
        return ends

    def block(self) -> Column:
        """The 0/1 array of a row, all blocks behind each other."""
        return F.concat(*[_flags(F.array(*[F.lit(v) for v in self.levels[c]]), stand_in(c)) for c in self.cat_columns])

    def _winner(self, soft: str, i: int) -> Column:
        """1-based place of the first maximum within block i."""
        ends = [0, *self.end_indices()]
        part = F.slice(F.col(soft), ends[i] + 1, ends[i + 1] - ends[i])
        return F.array_position(part, F.array_max(part)).cast("int")

    def harden(self, soft: str) -> Column:
        """Soft scores to a 0/1 array: per block, the first maximum wins."""
        places = lambda c: F.sequence(F.lit(1), F.lit(len(self.levels[c])))
        return F.concat(*[_flags(places(c), self._winner(soft, i)) for i, c in enumerate(self.cat_columns)])

    def decode(self, df: DataFrame, soft: str, row_id: str = "row_id") -> DataFrame:
        """Categories of the winning places beside the continuous columns, in the original order."""
        picked = {
            c: F.replace(
                F.element_at(F.array(*[F.lit(v) for v in self.levels[c]]), self._winner(soft, i)),
                F.lit(STAND_IN),
                F.lit(SEPARATOR),
            ).alias(c)
            for i, c in enumerate(self.cat_columns)
        }
        return df.select(row_id, *[picked.get(c, F.col(c)) for c in self.columns])


def _flags(options: Column, hit: Column) -> Column:
    return F.transform(options, lambda v: F.when(v == hit, 1.0).otherwise(0.0))


def stand_in(c: str) -> Column:
    return F.replace(F.col(c).cast("string"), F.lit(SEPARATOR), F.lit(STAND_IN))


def fit_dummies(df: DataFrame, cat_columns: list[str], row_id: str = "row_id") -> DummyCodec:
    """Sorted categories per column, after the separator has been replaced."""
    renamed = df.select(*[stand_in(c).alias(c) for c in cat_columns])
    levels = category_lists(categories(renamed, cat_columns), cat_columns)
    return DummyCodec(tuple(c for c in df.columns if c != row_id), tuple(cat_columns), levels)


def dummies(df: DataFrame, codec: DummyCodec, row_id: str = "row_id") -> DataFrame:
    return df.select(row_id, *codec.cont_columns, codec.block().alias("onehot"))


def block_ends(df: DataFrame, cat_columns: list[str]) -> DataFrame:
    """(column, width, end): cumulated width of the one-hot blocks, in column order."""
    sizes = categories(df, cat_columns).groupBy("column").agg(F.count(F.lit(1)).alias("width"))
    place = F.array_position(F.array(*[F.lit(c) for c in cat_columns]), F.col("column"))
    # One row per column of the table.
    running = W.partitionBy(F.lit(0)).orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    return sizes.withColumn("place", place).select("column", "width", F.sum("width").over(running).alias("end"))


def _shares(weights: list[float]) -> list[float]:
    """Shares of a total times their number; zeros lifted to the smallest positive share."""
    total = sum(weights)
    if total <= 0:  # nothing varies, so nothing weighs more
        return [1.0] * len(weights)
    scaled = [w / total * len(weights) for w in weights]
    smallest = min(w for w in scaled if w > 0)
    return [w if w > 0 else smallest for w in scaled]


def column_importance(df: DataFrame, columns: list[str], cat_columns: list[str]) -> dict[str, float]:
    """Weight per column: share of the summed deviations for numbers, 1 for categories."""
    nums = [c for c in columns if c not in cat_columns]
    weights = {c: 1.0 for c in columns}
    if nums:
        row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in nums]).first()
        weights.update(zip(nums, _shares([row[c] for c in nums])))
    return weights


def encoded_importance(df: DataFrame, codec: DummyCodec, weights: dict[str, float] | None = None) -> list[tuple[str, float]]:
    """Weight per encoded column: continuous ones first, then every dummy place.

    Without given weights the dummies are weighted by their own deviations and everything is
    scaled to sum to the number of encoded columns; given weights pass to all places of a column.
    """
    if weights is not None:
        return [(c, weights[c]) for c in codec.cont_columns] + [
            (f"{c}{SEPARATOR}{v}", weights[c]) for c, v in codec.places
        ]
    numbers = column_importance(df, list(codec.columns), list(codec.cat_columns))
    counts = categories_with_counts(df, list(codec.cat_columns))
    total = df.count()
    spread = {(r["column"], r["value"]): math.sqrt(r["n"] / total * (1 - r["n"] / total)) for r in counts.collect()}
    dummy = _shares([spread.get(p, 0.0) for p in codec.places])
    raw = [numbers[c] for c in codec.cont_columns] + dummy
    scale = len(raw) / (sum(raw) or 1.0)
    names = [*codec.cont_columns, *codec.names()]
    return [(n, w * scale) for n, w in zip(names, raw)]


def categories_with_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), stand_in(c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("n"))


def row_weights(df: DataFrame, weight: str | None = None, name: str = "weight") -> DataFrame:
    """Weights that sum to 1; 1/n each when no weight column is given."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    total = df.agg(F.sum(w).alias("total")).first()["total"]
    return df.withColumn(name, w / F.lit(total))


# ---- fixed-width bits


@dataclass(frozen=True)
class BitCodec:
    """Every row as one string of bits: numbers in 32, categories in as many as they need."""

    columns: tuple[str, ...]
    low: dict[str, float]
    high: dict[str, float]
    sizes: dict[str, int]
    codes: DataFrame
    types: dict[str, T.DataType]

    @property
    def numbers(self) -> list[str]:
        return [c for c in self.columns if c in self.low]

    @property
    def cats(self) -> list[str]:
        return [c for c in self.columns if c not in self.low]

    @property
    def row_size(self) -> int:
        return sum(self.sizes.values())

    def encode(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        """One string of 0 and 1 per column; a category the codec has not seen gives null."""
        coded = ordinal_encode(df, self.cats, self.codes, unknown=None) if self.cats else df
        bits = {}
        for c in self.columns:
            if c in self.low:
                width = self.high[c] - self.low[c]
                part = (F.col(c).cast("double") - F.lit(self.low[c])) / F.lit(width) if width else F.lit(0.0)
                part = F.greatest(F.least(part, F.lit(1.0)), F.lit(0.0))  # a value outside the fitted range counts as its end
                whole = (part * F.lit(float(2**NUMBER_BITS - 1))).cast("long")
            else:
                whole = F.col(c)
            bits[c] = F.lpad(F.bin(whole), self.sizes[c], "0")
        return coded.select(row_id, *[bits[c].alias(c) for c in self.columns])

    def decode(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        """Bits back to numbers and categories; a code without a category gives null."""
        numbers = {
            c: F.conv(F.col(c), 2, 10).cast("double")
            / F.lit(float(2**NUMBER_BITS - 1))
            * F.lit(self.high[c] - self.low[c])
            + F.lit(self.low[c])
            for c in self.numbers
        }
        codes = {c: F.conv(F.col(c), 2, 10).cast("long") for c in self.cats}
        opened = df.select(row_id, *[(numbers.get(c) if c in numbers else codes[c]).alias(c) for c in self.columns])
        return ordinal_decode(opened, self.cats, self.codes) if self.cats else opened

    def join_bits(self, encoded: DataFrame, row_id: str = "row_id") -> DataFrame:
        return encoded.select(row_id, F.concat(*self.columns).alias("bits"))

    def split_bits(self, joined: DataFrame, row_id: str = "row_id") -> DataFrame:
        parts, at = [], 1
        for c in self.columns:
            parts.append(F.substring("bits", at, self.sizes[c]).alias(c))
            at += self.sizes[c]
        return joined.select(row_id, *parts)


def first_seen_codes(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """(column, value, code): codes in the order in which values first appear."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, code long")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    seen = (
        df.select(row_id, F.explode(cells).alias("e"))
        .where(F.col("e.value").isNotNull())
        .groupBy("e.column", "e.value")
        .agg(F.min(row_id).alias("_first"))
    )
    return ranks_within(seen, "column", "_first", "code").select("column", "value", "code")


def fit_bits(df: DataFrame, num_columns: list[str], cat_columns: list[str], row_id: str = "row_id") -> BitCodec:
    columns = tuple(c for c in df.columns if c in (*num_columns, *cat_columns))
    types = {f.name: f.dataType for f in df.schema}
    for c in num_columns:
        if not isinstance(types[c], T.NumericType):
            raise ValueError(f"column {c!r} must be numeric")
    row = (
        df.agg(
            *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in num_columns],
            *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in num_columns],
        ).first()
        if num_columns
        else {}
    )
    codes = as_small(first_seen_codes(df, cat_columns, row_id), ONE_HOT_LIMIT)
    counts = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits = lambda k: max(1, math.ceil(math.log2(k))) if k > 1 else 1
    return BitCodec(
        columns,
        {c: row[f"lo_{c}"] for c in num_columns},
        {c: row[f"hi_{c}"] for c in num_columns},
        {c: NUMBER_BITS if c in num_columns else bits(counts.get(c, 1)) for c in columns},
        codes,
        types,
    )


@dataclass(frozen=True)
class LabelCodec:
    """Class labels as sorted codes, or a regression target scaled to [0, 1]."""

    column: str
    task: str
    codes: DataFrame | None
    scaler: Scaler

    @property
    def n_classes(self) -> int:
        if self.task != "classification":
            raise ValueError("only a classification has classes")
        return self.codes.count()

    def transform(self, df: DataFrame) -> DataFrame:
        if self.task == "regression":
            return df.withColumn(self.column, self.scaler.transform(self.column))
        coded = ordinal_encode(df, [self.column], self.codes, unknown=None)
        unseen = F.raise_error(F.lit(f"label of {self.column} was not seen while fitting"))
        return coded.withColumn(self.column, F.coalesce(F.col(self.column), unseen.cast("long")))

    def inverse(self, df: DataFrame) -> DataFrame:
        if self.task == "regression":
            return df.withColumn(self.column, self.scaler.inverse(self.column))
        return ordinal_decode(df, [self.column], self.codes)


def fit_label(df: DataFrame, column: str, task: str) -> LabelCodec:
    if task == "classification":
        return LabelCodec(column, task, as_small(categories(df, [column])), Scaler({}, {}))
    return LabelCodec(column, task, None, fit_scaler(df, [column], "minmax"))
