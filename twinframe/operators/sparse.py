"""One-hot encodings without a limit on the categories.

A row holds the places of its ones, not the block; the categories stay a table (column, value, code)
that is joined by value, and the driver knows one width per column. Places equal those of the dense
forms in `encode` and `codec`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.operators.codec import SEPARATOR, STAND_IN, categories_with_counts, column_importance, stand_in
from twinframe.operators.encode import ONE_HOT_LIMIT, Scaler, categories, fit_scaler, ordinal_decode, ordinal_encode
from twinframe.operators.ordering import look_up
from twinframe.session import written


@dataclass(frozen=True)
class Blocks:
    """The one-hot blocks of some category columns, one behind the other."""

    columns: tuple[str, ...]
    widths: dict[str, int]
    codes: DataFrame

    @property
    def width(self) -> int:
        return sum(self.widths.values())

    def start(self, column: str) -> int:
        """Place at which the block of a column begins."""
        before = self.columns[: self.columns.index(column)]
        return sum(self.widths[c] for c in before)

    def places(self, df: DataFrame, name: str = "places") -> DataFrame:
        """Adds the place of the one in each block; null for a missing or unseen category."""
        helpers = {f"_c{i}": F.col(c).cast("string") for i, c in enumerate(self.columns)}
        out = df
        for (helper, value), c in zip(helpers.items(), self.columns):
            entries = self.codes.where(F.col("column") == c).select(F.col("value").alias("k"), F.col("code").alias("v"))
            out = look_up(out, value, entries, helper)
        at = [F.col(helper) + self.start(c) for helper, c in zip(helpers, self.columns)]
        return out.withColumn(name, F.array(*at).cast("array<bigint>")).drop(*helpers)

    def winners(self, soft: str) -> Column:
        """Places of the first maximum of each block of an array of scores."""
        best = []
        for c in self.columns:
            part = F.slice(F.col(soft), self.start(c) + 1, self.widths[c])
            best.append(F.array_position(part, F.array_max(part)) - 1 + self.start(c))
        return F.array(*best).cast("array<bigint>")

    def decode(self, df: DataFrame, places: str = "places") -> DataFrame:
        """The category columns in place of the places; a null place gives null."""
        coded = df.withColumns({c: F.get(places, F.lit(i)) - self.start(c) for i, c in enumerate(self.columns)})
        return ordinal_decode(coded, list(self.columns), self.codes).drop(places)


def fit_blocks(df: DataFrame, columns: list[str], rename: bool = False) -> Blocks:
    """Sorted categories of each column; with `rename` after the separator of dummies is replaced.

    A column without any value has a block of width 0.
    """
    if rename:
        df = df.select(*[stand_in(c).alias(c) for c in columns])
    codes = categories(df, list(columns))
    found = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Blocks(tuple(columns), {c: found.get(c, 0) for c in columns}, codes)


# ---- generator input


def sparse_dummies(df: DataFrame, blocks: Blocks, row_id: str = "row_id") -> DataFrame:
    """Dummies of a table by places: (row_id, continuous columns, places)."""
    others = [c for c in df.columns if c not in (row_id, *blocks.columns)]
    renamed = df.withColumns({c: stand_in(c) for c in blocks.columns})
    return blocks.places(renamed).select(row_id, *others, "places")


def sparse_categories(df: DataFrame, blocks: Blocks) -> DataFrame:
    """Places of dummies back to categories, the separator put back."""
    back = lambda c: F.replace(F.col(c), F.lit(STAND_IN), F.lit(SEPARATOR))
    return blocks.decode(df).withColumns({c: back(c) for c in blocks.columns})


def place_weights(df: DataFrame, columns: list[str], cat_columns: list[str]) -> DataFrame:
    """(name, weight) of all encoded columns: importance of numbers, deviation of each dummy.

    Weights of dummies without a spread are lifted to the smallest positive one, and all weights
    are scaled to sum to their number.
    """
    numbers = column_importance(df, columns, cat_columns)
    total = df.count()
    share = F.col("n") / F.lit(total)
    name = F.concat("column", F.lit(SEPARATOR), "value")
    spread = categories_with_counts(df, cat_columns).where(F.col("value").isNotNull())
    spread = spread.select(name.alias("name"), F.sqrt(share * (1 - share)).alias("s"))
    sums = spread.agg(F.sum("s").alias("all"), F.count("s").alias("k"), F.min(F.when(F.col("s") > 0, F.col("s"))).alias("low"))
    lifted = F.when(F.col("all") > 0, F.greatest("s", "low") * F.col("k") / F.col("all")).otherwise(1.0)
    # One row of sums.
    dummy = spread.join(F.broadcast(sums)).select("name", lifted.alias("weight"))
    plain = [(c, float(w)) for c, w in numbers.items() if c not in cat_columns]
    raw = dummy.unionByName(df.sparkSession.createDataFrame(plain, "name string, weight double"))
    scale = raw.agg((F.count("weight") / F.sum("weight")).alias("scale"))
    return raw.join(F.broadcast(scale)).select("name", (F.col("weight") * F.col("scale")).alias("weight"))


# ---- model features


@dataclass(frozen=True)
class SparseEncoder:
    """Scaled numbers followed by one-hot blocks as sparse vectors, with the label of a regression or class codes."""

    scaler: Scaler
    blocks: Blocks
    target: str
    target_scaler: Scaler | None
    classes: DataFrame | None

    @property
    def width(self) -> int:
        return len(self.scaler.shift) + self.blocks.width

    def transform(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        """(row_id, features, label). An unseen category gives zeros, an unseen class -1; numbers must not be null."""
        if self.classes is None:
            labelled = df.withColumn("_label", self.target_scaler.transform(self.target))
        else:
            labelled = df.withColumn("_label", F.col(self.target))
            labelled = ordinal_encode(labelled, ["_label"], self.classes.withColumn("column", F.lit("_label")))
        numbers = {f"_n{i}": self.scaler.transform(c) for i, c in enumerate(self.scaler.shift)}
        placed = self.blocks.places(labelled, "_places")
        if self.width > ONE_HOT_LIMIT:
            return self._undescribed(placed, list(numbers.values()), row_id)
        codes = {}
        for i, c in enumerate(self.blocks.columns):
            width = self.blocks.widths[c]
            if width:  # a code equal to the width stands for "none of them"
                code = F.coalesce(F.get("_places", F.lit(i)) - self.blocks.start(c), F.lit(width)).cast("double")
                codes[f"_k{i}"] = code.alias(f"_k{i}", metadata={"ml_attr": {"type": "nominal", "num_vals": width}})
        rows = placed.select(
            F.col(row_id), F.col("_label").cast("double").alias("label"), *[v.alias(k) for k, v in numbers.items()], *codes.values()
        )
        hot = [k.replace("_k", "_h") for k in codes]
        if codes:
            encoder = OneHotEncoder(inputCols=list(codes), outputCols=hot, handleInvalid="keep", dropLast=True)
            rows = encoder.fit(rows).transform(rows)
        assembled = VectorAssembler(inputCols=[*numbers, *hot], outputCol="features").transform(rows)
        return assembled.select(row_id, "features", "label")

    def _undescribed(self, placed: DataFrame, numbers: list[Column], row_id: str) -> DataFrame:
        """The vectors as Spark stores them, written and read back.

        `OneHotEncoder` and `VectorAssembler` describe every place of a vector in the schema, which the driver holds.
        """
        cell = lambda place, value: F.struct(place.cast("int").alias("place"), value.alias("value"))
        known = lambda x: F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(F.raise_error(F.lit("a number of the features is null or NaN")))
        first = F.array(*[cell(F.lit(i), known(x)) for i, x in enumerate(numbers)]).cast("array<struct<place:int,value:double>>")
        ones = F.transform(F.filter("_places", lambda p: p.isNotNull()), lambda p: cell(p + len(numbers), F.lit(1.0)))
        rows = placed.withColumn("_cells", F.filter(F.concat(first, ones), lambda c: c["value"] != 0))
        vector = F.struct(
            F.lit(0).cast("byte").alias("type"),
            F.lit(self.width).alias("size"),
            F.col("_cells.place").alias("indices"),
            F.col("_cells.value").alias("values"),
        )
        rows = rows.select(F.col(row_id), vector.alias("features"), F.col("_label").cast("double").alias("label"))
        schema = T.StructType([rows.schema[row_id], T.StructField("features", VectorUDT()), rows.schema["label"]])
        return written(rows, "vectors", schema)


def fit_sparse_features(df: DataFrame, num_features: list[str], cat_features: list[str], target: str, task: str) -> SparseEncoder:
    """Scalers, category tables and class codes fitted on one table; ridge, logistic and forests take the vectors."""
    regression = task == "regression"
    return SparseEncoder(
        fit_scaler(df, list(num_features)),
        fit_blocks(df, list(cat_features)),
        target,
        fit_scaler(df, [target]) if regression else None,
        None if regression else categories(df, [target]),
    )
