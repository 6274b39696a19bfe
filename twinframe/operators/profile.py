"""Profiling: shape, missing values, semantic types, task and schema checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.operators.ordering import any_null

# Thresholds of the semantic type rules.
CATEGORICAL_SHARE = 10  # whole numbers: distinct <= min(round(N / 10), 10)
CATEGORICAL_MAX = 10
STRING_SHARE = 5  # strings: distinct <= round(N / 5)


@dataclass(frozen=True)
class Metadata:
    """What every later step needs to know about a dataset."""

    num_features: tuple[str, ...]
    cat_features: tuple[str, ...]
    target_column: str
    task: str
    N: int
    d: int
    missing_percentage: float
    test_size: float = 0.2
    random_state: int = 42

    @property
    def discrete_columns(self) -> tuple[str, ...]:
        """Columns compared by equality: categorical features, plus the target of a classification."""
        extra = (self.target_column,) if self.task == "classification" else ()
        return self.cat_features + extra

    @property
    def numeric_columns(self) -> tuple[str, ...]:
        extra = (self.target_column,) if self.task == "regression" else ()
        return self.num_features + extra

    def as_row(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_row(cls, row) -> "Metadata":
        values = row.asDict() if hasattr(row, "asDict") else dict(row)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


METADATA_SCHEMA = (
    "num_features array<string>, cat_features array<string>, target_column string, task string, "
    "N long, d long, missing_percentage double, test_size double, random_state long"
)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("N")).withColumn("d", F.lit(len(df.columns)).cast("long"))


def missing_percentage(df: DataFrame) -> DataFrame:
    """Share of rows with any missing value, in percent."""
    hit = F.when(any_null(df.columns, df), 1.0).otherwise(0.0)
    return df.agg((F.avg(hit) * 100).alias("missing_percentage"))


def _profile_exprs(field: T.StructField) -> list[Column]:
    c, name = F.col(field.name), field.name
    exprs = [F.count_distinct(c).alias(f"{name}::distinct")]
    if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
        exprs.append(F.coalesce(F.bool_and(c == F.floor(c)), F.lit(False)).alias(f"{name}::whole"))
        exprs.append(F.min(c).cast("double").alias(f"{name}::low"))
    elif isinstance(field.dataType, T.IntegralType):
        exprs.append(F.lit(True).alias(f"{name}::whole"))
        exprs.append(F.min(c).cast("double").alias(f"{name}::low"))
    else:
        exprs.append(F.lit(False).alias(f"{name}::whole"))
        exprs.append(F.lit(None).cast("double").alias(f"{name}::low"))
    return exprs


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    return "text"


def semantic_types(df: DataFrame) -> DataFrame:
    """(position, column, sdtype, n_distinct) for every column, from one aggregation."""
    stats = df.agg(F.count(F.lit(1)).alias("::N"), *[e for f in df.schema for e in _profile_exprs(f)])
    entries = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(_kind(f.dataType)).alias("kind"),
                F.col(f"`{f.name}::distinct`").alias("n_distinct"),
                F.col(f"`{f.name}::whole`").alias("whole"),
                F.col(f"`{f.name}::low`").alias("low"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    long = stats.select(F.col("`::N`").alias("N"), F.explode(entries).alias("e")).select("N", "e.*")
    few = F.least(F.bround(F.col("N") / CATEGORICAL_SHARE), F.lit(CATEGORICAL_MAX))
    sdtype = (
        F.when(F.col("kind") == "time", "datetime")
        .when(F.col("kind") == "boolean", "categorical")
        .when(
            (F.col("kind") == "number") & F.col("whole") & (F.col("low") >= 0) & (F.col("n_distinct") <= few),
            "categorical",
        )
        .when((F.col("kind") == "number") & F.col("whole") & (F.col("n_distinct") == F.col("N")), "id")
        .when(F.col("kind") == "number", "numerical")
        .when(F.col("n_distinct") == F.col("N"), "id")
        .when(F.col("n_distinct") <= F.bround(F.col("N") / STRING_SHARE), "categorical")
        .otherwise("unknown")
    )
    return long.select("position", "column", sdtype.alias("sdtype"), "n_distinct")


def feature_lists(types: DataFrame, target: str) -> DataFrame:
    """(role, position, column): numerical and categorical features in column order, target left out."""
    return types.where((F.col("column") != target) & F.col("sdtype").isin("numerical", "categorical")).select(
        F.when(F.col("sdtype") == "numerical", "num_features").otherwise("cat_features").alias("role"),
        "position",
        "column",
    )


def infer_task(types: DataFrame, target: str) -> DataFrame:
    return types.where(F.col("column") == target).select(
        F.col("column").alias("target_column"),
        F.when(F.col("sdtype") == "numerical", "regression").otherwise("classification").alias("task"),
    )


def describe(df: DataFrame, target: str, **extra) -> Metadata:
    """The metadata record of a dataset; its rows stay on the cluster, one row per column comes back."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    types = semantic_types(df).orderBy("position").collect()
    summary = (
        df.agg(
            F.count(F.lit(1)).alias("N"),
            F.avg(F.when(any_null(df.columns, df), 1.0).otherwise(0.0)).alias("missing"),
        )
    ).first()
    pick = lambda kind: tuple(r["column"] for r in types if r["sdtype"] == kind and r["column"] != target)
    target_type = next(r["sdtype"] for r in types if r["column"] == target)
    return Metadata(
        num_features=pick("numerical"),
        cat_features=pick("categorical"),
        target_column=target,
        task="regression" if target_type == "numerical" else "classification",
        N=summary["N"],
        d=len(df.columns),
        missing_percentage=(summary["missing"] or 0.0) * 100,
        **extra,
    )


def metadata_frame(df: DataFrame, meta: Metadata) -> DataFrame:
    return df.sparkSession.createDataFrame([meta.as_row()], METADATA_SCHEMA)


def null_positions(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, column, is_null): the table behind a missing-value plot."""
    columns = [c for c in df.columns if c != row_id]
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), any_null([c], df).alias("is_null")) for c in columns]
    )
    return df.select(row_id, F.explode(cells).alias("cell")).select(row_id, "cell.*")


def null_counts(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Missing values per column, in one pass without unpivoting the rows."""
    columns = [c for c in df.columns if c != row_id]
    counted = df.agg(
        F.count(F.lit(1)).alias("::N"),
        *[F.count_if(any_null([c], df)).alias(c) for c in columns],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])
    return counted.select(F.explode(cells).alias("cell"), F.col("`::N`").alias("n_rows")).select(
        "cell.*", "n_rows"
    )


def check_compatible(real: DataFrame, synthetic: DataFrame) -> None:
    """Same number of columns, then the same names in any order, repeated names counted."""
    if len(real.columns) != len(synthetic.columns):
        raise ValueError("real and synthetic tables differ in their number of columns")
    if sorted(real.columns) != sorted(synthetic.columns):
        raise ValueError("real and synthetic tables differ in their column names")


def has_nulls(df: DataFrame) -> DataFrame:
    """One row: does any cell of the table miss its value? Stops at the first hit per partition."""
    hit = df.where(any_null(df.columns, df)).select(F.lit(1).alias("x")).limit(1)
    return hit.agg((F.count("x") > 0).alias("has_nulls"))


def require_no_nulls(df: DataFrame) -> DataFrame:
    if has_nulls(df).first()["has_nulls"]:
        raise ValueError("the table has missing values")
    return df


def numeric_kinds(df: DataFrame) -> DataFrame:
    """(column, kind): integer or continuous, for each numeric column; read off the schema."""
    rows = [
        (f.name, "integer" if isinstance(f.dataType, T.IntegralType) else "continuous")
        for f in df.schema
        if isinstance(f.dataType, T.NumericType)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")
