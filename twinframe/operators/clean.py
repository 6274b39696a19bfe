"""Missing values, duplicates and column selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.operators.ordering import any_null, dense_index


def drop_nulls(df: DataFrame) -> DataFrame:
    return df.where(~any_null(df.columns, df))


def drop_duplicates(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row per distinct content, keeping the smallest row id.

    The minimum is combined on the map side, so any number of copies of one row leaves each
    task as a single row.
    """
    content = [c for c in df.columns if c != row_id]
    return df.groupBy(*content).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def clean(df: DataFrame, row_id: str = "row_id", reindex: bool = True) -> DataFrame:
    """Drop incomplete rows, then duplicates, then renumber from 0 in row order."""
    kept = drop_duplicates(drop_nulls(df), row_id)
    if not reindex:
        return kept
    return dense_index(kept, row_id, "_new").drop(row_id).withColumnRenamed("_new", row_id).select(*df.columns)


def fill_missing(
    df: DataFrame, num_cols: list[str], cat_cols: list[str], dropna: bool = False, fillna: bool = True
) -> DataFrame:
    """Drop incomplete rows, or fill numbers with the mean and categories with the mode.

    The mode of a tie is its smallest value. Modes come from grouped counts, so that a column
    with many values does not build up in one aggregation buffer.
    """
    if dropna and fillna:
        raise ValueError("dropna and fillna exclude each other")
    if dropna:
        return drop_nulls(df)
    if not fillna:
        return df
    fills = fill_values(df, num_cols, cat_cols)
    out = df
    if num_cols:
        means = fills[0]
        out = out.select(
            *[
                F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(means[c])).alias(c)
                if c in num_cols and means[c] is not None
                else F.col(c)
                for c in df.columns
            ]
        )
    modes = {c: v for c, v in fills[1].items() if v is not None}
    return out.fillna(modes) if modes else out


def fill_values(df: DataFrame, num_cols: list[str], cat_cols: list[str]) -> tuple[dict, dict]:
    """Mean per numeric and mode per categorical column, as values on the driver."""
    types = dict(df.dtypes)
    as_number = lambda c: F.nanvl(F.col(c), F.lit(None)) if types[c] in ("double", "float") else F.col(c)
    means = df.agg(*[F.avg(as_number(c)).alias(c) for c in num_cols]).first().asDict() if num_cols else {}
    modes = {}
    for c in cat_cols:
        top = (
            df.where(F.col(c).isNotNull())
            .groupBy(c)
            .count()
            .agg(F.min_by(F.col(c), F.struct(-F.col("count"), F.col(c))).alias("mode"))
            .first()
        )
        modes[c] = top["mode"]
    return means, modes


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def split_target(df: DataFrame, target: str, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Features and target, both keyed by row id so they can be put together again."""
    return df.drop(target), df.select(row_id, target)


def same_order(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """The synthetic table with its columns in the order of the real one."""
    return synthetic.select(*real.columns)


def same_types(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """The synthetic table cast to the real column types; what does not parse becomes null."""
    types = {f.name: f.dataType for f in real.schema}
    return synthetic.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in synthetic.columns])


def cast_failures(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(column, n_failed): synthetic values lost by the cast to the real type."""
    types = {f.name: f.dataType for f in real.schema}
    shared = [c for c in synthetic.columns if c in types]
    counted = synthetic.agg(
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(types[c]).isNull()).alias(c) for c in shared]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_failed")) for c in shared])
    return counted.select(F.explode(cells).alias("cell")).select("cell.*")
