"""Correlation and contingency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twinframe.functions.special import chi2_sf
from twinframe.operators.rows import align

MAX_CATEGORIES = 10_000  # per column, where a full contingency table is asked for


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are given; null if a column does not vary.

    From covariance and deviations, as the built-in correlation divides by zero on a constant.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.nanvl(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(None))


def correlation_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for every ordered pair of columns; one aggregation over the upper triangle."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    number = lambda c: F.col(c).cast("double")
    row = df.agg(*[correlation(number(a), number(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{k}").alias("corr"))
        for k, (a, b) in enumerate(pairs)
        for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])
    ]
    return row.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def compare_correlation(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, first, second, delta): two correlation matrices side by side."""
    x = correlation_long(first, columns).withColumnRenamed("corr", "first")
    y = correlation_long(second, columns).withColumnRenamed("corr", "second")
    return x.join(y, ["a", "b"]).withColumn("delta", F.col("first") - F.col("second"))


def mean_correlation_change(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Mean over columns of the mean absolute change, diagonal included, undefined cells skipped."""
    change = compare_correlation(first, second, columns).groupBy("b").agg(F.avg(F.abs("delta")).alias("m"))
    return change.agg(F.avg("m").alias("avg_change"))


def aligned_correlation(x: DataFrame, y: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """(column, corr): each column of one table against the same column at the same position of the other."""
    both = align(x.select(row_id, *columns), y.select(row_id, *columns), row_id)
    row = both.agg(*[correlation(F.col(f"x_{c}").cast("double"), F.col(f"y_{c}").cast("double")).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("corr")) for c in columns])
    return row.select(F.explode(cells).alias("e")).select("e.*")


def _cells(x: DataFrame, y: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """(column, x, y, observed) with both marginals; only occupied cells exist."""
    both = align(x.select(row_id, *columns), y.select(row_id, *columns), row_id)
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"x_{c}").cast("string").alias("x"),
                F.col(f"y_{c}").cast("string").alias("y"),
            )
            for c in columns
        ]
    )
    counted = (
        both.select(F.explode(pairs).alias("e"))
        .select("e.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("column", "x", "y")
        .agg(F.count(F.lit(1)).alias("observed"))
    )
    by = lambda *keys: F.sum("observed").over(W.partitionBy("column", *keys))
    return counted.withColumns({"row_total": by("x"), "col_total": by("y")})


def chi2(x: DataFrame, y: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """(column, chi2, p_value, dof) of the contingency table of each column with itself across tables.

    sum (O-E)^2/E equals n (sum O^2/(R C) - 1), so empty cells are never formed. With one degree
    of freedom the continuity correction applies: all four cells deviate by the same amount.
    """
    cells = _cells(x, y, columns, row_id)
    o, r, c = (F.col(k).cast("double") for k in ("observed", "row_total", "col_total"))
    stats = cells.groupBy("column").agg(
        F.sum("observed").cast("double").alias("n"),
        F.sum(o * o / (r * c)).alias("share"),
        F.count_distinct("x").alias("rows"),
        F.count_distinct("y").alias("cols"),
        F.first(F.struct(o.alias("o"), r.alias("r"), c.alias("c"))).alias("cell"),
    )
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    n, o1, r1, c1 = F.col("n"), F.col("cell.o"), F.col("cell.r"), F.col("cell.c")
    deviation = F.greatest(F.abs(o1 - r1 * c1 / n) - 0.5, F.lit(0.0))
    corrected = deviation * deviation * n * n * n / (r1 * (n - r1) * c1 * (n - c1))
    stat = F.when(dof == 0, 0.0).when(dof == 1, corrected).otherwise(n * (F.col("share") - 1))
    scored = stats.select("column", stat.alias("chi2"), dof.cast("long").alias("dof"))
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(chi2_sf(F.col("chi2"), F.col("dof")))
    return scored.withColumn("p_value", p)


def expected_counts(x: DataFrame, y: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """(x, y, observed, expected) for every cell of one contingency table, empty cells included.

    The table is rows times columns by definition; its width is checked before it is laid out.
    """
    cells = _cells(x, y, [column], row_id)
    rows = cells.groupBy("column", "x").agg(F.sum("observed").alias("row_total"))
    cols = cells.groupBy("column").agg(
        F.collect_set(F.struct("y", "col_total")).alias("cols"), F.sum("observed").alias("n")
    )
    checked = F.when(F.size("cols") <= MAX_CATEGORIES, F.col("cols")).otherwise(
        F.raise_error(F.lit(f"{column} has too many categories for a contingency table")).cast(
            "array<struct<y:string,col_total:bigint>>"
        )
    )
    laid_out = (
        rows.join(cols, "column")
        .select("x", "row_total", "n", F.explode(checked).alias("c"))
        .select("x", "c.y", (F.col("row_total") * F.col("c.col_total") / F.col("n")).alias("expected"))
    )
    return laid_out.join(cells.select("x", "y", "observed"), ["x", "y"], "left").select(
        "x", "y", F.coalesce("observed", F.lit(0)).alias("observed"), "expected"
    )


def chi2_score(x: DataFrame, y: DataFrame, cat_features: list[str], row_id: str = "row_id") -> DataFrame:
    for name, df in (("first", x), ("second", y)):
        gone = [c for c in cat_features if c not in df.columns]
        if gone:
            raise ValueError(f"categorical features missing in the {name} table: {gone}")
    return chi2(x, y, cat_features, row_id)


def correlation_report(x: DataFrame, y: DataFrame, cat_features: list[str], row_id: str = "row_id") -> DataFrame:
    """(kind, column, statistic, value): aligned correlations and contingency tests in one table."""
    nums = [c for c in x.columns if c not in cat_features and c != row_id]
    numeric = aligned_correlation(x, y, nums, row_id).select(
        F.lit("numerical").alias("kind"), "column", F.lit("corr").alias("statistic"), F.col("corr").alias("value")
    )
    tests = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in ("chi2", "p_value")])
    categorical = (
        chi2_score(x, y, cat_features, row_id)
        .select(F.lit("categorical").alias("kind"), "column", F.explode(tests).alias("e"))
        .select("kind", "column", "e.statistic", "e.value")
    )
    return numeric.unionByName(categorical)
