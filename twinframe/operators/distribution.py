"""Tables behind distribution plots: proportions, counts and kernel densities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twinframe.operators.clean import clean
from twinframe.operators.distance import unpivot
from twinframe.operators.profile import check_compatible

# Grid size, how many bandwidths it reaches beyond the data, and the distance
# (in bandwidths) from which a kernel no longer shows in a double.
GRID, CUT, REACH = 200, 3.0, 8.7


def label_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables under each other with a `dataset` column."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def category_counts(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """(dataset, column, value, n)"""
    long = unpivot(labelled, columns, "string", ["dataset"]).where(F.col("value").isNotNull())
    return long.groupBy("dataset", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def category_proportions(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """(dataset, column, value, proportion), over the non-missing values of a column."""
    share = F.col("n") / F.sum("n").over(W.partitionBy("dataset", "column"))
    return category_counts(labelled, columns).select("dataset", "column", "value", share.alias("proportion"))


def kernel_density(labelled: DataFrame, columns: list[str], points: int = GRID) -> DataFrame:
    """(dataset, column, k, x, density): Gaussian density with Scott's bandwidth on a grid.

    Equal values are counted first. A value is then sent only to the grid points its kernel
    reaches: with many rows the bandwidth shrinks, and that is a handful of points.
    """
    long = unpivot(labelled, columns, "double", ["dataset"]).where(F.col("value").isNotNull())
    keys = ["dataset", "column"]
    spread = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    width = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    start = F.col("lo") - CUT * F.col("bw")
    params = (
        spread.withColumn("bw", width)
        .where(F.col("bw") > 0)
        .select(*keys, "n", "bw", start.alias("start"), ((F.col("hi") + CUT * F.col("bw") - start) / (points - 1)).alias("step"))
    )
    # One row per dataset and column.
    params = F.broadcast(params)
    weighted = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("w")).join(params, keys)
    place = (F.col("value") - F.col("start")) / F.col("step")
    reach = REACH * F.col("bw") / F.col("step")
    first = F.greatest(F.ceil(place - reach), F.lit(0)).cast("long")
    last = F.least(F.floor(place + reach), F.lit(points - 1)).cast("long")
    hits = weighted.withColumn("k", F.explode(F.sequence(first, last)))
    z = (F.col("start") + F.col("k") * F.col("step") - F.col("value")) / F.col("bw")
    sums = hits.groupBy(*keys, "k").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("total"))
    grid = params.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    density = F.coalesce("total", F.lit(0.0)) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return grid.join(sums, [*keys, "k"], "left").select(
        *keys, "k", (F.col("start") + F.col("k") * F.col("step")).alias("x"), density.alias("density")
    )


def compare_distributions(
    real: DataFrame, synthetic: dict[str, DataFrame], num_cols: list[str], cat_cols: list[str], row_id: str = "row_id"
) -> DataFrame:
    """Real and every synthetic table, cleaned and schema-checked, as one long plot table.

    (dataset, column, kind, point, value): proportions of categories, densities of numbers.
    """
    for table in synthetic.values():
        check_compatible(real, table)
    cleaned = {name: clean(df.select(*real.columns), row_id, reindex=False) for name, df in {"real": real, **synthetic}.items()}
    labelled = label_tables(cleaned)
    bars = category_proportions(labelled, cat_cols).select(
        "dataset", "column", F.lit("proportion").alias("kind"), F.col("value").alias("point"), F.col("proportion").alias("value")
    )
    curves = kernel_density(labelled, num_cols).select(
        "dataset", "column", F.lit("density").alias("kind"), F.col("k").cast("string").alias("point"), F.col("density").alias("value")
    )
    return bars.unionByName(curves)
