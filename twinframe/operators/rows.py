"""Splits, samples, and joins by row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twinframe.functions.hashing import rnd
from twinframe.operators.ordering import dense_index, mark_smallest, smallest_by_hash

BROADCAST_ROWS = 1_000_000  # of an id and a few numbers each


def _share_out(target: str, share: float):
    """Quota of each class for a stratified draw of ceil(n * share) rows.

    Each class gets the floor of its part; the rows still missing go to the classes with the
    largest remainders, ties in class order. One row per class.
    """

    def quotas(counts: DataFrame) -> DataFrame:
        everywhere = W.partitionBy(F.lit(0))
        wanted = F.ceil(F.sum("n").over(everywhere) * F.lit(share))
        exact = F.col("n") * wanted / F.sum("n").over(everywhere)
        floors = counts.select(
            target, F.floor(exact).alias("base"), (exact - F.floor(exact)).alias("rest"), wanted.alias("wanted")
        )
        order = W.partitionBy(F.lit(0)).orderBy(F.desc(F.round("rest", 9)), target)
        missing = F.col("wanted") - F.sum("base").over(everywhere)
        extra = F.when(F.row_number().over(order) <= missing, 1).otherwise(0)
        return floors.select(target, (F.col("base") + extra).alias("quota"))

    return quotas


def mark_holdout(
    df: DataFrame, share: float, seed, row_id: str = "row_id", target: str | None = None, within=None, name: str = "held"
) -> DataFrame:
    """Flags an exact share of the rows by seeded hash, per class when a target is given."""
    quota = _share_out(target, share) if target else lambda n: F.ceil(n * F.lit(share))
    return mark_smallest(df, row_id, seed, quota, [target] if target else None, within, name)


def two_stage_split(
    df: DataFrame,
    target: str,
    task: str,
    test_size: float = 0.2,
    seed: int = 42,
    row_id: str = "row_id",
) -> DataFrame:
    """Test out of all rows, then validation out of the rest; both stages use `test_size`.

    The result is the input with a `split` column: the rows are neither shuffled nor re-read.
    """
    by = target if task == "classification" else None
    tested = mark_holdout(df, test_size, f"{seed}-test", row_id, by, name="_test")
    both = mark_holdout(tested, test_size, f"{seed}-val", row_id, by, within=~F.col("_test"), name="_val")
    split = F.when(F.col("_test"), "test").when(F.col("_val"), "val").otherwise("train")
    return both.select(*df.columns, split.alias("split"))


def two_way_split(
    df: DataFrame, target: str, task: str, test_size: float = 0.2, seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """Train and validation only, for tables whose test rows were set aside before."""
    by = target if task == "classification" else None
    marked = mark_holdout(df, test_size, f"{seed}-val", row_id, by, name="_val")
    return marked.select(*df.columns, F.when(F.col("_val"), "val").otherwise("train").alias("split"))


def split_ids(split: DataFrame, name: str = "test", row_id: str = "row_id") -> DataFrame:
    return split.where(F.col("split") == name).select(row_id)


def exclude_ids(df: DataFrame, ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.join(ids.select(row_id), row_id, "left_anti").select(*df.columns)


def select_ids(df: DataFrame, ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The listed rows, renumbered from 0."""
    kept = df.join(ids.select(row_id), row_id, "left_semi")
    return dense_index(kept, row_id, "row_index")


def attach_columns(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Columns side by side: two tables with the same row ids."""
    return left.join(right, row_id)


def append_rows(first: DataFrame, *others: DataFrame, row_id: str = "row_id") -> DataFrame:
    """All rows under each other; the id becomes unique again by the position of its table."""
    tables = [first, *others]
    parts = len(tables)
    out = None
    for i, part in enumerate(tables):
        numbered = part.withColumn(row_id, F.col(row_id) * parts + i)
        out = numbered if out is None else out.unionByName(numbered)
    return out


def align(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Row k of one table beside row k of the other, by row order; columns prefixed x_ and y_."""
    x = dense_index(left, row_id, "position")
    y = dense_index(right, row_id, "position")
    x = x.select("position", *[F.col(c).alias(f"x_{c}") for c in left.columns])
    y = y.select("position", *[F.col(c).alias(f"y_{c}") for c in right.columns])
    return x.join(y, "position")


def drawn_position(u: Column, n: int) -> Column:
    """The position from 0 to n - 1 that a uniform draw falls on; draws of 52 bits reach every one of 2^52."""
    return F.least(F.floor(u * n), F.lit(n - 1)).cast("long")


def sample_with_replacement(df: DataFrame, k: int, seed, row_id: str = "row_id", draws: int = 1) -> DataFrame:
    """Exactly k rows per draw, each a hashed position of the table.

    Positions are looked up among the ids alone and draws of the same row are counted first,
    so the wide table meets at most one small row per chosen id. Adds `draw` and `slot`;
    draw i depends on (seed, i).
    """
    indexed = dense_index(df.select(row_id), row_id, "_position")
    n = df.count()
    slots = df.sparkSession.range(k * draws).select(
        F.floor(F.col("id") / k).alias("draw"), (F.col("id") % k).alias("slot")
    )
    u = rnd(seed, F.col("draw"), F.col("slot"))
    hits = (
        slots.withColumn("_position", drawn_position(u, n))
        .groupBy("_position")
        .agg(F.collect_list(F.struct("draw", "slot")).alias("_slots"))
    )
    chosen = indexed.join(hits, "_position").select(row_id, "_slots")
    if k * draws <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return (
        df.join(chosen, row_id)
        .withColumn("_slot", F.explode("_slots"))
        .select("_slot.draw", "_slot.slot", *df.columns)
    )


def sample_half(df: DataFrame, seed, row_id: str = "row_id") -> DataFrame:
    """Exactly n // 2 rows without replacement."""
    return smallest_by_hash(df, row_id, seed, lambda n: F.floor(n / 2))
