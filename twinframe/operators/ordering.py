"""Global order without a global window.

A cumulative sum over a whole table in one window runs in one task. Here each group is cut
into quantile buckets, the bucket totals (a few rows for each shuffle partition) are accumulated, and the rows
are accumulated inside their bucket only. Results are exact for any bucket bounds; the bounds
decide only how evenly the work is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twinframe.functions.hashing import rnd
from twinframe.session import written

LEAST_BUCKETS = 128
HASH_BUCKETS = 65536


def as_small(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """Fitted state as a local table, marked for broadcast, if it has at most `limit` rows.

    A larger table comes back unchanged and without a hint, so that joins with it shuffle.
    """
    rows = df.take(limit + 1)
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def count_below(bounds: Column, value: Column, size: int) -> Column:
    """How many of at most `size` ascending bounds lie below the value: a binary search."""
    steps = [2**k for k in range(size.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at),
    )


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a group: four for each shuffle partition, so that they follow the size of the cluster."""
    return max(LEAST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _with_buckets(df: DataFrame, key: str, groups: list[str], buckets: int) -> DataFrame:
    probs = [i / buckets for i in range(1, buckets)]
    # One row per group (an unpivoted column, a dataset label): small by construction.
    bounds = df.groupBy(*groups).agg(F.percentile_approx(key, probs, F.lit(max(10_000, 10 * buckets))).alias("_bounds"))
    placed = df.join(F.broadcast(bounds), groups)
    return placed.withColumn("_bucket", count_below(F.col("_bounds"), F.col(key), buckets)).drop("_bounds")


def running_totals(
    df: DataFrame,
    key: str,
    weights: list[str],
    groups: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Adds `cum_<w>` (inclusive) and `all_<w>` for each weight, and `next_<key>`, per group.

    `key` must be unique within a group: aggregate by value first. That also removes hot
    values, so a value shared by a third of all rows is one row here.
    """
    groups = list(groups or [])
    buckets = buckets or bucket_count(df.sparkSession)
    group_key = groups or ["_g"]
    if not groups:
        df = df.withColumn("_g", F.lit(0))
    placed = _with_buckets(df, key, group_key, buckets)
    per_bucket = placed.groupBy(*group_key, "_bucket").agg(
        F.min(key).alias("_low"), *[F.sum(w).alias(f"_s_{w}") for w in weights]
    )
    order = W.partitionBy(*group_key).orderBy("_bucket")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group_key)
    offsets = per_bucket.select(
        *group_key,
        "_bucket",
        F.lead("_low").over(order).alias("_next_low"),
        *[F.coalesce(F.sum(f"_s_{w}").over(earlier), F.lit(0)).alias(f"_before_{w}") for w in weights],
        *[F.sum(f"_s_{w}").over(whole).alias(f"all_{w}") for w in weights],
    )
    inside = W.partitionBy(*group_key, "_bucket").orderBy(key)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    # At most `buckets` rows of a few numbers per group; groups are columns, labels or draws.
    out = placed.join(F.broadcast(offsets), [*group_key, "_bucket"])
    out = out.withColumns(
        {
            **{f"cum_{w}": F.col(f"_before_{w}") + F.sum(w).over(upto) for w in weights},
            f"next_{key}": F.coalesce(F.lead(key).over(inside), F.col("_next_low")),
        }
    )
    return out.drop("_bucket", "_next_low", *[f"_before_{w}" for w in weights], *([] if groups else ["_g"]))


def dense_index(df: DataFrame, key: str, name: str = "row_index", buckets: int | None = None) -> DataFrame:
    """0-based position of each row in the order of a unique key."""
    counted = running_totals(df.withColumn("_w", F.lit(1).cast("long")), key, ["_w"], buckets=buckets)
    return counted.withColumn(name, F.col("cum__w") - 1).drop("_w", "cum__w", "all__w", f"next_{key}")


def ranks_within(df: DataFrame, group: str, key: str, name: str, limit: int = 10_000) -> DataFrame:
    """0-based rank of `key`, of any ordered type, within its group; (group, key) must be unique.

    A table of at most `limit` rows is ranked where it is. A larger one is dealt out by ranges of
    (group, key) and written, so that its ranges are fixed; rows are ranked in their range, and only
    the counts of the ranges (a row for each range and group) are accumulated in one place.
    """
    rows = df.take(limit + 1)
    if len(rows) <= limit:
        local = df.sparkSession.createDataFrame(rows, df.schema)
        return local.withColumn(name, (F.row_number().over(W.partitionBy(group).orderBy(key)) - 1).cast("long"))
    ranged = written(df.repartitionByRange(group, key).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = (
        ranged.groupBy(group, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy(group, "_range").orderBy(key)) - 1
    ranked = ranged.withColumn("_inside", inside).join(as_small(before, 100_000), [group, "_range"])
    return written(ranked.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name)), "ranks")


def look_up(
    df: DataFrame, key: Column, table: DataFrame, name: str, hot_share: int = 10_000, limit: int = 10_000, often: DataFrame | None = None
) -> DataFrame:
    """The rows with column `name`: what `table` (unique k, v) holds for the key, null if nothing.

    A table of at most `limit` rows is sent to the rows. For a larger one the rows are shuffled by key, but for those
    of a frequent key: of keys held by more than one row in `hot_share` there are fewer than
    `hot_share`, so their entries are sent. Rows that need no other entry, or have a null key, are spread by
    their contents, and no task gets all rows of a key. `often` names the frequent keys (column _k, fewer
    than `hot_share` rows) where they are known without counting.
    """
    small = as_small(table, limit)
    if small is not table:
        found = small.select(F.col("k").alias("_k"), F.col("v").alias(name))
        return df.withColumn("_key", key).join(found, F.col("_key") == F.col("_k"), "left").drop("_key", "_k")
    if often is None:
        counts = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        often = counts.where(F.col("_k").isNotNull() & (F.col("_n") * hot_share > F.lit(df.count()))).select("_k")
    hot = often.join(table, F.col("_k") == F.col("k"), "left").select(F.col("_k").alias("_hot"), F.col("v").alias("_hot_v"))
    hot = as_small(hot, hot_share)
    settled = F.col("_hot").isNotNull() | F.col("_key").isNull()
    spread = F.when(settled, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))).otherwise(0)
    # Entries may be long arrays: only the keys go through the shuffle, those of frequent keys are put in behind it.
    rows = df.withColumn("_key", key).join(hot.select("_hot"), F.col("_key") == F.col("_hot"), "left").withColumn("_spread", spread)
    rest = table.select(F.col("k").alias("_k"), F.col("v").alias("_v"), F.lit(0).cast("long").alias("_at"))
    joined = rows.join(rest, (F.col("_spread") == F.col("_at")) & (F.col("_key") == F.col("_k")), "left")
    entries = hot.select(F.col("_hot").alias("_hot_k"), "_hot_v")
    joined = joined.join(entries, F.col("_hot") == F.col("_hot_k"), "left")
    value = F.when(F.col("_hot").isNotNull(), F.col("_hot_v")).otherwise(F.col("_v"))
    return joined.select(*df.columns, value.alias(name))


def _last_chosen(draws: DataFrame, quotas: DataFrame, key: list[str]) -> DataFrame:
    """Per stratum, the last (_r, _id) among the `quota` smallest draws.

    A histogram of the hash finds the bucket that holds it, and only that bucket (1/65536 of a
    stratum) is ranked: the rows of the table are neither sorted nor moved.
    """
    order = W.partitionBy(*key).orderBy("_bucket")
    edge = (
        draws.groupBy(*key, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(order))
        .join(quotas, key)
        .where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(*key, "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_take"))
    )
    rank = F.row_number().over(W.partitionBy(*key).orderBy("_r", "_id"))
    return (
        draws.join(as_small(edge), [*key, "_bucket"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_take"))
        .select(*key, F.col("_r").alias("_last_r"), F.col("_id").alias("_last_id"))
    )


def mark_smallest(
    df: DataFrame, id_col: str, seed, quota, strata: list[str] | None = None, within: Column | None = None, name: str = "chosen"
) -> DataFrame:
    """Flags exactly `quota` rows (per stratum): those with the smallest (rnd(seed, id), id).

    `quota` turns a row count into a number of rows; with strata it turns the table of class
    counts (strata columns, n) into one with `quota`. `within` limits the draw to some rows.
    Finding the cut-off reads the ids only; marking is then a projection over the wide rows.
    """
    key = list(strata or []) or ["_g"]
    pool = df if within is None else df.where(within)
    if not strata:
        pool = pool.withColumn("_g", F.lit(0))
    draws = pool.select(*key, F.col(id_col).alias("_id"), rnd(seed, F.col(id_col)).alias("_r")).withColumn(
        "_bucket", F.floor(F.col("_r") * HASH_BUCKETS)
    )
    counts = draws.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    quotas = quota(counts) if strata else counts.select("_g", quota(F.col("n")).alias("quota"))
    last = _last_chosen(draws, quotas, key)
    r = rnd(seed, F.col(id_col))
    below = lambda last_r, last_id: (r < last_r) | ((r == last_r) & (F.col(id_col) <= last_id))
    if strata:
        marked = df.join(as_small(last), key, "left")
        flag = F.coalesce(below(F.col("_last_r"), F.col("_last_id")), F.lit(False))
    else:
        cut = last.first()
        marked = df
        flag = below(F.lit(cut["_last_r"]), F.lit(cut["_last_id"])) if cut else F.lit(False)
    if within is not None:
        flag = flag & within
    return marked.select(*df.columns, flag.alias(name))


def smallest_by_hash(df: DataFrame, id_col: str, seed, quota, strata: list[str] | None = None) -> DataFrame:
    """Exactly the `quota` rows (per stratum) with the smallest (rnd(seed, id), id)."""
    return mark_smallest(df, id_col, seed, quota, strata, name="_chosen").where("_chosen").drop("_chosen")


def any_null(columns: list[str], df: DataFrame) -> Column:
    """True where any listed column is null, or NaN in a floating-point column."""
    types = dict(df.dtypes)
    checks = [
        F.col(c).isNull() | F.isnan(c) if types[c] in ("double", "float") else F.col(c).isNull() for c in columns
    ]
    out = F.lit(False)
    for check in checks:
        out = out | check
    return out
