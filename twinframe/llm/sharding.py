"""Sharding by jump consistent hashing.

A key jumps from shard to shard, each jump drawn from a hash of the key and the shard it stands on;
the last shard below the count is its own. Adding a shard only adds a possible last jump, so keys
move into the new shard or stay. Built from column expressions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.shared import stash

SEED = 9
#: Rows of one input partition numbered together are 2 to this power at most.
BLOCK_BITS = 16


def jumps(key: Column, shards: int, seed: int = SEED) -> Column:
    """Struct (shard, grown): the key's shard among `shards`, and among one more.

    From shard b the key goes to floor((b + 1) / u) with u uniform in (0, 1) from hash(key, b): the
    chance to stay below n is 1 - (b + 1) / n, as each of n shards needs an equal part.
    """

    def uniform(b: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, b), 11)
        return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))

    def state(before: Column, last: Column, ahead: Column) -> Column:
        return F.struct(before.alias("before"), last.alias("last"), ahead.alias("ahead"))

    def step(s: Column, _: Column) -> Column:
        onward = F.floor((s["ahead"] + 1) / uniform(s["ahead"]))
        return F.when(s["ahead"] <= shards, state(s["last"], s["ahead"], onward)).otherwise(s)

    start = state(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit(0).cast("long"))
    # At most one jump a shard, and one more for the added shard.
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.aggregate(
        F.array(walked),
        F.struct(F.lit(0).alias("shard"), F.lit(0).alias("grown")),
        lambda _, s: F.struct(
            F.when(s["last"] == shards, s["before"]).otherwise(s["last"]).cast("int").alias("shard"),
            s["last"].cast("int").alias("grown"),
        ),
    )


def shard(docs: DataFrame, shards: int, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) of every row.

    The id and the shard count decide; null ids share one shard. A null text has no bytes, so its
    size is 8 and its checksum that of the empty text. Slots are gapless from 0 in each shard and
    follow the order of the input; repeated rows get slots of their own.

    Rows are numbered in blocks of one input partition each, so neither a large shard nor a key
    that fills a third of the table makes a large group; only the counts of blocks are summed up.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            jumps(F.col(id_col), shards, seed).alias("to"),
            F.monotonically_increasing_id().alias("place"),
        ).select("id", "size", "text_crc32", "to.shard", F.col("to.grown").alias("grown_shard"), "place"),
        "sharded",
    ).withColumn("block", F.shiftright("place", BLOCK_BITS))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("place")) - 1
    return (
        rows.withColumn("within", within)
        .join(starts, ["shard", "block"])
        .select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).alias("slot"), "grown_shard")
    )
