"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets in words are cut into equal blocks. The blocks go to the sources by highest quotients, then
each source's blocks go to its shards alike, and every shard takes its quota as a seeded run of
blocks over its documents in hashed order. Built from column expressions alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.shared import WORD, keeps_names, stash

#: Words in a block. Quotas are whole blocks, so a source ends within half a block of its target.
BLOCK_WORDS = 8
#: Words in a shard of a source, about; documents add a few words each, so that empty ones spread too.
SHARD_WORDS = 1 << 20
ROW_WORDS = 64
SEED = 5


def word_count(column: Column) -> Column:
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("long")


def targets(totals: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Adds `target` to (source, source_size): sources share `share` of all words by weight.

    Weights repeat over the sources by code point, null last. A target stops at `most` times its
    source; the excess is shared again by weight until none is above. Sorted by size over weight the
    sources that stop come first, so the final level is that of the first one that does not.
    The rows are one for each source.
    """
    everything = Window.partitionBy(F.lit(0))
    named = everything.orderBy(F.col("source").asc_nulls_last())
    rows = totals.withColumn("place", F.row_number().over(named)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)
    )
    rows = rows.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    filling = everything.orderBy(F.col("bound") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    rows = rows.withColumn(
        "level", (total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ).withColumn("rank", F.row_number().over(filling))
    open_rows = F.when(F.col("bound") > F.col("weight") * F.col("level"), F.struct("rank", "level"))
    level = F.min(open_rows).over(everything)["level"]
    target = F.least(F.col("bound"), F.coalesce(F.col("weight") * level, F.col("bound")))
    return rows.select(*totals.columns, target.alias("target"))


def apportion(parties: DataFrame, group: str) -> DataFrame:
    """Adds `quota` to (party, votes, seats): each group's seats by highest quotients v / (2k + 1).

    Rounding v over the mean votes of a seat gives all but few seats; those missing go to the
    highest further quotients, those too many are taken from the lowest ones held. A party differs
    from its rounded share by at most its part of half the parties, plus one, so only so many
    quotients of each are looked at. Ties go to the smaller party number.
    """
    whole = Window.partitionBy(group)
    rows = parties.withColumn("all_votes", F.sum("votes").over(whole)).withColumn("n", F.count("*").over(whole))
    fair = F.when(F.col("all_votes") > 0, F.col("votes") / F.col("all_votes") * F.col("seats")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(fair + 0.5))
    rows = rows.withColumn("missing", F.when(F.col("all_votes") > 0, F.col("seats")).otherwise(0) - F.sum("base").over(whole))
    reach = F.floor(F.when(F.col("all_votes") > 0, F.col("votes") / F.col("all_votes")).otherwise(0.0) * F.col("n") / 2) + 2
    steps = rows.where("missing != 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), reach)))
    up = F.col("missing") > 0
    steps = steps.where(up | (F.col("k") <= F.col("base")))
    # The k-th seat from here: seat number base + k - 1 when given, base - k when taken, from zero.
    seat = F.when(up, F.col("base") + F.col("k") - 1).otherwise(F.col("base") - F.col("k"))
    quotient = F.col("votes") / (2 * seat + 1)
    order = F.when(up, -quotient).otherwise(quotient)
    ranked = steps.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, F.when(up, F.col("party")).otherwise(-F.col("party")))))
    change = (
        ranked.where(F.col("rank") <= F.abs("missing"))
        .groupBy(group, "party")
        .agg(F.sum(F.signum("missing").cast("long")).alias("change"))
    )
    return rows.join(change, [group, "party"], "left").select(
        *parties.columns, (F.col("base") + F.coalesce("change", F.lit(0))).alias("quota")
    )


@keeps_names("_")
def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """Every row of `docs` with size, source_size, target, taken, and the run of words taken once more.

    `taken` counts the words the mix takes of the row, repeats counted, at most `most` times its
    size: mix_whole whole copies, then mix_run words from word mix_from on (a run that goes over the
    end goes on at the start). Empty and null texts have size 0 and take nothing. A null source is
    a source like any other. The result depends on ids and texts, not on partitions; wholly repeated
    rows may swap their parts. Columns of the added names are replaced.
    """
    added = ["mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_whole", "mix_from", "mix_run"]
    docs = docs.drop(*added)
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))

    def sized(df: DataFrame) -> DataFrame:
        return df.withColumns({"_m_source": F.col(source_col), "_m_size": word_count(F.col(text_col)), "_m_key": key})

    narrow = stash(sized(docs).select("_m_source", "_m_size", "_m_key"), "sizes")
    totals = narrow.groupBy(F.col("_m_source").alias("source")).agg(
        F.sum("_m_size").alias("source_size"), F.count("*").alias("rows")
    )
    shards = F.ceil((F.col("source_size") + F.col("rows") * ROW_WORDS) / shard_words).alias("shards")
    one = Window.partitionBy(F.lit(0))
    votes = targets(totals, weights, share, most).select(
        "source",
        "source_size",
        "target",
        shards,
        F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())).alias("party"),
        F.lit(0).alias("all"),
        F.col("target").alias("votes"),
        F.round(F.sum("target").over(one) / block_words).cast("long").alias("seats"),
    )
    names = {"source": "_m_name", "source_size": "_m_source_size", "target": "_m_target", "party": "_m_number", "quota": "_m_quota", "shards": "_m_shards"}
    sources = stash(apportion(votes, "all").select(*[F.col(c).alias(name) for c, name in names.items()]), "sources")

    def placed(df: DataFrame) -> DataFrame:
        """Joins the source's row, one for each source, and picks the shard."""
        joined = df.join(sources, F.col("_m_source").eqNullSafe(F.col("_m_name")))
        return joined.withColumn("_m_shard", F.pmod(F.xxhash64(F.col("_m_key"), F.lit(seed)), F.col("_m_shards")))

    stock = placed(narrow).groupBy("_m_number", "_m_quota", "_m_shard").agg(F.sum("_m_size").alias("stock"))
    quotas = apportion(
        stock.select(
            F.col("_m_number").alias("number"),
            F.col("_m_shard").alias("party"),
            "stock",
            F.col("stock").cast("double").alias("votes"),
            F.col("_m_quota").alias("seats"),
        ),
        "number",
    )
    blocks = F.ceil(F.col("stock") / block_words)
    wanted = F.least(F.col("quota") * block_words, F.col("stock") * most)
    runs = stash(
        quotas.where("stock > 0").select(
            F.col("number").alias("_m_run_number"),
            F.col("party").alias("_m_run_shard"),
            F.col("stock").alias("_m_stock"),
            F.floor(wanted / F.col("stock")).alias("_m_epochs"),
            F.pmod(wanted, F.col("stock")).alias("_m_rest"),
            (F.pmod(F.xxhash64(F.lit(seed), "number", "party"), blocks) * block_words).alias("_m_begin"),
        ),
        "quotas",
    )
    line = Window.partitionBy("_m_number", "_m_shard").orderBy("_m_key", id_col, "_m_size")
    size, stock_words, begin = F.col("_m_size"), F.col("_m_stock"), F.col("_m_begin")
    upto = F.sum("_m_size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = (
        placed(sized(docs))
        .withColumn("_m_end", upto)
        .join(runs, (F.col("_m_number") == F.col("_m_run_number")) & (F.col("_m_shard") == F.col("_m_run_shard")), "left")
    )
    first = F.col("_m_end") - size
    until = begin + F.col("_m_rest")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_m_end"), high) - F.greatest(first, low))

    # A run that goes over the shard's end goes on at its front.
    parts = {"_m_front": overlap(F.lit(0), until - stock_words), "_m_back": overlap(begin, F.least(until, stock_words))}
    some, epochs = size > 0, F.col("_m_epochs")
    front, back = F.col("_m_front"), F.col("_m_back")
    return rows.withColumns(parts).select(
        *docs.columns,
        size.alias("mix_size"),
        F.col("_m_source_size").alias("mix_source_size"),
        F.col("_m_target").alias("mix_target"),
        F.when(some, epochs * size + front + back).otherwise(0).cast("long").alias("mix_taken"),
        F.when(some, epochs).otherwise(0).cast("long").alias("mix_whole"),
        F.when(some & (back > 0), F.greatest(F.lit(0), begin - first)).otherwise(0).cast("long").alias("mix_from"),
        F.when(some, front + back).otherwise(0).cast("long").alias("mix_run"),
    )


@keeps_names("_", "mix_")
def draw(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixed table: whole copies, and the run of words of rows taken in part, joined by spaces.

    A row that is not taken goes, and so do empty texts. The columns are those of `docs`.
    """
    mixed = mix(docs, text_col=text_col, **options)
    part = F.when((F.col("mix_run") > 0) & (F.col("mix_run") < F.col("mix_size")), F.lit(1)).otherwise(0)
    whole = F.col("mix_whole") + F.when((F.col("mix_run") > 0) & (F.col("mix_run") == F.col("mix_size")), 1).otherwise(0)
    # One entry for each copy: false whole, true cut.
    copies = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.array_repeat(F.lit(True), part))
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    words = F.concat(words, words)  # a run may go over the end
    run = F.array_join(F.slice(words, (F.col("mix_from") + 1).cast("int"), F.col("mix_run").cast("int")), " ")
    rows = mixed.withColumn("_m_cut", F.explode(copies))
    return rows.withColumn(text_col, F.when(F.col("_m_cut"), run).otherwise(F.col(text_col))).select(*docs.columns)
