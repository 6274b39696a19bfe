"""Helpers of the operators: materialised intermediate tables, word patterns, connected components."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.session import scratch_path

# A word is a run of characters other than these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    Cuts the lineage, survives lost executors, and keeps column pruning and size statistics for
    what reads it, which a checkpointed RDD would not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame], *starts: str) -> DataFrame:
    """The result of `work`, which may use columns that begin with one of `starts` as its own.

    Columns of the input that begin so are renamed before and get their names and values back after.
    """
    used, aside = {c.lower() for c in docs.columns}, {}
    for name in docs.columns:
        if name.lower().startswith(starts):
            other = f"input{name}"
            while other.lower() in used or other.lower().startswith(starts):
                other = f"input_{other}"
            used.add(other.lower())
            aside[name] = other
    return work(docs.withColumnsRenamed(aside)).withColumnsRenamed({other: name for name, other in aside.items()})


def keeps_names(*starts: str):
    """An operator on `docs` as `apart` runs it; column names among its arguments are renamed alike."""

    def decorate(operator):
        @wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            def work(renamed: DataFrame) -> DataFrame:
                now = dict(zip(docs.columns, renamed.columns))
                told = lambda value: now.get(value, value) if isinstance(value, str) else value
                return operator(renamed, *map(told, args), **{k: told(v) for k, v in options.items()})

            return apart(docs, work, *starts)

        return run

    return decorate


def text_crc(column: Column | str) -> Column:
    """Unsigned CRC-32 of the column as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string"))


def rest_of_id(modulus: int, id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo: the stable split into learned and held-out rows."""
    return F.pmod(text_crc(F.col(id_col).cast("string")), F.lit(modulus))


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), two longs: one row (node, root) for each linked node.

    The root is the smallest node of its component. Alternates large-star and small-star steps
    until every node points at its root; each step is a pre-aggregated minimum and a join, so a
    node with very many neighbours is never gathered in one place. The number of steps grows with
    the logarithm of the longest chain.
    """
    stars = stash(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()
        stars = stash(small, "stars")
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def _are_stars(links: DataFrame) -> bool:
    """True if no link starts where another ends and no node has two links downwards."""
    chained = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    if not chained.isEmpty():
        return False
    return links.groupBy("a").count().where("count > 1").isEmpty()
