"""From documents to packed training sequences: five stages, each one operator of twinframe.llm.

Every stage takes what the one before kept and, but for the last, returns the columns of documents;
further columns of the input come back unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import langid, lines, mixing, packing, simhash
from twinframe.llm.shared import apart, stash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars again equal to the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; null and letterless texts go.

    The dictionaries are learned from the language labels of the documents themselves, except of
    the quarter that the operator's query holds out.
    """
    dictionaries = langid.fit_dictionaries(docs, ~langid.held_out())
    accepted = lambda rows: langid.identify(rows, dictionaries).where("lang_accepted").select(*rows.columns)
    return apart(docs, accepted, "lang_")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat earlier ones; a document that has only such lines goes."""
    emptied = (F.col("line_dropped") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    shortened = lambda rows: lines.deduplicate(rows, least_chars=lines.EVERY_LINE).where(~emptied).select(*rows.columns)
    return recounted(apart(docs, shortened, "line_"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with the shingles and distance of op3.

    Null and empty texts and those without a word share the fingerprint zero and are one group. The
    row with the smallest id stays, and of rows that repeat it only one.
    """
    return simhash.keep_one(docs, simhash.SHINGLE_WORDS, simhash.MAX_BITS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of op5: documents as often as it takes them, the last copy cut to the words taken.

    Documents without words are taken no times and leave here; repeated rows are mixed one by one;
    null sources are one source. Equal quotients go to the source or shard with the smaller number.
    """
    return recounted(mixing.draw(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence, with their token ids.

    A null or empty text gives the end id alone; repeated rows are packed one by one; the order of
    the input numbers the sequences, so ties need none.
    """
    return packing.pack(docs, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("pack", pack),
]

#: SQL can neither compress with a dictionary nor tokenise; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
