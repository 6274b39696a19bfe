"""Language identification by compression.

Each language gets a zstandard raw-content dictionary made of short passages of its labelled
documents. A text is compressed with every dictionary; the language whose dictionary makes it
smallest is the answer, and a narrow margin to the next one rejects the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.shared import keeps_names, rest_of_id

UNDETERMINED = "und"
#: Passages each language's dictionary is made of, and their length in characters: the bound of the sample.
PASSAGES = 256
PASSAGE_CHARS = 128
#: Texts are compressed in pieces of this many bytes, so that the dictionary matters in all of a long text.
PIECE_BYTES = 2048
#: A text whose best size is not smaller than the second best by this share is rejected.
LEAST_MARGIN = 0.004
#: Bytes of difference that multiply the odds between two languages by e.
BYTES_PER_NAT = 4.0

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str | None) -> str:
    """Lower-case words of letters with single spaces; empty if there is no letter."""
    return _NO_LETTERS.sub(" ", text.lower()).strip() if text else ""


def fit_dictionaries(
    docs: DataFrame,
    learn: Column,
    passages: int = PASSAGES,
    passage_chars: int = PASSAGE_CHARS,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
) -> list[tuple[str, bytes]]:
    """One dictionary for each language found where `learn` holds, the most frequent language first.

    The sample is bounded: `passages` documents of each language, those with the smallest hash of
    their id, and one passage of `passage_chars` from a hashed place in each. Only ids and
    languages are ranked; texts are read for the chosen rows alone.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.col(id_col))
    ranked = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), key.alias("key")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "id"))
    )
    chosen = ranked.where(F.col("rank") <= passages).select("lang", "id").distinct()
    start = F.pmod(key, F.greatest(F.length(text_col) - passage_chars, F.lit(1))).cast("int") + 1
    cut = F.substring(F.col(text_col), start, F.lit(passage_chars))
    # Rows that repeat an id do not lengthen the sample: one passage, the smallest, for each id.
    texts = (
        rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), cut.alias("passage"))
        .join(F.broadcast(chosen), ["lang", "id"], "left_semi")  # at most `passages` ids a language
        .groupBy("lang", "id")
        .agg(F.min("passage").alias("passage"))
    )
    found: dict[str, list[tuple]] = {}
    for row in texts.collect():  # bounded as above
        found.setdefault(row["lang"], []).append((str(row["id"]), letters_only(row["passage"])))
    counts = {r["lang"]: r["count"] for r in rows.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    order = sorted(found, key=lambda lang: (-counts[lang], lang))
    return [(lang, " ".join(text for _, text in sorted(found[lang]) if text).encode()) for lang in order]


class Compressors:
    """The dictionaries made ready for one Python worker."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        params = zstandard.ZstdCompressionParameters(
            window_log=17,
            chain_log=16,
            hash_log=16,
            search_log=4,
            min_match=3,
            target_length=32,
            strategy=zstandard.STRATEGY_LAZY,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        self.langs = [lang for lang, _ in dictionaries]
        self.codecs = []
        for _, content in dictionaries:
            if len(content) < 8:  # nothing to learn from: compress without a dictionary
                self.codecs.append(zstandard.ZstdCompressor(compression_params=params))
                continue
            ready = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            ready.precompute_compress(compression_params=params)
            self.codecs.append(zstandard.ZstdCompressor(dict_data=ready, compression_params=params))

    def judge(self, text: str | None, least_margin: float) -> tuple[str, float, float, bool]:
        """(language, score, margin, accepted) of one whole text."""
        data = letters_only(text).encode()
        if not data or not self.langs:
            return UNDETERMINED, 0.0, 0.0, False
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        sizes = [sum(len(codec.compress(p)) for p in pieces) for codec in self.codecs]
        best = min(range(len(sizes)), key=sizes.__getitem__)  # a tie goes to the more frequent language
        others = [s for i, s in enumerate(sizes) if i != best]
        odds = sum(2.718281828459045 ** (-min((s - sizes[best]) / BYTES_PER_NAT, 700.0)) for s in others)
        margin = (min(others) - sizes[best]) / min(others) if others else 1.0
        return self.langs[best], 1.0 / (1.0 + odds), margin, margin >= least_margin


@keeps_names("_")
def identify(
    docs: DataFrame,
    dictionaries: list[tuple[str, bytes]],
    least_margin: float = LEAST_MARGIN,
    text_col: str = "text",
) -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1), lang_margin and lang_accepted to every row.

    A null text, an empty one and one without a letter get `und`, score 0 and are not accepted;
    a tie in size goes to the more frequent language with margin 0, so it is not accepted.
    Without any dictionary every row is `und`. Columns of the same names are replaced.
    """
    added = ["lang_pred", "lang_score", "lang_margin", "lang_accepted"]
    kept = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by the sample

    @F.pandas_udf("lang_pred string, lang_score double, lang_margin double, lang_accepted boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codecs = Compressors(sent.value)
        for texts in batches:
            yield pd.DataFrame([codecs.judge(t, least_margin) for t in texts], columns=added)

    out = kept.withColumn("_judged", judged(F.col(text_col)))
    return out.select(*kept.columns, *[F.col(f"_judged.{c}").alias(c) for c in added])


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the documents that nothing is learned from."""
    return rest_of_id(4, id_col) == 2
