"""Packing by power-of-two decomposition.

A document's token ids are split into pieces whose lengths are the powers of two of its length in
binary, none longer than a sequence. Every piece is a training sequence of its own length, so no
sequence crosses documents and none is padded; pieces of equal length form a bucket, from which a
trainer draws batches of equal shape.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Longest sequence, a power of two, and the id that ends every document.
SEQUENCE = 2048
END_ID = 1
#: Pieces handed back to Spark at a time.
ROWS = 4096


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine keeps the public tokenizer; every executor looks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as the tokenizer file defines them.

    The file's merges are in the order of its ids, so a byte-pair encoder that ranks by id gives
    the same ids several times faster. Where it gives up (a blank run too long for its splitter)
    the file's own tokenizer takes the text.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers

        self.path = path or tokenizer_path()
        self.slow = Tokenizer.from_file(self.path)
        self.fast = None
        if path is None:
            lines = open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            # Fixed value: the one added token of the file.
            special = {"<|endoftext|>": 50256}
            self.fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode(text, allowed_special="all")
            except ValueError:
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


def binary_pieces(tokens: int, longest: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces: as many of the longest as fit, then the powers of two of the rest."""
    pieces, start = [(at, longest) for at in range(0, tokens - longest + 1, longest)], tokens // longest * longest
    length = longest // 2
    while length:
        if tokens - start >= length:
            pieces.append((start, length))
            start += length
        length //= 2
    return pieces


#: Columns of a packed piece.
SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def pack(
    docs: DataFrame,
    longest: int = SEQUENCE,
    end_id: int = END_ID,
    path: str | None = None,
    with_ids: bool = False,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row for each piece: its document, place, length, checksum, sequence and offset there.

    Null text counts as empty and gives the end id alone; every document, repeated rows included,
    is packed for itself. A sequence holds one piece, so its offset is 0 and its length, a power
    of two, is its bucket. `with_ids` adds the ids. Sequence ids are unique and follow the order
    of the input: the partition in the upper bits, the place in it in the lower ones, so packing
    needs no shuffle. `path` names another tokenizer file, used by its own library.
    """
    fields = [*SCHEMA, *([pa.field("ids", pa.list_(pa.int32()))] if with_ids else [])]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encoder.ids(text or ""), end_id], dtype="<u4")
                for start, length in binary_pieces(len(ids), longest):
                    part = ids[start : start + length]
                    row = (doc, start, length, zlib.crc32(part.tobytes()), len(ids), sequence, 0)
                    rows.append((*row, part.astype(np.int32)) if with_ids else row)
                    sequence += 1
                    held += 1 + (length if with_ids else 0)
                    if held >= ROWS * (1 + 64 * with_ids):
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    spec = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, spec + (", ids array<int>" if with_ids else "")
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def buckets(pieces: DataFrame) -> DataFrame:
    """Sequences and tokens by length: what a trainer can draw batches of."""
    return pieces.groupBy("length").agg(F.count("*").alias("sequences"), F.sum("length").alias("tokens"))
