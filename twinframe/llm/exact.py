"""Exact deduplication by Grace hashing.

Texts are dealt out by a hash; within a task a bucket that does not fit is dealt out again to spill
files by further bits of the hash, until each bucket fits an open-addressing table that compares
complete contents. It runs twice: over the rows as they are read, where copies in one input
partition shrink to one entry, and over those entries, dealt out across the cluster.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.shared import BLANKS, stash

#: Bytes of content one open-addressing table may hold before its bucket is dealt out again.
TABLE_BYTES = 96 << 20
#: Spill files a bucket is dealt out to, a power of two.
FAN_OUT = 16
#: Rows handed back to Spark at a time.
ROWS = 4096


class Table:
    """Open addressing with linear probing; a slot is taken over only if hash and content are equal."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.used = 0

    def find(self, key: int, content: bytes) -> int:
        """Number of the entry of this content, a new one if there is none."""
        mask = len(self.slots) - 1
        at = (key ^ key >> 29) & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        self.used += len(content) + 120
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        size = 4 * len(self.slots)
        self.slots = [-1] * size
        for entry, key in enumerate(self.hashes):
            at = (key ^ key >> 29) & (size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = entry


def grace(rows: Iterator[tuple], table_bytes: int = TABLE_BYTES, depth: int = 0) -> Iterator[tuple[Table, list]]:
    """Groups (hash, content, *rest) rows: (table, [(entry, *rest)]) for each bucket that fits.

    Rows stream into a table. When its contents pass the bound, rows of known content still go to
    it and the others are dealt out to spill files by the next bits of their hash; each file is
    then treated alike. Equal contents always meet in one table. A table takes at least one
    content, so buckets shrink even if hashes collide and contents are larger than the bound.
    """
    table, members = Table(), []
    files = None
    shift = 4 * depth % 60
    for key, content, *rest in rows:
        if table.used > table_bytes and table.contents:
            at = (key ^ key >> 29) & (len(table.slots) - 1)
            while (entry := table.slots[at]) >= 0:
                if table.hashes[entry] == key and table.contents[entry] == content:
                    break
                at = (at + 1) & (len(table.slots) - 1)
            if entry < 0:
                if files is None:
                    files = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
                pickle.dump((key, content, *rest), files[key >> shift & FAN_OUT - 1], protocol=5)
                continue
        else:
            entry = table.find(key, content)
        members.append((entry, *rest))
    yield table, members
    del table, members
    for file in files or []:
        with file:
            file.seek(0)
            yield from grace(_read(file), table_bytes, depth + 1)


def _read(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def normalised(column: Column) -> Column:
    """The text with every run of ASCII blanks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), BLANKS, " ")


def shrink(rows: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Groups equal contents within each partition of (id, place, hash, content).

    One row for each input row: (id, place, local, n, hash, content). `local` is the place of the
    group's first row by (id, place), nulls last; only that row carries the content, and n, the
    size of the group.
    """
    schema = pa.schema(
        [("id", pa.int64()), ("place", pa.int64()), ("local", pa.int64()), ("n", pa.int64()), ("hash", pa.int64()), ("content", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read():
            for batch in batches:
                cols = [batch.column(name).to_pylist() for name in ("hash", "content", "id", "place")]
                yield from zip(*cols)

        for table, members in grace(read(), table_bytes):
            first: dict[int, tuple] = {}
            count = [0] * len(table.contents)
            for entry, doc, place in members:
                key = (doc is None, doc or 0, place)
                count[entry] += 1
                if entry not in first or key < first[entry]:
                    first[entry] = key
            for at in range(0, len(members), ROWS):
                out = [
                    (doc, place, first[e][2], count[e], table.hashes[e], table.contents[e])
                    if first[e][2] == place
                    else (doc, place, first[e][2], None, None, None)
                    for e, doc, place in members[at : at + ROWS]
                ]
                for part in _bounded(out):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)

    return rows.mapInArrow(run, "id long, place long, local long, n long, hash long, content binary")


def _bounded(rows: list[tuple], most: int = 16 << 20) -> Iterator[list[tuple]]:
    """The rows in pieces of about `most` bytes of content."""
    piece, size = [], 0
    for row in rows:
        piece.append(row)
        size += len(row[5] or b"")
        if size > most:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def settle(entries: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Groups the entries (hash, content, id, local, n) of equal hash across partitions.

    One row for each entry: (local, keep_id, keep_local, group_size).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read():
            for batch in batches:
                cols = [batch.column(name).to_pylist() for name in ("hash", "content", "id", "local", "n")]
                yield from zip(*cols)

        for table, members in grace(read(), table_bytes):
            first: dict[int, tuple] = {}
            count = [0] * len(table.contents)
            for entry, doc, local, n in members:
                key = (doc is None, doc or 0, local)
                count[entry] += n
                if entry not in first or key < first[entry]:
                    first[entry] = key
            for at in range(0, len(members), ROWS):
                part = members[at : at + ROWS]
                best = [first[m[0]] for m in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([m[2] for m in part], pa.int64()),
                        pa.array([None if b[0] else b[1] for b in best], pa.int64()),
                        pa.array([b[2] for b in best], pa.int64()),
                        pa.array([count[m[0]] for m in part], pa.int64()),
                    ],
                    names=["local", "keep_id", "keep_place", "group_size"],
                )

    return entries.mapInArrow(run, "local long, keep_id long, keep_place long, group_size long")


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when identical after blanks are normalised; null counts as empty. Of equal
    texts the row with the smallest id stays, null ids last; of rows that also repeat the id, the
    one read first stays, and the rest have kept = false with keep_id equal to their own id.
    Copies shrink to one entry in every input partition before anything is shuffled, so a text
    that fills a third of the table sends one entry a partition.
    """
    content = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("place"),
        content.alias("content"),
    ).select("id", "place", F.xxhash64("content").alias("hash"), F.col("content").cast("binary").alias("content"))
    shrunk = stash(
        shrink(rows, table_bytes).withColumn("text_sha256", F.sha2("content", 256)), "shrunk"
    )
    entries = shrunk.where("n is not null").select("hash", "content", "id", "local", "n").repartition("hash")
    groups = settle(entries, table_bytes).join(
        shrunk.where("n is not null").select("local", "text_sha256"), "local"
    )
    return shrunk.select("id", "place", "local").join(groups, "local").select(
        "id",
        "keep_id",
        "group_size",
        (F.col("place") == F.col("keep_place")).alias("kept"),
        "text_sha256",
    )
