"""Vector code compression: product codes whose codebooks are fitted by ball k-means.

Each part of a vector has a codebook of entries. An entry and the parts assigned to it form a ball.
After the entries have moved, a ball's radius tells which entries are its neighbours: only those
closer to it than twice the radius can take a part away. A part closer to its entry than half the
way to the nearest neighbour lies in the stable core and needs no comparison; between these, rings
at half the way to each next neighbour say how many of the neighbours a part has to be compared
with. All arithmetic is in whole numbers, so the result is that of comparing every pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.shared import stash
from twinframe.operators.ordering import as_small

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components at or beyond this are not coded: below it, distances and their sums are exact in 64 bits.
LARGEST = float(1 << 16)
#: Vectors assigned at a time, which bounds the candidate pairs held by a task.
ROWS = 2048
#: Rows of sums by label that may be sent to every task.
SENT_ROWS = 100_000


def cuts(dims: int, parts: int = PARTS) -> list[int]:
    """Bounds of the parts: equal, or the first ones a component longer where that cannot be."""
    return np.cumsum([0, *[dims // parts + (p < dims % parts) for p in range(parts)]]).tolist()


class Codebook:
    """Entries of one part, and for each entry the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        apart = self.entries[:, None, :] - self.entries[None, :, :]
        between = (apart * apart).sum(axis=2)
        # The ball's own entry comes first, whatever others lie on it.
        np.fill_diagonal(between, -1)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, axis=1)

    def distances(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        off = points - self.entries[entry]
        return (off * off).sum(axis=1)

    def assign(self, points: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance, distances computed), for points now in the given balls.

        With a point at distance d from its entry, another entry at least 2 d away from that one is
        at least as far from the point. Equally far is a tie that a lower index wins, so only
        entries more than 2 d away are left out.
        """
        near = self.distances(points, ball)
        radius = np.full(len(self.entries), -1, dtype=np.int64)
        np.maximum.at(radius, ball, near)
        # Neighbours of each ball, and of them those within the ring of each point outside the core.
        neighbours = np.array([np.searchsorted(b[1:], 4 * r, "right") if r >= 0 else 0 for b, r in zip(self.between, radius)])
        ring = np.zeros(len(points), dtype=np.int64)
        for entry in np.flatnonzero(neighbours):
            members = np.flatnonzero(ball == entry)
            ring[members] = np.searchsorted(self.between[entry, 1 : neighbours[entry] + 1], 4 * near[members], "right")
        moving = np.flatnonzero(ring)
        best, least = ball.astype(np.int64), near.copy()
        if not len(moving):
            return best, least, len(points)
        counts = ring[moving]
        starts = np.cumsum(counts) - counts
        point = np.repeat(moving, counts)
        place = np.arange(counts.sum()) - np.repeat(starts, counts) + 1
        entry = self.order[ball[point], place]
        # Distance and index in one number: the smallest is the nearest entry, of equals the lowest.
        size = len(self.entries)
        found = np.minimum.reduceat(self.distances(points[point], entry) * size + entry, starts)
        found = np.minimum(found, near[moving] * size + ball[moving])
        best[moving], least[moving] = found % size, found // size
        return best, least, len(points) + len(point)


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _assigner(books: list[np.ndarray], dims: int, parts: int):
    """Arrow function over (row, v, balls): the same with the nearest entries and their squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks, bounds = [Codebook(b) for b in books], cuts(dims, parts)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                v = _rows(batch["v"], dims) if dims else np.zeros((batch.num_rows, 0), dtype=np.int64)
                balls = _rows(batch["balls"], parts)
                errors = np.zeros_like(balls)
                for p, book in enumerate(codebooks):
                    part = np.ascontiguousarray(v[:, bounds[p] : bounds[p + 1]])
                    balls[:, p], errors[:, p], _ = book.assign(part, balls[:, p])
                offsets = pa.array(np.arange(batch.num_rows + 1) * parts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["row"],
                        batch["v"],
                        pa.ListArray.from_arrays(offsets, pa.array(balls.ravel(), pa.int32())),
                        pa.array(errors.sum(axis=1), pa.int64()),
                    ],
                    names=["row", "v", "balls", "error"],
                )

    return run


def _summer(sizes: list[int], dims: int, parts: int):
    """Arrow function over (v, balls): for each part and entry the count and the sums of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = cuts(dims, parts)
        counts = [np.zeros(n, dtype=np.int64) for n in sizes]
        sums = [np.zeros((n, bounds[p + 1] - bounds[p]), dtype=np.int64) for p, n in enumerate(sizes)]
        for batch in batches:
            v, balls = _rows(batch["v"], dims), _rows(batch["balls"], parts)
            for p in range(parts):
                np.add.at(counts[p], balls[:, p], 1)
                np.add.at(sums[p], balls[:, p], v[:, bounds[p] : bounds[p + 1]])
        rows = [(p, e, d, int(sums[p][e, d]), int(counts[p][e])) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist() for d in range(sums[p].shape[1])]
        if rows:
            names = ["part", "entry", "place", "total", "n"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def updated(books: list[np.ndarray], assigned: DataFrame, dims: int, parts: int) -> list[np.ndarray]:
    """Every entry moved to the floored mean of its parts; unused entries stay.

    The sums meet in Spark; what comes to the driver is as large as the codebooks.
    """
    if not dims:
        return books
    sums = assigned.select("v", "balls").mapInArrow(
        _summer([len(b) for b in books], dims, parts), "part int, entry int, place int, total long, n long"
    )
    moved = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r.part][r.entry, r.place] = r.total // r.n
    return moved


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    carry: list[str] | None = None,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, the carried columns, balls, error) of every usable vector, and the codebooks.

    Vectors that are null, or hold a null or non-finite component, are left out. A codebook starts
    as the parts of the usable vectors with the smallest ids (nulls last, ties by the components);
    there are fewer entries where there are fewer vectors. The length of the first of them is that
    of the codes: vectors of another length, and those with a component of LARGEST or beyond, come
    back with null `balls` and `error` and move no entry. A length that the parts do not divide
    makes the first parts one component longer. Repeated ids are vectors of their own. An empty
    table gives no rows and no codebooks.

    Each round is one pass over the integer vectors and the balls of the round before, written to
    the shared folder; sums are combined in the tasks before they are shuffled.
    """
    carry = carry or []
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    kept = vectors.where(F.coalesce(finite, F.lit(False))).select(
        F.struct(F.col(id_col).alias("id"), *carry).alias("row"), vector.alias("whole")
    )
    first = [
        np.array([math.floor(float(x) * scale) for x in r.whole], dtype=object)
        for r in kept.orderBy(F.col("row.id").asc_nulls_last(), "whole").limit(entries).collect()
    ]
    dims = len(first[0]) if first else 0
    small = F.forall("whole", lambda x: F.abs(x) < LARGEST) & (F.size("whole") == dims)
    first = [v for v in first if len(v) == dims and all(abs(x) < LARGEST * scale for x in v)]
    bounds = cuts(dims, parts)
    fields = [F.col("row.id").alias("id"), *[F.col("row")[c].alias(c) for c in carry]]
    uncoded = kept.where(~small if first else F.lit(True)).select(
        *fields, F.lit(None).cast("array<int>").alias("balls"), F.lit(None).cast("long").alias("error")
    )
    if not first:
        return uncoded, []
    books = [np.stack([v[bounds[p] : bounds[p + 1]] for v in first]).astype(np.int64) for p in range(parts)]
    # Every part starts in the ball of entry 0.
    state = stash(
        kept.where(small).select(
            "row", integers(F.col("whole"), scale).alias("v"), F.array_repeat(F.lit(0), parts).alias("balls"), F.lit(0).cast("long").alias("error")
        ),
        "vectors",
    )
    schema = state.schema
    for round_ in range(rounds + 1):
        state = stash(state.select("row", "v", "balls").mapInArrow(_assigner(books, dims, parts), schema), "balls")
        if round_ < rounds:
            books = updated(books, state, dims, parts)
    return state.select(*fields, "balls", "error").unionByName(uncoded), books


def code(balls: Column) -> Column:
    """Two lowercase hex digits for each part."""
    return F.lower(F.concat_ws("", F.transform(balls, lambda b: F.lpad(F.hex(b), 2, "0"))))


def restored(balls: Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector that the codes stand for: the entries one after the other, divided by the scale."""
    tables = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]).cast("array<int>") for e in book]) for book in books])
    whole = F.flatten(F.transform(balls, lambda b, p: F.get(F.get(tables, p), b)))
    return F.when(balls.isNotNull(), F.transform(whole, lambda x: x.cast("double") / scale))


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def summed_over(rows: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of `value` over all rows of their label; null labels count together."""
    sums = rows.groupBy(F.col(label).alias("sum_label")).agg(F.sum(value).alias(name))
    return rows.join(as_small(sums, SENT_ROWS), F.col(label).eqNullSafe(F.col("sum_label"))).drop("sum_label")
