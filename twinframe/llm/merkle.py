"""Merkle manifest of a dataset, built by aligned appends with incremental witnesses.

Leaves are numbered in the order of their tree and dealt into aligned blocks. A block streams its
leaves into a frontier of open perfect subtrees; whenever two subtrees of one height meet, the root
of each is added to the partial witness of every leaf below the other. The roots of blocks are
nodes of a higher frontier and are appended in the same way, block by block, until one root is left
for each tree; witnesses are then extended downwards by those of the block above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.shared import stash
from twinframe.operators.ordering import as_small

#: A block holds 2 to this power nodes: what one task keeps open at a time.
BLOCK_BITS = 10
#: Rows of a table that may be sent to every task: one for each tree, or for each tree and partition.
SENT_ROWS = 100_000


def encoded(columns: list[Column]) -> Column:
    """The columns one after the other, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf(*columns: Column | str) -> Column:
    """SHA-256, lowercase hex, of the encoded columns."""
    return F.sha2(encoded([F.col(c) if isinstance(c, str) else c for c in columns]), 256)


class Frontier:
    """Open perfect subtrees of the nodes appended so far, and the witness of every node.

    `witness[h, i]` is the sibling of node i at height h: `l` or `r` for its side and its digest,
    or an empty text where the run has no other node.
    """

    def __init__(self, size: int, height: int):
        self.witness = np.full((height, size), "", dtype=object)
        self.open: list[tuple[int, int, str]] = []
        self.size, self.height, self.next = size, height, 0

    def append(self, digest: str) -> None:
        self.open.append((0, self.next, digest))
        self.next += 1
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._complete()

    def _complete(self) -> None:
        height, middle, right = self.open.pop()
        _, start, left = self.open.pop()
        self.witness[height, start:middle] = "r" + right
        self.witness[height, middle : self.next] = "l" + left
        self.open.append((height + 1, start, hashlib.sha256((left + right).encode()).hexdigest()))

    def close(self) -> str:
        """The root at the full height: the last subtree, without a sibling, rises alone until it meets one."""
        while self.open[-1][0] < self.height:
            height, start, digest = self.open.pop()
            self.open.append((height + 1, start, hashlib.sha256(digest.encode()).hexdigest()))
            while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._complete()
        return self.open[0][2]


def append_all(digests: list[str], total: int, bits: int = BLOCK_BITS) -> Frontier:
    """A block's frontier. Its height is that of the whole tree if the block holds it, else the block's."""
    frontier = Frontier(len(digests), min(bits, max(0, total - 1).bit_length()))
    for digest in digests:
        frontier.append(digest)
    return frontier


_ROOTS = "tree string, index long, digest string, total long"
_WITNESSES = "tree string, index long, witness array<string>, root string"


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pa.compute.sort_indices(table["index"]))


def _block_root(block: pa.Table, bits: int) -> pa.Table:
    block = _in_order(block)
    total = block["total"][0].as_py()
    root = append_all(block["digest"].to_pylist(), total, bits).close()
    return pa.table(
        {
            "tree": block["tree"].slice(0, 1),
            "index": pa.array([block["index"][0].as_py() >> bits], pa.int64()),
            "digest": pa.array([root]),
            "total": pa.array([-(-total >> bits)], pa.int64()),
        }
    )


def _block_witnesses(block: pa.Table, above: pa.Table | None, bits: int) -> pa.Table:
    """Witnesses of a block's nodes up to the root of the tree; `above` is the block's own row one level up."""
    block = _in_order(block)
    frontier = append_all(block["digest"].to_pylist(), block["total"][0].as_py(), bits)
    root, n = frontier.close(), block.num_rows
    rows = list(frontier.witness)
    if above is not None:
        root = above["root"][0].as_py()
        rows += [np.full(n, w, dtype=object) for w in above["witness"][0].as_py()]
    flat = np.stack(rows, axis=1).ravel().tolist() if rows else []
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(rows), pa.int32()), pa.array(flat, pa.string()))
    return pa.table({"tree": block["tree"], "index": block["index"], "witness": lists, "root": pa.array([root] * n, pa.string())})


def witnesses(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, index, witness, root) of the nodes (tree, index, digest, total), numbered from 0 in each tree.

    `total` is the number of nodes of the tree. Every task sees one block and, on the way down, one
    row of the level above, so a tree of any size is spread over all tasks.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    block = F.shiftright("index", bits)
    levels = [nodes]
    while most > 1 << bits:
        below = levels[-1].withColumn("block", block)
        roots = below.groupBy("tree", "block").applyInArrow(lambda t: _block_root(t, bits), _ROOTS)
        levels.append(stash(roots, "block-roots"))
        most = -(-most >> bits)
    top = levels.pop().withColumn("block", block)
    found = top.groupBy("tree", "block").applyInArrow(lambda t: _block_witnesses(t, None, bits), _WITNESSES)
    while levels:
        below = levels.pop().withColumn("block", block)
        above = stash(found, "block-witnesses")
        found = (
            below.groupBy("tree", "block")
            .cogroup(above.groupBy("tree", "index"))
            .applyInArrow(lambda t, up: _block_witnesses(t, up, bits), _WITNESSES)
        )
    return found


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with `index`, from 0 in each tree, and `total`, the rows of their tree.

    Sorted by ranges into files; only the counts of (file, tree) are added up, and a tree that fills
    most of the table is spread over as many files as any other.
    """
    keys = [tree, *order]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = stash(laid.withColumn("place", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("place", 33))
    earlier = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = laid.groupBy(tree, "part").agg(F.min("place").alias("from"), F.count("*").alias("n"))
    starts = runs.select(
        tree,
        "part",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("from")).alias("shift"),
        F.sum("n").over(Window.partitionBy(tree)).alias("total"),
    )
    return (
        laid.join(as_small(starts, SENT_ROWS), [tree, "part"])
        .withColumn("index", F.col("place") + F.col("shift"))
        .drop("place", "part", "shift")
    )


def manifest(
    rows: DataFrame, digest: Column, tree: Column, order: list[str], carry: dict[str, Column], bits: int | None = None
) -> DataFrame:
    """One row for each row of `rows`: the carried columns, leaf, index, witness, subroot and root.

    `digest` is the leaf of a row, `tree` the text that names its tree. Leaves of a tree ascend by
    `order` (nulls first) and then by digest, so that rows repeated as a whole count as often as
    they occur and ties need no other order. While a level has several nodes, every two consecutive
    ones become the SHA-256 of their hex digests, a last one without a partner that of its own; a
    lone leaf is its tree's subroot. Subroots ordered by tree (null first, by UTF-8 bytes) give the
    root in the same way. `witness` lists the siblings level by level from leaf to root as `l` or
    `r`, the side, and the digest; an empty text stands for a level without one. An empty table
    gives no rows. Columns of `rows` that are not carried play no part, whatever their names.
    """
    bits = bits or BLOCK_BITS
    own = [F.col(c).alias(f"order_{i}") for i, c in enumerate(order)]
    kept = F.struct(*[c.alias(name) for name, c in carry.items()]).alias("carried")
    # The name sorts as the tree does: `-` stands before `=`.
    name = F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-"))
    leaves = stash(rows.select(name.alias("tree"), *own, digest.alias("digest"), kept).withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = stash(numbered(leaves, "tree", [f"order_{i}" for i in range(len(order))] + ["digest", "row"]), "placed")
    below = stash(witnesses(placed.select("tree", "index", "digest", "total"), bits), "witnesses")
    subroots = below.where("index = 0").select(F.lit("").alias("all"), "tree", F.col("root").alias("digest"))
    forest = numbered(subroots, "all", ["tree"]).select("tree", F.col("all").alias("above"), "index", "digest", "total")
    forest = stash(forest, "subroots")
    upper = witnesses(forest.select(F.col("above").alias("tree"), "index", "digest", "total"), bits)
    upper = upper.select("index", F.col("witness").alias("upper"), F.col("root").alias("top"))
    tops = as_small(forest.select("tree", "index").join(upper, "index").select("tree", "upper", "top"), SENT_ROWS)
    return (
        placed.join(below, ["tree", "index"])
        .join(tops, "tree")
        .select(
            "carried.*",
            F.col("digest").alias("leaf"),
            "index",
            F.concat("witness", "upper").alias("witness"),
            F.col("root").alias("subroot"),
            F.col("top").alias("root"),
        )
    )


def fold(digest: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""

    def step(now: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        text = F.when(F.startswith(sibling, F.lit("l")), F.concat(other, now)).otherwise(F.concat(now, other))
        return F.sha2(text, 256)

    return F.aggregate(witness, digest, step)


def proof_digest(witness: Column) -> Column:
    """SHA-256 of the siblings' digests, from leaf to root."""
    return F.sha2(F.concat_ws("", F.transform(witness, lambda w: F.substring(w, 2, 64))), 256)
