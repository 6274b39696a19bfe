"""Embedding near-duplicates by int8 tile products with error bounds.

Unit vectors are rounded to int8 with one scale each, and the length of the rounding error is kept.
Tiles of vectors are multiplied in int8; the product with the errors of both sides bounds the true
cosine, so only pairs that may pass the threshold are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.shared import components, stash

#: Vectors in a tile.
TILE = 2048
#: Rows multiplied at a time, which bounds the product matrix.
STRIP = 512
#: Slack for rounding in double precision when a bound is compared.
SLACK = 1e-9


def unit_rows(flat: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; scaled by the largest component first, against overflow."""
    rows = flat.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, error): row = scale * int8 + rest, and `error` is the length of the rest."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    rest = unit - codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt((rest * rest).sum(axis=1))


def tile_links(left: np.ndarray, right: np.ndarray, least_cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows with cosine at or above the threshold, strip by strip.

    With x = qx + ex and |x| = |y| = 1: |x.y - qx.qy| <= |ex| |qy| + |x| |ey| <= ex (1 + ey) + ey.
    """
    ql, sl, el = quantise(left)
    qr, sr, er = quantise(right)
    # Products of int8 codes are whole numbers; single precision holds them exactly up to 1040 components.
    kind = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qr = qr.astype(kind)
    for at in range(0, len(left), STRIP):
        part = slice(at, at + STRIP)
        near = (ql[part].astype(kind) @ qr.T) * sl[part, None] * sr[None, :]
        near += el[part, None] * (1 + er[None, :]) + er[None, :]
        i, j = np.nonzero(near >= least_cosine - SLACK)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            real = np.einsum("ij,ij->i", left[a], right[b]) >= least_cosine
            yield a[real], b[real]


def forest(size: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> list[tuple[int, int]]:
    """The links that join two trees; `parent` is updated."""

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def compare_tiles(least_cosine: float):
    """Grouped function over one pair of tiles: link counts and a spanning forest, never the pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = [g for _, g in pdf.groupby("tile", sort=True)]
        same = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        left, right = tiles[0], tiles[-1]
        empty = pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
        if not same and len(tiles) < 2:
            return empty
        x = unit_rows(np.stack(left["embedding"].to_numpy()))
        y = x if same else unit_rows(np.stack(right["embedding"].to_numpy()))
        idl, idr = left["id"].to_numpy(), right["id"].to_numpy()
        nl, nr = left["n"].to_numpy(), right["n"].to_numpy()
        shift = 0 if same else len(x)
        counts, parent, edges = np.zeros(shift + len(y), dtype=np.int64), np.arange(shift + len(y)), []
        for a, b in tile_links(x, y, least_cosine, same):
            np.add.at(counts, a, nr[b])
            np.add.at(counts, b + shift, nl[a])
            edges += forest(len(parent), a, b + shift, parent)
        ids = idl if same else np.concatenate([idl, idr])
        some = np.flatnonzero(counts)
        rows = pd.DataFrame({"id": ids[some], "links": counts[some], "other": ids[some]})
        ends = np.array(edges, dtype=np.int64).reshape(-1, 2)
        joins = pd.DataFrame({"id": ids[ends[:, 0]], "links": 0, "other": ids[ends[:, 1]]})
        return pd.concat([rows, joins], ignore_index=True).astype("int64")

    return run


def near_duplicates(
    vectors: DataFrame,
    least_cosine: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile: int = TILE,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Vectors link when their cosine is at least `least_cosine` (above 0) in double precision.
    Vectors of different lengths never link, nor do vectors that are null, empty, zero or hold a
    null or non-finite component: they get n_links 0 and themselves as component. Equal vectors
    shrink to one first and count as often as they occur; repeated ids are separate vectors. Null
    ids link like others; a component whose ids are all null is named null, and its rows are kept,
    as are rows of a null id among vectors that link with nothing.

    Every pair of tiles is one task of bounded size, so the work is quadratic in the number of
    different vectors, as the method is; what a task returns is linear in its tiles.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    usable = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    marked = rows.withColumn("usable", usable)
    classes = stash(
        # Every class of equal vectors is a node of its own, whatever ids it shares with others.
        marked.where("usable")
        .groupBy("embedding")
        .agg(F.min("id").alias("least"), F.count("*").alias("n"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    tiles = max(1, math.ceil(classes.count() / tile))
    dealt = classes.select(
        "id", "n", "embedding", F.size("embedding").alias("dims"), F.pmod(F.xxhash64("embedding"), F.lit(tiles)).cast("int").alias("tile")
    )
    paired = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        "id", "n", "embedding", "dims", "tile", F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high")
    )
    found = stash(
        paired.groupBy("dims", "low", "high").applyInPandas(compare_tiles(least_cosine), "id long, links long, other long"),
        "tile-links",
    )
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("id != other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    nodes = classes.select("embedding", "id", "n", "least").join(counts, "id", "left").join(
        roots.select(F.col("node").alias("id"), "root"), "id", "left"
    )
    nodes = stash(nodes.withColumn("root", F.coalesce("root", "id")), "nodes")
    # The smallest id of a component; a minimum leaves nulls out.
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = nodes.join(names, "root").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    linked = marked.where("usable").join(known, "embedding").select("id", "n_links", "component_id")
    alone = marked.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
