import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import codes
from twinframe.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dims=32, seed=4):
    """Clusters, copies, ties on a coarse grid, and every kind of row that is left out."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    rows = []
    for i in range(n):
        if i % 5 == 0:
            v = [rng.choice([-1.0, 0.0, 0.5]) for _ in range(dims)]
        else:
            v = [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]
        rows.append((i * 3, v, rng.choice([None, 1, 2, 3])))
    rows += [(1, rows[4][1], 1), (5, None, 1), (2, [math.nan] + [0.0] * (dims - 1), 1), (7, [math.inf] * dims, None)]
    rows += [(8, [None] + [0.0] * (dims - 1), 2), (10, [0.0] * dims, 2), (10, [0.0] * dims, 2), (None, [0.5] * dims, 2), (3, rows[2][1], 9)]
    return rows


def brute(rows, parts=16, entries=64, rounds=2):
    """{(id, code, error)} and the codebooks by comparing every part with every entry."""
    kept = [(i, [math.floor(float(np.float32(x)) * 256) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            for k, members in groups.items():
                book[k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    totals = {}
    for _, _, error, label in out:
        totals[label] = totals.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, totals[label], sha) for i, c, e, label in out)


def result(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("n", [300, 5])
def test_codes_against_brute_force(spark, tmp_path, n):
    rows = vectors(n)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("balls", F.lit(1)).withColumn("error", F.lit("y"))
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert result(QUERIES["op11_codes"](spark, str(tmp_path))) == brute(rows)


def test_no_vectors(spark, tmp_path):
    for name, rows in {"none": [], "unusable": [(1, None, 1), (2, [math.nan], None)]}.items():
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert QUERIES["op11_codes"](spark, f"{tmp_path}/{name}").count() == 0


def test_other_lengths_and_large_components_are_not_coded(spark):
    rows = [(1, [0.5] * 6, 1), (2, [0.25] * 6, 1), (3, [1.0] * 5, 1), (4, [1e30] + [0.0] * 5, 1), (5, [], 1)]
    coded, books = codes.compress(spark.createDataFrame(rows, SCHEMA), parts=4)
    assert codes.cuts(6, 4) == [0, 2, 4, 5, 6]
    assert {r.id: r.balls for r in coded.collect()} == {1: [0] * 4, 2: [1] * 4, 3: None, 4: None, 5: None}
    back = coded.select("id", codes.restored(F.col("balls"), books).alias("v")).collect()
    assert {r.id: r.v for r in back} == {1: [0.5] * 6, 2: [0.25] * 6, 3: None, 4: None, 5: None}


def test_balls_skip_work_and_agree_with_all_pairs():
    rng = np.random.default_rng(3)
    middles = rng.integers(-2000, 2000, (64, 4))
    points = middles[rng.integers(0, 64, 5000)] + rng.integers(-60, 60, (5000, 4))
    points[:500] = rng.integers(-3, 3, (500, 4))
    for entries in (middles, rng.integers(-3, 3, (64, 4)), np.zeros((64, 4), dtype=np.int64)):
        book = codes.Codebook(entries)
        every = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        for start in (np.zeros(5000, dtype=np.int64), rng.integers(0, 64, 5000), every.argmin(axis=1)):
            best, least, work = book.assign(points, start)
            assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    _, _, work = codes.Codebook(middles).assign(points[500:], ((points[500:, None, :] - middles[None, :, :]) ** 2).sum(axis=2).argmin(axis=1))
    assert work < 3 * 4500


def test_codes_against_sql(spark, sf, duck):
    expected = sorted(map(tuple, duck.execute(f"SELECT vec_id::VARCHAR, code, error, label_error, codebooks_sha256 FROM ({ORACLES['op11_codes']})").fetchall()))
    assert result(QUERIES["op11_codes"](spark, sf)) == expected
