import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from twinframe.llm import exact, simhash, vectors
from twinframe.llm.queries import ORACLES, QUERIES
from twinframe.llm.shared import components


def brute_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = cases.WORD.findall(text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)][: len(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, most=4):
    links = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= most]
    root = cases.roots(len(prints), links)
    least = {}
    for r, i in zip(root, ids):
        known = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(known) if known else None
    return [least[r] for r in root]


def test_simhash_against_brute_force(spark):
    rows = cases.documents() + [(100 + i, cases.documents()[7][1] + f" w{i}", "en", "s1", 0) for i in range(12)]
    docs = cases.table(spark, rows).withColumn("fp", F.lit("mine")).withColumn("root", F.lit(1)).withColumn("key", F.lit(1))
    found = simhash.near_duplicates(docs).select("id", simhash.hex_digits(F.col("fp")).alias("fp"), "component_id").collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    least = brute_components(prints, [r[0] for r in rows])
    expected = sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(rows, prints, least))
    assert sorted((str(r.id), r.fp, str(r.component_id)) for r in found) == expected

    kept = simhash.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(c) for c in least})
    assert kept[0].asDict().keys() == set(docs.columns)


@pytest.mark.parametrize("max_bits", [0, 1, 3, 6])
def test_every_link_of_random_fingerprints_is_found(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    base = rng.integers(-(2**63), 2**63, 60)
    flips = [int(b) ^ simhash.signed(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 8), replace=False))) for b in base for _ in range(3)]
    prints = sorted({int(b) for b in base} | set(flips))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    plan = simhash.choose_partitions(*simhash.bit_statistics(df), max_bits=max_bits)
    assert sum(t + 1 for _, t in plan) == max_bits + 1
    found = {r.fp: r.root for r in simhash.link_components(df, plan, max_bits).collect()}
    links = [(i, j) for i in range(len(prints)) for j in range(i) if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= max_bits]
    root = cases.roots(len(prints), links)
    assert len({(found[p], r) for p, r in zip(prints, root)}) == len(set(root)) == len(set(found.values()))


def test_simhash_of_no_rows(spark):
    assert simhash.near_duplicates(cases.table(spark, [])).count() == 0
    assert simhash.keep_one(cases.table(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[100 + i] for i in range(30)} == {100}
    assert found[301] == 300 and 200 not in found


@pytest.mark.parametrize("table_bytes", [1, 2_000, exact.TABLE_BYTES])
def test_exact_against_brute_force(spark, table_bytes):
    rows = cases.documents()
    docs = cases.table(spark, rows).withColumn("n", F.lit("x")).withColumn("hash", F.lit("y")).repartition(3)
    found = exact.deduplicate(docs, table_bytes=table_bytes).collect()
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for b, r in zip(body, rows):
        groups.setdefault(b, []).append(r[0])
    expected = []
    for b, r in zip(body, rows):
        ids = [i for i in groups[b] if i is not None]
        expected.append((str(r[0]), str(min(ids) if ids else None), len(groups[b]), hashlib.sha256(b.encode()).hexdigest()))
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == sorted(expected)
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.id == r.keep_id for r in found if r.kept)


def test_tables_compare_contents_when_hashes_collide():
    rows = [(7, b"a%d" % (i % 50), i) for i in range(200)]
    seen = {}
    for table, members in exact.grace(iter(rows), table_bytes=500):
        for entry, i in members:
            assert seen.setdefault(table.contents[entry], i % 50) == i % 50
    assert len(seen) == 50


def test_exact_of_no_rows(spark):
    assert exact.deduplicate(cases.table(spark, [])).count() == 0


def test_exact_agrees_with_sql(spark, sf, duck):
    found = QUERIES["op4_exact"](spark, sf)
    cursor = duck.execute(ORACLES["op4_exact"])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r) for r in found.select(*names).collect()) == sorted(cursor.fetchall())


def brute_vectors(rows, least=0.95):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, dtype=np.float64)
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least
    ]
    count = [sum(i in link for link in links) for i in range(len(rows))]
    root = cases.roots(len(rows), links)
    least_id = {}
    for r, (i, _) in zip(root, rows):
        least_id[r] = min(least_id.get(r, i), i)
    return sorted((i, c, least_id[r], i == least_id[r]) for (i, _), c, r in zip(rows, count, root))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.18, size=16)).astype(np.float32).tolist()) for i in range(90)]
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300, [2 * x for x in rows[1][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16), (405, [float("inf")] * 16)]
    rows += [(500, rows[0][1][:8]), (501, rows[0][1][:8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("tile", F.lit(1))
    found = vectors.near_duplicates(df, tile=20).collect()
    assert sorted(tuple(r) for r in found) == brute_vectors(rows)


def test_vectors_of_one_id_and_of_none(spark):
    """Links belong to vectors, not to ids; a component is named by its smallest id, null if it has none."""
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, c), (None, near(c)), (9, [0.0, 0.0, 0.0, 1.0]), (None, None), (7, near(near(a)))]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    expected = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (7, 2, 1, False), (9, 0, 9, True)]
    expected += [(None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, expected))


def test_bounds_never_miss_a_pair():
    rng = np.random.default_rng(5)
    x = vectors.unit_rows(rng.normal(size=(300, 8)))
    for least in (0.5, 0.9, 0.99):
        found = {(i, j) for a, b in vectors.tile_links(x, x, least, True) for i, j in zip(a.tolist(), b.tolist())}
        real = {(i, j) for i, j in zip(*np.nonzero(np.einsum("ik,jk->ij", x, x) >= least)) if i < j}
        assert found == real


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
