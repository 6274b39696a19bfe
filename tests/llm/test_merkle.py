import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from twinframe.llm import merkle
from twinframe.llm.queries import ORACLES, QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """(root, for each leaf the list of (sibling or None, it is on the left)), level by level."""
    paths, nodes, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        above, members = [], []
        for at in range(0, len(nodes), 2):
            pair = nodes[at : at + 2]
            for side, group in enumerate(under[at : at + 2]):
                for i in group:
                    paths[i].append((pair[1 - side] if len(pair) == 2 else None, side == 1))
            above.append(h(*pair))
            members.append(sum(under[at : at + 2], []))
        nodes, under = above, members
    return nodes[0], paths


def folded(leaf, path):
    for sibling, left in path:
        leaf = h(*([sibling] if sibling and left else []), leaf, *([sibling] if sibling and not left else []))
    return leaf


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) -> sorted result rows of op12."""
    leaf = lambda r, more=0: h(*map(coded, (r[0], r[3], r[2], r[4] + more if r[4] is not None else None, r[1])))
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    grown = {n: tree([leaf(r) for r in trees[n]]) for n in names}
    if not rows:
        return []
    root, tops = tree([grown[n][0] for n in names])
    out = []
    for n, top in zip(names, tops):
        for r, path in zip(trees[n], grown[n][1]):
            path = path + top
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            got = folded(leaf(r, int(odd)), path)
            out.append((str(r[0]), leaf(r), grown[n][0], root, h(*[s for s, _ in path if s]), got, got == root))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_against_brute_force(spark, tmp_path, monkeypatch, bits):
    """Blocks of 2 and 4 leaves make several levels of block roots."""
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    rows = cases.documents()
    docs = cases.table(spark, rows).withColumn("tree", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("index", F.lit(2))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert result(QUERIES["op12_manifest"](spark, str(tmp_path))) == brute(rows)


def test_small_trees(spark, tmp_path):
    for name, rows in {"none": [], "one": cases.documents()[:1], "two": cases.documents()[:2]}.items():
        cases.table(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert result(QUERIES["op12_manifest"](spark, f"{tmp_path}/{name}")) == brute(rows)


def test_frontier_for_every_size():
    for n in range(1, 40):
        leaves = [h(str(i)) for i in range(n)]
        root, paths = tree(leaves)
        frontier = merkle.append_all(leaves, n)
        assert frontier.close() == root
        for i, path in enumerate(paths):
            assert [("l" if left else "r") + s if s else "" for s, left in path] == list(frontier.witness[:, i])


def test_tampering_shows(spark, sf):
    found = QUERIES["op12_manifest"](spark, sf)
    counts = found.agg(
        F.count_if(~F.col("verified") & (F.crc32(F.col("doc_id").cast("string")) % 7 != 0)).alias("clean"),
        F.count_if(F.col("verified") & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)).alias("missed"),
        F.countDistinct("root").alias("roots"),
    ).first()
    assert counts == (0, 0, 1)


def test_manifest_against_sql(spark, sf, duck):
    expected = duck.execute(ORACLES["op12_manifest"]).fetchdf().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES["op12_manifest"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)[list(expected.columns)]
    assert got.astype(str).equals(expected.astype(str))
