import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import cases
from twinframe.llm import packing, sharding


@lru_cache
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def reference_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_agrees_with_the_tokenizer():
    rng = random.Random(6)
    pool = ["a", "b", " ", "  ", "\n", "\t", "\u00a0", "é", "中", "😀", "\u0301", "'s", "'S", "'ll", "1", "²", "_", "<|endoftext|>", "<|", "%", "\x00", "\u200b", "\x85"]
    encoder = packing.Encoder()
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 14)))
        assert [*encoder.ids(text), 1] == reference_ids(text)
    for text in (" " * 300_000 + "x", "ab" * 50_000, "the of and " * 20_000):
        assert [*encoder.ids(text), 1] == reference_ids(text)


@pytest.mark.parametrize("tokens", [1, 2, 3, 2047, 2048, 2049, 5000, 4096])
def test_pieces_are_the_binary_lengths(tokens):
    pieces = packing.binary_pieces(tokens)
    assert [s for s, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
    assert sum(n for _, n in pieces) == tokens
    assert [n for _, n in pieces] == [2048] * (tokens // 2048) + [1 << b for b in range(10, -1, -1) if tokens % 2048 >> b & 1]


def test_packing_round_trip(spark):
    rows = cases.documents()
    docs = cases.table(spark, rows).withColumn("id", F.lit("x")).withColumn("start", F.lit(1)).repartition(3)
    found = packing.pack(docs, with_ids=True).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in found)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length for r in found)
    docs_found, current = [], []
    for r in sorted(found, key=lambda r: r.sequence_id):
        assert r.start == len(current)
        current += r.ids
        if len(current) == r.doc_tokens:
            docs_found.append((str(r.id), tuple(current)))
            current = []
    assert not current
    assert sorted(docs_found) == sorted((str(r[0]), tuple(reference_ids(r[1]))) for r in rows)
    assert packing.pack(cases.table(spark, [])).count() == 0
    other = packing.pack(docs.limit(5), path=packing.tokenizer_path("byte_bpe_50k.json"))
    assert other.count() == packing.pack(docs.limit(5)).count()


def test_sharding(spark):
    rows = cases.documents()
    docs = cases.table(spark, rows).withColumn("shard", F.lit("x")).withColumn("block", F.lit(1)).repartition(3)
    found = sharding.shard(docs, 5).collect()
    text = {str(r[0]): r[1] for r in rows if r[0] is not None}
    assert len(found) == len(rows)
    for r in found:
        if r.id is not None:
            data = (text[str(r.id)] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert r.grown_shard in (r.shard, 5) and 0 <= r.shard < 5
    for s in range(5):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in found if r.id is None}) == 1 and len({r.shard for r in found if r.id == 5}) == 1
    assert sharding.shard(cases.table(spark, []), 5).count() == 0


def test_jumps_are_even_and_move_only_what_they_must(spark):
    n = 12_000
    for shards in (1, 2, 7, 24):
        at = sharding.jumps(F.col("id"), shards)
        after = sharding.jumps(F.col("id"), shards + 1)
        rows = spark.range(n).select(at.alias("a"), after.alias("b")).collect()
        counts = np.bincount([r.a.shard for r in rows], minlength=shards)
        assert abs(counts - n / shards).max() < 5 * (n / shards) ** 0.5
        moved = sum(r.a.grown != r.a.shard for r in rows)
        assert abs(moved - n / (shards + 1)) < 5 * (n / (shards + 1)) ** 0.5
        assert all(r.a.grown == r.b.shard and r.a.grown in (r.a.shard, shards) for r in rows)
