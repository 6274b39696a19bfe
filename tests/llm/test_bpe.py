import base64
import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import cases
from twinframe.llm import bpe
from twinframe.llm.queries import QUERIES

POOL = ["a", "b", "th", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "é", "中", "😀", "́", "'", "'s", "'S", "'ll", "'l", "'re", "'r", "1", "²", "Ⅷ", "_", "-", "<|endoftext|>", "\x00"]


@lru_cache
def tokenizer():
    lines = open(bpe.ranks_path(), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words(texts):
    found, counts = bpe.cut_words(texts)
    return found.to_pylist(), counts.tolist()


def by_pattern(texts):
    found = [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    return [w.encode() for f in found for w in f], [len(f) for f in found]


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_words_of_every_code_point():
    texts = [f"a{c}a {c} 1{c}1  {c}  !{c}!'{c}\n{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000, 7)])]
    assert words(texts) == by_pattern(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(POOL), max_size=12).map("".join), min_size=1, max_size=4))
def test_words_of_mixed_texts(texts):
    assert words(texts) == by_pattern(texts)


def test_ids_agree_with_the_library():
    rng = random.Random(7)
    texts = ["".join(rng.choices(POOL, k=rng.randint(0, 14))) for _ in range(2000)]
    letters = "etaonisrhdlucmfygpwbvkjxqz"
    texts += ["".join(rng.choices(letters, k=n)) for n in (63, 64, 65, 200, 3000)]
    texts += ["a" * 20_000, "-" * 5_001, "=-" * 700, "ab" * 999, "中文" * 400, " " * 3_000 + "x", "\n" * 777, "é" * 500, "the of and " * 3000]
    own = bpe.Coder(bpe.ranks_path())
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        expected = [tokenizer().encode_ordinary(t) for t in part]
        found = own.encode(part)
        assert [f.tolist() for f in found] == expected
        assert own.decode(found) == [t.encode() for t in part]


def test_long_words_merge_as_short_ones(monkeypatch):
    """Unfinished words go on in further queries, and a full memory is only a matter of time."""
    monkeypatch.setattr(bpe, "SHORT", 1)
    monkeypatch.setattr(bpe, "STEPS", 2)
    monkeypatch.setattr(bpe, "REMEMBERED", 30)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("aabcdeé", k=rng.randint(2, 25))) for _ in range(4)) for _ in range(15)]
    own = bpe.Coder(bpe.ranks_path())
    for text in texts:
        assert own.encode([text])[0].tolist() == tokenizer().encode_ordinary(text)


def test_slices_end_where_words_end():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choices(POOL, k=200))
        parts = list(bpe.slices(text, 20))
        assert "".join(parts) == text and by_pattern(parts)[0] == by_pattern([text])[0]
    assert list(bpe.slices("", 20)) == [""]


def test_query_against_the_library(spark, tmp_path):
    rows = cases.documents()
    docs = cases.table(spark, rows).withColumn("id", F.lit("x")).withColumn("tokens", F.lit(1)).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_bpe"](spark, str(tmp_path)).collect()
    expected = []
    for r in rows:
        ids = np.array(tokenizer().encode_ordinary(r[1] or ""), dtype="<u4")
        expected.append((str(r[0]), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(expected)
    again = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted((r[1] or "").encode() for r in rows)
    cases.table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op13_bpe"](spark, f"{tmp_path}/none").count() == 0


def test_unknown_ids_decode_to_null(spark):
    ids = [[0, 1], [50256], [], None]
    rows = [(k, 0, None if i is None else np.array(i, dtype="<u4").tobytes()) for k, i in enumerate(ids)]
    found = bpe.decode(spark.createDataFrame(rows, "id long, n_tokens long, tokens binary")).collect()
    assert {r.id: r.decoded for r in found} == {0: b'!"', 1: None, 2: b"", 3: None}
