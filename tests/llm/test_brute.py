"""Operators against plain versions of their methods: languages, quality, path templates, jumps."""

import math
import random
import re
from zlib import crc32

import numpy as np
import xxhash
import zstandard
from pyspark.sql import functions as F

from twinframe.llm import langid, quality, sharding, urls
from twinframe.llm.queries import QUERIES



def hashed(*parts):
    """Spark's xxhash64 of 4- and 8-byte whole numbers, unsigned."""
    seed = 42
    for value, width in parts:
        seed = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), seed=seed)
    return seed


def signed(h):
    return h - (1 << 64) if h >> 63 else h


# ---- op1


def letters(text):
    return re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()


def plain_dictionaries(rows):
    """Of each language the 256 documents of smallest hash, 128 characters from a hashed place in each."""
    by_lang = {}
    for doc_id, text, lang in rows:
        if crc32(str(doc_id).encode()) % 4 != 2 and text is not None and lang is not None:
            by_lang.setdefault(lang, []).append((signed(hashed((doc_id, 8))), doc_id, text))
    out = {}
    for lang, found in sorted(by_lang.items(), key=lambda e: (-len(e[1]), e[0])):
        cuts = []
        for h, doc_id, text in sorted(found)[:256]:
            start = h % max(len(text) - 128, 1)
            cuts.append((str(doc_id), letters(text[start : start + 128])))
        out[lang] = " ".join(t for _, t in sorted(cuts) if t).encode()
    return out


def plain_size(data, content):
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    ready = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    ready.precompute_compress(compression_params=params)
    return len(zstandard.ZstdCompressor(dict_data=ready, compression_params=params).compress(data))


def test_languages_are_those_of_the_smallest_sizes(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    dictionaries = plain_dictionaries([tuple(r) for r in rows])
    found = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, sf).collect()}
    assert len(found) == len(rows)
    for r in random.Random(1).sample(rows, 60):
        data = letters(r.text).encode()
        if not data:
            assert found[r.doc_id].lang_pred == "und"
            continue
        sizes = {}
        for lang, content in dictionaries.items():
            sizes[lang] = sum(plain_size(data[i : i + 2048], content) for i in range(0, len(data), 2048))
        best, second = sorted(sizes.values())[:2]
        assert sizes[found[r.doc_id].lang_pred] == best
        assert found[r.doc_id].accepted == ((second - best) / second >= 0.004)


# ---- op2


def test_dual_descent_meets_the_bound_of_its_dual():
    """The hinge-loss objective of the weights found is within a thousandth of a lower bound by projected gradients."""
    rng = random.Random(4)
    words = ["red", "blue", "green", "grey", "pink"]
    texts = [" ".join(rng.choices(words, weights=w, k=15)) for w in ([3, 2, 1, 1, 1], [1, 1, 1, 2, 3]) for _ in range(30)]
    marks = np.array([1.0] * 30 + [-1.0] * 30)
    grams = [quality.gram_places(t) for t in texts]
    ratio = quality.log_count_ratio(grams, marks)
    weights, bias = quality.dual_descent(grams, marks, ratio)
    matrix = np.zeros((60, quality.PLACES + 1))
    for i, g in enumerate(grams):
        matrix[i, g] = ratio[g] / np.sqrt(len(g))
        matrix[i, -1] = 1.0
    signs = matrix * marks[:, None]
    kernel = signs @ signs.T
    dual = np.zeros(60)
    rate = 1.0 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(200_000):
        dual = np.clip(dual + rate * (1.0 - kernel @ dual), 0.0, quality.PENALTY)
    bound = dual.sum() - 0.5 * dual @ kernel @ dual
    w = np.append(weights, bias)
    objective = 0.5 * w @ w + quality.PENALTY * np.maximum(0.0, 1.0 - signs @ w).sum()
    assert bound <= objective + 1e-9 and objective <= bound * 1.001


# ---- op7


def plain_templates(leaves):
    """Templates of (segments, labelled, good) of one host by recursion over whole lists of leaves."""
    names = {i: "" for i in range(len(leaves))}

    def grow(members, level):
        going = [i for i in members if len(leaves[i][0]) > level]
        if not going:
            return
        branches = {}
        for i in going:
            branches.setdefault(leaves[i][0][level], []).append(i)
        total = lambda rows, k: sum(leaves[i][k] for i in rows)
        labelled, good = total(going, 1), total(going, 2)
        if level >= 4 and good in (0, labelled):
            for i in going:
                names[i] += "/**"
            return
        merged = {}
        for segment, rows in branches.items():
            n, g, shown = total(rows, 1), total(rows, 2), "*"
            if len(branches) == 1:
                shown = segment
            elif n:
                share, all_share = g / n, good / labelled
                gain = (share * math.log(share / all_share) if g else 0) + ((1 - share) * math.log((1 - share) / (1 - all_share)) if g < n else 0)
                if math.log(2 * len(branches)) - n * gain <= math.log(0.01):
                    shown = segment
            merged.setdefault(shown, []).extend(rows)
        for shown, rows in merged.items():
            for i in rows:
                names[i] += f"/{shown}"
            grow(rows, level + 1)

    grow(list(names), 0)
    return names


def test_templates_equal_a_plain_tree(spark):
    for seed in range(4):
        rng = random.Random(seed)
        counts = {}
        for _ in range(250):
            path = tuple(rng.choice("abcd" if k < 2 else "xyz") for k in range(rng.randint(0, 7)))
            bad = 0.9 if path[:1] == ("a",) or "z" in path[4:] else 0.1
            labels = [int(rng.random() > bad) for _ in range(rng.choice([0, 0, 3, 12]))]
            counts.setdefault(path, []).extend(labels)
        leaves = [(list(p), len(v), sum(v)) for p, v in counts.items()]
        data = [("h", list(p), g) for p, v in counts.items() for g in [None, *v]]
        pages = spark.createDataFrame(data, "host string, segments array<string>, good int")
        found = {tuple(r.segments): r.template for r in urls.grow_templates(pages).collect()}
        names = plain_templates(leaves)
        assert found == {tuple(p): names[i] for i, (p, _, _) in enumerate(leaves)}
        assert len(set(found.values())) > 3


# ---- op9


def test_jumps_equal_a_plain_walk(spark):
    def walk(key, shards):
        at, ahead = -1, 0
        while ahead < shards:
            at = ahead
            u = ((hashed((sharding.SEED, 4), (key, 8), (at, 8)) >> 11) + 0.5) / (1 << 53)
            ahead = math.floor((at + 1) / u)
        return at

    keys = [*range(-50, 400), 2**62, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    for shards in (1, 3, 24, 100):
        for r in df.select("id", sharding.jumps(F.col("id"), shards).alias("to")).collect():
            assert (r["to"].shard, r["to"].grown) == (walk(r.id, shards), walk(r.id, shards + 1))
