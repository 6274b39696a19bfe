"""Near-duplicate detection by SimHash and the generalised pigeonhole principle.

Every text gets a 64-bit fingerprint of its word shingles; fingerprints link when they differ in
few bits. To find the links, bits that vary together are grouped into partitions and each
partition gets a threshold of its own (minus one: not probed) such that thresholds plus one add up
to the distance plus one: two fingerprints within the distance then agree within the threshold in
at least one partition. The thresholds come from dynamic programming over estimated costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, inf

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.shared import components, keeps_names, stash

#: Defaults of the contract: words in a shingle, seed of the hash, differing bits of a link.
SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
#: Shingles hashed at a time, which bounds the memory of a very long text.
BLOCK = 1 << 16
#: Cost of a probe row against that of comparing one candidate, as measured roughly on one core.
PROBE_COST = 8.0


def fingerprint(text: bytes | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of a whole text; zero if it has no word.

    Only A to Z are lower-cased, words end at ASCII blanks, a text of fewer words is one shingle,
    and repeated shingles count as often as they occur.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_in_shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        cuts = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:b], HASH_SEED) for a, b in cuts]), dtype=np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS, text_col: str = "text") -> Column:
    """The fingerprint of every row's text as a column expression."""

    @F.pandas_udf("long")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, words_in_shingle) for t in batch], dtype="int64")

    return hashed(F.col(text_col).cast("binary"))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each pair of bits is set together (64 x 64)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, together = 0, np.zeros((64, 64))
        for batch in batches:
            values = batch["fp"].to_numpy(dtype=np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1)[:, ::-1].astype(np.float32)
            together += bits.T @ bits
            total += len(bits)
        at = np.arange(64 * 64 + 1)
        yield pd.DataFrame({"cell": at, "n": np.append(together.ravel(), total).astype(np.int64)})

    rows = prints.select("fp").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(64 * 64 + 1)
    for row in rows.collect():  # 4097 rows whatever the input
        cells[row["cell"]] = row["n"]
    return int(cells[-1]), cells[:-1].reshape(64, 64)


def group_bits(total: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal size; each bit joins the one whose bits it varies with most."""
    share = np.diag(together) / max(total, 1)
    cov = together / max(total, 1) - np.outer(share, share)
    spread = np.sqrt(np.maximum(np.outer(share * (1 - share), share * (1 - share)), 1e-12))
    likeness = np.abs(cov / spread)
    np.fill_diagonal(likeness, 0.0)
    free, groups = set(range(64)), []
    for p in range(parts):
        size = 64 // parts + (p < 64 % parts)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (likeness[b, rest].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            rest = sorted(free)
            best = max(rest, key=lambda b: (likeness[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def distance_chances(total: int, together: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most t of these bits, t = 0 to `most`."""
    share = np.diag(together)[bits] / max(total, 1)
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for differ in 2 * share * (1 - share):
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    return np.cumsum(chance)[: most + 1].tolist()


def choose_partitions(total: int, together: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition: the cheapest allocation over two to max_bits + 1 partitions.

    A threshold of t costs one probe row for every fingerprint and every change of at most t bits,
    and one comparison for every pair that agrees so far. The allocation of the exact total
    max_bits - partitions + 1 with the lowest sum is found by dynamic programming.
    """
    best, plan = inf, []
    for parts in range(2, max(max_bits + 1, 2) + 1):
        groups = group_bits(total, together, parts)
        # reached[s]: lowest cost so far with thresholds that sum to s (each counted plus one).
        reached = {0: (0.0, [])}
        for group in groups:
            chances = distance_chances(total, together, group, max_bits)
            step = {}
            for used, (cost, taken) in reached.items():
                for t in range(-1, max_bits + 1 - used):
                    probes = sum(comb(len(group), k) for k in range(t + 1))
                    extra = total * probes * PROBE_COST + total * total * chances[t] if t >= 0 else 0.0
                    at = used + t + 1
                    if at not in step or cost + extra < step[at][0]:
                        step[at] = (cost + extra, [*taken, t])
            reached = step
        cost, taken = reached.get(max_bits + 1, (inf, []))
        if cost < best:
            best, plan = cost, [(g, t) for g, t in zip(groups, taken) if t >= 0]
    return plan


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def changes(bits: list[int], most: int) -> list[int]:
    """All masks that flip at most `most` of the bits."""
    return [signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def link_components(prints: DataFrame, plan: list[tuple[list[int], int]], max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) of every distinct fingerprint: connected components under max_bits differing bits.

    First every fingerprint is compared with the smallest and the largest one that equals it in a
    partition: two rows each, however many share the value, and enough to draw groups of copies
    together. Then all probes run and each pair within the distance that is still apart is a
    link; pairs already in one component need no row, so no link between components is lost and
    groups are never spelled out as pairs.
    """
    masks = [signed(sum(1 << b for b in bits)) for bits, _ in plan]
    shared = [F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks]
    keyed = [F.struct(F.lit(i).alias("part"), key.alias("key")) for i, key in enumerate(shared)]

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits

    rows = prints.select("fp", F.inline(F.array(*keyed)))
    ends = (
        rows.groupBy("part", "key")
        .agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
        .where("low != high")
    )
    stars = rows.join(ends, ["part", "key"]).select("fp", F.explode(F.array("low", "high")).alias("hub"))
    first = components(stars.where((F.col("fp") != F.col("hub")) & near("fp", "hub")).select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    drawn = stash(
        prints.join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root")
        ),
        "drawn",
    )
    held = drawn.select("fp", "root", F.inline(F.array(*keyed)))
    def probes(i: int) -> Column:
        bits, most = plan[i]
        flips = F.array(*[F.lit(c).cast("long") for c in changes(bits, most)])
        return F.transform(flips, lambda c: F.struct(F.lit(i).alias("part"), shared[i].bitwiseXOR(c).alias("key")))

    tried = drawn.select(
        F.col("fp").alias("fp2"), F.col("root").alias("root2"), F.inline(F.concat(*map(probes, range(len(plan)))))
    )
    # Both of a pair probe, so one direction is enough.
    found = held.join(tried, ["part", "key"]).where((F.col("root") < F.col("root2")) & near("fp", "fp2"))
    second = components(found.select(F.col("root").alias("a"), F.col("root2").alias("b")))
    return drawn.join(
        second.select(F.col("node").alias("root"), F.col("root").alias("joined")), "root", "left"
    ).select("fp", F.coalesce("joined", "root").alias("root"))


def near_duplicates(
    docs: DataFrame,
    words_in_shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    text_col: str = "text",
    id_col: str = "doc_id",
    **carried: Column,
) -> DataFrame:
    """(id, fp, root, component_id) of every row; component_id is the smallest id of the component.

    Null and blank texts have fingerprint zero and link like any other. Null ids are kept, and a
    component of null ids alone has a null component_id. Repeated rows stay repeated. `carried`
    names further columns that go along.
    """
    extra = [column.alias(name) for name, column in carried.items()]
    print_of = fingerprints(docs, words_in_shingle, text_col)
    printed = stash(docs.select(F.col(id_col).alias("id"), print_of.alias("fp"), *extra), "prints")
    prints = stash(printed.groupBy("fp").agg(F.min("id").alias("first")), "distinct-prints")
    total, together = bit_statistics(prints)
    roots = link_components(prints.select("fp"), choose_partitions(total, together, max_bits), max_bits)
    rooted = stash(prints.join(roots, "fp"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "root", "component_id")
    return printed.join(known, "fp").select("id", "fp", "root", "component_id", *carried)


@keeps_names("_")
def keep_one(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, nulls last.

    Among texts that repeat this id in the group the one with the smallest hash stays, and of
    wholly repeated rows one. Texts are hashed once and read once more to be kept, never shuffled,
    except for the chosen rows that are repeated.
    """
    found = near_duplicates(docs, words_in_shingle, max_bits, mark=F.xxhash64("text"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "n")
    rows = found.groupBy("root", "id", "mark").agg(F.count("*").alias("n"))
    chosen = stash(rows.groupBy("root").agg(F.min(order).alias("row")).select("row.id", "row.mark", "row.n"), "chosen")
    here = docs.withColumn("_mark", F.xxhash64("text"))

    def picked(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("id").alias("_id"), F.col("mark").alias("_key"))
        return here.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_key")), "left_semi")

    single = picked(chosen.where("n = 1"))
    repeated = picked(chosen.where("n > 1")).dropDuplicates(["doc_id", "_mark"])
    return single.unionByName(repeated).select(*docs.columns)


def hex_digits(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
