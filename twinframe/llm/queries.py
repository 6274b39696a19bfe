"""The queries op1 to op13: each applies its operator to a whole table and derives the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import bpe, codes, exact, langid, lines, merkle, mixing, packing, quality, sharding, simhash, urls, vectors

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    dictionaries = langid.fit_dictionaries(docs, ~langid.held_out())
    return langid.identify(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id",
        langid.held_out().alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_margin").alias("margin"),
        F.col("lang_accepted").alias("accepted"),
    )


@query("op2_quality")
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels, ~quality.held_out())
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query(
    "op4_exact",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
    FROM n
    """,
)
def op4_exact(spark: SparkSession, sf: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_embeddings")
def op6_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf, "embeddings"), least_cosine=0.95).withColumnRenamed("id", "vec_id")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return packing.pack(docs.select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


#: The rules of the contract.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query("op7_urls")
def op7_urls(spark: SparkSession, sf: str) -> DataFrame:
    """A page's address ends in the id of the document it shows, whose labels are the page's."""
    pages, labels = table(spark, sf, "pages").select("page_id", "url"), table(spark, sf, "labels")
    path = urls.path_of(F.col("url"))
    shown = pages.select(
        urls.host_of(F.col("url")).alias("host"), path.alias("path"), F.try_to_number(F.regexp_extract(path, r"/(\d{1,18})(?:\.\w+)?/?$", 1), F.lit("9" * 18)).cast("long").alias("doc_id")
    )
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    known = shown.join(labels.groupBy("doc_id").agg(F.min(good).alias("good")), "doc_id").select("host", "path", "good")
    return urls.judge(pages, known, URL_RULES).withColumnRenamed("id", "page_id")


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"), shards=24).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query("op10_lines")
def op10_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.deduplicate(docs, least_chars=lines.EVERY_LINE).select(
        "doc_id",
        F.col("line_total").cast("long").alias("line_total"),
        F.col("line_dropped").cast("long").alias("line_dropped"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("kept_crc32"),
    )


#: Fixed value: the reversed polynomial of CRC-32, here in decimal.
_CRC32_SQL = """
xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)
"""
_LEAF_SQL = "sha256(" + " || ".join(
    f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{0}", "text")
) + ")"


@query(
    "op12_manifest",
    f"""
    WITH RECURSIVE leaves AS (
      SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF_SQL.format("n_chars")} AS leaf,
             CASE WHEN {_CRC32_SQL.format("doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF_SQL.format("(n_chars + 1)")}
                  ELSE {_LEAF_SQL.format("n_chars")} END AS claimed
      FROM documents
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY tree) AS n
      FROM leaves
    ), nodes AS (
      SELECT tree, 0 AS level, i, n, leaf AS h FROM placed
      UNION ALL
      SELECT tree, level + 1, i // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i))
      FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2
    ), subroots AS (
      SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
    ), tops AS (
      SELECT 0 AS level, i, n, h FROM subroots
      UNION ALL
      SELECT level + 1, i // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2
    ), walk AS (
      SELECT row, tree, 0 AS level, i, n, claimed AS h, '' AS proof FROM placed
      UNION ALL
      SELECT w.row, w.tree, w.level + 1, w.i // 2, (w.n + 1) // 2,
             sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.i % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
      FROM walk w LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1::BIGINT)
      WHERE w.n > 1
    ), climb AS (
      SELECT w.row, 0 AS level, r.i, r.n, w.h, w.proof FROM walk w JOIN subroots r USING (tree) WHERE w.n = 1
      UNION ALL
      SELECT w.row, w.level + 1, w.i // 2, (w.n + 1) // 2,
             sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.i % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
      FROM climb w LEFT JOIN tops s ON s.level = w.level AND s.i = xor(w.i, 1::BIGINT)
      WHERE w.n > 1
    )
    SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
    FROM placed p JOIN subroots r USING (tree) JOIN climb c ON c.row = p.row AND c.n = 1 CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
    """,
)
def op12_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The claimed leaf is that of a row whose n_chars is one more where 7 divides the checksum of its id."""
    docs = table(spark, sf, "documents")
    digest = merkle.leaf("doc_id", "source", "lang", "n_chars", "text")
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    claimed = F.when(odd, merkle.leaf("doc_id", "source", "lang", F.col("n_chars") + 1, "text")).otherwise(digest)
    carry = {"doc_id": F.col("doc_id"), "claimed": claimed}
    found = merkle.manifest(docs, digest, F.col("lang"), ["doc_id"], carry)
    folded = found.select(
        "doc_id", "leaf", "subroot", "root",
        merkle.proof_digest(F.col("witness")).alias("proof_sha256"),
        merkle.fold(F.col("claimed"), F.col("witness")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """The same by comparing every part with every entry: one table of parts, one codebook a round."""
    nearest = """
    a{n} AS MATERIALIZED (
      SELECT p.vec, p.part, min((d * {entries} + e)::HUGEINT) AS best
      FROM (SELECT p.vec, p.part, b.e, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM parts p JOIN b{n} b ON b.part = p.part) p
      GROUP BY ALL
    )"""
    moved = """
    s{n} AS MATERIALIZED (
      SELECT part, e, list(m ORDER BY place) AS v
      FROM (SELECT a.part, (a.best % {entries})::BIGINT AS e, k.place, floor(sum(p.v[k.place])::DOUBLE / count(*))::BIGINT AS m
            FROM a{n} a JOIN parts p USING (vec, part) CROSS JOIN (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS place) k
            GROUP BY ALL)
      GROUP BY part, e
    ),
    b{m} AS MATERIALIZED (SELECT b.part, b.e, coalesce(s.v, b.v) AS v FROM b{n} b LEFT JOIN s{n} s USING (part, e))"""
    steps = []
    for n in range(rounds + 1):
        steps.append(nearest.format(n=n, entries=entries))
        if n < rounds:
            steps.append(moved.format(n=n, m=n + 1, entries=entries))
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS MATERIALIZED (
      SELECT vec, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v
      FROM kept CROSS JOIN (SELECT unnest(range({parts})) AS part)
    ), b0 AS MATERIALIZED (SELECT part, vec AS e, v FROM parts WHERE vec < {entries}),
    {",".join(steps)},
    coded AS (
      SELECT vec, string_agg(printf('%02x', (best % {entries})::BIGINT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error
      FROM a{rounds} GROUP BY vec
    ), hashed AS (
      SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, place)) AS h
      FROM (SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS place FROM b{rounds})
    )
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
    FROM kept JOIN coded USING (vec) CROSS JOIN hashed
    """


@query("op11_codes", _codes_sql(parts=16, entries=64, rounds=2))
def op11_codes(spark: SparkSession, sf: str) -> DataFrame:
    found, books = codes.compress(table(spark, sf, "embeddings"), parts=16, entries=64, rounds=2, scale=256, carry=["label"])
    return codes.summed_over(found, "label", "error", "label_error").select(
        F.col("id").alias("vec_id"),
        codes.code(F.col("balls")).alias("code"),
        "error",
        "label_error",
        F.lit(codes.fingerprint(books)).alias("codebooks_sha256"),
    )


@query("op13_bpe")
def op13_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.encode(docs, with_decoded=True).select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
