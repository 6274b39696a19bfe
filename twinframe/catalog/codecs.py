"""Generator input and output codecs (E14 to E27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.catalog.encoding import sql_code, sql_codes, sql_minmax, sql_std
from twinframe.operators import codec as cd

OF = fx.ORDER_FACTS
PARTS = fx.PARTS
CAT = fx.ORDER_CAT
NATIONS = (
    "named AS (SELECT c_custkey AS row_id, c_acctbal, n_name, c_mktsegment FROM customer JOIN nation ON "
    "c_nationkey = n_nationkey)"
)
NAMED_CAT = ["n_name", "c_mktsegment"]


def named(spark, sf):
    customer, nation = fx.table(spark, sf, "customer"), fx.table(spark, sf, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("row_id"), "c_acctbal", *NAMED_CAT
    )


@query(
    "E14_generator_input",
    f"WITH {OF} SELECT row_id, {sql_std('o_totalprice', 'order_facts')} AS o_totalprice, "
    f"{sql_minmax('c_acctbal', 'order_facts')} AS c_acctbal FROM order_facts",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    out = cd.generator_input(df, cd.fit_generator_scaler(df, ["o_totalprice"]))
    out = cd.generator_input(out, cd.fit_generator_scaler(df, ["c_acctbal"], "min_max"))
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in fx.ORDER_NUM])


@query(
    "E14i_generator_output",
    f"WITH {OF} SELECT row_id, round(o_totalprice, 4) AS o_totalprice, round(c_acctbal, 4) AS c_acctbal FROM order_facts",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    for kind in ("standardize", "min_max"):
        scaler = cd.fit_generator_scaler(df, fx.ORDER_NUM, kind)
        df = cd.generator_output(cd.generator_input(df, scaler), scaler)
    return df.select("row_id", *[F.round(c, 4).alias(c) for c in fx.ORDER_NUM])


@query(
    "E15_type_output",
    f"WITH {OF} SELECT row_id, CAST(round_even(o_totalprice * 0.5, 0) AS INTEGER) AS o_totalprice, "
    "round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE), 4) AS c_acctbal FROM order_facts",
)
def _(spark, sf):
    half = fx.order_facts(spark, sf).withColumn("o_totalprice", F.col("o_totalprice") * 0.5)
    out = cd.type_output(half, ["o_totalprice"], ["c_acctbal"])
    return out.select("row_id", "o_totalprice", F.round(F.col("c_acctbal").cast("double"), 4).alias("c_acctbal"))


DUMMIES = (
    f"WITH {NATIONS}, labels_ AS ("
    + fx.sql_union(
        [
            f"SELECT {i} AS block, '{c}' AS col, v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS width FROM "
            f"(SELECT DISTINCT replace({c}, '_', '#') AS v FROM named)"
            for i, c in enumerate(NAMED_CAT)
        ]
    )
    + "), places AS (SELECT *, row_number() OVER (ORDER BY block, v) AS place FROM labels_)"
)
HOT = "CASE WHEN replace(CASE WHEN col = 'n_name' THEN n_name ELSE c_mktsegment END, '_', '#') = v THEN 1.0 ELSE 0.0 END"


@query(
    "E16_dummies",
    f"{DUMMIES} SELECT row_id, round(c_acctbal, 2) AS c_acctbal, col || '_' || v AS name, CAST({HOT} AS DOUBLE) AS hot "
    "FROM named, places",
)
def _(spark, sf):
    df = named(spark, sf)
    codec = cd.fit_dummies(df, NAMED_CAT)
    long = cd.dummies(df, codec).select("row_id", "c_acctbal", F.posexplode("onehot").alias("place", "hot"))
    names = F.array(*[F.lit(n) for n in codec.names()])
    return long.select("row_id", "c_acctbal", F.element_at(names, F.col("place") + 1).alias("name"), "hot")


@query(
    "E17_block_ends",
    f"{DUMMIES} SELECT col AS \"column\", count(*) AS width, max(place) AS \"end\" FROM places GROUP BY col",
)
def _(spark, sf):
    return cd.block_ends(named(spark, sf), NAMED_CAT)


def soft_scores(df, codec):
    """Hashed scores in [0, 1) for every place of every row, in quarters so that ties happen."""
    n = len(codec.places)
    score = lambda k: F.floor(fx.rnd("soft", F.col("row_id"), k) * 4) / 4
    return df.withColumn("soft", F.transform(F.sequence(F.lit(1), F.lit(n)), score))


SCORES = (
    f"{DUMMIES}, scores AS (SELECT row_id, c_acctbal, place, block, v, col, "
    f"floor({fx.sql_rnd('soft', 'row_id', 'place')} * 4) / 4 AS s FROM named, places), "
    "won AS (SELECT *, row_number() OVER (PARTITION BY row_id, block ORDER BY s DESC, place) = 1 AS w FROM scores)"
)


@query(
    "E18_harden",
    f"{SCORES} SELECT row_id, CAST(place AS BIGINT) AS place, CAST(CASE WHEN w THEN 1 ELSE 0 END AS DOUBLE) AS hot FROM won",
)
def _(spark, sf):
    df = named(spark, sf)
    codec = cd.fit_dummies(df, NAMED_CAT)
    hard = soft_scores(df, codec).select("row_id", F.posexplode(codec.harden("soft")).alias("place", "hot"))
    return hard.withColumn("place", F.col("place").cast("long") + 1)


@query(
    "E19_decode_dummies",
    f"{SCORES} SELECT row_id, any_value(c_acctbal) AS c_acctbal, max(CASE WHEN w AND block = 0 THEN replace(v, '#', '_') "
    "END) AS n_name, max(CASE WHEN w AND block = 1 THEN replace(v, '#', '_') END) AS c_mktsegment FROM won GROUP BY row_id",
)
def _(spark, sf):
    df = named(spark, sf)
    codec = cd.fit_dummies(df, NAMED_CAT)
    return codec.decode(soft_scores(df, codec), "soft")


def _weights(spark, rows):
    return spark.createDataFrame([(n, round(w, 6)) for n, w in rows], "name string, weight double")


IMPORTANCE = (
    "spread AS (SELECT 'o_totalprice' AS c, stddev_pop(o_totalprice) AS s FROM order_facts UNION ALL "
    "SELECT 'c_acctbal', stddev_pop(c_acctbal) FROM order_facts UNION ALL SELECT 'constant', 0.0), "
    "shares AS (SELECT c, s / sum(s) OVER () * count(*) OVER () AS w FROM spread), "
    "lifted AS (SELECT c, CASE WHEN w > 0 THEN w ELSE (SELECT min(w) FROM shares WHERE w > 0) END AS w FROM shares)"
)


@query(
    "E20_column_importance",
    f"WITH {OF}, {IMPORTANCE} SELECT c AS name, round(w, 6) AS weight FROM lifted UNION ALL "
    + fx.sql_union([f"SELECT '{c}', CAST(1.0 AS DOUBLE)" for c in CAT]),
)
def _(spark, sf):
    df = fx.order_facts(spark, sf).withColumn("constant", F.lit(3.0))
    columns = [c for c in df.columns if c != "row_id"]
    return _weights(spark, cd.column_importance(df, columns, CAT).items())


@query(
    "E21_encoded_importance",
    f"WITH {OF}, {IMPORTANCE}, freq AS ("
    + fx.sql_union(
        [
            f"SELECT '{c}' || '_' || replace({c}, '_', '#') AS name, count(*) / (SELECT count(*) FROM order_facts) AS p "
            f"FROM order_facts GROUP BY {c}"
            for c in CAT
        ]
    )
    + "), dev AS (SELECT name, sqrt(p * (1 - p)) AS s FROM freq), allw AS (SELECT name, s / sum(s) OVER () * count(*) "
    "OVER () AS w FROM dev UNION ALL SELECT c, w FROM lifted) SELECT name, round(w / sum(w) OVER () * count(*) OVER (), 6) "
    "AS weight FROM allw",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf).withColumn("constant", F.lit(3.0))
    return _weights(spark, cd.encoded_importance(df, cd.fit_dummies(df, CAT)))


@query(
    "E22_row_weights",
    f"WITH {OF} SELECT row_id, round(o_totalprice / (SELECT sum(o_totalprice) FROM order_facts) * 1000000, 6) AS weight, "
    "round(1000000.0 / (SELECT count(*) FROM order_facts), 6) AS uniform FROM order_facts",
)
def _(spark, sf):
    out = cd.row_weights(cd.row_weights(fx.order_facts(spark, sf), "o_totalprice"), None, "uniform")
    return out.select("row_id", *[F.round(F.col(c) * 1e6, 6).alias(c) for c in ("weight", "uniform")])


def sql_whole(c: str, source: str = "parts") -> str:
    lo, hi = f"(SELECT CAST(min({c}) AS DOUBLE) FROM {source})", f"(SELECT CAST(max({c}) AS DOUBLE) FROM {source})"
    part = f"(CAST({c} AS DOUBLE) - {lo}) / ({hi} - {lo}) * CAST(4294967295 AS DOUBLE)"
    return f"CAST(trunc({part}) AS BIGINT)"


def sql_first_seen(columns: list[str], source: str) -> str:
    return "seen AS (" + fx.sql_union(
        [
            f"SELECT '{c}' AS col, {c} AS value, row_number() OVER (ORDER BY min(row_id)) - 1 AS code, "
            f"greatest(1, CAST(ceil(log2(count(*) OVER ())) AS INTEGER)) AS size FROM {source} GROUP BY {c}"
            for c in columns
        ]
    ) + ")"


def sql_cat_bits(c: str) -> str:
    return f"(SELECT lpad(bin(code), size, '0') FROM seen WHERE col = '{c}' AND value = t.{c})"


def sql_num_bits(c: str) -> str:
    return f"lpad(bin({sql_whole(c)}), 32, '0')"


SEEN = f"WITH {PARTS}, {sql_first_seen(fx.PART_CAT, 'parts')}"


@query(
    "E23_number_bits",
    f"WITH {PARTS} SELECT row_id, {sql_num_bits('p_size')} AS p_size, {sql_num_bits('p_retailprice')} AS p_retailprice, "
    "repeat('0', 32) AS constant FROM parts",
)
def _(spark, sf):
    df = fx.parts(spark, sf).withColumn("constant", F.lit(5.0))
    return cd.fit_bits(df, [*fx.PART_NUM, "constant"], []).encode(df)


@query(
    "E24_category_bits",
    f"{SEEN}, {fx.sql_unseen('parts', fx.PART_COLS, 'p_brand', 'Brand#2', 'twin')} SELECT row_id, {sql_cat_bits('p_brand')} AS p_brand, {sql_cat_bits('p_type')} AS p_type FROM twin t",
)
def _(spark, sf):
    df = fx.parts(spark, sf)
    return cd.fit_bits(df, [], fx.PART_CAT).encode(fx.with_unseen(df, "p_brand", "Brand#2"))


@query(
    "E25_decode_bits",
    f"WITH {PARTS} SELECT row_id, round({sql_whole('p_size')} / CAST(4294967295 AS DOUBLE) * (SELECT max(p_size) - "
    "min(p_size) FROM parts) + (SELECT min(p_size) FROM parts), 5) AS p_size, p_brand, p_type FROM parts",
)
def _(spark, sf):
    df = fx.parts(spark, sf).select("row_id", "p_size", *fx.PART_CAT)
    codec = cd.fit_bits(df, ["p_size"], fx.PART_CAT)
    return codec.decode(codec.encode(df)).withColumn("p_size", F.round("p_size", 5))


@query(
    "E26_row_bits",
    f"{SEEN} SELECT row_id, {sql_num_bits('p_size')} || {sql_num_bits('p_retailprice')} || {sql_cat_bits('p_brand')} || "
    f"{sql_cat_bits('p_type')} AS bits, 64 + (SELECT CAST(sum(s) AS INTEGER) FROM (SELECT max(size) AS s FROM seen GROUP "
    "BY col)) AS row_size FROM parts t",
)
def _(spark, sf):
    df = fx.parts(spark, sf)
    codec = cd.fit_bits(df, fx.PART_NUM, fx.PART_CAT)
    return codec.join_bits(codec.encode(df)).withColumn("row_size", F.lit(codec.row_size))


@query(
    "E26_split_bits",
    f"{SEEN} SELECT row_id, {sql_num_bits('p_size')} AS p_size, {sql_num_bits('p_retailprice')} AS p_retailprice, "
    f"{sql_cat_bits('p_brand')} AS p_brand, {sql_cat_bits('p_type')} AS p_type FROM parts t",
)
def _(spark, sf):
    df = fx.parts(spark, sf)
    codec = cd.fit_bits(df, fx.PART_NUM, fx.PART_CAT)
    return codec.split_bits(codec.join_bits(codec.encode(df)))


@query(
    "E27_label_codes",
    f"WITH {OF}, {sql_codes(['o_orderstatus'], 'order_facts')} SELECT row_id, {sql_code('o_orderstatus')} AS o_orderstatus, "
    f"{sql_minmax('o_totalprice', 'order_facts')} AS o_totalprice, (SELECT count(*) FROM codes) AS n_classes FROM "
    "order_facts t",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf).select("row_id", "o_orderstatus", "o_totalprice")
    classes = cd.fit_label(df, "o_orderstatus", "classification")
    out = cd.fit_label(df, "o_totalprice", "regression").transform(classes.transform(df))
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6)).withColumn(
        "n_classes", F.lit(classes.n_classes).cast("long")
    )


@query(
    "E27_label_inverse",
    f"WITH {OF} SELECT row_id, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM order_facts",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf).select("row_id", "o_orderstatus", "o_totalprice")
    classes, target = cd.fit_label(df, "o_orderstatus", "classification"), cd.fit_label(df, "o_totalprice", "regression")
    back = classes.inverse(classes.transform(target.inverse(target.transform(df))))
    return back.withColumn("o_totalprice", F.round("o_totalprice", 4))
