"""Feature scaling and encoding (E1 to E13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.catalog.rows import sql_split
from twinframe.operators import encode as en
from twinframe.operators import rows as rw

OF = fx.ORDER_FACTS
CAT = fx.ORDER_CAT
TRAINED = (
    f"WITH {OF}, {sql_split('order_facts')}, tagged AS (SELECT o.*, split FROM order_facts o JOIN split_rows USING "
    "(row_id)), train AS (SELECT * FROM tagged WHERE split = 'train')"
)
PAIR = f"WITH {OF}, {fx.sql_pair('order_facts')}"
ORDER_SQL_COLS = fx.ORDER_COLS
PAIR_UNSEEN = (
    f"{PAIR}, {fx.sql_unseen('syn', ORDER_SQL_COLS, 'c_mktsegment', 'BUILDING', 'twin')}"
)


def tagged(spark, sf):
    return rw.two_stage_split(fx.order_facts(spark, sf), "o_totalprice", "regression")


def trained(spark, sf):
    df = tagged(spark, sf)
    return df, df.where(F.col("split") == "train").drop("split")


def pair_unseen(spark, sf):
    real, syn = fx.pair(fx.order_facts(spark, sf))
    return real, fx.with_unseen(syn, "c_mktsegment", "BUILDING")


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def sql_std(c: str, source: str) -> str:
    return (
        f"round(({c} - (SELECT avg({c}) FROM {source})) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE "
        f"stddev_pop({c}) END FROM {source}), 6)"
    )


def sql_minmax(c: str, source: str) -> str:
    return f"round(({c} - (SELECT min({c}) FROM {source})) / (SELECT max({c}) - min({c}) FROM {source}), 6)"


def sql_codes(columns: list[str], source: str) -> str:
    """CTE codes(column, value, code)."""
    return "codes AS (" + fx.sql_union(
        [
            f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 "
            f"AS code FROM (SELECT DISTINCT {c} FROM {source})"
            for c in columns
        ]
    ) + ")"


def sql_code(c: str) -> str:
    return f"coalesce((SELECT code FROM codes WHERE col = '{c}' AND value = CAST(t.{c} AS VARCHAR)), -1)"


@query(
    "E1_standard_scale",
    f"{TRAINED} SELECT row_id, split, "
    + ", ".join(f"{sql_std(c, 'train')} AS {c}" for c in fx.ORDER_NUM)
    + ", CAST(0.0 AS DOUBLE) AS constant FROM tagged",
)
def _(spark, sf):
    df, train = trained(spark, sf)
    fixed = lambda t: t.withColumn("constant", F.lit(7.0))
    out = en.scale(fixed(df), en.fit_scaler(fixed(train), [*fx.ORDER_NUM, "constant"]))
    return out.select("row_id", "split", *r6(*fx.ORDER_NUM), "constant")


@query(
    "E2_one_hot",
    f"WITH {OF}, {fx.sql_pair('order_facts')}, "
    f"{fx.sql_unseen('syn', ORDER_SQL_COLS, 'c_mktsegment', 'BUILDING', 'twin')}, {sql_codes(CAT, 'real')}, "
    "long AS ("
    + fx.sql_union([f"SELECT row_id, '{c}' AS \"column\", {c} AS v FROM twin" for c in CAT])
    + ") SELECT row_id, \"column\", CAST(code AS INTEGER) AS place, CAST(CASE WHEN value = v THEN 1 ELSE 0 END AS DOUBLE) "
    'AS hot FROM long JOIN codes ON col = "column"',
)
def _(spark, sf):
    real, twin = pair_unseen(spark, sf)
    levels = en.category_lists(en.categories(real, CAT), CAT)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), en.one_hot(c, levels[c]).alias("block")) for c in CAT])
    long = twin.select("row_id", F.explode(cells).alias("e"))
    return long.select("row_id", F.col("e.column").alias("column"), F.posexplode("e.block").alias("place", "hot"))


@query(
    "E3_feature_assembly",
    f"{TRAINED}, {sql_codes(CAT, 'train')}, width AS (SELECT count(*) AS w FROM codes) SELECT row_id, "
    + ", ".join(f"{sql_std(c, 'train')} AS {c}" for c in fx.ORDER_NUM[1:])
    + f", CAST((SELECT w FROM width) + 1 AS INTEGER) AS width, CAST({len(CAT)} AS DOUBLE) AS ones, "
    + f"{sql_std('o_totalprice', 'train')} AS label FROM tagged",
)
def _(spark, sf):
    df, train = trained(spark, sf)
    coder = en.fit_features(train, ["c_acctbal"], CAT, "o_totalprice", "regression")
    out = coder.transform(df)
    ones = F.aggregate(F.slice("features", 2, coder.width - 1), F.lit(0.0), lambda a, v: a + v)
    return out.select(
        "row_id",
        F.round(F.col("features")[0], 6).alias("c_acctbal"),
        F.size("features").alias("width"),
        ones.alias("ones"),
        F.round("label", 6).alias("label"),
    )


@query(
    "E4_ordinal_target",
    f"{PAIR_UNSEEN}, {sql_codes(['c_mktsegment'], 'real')} SELECT row_id, {sql_code('c_mktsegment')} AS c_mktsegment FROM twin t",
)
def _(spark, sf):
    real, twin = pair_unseen(spark, sf)
    codes = en.categories(real, ["c_mktsegment"])
    return en.ordinal_encode(twin.select("row_id", "c_mktsegment"), ["c_mktsegment"], codes)


@query(
    "E5_standard_scale_target",
    f"{TRAINED} SELECT row_id, split, {sql_std('o_totalprice', 'train')} AS label FROM tagged",
)
def _(spark, sf):
    df, train = trained(spark, sf)
    coder = en.fit_features(train, ["c_acctbal"], CAT, "o_totalprice", "regression")
    return df.select("row_id", "split", F.round(coder.label(), 6).alias("label"))


@query(
    "E6_preprocess",
    f"WITH {OF}, {fx.sql_nulls('order_facts', fx.ORDER_COLS)}, cleaned AS (SELECT row_number() OVER (ORDER BY id) - 1 "
    f"AS row_id, {', '.join(fx.ORDER_COLS)} FROM (SELECT min(row_id) AS id, {', '.join(fx.ORDER_COLS)} FROM holes WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in fx.ORDER_COLS)
    + f" GROUP BY {', '.join(fx.ORDER_COLS)})), {sql_split('cleaned')}, tagged AS (SELECT c.*, split FROM cleaned c JOIN "
    "split_rows USING (row_id)), train AS (SELECT * FROM tagged WHERE split = 'train') SELECT row_id, split, "
    f"{sql_std('c_acctbal', 'train')} AS c_acctbal, {sql_std('o_totalprice', 'train')} AS label FROM tagged",
)
def _(spark, sf):
    from twinframe.plans.jobs import preprocess
    from twinframe.operators.profile import Metadata

    meta = Metadata(("c_acctbal",), tuple(CAT), "o_totalprice", "regression", 0, 5, 0.0)
    out = preprocess(fx.with_nulls(fx.order_facts(spark, sf)), meta)
    return out.select("row_id", "split", F.round(F.col("features")[0], 6).alias("c_acctbal"), F.round("label", 6).alias("label"))


@query(
    "E7_normalise",
    f"WITH {OF} SELECT row_id, {', '.join(CAT)}, "
    + ", ".join(f"{sql_minmax(c, 'order_facts')} AS {c}" for c in fx.ORDER_NUM)
    + " FROM order_facts",
)
def _(spark, sf):
    out = en.normalise(fx.order_facts(spark, sf), fx.ORDER_NUM, "minmax")
    return out.select("row_id", *CAT, *r6(*fx.ORDER_NUM))


TABLE_CODES = sql_codes(["o_orderpriority", "c_mktsegment", "o_orderstatus"], "real")


@query(
    "E8_ordinal_table",
    f"{PAIR_UNSEEN}, {TABLE_CODES} SELECT row_id, o_totalprice, c_acctbal, {sql_code('o_orderpriority')} AS "
    f"o_orderpriority, {sql_code('c_mktsegment')} AS c_mktsegment, {sql_code('o_orderstatus')} AS o_orderstatus FROM twin t",
)
def _(spark, sf):
    real, twin = pair_unseen(spark, sf)
    coder = en.fit_table_coder(real, ["o_orderpriority", "c_mktsegment"], "o_orderstatus", "classification")
    return coder.transform(twin)


@query(
    "E8i_ordinal_inverse",
    f"{PAIR_UNSEEN} SELECT row_id, o_totalprice, c_acctbal, o_orderpriority, CASE WHEN c_mktsegment = 'UNSEEN' THEN NULL "
    "ELSE c_mktsegment END AS c_mktsegment, o_orderstatus FROM twin",
)
def _(spark, sf):
    real, twin = pair_unseen(spark, sf)
    coder = en.fit_table_coder(real, ["o_orderpriority", "c_mktsegment"], "o_orderstatus", "classification")
    coded = coder.transform(twin).withColumn("o_orderstatus", F.col("o_orderstatus") + F.lit(0.25))
    return coder.inverse(coded)


def _pair_scale(kind: str, sql):
    text = fx.sql_union(
        [
            f"SELECT '{side}' AS side, row_id, " + ", ".join(f"{sql(c, 'real')} AS {c}" for c in fx.ORDER_NUM) + f" FROM {side}"
            for side in ("real", "syn")
        ]
    )

    def run(spark, sf):
        real, syn = fx.pair(fx.order_facts(spark, sf))
        fitted = en.fit_scaler(real, fx.ORDER_NUM, kind)
        both = real.withColumn("side", F.lit("real")).unionByName(syn.withColumn("side", F.lit("syn")))
        return en.scale(both, fitted).select("side", "row_id", *r6(*fx.ORDER_NUM))

    return f"{PAIR} {text}", run


_sql, _run = _pair_scale("minmax", sql_minmax)
query("E9_minmax_scale", _sql)(_run)
_sql, _run = _pair_scale("standard", sql_std)
query("E10_standard_variant", _sql)(_run)


@query(
    "E11_quantile_grid",
    f"WITH {OF}, n AS (SELECT greatest(least(count(*) // 30, 1000), 10) AS q, count(*) AS n FROM order_facts), "
    "ranked AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS r FROM order_facts), "
    "grid AS (SELECT k, CAST(k * (n.n - 1) AS DOUBLE) / (q - 1) AS p FROM n, range(1000) t(k) WHERE k < q) "
    "SELECT k, round(a.v + (p - floor(p)) * (coalesce(b.v, a.v) - a.v), 4) AS quantile FROM grid JOIN ranked a ON "
    "a.r = CAST(floor(p) AS BIGINT) LEFT JOIN ranked b ON b.r = CAST(floor(p) AS BIGINT) + 1",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    grid = en.exact_quantiles(df, "o_totalprice", en.quantile_count(df.count()))
    return grid.select("k", F.round("quantile", 4).alias("quantile"))


@query("E11_quantile_normal")
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    grid = en.fit_quantile_grid(df, "o_totalprice")
    return en.quantile_to_normal(df, "o_totalprice", grid, "score").select("row_id", F.round("score", 6).alias("score"))


@query(
    "E12_one_hot_real",
    f"{PAIR_UNSEEN}, {sql_codes(['c_mktsegment'], 'real')}, n AS (SELECT count(*) AS width FROM codes) SELECT row_id, "
    f"CAST({sql_code('c_mktsegment')} AS BIGINT) + 1 AS hot_place, CAST(width AS INTEGER) AS width FROM twin t, n",
)
def _(spark, sf):
    real, twin = pair_unseen(spark, sf)
    joint = en.fit_joint(real.select("row_id", "c_mktsegment"), ["c_mktsegment"])
    block = joint.typed(twin).select("row_id", joint.dense().alias("block"))
    return block.select("row_id", F.array_position("block", F.lit(1.0)).alias("hot_place"), F.size("block").alias("width"))


@query(
    "E13_joint_matrix",
    f"{PAIR_UNSEEN}, {sql_codes(CAT, 'real')}, w AS (SELECT count(*) + 2 AS width FROM codes) SELECT row_id, "
    + ", ".join(f"{sql_minmax(c, 'real')} AS {c}" for c in fx.ORDER_NUM)
    + ", CAST("
    + " + ".join(f"CASE WHEN {sql_code(c)} < 0 THEN 0 ELSE 1 END" for c in CAT)
    + " AS DOUBLE) AS ones, CAST(width AS INTEGER) AS width, CAST(5 AS INTEGER) AS n_features FROM twin t, w",
)
def _(spark, sf):
    real, twin = pair_unseen(spark, sf)
    joint = en.fit_joint(real, CAT)
    rows = joint.typed(twin).select("row_id", joint.dense().alias("v"))
    return rows.select(
        "row_id",
        *[F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate(fx.ORDER_NUM)],
        F.aggregate(F.slice("v", 3, 1000), F.lit(0.0), lambda a, x: a + x).alias("ones"),
        F.size("v").alias("width"),
        F.lit(joint.n_features).alias("n_features"),
    )
