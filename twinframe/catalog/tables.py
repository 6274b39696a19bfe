"""Sources and sinks (A), profiling (B) and cleaning (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.operators import clean as cl
from twinframe.operators import profile as pf
from twinframe.operators import rows as rw
from twinframe.session import scratch_path
from twinframe.sources import tables as io

OF = fx.ORDER_FACTS
HOLES = f"WITH {OF}, {fx.sql_nulls('order_facts', fx.ORDER_COLS)}"
DOUBLED = f"WITH {OF}, {fx.sql_duplicates('order_facts', fx.ORDER_COLS)}"
COLS = ", ".join(fx.ORDER_COLS)
ANY_NULL = " OR ".join(f"{c} IS NULL" for c in fx.ORDER_COLS)
NO_NULL = " AND ".join(f"{c} IS NOT NULL" for c in fx.ORDER_COLS)


def holes(spark, sf):
    return fx.with_nulls(fx.order_facts(spark, sf))


# ---- A: sources and sinks


@query("A1_table_scan", "SELECT p_partkey AS row_id, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, sf):
    df = io.with_row_id(io.read_table(spark, f"{sf}/part.parquet"), "p_partkey")
    return df.select("row_id", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(
    "A1_csv_scan",
    "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS INTEGER) AS p_size, p_retailprice FROM part",
)
def _(spark, sf):
    path = scratch_path(spark, "part") + ".csv"
    io.write_table(fx.table(spark, sf, "part"), path, "csv")
    return io.read_table(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long"))


def _split_sql(cols: str) -> str:
    return f"SELECT row_id, {cols}, split FROM (SELECT *, CASE WHEN {fx.sql_rnd('s', 'row_id')} < 0.2 THEN 'test' " \
        f"WHEN {fx.sql_rnd('s', 'row_id')} < 0.36 THEN 'val' ELSE 'train' END AS split FROM order_facts)"


@query("A2_load_splits", f"WITH {OF} {_split_sql(COLS)}")
def _(spark, sf):
    u = fx.rnd("s", F.col("row_id"))
    split = F.when(u < 0.2, "test").when(u < 0.36, "val").otherwise("train")
    root = scratch_path(spark, "splits")
    io.write_splits(fx.order_facts(spark, sf).withColumn("split", split), root)
    return io.load_splits(spark, root)


@query("A3_write_tables", f"WITH {OF} SELECT row_id, {COLS} FROM order_facts")
def _(spark, sf):
    path = scratch_path(spark, "sample")
    io.write_table(fx.order_facts(spark, sf), path)
    return io.read_table(spark, path)


@query(
    "A4_results_document",
    f"WITH {OF} SELECT 'order_facts' AS dataset, o_orderstatus AS model, 'mean_price' AS metric, "
    "round(avg(o_totalprice), 2) AS value FROM order_facts GROUP BY o_orderstatus",
)
def _(spark, sf):
    scores = fx.order_facts(spark, sf).groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    rows = io.results_frame(
        spark, [("order_facts", r["o_orderstatus"], "mean_price", r["value"]) for r in scores.collect()]
    )
    path = scratch_path(spark, "results")
    io.write_document(rows, path)
    return io.read_document(spark, path, rows.schema)


@query(
    "A5_read_documents",
    f"WITH {OF} SELECT o_orderpriority AS name, CAST(count(*) AS BIGINT) AS n, round(avg(c_acctbal), 4) AS weight "
    "FROM order_facts GROUP BY o_orderpriority",
)
def _(spark, sf):
    params = fx.order_facts(spark, sf).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("weight")
    )
    path = scratch_path(spark, "params")
    io.write_document(params.withColumnRenamed("o_orderpriority", "name"), path)
    return io.read_document(spark, path).select("name", "n", "weight")


@query(
    "A6_persist_metadata",
    "SELECT 'p_retailprice' AS target_column, 'regression' AS task, CAST(count(*) AS BIGINT) AS N, "
    "CAST(4 AS BIGINT) AS d, 'p_size' AS num_features, 'p_brand,p_type' AS cat_features, "
    "CAST(0.0 AS DOUBLE) AS missing_percentage, CAST(0.2 AS DOUBLE) AS test_size, CAST(42 AS BIGINT) AS random_state "
    "FROM part",
)
def _(spark, sf):
    data = fx.parts(spark, sf).drop("row_id")
    frame = pf.metadata_frame(data, pf.describe(data, "p_retailprice"))
    path = scratch_path(spark, "metadata")
    io.write_document(frame, path)
    return (
        io.read_document(spark, path, frame.schema)
        .withColumn("num_features", F.array_join("num_features", ","))
        .withColumn("cat_features", F.array_join("cat_features", ","))
    )


@query(
    "A7_persist_ids",
    f"WITH {OF} SELECT row_id FROM order_facts WHERE {fx.sql_rnd('s', 'row_id')} < 0.2",
)
def _(spark, sf):
    ids = fx.order_facts(spark, sf).where(fx.rnd("s", F.col("row_id")) < 0.2).select("row_id")
    path = scratch_path(spark, "ids")
    io.write_table(ids, path)
    return io.read_table(spark, path)


# ---- B: profiling


@query("B1_table_shape", f"WITH {OF} SELECT count(*) AS N, CAST(6 AS BIGINT) AS d FROM order_facts")
def _(spark, sf):
    return pf.table_shape(fx.order_facts(spark, sf))


@query(
    "B2_missing_percentage",
    f"{HOLES} SELECT round(avg(CASE WHEN {ANY_NULL} THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_percentage FROM holes",
)
def _(spark, sf):
    return pf.missing_percentage(holes(spark, sf)).select(
        F.round("missing_percentage", 6).alias("missing_percentage")
    )


def _types_sql() -> str:
    """Semantic types of the part and customer columns, joined into one table by hand."""
    number = (
        "CASE WHEN bool_and({c} = floor({c})) AND min({c}) >= 0 AND count(DISTINCT {c}) <= "
        "least(round_even(count(*) / 10, 0), 10) THEN 'categorical' WHEN bool_and({c} = floor({c})) AND "
        "count(DISTINCT {c}) = count(*) THEN 'id' ELSE 'numerical' END"
    )
    text = (
        "CASE WHEN count(DISTINCT {c}) = count(*) THEN 'id' WHEN count(DISTINCT {c}) <= "
        "round_even(count(*) / 5, 0) THEN 'categorical' ELSE 'unknown' END"
    )
    time = "'datetime'"
    rules = [
        ("o_orderkey", number), ("o_custkey", number), ("o_orderstatus", text), ("o_totalprice", number),
        ("o_orderdate", time), ("o_orderpriority", text),
    ]
    return fx.sql_union(
        [
            f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", {rule.format(c=c)} AS sdtype, "
            f"count(DISTINCT {c}) AS n_distinct FROM orders"
            for i, (c, rule) in enumerate(rules)
        ]
    )


ORDER_TABLE = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("B3_semantic_types", _types_sql())
def _(spark, sf):
    return pf.semantic_types(fx.table(spark, sf, "orders").select(*ORDER_TABLE))


@query(
    "B4_feature_lists",
    f"WITH types AS ({_types_sql()}) SELECT CASE WHEN sdtype = 'numerical' THEN 'num_features' ELSE 'cat_features' "
    "END AS role, position, \"column\" FROM types WHERE \"column\" <> 'o_orderstatus' AND sdtype IN "
    "('numerical', 'categorical')",
)
def _(spark, sf):
    types = pf.semantic_types(fx.table(spark, sf, "orders").select(*ORDER_TABLE))
    return pf.feature_lists(types, "o_orderstatus")


@query(
    "B5_infer_task",
    f"WITH types AS ({_types_sql()}) SELECT \"column\" AS target_column, CASE WHEN sdtype = 'numerical' THEN "
    "'regression' ELSE 'classification' END AS task FROM types WHERE \"column\" IN ('o_totalprice', 'o_orderstatus')",
)
def _(spark, sf):
    types = pf.semantic_types(fx.table(spark, sf, "orders").select(*ORDER_TABLE))
    return pf.infer_task(types, "o_totalprice").unionByName(pf.infer_task(types, "o_orderstatus"))


@query(
    "B6_null_positions",
    HOLES + " " + fx.sql_union([f"SELECT row_id, '{c}' AS \"column\", {c} IS NULL AS is_null FROM holes" for c in fx.ORDER_COLS]),
)
def _(spark, sf):
    return pf.null_positions(holes(spark, sf))


@query(
    "B6_null_counts",
    HOLES
    + " "
    + fx.sql_union(
        [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, count(*) AS n_rows FROM holes" for c in fx.ORDER_COLS]
    ),
)
def _(spark, sf):
    return pf.null_counts(holes(spark, sf))


@query(
    "B7_schema_compatibility",
    f"WITH {OF}, {fx.sql_pair('order_facts')} SELECT CAST((SELECT count(*) FROM real) AS BIGINT) AS n_real, "
    "CAST((SELECT count(*) FROM syn) AS BIGINT) AS n_synthetic, true AS compatible",
)
def _(spark, sf):
    real, syn = fx.pair(fx.order_facts(spark, sf))
    shuffled = syn.select(*sorted(syn.columns))
    pf.check_compatible(real, shuffled)
    both = real.select(F.lit(1).alias("r")).unionByName(cl.same_order(real, shuffled).select(F.lit(0).alias("r")))
    return both.agg(
        F.count_if(F.col("r") == 1).alias("n_real"), F.count_if(F.col("r") == 0).alias("n_synthetic")
    ).withColumn("compatible", F.lit(True))


@query(
    "B8_missing_guard",
    f"{HOLES} SELECT 'holes' AS dataset, count(*) > 0 AS has_nulls FROM holes WHERE {ANY_NULL} UNION ALL "
    f"SELECT 'order_facts', count(*) > 0 FROM order_facts WHERE {ANY_NULL}",
)
def _(spark, sf):
    full = fx.order_facts(spark, sf)
    tag = lambda df, name: pf.has_nulls(df).select(F.lit(name).alias("dataset"), "has_nulls")
    return tag(fx.with_nulls(full), "holes").unionByName(tag(full, "order_facts"))


@query(
    "B9_numeric_kinds",
    "SELECT 'integer' AS kind, 'p_size' AS \"column\", CAST(sum(p_size) AS BIGINT) AS whole_sum FROM part UNION ALL "
    "SELECT 'continuous', 'p_retailprice', CAST(sum(floor(p_retailprice)) AS BIGINT) FROM part",
)
def _(spark, sf):
    df = fx.parts(spark, sf).drop("row_id")
    sums = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.floor(c).alias("v")) for c in fx.PART_NUM])
        ).alias("e")
    )
    sums = sums.groupBy(F.col("e.column").alias("column")).agg(F.sum("e.v").alias("whole_sum"))
    return pf.numeric_kinds(df).join(sums, "column")


# ---- C: cleaning and projection


@query("C1_drop_nulls", f"{HOLES} SELECT row_id, {COLS} FROM holes WHERE {NO_NULL}")
def _(spark, sf):
    return cl.drop_nulls(holes(spark, sf))


@query("C2_drop_duplicates", f"{DOUBLED} SELECT min(row_id) AS row_id, {COLS} FROM doubled GROUP BY {COLS}")
def _(spark, sf):
    return cl.drop_duplicates(fx.with_duplicates(fx.order_facts(spark, sf)))


@query(
    "C3_dense_index",
    f"{HOLES} SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS row_index FROM holes WHERE {NO_NULL}",
)
def _(spark, sf):
    return cl.dense_index(cl.drop_nulls(holes(spark, sf)), "row_id").select("row_id", "row_index")


@query(
    "C4_clean",
    f"WITH {OF}, {fx.sql_nulls('order_facts', fx.ORDER_COLS)}, {fx.sql_duplicates('holes', fx.ORDER_COLS)} "
    f"SELECT row_number() OVER (ORDER BY id) - 1 AS row_id, {COLS} FROM (SELECT min(row_id) AS id, {COLS} FROM "
    f"doubled WHERE {NO_NULL} GROUP BY {COLS})",
)
def _(spark, sf):
    return cl.clean(fx.with_duplicates(holes(spark, sf)))


@query(
    "C5_fill_mean",
    f"{HOLES} SELECT row_id, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM holes)), 3) AS o_totalprice, "
    "round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM holes)), 3) AS c_acctbal FROM holes",
)
def _(spark, sf):
    out = cl.fill_missing(holes(spark, sf), fx.ORDER_NUM, [])
    return out.select("row_id", *[F.round(c, 3).alias(c) for c in fx.ORDER_NUM])


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM holes WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "C6_fill_mode",
    f"{HOLES} SELECT row_id, " + ", ".join(f"coalesce({c}, {_mode(c)}) AS {c}" for c in fx.ORDER_CAT) + " FROM holes",
)
def _(spark, sf):
    return cl.fill_missing(holes(spark, sf), [], fx.ORDER_CAT).select("row_id", *fx.ORDER_CAT)


@query("C7_drop_or_fill", f"{HOLES} SELECT row_id, {COLS} FROM holes WHERE {NO_NULL}")
def _(spark, sf):
    df = holes(spark, sf)
    try:
        cl.fill_missing(df, fx.ORDER_NUM, fx.ORDER_CAT, dropna=True, fillna=True)
    except ValueError:
        return cl.fill_missing(df, fx.ORDER_NUM, fx.ORDER_CAT, dropna=True, fillna=False)
    raise AssertionError("dropping and filling at once must be refused")


@query("C8_drop_columns", f"WITH {OF} SELECT row_id, o_totalprice, c_acctbal, o_orderstatus FROM order_facts")
def _(spark, sf):
    return cl.drop_columns(fx.order_facts(spark, sf), ["o_orderpriority", "c_mktsegment"])


@query(
    "C9_split_target",
    f"WITH {OF} SELECT row_id, o_totalprice, c_acctbal, o_orderpriority, c_mktsegment, o_orderstatus AS target "
    "FROM order_facts",
)
def _(spark, sf):
    features, target = cl.split_target(fx.order_facts(spark, sf), "o_orderstatus")
    return rw.attach_columns(features, target.withColumnRenamed("o_orderstatus", "target"))


@query("C10_same_order", f"WITH {OF}, {fx.sql_pair('order_facts')} SELECT row_id, {COLS} FROM syn")
def _(spark, sf):
    real, syn = fx.pair(fx.order_facts(spark, sf))
    return cl.same_order(real, syn.select(*reversed(syn.columns)))


@query(
    "C11_same_types",
    f"WITH {OF}, {fx.sql_pair('order_facts')} SELECT row_id, o_totalprice, CASE WHEN c_acctbal < 0 THEN NULL ELSE "
    "c_acctbal END AS c_acctbal FROM syn",
)
def _(spark, sf):
    real, syn = fx.pair(fx.order_facts(spark, sf))
    text = syn.select(
        "row_id",
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.when(F.col("c_acctbal") < 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
    )
    return cl.same_types(real, text)


@query(
    "C11_cast_failures",
    f"WITH {OF}, {fx.sql_pair('order_facts')} SELECT 'c_acctbal' AS \"column\", count(*) AS n_failed FROM syn WHERE "
    "c_acctbal < 0 UNION ALL SELECT 'row_id', 0 UNION ALL SELECT 'o_totalprice', 0",
)
def _(spark, sf):
    real, syn = fx.pair(fx.order_facts(spark, sf))
    text = syn.select(
        "row_id",
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.when(F.col("c_acctbal") < 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
    )
    return cl.cast_failures(real, text)
