"""Row selection, joins by position, sampling and set operations (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.operators import clean as cl
from twinframe.operators import rows as rw

OF = fx.ORDER_FACTS
COLS = ", ".join(fx.ORDER_COLS)


def sql_split(source: str, seed: int = 42, share: str = "0.2") -> str:
    """Two-stage split by hash rank, as CTEs ending in `split_rows(row_id, split)`."""
    return (
        f"t1 AS (SELECT *, row_number() OVER (ORDER BY {fx.sql_rnd(f'{seed}-test', 'row_id')}, row_id) AS k, "
        f"ceil(count(*) OVER () * {share}) AS q FROM {source}), "
        f"t2 AS (SELECT *, row_number() OVER (ORDER BY {fx.sql_rnd(f'{seed}-val', 'row_id')}, row_id) AS k2, "
        f"ceil(count(*) OVER () * {share}) AS q2 FROM t1 WHERE k > q), "
        "split_rows AS (SELECT row_id, 'test' AS split FROM t1 WHERE k <= q UNION ALL "
        "SELECT row_id, CASE WHEN k2 <= q2 THEN 'val' ELSE 'train' END FROM t2)"
    )


def sql_stratified(source: str, target: str, seed: str, out: str, share: str = "0.2") -> str:
    """One stratified stage: adds `held` to the rows of a source."""
    return (
        f"{out}_n AS (SELECT {target} AS c, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY 1), "
        f"{out}_e AS (SELECT c, n * ceil(total * {share}) / total AS exact, ceil(total * {share}) AS wanted FROM {out}_n), "
        f"{out}_q AS (SELECT c, floor(exact) + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) "
        f"DESC, c) <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM {out}_e), "
        f"{out} AS (SELECT s.*, row_number() OVER (PARTITION BY s.{target} ORDER BY {fx.sql_rnd(seed, 'row_id')}, "
        f"row_id) <= quota AS held FROM {source} s JOIN {out}_q ON c = s.{target})"
    )


D1 = f"WITH {OF}, {sql_split('order_facts')}"


@query("D1_random_split", f"{D1} SELECT row_id, split FROM split_rows")
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    return rw.two_stage_split(df, "o_totalprice", "regression").select("row_id", "split")


D2 = (
    f"WITH {OF}, {sql_stratified('order_facts', 'o_orderstatus', '42-test', 's1')}, "
    "rest AS (SELECT row_id, o_orderstatus FROM s1 WHERE NOT held), "
    f"{sql_stratified('rest', 'o_orderstatus', '42-val', 's2')}"
)


@query(
    "D2_stratified_split",
    f"{D2} SELECT row_id, 'test' AS split FROM s1 WHERE held UNION ALL "
    "SELECT row_id, CASE WHEN held THEN 'val' ELSE 'train' END FROM s2",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    return rw.two_stage_split(df, "o_orderstatus", "classification").select("row_id", "split")


@query(
    "D3_two_way_split",
    f"WITH {OF}, {sql_stratified('order_facts', 'o_orderpriority', '42-val', 's1')} "
    "SELECT row_id, o_orderpriority, CASE WHEN held THEN 'val' ELSE 'train' END AS split FROM s1",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    return rw.two_way_split(df, "o_orderpriority", "classification").select("row_id", "o_orderpriority", "split")


@query("D4_test_ids", f"{D1} SELECT row_id FROM split_rows WHERE split = 'test'")
def _(spark, sf):
    return rw.split_ids(rw.two_stage_split(fx.order_facts(spark, sf), "o_totalprice", "regression"))


@query(
    "D5_exclude_ids",
    f"{D1} SELECT row_id, {COLS} FROM order_facts WHERE row_id NOT IN (SELECT row_id FROM split_rows WHERE split = 'test')",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    return rw.exclude_ids(df, rw.split_ids(rw.two_stage_split(df, "o_totalprice", "regression")))


@query(
    "D6_select_ids",
    f"WITH {OF} SELECT row_id, {COLS}, row_number() OVER (ORDER BY row_id) - 1 AS row_index FROM order_facts WHERE "
    f"{fx.sql_rnd('member', 'row_id')} < 0.5",
)
def _(spark, sf):
    df = fx.order_facts(spark, sf)
    return rw.select_ids(df, df.where(fx.rnd("member", F.col("row_id")) < 0.5))


@query("D7_attach_columns", f"WITH {OF} SELECT row_id, {COLS} FROM order_facts")
def _(spark, sf):
    return rw.attach_columns(*cl.split_target(fx.order_facts(spark, sf), "o_totalprice"))


@query(
    "D8_append_rows",
    f"WITH {OF}, {fx.sql_pair('order_facts')} SELECT row_id * 2 AS row_id, {COLS} FROM real UNION ALL "
    f"SELECT row_id * 2 + 1, {COLS} FROM syn",
)
def _(spark, sf):
    return rw.append_rows(*fx.pair(fx.order_facts(spark, sf)))


@query(
    "D9_sample_with_replacement",
    f"WITH {OF}, pos AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS p, count(*) OVER () AS n FROM order_facts), "
    "slots AS (SELECT i // 5000 AS draw, i % 5000 AS slot FROM range(15000) t(i)), "
    f"hits AS (SELECT draw, slot, CAST(floor({fx.sql_rnd('boot', 'draw', 'slot')} * (SELECT count(*) FROM order_facts)) "
    f"AS BIGINT) AS p FROM slots) SELECT draw, slot, row_id, {COLS} FROM hits JOIN pos USING (p)",
)
def _(spark, sf):
    return rw.sample_with_replacement(fx.order_facts(spark, sf), 5000, "boot", draws=3)


@query(
    "D10_sample_half",
    f"WITH {OF} SELECT row_id, {COLS} FROM (SELECT *, row_number() OVER (ORDER BY {fx.sql_rnd('half', 'row_id')}, "
    "row_id) AS k, count(*) OVER () AS n FROM order_facts) WHERE k <= n // 2",
)
def _(spark, sf):
    return rw.sample_half(fx.order_facts(spark, sf), "half")


@query(
    "D11_copy_test_split",
    f"{D1} SELECT row_id, o_totalprice, o_orderstatus FROM order_facts JOIN split_rows USING (row_id) WHERE split = 'test'",
)
def _(spark, sf):
    from twinframe.session import scratch_path
    from twinframe.sources import tables as io

    df = fx.order_facts(spark, sf).select("row_id", "o_totalprice", "o_orderstatus")
    source, target = scratch_path(spark, "source"), scratch_path(spark, "derived")
    io.write_splits(rw.two_stage_split(df, "o_totalprice", "regression"), source)
    io.write_table(io.read_table(spark, f"{source}/test"), f"{target}/test")
    return io.read_table(spark, f"{target}/test")


@query(
    "D12_align",
    f"WITH {OF}, {fx.sql_pair('order_facts')}, x AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS position "
    "FROM real), y AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS position FROM syn) SELECT position, "
    "x.row_id AS x_row_id, x.o_totalprice AS x_o_totalprice, y.row_id AS y_row_id, y.o_totalprice AS y_o_totalprice "
    "FROM x JOIN y USING (position)",
)
def _(spark, sf):
    real, syn = fx.pair(fx.order_facts(spark, sf))
    cols = ["row_id", "o_totalprice"]
    return rw.align(real.select(*cols), syn.select(*cols))
