"""Privacy (L): shadow membership, nearest neighbours and disclosure scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe.catalog import query
from twinframe.catalog import fixtures as fx
from twinframe.catalog.encoding import CAT, PAIR_UNSEEN
from twinframe.operators import privacy as pv
from twinframe.operators.encode import fit_joint
from twinframe.operators.neighbours import nearest_distances
from twinframe.session import written

PARTS = fx.PARTS
SHADOWS = 6


def sql_members(source: str, shadows: int = SHADOWS) -> str:
    return (
        f"members AS (SELECT row_id, s AS shadow_id, row_number() OVER (PARTITION BY row_id ORDER BY "
        f"{fx.sql_rnd('0', 'row_id', 's')}, s) <= {shadows // 2} AS is_member FROM {source}, range({shadows}) g(s))"
    )


@query("L1_memberships", f"WITH {PARTS}, {sql_members('parts')} SELECT row_id, shadow_id, is_member FROM members")
def _(spark, sf):
    return pv.memberships(fx.parts(spark, sf), SHADOWS)


@query(
    "L2_shadow_tables",
    f"WITH {PARTS}, {sql_members('parts')} SELECT row_id, shadow_id, {', '.join(fx.PART_COLS)} FROM parts JOIN members "
    "USING (row_id) WHERE is_member",
)
def _(spark, sf):
    df = fx.parts(spark, sf)
    return pv.shadow_tables(df, pv.memberships(df, SHADOWS))


def sql_squared(r: str, s: str, nums: list[str], cats: list[str], source: str) -> str:
    parts = [
        f"power(({r}.{c} - {s}.{c}) / (SELECT max({c}) - min({c}) FROM {source}), 2)" for c in nums
    ] + [
        f"CASE WHEN {r}.{c} = {s}.{c} THEN 0.0 WHEN {s}.{c} = 'UNSEEN' THEN 1.0 ELSE 2.0 END" for c in cats
    ]
    return " + ".join(parts)


NEAREST = (
    f"{PAIR_UNSEEN} SELECT r.row_id, round(sqrt(min({sql_squared('r', 's', fx.ORDER_NUM, CAT, 'real')})){{scale}}, 6) AS "
    "distance FROM real r, twin s GROUP BY r.row_id"
)


def written_pair(spark, sf):
    """`pair_unseen` from joined orders that are written once: fitting, packing and searching each read them again."""
    real, syn = fx.pair(written(fx.order_facts(spark, sf), "order_facts"))
    return real, fx.with_unseen(syn, "c_mktsegment", "BUILDING")


@query("L5_nearest_distance", NEAREST.format(scale=""))
def _(spark, sf):
    real, twin = written_pair(spark, sf)
    out = nearest_distances(real, twin, fit_joint(real, CAT), normalise=False)
    return out.withColumn("distance", F.round("distance", 6))


@query("L6_scaled_distance", NEAREST.format(scale=" / sqrt(5)"))
def _(spark, sf):
    real, twin = written_pair(spark, sf)
    return nearest_distances(real, twin, fit_joint(real, CAT)).withColumn("distance", F.round("distance", 6))


DRAWS = 4
HALVES = "halves AS (" + fx.sql_union(
    [
        f"SELECT CAST({i} AS BIGINT) AS syn_id, row_id, {', '.join(fx.PART_COLS)} FROM (SELECT *, row_number() OVER (ORDER BY "
        f"{fx.sql_rnd(str(i), 'row_id')}, row_id) AS k, count(*) OVER () AS n FROM parts) WHERE k <= n // 2"
        for i in range(DRAWS)
    ]
) + ")"
PART_DIST = (
    f"WITH {PARTS}, {HALVES}, dists AS (SELECT r.row_id, syn_id, sqrt(min("
    f"{sql_squared('r', 's', fx.PART_NUM, fx.PART_CAT, 'parts')})) / sqrt(4) AS d FROM parts r, halves s GROUP BY 1, 2)"
)


@query(
    "L7_mean_distance",
    f"{PART_DIST} SELECT row_id, syn_id % 2 AS shadow_id, round(avg(d), 6) AS dist FROM dists GROUP BY 1, 2",
)
def _(spark, sf):
    df = fx.parts(spark, sf)
    halves = pv.half_samples(df, DRAWS).withColumn("shadow_id", F.col("syn_id") % 2)
    dist = nearest_distances(df, halves, fit_joint(df, fx.PART_CAT), ["shadow_id", "syn_id"])
    return pv.mean_distances(dist, ["row_id", "shadow_id"]).withColumn("dist", F.round("dist", 6))


SCORED = (
    f"{PART_DIST}, {sql_members('parts', DRAWS)}, scored AS (SELECT row_id, abs(avg(CASE WHEN is_member THEN d END) - "
    "avg(CASE WHEN NOT is_member THEN d END)) AS ds FROM dists JOIN members USING (row_id) WHERE syn_id = shadow_id GROUP BY row_id)"
)


def scored(spark, sf):
    df = fx.parts(spark, sf)
    halves = pv.half_samples(df, DRAWS).withColumn("shadow_id", F.col("syn_id"))
    per_shadow = pv.score_shadows(df, halves, pv.memberships(df, DRAWS), fx.PART_CAT)
    return pv.disclosure_scores(per_shadow)


@query("L8_disclosure_score", f"{SCORED} SELECT row_id, round(ds, 6) AS ds FROM scored")
def _(spark, sf):
    return scored(spark, sf).withColumn("ds", F.round("ds", 6))


@query("L9_mds", f'{SCORED} SELECT round(max(ds), 6) AS "MDS" FROM scored')
def _(spark, sf):
    return pv.mds(scored(spark, sf)).select(F.round("MDS", 6).alias("MDS"))


@query(
    "L10_baseline_mds",
    f'{PART_DIST} SELECT round(max(ds), 6) AS "MDS" FROM (SELECT avg(d) AS ds FROM dists GROUP BY row_id)',
)
def _(spark, sf):
    return pv.mds(pv.baseline_scores(fx.parts(spark, sf), fx.PART_CAT, DRAWS)).select(F.round("MDS", 6).alias("MDS"))


@query(
    "L11_discrete_columns",
    f"WITH {PARTS} SELECT 'p_brand,p_type' AS discrete_columns, count(DISTINCT p_brand) + count(DISTINCT p_type) AS n_categories FROM parts",
)
def _(spark, sf):
    from twinframe.operators.encode import categories
    from twinframe.operators.profile import describe

    df = fx.parts(spark, sf)
    columns = describe(df.drop("row_id"), "p_type").discrete_columns
    return categories(df, list(columns)).agg(
        F.lit(",".join(columns)).alias("discrete_columns"), F.count(F.lit(1)).alias("n_categories")
    )


@query("L3_shadow_models")
def _(spark, sf):
    df = fx.parts(spark, sf)
    models = pv.fit_shadows(df, pv.memberships(df, SHADOWS), fx.PART_NUM, fx.PART_CAT)
    return models.correlation().withColumn("corr", F.round("corr", 5))


@query("L4_shadow_samples")
def _(spark, sf):
    df = fx.parts(spark, sf)
    models = pv.fit_shadows(df, pv.memberships(df, SHADOWS), fx.PART_NUM, fx.PART_CAT)
    return pv.sample_shadows(models, df.count() // 2, 2)


@query("L12_privacy_job")
def _(spark, sf):
    scores = pv.evaluate_privacy(fx.parts(spark, sf), fx.PART_NUM, fx.PART_CAT, fx.PART_CAT, shadows=4, draws=2)
    return scores.withColumn("ds", F.round("ds", 6))
