"""Copula models whose categories are a table: the same rows as with arrays, and columns beyond them."""

from pyspark.sql import functions as F

from twinframe.operators import copula as cp


def _facts(spark):
    row = F.col("row_id")
    return spark.range(6000).withColumnRenamed("id", "row_id").select(
        "row_id",
        (row % 2).alias("side"),
        (F.sqrt(row.cast("double")) * 3).alias("x"),
        F.when(row % 3 == 0, F.lit("hot")).when(row % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("v"), (row * row) % 701)).alias("c"),
        (row % 5).cast("long").alias("d"),
    )


def _fitted(df, keys):
    return cp.fit_copula(df, ["x"], ["c", "d"], keys=keys)


def test_tables_give_the_rows_of_arrays(spark, monkeypatch):
    df = _facts(spark)
    for keys in ([], ["side"]):
        plain = _fitted(df if keys else df.drop("side"), keys)
        monkeypatch.setattr(cp, "MAX_LEVELS", 50)
        monkeypatch.setattr(cp, "CHUNK", 16)
        wide = _fitted(df if keys else df.drop("side"), keys)
        assert set(wide.levels) == {"c"} and not plain.levels
        for a, b in zip(plain.rows, wide.rows):
            assert all(abs(x - y) < 1e-9 for p, q in zip(a["corr"], b["corr"]) for x, y in zip(p, q))
        several = wide.levels["c"].groupBy("model", "chunk").count().where("count > 16")
        assert several.isEmpty()
        mine, theirs = (sorted(map(tuple, cp.sample_copula(m, 700, 2, seed=4).select("row_id", "syn_id", "c", "d").collect())) for m in (wide, plain))
        monkeypatch.undo()
        assert mine == theirs


def test_one_column_of_fifty_thousand(spark):
    rows = spark.range(90_000).withColumnRenamed("id", "row_id")
    value = F.when(F.col("row_id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("row_id") % 75_000))
    df = rows.select("row_id", value.alias("c"), (F.col("row_id") % 97).cast("double").alias("x"))
    models = cp.fit_copula(df, ["x"], ["c"])
    levels = models.levels["c"]
    assert levels.count() == df.select("c").distinct().count() == 50_001
    share = df.groupBy("c").agg((F.count("c") / 90_000).alias("s"))
    off = levels.join(share, levels.value == share.c).agg(F.max(F.abs(F.col("high") - F.col("low") - F.col("s"))), F.count("s")).first()
    assert off[0] < 1e-12 and off[1] == 50_001
    drawn = cp.sample_copula(models, 30_000, seed=1)
    assert drawn.where("c IS NULL").isEmpty() and drawn.join(df, "c", "left_anti").isEmpty()
    hot = drawn.where("c = 'hot'").count() / 30_000
    assert abs(hot - 1 / 3) < 0.01
    assert drawn.select("c").distinct().count() > 14_000
