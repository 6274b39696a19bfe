"""Multiple imputation by chained equations with distributed models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twinframe.functions.hashing import rnd
from twinframe.operators.clean import fill_missing
from twinframe.operators.ordering import any_null
from twinframe.session import cut_lineage, scratch_path

DONORS = 5  # observed rows among which a gap draws


def _design(num_cols: list[str], cat_cols: list[str]) -> list:
    """Stages that turn the other columns into one feature vector; unseen categories get a place."""
    stages, inputs = [], [f"_x_{c}" for c in num_cols]
    if cat_cols:
        stages = [
            StringIndexer(inputCols=[f"_x_{c}" for c in cat_cols], outputCols=[f"_i_{c}" for c in cat_cols], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"_i_{c}" for c in cat_cols], outputCols=[f"_h_{c}" for c in cat_cols], handleInvalid="keep"),
        ]
        inputs += [f"_h_{c}" for c in cat_cols]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="_features")]


def _ranks(rows: DataFrame) -> DataFrame:
    """(tid, value, p, rank) of (tid, value, p, tie): how many rows with a value come before each, by (p, tie).

    Sorted by ranges into files; only the counts of files are added up.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "donors")
    laid = rows.repartitionByRange("p", "tie").sortWithinPartitions("p", "tie")
    laid.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    known = F.col("value").isNotNull().cast("long")
    laid = spark.read.parquet(path).withColumn("part", F.shiftright("place", 33))
    # One row for each file.
    parts = laid.groupBy("part").agg(F.sum(known).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    return laid.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select(
        "tid", "value", "p", (F.col("before") + F.sum(known).over(upto) - known).alias("rank")
    )


def donors(rows: DataFrame, seed: str, donors_of_gap: int = DONORS) -> DataFrame:
    """(tid, donated): for each row without a value, that of one of the rows with the nearest predictions.

    `rows` holds (tid, value, p). Rows with a value are numbered by prediction, equal predictions by
    a hash, among which the gaps stand by their own hash. A gap meets the `donors_of_gap` rows on
    either side by number, one equality join however many predictions are equal; of the nearest of
    them, by distance and then by number, one is drawn by hash. Where no row has a value, none is donated.
    """
    placed = cut_lineage(_ranks(rows.withColumn("tie", rnd(f"{seed}-tie", F.col("tid")))))
    given = placed.where("value is not null").select(F.col("rank").alias("number"), F.col("value").alias("donated"), F.col("p").alias("q"))
    gaps = placed.where("value is null").select("tid", "p", "rank")
    around = F.sequence(F.col("rank") - donors_of_gap, F.col("rank") + (donors_of_gap - 1))
    met = gaps.withColumn("number", F.explode(around)).join(given, "number")
    near = W.partitionBy("tid").orderBy(F.abs(F.col("p") - F.col("q")), "number")
    ranked = met.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= donors_of_gap)
    many = F.count(F.lit(1)).over(W.partitionBy("tid"))
    drawn = ranked.withColumn("drawn", 1 + F.floor(rnd(f"{seed}-donor", F.col("tid")) * many))
    return drawn.where("nth = drawn").select("tid", "donated")


def _impute_number(df: DataFrame, column: str, features: list, row_id: str, seed: str) -> DataFrame:
    """Predictive mean matching: the observed value of a row whose prediction is close to the gap's."""
    target = df.withColumn("_label", F.col(column).cast("double"))
    model = Pipeline(stages=[*features, LinearRegression(featuresCol="_features", labelCol="_label", regParam=1e-6)]).fit(
        target.where(~F.col(f"_gap_{column}"))
    )
    value = F.when(~F.col(f"_gap_{column}"), F.col(column))
    given = donors(model.transform(df).select(F.col(row_id).alias("tid"), value.alias("value"), F.col("prediction").alias("p")), seed)
    given = given.select(F.col("tid").alias(row_id), F.col("donated").alias("_donated"))
    out = df.join(given, row_id, "left")
    filled = F.when(F.col(f"_gap_{column}"), F.coalesce("_donated", column)).otherwise(F.col(column))
    return out.withColumn(column, filled).select(*df.columns)


def _impute_category(df: DataFrame, column: str, features: list, row_id: str, seed: str) -> DataFrame:
    """A draw from the predicted class probabilities."""
    known = df.where(~F.col(f"_gap_{column}"))
    if known.select(column).distinct().limit(2).count() < 2:
        return df
    indexer = StringIndexer(inputCol=column, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep")
    model = Pipeline(
        stages=[indexer, *features, LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=10, regParam=1e-3)]
    ).fit(known)
    labels = F.array(*[F.lit(v) for v in model.stages[0].labels])
    out = model.transform(df).withColumn("_p", F.slice(vector_to_array("probability"), 1, len(model.stages[0].labels)))
    total = F.aggregate("_p", F.lit(0.0), lambda s, v: s + v)
    out = out.withColumn("_u", rnd(seed, F.col(row_id)) * total)
    # Walk along the probabilities until the draw is used up.
    walk = F.aggregate(
        "_p",
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")),
        lambda a, v: F.struct(
            (a["s"] + v).alias("s"), (a["k"] + F.when(a["s"] + v <= F.col("_u"), 1).otherwise(0)).alias("k")
        ),
        lambda a: a["k"],
    )
    drawn = F.get(labels, F.least(walk, F.size(labels) - 1))
    return out.withColumn(column, F.when(F.col(f"_gap_{column}"), drawn).otherwise(F.col(column))).select(*df.columns)


def impute(
    df: DataFrame, num_cols: list[str], cat_cols: list[str], num_iter: int = 10, seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """Every missing cell filled by num_iter rounds of regressions on all other columns.

    Starts from means and modes. In each round every incomplete column, fewest gaps first, is
    fitted on its observed rows and redrawn on its gaps: numbers from donors with close predictions,
    categories from the predicted probabilities, so every filled cell is an observed value of its column. The table is checkpointed per round, so
    the plan does not grow with the rounds. Observed cells are never touched.
    """
    types = {f.name: f.dataType for f in df.schema}
    columns = [*num_cols, *cat_cols]
    gaps = df.agg(*[F.count_if(any_null([c], df)).alias(c) for c in columns]).first().asDict()
    broken = sorted((c for c in columns if gaps[c]), key=lambda c: (gaps[c], c))
    marked = df.withColumns({f"_gap_{c}": any_null([c], df) for c in broken})
    current = fill_missing(marked, [c for c in num_cols if gaps[c]], [c for c in cat_cols if gaps[c]])
    current = cut_lineage(current.withColumns({c: F.col(c).cast(types[c]) for c in num_cols}))
    for i in range(num_iter):
        for c in broken:
            others_num, others_cat = [x for x in num_cols if x != c], [x for x in cat_cols if x != c]
            staged = current.withColumns({f"_x_{x}": F.col(x) for x in [*others_num, *others_cat]})
            features = _design(others_num, others_cat)
            if c in num_cols:
                staged = _impute_number(staged, c, features, row_id, f"{seed}-{i}-{c}")
            else:
                staged = _impute_category(staged, c, features, row_id, f"{seed}-{i}-{c}")
            current = staged.select(*current.columns)
        current = cut_lineage(current)
    return current.select(*df.columns)
