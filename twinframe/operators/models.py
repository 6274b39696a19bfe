"""Models and metrics for utility: fit on one table, score on another.

Inputs carry (row_id, features array<double>, label). Linear, forest and classification models
are Spark ML estimators with the penalties translated. What Spark ML lacks (the support-vector
regressor, networks with a penalty) is fitted by full gradients: tasks sum them over their rows, the
driver holds the weights only. Ridge over vectors of more than WIDE places keeps the weights in a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from twinframe.operators.ordering import look_up
from twinframe.session import spread, written

MAX_DEPTH = 30  # deepest tree Spark ML grows
HIDDEN = 100  # units of the hidden layer
POLY_DEGREE = 3
FOURIER = 256  # random features standing in for the rbf kernel
TASK_BYTES = 16 << 20  # of mapped features in one task
CLASSES_AT_ONCE = 4  # of few rows, fitted against the rest side by side
SUM_BYTES = 16 << 20  # of partial sums that the driver adds up itself
LANDMARKS = 256  # training rows whose kernel values stand in for a kernel without an explicit map
TOLERANCE = 1e-4  # relative gain of ten gradient steps below which a fit has converged
FLAT = 1e-5  # share of the first slope below which a fit has converged
MEMORY = 10  # past steps that shape the next one
LENGTHS = [1.0, 0.3, 0.05, 3.0]  # lengths of a step that one pass over the data compares
WIDE = 10_000  # places of a vector beyond which the weights of ridge stay in a table
WIDE_STEPS = 100  # conjugate steps of such a fit at most
WIDE_FLAT = 1e-9  # share of the first slope, each place by its own curvature, at which it has converged
ROUNDING = 0.01  # width, in deviations of the label, over which the corner of the loss of `svr` is rounded


# ---- metrics


def regression_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(mse, r2) in one aggregation; r2 of a constant label is 1 when it is met, else 0."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    stats = predictions.agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("spread")
    )
    return stats.select(
        "mse", F.coalesce(1 - F.try_divide("mse", "spread"), F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).alias("r2")
    )


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(f1, accuracy), F1 weighted by class support, from the counts of (label, prediction)."""
    cells = predictions.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    actual = cells.select(F.col("y").alias("class"), "n", F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("long").alias("said"))
    said = cells.select(F.col("p").alias("class"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("said"))
    per_class = actual.unionByName(said).groupBy("class").agg(
        F.sum("n").alias("support"), F.sum("hit").alias("hit"), F.sum("said").alias("said")
    )
    f1 = 2.0 * F.col("hit") / (F.col("support") + F.col("said"))
    return per_class.agg(
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
    )


# ---- models


def as_vectors(df: DataFrame) -> DataFrame:
    """Feature arrays as vectors; sparse vectors pass as they are."""
    dense = isinstance(df.schema["features"].dataType, T.ArrayType)
    features = array_to_vector("features").alias("features") if dense else F.col("features")
    return df.select("row_id", features, F.col("label").cast("double").alias("label"))


def _packed(df: DataFrame) -> DataFrame:
    """Feature vectors without their zeros where that is shorter: products of one-hot blocks are nearly all zeros."""
    first = df.select("features").first()
    if first is None or first["features"] is None:
        return df
    sized = VectorSizeHint(inputCol="features", size=first["features"].size, handleInvalid="optimistic").transform(df)
    packed = VectorAssembler(inputCols=["features"], outputCol="packed", handleInvalid="keep").transform(sized)
    return packed.drop("features").withColumnRenamed("packed", "features")


def _size(train: DataFrame) -> int:
    return max(train.count(), 1)


def ridge(train: DataFrame, test: DataFrame, alpha: float = 1.0, fit_intercept: bool = True, **_) -> DataFrame:
    """Penalised least squares: sum of squares + alpha |w|^2."""
    if _vector_size(train) > WIDE:
        return _wide_ridge(train, test, alpha, fit_intercept)
    stats = train.agg(F.count("label").alias("n"), F.stddev_samp("label").alias("sd")).first()
    model = LinearRegression(
        elasticNetParam=0.0,
        standardization=False,
        solver="l-bfgs",
        fitIntercept=fit_intercept,
        regParam=alpha * (stats["sd"] or 1.0) / stats["n"],
    )
    return model.fit(as_vectors(train)).transform(as_vectors(test)).select("row_id", "label", "prediction")


def _vector_size(df: DataFrame) -> int:
    """Places of the vectors of a table; 0 for arrays, or without a row."""
    row = df.select("features").first() if isinstance(df.schema["features"].dataType, VectorUDT) else None
    return row["features"].size if row and row["features"] is not None else 0


def _cells(df: DataFrame) -> DataFrame:
    """(row_id, label, _row, place, value): a row for each stored number of a vector, one with nulls if there is none.

    `_row` tells the rows apart, as row ids may repeat; it is drawn once and written.
    """
    label = F.col("label").cast("double").alias("label")
    rows = df.select("row_id", label, F.monotonically_increasing_id().alias("_row"), F.unwrap_udt("features").alias("v"))
    places = F.coalesce("v.indices", F.sequence(F.lit(0), F.size("v.values") - 1))  # a dense vector stores no places
    pairs = rows.select("row_id", "label", "_row", F.explode_outer(F.arrays_zip(places.alias("place"), F.col("v.values").alias("value"))).alias("c"))
    return written(pairs.select("row_id", "label", "_row", F.col("c.place").alias("place"), F.col("c.value").alias("value")), "cells")


def _frequent(cells: DataFrame, share: int = 10_000) -> DataFrame:
    """Places that more than one cell in `share` has, fewer than `share` of them, as `look_up` takes them."""
    counts = cells.where("place IS NOT NULL").groupBy(F.col("place").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return written(counts.where(F.col("_n") * share > F.lit(cells.count())).select("_k"), "frequent")


def _wide_ridge(train: DataFrame, test: DataFrame, alpha: float, fit_intercept: bool) -> DataFrame:
    """The same by conjugate steps, each place scaled by its own curvature, on sums that stay in the cluster.

    A step joins the stored numbers with the direction by place, sums them up by row, and the rows' values by
    place. The driver holds a few sums. Where no two places of a row both vary, as with one category column, the
    first step ends at the solution. An intercept is left out by centring all columns in thought.
    """
    label = F.col("label").cast("double")
    shape = train.agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"), F.count_if(label.isNull() | F.isnan(label)).alias("unknown")
    ).first()
    if shape["unknown"]:
        raise ValueError("labels to fit on must not be null or NaN")
    n, middle = shape["n"], shape["mean"] if fit_intercept else 0.0
    cells = _cells(train)
    often = _frequent(cells)
    value = F.col("value")
    sums = cells.where("place IS NOT NULL").groupBy("place").agg(
        (F.sum(value) / n if fit_intercept else F.lit(0.0)).alias("mean"),
        F.sum(value * value).alias("square"),
        F.sum(value * (F.col("label") - middle)).alias("left"),
    )
    curvature = F.col("square") - n * F.col("mean") * F.col("mean")
    # A constant column has no curvature beside an intercept: what rounding leaves of it is none.
    curvature = F.when(curvature > 1e-12 * F.col("square"), curvature).otherwise(0.0) + alpha
    scaled = lambda left: F.when(F.col("curvature") > 0, left / F.col("curvature")).otherwise(0.0)
    state = written(sums.select("place", "mean", curvature.alias("curvature"), F.lit(0.0).alias("weight"), "left"), "ridge")
    state = state.withColumn("move", scaled(F.col("left")))
    slope = first = state.agg(F.sum(F.col("left") * F.col("move"))).first()[0] or 0.0
    for _ in range(WIDE_STEPS):
        if not slope > WIDE_FLAT**2 * first:
            break
        shift = state.agg(F.sum(F.col("mean") * F.col("move"))).first()[0]
        moves = state.select(F.col("place").alias("k"), F.col("move").alias("v"))
        met = look_up(cells.where("place IS NOT NULL").select("_row", "place", "value"), F.col("place"), moves, "move", often=often)
        told = met.select("place", "value", (F.sum(value * F.col("move")).over(W.partitionBy("_row")) - shift).alias("told"))
        bent = told.groupBy("place").agg(F.sum(value * F.col("told")).alias("bent"))
        state = written(state.join(bent, "place").withColumn("bent", F.col("bent") + alpha * F.col("move")), "ridge")
        curve = state.agg(F.sum(F.col("move") * F.col("bent"))).first()[0]
        if not curve > 0:
            break
        length, before = slope / curve, slope
        left = F.col("left") - length * F.col("bent")
        slope = state.agg(F.sum(left * scaled(left))).first()[0]
        weight, move = F.col("weight") + length * F.col("move"), scaled(left) + slope / before * F.col("move")
        state = state.select("place", "mean", "curvature", weight.alias("weight"), left.alias("left"), move.alias("move"))
    intercept = middle - (state.agg(F.sum(F.col("mean") * F.col("weight"))).first()[0] or 0.0)
    weights = state.select(F.col("place").alias("k"), F.col("weight").alias("v"))
    parts = look_up(_cells(test), F.col("place"), weights, "weight")
    scored = parts.groupBy("_row").agg(
        F.first("row_id").alias("row_id"), F.first("label").alias("label"), F.sum(value * F.col("weight")).alias("sum")
    )
    return scored.select("row_id", "label", (F.coalesce("sum", F.lit(0.0)) + intercept).alias("prediction"))


def logistic(train: DataFrame, test: DataFrame, C: float = 1.0, max_iter: int = 100, tol: float = 1e-4, **_) -> DataFrame:
    model = LogisticRegression(
        elasticNetParam=0.0, standardization=False, regParam=1.0 / (C * _size(train)), maxIter=max_iter, tol=tol
    )
    return model.fit(as_vectors(train)).transform(as_vectors(test)).select("row_id", "label", "prediction")


def _forest(cls, n_estimators=100, max_depth=MAX_DEPTH, min_samples_leaf=1, random_state=42, **_):
    return cls(
        numTrees=n_estimators,
        maxDepth=min(max_depth or MAX_DEPTH, MAX_DEPTH),
        minInstancesPerNode=min_samples_leaf,
        seed=random_state,
    )


def forest_regressor(train: DataFrame, test: DataFrame, **params) -> DataFrame:
    model = _forest(RandomForestRegressor, **params)
    return model.fit(as_vectors(train)).transform(as_vectors(test)).select("row_id", "label", "prediction")


def forest_classifier(train: DataFrame, test: DataFrame, **params) -> DataFrame:
    model = _forest(RandomForestClassifier, **params)
    return model.fit(as_vectors(train)).transform(as_vectors(test)).select("row_id", "label", "prediction")


def _kernel_width(train: DataFrame, gamma) -> float:
    """gamma as a number: 'auto' is 1/d, 'scale' is 1/(d Var(x)) over all cells."""
    if not isinstance(gamma, str):
        return float(gamma)
    cells = train.select(F.size("features").alias("d"), F.explode("features").alias("x"))
    row = cells.agg(F.max("d").alias("d"), F.var_pop("x").alias("v")).first()
    return 1.0 / row["d"] if gamma == "auto" else 1.0 / (row["d"] * (row["v"] or 1.0))


def _dealt(df: DataFrame, n: int, width: int) -> DataFrame:
    """The rows in tasks of about TASK_BYTES, as wide as a kernel's map makes them; a table of fewer stays as it is."""
    tasks = math.ceil(n * width * 8 / TASK_BYTES)
    return spread(df, tasks) if tasks > 1 else df


def fourier_features(df: DataFrame, gamma: float, dims: int, seed: int = 0) -> DataFrame:
    """Random cosine features whose inner products approximate the rbf kernel."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=math.sqrt(2 * gamma), size=(dims, FOURIER))
    offsets = rng.uniform(0, 2 * math.pi, FOURIER)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        out = np.sqrt(2.0 / FOURIER) * np.cos(np.stack(x.to_numpy()) @ weights + offsets)
        return pd.Series(list(out))

    return df.withColumn("features", project("features"))


def landmark_features(
    train: DataFrame, tables: list[DataFrame], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], landmarks: int = LANDMARKS
) -> list[DataFrame]:
    """The tables with `features` replaced by a Nystroem map of the kernel, fitted on `train`.

    The landmarks are the training rows with the smallest hashed row ids, at most `landmarks` of
    them; with as many landmarks as rows the map is exact. Only they and their kernel matrix reach
    the driver. Eigenvalues below zero, which a kernel like the sigmoid has, count by their size, so
    that inner products of the map form a kernel; those next to zero are left out.
    """
    chosen = train.select("row_id", "features").orderBy(F.xxhash64("row_id"), "row_id").limit(landmarks).collect()
    points = np.array([row["features"] for row in chosen], dtype=float)
    values, vectors = np.linalg.eigh(kernel(points, points))
    strong = np.abs(values) > 1e-10 * np.abs(values).max()
    lift = vectors[:, strong] / np.sqrt(np.abs(values[strong]))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(kernel(np.stack(x.to_numpy()), points) @ lift))

    return [table.withColumn("features", project("features")) for table in tables]


def svc(train: DataFrame, test: DataFrame, C: float = 1.0, kernel: str = "rbf", gamma="scale", max_iter: int = 50, **_) -> DataFrame:
    """Support-vector classes, one against the rest; kernels as explicit feature maps.

    Random features for `rbf`, an expansion for `poly`, landmarks for `sigmoid`, tanh(gamma x.y).
    """
    if kernel not in ("linear", "poly", "rbf", "sigmoid"):
        raise ValueError(f"kernel {kernel!r} is not known")
    n = _size(train)
    if kernel == "sigmoid":
        width = _kernel_width(train, gamma)
        train, test = landmark_features(train, [_dealt(train, n, LANDMARKS), test], lambda x, y: np.tanh(width * (x @ y.T)))
    if kernel == "rbf":
        width, dims = _kernel_width(train, gamma), len(train.select("features").first()[0])
        train, test = fourier_features(_dealt(train, n, FOURIER), width, dims), fourier_features(test, width, dims)
    a, b = as_vectors(train), as_vectors(test)
    if kernel == "poly":
        a, b = _packed(a), _packed(b)
        expand = PolynomialExpansion(degree=POLY_DEGREE, inputCol="features", outputCol="expanded")
        a, b = (expand.transform(t).drop("features").withColumnRenamed("expanded", "features") for t in (a, b))
    # Each class keeps blocks of its own: several at once only where they are small.
    at_once = CLASSES_AT_ONCE if n * FOURIER * 8 <= 4 * TASK_BYTES else 1
    model = OneVsRest(classifier=LinearSVC(regParam=1.0 / (C * n), maxIter=max_iter, standardization=False), parallelism=at_once)
    # The classes of the test rows play no part in predicting them.
    return model.fit(a).transform(b).select("row_id", "label", "prediction")


def _direction(slope: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quasi-Newton direction from the last steps and the changes of the slope along them."""
    q, kept = slope.copy(), []
    for step, change in reversed(pairs):
        share = (step @ q) / (step @ change)
        kept.append(share)
        q -= share * change
    if pairs:
        step, change = pairs[-1]
        q *= (step @ change) / (change @ change)
    else:
        q /= max(np.linalg.norm(slope), 1e-12)
    for (step, change), share in zip(pairs, reversed(kept)):
        q += (share - (change @ q) / (step @ change)) * step
    return -q


def _as_blocks(train: DataFrame) -> RDD:
    """(x, y): the features and labels of the rows of each batch as bytes, which every pass takes as they are."""

    def packed(batches):
        for batch in batches:
            if len(batch):
                x, y = np.stack(batch["features"].to_numpy()), batch["label"].to_numpy(dtype=float)
                yield pd.DataFrame({"x": [x.astype(float).tobytes()], "y": [y.tobytes()]})

    blocks = train.select("features", "label").mapInPandas(packed, "x binary, y binary")
    return blocks.rdd.map(lambda row: (bytes(row["x"]), bytes(row["y"])))


def _minimise(
    train: DataFrame, weights: np.ndarray, gradient: Callable, steps: int, gain: float = TOLERANCE
) -> tuple[np.ndarray, list[float], int]:
    """Limited-memory quasi-Newton on full gradients: (weights, losses, jobs).

    Each job scores several lengths of one step in one pass over blocks of rows; tasks make one partial sum each,
    one number a weight and length. Sums of more than SUM_BYTES in all are added up in the cluster. Ends after `steps`
    jobs, when the slope has fallen below FLAT times the first one, when ten steps gain less
    than `gain` of the loss, or when no length lowers the loss.
    """
    data = _as_blocks(train).persist(StorageLevel.MEMORY_AND_DISK)
    n = max(data.map(lambda block: len(block[1]) // 8).sum(), 1)

    def scored(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        def partial(blocks):
            sums = [np.zeros(len(points[0]) + 1) for _ in points]
            for values, labels in blocks:
                y = np.frombuffer(labels)
                x = np.frombuffer(values).reshape(len(y), -1)
                for k, point in enumerate(points):
                    loss, slope = gradient(point, x, y)
                    sums[k] += np.append(slope, loss)
            yield np.concatenate(sums)

        parts = data.mapPartitions(partial)
        size = len(points) * (len(points[0]) + 1)
        few = data.getNumPartitions() * size * 8 <= SUM_BYTES
        out = sum(parts.collect(), np.zeros(size)) if few else parts.treeReduce(np.add)
        return [(row[-1] / n, row[:-1] / n) for row in out.reshape(len(points), -1)]

    try:
        (loss, slope), = scored([weights])
        losses, pairs, jobs, first, lengths = [loss], [], 1, np.linalg.norm(slope), LENGTHS
        while jobs < steps and np.linalg.norm(slope) > FLAT * first:
            move = _direction(slope, pairs)
            if move @ slope >= 0:  # no way down: forget the past
                pairs, move = [], -slope / np.linalg.norm(slope)
            tried = scored([weights + t * move for t in lengths])
            jobs += 1
            fine = [k for k, (value, _) in enumerate(tried) if np.isfinite(value) and value <= loss + 1e-4 * lengths[k] * (move @ slope)]
            if not fine:
                if lengths is not LENGTHS:
                    break
                lengths = [t / 1000 for t in LENGTHS]
                continue
            best = min(fine, key=lambda k: tried[k][0])
            step, change = lengths[best] * move, tried[best][1] - slope
            if step @ change > 1e-12:
                pairs = [*pairs, (step, change)][-MEMORY:]
            weights, (loss, slope), lengths = weights + step, tried[best], LENGTHS
            losses.append(loss)
            if len(losses) > 10 and losses[-11] - loss < gain * max(abs(losses[-11]), 1e-12):
                break
    finally:
        data.unpersist()
    return weights, losses, jobs


def _predict(test: DataFrame, function: Callable) -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def predict(x: pd.Series) -> pd.Series:
        return pd.Series(function(np.stack(x.to_numpy())))

    return test.select("row_id", "label", predict("features").alias("prediction"))


def svr(
    train: DataFrame, test: DataFrame, C: float = 1.0, epsilon: float = 0.1, kernel: str = "rbf", gamma="scale", max_iter: int = 200, **_
) -> DataFrame:
    """Epsilon-insensitive regression, |w|^2 / 2 + C sum of losses beyond epsilon.

    The kernel is `linear`, or `rbf` by random features. The corner of the loss is rounded over a
    hundredth of the label's deviation.
    """
    if kernel not in ("linear", "rbf"):
        raise ValueError(f"kernel {kernel!r} has no explicit feature map")
    if kernel == "rbf":
        width, dims = _kernel_width(train, gamma), len(train.select("features").first()[0])
        train, test = fourier_features(_dealt(train, _size(train), FOURIER), width, dims), fourier_features(test, width, dims)
    shape = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("sd"), F.max(F.size("features")).alias("d")).first()
    n, d, corner = max(shape["n"], 1), shape["d"], ROUNDING * (shape["sd"] or 1.0)

    def gradient(w, x, y):
        gap = y - x @ w[:-1] - w[-1]
        beyond = np.maximum(np.abs(gap) - epsilon, 0.0)
        side = -np.sign(gap) * np.minimum(beyond / corner, 1.0)
        penalty = w[:-1] / (C * n)
        loss = np.where(beyond < corner, beyond**2 / (2 * corner), beyond - corner / 2).sum() + len(y) * (w[:-1] @ penalty) / 2
        return loss, np.append(x.T @ side + len(y) * penalty, side.sum())

    w, _losses, _jobs = _minimise(train, np.zeros(d + 1), gradient, max_iter, 1e-6)
    return _predict(test, lambda x: x @ w[:-1] + w[-1])


def mlp_regressor(
    train: DataFrame, test: DataFrame, alpha: float = 1e-4, max_iter: int = 200, random_state: int = 42, **_
) -> DataFrame:
    """One hidden layer of rectified units, squared error, L2 penalty alpha."""
    n, d = _size(train), len(train.select("features").first()[0])
    cuts = np.cumsum([d * HIDDEN, HIDDEN, HIDDEN])
    rng = np.random.default_rng(random_state)
    start = np.concatenate(
        [
            rng.uniform(-1, 1, d * HIDDEN) * math.sqrt(6 / (d + HIDDEN)),
            np.zeros(HIDDEN),
            rng.uniform(-1, 1, HIDDEN) * math.sqrt(6 / (HIDDEN + 1)),
            np.zeros(1),
        ]
    )

    def open_up(w):
        a, b, c, e = np.split(w, cuts)
        return a.reshape(d, HIDDEN), b, c, e[0]

    def forward(w, x):
        a, b, c, e = open_up(w)
        hidden = np.maximum(x @ a + b, 0.0)
        return hidden, hidden @ c + e

    def gradient(w, x, y):
        a, _b, c, _e = open_up(w)
        hidden, out = forward(w, x)
        gap = out - y
        back = np.outer(gap, c) * (hidden > 0)
        share = len(y) / n
        grads = [
            (x.T @ back + share * alpha * a).ravel(),
            back.sum(axis=0),
            hidden.T @ gap + share * alpha * c,
            [gap.sum()],
        ]
        return 0.5 * (gap**2).sum() + share * alpha * ((a * a).sum() + c @ c) / 2, np.concatenate(grads)

    w, _losses, _jobs = _minimise(train, start, gradient, max_iter)
    return _predict(test, lambda x: forward(w, x)[1])


def mlp_classifier(
    train: DataFrame, test: DataFrame, alpha: float = 1e-4, max_iter: int = 200, random_state: int = 42, **_
) -> DataFrame:
    """One hidden layer of rectified units, softmax over the classes, L2 penalty alpha."""
    shape = train.agg(F.count("label").alias("n"), F.max(F.size("features")).alias("d"), F.max("label").alias("top")).first()
    n, d, classes = max(shape["n"], 1), shape["d"], max(int(shape["top"]) + 1, 2)
    cuts = np.cumsum([d * HIDDEN, HIDDEN, HIDDEN * classes])
    rng = np.random.default_rng(random_state)
    start = np.concatenate(
        [
            rng.uniform(-1, 1, d * HIDDEN) * math.sqrt(6 / (d + HIDDEN)),
            np.zeros(HIDDEN),
            rng.uniform(-1, 1, HIDDEN * classes) * math.sqrt(6 / (HIDDEN + classes)),
            np.zeros(classes),
        ]
    )

    def forward(w, x):
        a, b, c, e = np.split(w, cuts)
        hidden = np.maximum(x @ a.reshape(d, HIDDEN) + b, 0.0)
        return hidden, hidden @ c.reshape(HIDDEN, classes) + e

    def gradient(w, x, y):
        a, _b, c, _e = np.split(w, cuts)
        hidden, out = forward(w, x)
        out = out - out.max(axis=1, keepdims=True)
        chance = np.exp(out)
        chance /= chance.sum(axis=1, keepdims=True)
        hit = chance[np.arange(len(y)), y.astype(int)]
        gap = chance
        gap[np.arange(len(y)), y.astype(int)] -= 1.0
        back = (gap @ c.reshape(HIDDEN, classes).T) * (hidden > 0)
        share = len(y) / n
        grads = [(x.T @ back).ravel() + share * alpha * a, back.sum(axis=0), (hidden.T @ gap).ravel() + share * alpha * c, gap.sum(axis=0)]
        loss = -np.log(np.maximum(hit, 1e-300)).sum() + share * alpha * (a @ a + c @ c) / 2
        return loss, np.concatenate(grads)

    w, _losses, _jobs = _minimise(train, start, gradient, max_iter)
    return _predict(test, lambda x: forward(w, x)[1].argmax(axis=1).astype(float))


REGRESSORS = {"ridge": ridge, "svr": svr, "rfr": forest_regressor, "mlpr": mlp_regressor}
CLASSIFIERS = {"logistic": logistic, "svc": svc, "rfc": forest_classifier, "mlpc": mlp_classifier}


def utility_report(
    train: DataFrame, test: DataFrame, task: str, params: dict[str, dict] | None = None, dataset: str = "dataset"
) -> DataFrame:
    """(dataset, model, metric, value) of the four models of a task."""
    models, metrics = (REGRESSORS, regression_metrics) if task == "regression" else (CLASSIFIERS, classification_metrics)
    rows = []
    for name, fit in models.items():
        scores = metrics(fit(train, test, **(params or {}).get(name, {}))).first().asDict()
        rows += [(dataset, name, metric, value) for metric, value in scores.items()]
    return train.sparkSession.createDataFrame(rows, "dataset string, model string, metric string, value double")


def utility_gap(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Difference of two result tables, synthetic minus real, per model and metric."""
    x = real.select("model", "metric", F.col("value").alias("real"))
    y = synthetic.select("model", "metric", F.col("value").alias("synthetic"))
    return x.join(y, ["model", "metric"]).withColumn("gap", F.col("synthetic") - F.col("real"))
