"""Parameter search by seeded random draws, and tables about the trials."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twinframe.operators.models import CLASSIFIERS, REGRESSORS, classification_metrics, regression_metrics

# The ranges searched for each model.
SPACES: dict[str, dict[str, tuple]] = {
    "ridge": {"alpha": ("float", 0.0, 10.0), "fit_intercept": ("choice", [True, False])},
    "logistic": {"max_iter": ("int", 100, 1000), "C": ("log", 1e-5, 1e-1), "tol": ("log", 1e-5, 1e-1)},
    "svr": {"C": ("log", 1e-5, 1e-1), "epsilon": ("log", 1e-5, 1e-1)},
    "svc": {
        "C": ("log", 1e-5, 1e-1),
        "kernel": ("choice", ["linear", "poly", "rbf", "sigmoid"]),
        "gamma": ("choice", ["scale", "auto"]),
    },
    "rfr": {
        "n_estimators": ("int", 10, 200),
        "max_depth": ("int", 4, 64),
        "min_samples_split": ("int", 2, 8),
        "min_samples_leaf": ("int", 1, 8),
    },
    "mlpr": {"max_iter": ("int", 50, 200), "alpha": ("log", 1e-5, 1e-1)},
}
SPACES["rfc"] = SPACES["rfr"]
SPACES["mlpc"] = SPACES["mlpr"]

TRIALS = "number long, params map<string,string>, value double, datetime_start timestamp, datetime_complete timestamp"


def draw(space: dict[str, tuple], number: int, seed: int = 0) -> dict:
    """Parameters of one trial; they depend on the seed, the trial number and the name only."""
    out = {}
    for name, (kind, *rest) in space.items():
        rng = random.Random(f"{seed}|{number}|{name}")
        if kind == "choice":
            out[name] = rng.choice(rest[0])
        elif kind == "int":
            out[name] = rng.randint(*rest)
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(rest[0]), math.log(rest[1])))
        else:
            out[name] = rng.uniform(*rest)
    return out


def run_trials(
    spark: SparkSession, space: dict[str, tuple], objective: Callable[[dict], float], n_trials: int, seed: int = 0, parallelism: int = 2
) -> DataFrame:
    """One row per trial. Trials submit their jobs from a few driver threads; a failure is raised."""

    def one(number):
        params, start = draw(space, number, seed), datetime.now(timezone.utc)
        value = float(objective(params))
        return number, {k: str(v) for k, v in params.items()}, value, start, datetime.now(timezone.utc)

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), range(n_trials)))
    return spark.createDataFrame(rows, TRIALS)


def tune(
    model: str,
    train: DataFrame,
    val: DataFrame,
    n_trials: int = 50,
    seed: int = 0,
    space: dict[str, tuple] | None = None,
    fixed: dict | None = None,
    parallelism: int = 2,
) -> DataFrame:
    """Trials of one model: validation MSE (to minimise) or weighted F1 (to maximise)."""
    regression = model in REGRESSORS
    fit = REGRESSORS[model] if regression else CLASSIFIERS[model]
    # A fixed value takes the place of its range, so that trials record what they used.
    space = {**(space or SPACES[model]), **{name: ("choice", [value]) for name, value in (fixed or {}).items()}}

    def objective(params):
        predictions = fit(train, val, **params)
        return regression_metrics(predictions).first()["mse"] if regression else classification_metrics(predictions).first()["f1"]

    return run_trials(train.sparkSession, space, objective, n_trials, seed, parallelism)


def best_trial(trials: DataFrame, direction: str = "minimise", by: list[str] | None = None) -> DataFrame:
    """(by..., number, value, params) of the best trial; of equal values the lowest number wins.

    `params` is there if the trials have it.
    """
    score = F.col("value") if direction == "minimise" else -F.col("value")
    shown = [c for c in ("number", "value", "params") if c in trials.columns]
    best = F.min_by(F.struct(*shown), F.struct(score, "number")).alias("best")
    return trials.groupBy(*(by or [])).agg(best).select(*(by or []), *[f"best.{c}" for c in shown])


def typed_params(space: dict[str, tuple], params: dict[str, str]) -> dict:
    """Recorded parameters as the values a model takes: numbers as numbers, choices as they were."""
    out = {}
    for name, text in params.items():
        kind, *rest = space[name]
        if kind == "choice":
            out[name] = next(v for v in rest[0] if str(v) == text)
        else:
            out[name] = int(text) if kind == "int" else float(text)
    return out


def merge_trials(parts: DataFrame, worker: str = "worker", number: str = "number") -> DataFrame:
    """One study from several workers: numbered by (worker, local number), gaps closed.

    A trial's number is the count of the workers before it plus its rank within its worker.
    """
    sizes = parts.groupBy(worker).agg(F.count(F.lit(1)).alias("_n"))
    # One row per worker.
    order = W.partitionBy(F.lit(0)).orderBy(worker).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(worker, F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy(worker).orderBy(number)) - 1
    return parts.withColumn("_rank", rank).join(F.broadcast(offsets), worker).withColumn(
        "study_number", F.col("_before") + F.col("_rank")
    ).drop("_before", "_rank")


def timeline(trials: DataFrame) -> DataFrame:
    """(number, start, duration, unit): offsets from the first start in seconds, minutes or hours."""
    seconds = lambda c: F.unix_micros(F.col(c)) / 1e6
    ends = trials.agg(F.min(seconds("datetime_start")).alias("t0"), F.max(seconds("datetime_complete")).alias("t1")).first()
    t0, span = ends["t0"], ends["t1"] - ends["t0"]
    unit, size = ("h", 3600.0) if span >= 3600 else ("m", 60.0) if span >= 60 else ("s", 1.0)
    return trials.select(
        "number",
        ((seconds("datetime_start") - t0) / size).alias("start"),
        ((seconds("datetime_complete") - seconds("datetime_start")) / size).alias("duration"),
        F.lit(unit).alias("unit"),
    )


def loss_per_epoch(log: DataFrame) -> DataFrame:
    return log.groupBy("Epoch").agg(
        F.avg("Loss").alias("mean"), F.min("Loss").alias("min"), F.max("Loss").alias("max"), F.stddev_samp("Loss").alias("std")
    )
