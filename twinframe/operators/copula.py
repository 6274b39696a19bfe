"""Gaussian copula: fit one or many models in the same jobs, and sample rows from them.

A model is a small row of numbers (marginals, category intervals, Cholesky factor). Many models
(one per shadow set) are rows of the same frame, so fitting them is a grouped aggregation and
sampling them is one join with that frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.hashing import fast_normal, fast_uniform
from twinframe.functions.special import add_norm_cdf, add_norm_ppf, gamma_cdf
from twinframe.operators.dependence import correlation
from twinframe.operators.ordering import count_below, look_up, ranks_within, running_totals
from twinframe.session import written

FAMILIES = ("norm", "truncnorm", "uniform", "gamma")
GRID = 512  # nodes of a tabulated gamma marginal
Z_LIMIT = 6.0
EDGE = 1e-9
NUMBER_PARAMS = ("mean", "sd", "lo", "hi", "below", "upto", "theta", "base", "top")
MAX_LEVELS = 10_000  # categories of a column in one model that travel as an array; more are a table
CHUNK = 1_000  # consecutive categories in one row of such a table
HOT_CHUNKS = 2_000  # a chunk drawn by more than one row in so many is sent to the rows


@dataclass(frozen=True)
class CopulaModels:
    """Fitted models: one parameter row per key, in key order."""

    spark: SparkSession
    columns: tuple[str, ...]
    families: dict[str, str]
    types: dict[str, T.DataType]
    keys: tuple[str, ...]
    rows: list[dict] = field(repr=False)
    levels: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @property
    def categories(self) -> list[str]:
        return [c for c in self.columns if c not in self.families]

    def frame(self) -> DataFrame:
        fields = [T.StructField("model", T.LongType())]
        fields += [T.StructField(k, T.LongType()) for k in self.keys]
        fields += [T.StructField("chol", T.ArrayType(T.ArrayType(T.DoubleType())))]
        for i, c in enumerate(self.columns):
            if c in self.families:
                fields += [T.StructField(f"{p}{i}", T.DoubleType()) for p in NUMBER_PARAMS]
                fields += [T.StructField(f"{p}{i}", T.ArrayType(T.DoubleType())) for p in ("forward", "back")]
            elif c in self.levels:
                fields += [T.StructField(f"bounds{i}", T.ArrayType(T.DoubleType()))]
            else:
                fields += [
                    T.StructField(f"labels{i}", T.ArrayType(T.StringType())),
                    T.StructField(f"shares{i}", T.ArrayType(T.DoubleType())),
                ]
        schema = T.StructType(fields)
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in self.rows], schema)

    def intervals(self, column: str) -> DataFrame:
        """(model, value, low, high): the share interval of each category of a column."""
        if column in self.levels:
            return self.levels[column].select("model", "value", "low", "high")
        i = self.columns.index(column)
        ends = F.col(f"shares{i}")
        spans = F.arrays_zip(
            F.col(f"labels{i}").alias("value"),
            F.concat(F.array(F.lit(0.0)), F.slice(ends, 1, F.size(ends) - 1)).alias("low"),
            ends.alias("high"),
        )
        return self.frame().select("model", F.explode(spans).alias("e")).select("model", "e.value", "e.low", "e.high")

    def correlation(self) -> DataFrame:
        """(keys..., a, b, corr) of the fitted normal scores."""
        out = [
            (*[r[k] for k in self.keys], a, b, float(r["corr"][i][j]))
            for r in self.rows
            for i, a in enumerate(self.columns)
            for j, b in enumerate(self.columns)
        ]
        heads = "".join(f"{k} long, " for k in self.keys)
        return self.spark.createDataFrame(out, f"{heads}a string, b string, corr double")


def _gamma_table(shape: float) -> tuple[float, float, list[float], list[float]]:
    """Normal scores on an even grid of the cube root, and cube roots on an even grid of scores.

    The cube root of a gamma variable is close to normal, so both curves are nearly straight.
    """
    top = (shape + Z_LIMIT * max(shape, 1.0) ** 0.5 + 25.0) ** (1 / 3)
    low = max(shape - 2 * Z_LIMIT * shape**0.5, 0.0) ** (1 / 3)  # below lies nothing that the limit on scores shows
    roots = np.linspace(low, top, GRID)
    probs = np.clip(gamma_cdf(shape, roots**3), EDGE, 1 - EDGE)
    scores = np.array([NormalDist().inv_cdf(p) for p in probs])
    inside = np.flatnonzero((probs > EDGE) & (probs < 1 - EDGE))
    inside = np.arange(max(inside[0] - 1, 0), min(inside[-1] + 2, GRID))
    even = np.linspace(-Z_LIMIT, Z_LIMIT, GRID)
    return float(low), float(top), scores.tolist(), np.interp(even, scores[inside], roots[inside]).tolist()


def _read_grid(nodes: Column, place: Column) -> Column:
    """Linear interpolation in an array of evenly spaced nodes; `place` counts steps from 0."""
    at = F.greatest(F.least(place, F.lit(GRID - 1.0)), F.lit(0.0))
    left = F.least(F.floor(at), F.lit(GRID - 2)).cast("int")
    low, high = F.get(nodes, left), F.get(nodes, left + 1)
    return low + (at - left) * (high - low)


def _kinds(models: CopulaModels) -> dict[int, str]:
    kind = lambda c: models.families.get(c, "wide" if c in models.levels else "category")
    return {i: kind(c) for i, c in enumerate(models.columns)}


def _with_parts(models: CopulaModels, source: DataFrame) -> DataFrame:
    """Adds the interval part<i> of a row's category in each column whose categories are a table."""
    out = source
    for i, c in enumerate(models.columns):
        if c in models.levels:
            key = F.struct("model", "value").alias("k")
            table = models.levels[c].select(key, F.struct("low", "high").alias("v"))
            often = models.levels[c].where((F.col("high") - F.col("low")) * MAX_LEVELS > 1).select(key.alias("_k"))
            value = F.col(c).cast("string").alias("value")
            out = look_up(out, F.when(value.isNotNull(), F.struct("model", value)), table, f"part{i}", often=often)
    return out


def _with_drawn(models: CopulaModels, out: DataFrame) -> DataFrame:
    """Adds the categories whose intervals hold u<i>, for the columns whose categories are a table."""
    for i, c in enumerate(models.columns):
        if c in models.levels:
            key = F.struct("model", "chunk").alias("k")
            ends = F.sort_array(F.collect_list(F.struct("high", "value"))).alias("ends")
            table = models.levels[c].groupBy("model", "chunk").agg(ends, (F.max("high") - F.min("low")).alias("mass"))
            # Two arrays, as one of structs would be taken apart anew at each step of the search.
            table = table.withColumn("v", F.struct(F.col("ends.high").alias("high"), F.col("ends.value").alias("value")))
            often = table.where(F.col("mass") * HOT_CHUNKS > 1).select(key.alias("_k"))
            drawn = F.struct("model", F.col(f"chunk{i}").alias("chunk"))
            out = look_up(out, drawn, table.select(key, "v"), "_ends", HOT_CHUNKS, HOT_CHUNKS // 10, often)
            at = count_below(F.col("_ends")["high"], F.col(f"u{i}"), CHUNK)
            label = F.get(F.col("_ends")["value"], F.least(at, F.size(F.col("_ends")["value"]) - 1))
            out = out.withColumn(c, label.cast(models.types[c])).drop("_ends", f"u{i}", f"chunk{i}")
    return out


def _scores(models: CopulaModels, placed: DataFrame, keep: list[str], row_id: str, seed: int) -> DataFrame:
    """Normal score z<i> of every column: its distribution function, then the normal quantile.

    Built up in steps of plain columns: the normal functions use their argument many times.
    """
    p = lambda name, i: F.col(f"{name}{i}")
    kind = _kinds(models)
    first = {}
    for i, c in enumerate(models.columns):
        x = F.col(c).cast("double") if c in models.families else None
        if kind[i] in ("norm", "truncnorm"):
            first[f"z{i}"] = (x - p("mean", i)) / p("sd", i)
        elif kind[i] == "uniform":
            first[f"u{i}"] = F.try_divide(x - p("lo", i), p("hi", i) - p("lo", i))  # null on a constant
        elif kind[i] == "gamma":
            root = F.pow(F.greatest((x - p("lo", i)) / p("theta", i), F.lit(0.0)), F.lit(1 / 3))
            first[f"g{i}"] = (root - p("base", i)) / (p("top", i) - p("base", i)) * (GRID - 1)
        elif kind[i] == "category":
            first[f"g{i}"] = F.array_position(p("labels", i), F.col(c).cast("string")).cast("int")
    out = placed.withColumns(first)
    truncated = [i for i in kind if kind[i] == "truncnorm"]
    out = add_norm_cdf(out, {f"g{i}": f"z{i}" for i in truncated})
    second = {f"u{i}": F.try_divide(p("g", i) - p("below", i), p("upto", i) - p("below", i)) for i in truncated}
    for i, c in enumerate(models.columns):
        if kind[i] == "gamma":
            second[f"z{i}"] = _read_grid(p("forward", i), p("g", i))
        elif kind[i] in ("category", "wide"):
            low = F.when(p("g", i) > 1, F.get(p("shares", i), p("g", i) - 2)).otherwise(0.0) if kind[i] == "category" else p("part", i)["low"]
            high = F.get(p("shares", i), p("g", i) - 1) if kind[i] == "category" else p("part", i)["high"]
            second[f"u{i}"] = low + (high - low) * fast_uniform(seed, F.lit(c), F.col(row_id))
    out = out.withColumns(second) if second else out
    out = add_norm_ppf(out, {f"z{i}": f"u{i}" for i in kind if kind[i] in ("truncnorm", "uniform", "category", "wide")}, EDGE)
    return out.select(*keep, *[f"z{i}" for i in kind])


def _values(models: CopulaModels, scored: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of sampled rows from their normal scores y<i>."""
    p = lambda name, i: F.col(f"{name}{i}")
    kind = _kinds(models)
    out = add_norm_cdf(scored, {f"u{i}": f"y{i}" for i in kind if kind[i] not in ("norm", "gamma")})
    truncated = [i for i in kind if kind[i] == "truncnorm"]
    if truncated:
        out = out.withColumns({f"t{i}": p("below", i) + p("u", i) * (p("upto", i) - p("below", i)) for i in truncated})
        out = add_norm_ppf(out, {f"v{i}": f"t{i}" for i in truncated}, EDGE)
    values = []
    for i, c in enumerate(models.columns):
        if kind[i] == "wide":
            most = max(len(r[f"bounds{i}"]) for r in models.rows)
            chunk = F.least(count_below(p("bounds", i), p("u", i), most), F.size(p("bounds", i)) - 1)
            values += [p("u", i), chunk.cast("long").alias(f"chunk{i}")]
            continue
        if kind[i] == "category":
            place = F.size(F.filter(p("shares", i), _below(f"u{i}")))
            values.append(F.get(p("labels", i), F.least(place, F.size(p("labels", i)) - 1)).cast(models.types[c]).alias(c))
            continue
        if kind[i] == "uniform":
            x = p("lo", i) + p("u", i) * (p("hi", i) - p("lo", i))
        elif kind[i] == "gamma":
            root = _read_grid(p("back", i), (p("y", i) + Z_LIMIT) / (2 * Z_LIMIT) * (GRID - 1))
            x = p("lo", i) + p("theta", i) * F.pow(root, F.lit(3.0))
        else:
            x = p("mean", i) + p("sd", i) * p("y" if kind[i] == "norm" else "v", i)
        x = F.greatest(F.least(x, p("hi", i)), p("lo", i))  # sampled values stay within the seen range
        whole = isinstance(models.types[c], T.IntegralType)
        values.append((F.round(x) if whole else x).cast(models.types[c]).alias(c))
    if not models.levels:
        return out.select(*keep, *values)
    # What follows shuffles the rows: the parameters of the models stay behind.
    narrow = out.select("model", *[k for k in keep if k != "model"], *values)
    return _with_drawn(models, narrow).select(*keep, *models.columns)


def _below(name: str):
    return lambda share: share < F.col(name)


def truncated_moments(mean: float, sd: float, low: float, high: float) -> tuple[float, float]:
    """Mean and deviation of the normal that has these moments once cut to [low, high].

    For a given deviation the centre is found by bisection (the cut mean grows with it), and the
    deviation by bisection over that (the cut deviation grows with it). Data at least as wide as
    uniform ones get a normal twice as wide as the range, which is flat over it to a few parts in a hundred.
    """
    width = high - low
    if width <= 0:
        return mean, sd
    normal = NormalDist()

    def cut(centre: float, spread: float) -> tuple[float, float]:
        a, b = (low - centre) / spread, (high - centre) / spread
        if a > 0:  # the far tail is mirrored, where differences of probabilities keep their digits
            m, s = cut(low + high - centre, spread)
            return low + high - m, s
        mass = normal.cdf(b) - normal.cdf(a)
        if mass < 1e-14:
            return high, 0.0
        fa, fb = normal.pdf(a), normal.pdf(b)
        shift = (fa - fb) / mass
        rest = 1 + (a * fa - b * fb) / mass - shift * shift
        return centre + spread * shift, spread * max(rest, 0.0) ** 0.5

    def centre_for(spread: float) -> float:
        lower, upper = low - 5 * spread, high + 5 * spread  # probabilities beyond would lose their digits
        for _ in range(80):
            middle = (lower + upper) / 2
            lower, upper = (middle, upper) if cut(middle, spread)[0] < mean else (lower, middle)
        return (lower + upper) / 2

    small, large = width * 1e-3, width * 2
    for _ in range(60):
        middle = (small * large) ** 0.5
        small, large = (middle, large) if cut(centre_for(middle), middle)[1] < sd else (small, middle)
    spread = (small * large) ** 0.5
    return centre_for(spread), spread


def _cholesky(corr: np.ndarray) -> np.ndarray:
    """Factor of the nearest usable correlation matrix."""
    values, vectors = np.linalg.eigh(np.nan_to_num(corr))
    fixed = vectors @ np.diag(np.maximum(values, 1e-8)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return np.linalg.cholesky(fixed / np.outer(scale, scale))


def fit_copula(
    df: DataFrame,
    num_cols: list[str],
    cat_cols: list[str],
    distributions: dict[str, str] | None = None,
    default_distribution: str = "truncnorm",
    keys: list[str] | None = None,
    row_id: str = "row_id",
    seed: int = 0,
) -> CopulaModels:
    """Marginals, category intervals and the correlation of normal scores, per key.

    Three grouped aggregations over the rows; what reaches the driver is one row of parameters
    per model and one row per category.
    """
    keys = list(keys or [])
    families = {c: (distributions or {}).get(c, default_distribution) for c in num_cols}
    for c, family in families.items():
        if family not in FAMILIES:
            raise ValueError(f"unknown distribution {family!r} for column {c!r}")
    columns = tuple(c for c in df.columns if c in families or c in cat_cols)
    types = {f.name: f.dataType for f in df.schema}
    by = keys or ["model"]
    source = df if keys else df.withColumn("model", F.lit(0).cast("long"))
    number = lambda c: F.col(c).cast("double")
    stats = source.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            f(number(c)).alias(f"{name}{i}")
            for i, c in enumerate(columns)
            if c in families
            for name, f in (("mean", F.avg), ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max))
        ],
    )
    rows = []
    for model, r in enumerate(sorted(stats.collect(), key=lambda r: [r[k] for k in by])):
        row = {"model": model, "n": r["n"], **{k: r[k] for k in keys}}
        for i, c in enumerate(columns):
            if c not in families:
                continue
            mean, sd, lo, hi = (float(r[f"{p}{i}"]) for p in ("mean", "sd", "lo", "hi"))
            sd = sd or 1.0
            if families[c] == "truncnorm":
                mean, sd = truncated_moments(mean, sd, lo, hi)
            row |= {f"mean{i}": mean, f"sd{i}": sd, f"lo{i}": lo, f"hi{i}": hi}
            row |= {f"below{i}": NormalDist(mean, sd).cdf(lo), f"upto{i}": NormalDist(mean, sd).cdf(hi)}
            if families[c] == "gamma":
                mean, sd = float(r[f"mean{i}"]), float(r[f"sd{i}"]) or 1.0
                centre = max(mean - lo, 1e-12)
                shape = max((centre / sd) ** 2, 1e-3)
                base, top, forward, back = _gamma_table(shape)
                row |= {f"theta{i}": centre / shape, f"base{i}": base, f"top{i}": top, f"forward{i}": forward, f"back{i}": back}
        rows.append(row)
    levels = _add_intervals(source, columns, cat_cols, by, rows) if cat_cols else {}
    models = CopulaModels(df.sparkSession, columns, families, types, tuple(keys), rows, levels)
    # One row per model: as many as there are shadow sets.
    placed = source.drop("model").join(F.broadcast(_numbers_of(source, by, rows)), by) if keys else source
    shared = [k for k in ("model", *keys)]
    placed = _with_parts(models, placed).join(F.broadcast(models.frame()), shared)
    d = len(columns)
    scores = _scores(models, placed, by, row_id, seed)
    pairs = [(i, j) for i in range(d) for j in range(i)]
    if pairs:
        corr = scores.groupBy(*by).agg(*[correlation(F.col(f"z{i}"), F.col(f"z{j}")).alias(f"c{i}_{j}") for i, j in pairs])
        found = {tuple(r[k] for k in by): r for r in corr.collect()}
    for row in rows:
        matrix = np.eye(d)
        for i, j in pairs:
            value = found[tuple(row[k] for k in by)][f"c{i}_{j}"]
            matrix[i, j] = matrix[j, i] = 0.0 if value is None or np.isnan(value) else value
        row["corr"] = matrix.tolist()
        row["chol"] = _cholesky(matrix).tolist()
    return models


def _numbers_of(source: DataFrame, by: list[str], rows: list[dict]) -> DataFrame:
    """(keys..., model): the number of each model."""
    fields = [source.schema[k] for k in by if k != "model"] + [T.StructField("model", T.LongType())]
    return source.sparkSession.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], T.StructType(fields))


def _add_intervals(source: DataFrame, columns, cat_cols: list[str], by: list[str], rows: list[dict]) -> dict[str, DataFrame]:
    """Cumulated frequencies of the categories, most frequent first, per model.

    Columns of at most MAX_LEVELS categories in each model get arrays in its row; the others come
    back as tables of intervals, of which the driver gets one bound for each CHUNK categories.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cat_cols])
    counted = (
        source.select(*by, F.explode(cells).alias("e"))
        .where(F.col("e.value").isNotNull())
        .groupBy(*by, "e.column", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    levels = counted.take(MAX_LEVELS + 1)
    wide = []
    if len(levels) > MAX_LEVELS:
        counted = written(counted, "levels")
        sizes = counted.groupBy(*by, "column").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.max("n").alias("n"))
        wide = [r["column"] for r in sizes.collect() if r["n"] > MAX_LEVELS]
        levels = counted.where(~F.col("column").isin(wide)).collect()  # at most MAX_LEVELS for each model and column
    per: dict[tuple, list] = {}
    for r in levels:
        per.setdefault((tuple(r[k] for k in by), r["column"]), []).append((-r["n"], r["value"]))
    for row in rows:
        for i, c in enumerate(columns):
            if c in cat_cols and c not in wide:
                ordered = sorted(per[(tuple(row[k] for k in by), c)])
                upto = np.cumsum([-n for n, _ in ordered], dtype=float)
                row |= {f"labels{i}": [v for _, v in ordered], f"shares{i}": (upto / upto[-1]).tolist()}
    if not wide:
        return {}
    many = counted.where(F.col("column").isin(wide)).join(F.broadcast(_numbers_of(source, by, rows)), by)
    table = _interval_table(many.select("model", "column", "value", "n"))
    ends = table.groupBy("model", "column", "chunk").agg(F.max("high").alias("high")).collect()
    for row in rows:
        for i, c in enumerate(columns):
            if c in wide:
                row[f"bounds{i}"] = sorted(r["high"] for r in ends if r["model"] == row["model"] and r["column"] == c)
    return {c: table.where(F.col("column") == c).drop("column") for c in wide}


def _interval_table(counted: DataFrame) -> DataFrame:
    """(model, column, value, low, high, chunk) from counts: cumulated shares, most frequent first.

    Values of equal counts form a class. Classes are accumulated, of which there are few; within a class the
    interval follows from the rank of the value.
    """
    group = ["model", "column"]
    classes = counted.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("k")).withColumns(
        {"w": F.col("k") * F.col("n"), "down": -F.col("n").cast("double")}
    )
    summed = running_totals(classes, "down", ["w", "k"], groups=group)
    key = F.struct(*group, "n")
    entries = summed.select(
        key.alias("k_"), F.struct((F.col("cum_w") - F.col("w")).alias("w"), (F.col("cum_k") - F.col("k")).alias("k"), F.col("all_w").alias("all")).alias("v")
    ).withColumnRenamed("k_", "k")
    ranked = ranks_within(counted.withColumn("_class", key), "_class", "value", "_rank").drop("_class")
    placed = look_up(ranked, key, entries, "_from")
    upto = lambda rank: (F.col("_from")["w"] + rank * F.col("n")) / F.col("_from")["all"]
    return written(
        placed.select(
            *group,
            "value",
            upto(F.col("_rank")).alias("low"),
            upto(F.col("_rank") + 1).alias("high"),
            F.floor((F.col("_from")["k"] + F.col("_rank")) / CHUNK).cast("long").alias("chunk"),
        ),
        "intervals",
    )


def sample_copula(models: CopulaModels, n: int, draws: int = 1, seed: int = 0) -> DataFrame:
    """n rows per model and draw: (row_id, keys..., syn_id, columns...).

    Every value is a hash of (seed, row number, column): partitions need no shared state, and a
    lost one is rebuilt to the same rows.
    """
    total = n * draws * len(models.rows)
    ids = models.spark.range(total).select(
        F.col("id").alias("row_id"),
        F.floor(F.col("id") / (n * draws)).cast("long").alias("model"),
        (F.floor(F.col("id") / n) % draws).cast("long").alias("syn_id"),
    )
    d = len(models.columns)
    noise = F.array(*[fast_normal(seed, F.col("row_id"), F.lit(k)) for k in range(d)])
    rows = ids.withColumn("_noise", noise).join(F.broadcast(models.frame()), "model")
    mixed = F.transform(
        F.col("chol"),
        lambda line: F.aggregate(F.zip_with(line, F.col("_noise"), lambda a, e: a * e), F.lit(0.0), lambda s, v: s + v),
    )
    scored = rows.withColumn("_y", mixed).withColumns({f"y{i}": F.col("_y")[i] for i in range(d)})
    return _values(models, scored, ["row_id", *models.keys, "syn_id"])
