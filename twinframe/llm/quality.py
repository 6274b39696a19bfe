"""Quality classifier: Naive Bayes support vectors.

Byte n-gram indicators of a text are scaled by the log-count ratio of the two classes, and a
linear hinge-loss model over them is fitted by dual coordinate descent. A sigmoid fitted to
margins of rows left out of that fit turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.shared import rest_of_id

#: Labelled documents the model is fitted on at most: those with the smallest hash of their id.
SAMPLE = 6000
#: Lengths in bytes of the n-grams, and the number of places they are hashed to.
GRAMS = (1, 2, 3)
PLACES = 1 << 17
#: Smoothing of the class counts, penalty of a margin violation, passes over the sample.
SMOOTHING = 1.0
PENALTY = 1.0
PASSES = 12
#: Words whose equality to the word before makes one n-gram of repetition, at most.
REPEATS = 4
#: Bytes of a text that are turned into n-grams at a time.
BLOCK = 1 << 18


def gram_places(text: str | None) -> np.ndarray:
    """Sorted distinct places of the n-grams of a whole text.

    Besides n-grams of bytes there are n-grams over words of which only one thing is kept: whether
    each word equals the one before it. They tell looping texts, whatever is repeated.
    """
    flags = np.zeros(PLACES, dtype=bool)
    if text:
        flags[PLACES - (2 << REPEATS) + repeat_codes(text)] = True
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK + max(GRAMS) - 1].astype(np.uint32)
            for n in GRAMS:
                gram = part[: max(len(part) - n + 1, 0)].copy()
                for k in range(1, n):
                    gram |= part[k : k + len(gram)] << np.uint32(8 * k)
                gram += np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                gram ^= gram >> np.uint32(15)
                gram *= np.uint32(0x85EBCA6B)
                gram ^= gram >> np.uint32(13)
                gram %= np.uint32(PLACES - (2 << REPEATS))
                flags[gram] = True
    return np.flatnonzero(flags).astype(np.uint32)


def repeat_codes(text: str) -> np.ndarray:
    """Codes of the n-grams of repetition, below 2 to the power REPEATS + 1."""
    words = text.split()
    same = np.fromiter(map(eq, words, words[1:]), dtype=np.uint8, count=max(len(words) - 1, 0))
    codes = [np.empty(0, np.uint8)]
    for n in range(1, min(REPEATS, len(same)) + 1):
        code = np.full(len(same) - n + 1, 1 << n, dtype=np.uint8)
        for k in range(n):
            code |= same[k : k + len(code)] << np.uint8(k)
        codes.append(code)
    return np.concatenate(codes).astype(np.int64)


@dataclass
class QualityModel:
    """Weights by place (ratios included), the bias, and the sigmoid over margins."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def score(self, text: str | None) -> float:
        places = gram_places(text)
        if not len(places):
            return self.prior
        return float(self.chance(self.margin(places)))

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum() / np.sqrt(len(places)) + self.bias)

    def chance(self, margin):
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> QualityModel:
    """Fits on at most `sample` labelled documents for which `learn` (over doc_id) holds.

    The bound is on the fit alone. Rows with a null label or id are left out; a document with two
    labels takes the larger. Without rows of both classes every score is the share of label 1.
    """
    known = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    chosen = (
        known.groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    @F.pandas_udf("binary")
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: gram_places(t).tobytes())

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
        .groupBy("doc_id", "quality")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .select("doc_id", "quality", places("text").alias("places"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    marks = np.array([1.0 if r["quality"] > 0 else -1.0 for r in rows])
    grams = [np.frombuffer(r["places"], dtype=np.uint32) for r in rows]
    return fit_places(grams, marks)


def fit_places(grams: list[np.ndarray], marks: np.ndarray) -> QualityModel:
    prior = float((marks > 0).mean()) if len(marks) else 0.5
    checked = np.arange(len(marks)) % 5 == 0  # their margins set the sigmoid
    fitted = np.flatnonzero(~checked)
    if len(set(marks[fitted])) < 2:
        return QualityModel(np.zeros(PLACES), 0.0, 0.0, _logit(prior), prior)
    ratio = log_count_ratio([grams[i] for i in fitted], marks[fitted])
    weights, bias = dual_descent([grams[i] for i in fitted], marks[fitted], ratio)
    model = QualityModel(weights * ratio, bias, 1.0, 0.0, prior)
    margins = np.array([model.margin(grams[i]) if len(grams[i]) else bias for i in np.flatnonzero(checked)])
    model.slope, model.shift = fit_sigmoid(margins, marks[checked] > 0)
    return model


def log_count_ratio(grams: list[np.ndarray], marks: np.ndarray) -> np.ndarray:
    counts = {}
    for side in (1.0, -1.0):
        chosen = [g for g, m in zip(grams, marks) if m == side]
        counts[side] = SMOOTHING + np.bincount(np.concatenate(chosen), minlength=PLACES).astype(float)
    return np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())


def dual_descent(grams: list[np.ndarray], marks: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear model under hinge loss: one dual variable a row, each step exact, rows in seeded order."""
    weights, bias = np.zeros(PLACES), 0.0
    values = [ratio[g] / np.sqrt(max(len(g), 1)) for g in grams]
    size = np.array([v @ v + 1.0 for v in values])
    dual = np.zeros(len(marks))
    order = np.random.default_rng(20).permutation
    for _ in range(PASSES):
        for i in order(len(marks)):
            g, v, y = grams[i], values[i], marks[i]
            slack = y * (weights[g] @ v + bias) - 1.0
            new = min(max(dual[i] - slack / size[i], 0.0), PENALTY)
            step = (new - dual[i]) * y
            if step:
                weights[g] += step * v
                bias += step
                dual[i] = new
    return weights, bias


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on the logistic loss, targets drawn in as for rare classes."""
    n1, n0 = int(positive.sum()), int((~positive).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -35, 35)))
        grad = x @ (p - target) + 1e-6 * theta
        hess = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """Adds quality_score, 0 to 1, of every whole text; null and empty texts get the share of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number a place

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = sent.value
        for texts in batches:
            yield pd.Series([ready.score(t) for t in texts], dtype="float64")

    return docs.drop("quality_score").withColumn("quality_score", scored(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of the documents whose labels are not learned from."""
    return rest_of_id(5, id_col) == 0
