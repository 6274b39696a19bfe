import random
import zlib

from pyspark.sql import functions as F

from tests.llm import cases
from twinframe.llm import langid, quality
from twinframe.llm.queries import QUERIES


def test_languages_and_odd_texts(spark):
    docs = cases.table(spark).withColumn("lang_score", F.lit("mine")).withColumn("score", F.lit("kept"))
    found = langid.identify(docs, langid.fit_dictionaries(docs, ~langid.held_out()))
    assert "score" in found.columns and found.columns.count("lang_score") == 1
    rows = found.collect()
    assert len(rows) == len(cases.documents())
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert 0.0 <= r.lang_score <= 1.0 and r.score == "kept"
        assert letters or not r.lang_accepted
    real = [r for r in rows if r.doc_id is not None and r.doc_id < 40]
    assert sum(r.lang == r.lang_pred for r in real) >= 0.95 * len(real)


def test_no_labels_and_no_rows(spark):
    docs = cases.table(spark, [])
    assert langid.fit_dictionaries(docs, F.lit(True)) == []
    assert langid.identify(docs, []).count() == 0
    assert {r.lang_pred for r in langid.identify(cases.table(spark), []).collect()} == {"und"}


def test_a_tie_is_rejected(spark):
    docs = spark.createDataFrame([("zzz",), ("the house",)], "text string")
    same = [("a", b"the house on the hill"), ("b", b"the house on the hill")]
    rows = langid.identify(docs, same).collect()
    assert [r.lang_pred for r in rows] == ["a", "a"] and not any(r.lang_accepted for r in rows)


def test_held_out_accuracy_of_languages(spark, sf):
    found = QUERIES["op1_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert sum(r.accepted for r in rows) >= 0.97 * len(rows)


def test_quality_odd_texts(spark):
    docs = cases.table(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(31, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, ~quality.held_out())
    rows = quality.score(docs.withColumn("quality_score", F.lit(7)), model).collect()
    assert len(rows) == len(cases.documents())
    assert all(0.0 <= r.quality_score <= 1.0 for r in rows)
    empty = {r.quality_score for r in rows if not r.text}
    assert len(empty) == 1


def test_quality_without_labels(spark):
    docs = cases.table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality_score for r in quality.score(docs, quality.fit(docs, none, F.lit(True))).collect()} == {0.5}
    assert quality.score(cases.table(spark, []), quality.fit(docs, none, F.lit(True))).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op2_quality"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    better = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert better >= 0.95 * len(good) * len(bad)


def test_dual_descent_reaches_the_optimum():
    """The hinge-loss model separates what one gram separates, and repeats are told from their shape."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["red", "blue", "green"], k=20)) for _ in range(80)]
    texts += [" ".join(w for w in rng.choices(["red", "blue", "green"], k=5) for _ in range(6)) for _ in range(80)]
    marks = quality.np.array([1.0] * 80 + [-1.0] * 80)
    model = quality.fit_places([quality.gram_places(t) for t in texts], marks)
    assert all((model.score(t) >= 0.5) == (m > 0) for t, m in zip(texts, marks))
