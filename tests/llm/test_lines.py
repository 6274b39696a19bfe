import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from twinframe.llm import lines
from twinframe.llm.queries import QUERIES


def pairs(seed, n=600):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        letters = rng.choice(["ab", "abcdé中"])
        a = rng.choices(letters, k=rng.randint(0, 30))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(b))
            if rng.random() < 0.4:
                b.insert(k, rng.choice(letters))
            elif k < len(b):
                b[k : k + 1] = rng.choice([[], [rng.choice(letters)]])
        out.append(("".join(a), "".join(b)))
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rows = pairs(most)
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.within_edits(F.col("a"), F.col("b"), most).alias("w"))
    for r in found.collect():
        assert r.w == (cases.edit_distance(r.a, r.b) <= most), r


def test_segments_meet_for_every_near_pair(spark):
    rows = [(a, b) for a, b in pairs(9, 1500) if min(len(a), len(b)) >= 6 and len(a) >= len(b) and cases.edit_distance(a, b) <= 2]
    assert len(rows) > 100
    own = [at for at, (d, _, shift) in enumerate(lines.probe_places(2)) if d == shift == 0]
    probing = spark.createDataFrame(rows, "line string, b string").withColumn("probes", lines.probe_keys(2))
    found = probing.withColumnRenamed("line", "a").withColumnRenamed("b", "line").withColumn("index", lines.probe_keys(2)).select(
        F.arrays_overlap("probes", F.array(*[F.col("index")[i] for i in own])).alias("meet"),
        lines.may_be_near(lines.letter_counts(F.col("a")), lines.letter_counts(F.col("line")), 2).alias("near"),
    )
    assert all(r.meet and r.near for r in found.collect())


def brute(rows, most=2):
    """(id, text) -> (text left, lines dropped), by comparing all lines with all.

    Every line but blank ones takes part; lines under 9 characters are the same only if equal.
    """
    places = []
    for doc, text in rows:
        if text is None:
            continue
        mark = xxhash.xxh64_intdigest(text.encode(), 42)
        mark -= (mark >> 63) << 64
        for n, line in enumerate(text.split("\n")):
            line = line.translate(str.maketrans("\t\r\x0b\x0c", "    ")).strip(" ")
            if line:
                places.append(((doc is None, doc or 0, mark, n), line))
    names = sorted({line for _, line in places})
    links = [
        (i, j)
        for i in range(len(names))
        for j in range(i)
        if min(len(names[i]), len(names[j])) >= 9 and abs(len(names[i]) - len(names[j])) <= most and len(names[i]) < 500 and cases.edit_distance(names[i], names[j]) <= most
    ]
    root = dict(zip(names, cases.roots(len(names), links)))
    first = {}
    for at, line in places:
        first[root[line]] = min(first.get(root[line], at), at)
    gone = {at for at, line in places if at != first[root[line]]}
    out = []
    for doc, text in rows:
        if text is None:
            out.append((str(doc), "None", 0))
            continue
        mark = xxhash.xxh64_intdigest(text.encode(), 42)
        mark -= (mark >> 63) << 64
        kept = [x for n, x in enumerate(text.split("\n")) if (doc is None, doc or 0, mark, n) not in gone]
        out.append((str(doc), "\n".join(kept), text.count("\n") + 1 - len(kept)))
    return sorted(out)


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    rows = cases.documents()
    for i in range(20):
        text = list(rows[i][1])
        for _ in range(3):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((500 + i, "".join(text), "en", "s1", 0))
    rows += [(600 + i, f"a passage that many pages share, page {i} of 99\nown line number {i * 7919}", "en", "s1", 0) for i in range(30)]
    docs = cases.table(spark, rows).withColumn("line", F.lit("x")).withColumn("h1", F.lit(1)).withColumn("line_dropped", F.lit("y"))
    found = lines.deduplicate(docs)
    assert found.columns.count("line_dropped") == 1
    assert sorted((str(r.doc_id), str(r.text), r.line_dropped) for r in found.collect()) == brute([r[:2] for r in rows])


def test_a_line_in_every_document(spark):
    """Many places of one line, met in several tasks, and near copies of it."""
    rows = [(i, f"the line that stands everywhere\nown line {i * 7919} of this one\n" + ("the line that stands everywherf" if i % 9 == 0 else "ok"), "en", "s", 0) for i in range(120)]
    found = lines.deduplicate(cases.table(spark, rows).repartition(7))
    assert sorted((str(r.doc_id), r.text, r.line_dropped) for r in found.collect()) == brute([r[:2] for r in rows])


def test_no_lines(spark):
    assert lines.deduplicate(cases.table(spark, [])).count() == 0
    short = cases.table(spark, [(1, "same\nsame\n", "en", "s", 0), (2, "same", "en", "s", 0)])
    assert sorted(r.text for r in lines.deduplicate(short).collect()) == ["", "same\n"]
    assert sorted(r.text for r in lines.deduplicate(short, least_chars=5).collect()) == ["same", "same\nsame\n"]


def test_short_lines_take_part(spark):
    texts = ["Les.\nLes.\nnew one", "Les.\nLen.\n\n a", "so\na\n\nhello there", "hello thera\nno\nso", "Len.\n \nx"]
    docs = cases.table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    found = lines.deduplicate(docs, least_chars=lines.EVERY_LINE)
    # Under LEAST_NEAR characters equality counts, from there on two edits; blank lines stay.
    expected = ["Les.\nnew one", "Len.\n\n a", "so\n\nhello there", "no", " \nx"]
    assert [r.text for r in found.orderBy("doc_id").collect()] == expected


def test_query_and_pipeline_drop_short_lines(spark, tmp_path):
    docs = cases.table(spark, [(i, f"Les.\nline number {i * 7919} of many", "en", "s", 0) for i in range(3)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.line_dropped for r in QUERIES["op10_lines"](spark, str(tmp_path)).collect()) == [0, 1, 1]
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    assert sum(r.text.startswith("Les.") for r in stage(spark, docs, str(tmp_path)).collect()) == 1
