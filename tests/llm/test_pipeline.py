from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm import cases
from tests.llm.test_copies import brute_components, brute_fingerprint
from tests.llm.test_lines import brute
from tests.llm.test_packing_sharding import reference_ids
from twinframe.llm.shared import stash


def test_stages_against_brute_force(spark, sf):
    docs = cases.table(spark)
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_dedup", "source_mix", "pack"]

    told = stash(stages["language_id"](spark, docs, sf), "t").collect()
    assert sum(1 for r in told if r.doc_id is not None and r.doc_id < 40) >= 38
    assert all(any(c.isalpha() for c in r.text) for r in told)

    clean = stages["line_dedup"](spark, docs, sf).collect()
    expected = [(i, t) for i, t, dropped in brute([r[:2] for r in cases.documents()]) if not dropped or t.split()]
    assert sorted((str(r.doc_id), str(r.text)) for r in clean) == sorted(expected)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in clean)

    rows = cases.documents()
    least = brute_components([brute_fingerprint(r[1]) for r in rows], [r[0] for r in rows])
    kept = stages["simhash_dedup"](spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, set(least)))

    packed = stages["pack"](spark, docs, sf).collect()
    assert sum(r.length for r in packed) == sum(len(reference_ids(r[1])) for r in rows)
    for name in ("language_id", "line_dedup", "simhash_dedup", "source_mix"):
        assert stages[name](spark, docs, sf).columns == docs.columns
        assert stages[name](spark, docs.where("false"), sf).count() == 0


def test_columns_of_any_name_come_back(spark, sf):
    names = ["_judged", "_mark", "_ID", "_key", "_l_id", "_l_here", "_m_name", "_m_size", "_m_cut", "mix_size", "lang_pred", "line_total", "id", "mark", "input_mark"]
    docs = cases.table(spark).withColumns({name: F.concat_ws("/", F.lit(name), "doc_id") for name in names})
    for name, stage in pipeline.STAGES[:-1]:
        plain, wide = stage(spark, cases.table(spark), sf), stage(spark, docs, sf)
        assert wide.columns == docs.columns
        rows = wide.collect()
        own = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["source"]))
        assert sorted(map(own, rows)) == sorted(map(own, plain.collect()))
        assert all(r[c] == c + (f"/{r['doc_id']}" if r["doc_id"] is not None else "") for r in rows for c in names)
    assert dict(pipeline.STAGES)["pack"](spark, docs, sf).count() > 0


def test_whole_run(spark, sf):
    packed = pipeline.run(spark, sf)
    assert packed.count() > 0
    assert packed.where("length != size(ids) or length > 2048").count() == 0
