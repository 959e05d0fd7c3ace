"""The stages of the corpus pipeline on the sample and on odd rows."""

from collections import Counter

import corpus_pipeline
from docketry.llm import op6_pii, op10_mixing, stages
from docketry.llm.common import table
from test_near_copies import brute

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "the cat and the dog sat here", "en", "a", 28), (1, "the cat and the dog sat here", "en", "a", 28), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "12 !!", None, "b", 5),
       (5, "mail me at who@where.org or +1 (512) 555-4564 please do", None, None, None), (None, "a text without any number for it", "en", "b", 32), (None, "a text without any number for it", "en", "b", 32),
       (7, "go " * 20_000, "en", "c", 60_000)]


def run(spark, docs):
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stages.keep(stage(spark, docs, FOLDER), name)
        seen[name] = docs
    return seen


def test_stages_follow_each_other(spark):
    docs = table(spark, FOLDER, "documents")
    seen = run(spark, docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "personal_data", "source_mixing", "best_fit_packing"]
    assert all(seen[n].columns == docs.columns for n in list(seen)[:4])
    first = {r.doc_id: r for r in seen["language_id"].collect()}
    assert set(first) == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}
    want = brute({i: r.text for i, r in first.items()})
    second = {r.doc_id: r for r in seen["simhash_near_dedup"].collect()}
    assert set(second) == set(want.values()) and all(second[i] == first[i] for i in second)
    third = {r.doc_id: r for r in seen["personal_data"].collect()}
    assert set(third) == set(second)
    for i, r in third.items():
        assert not op6_pii.base_spans(r.text) and len(r.text) == r.n_chars
        assert r.text == second[i].text or op6_pii.base_spans(second[i].text)
    copies = {r.doc_id: r.copies for r in op10_mixing.mix(seen["personal_data"]).collect()}
    assert Counter(r.doc_id for r in seen["source_mixing"].collect()) == Counter({i: n for i, n in copies.items() if n})
    last = seen["best_fit_packing"].collect()
    assert Counter(r.doc_id for r in last if r.piece == 0) == Counter({i: n for i, n in copies.items() if n})


def test_stages_take_odd_rows(spark):
    seen = run(spark, spark.createDataFrame(ODD, SCHEMA))
    assert sorted(str(r.doc_id) for r in seen["language_id"].collect()) == ["1", "1", "5", "7", "None", "None"]
    kept = {r.doc_id: r for r in seen["simhash_near_dedup"].collect()}
    assert seen["simhash_near_dedup"].count() == 4 and set(kept) == {1, 5, 7, None}
    clean = {r.doc_id: r for r in seen["personal_data"].collect()}
    assert clean[5].text == "mail me at [EMAIL] or [PHONE] please do" and clean[7].text == ODD[-1][1]
    assert all(s.count() == 0 for s in run(spark, spark.createDataFrame([], SCHEMA)).values())


def test_rows_are_numbered_without_another_copy(spark, tmp_path):
    rows = [(n % 3, "same text", "en", "s", 9) for n in range(50)]
    written = str(tmp_path / "docs")
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(written)
    made = []
    with stages.noting() as made:
        for docs in (spark.read.parquet(written), spark.createDataFrame(rows, SCHEMA), spark.read.parquet(written).unionByName(spark.read.parquet(written))):
            one = stages.numbered(docs)
            assert one.select("row").distinct().count() == docs.count()
    assert len(made) == 2  # only what is no plain table was written


def test_a_stage_releases_what_the_one_before_wrote(spark):
    import os

    docs = stages.keep(spark.createDataFrame([(n, f"some words of text {n} go here", "en", "s", 9) for n in range(40)], SCHEMA))
    lazy = stages.near_dedup(spark, docs, "")
    wrote = list(stages.LEFT)
    assert wrote and all(os.path.isdir(p) for p in wrote)
    inner = {os.path.dirname(f) for f in lazy.inputFiles()}
    stages.personal_data(spark, lazy, "")  # reads some of them still
    assert {p for p in wrote if os.path.isdir(p)} == {p for p in wrote if any(i.endswith(p) for i in inner)} and lazy.count() == 40
