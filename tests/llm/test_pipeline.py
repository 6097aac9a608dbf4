"""Each stage of the pipeline on what it is given, and the whole."""

import pytest

import corpus_pipeline as pipeline
from eventlab.llm import catalog, crf, pieces, sketch
from eventlab.llm.common import prepared
from tests.llm.test_containment import brute as leaks
from tests.llm.test_sketch import brute as classes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and gave, on the small tables."""
    data = "/root/testdata/sf0.001"
    docs, out = catalog.table(spark, data, "documents"), []
    for name, stage in pipeline.STAGES:
        done = stage(spark, docs, data)
        rows = done.collect()
        out.append((name, docs.collect(), rows, done.columns))
        docs = spark.createDataFrame(rows, done.schema)
    return {name: rest for name, *rest in out}


def test_columns(steps):
    assert all(columns == list(pipeline.COLUMNS) for name, (_, _, columns) in steps.items() if name != "pieces")


def test_toxic_documents_go(spark, steps):
    before, after, _ = steps["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    toxic = {r.doc_id for r in catalog.table(spark, "/root/testdata/sf0.001", "labels").where("toxic = 1").collect()}
    clean = {r.doc_id for r in catalog.table(spark, "/root/testdata/sf0.001", "labels").where("toxic = 0").collect()}
    assert not gone & clean and len(gone & toxic) >= 0.8 * len(toxic)


def test_one_of_each_class_stays(steps):
    before, after, _ = steps["near_copies"]
    want = {d for d, _, _, kept in classes([(r.doc_id, r.text) for r in before], 80) if kept}
    assert {r.doc_id for r in after} == want and len(after) == len(want)


def test_benchmark_holders_go(spark, steps):
    before, after, _ = steps["contamination"]
    items = [(r.item_id, r.text) for r in catalog.table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    bad = {d for d, *_ in leaks([(r.doc_id, r.text) for r in before], items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad


def test_personal_data_is_masked(steps):
    before, after, _ = steps["personal_data"]
    then = {r.doc_id: r for r in before}
    assert len(after) == len(before)
    for r in after:
        assert not crf.base_spans(r.text) and r.n_chars == len(r.text)
        if not crf.base_spans(then[r.doc_id].text):
            assert r == then[r.doc_id]


def test_pieces_round_trip(steps):
    before, after, _ = steps["pieces"]
    text = {r.doc_id: r.text for r in before}
    lib = pieces.vocabulary(catalog.piece_file()).library
    assert len(after) == len(before)
    for r in after:
        assert r.ids == lib.encode(text[r.doc_id]) and r.n_tokens == len(r.ids)


def test_odd_rows_pass_each_stage(spark):
    spark = prepared(spark)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (4, "A b c d e f g", "en", "s", 13),
            (None, "x@y.zz " + "w " * 40_000, "en", "s", 80_007), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs.selectExpr("*", "1 AS score", "2 AS spans"), "/root/testdata/sf0.001").collect()
        assert len(got) == (5 if name == "near_copies" else 7), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").collect() == []


def test_rows_that_share_an_id_or_have_none(spark):
    spark = prepared(spark)
    copy, own = "one two three four five six seven eight nine ten", "quite another text that shares nothing with the others at all"
    rows = [(5, copy), (5, own), (7, copy), (None, copy), (None, own), (None, None), (None, "some text that only stands in a row without an id"), (9, ""), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA).repartition(3)
    got = pipeline.one_of_near_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        [(5, copy), (5, own), (None, None), (None, rows[6][1]), (9, ""), (9, "")], key=str)


def test_run(spark, steps):
    got = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, steps["pieces"][1]), key=str)


def test_as_many_sketches_as_bands():
    assert sketch.shape(85) == (48, 8) and sketch.shape(80) == (64, 6)
