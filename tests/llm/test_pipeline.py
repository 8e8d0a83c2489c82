"""The pipeline's stages against plain readings of their rules."""

import re

import corpus_pipeline
from .test_decontamination import best
from .test_ngram_join import plain
from .test_pii import plain as personal
from webtrail.llm.common import table
from webtrail.session import shared_dir


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    (_, by_language), (_, near), (_, clean), (_, personal_data), (_, pieces) = corpus_pipeline.STAGES

    one = by_language(spark, docs, sf)
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and kept == {i for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")}

    two = near(spark, one, sf)
    want = {i for i, _, c, _ in plain([(i, rows[i].text) for i in kept], 5, 80) if i == c}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == want

    three = clean(spark, two, sf)
    leaked = {i for i in want for k, t in items if " ".join(re.findall(r"[^\W_]+", t.lower())[3:8]) in " ".join(re.findall(r"[^\W_]+", rows[i].text.lower())) and best(rows[i].text, t)}
    assert leaked and {r.doc_id for r in three.collect()} == want - leaked

    four = personal_data(spark, three, sf)
    assert four.columns == docs.columns
    for r in four.collect():
        found = personal(rows[r.doc_id].text)[2]
        assert r.n_chars == len(r.text)
        if not found:
            assert r.text == rows[r.doc_id].text or "<PHONE>" in r.text
        assert not personal(r.text)[2]

    five = pieces(spark, four, sf)
    assert {r.doc_id for r in five.where("lossless").collect()} == want - leaked


def test_run_and_empty_table(spark, sf):
    empty = table(spark, sf, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.collect() == []


def test_columns_of_any_name_and_what_a_stage_leaves(spark, sf):
    """Columns named as those that the stages use themselves come through and decide nothing; the
    tables of a stage go with it, but for narrow ones of ids."""
    own = {"_id": 1, "_rows": 2, "_doc": 3, "_hash": 4, "_text": "t", "_digits": "d", "_at": "a", "_row": "r", "_found": "f", "_flat": "x", "_done": "y",
           "email_b_m": "m", "candidates": "c", "node": 5, "component": 6, "digest": "g", "text_hash": 7, "n": 8}
    docs = table(spark, sf, "documents")
    wide = docs.selectExpr("*", *(f"{v!r} AS `{k}`" for k, v in own.items()))
    given = {r.doc_id: r for r in docs.collect()}
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/webtrail-llm/{spark.sparkContext.applicationId}")
    size = lambda: place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = size()
        got = stage(spark, wide, sf)
        assert size() - before < 200_000, name
        rows = got.collect()
        assert rows and got.columns == wide.columns, name
        assert all(r[k] == v for r in rows for k, v in own.items()), name
        same = docs.columns if name != "personal_data" else ["doc_id", "lang", "source"]
        assert all(r[c] == given[r.doc_id][c] for r in rows for c in same), name
