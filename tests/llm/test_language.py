import math

from webtrail.llm import language
from webtrail.llm.common import table


def test_languages_of_held_out_documents(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    hidden = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang", "source")
    truth = {r.doc_id: (r.lang, r.n_chars) for r in docs.collect()}
    got = [r for r in language.identify(hidden).collect() if r.doc_id % 3 == 0 and truth[r.doc_id][1] > 60]
    right = sum(r.lang == truth[r.doc_id][0] for r in got)
    assert len(got) > 250 and right >= 0.98 * len(got)


def test_rejected_and_odd_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-1, None, "en", "s"), (-2, "", None, None), (-3, "### 123 *** %%%", "en", "s"), (None, "The of and the.", None, None), (-4, "the of that", "en", "src1"),
                                 (-4, "the of that", "en", "src1"), (-5, "12345", "fr", None)], docs.schema)
    frame = docs.unionByName(odd).selectExpr("*", "'x' AS post", "'y' AS fit", "3 AS n")
    got = language.identify(frame).collect()
    assert len(got) == docs.count() + 7
    by = {r.doc_id: r for r in got}
    assert all(not by[i].accepted and by[i].lang == "und" for i in (-1, -2, -3, -5))
    assert by[-4].accepted and by[-4].lang == "en"
    kept = language.identified(frame)
    assert kept.columns == frame.columns and kept.count() == sum(r.accepted for r in got)


def test_tables_without_languages_and_empty_tables(spark):
    bare = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.lang, r.accepted) for r in language.identify(bare).collect()} == {(1, "und", False), (2, "und", False)}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert language.identify(empty).collect() == []


def test_pages_give_their_evidence(spark, sf):
    rows = language.page_evidence(table(spark, sf, "pages"))
    got = language.identify(rows).groupBy("lang").count().collect()
    assert {r.lang for r in got} >= {"en", "fr"}


def test_a_rare_language_of_a_large_table_is_kept(spark):
    rare = "zvirokwazvo ndinoda kutaura navanhu vose vokumusha nhasi mangwanani"
    rows = [(k, "the cat sat on the mat and the dog ran to the house", "en") for k in range(3000)]
    rows += [(5000, rare, "sn"), (5001, rare + " zvakare", "sn"), (5002, "ndinoda kutaura zvakare navanhu vose", None), (5003, "the dog ran", "und"), (5004, "the dog sat", "und")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang == "sn" and got[k].accepted for k in (5000, 5001, 5002))
    assert all(got[k].lang == "en" for k in (0, 2999, 5003, 5004))


def test_every_suffix_has_its_reliability(spark):
    seen = spark.range(300).selectExpr("CAST(id AS STRING) AS suffix", "array(0.25D, 0.75D) AS post")
    got = language._reliability(seen, "suffix", 2).collect()
    assert len({r.suffix for r in got}) == 300
    assert all(abs(r.suffix_log[0] - math.log(0.75 / (75 + 150.5))) < 1e-9 for r in got)
