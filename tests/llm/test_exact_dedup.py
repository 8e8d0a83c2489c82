"""Stateful exact deduplication against a dictionary of normalised texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from webtrail.llm import exact_dedup
from webtrail.llm.common import table, work_path
from webtrail.llm.exact_dedup import Source

SCHEMA = "doc_id long, text string, digest string, path string, _metadata int, _segment int"


def plain(rows):
    """{doc_id: (keep_id, group_size, kept, sha256)} of (doc_id, text) with distinct ids."""
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def found(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def write(spark, path, rows, mode="append"):
    # Extra columns, some with names that the operator uses itself.
    spark.createDataFrame([(*r, "d", "p", 1, 2) for r in rows], SCHEMA).coalesce(1).write.mode(mode).parquet(path)


FIRST = [(7, "a  b"), (3, "a\tb"), (9, "A b"), (4, None), (5, ""), (6, " "), (10, "\n"), (11, "a b"), (12, "x" * 300_000), (13, "x" * 300_000 + " "), (14, "x" * 300_000)]
SECOND = [(1, "a b"), (2, "new"), (20, "new"), (21, "x" * 300_000)]


def test_against_all_rows(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert found(exact_dedup.op13(spark, sf)) == plain(rows)


def test_files_that_come_later_take_over_groups(spark):
    path, state = work_path(spark, "later"), work_path(spark, "state")
    write(spark, path, FIRST)
    assert found(exact_dedup.deduplicate(Source(spark, path), state)) == plain(FIRST)
    write(spark, path, SECOND)
    got = exact_dedup.deduplicate(Source(spark, path), state)
    assert found(got) == plain(FIRST + SECOND) and got.count() == len(FIRST + SECOND)
    # Nothing new: the state stays as it is.
    assert found(exact_dedup.deduplicate(Source(spark, path), state)) == plain(FIRST + SECOND)


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_many_batches_give_what_one_gives(spark, size):
    path = work_path(spark, "batches")
    for row in FIRST + SECOND:
        write(spark, path, [row])
    assert found(exact_dedup.deduplicate(Source(spark, path), batch_bytes=size)) == plain(FIRST + SECOND)


def test_texts_with_one_digest_are_told_apart(spark):
    """With one digit as the digest nearly all rows are hits."""
    path = work_path(spark, "weak")
    rows = FIRST + SECOND + [(100 + i, f"text {i % 40}") for i in range(200)]
    write(spark, path, rows)
    weak = Source(spark, path, key=lambda sha: F.encode(F.substring(sha, 1, 1), "UTF-8"))
    assert found(exact_dedup.deduplicate(weak)) == plain(rows)


def test_null_and_repeated_ids(spark):
    path = work_path(spark, "ids")
    write(spark, path, [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (5, "c"), (5, "d")])
    got = exact_dedup.deduplicate(Source(spark, path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
        (False, 3, 3, 4, False), (False, 3, 3, 4, True), (False, 5, 5, 1, True), (False, 5, 5, 1, True),
        (True, 0, 0, 2, False), (True, 0, 0, 2, True), (True, 0, 3, 4, False), (True, 0, 3, 4, False)]


def test_settings_and_empty_folder(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    path = work_path(spark, "none")
    write(spark, path, [])
    assert exact_dedup.deduplicate(Source(spark, path)).collect() == []
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_no_python_in_the_plan(spark, sf):
    source = Source(spark, f"{sf}/documents.parquet")
    state = work_path(spark, "plan")
    exact_dedup.ingest(source, state)
    plan = exact_dedup.resolved(source, exact_dedup.owners(spark, state))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
