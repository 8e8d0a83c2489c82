import hashlib

import pytest

from webtrail.llm import warc
from webtrail.llm.common import work_path

LONG = "<p>" + "é" * 100
ROWS = [(3, "http://a/x", LONG), (1, "http://a/y z\r\n", LONG), (2, None, LONG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
        (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" + LONG), (None, "n", LONG), (1, "http://a/y", LONG)]


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' AS digest", "1 AS bytes", "'y' AS header")
    return warc.write(pages, work_path(spark, "warc-test"))


def test_records_come_back_whole(spark, archive):
    got = warc.records(spark, archive).collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = {(p, (h or "")) for p, _, h in ROWS}
        assert (r.page_id, bytes(r.payload).decode()) in want
        assert r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest() and r.payload_bytes == len(r.payload)
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and block.endswith(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert len(block) == length + 4 and (r.record_type == "revisit") == (length == 0 and len(r.payload) > 0)


def test_first_copies_are_responses(spark, archive):
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.records(spark, archive).where("payload_bytes = 203").collect()}
    assert got == {(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1)}
    small = warc.records(spark, archive).where("payload_bytes < 100")
    assert {r.record_type for r in small.collect()} == {"response"}


def test_payloads_are_stored_once(spark, archive):
    stored = spark.read.parquet(archive.payloads)
    assert stored.count() == len({h or "" for _, _, h in ROWS})


def test_damage_is_an_error(spark, archive):
    path = work_path(spark, "warc-damaged")
    spark.read.parquet(archive.payloads).selectExpr("digest", "concat(payload, encode('x', 'UTF-8')) AS payload", "bytes", "first_id").write.parquet(path)
    with pytest.raises(Exception, match="damaged payload"):
        warc.records(spark, warc.Archive(archive.headers, path)).collect()


def test_export_is_warc_text(spark, archive):
    path = work_path(spark, "warc-files")
    warc.export(warc.records(spark, archive).where("page_id in (4, 5)").coalesce(1), path)
    whole = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/*.txt").collect())
    assert whole.count(b"WARC/1.1\r\n") == 2 and whole.endswith(b"short\r\n\r\n")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(spark, warc.write(empty, work_path(spark, "warc-empty"))).collect() == []
