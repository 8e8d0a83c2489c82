"""Personal data against a plain reading of the contract."""

import hashlib
import re

from webtrail.llm import pii
from webtrail.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    out, counts = [], []
    for kind, pattern in PATTERNS.items():
        n = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits),
                    "phone": 8 <= len(digits) <= 15}[kind]
            if fits:
                n += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return counts, hashlib.sha256(",".join(out).encode()).hexdigest(), out


HARD = [
    None, "", "é a.b@c.d e", "a@b.com_x@c.d y@z", "x@@y.com a@b.c.d.e-f.g @q.r", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 12.3 4.5.6.7",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 41111111  11111111", "+1 (499) 555-6503 +12 +1234567 +12345678 ++1 2345 6789 +1(((((((2345678",
    "9" * 5000, "a." * 4000 + "@b.c", "😀 card 5500 0000 0000 0004 mail x@y.zz 10.0.0.1!", "a@b.c" * 50, "+1 555 123 4567 4111111111111111 +4111111111111111",
    "call (555) 123-4567 now, amex 3782 822463 10005, host 2001:0db8:0000:0000:0000:ff00:0042:8329 ok; bob (at) example (dot) com",
]


def test_base_spans_are_those_of_the_contract(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    hard = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    docs = docs.unionByName(hard)
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = pii.find(docs).collect()
    assert len(got) == len(want)
    for r in got:
        counts, digest, base = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == digest
        assert set(base) <= set(r.spans.split(",") if r.spans else [])
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in r.spans.split(",") if s)]
        assert order == sorted(order)


def test_redaction_leaves_clean_texts_and_other_columns(spark):
    rows = [(1, "nothing here", "x"), (2, "mail a@b.com and +1 (499) 555-6503.", None), (3, None, "y"), (4, "", "z"), (2, "mail a@b.com and +1 (499) 555-6503.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, candidates string")
    got = sorted(pii.redact(docs).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([
        (1, "nothing here", "x"), (2, "mail <EMAIL> and <PHONE>.", None), (3, None, "y"), (4, "", "z"), (2, "mail <EMAIL> and <PHONE>.", None)], key=str)


def test_redaction_of_overlapping_spans_leaves_nothing_of_them(spark):
    texts = ["10.0.0.0 4111 1111 1111 1111", "pay 10.0.0.0 4111 1111 1111 1111 now, or +1 (499) 555-6503", "10.0.0.1, 4111 1111 1111 1111."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {0: "<IP><CARD>", 1: "pay <IP><CARD> now, or <PHONE>", 2: "<IP>, <CARD>."}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).collect() == []
    assert pii.redact(empty).collect() == []


def test_no_python_in_the_plan(spark, sf):
    plan = pii.find(table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|RDD\\[", plan.replace("MapPartitionsRDD", ""))


def test_reliabilities_follow_the_votes():
    patterns = [(0, (1, 1, 0, 1, 1), 900), (0, (-1, -1, 0, -1, 0), 300), (0, (1, 1, 1, 1, 1), 100)]
    post = pii.reliabilities(patterns)
    assert post[0, (1, 1, 0, 1, 1)] > 0.9 > 0.1 > post[0, (-1, -1, 0, -1, 0)]
