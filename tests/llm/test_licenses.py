import random
import re

from webtrail.llm import licenses
from webtrail.llm.common import table


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


HARD = [None, "", "...", "MIT--License", "the mit  license, mit license mit license", "mit licenses", "xmit license", "Apache License CC-BY 4.0 cc by", "é MIT\nLicense ÉÉ",
        "gnu general public license " * 3000, "mit" + "\x7f" + "license"]


def test_base_places_are_those_of_the_contract(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10 ** 7 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = licenses.scan(docs.selectExpr("*", "1 AS spans", "'x' AS labels")).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert not r.base_labels or r.score == 1


def test_edits_within_the_bound_are_found():
    finder = licenses.Finder()
    near = licenses.scan_text(finder, "Relased undr the MIT Licence. more words")
    assert near[5] == "mit" and near[4] == "" and 0 < near[6] < 1
    span = near[7][0]
    assert (span["first_word"], span["last_word"], span["edits"]) == (0, 4, 3)
    assert licenses.scan_text(finder, "released over a smitten silence") [5] == ""


def test_near_notices_beside_better_ones_are_found():
    finder = licenses.Finder()
    spans = lambda text: [(s["first_word"], s["last_word"], s["edits"]) for s in licenses.scan_text(finder, text)[7]]
    assert spans("all right reserved all rights reserved") == [(0, 2, 1), (3, 5, 0)]
    assert spans("licenced undr the mit license licensed under the mit license") == [(0, 4, 2), (5, 9, 0)]
    assert spans("all rights reserved all right reserved") == [(0, 2, 0), (3, 5, 1)]
    assert spans("all right reserved " * 1000 + "all rights reserved") == [(3 * k, 3 * k + 2, int(k < 1000)) for k in range(1001)]


def test_every_text_within_the_bound_holds_a_seed():
    for words, _, edits in licenses.NOTICES:
        raw = words.encode()
        parts = licenses.seeds(raw, edits)
        assert len(parts) == edits + 1 and b"".join(p for p, _ in parts) == raw and all(raw[o:o + len(p)] == p for p, o in parts)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_places_against_every_window():
    """Every run of whole words, by its edit distance: what is reported has the edits it says, and
    every run within the bound meets a reported place that is no worse."""
    dice = random.Random(12)
    notices = [("all rights reserved", "arr", 3), ("mit license", "mit", 1)]
    finder = licenses.Finder(notices=notices)
    words = ["all", "rights", "reserved", "mit", "license", "al", "right", "licence", "rightsx", "reservd", "a", "the", "allrights"]
    met = 0
    for _ in range(900):
        text = " " + " ".join(dice.choice(words) for _ in range(dice.randint(1, 14))) + " "
        got = finder.fuzzy(text.encode())
        starts = [k + 1 for k, c in enumerate(text[:-1]) if c == " "]
        ends = [k for k, c in enumerate(text) if c == " " and k]
        for notice, label, most in notices:
            mine = [(low, high, n) for name, low, high, n, _ in got if name == label]
            for low, high, n in mine:
                assert edits_between(text[low:high], notice) <= n <= most
            for low in starts:
                for high in ends:
                    if low < high and abs(high - low - len(notice)) <= most:
                        n = edits_between(text[low:high], notice)
                        if n <= most:
                            met += 1
                            assert any(a < high and low < b for a, b, _ in mine), (text, label, text[low:high])
    assert met > 100
