"""Fuzzy search for short licence notices.

A text is folded (A-Z lowered, every other ASCII byte that is no letter or digit becomes a
space) into words. Each notice is cut into k+1 parts; by the pigeonhole principle a place that
differs from the notice in at most k edits holds one of the parts unchanged. The parts are
looked up exactly; around each place found, the regex library's bounded-error matching
verifies the edits and gives the span. Spans of a notice do not overlap: those with the fewest
edits are taken first, then what is left of the windows beside them is searched again. Exact
places of the base phrases are counted apart.

Defined cases: a null or empty text has no words, no places, empty labels and score 0. A
repeated row is answered twice. Texts are read whole, whatever their length. Other columns
of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from webtrail.llm.common import query, table, text_pass

# Base phrases with their labels, in the contract's order.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Notices that the search allows edits in: words, label, edits (letters).
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("released under the mit license", "mit", 3),
    ("licensed under the mit license", "mit", 3),
    ("licensed under cc by", "cc-by", 2),
    ("creative commons attribution", "cc-by", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("permission is hereby granted free of charge", "mit", 4),
    ("all rights reserved", "proprietary", 2),
]

FOLD = bytes(b if b > 0x7F or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
          " score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int,text:string>>")

ARROW = pa.schema([
    *((name, pa.int64()) for name in ("doc_id", "n_words", "n_base", "first_word", "last_word")),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))),
])


def seeds(notice: bytes, edits: int) -> list[tuple[bytes, int]]:
    """edits + 1 parts of about equal length, each with its offset in the notice."""
    n, parts = len(notice), edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Finder:
    def __init__(self, base=BASE, notices=NOTICES):
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base]
        self.notices = []
        for words, label, edits in notices:
            raw = words.encode()
            pattern = regex.compile(rb"(?b)(?<![^ ])(?:" + regex.escape(raw, special_only=True) + rb"){e<=%d}(?![^ ])" % edits)
            self.notices.append((raw, label, edits, seeds(raw, edits), pattern))
        every: dict[bytes, list[tuple[int, int]]] = {}
        for at, (_, _, _, parts, _) in enumerate(self.notices):
            for part, offset in parts:
                every.setdefault(part, []).append((at, offset))
        self.parts = every

    def places(self, text: bytes) -> dict[int, list[tuple[int, int]]]:
        """Windows of `text` per notice that hold one of its parts where it may belong."""
        out: dict[int, list[tuple[int, int]]] = {}
        for part, uses in self.parts.items():
            at = text.find(part)
            while at >= 0:
                for which, offset in uses:
                    raw, _, edits, _, _ = self.notices[which]
                    low = max(0, at - offset - edits - 1)
                    high = min(len(text), at - offset + len(raw) + edits + 1)
                    out.setdefault(which, []).append((low, high))
                at = text.find(part, at + 1)
        return out

    def fuzzy(self, text: bytes) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, similarity) of verified places in a folded text."""
        found = set()
        for which, windows in self.places(text).items():
            raw, label, most, _, pattern = self.notices[which]

            def search(low: int, high: int) -> list[tuple[int, int, int, int, int]]:
                """The best place in a window as (edits, start, end, low, high). The window is cut
                at its last space, as the pattern takes a window's end for the end of a word."""
                high = text.rfind(b" ", low, high + 1)
                if high - low < len(raw) - most:
                    return []
                m = pattern.search(text, low, high)
                return [(sum(m.fuzzy_counts), m.start(), m.end(), low, high)] if m else []

            heap = [best for window in set(windows) for best in search(*window)]
            heapify(heap)
            taken: list[tuple[int, int]] = []
            while heap:
                edits, start, end, low, high = heappop(heap)
                at = bisect(taken, (start, end))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    insort(taken, (start, end))
                    found.add((label, start, end, edits, 1 - edits / len(raw)))
                # The same window without what is taken of it.
                at = max(0, bisect(taken, (low, low)) - 1)
                while at < len(taken) and taken[at][0] < high:
                    for best in search(low, taken[at][0]):
                        heappush(heap, best)
                    low = max(low, taken[at][1])
                    at += 1
                for best in search(low, high):
                    heappush(heap, best)
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def exact(self, text: bytes) -> list[tuple[int, str]]:
        """(byte offset, label) of every base phrase; the text has a space at both ends."""
        out = []
        for phrase, label in self.base:
            at = text.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = text.find(phrase, at + 1)
        return out


def scan_text(finder: Finder, text: str | None) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    folded = b" " + b" ".join(words) + b" "
    exact = finder.exact(folded)
    starts = [folded.count(b" ", 0, at) for at, _ in exact]
    base = sorted({label for _, label in exact})
    spans, score = [], 1.0 if exact else 0.0
    for label, low, high, edits, likeness in finder.fuzzy(folded):
        piece = folded[low:high].strip()
        first = folded.count(b" ", 0, low) - (0 if folded[low:low + 1] == b" " else 1)
        spans.append({"label": label, "first_word": first, "last_word": first + piece.count(b" "), "edits": edits, "text": piece.decode("utf-8", "replace")})
        score = max(score, likeness)
    labels = sorted({*base, *(s["label"] for s in spans)})
    return len(words), len(exact), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, spans


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text -> one row of SCHEMA per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low in range(0, len(ids), 500):
                rows = [scan_text(finder, t.as_py()) for t in texts.slice(low, 500)]
                columns = [ids.slice(low, 500), *(pa.array(list(c), ARROW.field(i + 1).type) for i, c in enumerate(zip(*rows)))]
                yield pa.RecordBatch.from_arrays(columns, schema=ARROW)

    return text_pass(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text"), work, SCHEMA)


@query("op8_license_scan")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return scan(table(spark, sf, "documents"))
