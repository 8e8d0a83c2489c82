"""Alignment of two tokenizers against a reading token by token with the general encoders."""

import hashlib
import json
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from webtrail.llm import alignment
from webtrail.llm.common import table

ODD = [None, "", " ", "  ", "a▁b", "▁", "<|endoftext|> x <s></s>", "é\U0001F600 é", "\n\n\t a", "<0x41>", "x" * 20_000, " " * 5_000 + "y", "It's 12'll we'VE", "a b c\u0085d"]


@pytest.fixture(scope="module")
def sides():
    """Plain encoders: (ids, bytes of each token)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    alphabet = alignment.byte_alphabet()

    def encode_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids]

    def encode_b(text):
        ids = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids]
        return ids, [bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]

    return encode_a, encode_b


def plain(rows, sides):
    """{key: the query's columns} of (key, text)."""
    found, links = {}, {}
    for key, text in rows:
        groups = []
        if text:
            (a, ab), (b, bb) = sides[0](text), sides[1](text)
            if b"".join(ab) == b"".join(bb) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                cuts = sorted(set(ends_a) & set(ends_b))
                groups = [([], []) for _ in cuts]
                for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
                    for i, e in zip(ids, ends):
                        groups[bisect_left(cuts, e)][side].append(i)
        links[key] = [(x[-1], y[-1]) for x, y in groups]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found[key] = [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), hashlib.sha256(shown.encode()).hexdigest() if groups else ""]
    counts = Counter(p for v in links.values() for p in v)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return {k: (*v[:3], len(links[k]), sum(counts[p] == most[p[1]] for p in links[k]), sum(counts[p] for p in links[k]), v[3]) for k, v in found.items()}


def found(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_against_every_token(spark, sf, sides):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert found(alignment.op12(spark, sf)) == plain(rows, sides)


def test_odd_texts_in_small_chunks(spark, sf, sides, monkeypatch):
    rows = list(enumerate(ODD + [r.text for r in table(spark, sf, "documents").limit(40).collect()] + ODD))
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, chunk string, place int, kind int").repartition(3)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2_000)
    assert found(alignment.align(docs)) == plain(rows, sides)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a text"), (1, "a text"), (None, "a text"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_links, r.n_best, r.count_sum) for r in alignment.align(docs).collect())
    n = got[-1][1]
    assert n and got == [(0, 0, 0, 0), (0, n, n, 3 * n), (1, n, n, 3 * n), (1, n, n, 3 * n)]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pointer_jumping_finds_components():
    """Components of the overlap graph, found by search, on random cuts of a line."""
    dice = random.Random(5)
    for _ in range(200):
        n = dice.randint(1, 60)
        cut = lambda: np.array(sorted({*dice.sample(range(1, n + 1), dice.randint(0, n)), n}))
        a, b = cut(), cut()
        nodes = [(s, e, k) for k, ends in enumerate((a, b)) for s, e in zip([0, *ends.tolist()], ends.tolist())]
        seen = list(range(len(nodes)))
        for i, (s, e, k) in enumerate(nodes):
            for j, (s2, e2, k2) in enumerate(nodes):
                if k != k2 and s < e2 and s2 < e:
                    old, new = seen[i], seen[j]
                    seen = [new if x == old else x for x in seen]
        last = alignment.terminals(a, b).tolist()
        assert len({*zip(seen, last)}) == len(set(seen)) == len(set(last))
        assert all(b[t] == max(nodes[i][1] for i in range(len(nodes)) if last[i] == t) for t in set(last))


def test_both_encoders_of_the_byte_level_side_agree():
    """The fast one against the general one: every letter, digit, mark and space that Unicode has in
    a short setting, and random strings of pieces of the vocabulary."""
    with open(alignment.BYTE_LEVEL, encoding="utf-8") as f:
        source = f.read()
    spec = json.loads(source)
    assert alignment._plain(spec)
    general = json.loads(source)
    general["normalizer"] = {"type": "Sequence", "normalizers": []}  # does nothing, but is not plain
    fast, slow = alignment.byte_level(source), alignment.byte_level(json.dumps(general))
    dice = random.Random(9)
    points = [c for c in [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 5)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" a{chr(c)}b {chr(c)}1{chr(c)}" for c in points[k:k + 200]) for k in range(0, len(points), 200)]
    pieces = [e for e in spec["model"]["vocab"] if e.isascii() and e.isalpha()]
    texts += ["".join(dice.choices(pieces, k=400)) for _ in range(60)]
    assert fast.encode(texts) == slow.encode(texts)
