from collections import Counter

import numpy as np
import sentencepiece

from webtrail.llm import pieces
from webtrail.llm.common import table

HARD = [None, "", " ", "a", "  two  spaces \n", "▁ literal ▁▁", "é☃𝄞́", "x" * 20000, "tab\tcr\r\x00\x1f", "Hello world, this is a test."]


def docs_of(spark, sf):
    hard = spark.createDataFrame([(10 ** 7 + i, t) for i, t in enumerate(HARD)] + [(None, "null key"), (1, "same"), (1, "same")], "doc_id long, text string")
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(hard)


def test_round_trip_and_reproducible(spark, sf):
    docs = docs_of(spark, sf)
    one = pieces.encode(docs.selectExpr("*", "1 AS key", "2 AS n_pieces"))
    got = one.collect()
    assert all(r.lossless and r.n_pieces == len(r.piece_ids) for r in got)
    again = {(r.doc_id, tuple(r.piece_ids)) for r in pieces.encode(docs.repartition(13)).collect()}
    assert again == {(r.doc_id, tuple(r.piece_ids)) for r in got}
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(one).collect()), key=str)
    assert back == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    other = {r.doc_id: r.piece_ids for r in pieces.encode(docs, seed=18).collect()}
    assert any(other[r.doc_id] != r.piece_ids for r in got)


def test_the_library_decodes_the_pieces():
    sampler = pieces.Sampler(pieces.vocabulary(), 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids, counts = sampler.encode(HARD, np.arange(len(HARD), dtype=np.uint64))
    at = 0
    for text, n in zip(HARD, counts):
        if text != "tab\tcr\r\x00\x1f":
            assert sp.decode([int(i) for i in ids[at:at + n]]) == (text or "")
        at += n


def test_samples_follow_the_lattice():
    """Shares of sampled segmentations against their exact probabilities."""
    words = pieces.vocabulary(alpha=0.6)
    sampler = pieces.Sampler(words, 9)
    unit = " then"
    weights = Counter()

    def spell(at, path, weight):
        if at == len(unit):
            weights[tuple(path)] += np.exp(weight)
        for end in range(at + 1, len(unit) + 1):
            piece = words.pieces.get(unit[at:end])
            if piece:
                spell(end, [*path, piece[0]], weight + piece[1])

    spell(0, [], 0.0)
    n = 20000
    ids, counts = sampler.encode(["then"] * n, pieces._keys(__import__("pyarrow").array(range(n))))
    ends = np.concatenate(([0], np.cumsum(counts)))
    seen = Counter(tuple(int(i) for i in ids[a:b]) for a, b in zip(ends, ends[1:]))
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for path, weight in weights.items():
        assert abs(seen[path] / n - weight / total) < 0.015


def test_empty_table(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
