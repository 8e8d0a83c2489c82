import math

import numpy as np

from webtrail.llm import quality
from webtrail.llm.common import table


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.classify(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").collect()
    right = sum(r.keep == (r.quality == 1) for r in got)
    assert len(got) > 300 and right >= 0.97 * len(got)


def test_odd_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "One."), (None, "The and of the."), (-5, "spam " * 4000), (-6, "ab | cd | " * 200), (-6, "ab | cd | " * 200)], docs.schema)
    got = quality.classify(docs.unionByName(odd).selectExpr("*", "1 AS pattern", "2 AS x")).collect()
    assert len(got) == docs.count() + 8 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert not any(by[i].keep for i in (-1, -2, -3, -5, -6)) and by[-1].score == 0
    assert quality.classify(docs.where("false")).collect() == []


def test_label_model_finds_reliable_heuristics():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    # Each heuristic finds its defect in some bad texts and hardly ever in a good one.
    votes = np.stack([np.where(rng.random(4000) < np.where(truth, 0.01, share), -1, 1) for share in (0.9, 0.8, 0.7)], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, like, share = quality.label_model(patterns, counts.astype(float))
    assert 0.75 < share < 0.85 and ((post[inverse.ravel()] > 0.5) == truth).mean() > 0.93


def test_measures():
    text = "a a b | c\nx\nx"
    data = np.frombuffer(text.encode(), np.uint8)
    m, n, lines = quality.measure(data, np.array([0, len(data)]))
    got = dict(zip(quality.MEASURES, m[0]))
    assert n[0] == 7 and lines[0] == 3
    assert abs(got["again"] - 2 / 7) < 1e-9 and abs(got["lines"] - 1 / 3) < 1e-9 and abs(got["top"] - 2 / 7) < 1e-9 and abs(got["bars"] - 1 / 7) < 1e-9


def test_label_model_against_a_row_by_row_one():
    """Expectation-maximisation over every row by its definition, against the one over counted
    patterns."""
    rng = np.random.default_rng(7)
    rows = rng.choice([-1, 0, 1], size=(300, 4), p=[0.2, 0.3, 0.5]).tolist()
    belief = quality.PRIOR_WEIGHT * len(rows)
    post = [0.1 if -1 in r else 0.9 for r in rows]
    for _ in range(60):
        share = min(1 - 1e-3, max(1e-3, sum(post) / len(rows)))
        chance = []
        for h in range(4):
            each = []
            for good in (False, True):
                weight = [p if good else 1 - p for p in post]
                bad_votes = sum(w for w, r in zip(weight, rows) if r[h] == -1) + belief * quality.BAD_VOTE[int(good)]
                good_votes = sum(w for w, r in zip(weight, rows) if r[h] == 1) + belief * (1 - quality.BAD_VOTE[int(good)])
                each.append({-1: bad_votes / (bad_votes + good_votes), 0: 1.0, 1: good_votes / (bad_votes + good_votes)})
            chance.append(each)
        post = []
        for r in rows:
            yes, no = share, 1 - share
            for h, v in enumerate(r):
                yes, no = yes * chance[h][True][v], no * chance[h][False][v]
            post.append(yes / (yes + no))
    patterns, inverse, counts = np.unique(np.array(rows), axis=0, return_inverse=True, return_counts=True)
    got, like, found = quality.label_model(patterns, counts.astype(float))
    assert math.isclose(found, share, abs_tol=1e-9)
    assert np.allclose(got[inverse.ravel()], post, atol=1e-9)
    assert all(math.isclose(like[h, c, v + 1], chance[h][c][v], abs_tol=1e-9) for h in range(4) for c in (0, 1) for v in (-1, 0, 1))
