import math

import numpy as np
import pytest

from webtrail.llm import embeddings


def made(seed=2, n=400, size=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        rows.append((k, rng.normal(size=size).tolist(), int(k % 3)))
    centre = rng.normal(size=size)
    for k in range(n, n + 150):
        rows.append((k, (centre + rng.normal(size=size) * 0.11).tolist(), 1))
    for k in range(n + 150, n + 180):
        rows.append((k, centre.tolist(), 1))
    return rows


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 15 + [None], 1), (9004, [math.nan] + [1.0] * 15, 1), (9005, [math.inf] + [1.0] * 15, 1), (9006, [1.0] * 16, None),
       (9007, [], 1), (None, [1.0] * 16, 1), (9008, [1.0, 2.0], 1), (9009, [2.0, 4.0], 1), (9010, [1e300] * 16, 2), (9011, [1e-200] * 16, 2), (9012, [3.0], 0), (9012, [3.0], 0)]


def plain(rows, threshold):
    fine = [(i, np.array(v, float), label) for i, v, label in rows
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    links, top = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(fine)):
        for b in range(a):
            (i, v, x), (j, w, y) = fine[a], fine[b]
            if x == y and len(v) == len(w):
                v, w = v / np.abs(v).max(), w / np.abs(w).max()
                if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    top[max(p, q)] = min(p, q)
    return links, {i: find(i) for i in links}


@pytest.mark.parametrize("block", [4, 64])
def test_links_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = made() + ODD
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS cell", "'x' AS v")
    got = embeddings.duplicates(frame).collect()
    links, groups = plain(rows, embeddings.THRESHOLD)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got if r.vec_id != 9012)
    want = sum(v for i, v in links.items() if i is not None and i != 9012)
    assert found >= 0.97 * want and all(r.n_links <= links[r.vec_id] for r in got if r.vec_id not in (None, 9012))
    assert all(r.component_id == groups[r.vec_id] for r in got if r.vec_id is not None)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, None)]
    assert [r.n_links for r in got if r.vec_id == 9012] == [1, 1]


def test_visits_begin_at_home_and_reach_the_target():
    rng = np.random.default_rng(4)
    x = embeddings._unit(rng.normal(size=(2000, 32)))
    index = embeddings.fit(x[:1000], 50_000, 0.98)
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    partner = embeddings._unit(0.98 * x + math.sqrt(1 - 0.98 ** 2) * embeddings._unit(turn))
    seen, home = embeddings.visits(index, x[1000:]), [v[0] for v in embeddings.visits(index, partner[1000:])]
    assert np.mean([h in v for h, v in zip(home, seen)]) > 0.97


def test_empty_table(spark):
    assert embeddings.duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
