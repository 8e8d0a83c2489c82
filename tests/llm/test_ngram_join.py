"""The n-gram join against all pairs."""

import itertools
import random

import numpy as np
import pytest

from webtrail.llm import ngram_join
from webtrail.llm.common import components, table


def grams(text, width):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {b" ".join(w)} if w else set()


def plain(rows, width, percent):
    """Components and links by comparing every pair; a doc_id may stand in several rows."""
    top = {i: i for i, _ in rows if i is not None}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    sets = [grams(t, width) for _, t in rows]
    links = [0] * len(rows)
    for a, b in itertools.combinations([k for k, (i, _) in enumerate(rows) if i is not None and sets[k]], 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = find(rows[a][0]), find(rows[b][0])
            top[max(p, q)] = min(p, q)
            links[a] += 1
            links[b] += 1
    return sorted(((i, len(sets[k]), None if i is None else find(i), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def made(seed, copies=60, words=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(80)]
    rows, at = [], 1
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([words, 60, 12]))]
        for _ in range(copies if len(base) == words else 12):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(text) // 40))):
                k = rng.randrange(len(text))
                text[k:k + 1] = rng.choice([[], [rng.choice(vocabulary)], [text[k], rng.choice(vocabulary)]])
            rows.append((at, " ".join(text)))
            at += 1
    for _ in range(40):  # one passage, otherwise different
        rows.append((at, " ".join([*shared, *(rng.choice(vocabulary) for _ in range(rng.randrange(5, 90)))])))
        at += 1
    rng.shuffle(rows)
    return rows


EDGES = [(900, None), (901, ""), (902, "  \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one  two"), (907, "one two three"), (908, "One Two Three"),
         (909, "café ÉTÉ x"), (910, "café été x"), (None, "one two three"), (None, None), (911, "a b c d e f g h i j"), (911, "a b c d e f g h i j"), (912, "x " * 5000)]


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_components_are_those_of_all_pairs(spark, width, percent, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = made(seed) + EDGES
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in ngram_join.join(docs, width, percent).collect()), key=str)
    assert got == plain(rows, width, percent)


def test_tables_of_the_test_data(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 150")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in ngram_join.join(docs).collect()), key=str)
    assert got == plain(rows, 3, 90)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(3, text, "a"), (2, text, "b"), (2, text, "b"), (5, "other words", None), (None, text, "n")], "doc_id long, text string, node string")
    got = sorted((r.doc_id, r.node) for r in ngram_join.keep_one(docs).collect() if r.doc_id is not None)
    assert got == [(2, "b"), (5, None)]
    assert ngram_join.keep_one(docs.where("false")).collect() == []


def test_texts_that_stay_are_not_dealt(spark):
    """Each id stands once and no text is alike to another: what is joined to tell copies apart has no row."""
    docs = [(k, " ".join(f"w{k}x{j}" for j in range(9)), k) for k in range(50)] + [(50, "a copy of it", 50), (51, "a copy of it", 51)]
    got = ngram_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string, _id int"))
    first = got._jdf.queryExecution().optimizedPlan().children().head()
    assert "Join" not in first.toString()
    assert sorted(r.doc_id for r in got.collect()) == list(range(51))


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_trees_find_every_pair_that_can_link():
    rng = np.random.default_rng(3)
    percent = 80
    records = []
    for k in range(60):
        base = np.arange(40) + 100 * (k // 12)
        codes = np.unique(np.concatenate((rng.choice(base, 36, replace=False), rng.integers(1000, 1100, 3))))
        size = ngram_join.prefix_size(len(codes), percent)
        records.append({"node": k, "component": k, "n": len(codes), "size": size, "last": int(codes[size - 1]), "path": codes[:size].tolist(),
                        "weights": [1] * size, "all": set(codes.tolist())})
    found = set()
    for code in {c for r in records for c in r["path"]}:
        group = [r for r in records if code in r["path"]]
        found |= {(max(p), min(p)) for p in ngram_join.tree_pairs(code, group, group, percent)}
    want = {(a["node"], b["node"]) for a in records for b in records if a["node"] > b["node"]
            and 100 * len(a["all"] & b["all"]) >= percent * len(a["all"] | b["all"])}
    assert want and want <= found


def test_marks_bound_what_sets_share():
    rng = np.random.default_rng(4)
    for n in (1, 30, 400, 60_000):
        codes = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        one, other = codes[: n - n // 10], codes[n // 10:]
        r, q = ({"n": len(c), "marks": np.frombuffer(ngram_join.marks(c), np.uint8)} for c in (one, other))
        share = 100 * len(np.intersect1d(one, other)) // len(codes)
        assert ngram_join.may_link(r, q, share)
        assert n != 400 or not ngram_join.may_link(r, q, 95)


def test_pairs_below_the_threshold_are_no_rows(spark, monkeypatch):
    """80 copies of a text with a word changed in each: every two are alike to less than 90 percent."""
    words = [f"w{k}" for k in range(62)]
    docs = [(k, " ".join(f"changed{k}" if at == 3 * (k % 20) + 1 else w for at, w in enumerate(words))) for k in range(80)]
    seen, plainly = [], ngram_join.verified

    def counted(pairs, sets, percent):
        seen.append(pairs.count())
        return plainly(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "verified", counted)
    rows = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in rows), key=str) == plain(docs, 3, 90)
    assert sum(seen) < 600


def test_links_of_a_component_are_counted_and_no_rows(spark, monkeypatch):
    """60 texts that all link with one another, ids that stand for two of them, and copies: 1,770 links
    and more, but a few rows for each text."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(f"changed{k}" if at == 6 * k + 1 else w for at, w in enumerate(words))) for k in range(60)]
    docs += [(k + 100, docs[k][1]) for k in range(5)] + [(7, docs[30][1]), (200, "a b c d e f g h i j k l m n o p q r s t u v w"), (201, "a b c d e f g h i j k l m n o p q r s t u v w x")]
    written, plainly = [], ngram_join.stored

    def counted(df, name):
        out = plainly(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    want = {}
    for i, n, component, links in plain(docs, 3, 90):
        want.setdefault(i, []).append((n, component, links))
    got = {}
    for i, n, component, links in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(i, []).append((n, component, links))
    assert {i: sorted(v) for i, v in got.items() if i not in (7, 30)} == {i: sorted(v) for i, v in want.items() if i not in (7, 30)}
    assert max(rows for name, rows in written if name in ("links", "held", "link-counts")) <= 70


def test_sets_are_not_dealt_and_codes_travel_as_fingerprints(spark, monkeypatch):
    """The sets of texts whose id stands once are written by the pass that makes them, and the codes of
    a task are a row for each bucket, not a row each."""
    plans, plainly = {}, ngram_join.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plainly(df, name)

    monkeypatch.setattr(ngram_join, "stored", watched)
    rows = made(6, copies=6)
    got = sorted((tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain(rows, 3, 90)
    assert "Exchange" not in plans["whole"] and "Join" not in plans["whole"]
    assert not [name for name, plan in plans.items() if name.startswith("shared") and "Aggregate" in plan]


def test_fingerprints_that_collide_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PRINT_BITS", 2)
    monkeypatch.setattr(ngram_join, "BUCKET_CODES", 64)
    rows = made(5, copies=12, words=100) + EDGES
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in ngram_join.join(docs, 5, 80).collect()), key=str) == plain(rows, 5, 80)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
