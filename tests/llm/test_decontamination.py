import random
import re
from collections import Counter

from webtrail.llm import decontamination as de
from webtrail.llm.common import table


def grams(words, width):
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def best(text, item, similarity=0.8):
    """The best similarity of the item-sized windows that begin where a shared shingle says that
    the item would, and the window's first word."""
    words, wanted = re.findall(r"[^\W_]+", (text or "").lower()), re.findall(r"[^\W_]+", (item or "").lower())
    if not words or not wanted:
        return None
    width = min(5, len(wanted))
    own = Counter(grams(wanted, width))
    top = None
    places = {}
    for k, gram in enumerate(grams(wanted, width)):
        places.setdefault(gram, []).append(k)
    for start in sorted({at - k for at, gram in enumerate(grams(words, width)) for k in places.get(gram, [])}):
        have = Counter(grams(words[max(0, start):start + len(wanted)], width))
        both = sum((own & have).values())
        value = both / max(1, sum((own | have).values()))
        if value >= similarity - 1e-12 and (top is None or value > top[0]):
            top = (value, max(0, start))
    return top


def test_leaks_against_every_window(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(25, 60)))) for k in range(12)] + [(20, "tiny item here"), (21, ""), (22, None), (23, "...")]
    docs = []
    for k in range(60):
        body = [word() for _ in range(rng.randrange(0, 120))]
        if k % 2:
            passage = items[k % 12][1].split()
            for _ in range(k % 5 // 2):
                passage[rng.randrange(len(passage))] = word()
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((k, " ".join(body)))
    docs += [(100, items[3][1].upper().replace(" ", "!! ")), (101, "x Tiny, ITEM here y"), (102, None), (103, ""), (None, items[4][1]), (104, items[5][1]), (104, items[5][1]),
             (105, " ".join([items[6][1]] * 200))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS size", "3 AS start")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in de.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, text in docs:
        for k, item in items:
            found = best(text, item)
            if found:
                want[i, k] = round(found[0], 9)
    assert len(want) > 20 and set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-6 for p in want)
    kept = de.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, t in docs if not any((i, k) in want for k, _ in items)), key=str)


def slid(text, item, similarity=0.8):
    """The best similarity of the windows at every start, whole ones before cut ones, and the first
    such window's first word."""
    words, wanted = text.split(), item.split()
    width = min(5, len(wanted))
    own = Counter(grams(wanted, width))
    top = None
    for start in range(1 - len(wanted), len(words)):
        have = Counter(grams(words[max(0, start):start + len(wanted)], width))
        value = sum((own & have).values()) / sum((own | have).values())
        whole = 0 <= start <= len(words) - len(wanted)
        if value >= similarity - 1e-12 and (top is None or (whole, value) > top[:2]):
            top = (whole, value, max(0, start))
    return top and top[1:]


def test_windows_at_every_start(spark):
    rng = random.Random(11)
    run = lambda n, of: [f"{of}{rng.randrange(n)}" for _ in range(n)]
    halves = run(50, "a"), run(50, "b")
    items = [(0, " ".join(halves[0] + halves[1]))]
    docs = [(0, " ".join(run(9, "x") + halves[1] + halves[0] + run(9, "y"))), (1, " ".join(halves[1] + halves[0])), (2, " ".join((halves[1] + halves[0])[3:]))]
    for k in range(1, 9):  # parts in another order, repeated parts, few different words, cut ends
        parts = [[f"p{k}w{rng.randrange(1 + 5 * (k % 4))}" for _ in range(rng.randrange(8, 30))] for _ in range(3)]
        items.append((k, " ".join(w for p in parts for w in p)))
        for j in range(6):
            rng.shuffle(parts)
            body = run(5 * (j % 3), "x") + [w for p in parts + parts[:j % 2] for w in p] + run(5 * (j % 2), "y")
            docs.append((10 * k + j, " ".join(body[j % 4:len(body) - j % 3])))
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in de.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k): (round(found[0], 9), found[1]) for i, text in docs for k, item in items if (found := slid(text, item))}
    assert {(0, 0), (1, 0), (2, 0)} <= set(want) and len(want) > 20
    assert got == want


def test_repeated_words_do_not_hide_a_leak(spark):
    items, docs = [], []
    for k in range(20):
        body = " ".join(f"v{k}x{i}" for i in range(100))
        items.append((k, body + f" blank{k}" * 12))
        docs.append((k, body + f" other{k}" * 12))
    got = de.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(20)]
    assert all(abs(r.similarity - 0.8) < 1e-9 for r in got)


def test_plan_is_native_and_empty_tables(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    plan = de.leaks(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert de.leaks(docs.where("false"), items).collect() == []
    assert de.leaks(docs, items.where("false")).collect() == []
    assert de.clean(docs, items.where("false")).count() == docs.count()
