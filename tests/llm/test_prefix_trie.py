"""The conversations' trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from webtrail.llm import prefix_trie
from webtrail.llm.common import table
from webtrail.llm.prefix_trie import Forest

SCHEMA = "conv_id long, turn long, role string, text string, d int, path string, n int"


def rebuilt(rows):
    """{conv_id: [(role, text)]} of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain(rows):
    """All nodes as tuples in the order of the query's columns."""
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        if not kids[node]:
            leaves[node] = 1
        saved[node] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            kids[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), kids[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)


def test_against_all_prefixes(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf, "conversations").collect()]
    assert found(prefix_trie.op11(spark, sf)) == plain(rows)


def conversations(seed, n=150, words="abc", longest=9):
    dice = random.Random(seed)
    rows = []
    for c in dice.sample(range(-200, 900), n):
        for turn in range(dice.randint(1, longest)):
            # Texts that repeat, among them null ones; some turns without number or with the same one.
            rows.append((c, dice.choice([turn, turn, turn, turn, None, 0]), dice.choice(["user", "bot", None, ""]) if c % 3 else "user", dice.choice([*words, "x" * turn, None, ""])))
    return rows


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 2), (3, 1)])
def test_odd_conversations_in_small_blocks(spark, monkeypatch, seed, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 8)
    rows = conversations(seed)
    assert found(prefix_trie.trie(frame(spark, rows))) == plain(rows)


def test_copies_long_conversations_and_prefixes_of_one_another(spark):
    """A third of all conversations alike, one of many turns with a copy, one that ends in every node
    of another."""
    rows = [(c, t, "u", f"same {t}") for c in range(5, 65) for t in range(4)]
    rows += [(c, t, "u", f"long {t % 7}") for c in (1000, 1001) for t in range(900)]
    rows += [(2000 + k, t, "u", f"step {t}") for k in range(40) for t in range(k + 1)]
    rows += [(3000, 0, "u", "é\U0001F600"), (None, 0, "u", "left out"), (3101, 0, "u", "gone")]
    assert found(prefix_trie.trie(frame(spark, rows))) == plain(rows)


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_forest_of_sorted_items():
    """Every node of a partition: members, children and leaves against all common prefixes. Steps
    are (d, p1, p2, z) with z = d."""
    dice = random.Random(4)
    for _ in range(200):
        paths = sorted({tuple(dice.choices("ab", k=dice.randint(1, 5))) for _ in range(dice.randint(1, 12))})
        steps = [[(k + 1, hash_of(p[:k + 1]), 0, k + 1) for k in range(len(p))] for p in paths]
        order = sorted(range(len(paths)), key=lambda i: [s[:3] for s in steps[i]])
        steps = [steps[i] for i in order]
        weights = [(dice.randint(1, 3), i, 0) for i in range(len(steps))]
        tree = Forest(steps, weights)
        for node in range(len(tree.level)):
            top = tree.path[tree.rep[node]][:tree.level[node]]
            inside = [k for k, s in enumerate(steps) if tuple(s[:len(top)]) == tuple(top)]
            assert tree.members[node] == sum(weights[k][0] for k in inside)
            assert tree.first[node] == min(weights[k][1] for k in inside)
        tops = {tuple(tree.path[tree.rep[n]][:tree.level[n]]) for n in range(len(tree.level))}
        assert len(tops) == len(tree.level) and {tuple(s) for s in steps} <= tops
        assert {s[:3] for s in (*steps[0], *steps[-1])} == tree.open


def hash_of(prefix):
    return zlib.crc32("".join(prefix).encode())
