"""The prefix trie of conversations, from sorted neighbours.

Every conversation is a sequence of turns; each distinct sequence of first turns is a node. A
prefix has a code of 128 bits, the running XOR of the hashes of (depth, role, text), so that it
can be computed in blocks of BLOCK turns whatever the length of a conversation.

A prefix matters for the shape of the trie only where its members part: where one ends, or two go
on differently. A conversation's path has these steps only; they are fewer than the square root of
twice the number of rows. Conversations with the same path are one item, counted before they are
brought together. Items are sorted by their paths over range partitions. In each partition the
edges between neighbours, as deep as the prefix they share (LCP), are taken in descending depth:
union-find merges the components on either side, and each merge is a branching node with its
members, leaves and savings. What the partition's borders cut stays open: the steps of its first
and last item. These few nodes are merged over all partitions by their codes. Other depths of the
trie, which branch nowhere, are written out along the conversation with the smallest id.

The ids of conversations that end in one node are joined in blocks and streamed in order through
SHA-256, which is one sequence by nature: one task reads a node's blocks, and holds one of them.

64-bit hashes, two of them, stand for turns and prefixes.

Defined cases: turns are ordered by turn, nulls first; turns with the same number by role and
text. Null and empty role and text are the same. Rows with a null conv_id belong to no conversation
and are left out. Repeated rows are turns of their own. c%100 has the sign of c. An empty table has
no nodes, not even a root. Other columns are kept out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtrail.llm.common import query, settled, stored, table

BLOCK = 4096
ID_BLOCK = 1 << 16  # bytes of ids in a block
GROUP, HEADS = 100, 6
CODE = ["d", "p1", "p2"]


# --- turns -----------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, mid, one, two, size: the turns in order. mid numbers the rows of a range
    partition (part); a long conversation lies in several."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twice = stored(rows.groupBy("conv_id", "turn").agg(F.count("*").alias("held")).where("held > 1").drop("held"), "tied-turns").alias("t")
    tied = F.col("t.conv_id").isNotNull()  # only such rows need their texts to be ordered
    rows = rows.alias("r").join(twice, (F.col("r.conv_id") == F.col("t.conv_id")) & F.col("r.turn").eqNullSafe(F.col("t.turn")), "left").select(
        "r.conv_id", "r.turn", F.when(tied, F.col("role")).alias("role"), F.when(tied, F.col("text")).alias("text"),
        F.xxhash64("role", "text").alias("one"), F.xxhash64(F.lit(1), "text", "role").alias("two"), F.length("text").cast("long").alias("size"))
    order = ["conv_id", "turn", "role", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("mid"), "one", "two", "size")
    return stored(placed.select("conv_id", F.shiftright("mid", 33).alias("part"), "mid", "one", "two", "size"), "turns")


def rebuilt(placed: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their group's first one. Rows: c, d (from 1), one, two,
    size; conversations: c, length."""
    spans = placed.groupBy("conv_id", "part").agg(F.min("mid").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = stored(spans.withColumn("carry", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")), "spans")

    c = F.col("conv_id")
    h = (F.crc32(c.cast("string")) % heads).alias("h")
    own = spans.groupBy("conv_id").agg(F.sum("n").alias("own")).select("conv_id", "own", h, (c - c % group).alias("base"))
    base = own.select(c.alias("base"), F.col("own").alias("there"))
    own = own.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    own = stored(own.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")), "conversations")

    at = spans.join(own, "conv_id").select("conv_id", "part", "carry", "h", "m")
    rows = placed.join(at, ["conv_id", "part"]).withColumn("pos", F.col("mid") + F.col("carry"))
    later = rows.where("pos >= h").select(c.alias("c"), (F.col("pos") - F.col("h") + F.col("m") + 1).alias("d"), "one", "two", "size")
    first = rows.where((c % group == 0) & (F.col("pos") < heads - 1)).select(c.alias("base"), "pos", "one", "two", "size")
    first = first.join(own.select("conv_id", "base", "h"), "base").where("pos < h").select(c.alias("c"), (F.col("pos") + 1).alias("d"), "one", "two", "size")
    return later.unionByName(first), own.select(c.alias("c"), "length")


def prefixed(rows: DataFrame) -> DataFrame:
    """c, d, p1, p2, q1, q2, z, size: codes of the prefix with and without the turn, and the code
    points up to it."""
    marked = rows.select(
        "c", "d", F.floor((F.col("d") - 1) / BLOCK).alias("block"), "size",
        F.xxhash64("d", "one", "two").alias("f1"), F.xxhash64(F.lit(1), "two", "one", "d").alias("f2"))
    upto = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    within = marked.select("*", F.bit_xor("f1").over(upto).alias("x1"), F.bit_xor("f2").over(upto).alias("x2"), F.sum("size").over(upto).alias("s"))
    within = stored(within, "prefix-blocks")
    # Only conversations beyond one block have something to carry.
    ends = within.where(F.col("d") % BLOCK == 0).select("c", "block", "x1", "x2", "s")
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.select("c", (F.col("block") + 1).alias("block"), F.bit_xor("x1").over(before).alias("c1"), F.bit_xor("x2").over(before).alias("c2"), F.sum("s").over(before).alias("cs"))
    whole = within.join(stored(carried, "prefix-carry"), ["c", "block"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    whole = whole.select("c", "d", "f1", "f2", "size", F.col("x1").bitwiseXOR(zero("c1")).alias("p1"), F.col("x2").bitwiseXOR(zero("c2")).alias("p2"), (F.col("s") + zero("cs")).alias("z"))
    return whole.select("c", "d", "p1", "p2", F.col("p1").bitwiseXOR(F.col("f1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("f2")).alias("q2"), "z", "size")


def paths(rows: DataFrame) -> DataFrame:
    """c, path: the steps (d, p1, p2, z) of conversations that share any, in order."""
    shared = rows.groupBy(*CODE).agg(F.count("*").alias("n"), F.min("q1").alias("q1"), F.min("q2").alias("q2")).where("n > 1")
    shared = stored(shared, "shared-prefixes")
    on = shared.select((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n")
    steps = stored(shared.join(on, [*CODE, "n"], "left_anti").select(*CODE), "steps")  # no child has all members
    held = rows.join(steps, CODE).select("c", F.struct(*CODE, "z").alias("step"))
    return held.groupBy("c").agg(F.array_sort(F.collect_list("step")).alias("path"))


# --- the forest of a partition ---------------------------------------------------------


class Forest:
    """Components of sorted items; the top of each is a node. Steps of the borders are open."""

    def __init__(self, paths: list[list[tuple]], weights: list[tuple[int, int, int]]):
        """paths: distinct and sorted, of steps (d, p1, p2, z); weights: members, smallest member,
        members that go on alone."""
        self.open = {steps[k][:3] for steps in (paths[0], paths[-1]) for k in range(len(steps))} if paths else set()
        # Open steps are nodes even where nothing branches in this partition.
        extra = {steps[:k + 1] for steps in ([tuple(paths[0]), tuple(paths[-1])] if paths else []) for k in range(len(steps))} - {tuple(p) for p in paths}
        items = sorted([(tuple(p), w) for p, w in zip(paths, weights)] + [(p, (0, None, 0)) for p in extra], key=lambda x: [s[:3] for s in x[0]])
        self.path = [p for p, _ in items]
        self.level = [len(p) for p, _ in items]
        self.members = [w[0] for _, w in items]
        self.first = [w[1] for _, w in items]
        self.kids = [w[2] for _, w in items]
        self.leaves = [w[2] for _, w in items]
        self.below = [0] * len(items)
        self.parent: list[int | None] = [None] * len(items)
        self.rep = list(range(len(items)))  # an item whose path runs through the node
        self._merge()

    def step(self, node: int) -> tuple:
        return self.path[self.rep[node]][self.level[node] - 1]

    def is_open(self, node: int) -> bool:
        return self.step(node)[:3] in self.open

    def _common(self) -> np.ndarray:
        """Steps that each item shares with the next."""
        shared = np.zeros(max(0, len(self.path) - 1), np.int64)
        for k, (a, b) in enumerate(zip(self.path, self.path[1:])):
            n = 0
            for x, y in zip(a, b):
                if x[:3] != y[:3]:
                    break
                n += 1
            shared[k] = n
        return shared

    def _merge(self) -> None:
        shared = self._common()
        leader, top = list(range(len(self.path))), list(range(len(self.path)))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        weight = [1] * len(self.path)
        # Of edges of one depth the left one first: the component to the right is deeper then.
        for k in np.argsort(-shared, kind="stable").tolist():
            depth = int(shared[k])
            if not depth:
                break  # what is left meets in the root
            x, y = find(k), find(k + 1)
            node = top[x]
            if self.level[node] > depth:
                node = self._branch(depth, top[x])
            self._hang(top[y], node)
            if weight[x] < weight[y]:
                x, y = y, x
            leader[y] = x
            weight[x] += weight[y]
            top[x] = node
        for node in range(len(self.level)):
            if self.parent[node] is None:
                self._close(node)

    def _branch(self, depth: int, below: int) -> int:
        for values, value in ((self.level, depth), (self.members, 0), (self.first, None), (self.kids, 0), (self.leaves, 0), (self.below, 0), (self.parent, None), (self.rep, self.rep[below])):
            values.append(value)
        node = len(self.level) - 1
        self._hang(below, node)
        return node

    def _close(self, node: int) -> None:
        if not self.kids[node] and not self.is_open(node):
            self.leaves[node] = 1  # all members end here

    def _hang(self, kid: int, node: int) -> None:
        """kid is complete, unless it is open: then the rest of it is in other partitions, and only its
        members are handed up."""
        self._close(kid)
        self.parent[kid] = node
        self.members[node] += self.members[kid]
        self.first[node] = min((f for f in (self.first[node], self.first[kid]) if f is not None), default=None)
        if not self.is_open(kid):
            self.kids[node] += 1
            self.leaves[node] += self.leaves[kid]
            self.below[node] += self.below[kid] + (self.members[kid] - 1) * (self.step(kid)[3] - self.step(node)[3])


NODE = "d long, p1 long, p2 long, z long, pd long, pp1 long, pp2 long, pz long, n long, first long, kids long, leaves long, below long"
OPEN = "over array<struct<d:long,p1:long,p2:long>>"


def forests(items: DataFrame) -> DataFrame:
    """NODE, OPEN of every partition of sorted items: complete nodes, and open ones (over: the steps
    above them, null for complete nodes)."""
    sorted_items = items.repartitionByRange("path").sortWithinPartitions("path").select("path", "members", "first", "tails")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, weights = [], []
        for batch in batches:
            column = batch.column(0)
            ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy()))).tolist()
            steps = list(zip(*(f.to_pylist() for f in column.flatten().flatten())))
            paths += [steps[a:b] for a, b in zip(ends, ends[1:])]
            weights += zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
        tree = Forest(paths, weights)
        rows = []
        for node in range(len(tree.level)):
            path, level = tree.path[tree.rep[node]], tree.level[node]
            d, p1, p2, z = path[level - 1]
            pd, pp1, pp2, pz = path[level - 2] if level > 1 else (0, 0, 0, 0)
            over = [{"d": s[0], "p1": s[1], "p2": s[2]} for s in path[:level - 1]] if tree.is_open(node) else None
            rows.append((d, p1, p2, z, pd, pp1, pp2, pz, tree.members[node], tree.first[node], tree.kids[node], tree.leaves[node], tree.below[node], over))
        names = [c.split()[0] for c in NODE.split(", ")]
        kinds = [pa.int64()] * len(names) + [pa.list_(pa.struct([(c, pa.int64()) for c in CODE]))]
        for low in range(0, len(rows), 4096):
            columns = zip(*rows[low:low + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [*names, "over"])

    return sorted_items.mapInArrow(work, f"{NODE}, {OPEN}")


def branching(items: DataFrame) -> DataFrame:
    """NODE of all branching nodes: those that partitions left open are merged by their codes. Of
    each, pd, pp1, pp2, pz are its parent's (0: the root); below: savings beneath it."""
    found = stored(forests(items), "forests")
    done = found.where("over IS NULL").drop("over")
    parts = found.where("over IS NOT NULL").groupBy(*CODE, "z", "pd", "pp1", "pp2", "pz").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("below").alias("below"), F.max("over").alias("over"))
    parts = stored(parts, "open-nodes")
    more = parts.groupBy(F.col("pd").alias("d"), F.col("pp1").alias("p1"), F.col("pp2").alias("p2")).agg(F.count("*").alias("more"))
    parts = parts.join(more, CODE, "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0)))
    parts = stored(parts.withColumn("leaves", F.when(F.col("kids") == 0, F.lit(1)).otherwise(F.col("leaves"))), "open-nodes-counted")
    # Leaves and savings of an open node go to every open node above it.
    saved = F.col("below") + (F.col("n") - 1) * (F.col("z") - F.col("pz"))
    up = parts.select(F.explode("over").alias("o"), "leaves", saved.alias("saved")).groupBy("o").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    up = up.select("o.*", "l", "s")
    names = [c.split()[0] for c in NODE.split(", ")]
    parts = parts.join(up, CODE, "left").withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("below", F.col("below") + F.coalesce("s", F.lit(0)))
    return done.unionByName(parts.select(*names))


# --- ends ------------------------------------------------------------------------------


def end_digests(ends: DataFrame) -> DataFrame:
    """d, p1, p2, ends_sha256 of (d, p1, p2, c): SHA-256 of the ids in ascending order."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size = None, [], 0

        def block():
            return pa.RecordBatch.from_pylist([{**dict(zip(CODE, now)), "first": ids[0], "ids": ",".join(map(str, ids))}])

        for batch in batches:
            for *code, c in zip(*(column.to_pylist() for column in batch.columns)):
                if code != now or size > ID_BLOCK:
                    if ids:
                        yield block()
                    now, ids, size = code, [], 0
                ids.append(c)
                size += len(str(c)) + 1
        if ids:
            yield block()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for *code, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if code == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = code, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*CODE, "ends_sha256"], r)) for r in out])
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*CODE, "ends_sha256"], (*now, digest.hexdigest())))])

    order = [*CODE, "c"]
    blocks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "d long, p1 long, p2 long, first long, ids string")
    blocks = blocks.repartition(*CODE).sortWithinPartitions(*CODE, "first")
    return blocks.mapInArrow(digested, "d long, p1 long, p2 long, ends_sha256 string")


# --- the trie --------------------------------------------------------------------------


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    return settled(conversations.sparkSession, lambda: _trie(conversations, group, heads), "trie")


def _trie(conversations: DataFrame, group: int, heads: int) -> DataFrame:
    given, convs = rebuilt(turns(conversations), group, heads)
    rows = stored(prefixed(given), "prefixes")
    found = stored(paths(rows).select("c", "path", F.element_at("path", -1).alias("last")), "paths")
    # Every conversation with its last step; without steps it shares nothing: (0, 0, 0), the root.
    zero = F.lit(0).cast("long")
    placed = convs.join(found.select("c", "last"), "c", "left").select("c", "length", *[F.coalesce(f"last.{k}", zero).alias(k) for k in CODE])
    placed = stored(placed, "placed")

    alone = F.when(F.col("length") > F.col("last.d"), 1).otherwise(0)
    items = found.join(convs, "c").groupBy("path").agg(F.count("*").alias("members"), F.min("c").alias("first"), F.sum(alone).alias("tails"))
    tree = stored(branching(items), "branching")

    # The root: sums over conversations and over the nodes below it, put together as rows of one
    # shape; no row for an empty table.
    nothing = F.lit(None).cast("long")
    alone = F.when((F.col("d") == 0) & (F.col("length") > 0), 1)
    own = placed.agg(F.count("*").alias("n"), F.min("c").alias("first"), F.sum(alone).alias("kids"), F.sum(alone).alias("leaves"), F.max(nothing).alias("below"))
    saved = F.col("below") + (F.col("n") - 1) * (F.col("z") - F.col("pz"))
    under = tree.where("pd = 0").agg(zero.alias("n"), F.max(nothing).alias("first"), F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum(saved).alias("below"))
    root = own.unionByName(under).agg(F.sum("n").alias("n"), F.min("first").alias("first"), *[F.coalesce(F.sum(k), zero).alias(k) for k in ("kids", "leaves", "below")])
    root = root.where("n > 0").select(
        *[zero.alias(k) for k in ("d", "p1", "p2", "z", "pd", "pp1", "pp2", "pz")], "n", "first", "kids", F.greatest("leaves", F.lit(1).cast("long")).alias("leaves"), "below")
    root = stored(root, "root")

    nodes = stored(root.unionByName(tree), "nodes")
    ends = stored(end_digests(placed.where("length = d")), "ends")
    above = nodes.select(F.col("d").alias("pd"), F.col("p1").alias("pp1"), F.col("p2").alias("pp2"), F.col("first").alias("above"))
    full = tree.join(above, ["pd", "pp1", "pp2"]).join(ends, CODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())

    # Depths between a branching node and its parent, in blocks: along its first conversation.
    lows = F.explode(F.sequence(F.col("pd") + 1, F.col("d"), F.lit(BLOCK).cast("long")))
    runs = full.select("*", lows.alias("low")).select("*", F.explode(F.sequence("low", F.least(F.col("d"), F.col("low") + BLOCK - 1))).alias("depth"))
    places = rows.select(F.col("c").alias("first"), F.col("d").alias("depth"), F.col("z").alias("at"), "size")
    here = F.col("depth") == F.col("d")
    shared = runs.join(places, ["first", "depth"]).select(
        F.col("first").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("pd") + 1, F.col("above")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(here, F.col("kids")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("z") - F.col("at") + F.col("size"))).alias("saved_tokens"),
        F.coalesce(F.when(here, F.col("ends_sha256")), none).alias("ends_sha256"))

    # Beyond its last step a conversation is alone.
    last = placed.where("length > d").join(nodes.select(*CODE, F.col("first").alias("above")), CODE).select("c", "length", F.col("d").alias("from"), "above")
    tails = rows.select("c", "d").join(last, "c").where(F.col("d") > F.col("from"))
    ending = F.col("d") == F.col("length")
    tails = tails.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("from") + 1, F.col("above")).otherwise(F.col("c")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(ending, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(ending, F.sha2(F.col("c").cast("string"), 256)).otherwise(none).alias("ends_sha256"))

    top = root.join(ends, CODE, "left").select(
        F.col("first").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("below").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    return top.unionByName(shared).unionByName(tails)


# Unsigned CRC-32 of the decimal id: bits are shifted out eight for each character (-1 is a shift).
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""
CHECK = rf"""
WITH o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, base, h, least(h, coalesce((SELECT count(*) FROM o WHERE o.conv_id = base), 0)) AS m
  FROM (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM o))),
b AS MATERIALIZED (SELECT c.conv_id AS c, pos - h + m + 1 AS d, r, t FROM c JOIN o ON o.conv_id = c.conv_id WHERE pos >= h
  UNION ALL SELECT c.conv_id, pos + 1, r, t FROM c JOIN o ON o.conv_id = base WHERE pos < h),
p AS MATERIALIZED (SELECT c, d, t, sha256(string_agg(length(r) || ':' || r || length(t) || ':' || t, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM b
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
n AS MATERIALIZED (SELECT d, k, min(c) AS first, count(*) AS n, min(length(t)) AS size FROM p GROUP BY d, k),
l AS (SELECT c, max(d) AS l FROM p GROUP BY c),
e AS (SELECT p.d, p.k, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM p JOIN l ON l.c = p.c AND l.l = p.d GROUP BY p.d, p.k),
u AS MATERIALIZED (SELECT n.*, q.k AS pk, up.first AS above FROM n LEFT JOIN p q ON q.c = n.first AND q.d = n.d - 1 LEFT JOIN n up ON up.d = q.d AND up.k = q.k),
f AS (SELECT n.d, n.k, count(u.k) AS kids FROM n LEFT JOIN u ON u.d = n.d + 1 AND u.pk = n.k GROUP BY n.d, n.k),
s AS (SELECT q.d, q.k, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.size) AS saved
  FROM n JOIN f ON f.d = n.d AND f.k = n.k JOIN p q ON q.c = n.first AND q.d <= n.d GROUP BY q.d, q.k)
SELECT u.first AS conv_id, u.d AS depth, u.above AS parent_conv_id, u.n AS n_convs, f.kids AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM u JOIN f ON f.d = u.d AND f.k = u.k JOIN s ON s.d = u.d AND s.k = u.k LEFT JOIN e ON e.d = u.d AND e.k = u.k
"""


@query("op11_conversation_prefix_trie", CHECK)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return trie(table(spark, sf, "conversations"))
