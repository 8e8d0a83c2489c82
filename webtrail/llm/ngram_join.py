"""Exact Jaccard join of word n-gram sets over prefix trees.

Every text becomes a set of 64-bit n-gram codes in one global order: frequency classes of a
fixed-width count sketch over the whole corpus first, rarer before more frequent, then the
code. Equal sets are one node. Two sets that link share at least `common(n)` codes of their
prefixes, so nodes with fewer codes that anyone shares drop out without being compared. The
rest, their shared codes in order, are the paths of prefix trees. Codes that the same nodes
share are one step of a path, with their number as its weight.

Components first: per shared code the node that shares most is asked, each node against the two
such centres it meets most often; then codes whose nodes are not yet in one component are joined by
their trees. A node is posted under such a code only while the rest of its path is as much as two
linking nodes share at least. Then links: the nodes of each component, and only they can link, are
joined with one another by their trees, and each link is counted where its two nodes meet.

Each task holds the tree of a block of nodes and walks it for each other node: partial overlaps are
carried down shared paths, and a subtree is left as soon as the codes that remain in the tree or
in the probe cannot reach the overlap needed. What is left is held against the marks of both
sets: their codes counted in cells, whose smaller counts add up to no less than what the sets share.
A pair far below the threshold so becomes no row, however many of them a group of texts has. The rest
is verified over the whole sets.

Large components and codes that very many nodes share are cut into blocks, by their number and their
bytes, and each pair of blocks meets once. Nothing is capped; every link between different sets is
found. Only block-sized groups and fixed-width tables (the sketch, a bitmap of the nodes to be
verified) reach a task or the driver.

64-bit codes stand for n-grams and 128-bit digests for sets.

Links count documents: the rows of other sets that link, and the other rows of the same set.

Defined cases: null and empty texts and texts without words have no n-grams, size 0, and link
with nothing. With fewer words than an n-gram has, the whole sequence is the one n-gram. A null
doc_id gets a row with a null component and links with nothing. Rows with the same id are one
document: their links join. Other columns are kept out of the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtrail.llm.common import WHITE, chunks, components, mix, query, scratch, settled, shingles, stored, table, text_pass, words

WIDTH, PERCENT = 3, 90
SKETCH_BITS = 20
SLICES = 64
BITMAP_BITS = 24
PRINT_BITS = 32
BUCKET_CODES = 1 << 20  # codes of a bucket of fingerprints, about
CLASSES = 32
MARK_BITS = 7
SHARE = 5  # percent of a set's size that two linking prefixes share
BLOCK = 256
BLOCK_BYTES = 8 << 20


# --- sets ------------------------------------------------------------------------------


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct codes) of every row that has any."""
    for low, _, data, bounds in chunks(column):
        codes, edges = shingles(words(data, bounds, WHITE), width)
        for row in np.flatnonzero(np.diff(edges)).tolist():
            yield low + row, np.unique(codes[edges[row]:edges[row + 1]])


def _digest(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def ordered(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The codes in the global order, each with its class in front: one number that sorts."""
    head = classes[(codes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((head << np.uint64(58)) | (codes & np.uint64((1 << 58) - 1)))


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set it links with."""
    return -(-n * percent // 100)


def common(n, percent: int):
    return np.maximum(1, np.minimum(np.asarray(n) * SHARE // 100, -(-np.asarray(n) * percent // 100)))


def prefix_size(n: int, percent: int) -> int:
    return n - needed(n, percent) + int(common(n, percent))


def _sliced(values: np.ndarray) -> pa.RecordBatch:
    parts = np.split(values, SLICES)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["slice", "part"])


def _combined(parts: DataFrame, kind: str, how) -> np.ndarray:
    """Fixed-width arrays of all tasks, combined slice by slice; SLICES rows come to the driver."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(part), kind)
                held[at] = how(held[at], got) if at in held else got
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["slice", "part"])

    rows = parts.repartition(SLICES, "slice").mapInArrow(work, "slice int, part binary").collect()
    found = {r["slice"]: np.frombuffer(r["part"], kind) for r in rows}
    return np.concatenate([found[k] for k in range(SLICES)]) if found else np.zeros(0, kind)


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Classes of a sketch cell by its count against the mean, an eighth of an octave each."""
    if not len(counts):
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    relative = np.maximum(counts, 1e-9) / max(1e-9, counts.mean())
    return np.clip(np.round(8 * np.log2(relative)) + 4, 0, CLASSES - 1).astype(np.uint8)


def measured(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, digest of every document; and the count sketch of each task (slice, part)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n", "digest", "slice", "part"]
        for batch in batches:
            n, digest = np.zeros(len(batch), np.int64), [None] * len(batch)
            waiting, size = [], 0
            for row, codes in _sets(batch.column(1), width):
                n[row], digest[row] = len(codes), _digest(codes)
                waiting.append(codes)
                size += len(codes)
                if size > 1 << 20:
                    counts += np.bincount((np.concatenate(waiting) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                    waiting, size = [], 0
            if waiting:
                counts += np.bincount((np.concatenate(waiting) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            none = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digest, pa.binary()), none, pa.nulls(len(batch), pa.binary())], names)
        sketch = _sliced(counts.astype(np.int32) if counts.max() < 1 << 31 else np.minimum(counts, (1 << 31) - 1).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), sketch.column(0), sketch.column(1)], names)

    return text_pass(docs, work, "doc_id long, n long, digest binary, slice int, part binary")


def prefixes(docs: DataFrame, width: int, percent: int, classes, copies) -> DataFrame:
    """node, digest, n, prefix, copy of every document that has n-grams; copy: its id may be
    among those of `copies`."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = copies.value
        for batch in batches:
            rows, n, digest, cut = [], [], [], []
            for row, codes in _sets(batch.column(1), width):
                rows.append(row)
                n.append(len(codes))
                digest.append(_digest(codes))
                cut.append(ordered(codes, classes.value)[:prefix_size(len(codes), percent)].astype(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int32)
            flat = np.concatenate(cut) if cut else np.zeros(0, np.int64)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            maybe = ids.is_null().to_numpy(zero_copy_only=False) | _maybe(flags, ids.fill_null(0).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(maybe)],
                ["node", "digest", "n", "prefix", "copy"])

    return text_pass(docs, work, "node long, digest binary, n long, prefix array<long>, copy boolean")


# --- candidates ------------------------------------------------------------------------


def marks(codes: np.ndarray) -> bytes:
    """The codes counted in cells of a byte each; nothing if a count does not fit."""
    counts = np.bincount((codes >> np.uint64(64 - MARK_BITS)).astype(np.int64), minlength=1 << MARK_BITS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(r: dict, q: dict, percent: int) -> bool:
    """Whether the marks of two sets, which share no more than the smaller counts, leave a link open."""
    one, other = r.get("marks"), q.get("marks")
    if one is None or other is None or not len(one) or not len(other):
        return True
    return int(np.minimum(one, other).sum()) * (100 + percent) >= percent * (r["n"] + q["n"])


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose marks leave a link open."""
    of = lambda side, name: sets.select(F.col("node").alias(side), F.col("marks").alias(name))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.ones(len(batch), bool)
            rows = np.flatnonzero([len(m) > 0 and len(n) > 0 for m, n in zip(x, y)])
            if len(rows):
                m, n = (np.frombuffer(b"".join(z[k] for k in rows), np.uint8).reshape(len(rows), -1) for z in (x, y))
                size = m.sum(1, dtype=np.int64) + n.sum(1, dtype=np.int64)
                keep[rows] = np.minimum(m, n).sum(1, dtype=np.int64) * (100 + percent) >= percent * size
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def _shared(heads: DataFrame, bits: int) -> DataFrame:
    """print: fingerprints, the last bits of a code, that stand in two prefixes at least. They are
    among those of all shared codes, and hardly any other: the buckets are as many as the codes need.
    A task sends the fingerprints of a bucket sorted in one row, each of them twice at most."""
    low = np.uint64((1 << bits) - 1)

    def sent(waiting: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.sort(np.concatenate(waiting).view(np.uint64) & low)
        prints = prints[np.concatenate((np.ones(min(2, len(prints)), bool), prints[2:] != prints[:-2]))]
        bucket = (prints >> np.uint64(PRINT_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        parts = np.split((prints & np.uint64((1 << PRINT_BITS) - 1)).astype(np.uint32), first[1:])
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([x.tobytes() for x in parts], pa.binary())], ["bucket", "prints"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            codes, _ = _flat(batch.column(0))
            if len(codes):
                waiting.append(codes)
                size += len(codes)
            if size >= 2 * BUCKET_CODES:
                yield sent(waiting)
                waiting, size = [], 0
        if waiting:
            yield sent(waiting)

    def twice(bucket: int, parts: list[bytes]) -> pa.RecordBatch:
        prints = np.sort(np.frombuffer(b"".join(parts), np.uint32))
        again = np.unique(prints[1:][prints[1:] == prints[:-1]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(again + (bucket << PRINT_BITS))], ["print"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            for bucket, prints in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != key:
                    if parts:
                        yield twice(key, parts)
                    key, parts = bucket, []
                parts.append(prints)
        if parts:
            yield twice(key, parts)

    rows = heads.select("prefix").mapInArrow(spread, "bucket long, prints binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gathered, "print long")


def _of(heads: DataFrame, wanted, bits: int) -> DataFrame:
    """node, code of the prefixes: the codes whose fingerprint may be among the wanted ones."""
    low = np.int64((1 << bits) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        for batch in batches:
            codes, row = _flat(batch.column(1))
            keep = _maybe(flags, codes & low)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), pa.array(codes[keep])], ["node", "code"])

    return heads.select("node", "prefix").mapInArrow(work, "node long, code long")


def _least(percent: int):
    """How many live codes a node of n codes has at least, if it links with any."""
    return F.greatest(F.lit(1), F.floor(-F.floor(-F.col("n") * percent / 100) * SHARE / 100))


def _live(heads: DataFrame, percent: int) -> DataFrame:
    """node, code, weight: codes that two nodes share, of nodes that may share enough of them. Of
    codes with the same nodes the first one stands for all; weight is their number. Fingerprints tell
    nearly all codes that no other node has, and an exact count of what is left the rest."""
    total = heads.agg(F.sum("n")).first()[0] or 0
    bits = PRINT_BITS + min(20, max(8, int(total * (100 - percent + SHARE) // 100 // BUCKET_CODES).bit_length()))
    shared = stored(_shared(heads, bits), "shared")
    codes = _of(heads, bitmap(shared), bits).join(shared, F.col("code").bitwiseAND(F.lit((1 << bits) - 1)) == F.col("print"), "left_semi")
    codes = stored(codes, "maybe-live")
    enough = codes.groupBy("node").agg(F.count("*").alias("lives")).join(heads.select("node", "n"), "node").where(F.col("lives") >= _least(percent)).select("node")
    codes = stored(codes.join(enough, "node").select("node", "code"), "enough")
    members = codes.groupBy("code").agg(
        F.count("*").alias("held"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")).where("held > 1")
    steps = stored(members.groupBy("held", "low", "high", "h", "g").agg(F.min("code").alias("code"), F.count("*").alias("weight")).select("code", "weight"), "steps")
    return codes.join(steps, "code").select("node", "code", "weight")


def _centres(live: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the two centres that it meets most often."""
    lives = live.groupBy("node").agg(F.sum("weight").alias("lives")).join(heads.select("node", "n"), "node")
    weighed = stored(live.join(lives, "node"), "weighed")
    centre = stored(weighed.groupBy("code").agg(F.max(F.struct("lives", (-F.col("node")).alias("back"), "n")).alias("top")).select(
        "code", (-F.col("top.back")).alias("b"), F.col("top.n").alias("m")), "centres")
    met = weighed.join(centre, "code").where(F.col("node") != F.col("b"))
    met = met.where((F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent))
    times = met.groupBy(F.col("node").alias("a"), "b").agg(F.sum("weight").alias("times"), F.first("n").alias("n"))
    times = times.where(F.col("times") * 100 >= F.col("n") * SHARE)  # the likely ones; the others are met across
    # A node meets no more centres than its prefix has codes.
    best = times.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", (-F.col("b")).alias("back"))), asc=False), 1, 2).alias("best"))
    return best.select("a", F.explode("best").alias("x")).select("a", (-F.col("x.back")).alias("b"))


class Tree:
    """A prefix tree of weighted paths; each node knows what its records may still share."""

    __slots__ = ("kids", "records", "least", "most_later", "most_beyond")

    def __init__(self):
        self.kids: dict[int, Tree] = {}
        self.records: list[int] = []
        self.least = 1 << 62  # smallest set below
        self.most_later = 0  # most weight that a record below has after this node
        self.most_beyond = 0  # most codes that a record below has beyond its prefix

    def add(self, record: int, path: list[int], weights: list[int], n: int, beyond: int) -> None:
        node, later = self, sum(weights)
        for code, weight in [(None, 0), *zip(path, weights)]:
            node = self if code is None else node.kids.setdefault(code, Tree())
            later -= weight
            node.least = min(node.least, n)
            node.most_later = max(node.most_later, later)
            node.most_beyond = max(node.most_beyond, beyond)
        node.records.append(record)

    def walk(self, start: int | None, path: list[int], weights: list[int], n: int, beyond: int, percent: int) -> Iterator[tuple[int, int]]:
        """(record, overlap of the paths) of the records that a probe may still link with and
        whose first common step with it is `start`, if that is given."""
        index = {c: k for k, c in enumerate(path)}
        later = [0] * (len(path) + 1)  # weight of the probe's steps from each place on
        for k in range(len(path) - 1, -1, -1):
            later[k] = later[k + 1] + weights[k]
        stack = [(self, 0, 0)]
        while stack:
            node, overlap, passed = stack.pop()
            if overlap:
                for record in node.records:
                    yield record, overlap
            for code, kid in node.kids.items():
                at = index.get(code)
                if at is not None:
                    if start is not None and code < start:
                        continue  # these pairs meet at that earlier step
                    over, gone = overlap + weights[at], at + 1
                else:
                    if start is not None and code > start and not overlap:
                        continue
                    over, gone = overlap, passed
                    while gone < len(path) and path[gone] < code:
                        gone += 1
                most = over + min(kid.most_later, later[gone]) + max(kid.most_beyond, beyond)
                if most * (100 + percent) >= percent * (kid.least + n):
                    stack.append((kid, over, gone))


def planted(held: list[dict]) -> Tree:
    tree = Tree()
    for k, r in enumerate(held):
        tree.add(k, r["path"], r["weights"], r["n"], r["n"] - r["size"])
    return tree


def met(tree: Tree, held: list[dict], q: dict, code: int | None, percent: int) -> Iterator[int]:
    """Places of the held records that the paths do not rule out as links of a probe."""
    for k, overlap in tree.walk(code, q["path"], q["weights"], q["n"], q["n"] - q["size"], percent):
        r = held[k]
        # Common codes up to the smaller last one are all in both paths.
        first = r if r["last"] <= q["last"] else q
        if (overlap + first["n"] - first["size"]) * (100 + percent) >= percent * (r["n"] + q["n"]):
            yield k


def tree_pairs(code: int, held: list[dict], asked: list[dict], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of `asked` and `held` records of different components whose first common step is
    `code` and whose paths and marks do not rule a link out."""
    tree = planted(held)
    for q in asked:
        for k in met(tree, held, q, code, percent):
            if held[k]["component"] != q["component"] and may_link(held[k], q, percent):
                yield q["node"], held[k]["node"]


def _paths(live: DataFrame, heads: DataFrame) -> DataFrame:
    """node, n, size, last, path, weights: a node's own prefix."""
    paths = live.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("code", "weight"))).alias("p"))
    return paths.join(heads, "node").select("node", "n", "size", "last", F.col("p.code").alias("path"), F.col("p.weight").alias("weights"))


def _posts(live: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """node, code: the codes of a node from which on its path weighs as much as it has in common with
    any node it links with. The first common code of two linking nodes is one of both."""
    rest = F.sum("weight").over(Window.partitionBy("node").orderBy("code").rowsBetween(0, Window.unboundedFollowing))
    return live.withColumn("rest", rest).join(heads.select("node", "n"), "node").where(F.col("rest") >= _least(percent)).select("node", "code")


def _across(live: DataFrame, heads: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidate pairs of nodes in different components."""
    posts = _posts(live, heads, percent)
    placed = stored(posts.join(groups, "node", "left").select("node", "code", F.coalesce("component", "node").alias("component")), "posts")
    counted = placed.groupBy("code", "component").agg(F.count("*").alias("c"))
    mixed = counted.groupBy("code").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(BLOCK)).cast("int"))
    mixed = stored(mixed.select("code", F.col("top.component").alias("large"), blocks(F.col("top.c")).alias("ni"), blocks(F.col("all") - F.col("top.c")).alias("nj")), "mixed")

    asked = placed.join(mixed, "code", "left_semi").select("node").distinct()
    paths = _paths(live.join(asked, "node", "left_semi"), heads).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    paths = stored(paths.join(sets.select("node", "marks"), "node"), "paths")
    rows = placed.select("node", "code", "component").join(mixed, "code")
    big = F.col("component") == F.col("large")
    i, j = F.pmod(F.xxhash64("node", F.lit(1)), F.col("ni")).cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("nj")).cast("int")
    cell = lambda kind, i, j, role: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    rows = rows.select("node", "code", big.alias("big"), "ni", "nj", i.alias("ii"), j.alias("jj"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # The large component's blocks meet each block of the others (kind 0); these meet one another (kind 1).
    large = F.transform(upto("nj"), lambda x: cell(0, F.col("ii"), x, 0))
    other = F.concat(
        F.transform(upto("ni"), lambda x: cell(0, x, F.col("jj"), 1)),
        F.transform(F.filter(upto("nj"), lambda x: x >= F.col("jj")), lambda x: cell(1, F.col("jj"), x, 0)),
        F.transform(F.filter(upto("nj"), lambda x: x <= F.col("jj")), lambda x: cell(1, x, F.col("jj"), 1)))
    rows = rows.select("node", "code", F.inline(F.when(F.col("big"), large).otherwise(other)))
    rows = rows.join(paths, "node").repartition("code", "kind", "i", "j").sortWithinPartitions("code", "kind", "i", "j", "role")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def close():
            if len(group) < 2:
                return None
            held, asked = [r for r in group if r["role"] == 0], [r for r in group if r["role"] == 1]
            pairs = set()
            for a, b in tree_pairs(key[0], held, asked, percent):
                pairs.add((max(a, b), min(a, b)))
            if not pairs:
                return None
            a, b = zip(*pairs)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                mine = (r["code"], r["kind"], r["i"], r["j"])
                if mine != key:
                    done = close()
                    if done is not None:
                        yield done
                    key, group = mine, []
                r["marks"] = np.frombuffer(r["marks"], np.uint8)
                group.append(r)
        done = close()
        if done is not None:
            yield done

    return rows.mapInArrow(work, "a long, b long").distinct()


# --- verification ----------------------------------------------------------------------


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x1234567))
    mask = np.uint64((1 << BITMAP_BITS) - 1)
    return (x & mask).astype(np.int64), ((x >> np.uint64(32)) & mask).astype(np.int64)


def bitmap(ids: DataFrame):
    """A bitmap of fixed width (2 MB) that holds the values of a column of longs, broadcast: it
    says "no" for certain or "maybe". It spares most rows a shuffle while the values are not too
    many for it; what it lets through is always joined exactly."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITMAP_BITS, bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy()):
                flags[at] = True
        yield _sliced(np.packbits(flags))

    return ids.sparkSession.sparkContext.broadcast(_combined(ids.mapInArrow(mark, "slice int, part binary"), "uint8", np.bitwise_or))


def _maybe(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(flags):
        return np.zeros(len(ids), bool)
    out = np.ones(len(ids), bool)
    for at in _bits(ids):
        out &= (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return out


def whole_sets(docs: DataFrame, nodes: DataFrame, width: int, copies) -> DataFrame:
    """node, codes, marks of the wanted nodes, and of a few others that the bitmap lets through. It
    lets the pass over the texts skip nearly all others, so that no text is shuffled; nor are sets,
    but for those whose id may be among `copies`: only they can stand in several rows."""
    wanted = nodes.select("node", "digest")
    shared = bitmap(wanted.select("node"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, doubted = shared.value, copies.value
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            rows = np.flatnonzero(_maybe(flags, ids))
            if not len(rows):
                continue
            keep = batch.take(pa.array(rows))
            copy = keep.column(0).is_null().to_numpy(zero_copy_only=False) | _maybe(doubted, ids[rows])
            at, digest, blob, mark = [], [], [], []
            for row, codes in _sets(keep.column(1), width):
                at.append(row)
                digest.append(_digest(codes))
                blob.append(codes.tobytes())
                mark.append(marks(codes))
            yield pa.RecordBatch.from_arrays(
                [keep.column(0).take(pa.array(at, pa.int64())), pa.array(digest, pa.binary()), pa.array(blob, pa.binary()), pa.array(mark, pa.binary()), pa.array(copy[at])],
                ["node", "digest", "codes", "marks", "copy"])

    found = stored(text_pass(docs, work, "node long, digest binary, codes binary, marks binary, copy boolean"), "whole")
    told = found.where("copy").join(wanted, ["node", "digest"]).dropDuplicates(["node", "digest"])
    return found.where("NOT copy").select("node", "codes", "marks").unionByName(stored(told.select("node", "codes", "marks"), "whole-told"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. The set of b travels once to each of its groups of at most
    about BLOCK partners, that of a once for the pair. Pairs are stored first: they are asked twice, and
    are the product of the trees."""
    pairs, sets = stored(pairs, "pairs"), sets.select("node", "codes")
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    salted = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    member = salted.join(sets.withColumnRenamed("node", "a"), "a").select("b", "salt", F.lit(1).alias("role"), "a", "codes")
    head = groups.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.withColumnRenamed("node", "b"), "b")
    rows = head.select("b", "salt", F.lit(0).alias("role"), F.col("b").alias("a"), "codes").unionByName(member)
    rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "role")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            a, b = [], []
            for mine, salt, role, other, blob in zip(*(batch.column(k).to_pylist() for k in range(5))):
                codes = np.frombuffer(blob, np.uint64)
                if (mine, salt) != key:
                    key, heads = (mine, salt), []
                if role == 0:
                    heads.append(codes)
                    continue
                for head in heads:
                    if 100 * min(len(head), len(codes)) < percent * max(len(head), len(codes)):
                        continue
                    at = np.searchsorted(head, codes)
                    at[at == len(head)] = 0
                    both = int((head[at] == codes).sum())
                    if 100 * both >= percent * (len(head) + len(codes) - both):
                        a.append(other)
                        b.append(mine)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(work, "a long, b long")


def _both(a: np.ndarray, b: np.ndarray) -> int:
    """How many codes two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked(live: DataFrame, heads: DataFrame, sets: DataFrame, groups: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """node, others: how many documents (of `held`) the nodes have that link with a node. Nodes of a
    component are dealt to blocks; a pair of blocks meets in one task, with the paths and whole sets of
    both. Links are counted there and become no rows: a component has as many as pairs of its nodes."""
    members = groups.join(heads.select("node", "n"), "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("s"), F.sum("n").alias("codes"), F.min("node").alias("low"), F.max("node").alias("high"))
    count = F.ceil(F.greatest(F.col("s") / BLOCK, F.col("codes") * 8 / BLOCK_BYTES)).cast("int")
    sizes = stored(sizes.select("component", "s", "low", "high", F.greatest(F.lit(1), count).alias("blocks")), "component-sizes")
    # Two nodes are a component by their one link.
    two = sizes.where("s = 2").select(F.explode(F.array(F.struct(F.col("low").alias("node"), F.col("high").alias("b")), F.struct(F.col("high").alias("node"), F.col("low").alias("b")))).alias("x"))
    two = two.select("x.node", "x.b").join(held.withColumnRenamed("node", "b"), "b").select("node", F.col("held").alias("others"))
    members = members.join(sizes.where("s > 2").select("component", "blocks"), "component").select("component", "node", "blocks", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("k"))
    members = stored(members, "members")
    paths = _paths(live.join(members.select("node"), "node", "left_semi"), heads)
    rows = members.join(paths, "node").join(sets.select("node", "codes"), "node").join(held, "node")
    # A node is held in the cells of its block with later ones and asked in those with earlier ones.
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    k = F.col("k")
    cells = F.concat(
        F.transform(F.sequence(k, F.col("blocks") - 1), lambda x: cell(k, x, 0)),
        F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda x: cell(x, k, 1))).otherwise(F.expr("CAST(array() AS array<struct<i:int,j:int,role:int>>)")))
    rows = rows.select("component", F.inline(cells), "node", "n", "size", "last", "path", "weights", "codes", "held")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "role")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, tree = None, [], None
        links: set[tuple[int, int]] = set()
        others: dict[int, int] = {}

        def ask(q: dict, upto: int) -> None:
            for k in met(tree, mine, q, None, percent):
                r = mine[k]
                if k >= upto or r["node"] == q["node"]:
                    continue
                pair = (max(r["node"], q["node"]), min(r["node"], q["node"]))
                if pair in links:  # an id that stands for several sets meets several times
                    continue
                both = _both(r["set"], q["set"])
                if 100 * both >= percent * (len(r["set"]) + len(q["set"]) - both):
                    links.add(pair)
                    others[r["node"]] = others.get(r["node"], 0) + q["held"]
                    others[q["node"]] = others.get(q["node"], 0) + r["held"]

        def inner() -> None:
            """Pairs within a block, where it meets itself."""
            if key and key[1] == key[2]:
                for k, q in enumerate(mine):
                    ask(q, k)

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(others), pa.int64()), pa.array(list(others.values()), pa.int64())], ["node", "others"])
            others.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                cell = (r["component"], r["i"], r["j"])
                if cell != key:
                    if tree is None and mine:
                        tree = planted(mine)
                        inner()
                    key, mine, tree = cell, [], None
                    links.clear()
                    if len(others) > 1 << 14:
                        yield counted()
                r["set"] = np.frombuffer(r.pop("codes"), np.uint64)
                if r["role"] == 0:
                    mine.append(r)
                    continue
                if tree is None:
                    tree = planted(mine)
                ask(r, len(mine))
        if tree is None and mine:
            tree = planted(mine)
            inner()
        yield counted()

    return two.unionByName(rows.mapInArrow(work, "node long, others long")).groupBy("node").agg(F.sum("others").alias("others"))


# --- the join --------------------------------------------------------------------------


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, links: bool = True) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, n_links; one row per row of docs. Without
    links only components are asked for."""
    return settled(docs.sparkSession, lambda: _join(docs, width, percent, links), "joined")


def _join(docs: DataFrame, width: int, percent: int, count_links: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stored(measured(docs, width), "sets")
    rows = seen.where("slice IS NULL").select("doc_id", "n", "digest")
    classes = spark.sparkContext.broadcast(frequency_classes(_combined(seen.where("slice IS NOT NULL").select("slice", "part"), "int32", lambda a, b: (a.astype(np.int64) + b).clip(max=(1 << 31) - 1).astype(np.int32))))
    nodes = stored(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")

    # Documents that are no first copy, or that repeat an id, are told apart exactly; the bitmap
    # of their ids spares the others the shuffle. An id repeated with another text is one node
    # with several sets.
    named = rows.where("n > 0 AND doc_id IS NOT NULL")
    others = named.join(nodes, "digest").where("doc_id <> node").select("doc_id").unionByName(named.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    # The prefixes are needed for the paths only; what is made of them on the way goes here.
    copies = bitmap(others)
    with scratch(spark) as hand_out:
        every = stored(prefixes(docs, width, percent, classes, copies), "prefixes")
        told = every.where("copy AND node IS NOT NULL").join(nodes, ["digest", "node"]).dropDuplicates(["digest", "node"])
        heads = every.where("NOT copy").unionByName(stored(told.select(every.columns), "told"))
        live = hand_out(_live(heads, percent), "live")
        alive = live.groupBy("node").agg(F.sum("weight").alias("lives"))
        # Narrow before the join: a prefix is a quarter of a text's codes.
        narrow = heads.select("node", "digest", "n", F.size("prefix").alias("size"), F.element_at("prefix", -1).alias("last"))
        kept = hand_out(narrow.join(alive, "node").where(F.col("lives") >= _least(percent)).drop("lives"), "kept")
    sets = whole_sets(docs, kept, width, copies)

    first = settled(spark, lambda: verified(_possible(_centres(live, kept, percent), sets, percent), sets, percent), "links-centres")
    groups = components(first)
    second = settled(spark, lambda: verified(_across(live, kept.drop("digest"), sets, groups, percent), sets, percent), "links-across")
    groups = components(first.unionByName(second))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    joined = rows.join(nodes, "digest", "left").join(groups, "node", "left")
    if not count_links:
        return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    held = stored(named.join(nodes, "digest").groupBy("node").agg(F.count("*").alias("held")), "held")
    others = settled(spark, lambda: _linked(live, kept.drop("digest"), sets, groups, held, percent), "linked")
    counts = stored(held.join(others, "node", "left").select("node", (F.coalesce("others", F.lit(0)) + F.col("held") - 1).alias("n_links")), "link-counts")

    return joined.join(counts, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the row with the smallest id (of rows that repeat the
    id, one). Rows with a null id stay."""
    groups = join(docs, width, percent, links=False)
    kept = stored(groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows")), "kept-ids")
    once, more = kept.where("_rows = 1"), kept.where("_rows > 1")
    # Ids that stand in one row which stays are the most: the bitmap spares their texts the shuffle.
    doubted = bitmap(groups.where("doc_id <> component_id").select("doc_id").unionByName(more.select(F.col("_id").alias("doc_id"))))

    @F.arrow_udf("boolean")
    def maybe(ids: pa.Array) -> pa.Array:
        return pa.array(_maybe(doubted.value, ids.to_numpy()))

    # Columns are named through their frames: docs may have an _id of its own.
    own = docs["doc_id"].cast("long")
    told = docs.where(own.isNotNull() & maybe(F.coalesce(own, F.lit(0))))
    same = lambda ids: told["doc_id"].cast("long") == ids["_id"]
    # Only rows of repeated ids are brought together.
    again = told.join(more, same(more), "left_semi").dropDuplicates(["doc_id"])
    stay = docs.where(own.isNotNull() & ~maybe(F.coalesce(own, F.lit(0))))
    return stay.unionByName(told.join(once, same(once), "left_semi")).unionByName(again).unionByName(docs.where("doc_id IS NULL"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHECK = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS gs FROM w),
s AS MATERIALIZED (SELECT doc_id, hash(u) AS h, u FROM (SELECT doc_id, unnest(gs) AS u FROM g)),
n AS MATERIALIZED (SELECT doc_id, len(gs)::BIGINT AS n FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.u = b.u AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM l WHERE l.a = n.doc_id)::BIGINT AS n_links FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""


@query("op1_ngram_jaccard_join", CHECK)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return join(table(spark, sf, "documents"))
