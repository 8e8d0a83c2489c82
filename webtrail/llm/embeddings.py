"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own (k-means on a sample of
SAMPLE_VECTORS vectors); a pair of codes is a cell of the product grid, and every vector is
indexed in its nearest cell. A query visits cells in the order of their distance, a
multi-sequence over the two sorted lists of codes, until the farthest cell is passed in which
a partner at the threshold lies with probability TARGET_RECALL. That distance is learnt by
turning sampled vectors by the angle of the threshold in random directions, so it holds for
the hardest pairs; nearer ones are found more often. Found pairs are verified by cosine in
double precision.

Equal vectors are one class before anything is shuffled. Visits of a large cell are cut into
a grid of blocks of BLOCK rows, so that no task holds a whole cell; tasks put out counts and a
spanning forest of their links, never the pairs.

Defined cases: vectors that are null, zero, or hold a null or non-finite component, and rows
with a null label or null vec_id, link with nothing; a null vec_id has a null component and
kept. Vectors are compared only with vectors of their own length; a length that has not the
most rows is compared whole, without cells. Rows that repeat a vector link with one another.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm.common import components, query, stored, table

THRESHOLD = 0.98
SAMPLE_VECTORS = 8192
TARGET_RECALL = 0.995
CELL_ROWS = 64  # vectors a cell should hold if all were spread evenly
MOST_CODES = 1024
BLOCK = 64
SEED = 5


@dataclass(frozen=True)
class Index:
    size: int  # length of the vectors
    first: np.ndarray  # codes of the first half
    second: np.ndarray
    slack: float  # squared distance beyond the nearest cell that is still visited


def _squares(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (rows * rows).sum(1)[:, None] - 2 * rows @ codes.T + (codes * codes).sum(1))


def _codebook(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    codes = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _squares(rows, codes).argmin(1)
        sums = np.zeros_like(codes)
        np.add.at(sums, nearest, rows)
        count = np.bincount(nearest, minlength=k)
        codes[count > 0] = sums[count > 0] / count[count > 0, None]
    return codes


def _excess(halves: np.ndarray, codes: np.ndarray) -> np.ndarray:
    d = _squares(halves, codes)
    return d - d.min(1, keepdims=True)


def fit(sample: np.ndarray, rows: int, threshold: float, target: float = TARGET_RECALL) -> Index:
    """sample: unit vectors; rows: how many vectors the index will hold."""
    rng = np.random.default_rng(SEED)
    size = sample.shape[1]
    cut = size // 2
    k = max(1, min(MOST_CODES, math.ceil(math.sqrt(rows / CELL_ROWS)), len(sample) // 8))
    if not cut:
        k = 1
    first, second = _codebook(sample[:, :cut], k, rng), _codebook(sample[:, cut:], k, rng)
    turn = rng.normal(size=sample.shape)
    turn -= (turn * sample).sum(1, keepdims=True) * sample
    turn /= np.maximum(1e-300, np.linalg.norm(turn, axis=1, keepdims=True))
    partner = threshold * sample + math.sqrt(1 - threshold ** 2) * turn
    at = np.arange(len(sample))
    beyond = (_excess(sample[:, :cut], first)[at, _squares(partner[:, :cut], first).argmin(1)]
              + _excess(sample[:, cut:], second)[at, _squares(partner[:, cut:], second).argmin(1)])
    return Index(size, first, second, float(np.quantile(beyond, target)))


def visits(index: Index, unit: np.ndarray) -> list[np.ndarray]:
    """For each vector the cells it visits, nearest first; the first one is its own."""
    cut = index.size // 2
    a, b = _excess(unit[:, :cut], index.first), _excess(unit[:, cut:], index.second)
    k = len(index.second)
    out = []
    for x, y in zip(a, b):
        i, j = np.flatnonzero(x <= index.slack), np.flatnonzero(y <= index.slack)
        sums = x[i][:, None] + y[j][None, :]
        p, q = np.nonzero(sums <= index.slack)
        order = np.lexsort((i[p] * k + j[q], sums[p, q]))
        cells = (i[p] * k + j[q])[order]
        own = int(x.argmin()) * k + int(y.argmin())
        out.append(np.concatenate(([own], cells[cells != own])))
    return out


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """A spanning forest of links inside a task: indices of the links that join two trees."""
    top = list(range(n))
    keep = []
    for e, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        while top[b] != b:
            top[b] = top[top[b]]
            b = top[b]
        if a != b:
            top[max(a, b)] = min(a, b)
            keep.append(e)
    return keep


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their class (null: links with nothing), and the classes."""
    e = F.col("embedding")
    plain = F.transform(e, lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    finite = F.forall(plain, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(plain, lambda x: x != 0.0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), plain.alias("v"), (fine & F.coalesce(finite & nonzero, F.lit(False))).alias("fine"))
    key = F.when(F.col("fine"), F.struct(F.xxhash64("label", "v").alias("h"), F.xxhash64("v", F.lit(7), "label").alias("g")))
    rows = rows.select("vec_id", "label", "v", key.alias("class"))
    found = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    return rows, found


_PARTS = "bucket long, cell long, i int, j int, role int, rep long, n long, home long, visited array<long>, v array<double>"


def duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """vec_id, embedding, label -> vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows, found = classes(vectors)
    found = stored(found.withColumn("size", F.size("v")), "vectors")
    sizes = found.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    if sizes:
        size, total = sizes[0]["size"], sizes[0]["count"]
        share = min(1.0, SAMPLE_VECTORS / total)
        drawn = found.where((F.col("size") == size) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) <= int(share * (1 << 30)))).select("v").limit(2 * SAMPLE_VECTORS)
        sample = np.array([r["v"] for r in drawn.collect()], float).reshape(-1, size)
        if len(sample) < 8:
            sample = np.array([r["v"] for r in found.where(F.col("size") == size).select("v").limit(64).collect()], float).reshape(-1, size)
        index = fit(_unit(sample), total, threshold, target)
    else:
        index = Index(0, np.zeros((1, 0)), np.zeros((1, 0)), 0.0)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for low in range(0, len(whole), 1024):
                batch = whole.slice(low, 1024)
                size = batch.column(1).to_numpy(zero_copy_only=False)
                cells: list[np.ndarray] = [np.zeros(1, np.int64)] * len(batch)
                mine = np.flatnonzero(size == index.size)
                if len(mine):
                    v = _unit(batch.column(2).take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), index.size))
                    for at, seen in zip(mine.tolist(), visits(index, v)):
                        cells[at] = seen
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.int64()))], ["rep", "visited"])

    placed = found.select("rep", "size", "v").mapInArrow(assign, "rep long, visited array<long>")
    bucket = F.xxhash64("label", "size")
    placed = stored(found.select("rep", "n", "v", bucket.alias("bucket")).join(placed, "rep").select("*", F.element_at("visited", 1).alias("home")), "placed")
    # What each cell has to do decides how it is cut.
    work = placed.select("bucket", "home", F.explode("visited").alias("cell")).groupBy("bucket", "cell").agg(
        F.count_if(F.col("home") == F.col("cell")).alias("held"), F.count("*").alias("met"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    work = stored(work.where("held > 0 AND met > 1").select("bucket", "cell", blocks("held").alias("ni"), blocks("met").alias("nj")), "cells")
    visit = placed.select("bucket", "rep", "home", F.explode("visited").alias("cell"))
    mixed = lambda salt: F.xxhash64("rep", F.lit(salt))
    visit = visit.join(work, ["bucket", "cell"])
    i, j = F.pmod(mixed(1), F.col("ni")).cast("int"), F.pmod(mixed(2), F.col("nj")).cast("int")
    one = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    whole = (F.col("ni") == 1) & (F.col("nj") == 1)
    asked = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda x: one(x, F.col("jj"), 1))
    held = F.when(F.col("home") == F.col("cell"), F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda x: one(F.col("ii"), x, 2)))
    visit = visit.select("bucket", "cell", "rep", "home", "ni", "nj", i.alias("ii"), j.alias("jj"))
    task = F.when(whole, F.array(one(F.lit(0), F.lit(0), 3))).otherwise(F.concat(asked, F.coalesce(held, F.array().cast("array<struct<i:int,j:int,role:int>>"))))
    visit = visit.select("bucket", "cell", "rep", F.inline(task)).join(placed.select("rep", "n", "home", "visited", "v"), "rep")
    tasks = visit.select("bucket", "cell", "i", "j", "role", "rep", "n", "home", "visited", "v").repartition("bucket", "cell", "i", "j").sortWithinPartitions("bucket", "cell", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            done = _links(group, threshold)
            if done is not None:
                yield done

    out = stored(tasks.mapInArrow(compare, "a long, b long, links long"), "links")
    counts = out.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(out.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    final = found.select("class", "rep", "n").join(counts, "rep", "left").join(groups, "rep", "left").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = rows.select("vec_id", "class").join(final, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True) if len(v) else v  # so that no square overflows
    return v / np.linalg.norm(v, axis=1, keepdims=True) if len(v) else v


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with the same (bucket, cell, i, j); at most 2 * BLOCK rows, give or take."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(4)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if last is not None and (keys[:, 0] != last).any() and rest:
            yield pa.Table.from_batches(rest)
            rest = []
        bounds = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            if a and rest:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
        last = keys[:, -1]
    if rest:
        yield pa.Table.from_batches(rest)


def _links(group: pa.Table, threshold: float) -> pa.RecordBatch | None:
    if len(group) < 2:
        return None
    group = group.combine_chunks()
    column = lambda name: group[name].to_numpy()
    role, rep, n, home, cell = column("role"), column("rep"), column("n"), column("home"), int(column("cell")[0])
    holds = np.flatnonzero((role != 1) & (home == cell))
    asks = np.flatnonzero(role != 2)
    if not len(holds) or not len(asks):
        return None
    v = _unit(group["v"].combine_chunks().flatten().to_numpy().reshape(len(group), -1))
    near = v[asks] @ v[holds].T >= threshold
    x, y = np.nonzero(near)
    if not len(x):
        return None
    x, y = asks[x], holds[y]
    # A pair that meets from both sides counts where the smaller id asks.
    visited = group["visited"].combine_chunks().to_pylist()
    mutual = np.array([home[a] in visited[b] for a, b in zip(x.tolist(), y.tolist())], bool)
    keep = (rep[x] != rep[y]) & (~mutual | (rep[x] < rep[y]))
    x, y = x[keep], y[keep]
    if not len(x):
        return None
    sums = np.zeros(len(group), np.int64)
    np.add.at(sums, x, n[y])
    np.add.at(sums, y, n[x])
    some = np.flatnonzero(sums)
    tree = _roots(len(group), x, y)
    a = np.concatenate((rep[some], rep[x[tree]]))
    b = pa.array(np.concatenate((np.zeros(len(some), np.int64), rep[y[tree]])), mask=np.arange(len(a)) < len(some))
    links = np.concatenate((sums[some], np.zeros(len(tree), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(links)], ["a", "b", "links"])


@query("op6_embedding_near_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates(table(spark, sf, "embeddings"))
