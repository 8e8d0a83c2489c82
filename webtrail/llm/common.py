"""What the operators share: tables in the shared folder, numpy passes over text columns,
connected components and the register of their queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.session import shared_dir


@dataclass(frozen=True)
class LlmQuery:
    run: Callable[[SparkSession, str], DataFrame]
    check_sql: str | None


QUERIES: dict[str, LlmQuery] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = LlmQuery(run, sql)
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/webtrail-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Folders written by the step that runs; None outside of settled().
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the cluster's shared folder and read back: lineage ends there,
    so a lost executor costs a reread and no repeated job."""
    path = work_path(df.sparkSession, name)
    if _written.get() is not None:
        _written.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of work_path()."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are deleted at its end, all but those handed out: it gives a function
    that stores rows so that they outlive it."""
    mine: list[str] = []
    outer = _written.get()
    token = _written.set(mine)

    def hand_out(rows: DataFrame, name: str) -> DataFrame:
        path = work_path(spark, name)
        if outer is not None:
            outer.append(path)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    try:
        yield hand_out
    finally:
        _written.reset(token)
        removed(spark, mine)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of make(), stored; what make() stored on the way is deleted once they are written."""
    with scratch(spark) as hand_out:
        return hand_out(make(), name)


BATCH_BYTES = 8 << 20


def text_pass(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow over texts. Rows may be long, so the session's Arrow batches are bounded by
    bytes: a task holds a few of them on either side."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


# --- text columns as bytes -------------------------------------------------------------

CHUNK_BYTES = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


WHITE = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, CHUNK_BYTES + 4096)
        one = np.full(n, _R)
        one[0] = 1
        _pow = np.cumprod(one)
        one[1:] = _RINV
        _inv = np.cumprod(one)
    return _pow, _inv


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, bounds


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, end row, bytes, bounds from 0."""
    if not len(column):
        return
    data, bounds = utf8(column)
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield low, high, data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low]
        low = high


@dataclass
class Words:
    start: np.ndarray  # byte offsets in the chunk
    end: np.ndarray
    row: np.ndarray  # row of each word, from 0 in the chunk
    first: np.ndarray  # per row: index of its first word; one more entry than rows
    code: np.ndarray  # 64-bit hash of each word


def words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray, lower: bool = True) -> Words:
    """Every word of every row of the chunk, with a 64-bit hash of its bytes."""
    low = LOWER[data] if lower else data
    inside = ~between[low]
    n = len(low)
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = bounds[(bounds > 0) & (bounds < n)]  # a word never runs over the end of its row
        starts[edge] |= inside[edge]
        ends[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[low] * power[:n], out=sums[1:])
    code = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first, code)


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words of each row and the bounds of the rows. A row with
    fewer words has one, of all its words; a row without words none."""
    code, first = found.code, found.first
    count = np.diff(first)
    n = len(code)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    rolled = np.full(max(0, n - width + 1), width, np.uint64)
    for k in range(width):
        rolled = mix(rolled * _R + code[k:n - width + 1 + k])
    have = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(have)))
    out = np.empty(int(bounds[-1]), np.uint64)
    long = count >= width
    at = np.repeat(first[:-1][long] - bounds[:-1][long], have[long]) + _ranges(bounds[:-1][long], have[long])
    out[_ranges(bounds[:-1][long], have[long])] = rolled[at]
    for row in np.flatnonzero(~long & (count > 0)):
        one = np.full(1, count[row], np.uint64)
        for k in range(first[row], first[row + 1]):
            one = mix(one * _R + code[k])
        out[bounds[row]] = one[0]
    return out, bounds


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.int64)
    total = int(count.sum())
    step = np.ones(total, np.int64)
    ends = np.cumsum(count)
    keep = count > 0
    start, ends, count = start[keep], ends[keep], count[keep]
    if not len(start):
        return np.zeros(0, np.int64)
    step[0] = start[0]
    step[ends[:-1]] = start[1:] - (start[:-1] + count[:-1] - 1)
    return np.cumsum(step)


ranges = _ranges


# --- components ------------------------------------------------------------------------

def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node that has a link to a smaller one or is in a group.

    Alternating large and small stars: each round hangs neighbours under the smallest node
    seen, until the links are stars. A node with very many links is aggregated before the
    shuffle, and the joins that follow can be split by the runtime. The tables of a round go with
    it."""
    spark = edges.sparkSession
    return settled(spark, lambda: _stars(edges, name), name)


def _stars(edges: DataFrame, name: str) -> DataFrame:
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    edge = stored(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    mark = None
    while True:
        edge = settled(spark, lambda edge=edge: _hung(edge, name), name)
        seen = tuple(edge.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b").cast("long"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    tops = edge.select(b.alias("node"), b.alias("component")).distinct()
    return edge.select(a.alias("node"), b.alias("component")).unionByName(tops)


def _hung(edge: DataFrame, name: str) -> DataFrame:
    """One round: the larger neighbours of each node, then the smaller ones, under the smallest."""
    a, b = F.col("a"), F.col("b")
    both = edge.select("a", "b").unionByName(edge.select(b.alias("a"), a.alias("b")))
    # The minima are written before they are joined: so the join has its rows in a stage of
    # its own, where the runtime can split those of a node with very many links.
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), a).alias("m")), name)
    large = both.join(least, "a").where("b > a and b <> m").select(b.alias("a"), F.col("m").alias("b"))
    large = stored(large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct(), name)
    small_least = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
    hung = large.join(small_least, "a").where("b <> m").select(b.alias("a"), F.col("m").alias("b"))
    return hung.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
