"""Sampled SentencePiece segmentations, reproducible and lossless.

A text becomes a lattice of pieces. Forward filtering sums the weight of all segmentations up
to each position; backward sampling then draws one segmentation from its exact distribution.
Random numbers are a function of (seed, row key, unit, step), so a row gets the same pieces on
any cluster, in any partition. A piece's probability falls with its rank in the model file
(1 / (rank + SHIFT)), raised to `alpha`; characters without a piece are spelt in byte pieces.

Pieces never run over the end of a unit, a run of spaces with the word after it. Rows are
taken in slices of about SLICE_BYTES; the lattice of a unit is built once for a slice and all
its occurrences are sampled together.

As in the library's own encoder a space is put before the text, so its decoder gives the text
back too. Defined cases: null and empty texts have no pieces and decode to an empty text; a
literal U+2581 is spelt in bytes, so decoding is exact; repeated keys with the same text get
the same pieces; a null key counts as a key of its own. Lone surrogates cannot occur in Spark's
strings. Other columns are kept out of the result. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm.common import mix, powers, query, ranges, table, text_pass, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 17
ALPHA = 1.0
SHIFT = 10.0
BYTE_COST = 2.0  # a byte piece weighs this many nats less than the rarest piece
SLICE_BYTES = 1 << 18
SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """What the executors need of a model file: at most a few MB."""

    pieces: dict[str, tuple[int, float] | None]  # None: only the beginning of longer pieces
    spelt: tuple[int, ...]  # ids of the 256 byte pieces
    byte_weight: float
    texts: tuple[bytes, ...]  # bytes of each id


def vocabulary(model: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    if not all(sp.piece_to_id(f"<0x{b:02X}>") != sp.unk_id() for b in range(256)):
        raise ValueError("the model has no byte pieces: it cannot spell every text")
    weights = {i: -alpha * math.log(rank + SHIFT) for rank, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
    pieces: dict[str, tuple[int, float] | None] = {}
    texts = [b""] * n
    for i in plain:
        piece = sp.id_to_piece(i).replace(SPACE, " ")
        texts[i] = piece.encode()
        for k in range(1, len(piece)):
            pieces.setdefault(piece[:k], None)
        pieces[piece] = (i, weights[i])
    spelt = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    for b, i in enumerate(spelt):
        texts[i] = bytes([b])
    return Vocabulary(pieces, spelt, min(weights.values()) - alpha * BYTE_COST, tuple(texts))


class Prefixes:
    """Pieces and their beginnings under a 64-bit hash of their code points."""

    def __init__(self, words: Vocabulary):
        self.longest = max(map(len, words.pieces))
        text = "".join(words.pieces)
        size = np.array([len(p) for p in words.pieces])
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        sums = prefix_sums(codes(text))
        hashed = span_hash(sums, begin, begin + size)
        order = np.argsort(hashed)
        hashed = hashed[order]
        if (np.diff(hashed) == 0).any():
            raise ValueError("two pieces share a hash")
        # Buckets by the upper bits; the few hashes of a bucket stand side by side.
        self.bucket = np.searchsorted(hashed >> np.uint64(44), np.arange(1 << 20, dtype=np.uint64))
        self.most = int(np.bincount((hashed >> np.uint64(44)).astype(np.int64)).max())
        self.hashed = np.concatenate((hashed, np.zeros(self.most + 1, np.uint64)))
        self.id = np.array([-1 if v is None else v[0] for v in words.pieces.values()])[order]
        self.weight = np.array([0.0 if v is None else v[1] for v in words.pieces.values()])[order]
        longer = {p[:-1] for p in words.pieces}
        self.goes_on = np.array([p in longer for p in words.pieces])[order]

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Where each hash stands, -1 for none."""
        first = self.bucket[(hashed >> np.uint64(44)).astype(np.int64)]
        out = np.where(self.hashed[first] == hashed, first, -1)
        for k in range(1, self.most):
            at = first + k
            np.copyto(out, at, where=self.hashed[at] == hashed)
        return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def prefix_sums(chars: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * powers(len(chars) + 1)[0][:len(chars)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * powers(len(sums))[1][begin] + (end - begin).astype(np.uint64))


class Lattices:
    """Lattices of units, end to end: nodes are positions, edges the pieces that end there."""

    def __init__(self, chars: np.ndarray, size: np.ndarray, prefixes: Prefixes, byte_weight: float):
        """chars: the units' code points, end to end; size: the length of each unit."""
        stop = np.cumsum(size)
        unit = np.repeat(np.arange(len(size)), size)
        self.begin = stop - size + np.arange(len(size))  # first node of each unit, and its last
        self.finish = self.begin + size
        sums = prefix_sums(chars)
        alive = np.arange(len(chars))
        alone = np.zeros(len(chars), bool)
        start, width, put, weight = [], [], [], []
        for length in range(1, prefixes.longest + 1):
            alive = alive[alive + length <= stop[unit[alive]]]
            at = prefixes.find(span_hash(sums, alive, alive + length))
            alive, at = alive[at >= 0], at[at >= 0]
            if not len(alive):
                break
            whole = prefixes.id[at] >= 0
            start.append(alive[whole])
            width.append(np.full(len(start[-1]), length))
            put.append(prefixes.id[at[whole]])
            weight.append(prefixes.weight[at[whole]])
            if length == 1:
                alone[start[-1]] = True
            alive = alive[prefixes.goes_on[at]]
        spelt = np.flatnonzero(~alone)
        if len(spelt):
            c = chars[spelt].astype(np.int64)
            start.append(spelt)
            width.append(np.ones(len(spelt), np.int64))
            put.append(-1 - c)
            weight.append(byte_weight * (1.0 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
        start, width, put, weight = map(np.concatenate, (start, width, put, weight))
        node = start + unit[start]
        # Level by level: the edges that end at the j-th position of any unit.
        end = node + width
        level = end - self.begin[unit[start]]
        # The key names an edge fully, so a unit's edges have one order in every slice.
        order = np.argsort((level * (len(chars) + len(size) + 1) + end) * (prefixes.longest + 1) + width)
        node, end, put, weight, level = node[order], end[order], put[order], weight[order], level[order]
        heads = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        turns = np.concatenate(([0], np.flatnonzero(np.diff(level)) + 1, [len(level)]))
        reach = np.zeros(len(chars) + len(size))
        head_turns = np.searchsorted(heads, turns)
        for k in range(len(turns) - 1):
            a, b = turns[k], turns[k + 1]
            into = heads[head_turns[k]:head_turns[k + 1]]
            reach[end[into]] = np.logaddexp.reduceat(reach[node[a:b]] + weight[a:b], into - a)
        self.source, self.put = node, put
        self.head = np.zeros(len(reach), np.int64)  # of each node, its first edge; the others follow
        self.head[end[heads]] = heads
        bounds = np.concatenate((heads, [len(end)]))
        # Cumulative probability in each node, summed from its first edge: what else is in the
        # slice leaves no rounding behind.
        self.upto = np.exp(reach[node] + weight - reach[end])
        count = np.diff(bounds)
        more = heads[count > 1]
        left = count[count > 1] - 1
        while len(more):
            self.upto[more + 1] += self.upto[more]
            more, left = more[left > 1] + 1, left[left > 1] - 1
        self.upto[bounds[1:] - 1] = 1.0

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge into each node by a number in [0, 1)."""
        edge = self.head[node]
        on = np.flatnonzero(self.upto[edge] <= u)
        while len(on):
            edge[on] += 1
            on = on[self.upto[edge[on]] <= u[on]]
        return edge


def uniform(key: np.ndarray, unit: np.ndarray, step: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but their arguments."""
    with np.errstate(over="ignore"):
        x = mix(key + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        x = mix(x + unit.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        x = mix(x + np.uint64(step + 1) * np.uint64(0x8CB92BA72F3D8DD7))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


class Sampler:
    def __init__(self, words: Vocabulary, seed: int):
        self.words, self.seed, self.prefixes = words, seed, Prefixes(words)
        self.spelt = np.array(words.spelt, np.int32)
        self.length = np.array([len(t) for t in words.texts])
        self.starts = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.pool = np.frombuffer(b"".join(words.texts), np.uint8)

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the number of ids of each row."""
        full = np.array([len(t) + 1 if t else 0 for t in texts])
        if not full.any():
            return np.zeros(0, np.int32), full
        chars = codes("".join(" " + t for t in texts if t))
        begins = np.concatenate(([0], np.cumsum(full)))
        space = chars == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[begins[:-1][full > 0]] = True
        first = np.flatnonzero(opens)
        end = np.concatenate((first[1:], [len(chars)]))
        row = np.searchsorted(begins, first, "right") - 1
        number = first - begins[row]  # a unit's place in its row
        _, sample, unit = np.unique(span_hash(prefix_sums(chars), first, end), return_index=True, return_inverse=True)
        size = (end - first)[sample]
        lattices = Lattices(chars[ranges(first[sample], size)], size, self.prefixes, self.words.byte_weight)
        source, put = lattices.source, lattices.put
        node, stop = lattices.finish[unit], lattices.begin[unit]
        alive = np.arange(len(unit))
        drawn, steps = [], np.zeros(len(unit), np.int64)
        step = 0
        while len(alive):
            u = uniform(keys[row[alive]], number[alive], step, self.seed)
            edge = lattices.draw(node[alive], u)
            drawn.append((alive, edge))
            steps[alive] += 1
            node[alive] = source[edge]
            alive = alive[node[alive] > stop[alive]]
            step += 1
        first = np.concatenate(([0], np.cumsum(steps)))
        out = np.empty(first[-1], np.int64)
        for k, (at, edge) in enumerate(drawn):
            out[first[at] + steps[at] - 1 - k] = put[edge]
        owner = np.repeat(row, steps)
        bad = np.flatnonzero(out < 0)
        if len(bad):
            spelt = [self.spelt[list(chr(-1 - c).encode())] for c in out[bad].tolist()]
            many = np.ones(len(out), np.int64)
            many[bad] = [len(s) for s in spelt]
            wide = np.repeat(out, many)
            places = np.concatenate(([0], np.cumsum(many)))
            wide[ranges(places[bad], many[bad])] = np.concatenate(spelt)
            out, owner = wide, np.repeat(owner, many)
        return out.astype(np.int32), np.bincount(owner, minlength=len(texts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows end to end, the space in front taken off, and the rows' bounds."""
        lengths = self.length[ids]
        data = self.pool[ranges(self.starts[ids], lengths)]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        rows = np.concatenate(([0], np.cumsum(counts)))
        bounds = upto[rows]
        full = counts > 0
        keep = np.ones(len(data), bool)
        keep[bounds[:-1][full]] = False
        return data[keep], bounds - np.concatenate(([0], np.cumsum(full)))


def _keys(column: pa.Array) -> np.ndarray:
    keys = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    return mix(keys + np.uint64(1)) ^ np.where(nulls, np.uint64(0x5851F42D4C957F2D), np.uint64(0))


def _slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    _, bounds = utf8(batch.column(1))
    low = 0
    while low < len(batch):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """key, n_pieces, piece_ids, lossless (the ids were decoded again and give the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model, alpha))  # the model's size, no row's

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value, seed)
        for whole in batches:
            for batch in _slices(whole):
                ids, counts = sampler.encode(batch.column(1).to_pylist(), _keys(batch.column(0)))
                data, bounds = sampler.decode(ids, counts)
                want, limits = utf8(batch.column(1))
                same = np.diff(bounds) == np.diff(limits)
                if len(data) == limits[-1] - limits[0] and same.all():
                    wrong = np.concatenate(([0], np.cumsum(data != want[limits[0]:limits[-1]])))
                    same &= np.diff(wrong[bounds]) == 0
                else:
                    same = np.array([data[bounds[i]:bounds[i + 1]].tobytes() == want[limits[i]:limits[i + 1]].tobytes() for i in range(len(batch))], bool)
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.array(same)],
                    ["key", "n_pieces", "piece_ids", "lossless"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return text_pass(rows, work, "key long, n_pieces long, piece_ids array<int>, lossless boolean").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """key, text of rows of piece_ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value, SEED)
        for whole in batches:
            for low in range(0, len(whole), 256):
                batch = whole.slice(low, 256)
                lists = batch.column(1)
                counts = np.array([0 if v is None else len(v) for v in lists.to_pylist()])
                data, bounds = sampler.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                text = [data[bounds[i]:bounds[i + 1]].tobytes().decode() for i in range(len(batch))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["key", "text"])

    rows = encoded.select(F.col(key).cast("long").alias("key"), "piece_ids")
    return rows.mapInArrow(work, "key long, text string").withColumnRenamed("key", key)


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"))
