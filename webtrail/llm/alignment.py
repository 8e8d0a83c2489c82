"""Alignment of the tokens of two tokenizers.

Every text is encoded by a byte-level BPE (A) and a SentencePiece model (B); both segment the
same bytes, a space and the text. A token points to the token of the other side that overlaps it
and reaches farthest to the right; where two end together, the B token points to itself. Pointer
jumping (every pointer becomes its target's pointer, until nothing moves) takes all tokens of
many texts at once to the last token of their component, which labels the groups that
common ends cut out. A and B tokens that end together are linked.

How often a pair of ids is linked in the whole corpus is counted over the pairs of each chunk of
texts (CHUNK_BYTES, or one long text), which hold most repetitions in themselves: a document keeps
numbers into its chunk's list of pairs, and only these lists are joined with the corpus's counts.
A pair that is frequent everywhere is one row per chunk. No table of pairs is broadcast, only the
highest count of each B id (a row per id of the vocabulary).

A is encoded by tiktoken where its file describes plain byte-level BPE with its merges in the
order of the ids, which is the same segmentation and several times faster, otherwise (and where
tiktoken gives up on a text) by the tokenizers library. Special tokens are plain text in texts.

Defined cases: null and empty texts, and texts whose bytes either side does not give back (such
as those with a literal U+2581), have no tokens: all numbers are 0 and the digest is empty. Rows
with repeated or null ids are rows of their own. Very long texts are a chunk each. Other columns
are kept out of the result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm.common import chunks, query, ranges, settled, stored, table, text_pass

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
#: Fixed value: the pattern by which byte-level BPE cuts texts into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


# --- the two sides ---------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes of Latin-1
    stand for themselves, the others for the code points from 256 on, in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


def token_bytes(entry: str, alphabet: dict[str, int]) -> bytes:
    return bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()


@dataclass
class Side:
    """An encoder with the bytes of its ids."""

    encode: object  # list of texts -> list of id lists
    pool: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, encode, texts: list[bytes]) -> Side:
        size = np.array([len(t) for t in texts], np.int64)
        return cls(encode, np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(size)))[:-1], size)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[ranges(self.start[ids], self.size[ids])]


def _plain(spec: dict) -> bool:
    """Whether the file is byte-level BPE and nothing else, its merges in the order of the ids."""
    model, words = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    return ids == sorted(set(ids)) and sum(len(w) == 1 for w in model["vocab"]) == 256 and (not ids or ids[0] >= 256)


def byte_level(source: str) -> Side:
    """The A side of a tokenizer file's text."""
    from tokenizers import Tokenizer

    spec = json.loads(source)
    alphabet = byte_alphabet()
    vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    texts = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        texts[i] = token_bytes(entry, alphabet)
    held: list[Tokenizer] = []

    def general(text: str) -> list[int]:
        if not held:
            held.append(Tokenizer.from_str(source))
            held[0].encode_special_tokens = True
        return held[0].encode(text, add_special_tokens=False).ids

    if not _plain(spec):
        return Side.of(lambda texts: [general(t) for t in texts], texts)
    import tiktoken

    added = {t["content"] for t in spec.get("added_tokens", [])}
    fast = tiktoken.Encoding("plain", pat_str=WORD_PATTERN, mergeable_ranks={texts[i]: i for e, i in spec["model"]["vocab"].items() if e not in added}, special_tokens={})

    def encode(texts: list[str]) -> list:
        out = []
        for t in texts:
            try:
                out.append(fast.encode_ordinary(t))
            except BaseException as failure:  # its regular expressions have a limit on some very long runs
                if isinstance(failure, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
                out.append(general(t))
        return out

    return Side.of(encode, texts)


def piece_model(source: bytes) -> Side:
    """The B side of a model file's bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=source)
    texts = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]]
    return Side.of(lambda texts: sp.encode(texts, num_threads=1), texts)


# --- groups and links ------------------------------------------------------------------


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Of every token, A's then B's, the B token that ends its component. Ends grow on each side
    and the last ones are equal."""
    n = len(a_end)
    to_b = np.searchsorted(b_end, a_end)  # overlaps the A token's last byte
    to_a = np.searchsorted(a_end, b_end)
    follow = np.concatenate((n + to_b, np.where(a_end[to_a] == b_end, n + np.arange(len(b_end)), to_a))) if n else np.zeros(0, np.int64)
    while True:
        further = follow[follow]
        if (further == follow).all():
            return follow - n
        follow = further


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, one row each and room for one more character; their numbers."""
    shown = [str(k).encode() for k in range(n)]
    size = np.array([len(s) for s in shown], np.int64)
    wide = int(size.max()) + 1
    return np.frombuffer(b"".join(s.ljust(wide) for s in shown), np.uint8).reshape(n, wide).copy(), size


@dataclass
class Aligned:
    """Rows of a slice: numbers per row, and the linked pairs (a * ids of B + b) in order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digest: list[str]
    pair: np.ndarray
    pair_row: np.ndarray


class Aligner:
    def __init__(self, a_source: str, b_source: bytes):
        self.a, self.b = byte_level(a_source), piece_model(b_source)
        self.width = len(self.b.size)
        self.digits, self.lengths = _decimals(max(len(self.a.size), self.width))

    def align(self, texts: list[str | None]) -> Aligned:
        rows = np.array([k for k, t in enumerate(texts) if t], np.int64)
        full = [" " + texts[k] for k in rows.tolist()]
        a_lists, b_lists = self.a.encode(full), self.b.encode([t[1:] for t in full])
        want = [t.encode() for t in full]
        good = np.ones(len(rows), bool)
        sides = []
        for side, lists in ((self.a, a_lists), (self.b, b_lists)):
            counts = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum()))
            data, upto = side.bytes_of(ids), np.concatenate(([0], np.cumsum(side.size[ids])))
            at = upto[np.concatenate(([0], np.cumsum(counts)))]
            for k, w in enumerate(want):
                good[k] &= data[at[k]:at[k + 1]].tobytes() == w
            # A piece of no bytes has no place in a text; such rows have no tokens either.
            empty = np.flatnonzero(side.size[ids] == 0)
            good[np.repeat(np.arange(len(rows)), counts)[empty]] = False
            sides.append((ids, counts))
        (a, na), (b, nb) = ((ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in sides)
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        a_row, b_row = np.repeat(np.arange(len(rows)), na), np.repeat(np.arange(len(rows)), nb)

        last = terminals(a_end, b_end)
        closes = last[len(a):] == np.arange(len(b))  # B tokens that end with an A token
        number = np.cumsum(closes) - 1
        group_a, group_b = number[last[:len(a)]], number[last[len(a):]]
        link_b = np.flatnonzero(closes)
        link_a = np.searchsorted(a_end, b_end[link_b])
        digest = self._digests(a, b, group_a, group_b, link_a, link_b, na, nb)

        n = len(texts)
        out = [np.zeros(n, np.int64) for _ in range(3)]
        out[0][rows], out[1][rows] = na, nb
        out[2][rows] = np.bincount(b_row[link_b], minlength=len(rows))
        named = [""] * n
        for k, d in zip(rows.tolist(), digest):
            named[k] = d
        return Aligned(*out, named, a[link_a] * self.width + b[link_b], rows[a_row[link_a]])

    def _digests(self, a, b, group_a, group_b, link_a, link_b, na, nb) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of every row, empty without tokens."""
        if not len(a):
            return [""] * len(na)
        a_before, b_before = np.concatenate(([0], link_a + 1)), np.concatenate(([0], link_b + 1))
        at_a = np.arange(len(a)) + b_before[group_a]  # a group's A tokens stand before its B tokens
        at_b = np.arange(len(b)) + a_before[group_b + 1]
        ids = np.empty(len(a) + len(b), np.int64)
        after = np.full(len(ids), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        after[at_a[link_a]] = ord("|")
        after[at_b[link_b]] = ord(";")
        row_end = np.cumsum(na + nb)
        size = self.lengths[ids] + 1
        grid = self.digits[ids]
        grid[np.arange(len(ids)), size - 1] = after
        text = grid[np.arange(grid.shape[1]) < size[:, None]].tobytes()
        stop = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], row_end))].tolist()
        return [hashlib.sha256(text[stop[k]:stop[k + 1] - 1]).hexdigest() if stop[k + 1] > stop[k] else "" for k in range(len(na))]


# --- the corpus ------------------------------------------------------------------------


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


def encoded(docs: DataFrame, a_source: str, b_source: bytes) -> DataFrame:
    """Rows of documents (number, columns of DOC, chunk, places in the chunk's list of pairs and how
    often each is linked) and of the chunks' lists (chunk, place, pair, n), told apart by place."""
    shared = docs.sparkSession.sparkContext.broadcast((a_source, b_source))  # two files' size
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunk", "at", "times", "place", "pair", "n"]

    def closed(chunk: int, parts: list[tuple[pa.Array, Aligned]]) -> Iterator[pa.RecordBatch]:
        listed, place, n = np.unique(np.concatenate([p.pair for _, p in parts]), return_inverse=True, return_counts=True)
        done = 0
        for ids, p in parts:
            mine = place[done:done + len(p.pair)]
            done += len(p.pair)
            # Sorted by (row, place): what a row links several times stands once, with its number.
            key, times = np.unique(p.pair_row * max(1, len(listed)) + mine, return_counts=True)
            row, at = np.divmod(key, max(1, len(listed)))
            each = np.bincount(row, minlength=len(ids))
            links = np.bincount(p.pair_row, minlength=len(ids))
            none = lambda kind: pa.nulls(len(ids), kind)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(p.n_a), pa.array(p.n_b), pa.array(p.n_groups), pa.array(links), pa.array(p.digest),
                pa.array(np.full(len(ids), chunk), mask=links == 0), _lists(at, each), _lists(times, each), none(pa.int64()), none(pa.int64()), none(pa.int64())], names)
        for low in range(0, len(listed), 1 << 16):
            some = listed[low:low + (1 << 16)]
            none = lambda kind: pa.nulls(len(some), kind)
            yield pa.RecordBatch.from_arrays([
                *[none(pa.int64())] * 5, none(pa.string()), pa.array(np.full(len(some), chunk)), none(pa.list_(pa.int32())), none(pa.list_(pa.int32())),
                pa.array(np.arange(low, low + len(some))), pa.array(some), pa.array(n[low:low + len(some)])], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        chunk, held, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for low, high, data, _ in chunks(batch.column(1), SLICE_BYTES):
                parts.append((batch.column(0).slice(low, high - low), aligner.align(batch.column(1).slice(low, high - low).to_pylist())))
                held += len(data)
                if held >= CHUNK_BYTES:
                    yield from closed(chunk, parts)
                    chunk, held, parts = chunk + 1, 0, []
        if parts:
            yield from closed(chunk, parts)

    return text_pass(docs, work, f"{DOC}, chunk long, at array<int>, times array<int>, place long, pair long, n long")


def scored(linked: DataFrame, answers: DataFrame) -> DataFrame:
    """DOC, n_best, count_sum of documents with links: the rows of a chunk meet the counts of its
    list of pairs."""
    nothing = lambda kind: F.lit(None).cast(kind)
    doc = [c.split()[0] for c in DOC.split(", ")]
    rows = linked.select("chunk", F.lit(1).alias("kind"), *doc, "at", "times", nothing("long").alias("place"), nothing("long").alias("count"), nothing("boolean").alias("best"))
    lists = answers.select("chunk", F.lit(0).alias("kind"), *[nothing(linked.schema[c].dataType).alias(c) for c in [*doc, "at", "times"]], "place", "count", "best")
    both = lists.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, count, best = None, [], None, None
        for batch in batches:
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turns = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1]))))
            for low, high in zip(turns.tolist(), [*turns[1:].tolist(), len(batch)]):
                part = batch.slice(low, high - low)
                if chunk[low] != now:
                    now, told, count = chunk[low], [], None
                if kind[low] == 0:
                    told.append(tuple(part.column(k).to_numpy(zero_copy_only=False) for k in (10, 11, 12)))
                    continue
                if count is None:
                    place, c, b = (np.concatenate(x) for x in zip(*told))
                    count, best, told = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), []
                    count[place], best[place] = c, b.astype(bool)
                at, times = (part.column(k).flatten().to_numpy().astype(np.int64) for k in (8, 9))
                ends = np.concatenate(([0], np.cumsum(part.column(8).value_lengths().to_numpy().astype(np.int64))))
                sums = [np.diff(np.concatenate(([0], np.cumsum(x[at] * times)))[ends]) for x in (best, count)]
                yield pa.RecordBatch.from_arrays([*part.columns[2:8], *map(pa.array, sums)], [*doc, "n_best", "count_sum"])

    return both.mapInArrow(work, f"{DOC}, n_best long, count_sum long")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        a_source, b_source = a.read(), b.read()
    width = len(piece_model(b_source).size)

    def make() -> DataFrame:
        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        every = stored(encoded(rows, a_source, b_source), "encoded")
        lists = every.where("place IS NOT NULL").select("chunk", "place", "pair", "n")
        counts = stored(lists.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
        b_id = F.pmod(F.col("pair"), F.lit(width)).alias("b")
        most = counts.groupBy(b_id).agg(F.max("count").alias("most"))  # a row per id of B at most
        counts = counts.select("pair", "count", b_id).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
        answers = lists.join(counts, "pair").select("chunk", "place", "count", "best")
        documents = every.where("place IS NULL")
        names = [c.split()[0] for c in DOC.split(", ")]
        without = documents.where("chunk IS NULL").select(*names, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
        return scored(documents.where("chunk IS NOT NULL"), answers).unionByName(without)

    return settled(spark, make, "aligned").withColumnRenamed("doc_id", key)


@query("op12_cross_tokenizer_alignment")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return align(table(spark, sf, "documents"))
