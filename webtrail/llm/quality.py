"""Text quality from weak labels.

Overlapping heuristics vote good, bad or abstain on every document. How often each pattern of
votes occurs is counted over all documents; expectation-maximisation over these counts (at
most 3 ** number of heuristics) estimates how far each heuristic can be trusted and gives each
pattern a posterior. The posteriors of about SAMPLE_ROWS documents train a hashed linear
scorer of byte trigrams and binned measures, which then scores every document.

Defined cases: null and empty texts, and texts without words, score 0 and are not kept; their
votes are all abstentions. Repeated rows are scored each, alike. If all documents get the same
posterior, the scorer gives that. An empty table gives an empty result. Other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm.common import LOWER, WHITE, chunks, query, separators, stored, table, text_pass, words

SAMPLE_ROWS = 4000
BITS = 11
KEEP = 0.5
#: Belief before the data: the share of bad votes among the votes on a bad and on a good text,
#: with the weight of this part of the corpus. A bad text has any one defect now and then, a
#: good text hardly ever; without it heuristics that find different defects outvote each other.
BAD_VOTE = (0.3, 0.005)
PRIOR_WEIGHT = 0.1

# Frequent function words of the four languages.
FUNCTION_WORDS = ("the of and to in is that it for was with as on be by at are this an or le la les de des et un une du en est que qui "
                  "dans pour pas sur au der die das und ist ein eine den von zu mit auf für nicht el los las y es una por con del se")

MEASURES = ("symbols", "again", "lines", "top", "bars", "function", "length", "variety")
_BINS = np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:128] = True
_SYMBOL[48:58] = _SYMBOL[65:91] = _SYMBOL[97:123] = False
_LINE = separators((0x0A, 0x0A))


def _codes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), WHITE).code


_FUNCTION = np.sort(_codes(FUNCTION_WORDS))
_BAR = _codes("|")[0]


def measure(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of a chunk: the measures, the number of words, the number of lines."""
    rows = len(bounds) - 1
    out = np.zeros((rows, len(MEASURES)))
    found, lines = words(data, bounds, WHITE), words(data, bounds, _LINE)
    count, n_lines = np.diff(found.first), np.diff(lines.first)
    some = np.maximum(1, count)
    size = np.maximum(1, np.diff(bounds))

    def per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[edges[1:]] - sums[edges[:-1]]

    out[:, 0] = per_row(_SYMBOL[data], bounds) / size
    again = np.zeros(len(found.code), bool)
    again[1:] = (found.code[1:] == found.code[:-1]) & (found.row[1:] == found.row[:-1])
    out[:, 1] = per_row(again, found.first) / some
    out[:, 4] = per_row(found.code == _BAR, found.first) / some
    out[:, 5] = per_row(np.isin(found.code, _FUNCTION), found.first) / some
    out[:, 6] = per_row(found.end - found.start, found.first) / some / 10
    for row in range(rows):
        a, b = found.first[row], found.first[row + 1]
        if b > a:
            ordered = np.sort(found.code[a:b])
            turns = np.flatnonzero(ordered[1:] != ordered[:-1])
            out[row, 7] = 1 - (len(turns) + 1) / (b - a)
            out[row, 3] = np.diff(np.concatenate(([-1], turns, [b - a - 1]))).max() / (b - a)
        a, b = lines.first[row], lines.first[row + 1]
        if b > a + 1:
            out[row, 2] = 1 - len(np.unique(lines.code[a:b])) / (b - a)
    return out, count, n_lines


def votes(m: np.ndarray, n: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 abstains; a column per measure."""
    def judge(value, bad, good, when=True):
        return np.where(when & bad(value), -1, np.where(when & good(value), 1, 0))

    return np.stack([
        judge(m[:, 0], lambda x: x > 0.12, lambda x: x < 0.06, n >= 5),
        judge(m[:, 1], lambda x: x > 0.2, lambda x: x < 0.05, n >= 5),
        judge(m[:, 2], lambda x: x > 0.3, lambda x: x < 0.1, lines >= 4),
        judge(m[:, 3], lambda x: x > 0.2, lambda x: x < 0.1, n >= 20),
        judge(m[:, 4], lambda x: x > 0.1, lambda x: x < 0, n >= 5),
        judge(m[:, 5], lambda x: x < 0.05, lambda x: x > 0.1, n >= 20),
        judge(m[:, 6], lambda x: (x > 0.8) | (x < 0.25), lambda x: (x > 0.35) & (x < 0.65), n >= 5),
        judge(m[:, 7], lambda x: x > 0.7, lambda x: x < 0.45, n >= 20),
    ], axis=1)


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" for each vote pattern, P(vote | class, votes) [heuristic, class,
    vote + 1] and the share of good documents. An abstention says nothing: heuristics abstain
    where a text is too short for them."""
    belief = PRIOR_WEIGHT * max(1.0, counts.sum())
    post = np.where((patterns < 0).any(1), 0.1, 0.9)
    like = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        share = float(np.clip((counts * post).sum() / max(1, counts.sum()), 1e-3, 1 - 1e-3))
        for h in range(patterns.shape[1]):
            for c, weight in enumerate((counts * (1 - post), counts * post)):
                got = np.array([weight[patterns[:, h] == v].sum() for v in (-1, 1)])
                got += belief * np.array([BAD_VOTE[c], 1 - BAD_VOTE[c]])
                like[h, c] = [got[0] / got.sum(), 1.0, got[1] / got.sum()]
        logs = np.log([1 - share, share]) + np.stack([np.log(like[h, :, patterns[:, h] + 1]) for h in range(patterns.shape[1])]).sum(0)
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return post, like, share


def _buckets(data: np.ndarray) -> np.ndarray:
    low = LOWER[data].astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


WIDTH = (1 << BITS) + len(MEASURES) * (len(_BINS) + 1)


def _binned(m: np.ndarray) -> np.ndarray:
    """Columns of the binned measures, after those of the trigrams."""
    return (1 << BITS) + np.arange(len(MEASURES)) * (len(_BINS) + 1) + np.searchsorted(_BINS, m)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, shrink: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, full-batch with momentum; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, step = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = 0.9 * step - rate * (x.T @ (p - y) / len(x) + shrink * w).astype(np.float32)
        w = w + step
    return w


SCALE = 30.0  # trigram shares are small: brings them to the size of the binned measures


def observed(docs: DataFrame) -> DataFrame:
    """doc_id, pattern (votes as one of "-0+" per heuristic)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = np.frombuffer(b"-0+", np.uint8)
        for batch in batches:
            rows = [votes(*measure(data, bounds)) for _, _, data, bounds in chunks(batch.column(1))]
            all_votes = np.concatenate(rows) if rows else np.zeros((0, len(MEASURES)), int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes().decode() for r in sign[all_votes + 1]], pa.string())], ["doc_id", "pattern"])

    return text_pass(docs, work, "doc_id long, pattern string")


def _features(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for low, high, data, bounds in chunks(batch.column(1)):
                cols = _binned(measure(data, bounds)[0])
                for row in range(high - low):
                    x = np.zeros(WIDTH, np.float32)
                    piece = data[bounds[row]:bounds[row + 1]]
                    if len(piece) > 2:
                        x[:1 << BITS] = np.bincount(_buckets(piece), minlength=1 << BITS) * (SCALE / (len(piece) - 2))
                    x[cols[row]] = 1
                    blobs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(blobs, pa.binary())], ["pattern", "x"])

    return docs.mapInArrow(work, "pattern string, x binary")


def classify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score (0 to 1), keep, posterior, pattern; a row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stored(observed(rows), "votes")
    counted = seen.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** 8 rows
    if not counted:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("keep"), F.lit(0.0).alias("posterior"), F.lit("").alias("pattern"))
    patterns = np.array([["-0+".index(v) - 1 for v in r["pattern"]] for r in counted])
    counts = np.array([r["count"] for r in counted], float)
    post, _, _ = label_model(patterns, counts)
    posterior = {r["pattern"]: float(p) for r, p in zip(counted, post)}

    total = counts.sum()
    share = min(1.0, sample_rows / total)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30))
    # A document's votes are found again from its text, so the sample needs no join.
    sample = rows.where(drawn & F.col("text").isNotNull())

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = np.frombuffer(b"-0+", np.uint8)
        for batch in batches:
            got = np.concatenate([votes(*measure(data, bounds)) for _, _, data, bounds in chunks(batch.column(1))] or [np.zeros((0, len(MEASURES)), int)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes().decode() for r in sign[got + 1]], pa.string())], ["doc_id", "text", "pattern"])

    sample = sample.mapInArrow(voted, "doc_id long, text string, pattern string")
    got = _features(sample).limit(2 * sample_rows).toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    y = np.array([posterior[p] for p in got["pattern"].to_pylist()], np.float32)
    weights = train(x, y) if len(x) else np.concatenate((np.zeros(WIDTH, np.float32), [0]))
    shared = spark.sparkContext.broadcast((weights, posterior))  # a few KB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = shared.value
        by_gram = weights[:1 << BITS].astype(float) * SCALE
        sign = np.frombuffer(b"-0+", np.uint8)
        for batch in batches:
            score = np.zeros(len(batch))
            names: list[str] = []
            for low, high, data, bounds in chunks(batch.column(1)):
                m, n, lines = measure(data, bounds)
                logit = weights[-1] + weights[_binned(m)].sum(1)
                if len(data) > 2:
                    sums = np.concatenate(([0.0], np.cumsum(by_gram[_buckets(data)])))
                    grams = np.maximum(0, np.diff(bounds) - 2)
                    start = np.minimum(bounds[:-1], len(sums) - 1)
                    logit = logit + (sums[np.minimum(start + grams, len(sums) - 1)] - sums[start]) / np.maximum(1, grams)
                score[low:high] = np.where(n > 0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), 0.0)
                names += [r.tobytes().decode() for r in sign[votes(m, n, lines) + 1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(score >= KEEP), pa.array([posterior[p] for p in names], pa.float64()), pa.array(names, pa.string())],
                ["doc_id", "score", "keep", "posterior", "pattern"])

    return text_pass(rows, work, "doc_id long, score double, keep boolean, posterior double, pattern string")


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return classify(table(spark, sf, "documents"))
