"""Language identification by fusing evidence.

Per document: a naive Bayes likelihood of the text's byte trigrams, the declared language of
the markup, the address suffix and a prior of the host. Every code declared by LEAST_DECLARED rows or more is a language, however large the
table is. The trigram model is fitted on a sample of about SAMPLE_ROWS documents with a declared
language, and of every language about LEAST_SAMPLE of them, or all it has. Everything else covers all
rows: how far a declaration or a suffix can be trusted is a grouped count of (declared,
language of the text), and host priors are grouped sums of text posteriors, smoothed towards
the host's domain and that towards the whole corpus.

Rejected are documents without a language: less than MIN_LETTERS of their visible bytes are
letters, or no language has half the posterior. A very short text is judged by what else is
known of it.

Defined cases: null and empty texts have no letters; they are rejected ("und"). Null declared
language, suffix or host is no evidence. Repeated rows are answered each. With no declared
language in the whole table nothing can be fitted and every row is "und". An empty table
gives an empty result. Columns of other names are kept out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm.common import LOWER, chunks, query, settled, stored, table, text_pass

SAMPLE_ROWS = 8000
LEAST_DECLARED, LEAST_SAMPLE = 2, 200
NO_LANGUAGE = ("mis", "mul", "und", "zxx")  # codes that name none
BITS = 15
MIN_LETTERS = 0.3
LENGTH_CAP = 60.0  # trigrams that count in full; neighbouring trigrams of longer texts repeat each other
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_VISIBLE = np.ones(256, bool)
_VISIBLE[:33] = False


def trigrams(data: np.ndarray) -> np.ndarray:
    """A bucket for each run of three bytes."""
    low = LOWER[data].astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def evidence(docs: DataFrame) -> DataFrame:
    """The columns the operator reads: doc_id, text, declared, suffix, host."""
    have = set(docs.columns)
    column = lambda name: (F.col(name) if name in have else F.lit(None)).cast("string")
    host = F.lower(column("host") if "host" in have else column("source"))
    declared = F.lower(F.regexp_extract(F.coalesce(column("declared") if "declared" in have else column("lang"), F.lit("")), "^\\s*([A-Za-z]{2,3})", 1))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), column("text").alias("text"), F.when(declared != "", declared).alias("declared"),
        F.lower(column("suffix")).alias("suffix"), host.alias("host"), F.xxhash64(column("text")).alias("text_hash"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html): markup language, address suffix and host beside the text."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return pages.select(
        F.col("page_id").alias("doc_id"), F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ").alias("text"),
        F.regexp_extract("html", r"""(?i)<html[^>]*\blang=["']?([a-z]{2,3})""", 1).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"))


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities [bucket, language] from a sample of the declared rows."""
    counts = rows.groupBy("declared").count().where((F.col("count") >= LEAST_DECLARED) & ~F.col("declared").isin(*NO_LANGUAGE)).collect()  # a row a code
    total = sum(r["count"] for r in counts)
    langs = sorted(r["declared"] for r in counts)
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = {r["declared"]: min(1.0, max(sample_rows / total, LEAST_SAMPLE / r["count"])) for r in counts}
    limit = F.element_at(F.array(*(F.lit(int(share[lang] * (1 << 20)) + 1) for lang in langs)), F.array_position(F.array(*map(F.lit, langs)), F.col("declared")).cast("int"))
    sample = rows.where(F.col("declared").isin(langs)).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit)
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column(1).to_pylist()
            for low, high, data, bounds in chunks(batch.column(0)):
                for row in range(low, high):
                    a, b = bounds[row - low], bounds[row - low + 1]
                    if b - a > 2:
                        which = place[label[row]]
                        if which not in sums:
                            sums[which] = np.zeros(1 << BITS, np.int64)
                        sums[which] += np.bincount(trigrams(data[a:b]), minlength=1 << BITS)
        for which, one in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([one.tobytes()], pa.binary())], ["place", "sums"])

    parts = sample.select("text", "declared").repartition(8).mapInArrow(count, "place int, sums binary").collect()
    sums = np.zeros((len(langs), 1 << BITS))
    for part in parts:  # 8 tasks x languages, each of fixed width
        sums[part["place"]] += np.frombuffer(part["sums"], np.int64)
    sums += 0.5
    return langs, np.log(sums / sums.sum(axis=1, keepdims=True)).T.astype(np.float32)


def likelihoods(rows: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, declared, suffix, host, n trigrams, share of letters, fit: log likelihood by language."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))  # 128 KB a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            n, letters = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            scores = np.zeros((len(batch), len(logs)))
            for low, high, data, bounds in chunks(batch.column(1)):
                begin, end = bounds[:-1], bounds[1:]
                seen = np.concatenate(([0], np.cumsum(_VISIBLE[data])))
                letter = np.concatenate(([0], np.cumsum(_LETTER[data])))
                letters[low:high] = (letter[end] - letter[begin]) / np.maximum(1, seen[end] - seen[begin])
                if len(data) < 3:
                    continue
                count = np.maximum(0, end - begin - 2)
                n[low:high] = np.minimum(count, letter[end] - letter[begin])
                at = trigrams(data)
                stop = np.minimum(begin + count, len(at))
                start = np.minimum(begin, len(at))
                for k, column in enumerate(logs):
                    sums = np.concatenate(([0.0], np.cumsum(column[at], dtype=np.float64)))
                    scores[low:high, k] = (sums[stop] - sums[start]) / np.maximum(1, count) * np.minimum(count, LENGTH_CAP)
            flat = pa.array(scores.ravel())
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(logs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), batch.column(4), batch.column(5), pa.array(n), pa.array(letters), pa.ListArray.from_arrays(ends, flat)],
                ["doc_id", "declared", "suffix", "host", "text_hash", "n", "letters", "fit"])

    return text_pass(
        rows.select("doc_id", "text", "declared", "suffix", "host", "text_hash"), work, "doc_id long, declared string, suffix string, host string, text_hash long, n long, letters double, fit array<double>")


def softmax(logs) -> F.Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _reliability(seen: DataFrame, name: str, size: int) -> DataFrame:
    """Every value with its log P(value | language), smoothed, from grouped sums."""
    sums = stored(seen.where(F.col(name).isNotNull()).groupBy(name).agg(*(F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(size))), f"{name}-sums")
    n, *totals = sums.agg(F.count("*"), *(F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(size))).first()
    return sums.select(name, F.array(*(F.log((F.col(f"s{i}") + 0.5) / (totals[i] + 0.5 * (n + 1))) for i in range(size))).alias(f"{name}_log"))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text_hash, lang ("und" if rejected), confidence, declared, accepted; a row per document."""
    spark = docs.sparkSession
    rows = evidence(docs)
    langs, model = fit(rows, sample_rows)
    size = len(langs)
    if not size:
        return rows.select("doc_id", "text_hash", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), "declared", F.lit(False).alias("accepted"))
    seen = stored(likelihoods(rows, langs, model).withColumn("post", softmax(F.col("fit"))), "language")

    tables = [(name, _reliability(seen.where("n > 0"), name, size)) for name in ("declared", "suffix")]

    # Host priors: sums of text posteriors by host, drawn towards the domain and the corpus.
    domain = F.regexp_extract("host", r"([^.]*(?:\.[^.]*)?)$", 1)
    by_host = stored(seen.where("n > 0 AND host IS NOT NULL").groupBy("host").agg(*(F.sum(F.col("post")[i]).alias(f"h{i}") for i in range(size))).withColumn("domain", domain), "hosts")
    whole = by_host.agg(*(F.coalesce(F.sum(f"h{i}"), F.lit(0.0)) for i in range(size))).first()
    every = [(v + 1.0) / (sum(whole) + size) for v in whole]
    by_domain = by_host.groupBy("domain").agg(*(F.sum(f"h{i}").alias(f"d{i}") for i in range(size)))
    d_total = sum((F.col(f"d{i}") for i in range(size)), F.lit(0.0))
    by_domain = by_domain.select("domain", *(((F.col(f"d{i}") + DOMAIN_WEIGHT * every[i]) / (d_total + DOMAIN_WEIGHT)).alias(f"d{i}") for i in range(size)))
    h_total = sum((F.col(f"h{i}") for i in range(size)), F.lit(0.0))
    prior = by_host.join(by_domain, "domain").select("host", F.array(*(F.log((F.col(f"h{i}") + HOST_WEIGHT * F.col(f"d{i}")) / (h_total + HOST_WEIGHT)) for i in range(size))).alias("host_log"))

    joined = seen.join(prior, "host", "left")
    for name, small in tables:
        joined = joined.join(small, name, "left")
    none = F.array(*(F.lit(0.0) for _ in range(size)))
    start = F.array(*(F.lit(float(np.log(p))) for p in every))
    logs = F.col("fit")
    for part in (F.coalesce("host_log", start), F.coalesce("declared_log", none), F.coalesce("suffix_log", none)):
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    post = joined.select("doc_id", "text_hash", "declared", "letters", softmax(logs).alias("post"))
    best = F.array_max("post")
    accepted = (F.col("letters") >= MIN_LETTERS) & (best >= 0.5)
    lang = F.element_at(F.array(*(F.lit(x) for x in langs)), F.array_position("post", best).cast("int"))
    return post.select("doc_id", "text_hash", F.when(accepted, lang).otherwise("und").alias("lang"), F.when(F.col("letters") > 0, best).otherwise(0.0).alias("confidence"), "declared", accepted.alias("accepted"))


@query("op7_language_id")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return identify(table(spark, sf, "documents")).drop("text_hash")


def identified(docs: DataFrame) -> DataFrame:
    """The documents without the rejected ones; a row is known by its id and its text."""
    found = lambda: identify(docs).where("NOT accepted").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rejected = settled(docs.sparkSession, found, "rejected")
    # Columns are named through their frames: docs may have an _id of its own.
    same = docs["doc_id"].cast("long").eqNullSafe(rejected["_id"]) & (F.xxhash64(docs["text"].cast("string")) == rejected["_hash"])
    return docs.join(rejected, same, "left_anti")
