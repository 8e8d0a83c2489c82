"""Benchmark passages in documents, in DataFrame functions alone.

A window is as many words of a document as an item has; it may begin at any word, and at the ends
of a document windows are cut. A cut window is reported only if no whole one of the pair reaches
the similarity. The weights of shingles are their counts, and sum(min) / sum(max) of
window and item has to reach SIMILARITY. Only (document, item) pairs whose shared shingles cover
enough of the item are followed, which loses nothing, since the similarity asked for cannot be
reached otherwise. There is no fingerprint in between: the pairs are known from their shared
shingles, and no Hamming radius holds for weighted shingles.

All windows of a pair are compared at once. A shingle that an item holds d times counts at most d
times, so an occurrence counts in just those windows that hold it but not the d-th one before it:
an interval of starts. sum(min) of every window is a running sum over the ends of these intervals.
Between two ends it stays the same and the windows' sizes first grow, then fall, so the best cut
window is at one of both and the whole ones are alike.

Words are runs of letters and digits, lower-cased. Items with fewer than SHINGLE words are one
shingle of all their words. Null and empty texts, and items without words, meet nothing. A
document repeated with the same id and text is one document; a null doc_id is kept as one. Ties
between windows go to the first. Columns of other names are ignored. Empty tables give an
empty result. Items are broadcast only if their shingles are no more than BROADCAST_ROWS rows,
otherwise the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtrail.llm.common import query, settled, stored, table

SHINGLE = 5
SIMILARITY = 0.8
BROADCAST_ROWS = 2_000_000
WORD = r"[\p{L}\p{N}]+"
NO_ID = -(1 << 63)


def word_codes(text) -> F.Column:
    """64-bit codes of the words of a text, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(codes: str, width: int) -> str:
    """The shingles of `width` words; none for fewer words."""
    parts = ", ".join(f"get({codes}, i + {k})" for k in range(width))
    return f"IF(size({codes}) < {width}, CAST(array() AS array<bigint>), transform(sequence(0, size({codes}) - {width}), i -> xxhash64({width}, {parts})))"


def items_of(benchmark: DataFrame, shingle: int) -> DataFrame:
    """item_id, width of its shingles, shingles in order."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_codes(F.col("text")).alias("codes")).where(F.size("codes") > 0)
    width = F.least(F.size("codes"), F.lit(shingle))
    arms = " ".join(f"WHEN {w} THEN {_shingles('codes', w)}" for w in range(1, shingle + 1))
    return rows.withColumn("width", width).select("item_id", "width", F.expr(f"CASE width {arms} END").alias("shingles"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, first_word, n_words, similarity: the best window of each
    (document, item) that reaches the similarity."""
    items = stored(items_of(benchmark, shingle), "items")
    bag = stored(items.select("item_id", "width", F.posexplode("shingles").alias("place", "shingle")), "item-shingles")
    total = bag.count()
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most `shingle` rows
    held = bag.groupBy("width", "shingle", "item_id").agg(F.count("*").cast("int").alias("d"))
    held = held.groupBy("width", "shingle").agg(F.collect_list(F.struct("item_id", "d")).alias("at"))  # a bounded table's own rows
    held = stored(held, "held")

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text IS NOT NULL AND text <> ''")
    coded = lambda df: df.withColumn("codes", word_codes(F.col("text"))).drop("text")
    met = None
    for width in widths:
        every = coded(rows).withColumn("n", F.size("codes") - (width - 1)).select("doc", "text_hash", "n", F.posexplode(F.expr(_shingles("codes", width))).alias("pos", "shingle"))
        here = every.join(_small(held.where(F.col("width") == width).select("shingle", "at"), total), "shingle")
        met = here if met is None else met.unionByName(here)
    if met is None:
        return rows.select(F.col("doc").alias("doc_id"), "text_hash", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("first_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")).where("false")
    # Where a document has an item's shingle, of n shingles; a repeated document has it there once.
    met = met.select("doc", "text_hash", "n", "pos", "shingle", F.inline("at")).groupBy("doc", "text_hash", "item_id", "shingle").agg(
        F.first("n").alias("n"), F.first("d").alias("d"), F.array_sort(F.collect_set("pos")).alias("places"))
    met = stored(met, "met")

    # Pairs whose shared shingles cover the least part of the item that the similarity needs.
    size = items.select("item_id", "width", F.size("shingles").alias("size"))
    covered = met.groupBy("doc", "text_hash", "item_id").agg(F.sum(F.least("d", F.size("places"))).alias("count"))
    pairs = covered.join(_small(size, total), "item_id").where(F.col("count") >= F.ceil(F.col("size") * F.lit(similarity) - 1e-9))
    pairs = stored(pairs.select("doc", "text_hash", "item_id", "width", "size"), "pairs")

    # The starts of windows that an occurrence counts in, as the change at either end.
    keys = ["doc", "text_hash", "item_id", "width", "size", "n"]
    ends = F.expr("transform(places, (p, k) -> struct(greatest(p - size + 1, IF(k < d, p - size + 1, get(places, k - d) + 1)) AS low, p + 1 AS high))")
    counted = met.join(pairs, ["doc", "text_hash", "item_id"]).select(*keys, F.explode(ends).alias("s"))
    steps = counted.select(*keys, F.explode(F.array(F.struct(F.col("s.low").alias("at"), F.lit(1).alias("step")), F.struct(F.col("s.high").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = steps.select(*keys, "e.*").groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    along = Window.partitionBy(*keys).orderBy("at")
    runs = steps.select(*keys, "at", F.sum("step").over(along).alias("both"), (F.lead("at").over(along) - 1).alias("last")).where("both > 0")
    window = runs.where(F.col("both") >= F.ceil(F.col("size") * F.lit(similarity) - 1e-9)).select(*keys, "both", F.explode(F.array_distinct(F.array("at", "last", F.least(F.greatest("at", F.lit(0)), "last")))).alias("start"))

    have = F.least(F.col("start") + F.col("size"), "n") - F.greatest("start", F.lit(0))
    likeness = F.col("both") / (have + F.col("size") - F.col("both"))
    whole = (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n"))
    best = window.select(*keys, "start", likeness.alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)
    best = best.groupBy(*keys).agg(F.max(F.struct(whole.alias("whole"), "similarity", (-F.col("start")).alias("back"))).alias("top"))
    first = F.greatest(-F.col("top.back"), F.lit(0))
    return best.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text_hash", "item_id", first.alias("first_word"),
        (F.col("size") + F.col("width") - 1).alias("n_words"), F.col("top.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark item."""
    found = lambda: leaks(docs, benchmark).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    bad = settled(docs.sparkSession, found, "leaks")
    # Columns are named through their frames: docs may have a _doc of its own.
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == bad["_doc"]) & (F.xxhash64(docs["text"]) == bad["_hash"])
    return docs.join(bad, same, "left_anti")


@query("op4_decontamination")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_hash")
