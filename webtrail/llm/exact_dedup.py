"""Exact deduplication as a stream with keyed state.

Files of documents arrive as a stream. Its state, in RocksDB on disk and without expiry, holds
for each digest of a normalised text the smallest identifier seen so far, where that row's
content lies (file and row in it) and how many rows had the digest. Digests are combined before
the shuffle, so a group of copies costs one row per task. More files may arrive later: the same
state folder goes on where it stood.

Rows whose digest others have too are hits: their whole texts are compared with the text at the
owner's place. Only such rows carry their text into a shuffle; a bitmap of fixed width says of
nearly all other places that they are no hit. Rows that share a digest but not the text, should
there be any, are grouped by their texts.

Texts are equal when they are identical after each run of white space has become one space.

Defined cases: a null text counts as empty, and empty texts are equal. Of equal texts the row with
the smallest doc_id stays; null ids come last, of rows that repeat an id the first by file and
place stays, and `keep_id` is null where all ids of a group are. Very long texts are compared
whole. Other columns are kept out of the result. A folder without rows gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm.common import query, settled, stored, work_path

WHITE = "\t\n\x0b\x0c\r"
BATCH_BYTES = 256 << 30  # files that one micro-batch takes up
BITMAP_BITS = 1 << 26
SEGMENT_BITS = 1 << 15  # of one row of the bitmap
_PREFIX = "spark.sql.streaming.stateStore."
STATE = {
    f"{_PREFIX}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_PREFIX}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_PREFIX}rocksdb.boundedMemoryUsage": "true",
    f"{_PREFIX}rocksdb.maxMemoryUsageMB": "256",
    f"{_PREFIX}rocksdb.allowFAllocate": "false",  # many small stores need no space ahead
}
Key = Callable[[Column], Column]


@dataclass(frozen=True)
class Source:
    """Parquet files of documents: a folder, or one file."""

    spark: SparkSession
    path: str
    key: Key = F.unhex  # of the text's SHA-256: what the state is keyed by

    def _rows(self, docs: DataFrame) -> DataFrame:
        """doc_id, text, path, row. The metadata column is named through the frame, so a column of
        that name in the files is no obstacle."""
        place = docs.metadataColumn("_metadata")
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), place["file_path"].alias("path"), place["row_index"].alias("row"))

    def batch(self) -> DataFrame:
        return self._rows(self.spark.read.parquet(self.path))

    def stream(self, batch_bytes: int) -> DataFrame:
        path = self.path.rstrip("/")
        path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, which may also name a single file
        files = self.spark.readStream.schema(self.spark.read.parquet(self.path).schema).option("maxBytesPerTrigger", batch_bytes)
        return self._rows(files.parquet(path))


def normalised(text: Column) -> Column:
    """The text with one space for each run of white space. Most texts have single characters
    there, which need no regular expression."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, "  +", " ")).otherwise(text)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest(source: Source, state: str, batch_bytes: int = BATCH_BYTES) -> None:
    """Takes the files that the state has not seen into it. A run that was broken off goes on
    with its unfinished batch."""
    rows = source.stream(batch_bytes).withColumn("digest", source.key(F.sha2(normalised(F.col("text")), 256)))
    owner = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "path", "row")
    groups = rows.groupBy("digest").agg(F.min(owner).alias("owner"), F.count("*").alias("held"))
    with _settings(source.spark, STATE):  # a query keeps the settings that it started with
        run = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()


def owners(spark: SparkSession, state: str) -> DataFrame:
    """digest, keep_id, keep_path, keep_row, held: the state's rows."""
    with _settings(spark, STATE):
        rows = spark.read.format("statestore").load(state)
        # In the order of the aggregates; their names are those of Spark's buffers.
        owner, held = (F.col("value")[f.name] for f in rows.schema["value"].dataType)
        rows = rows.select(
            "key.digest", owner["doc_id"].alias("keep_id"), owner["path"].alias("keep_path"), owner["row"].alias("keep_row"), held.alias("held"))
        return stored(rows, "owners")


def _maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose path and row may be among the wanted ones. The bitmap has BITMAP_BITS bits (8 MB)
    whatever the number of places; where it is full it lets all rows through."""
    bit = F.pmod(F.xxhash64("path", "row"), F.lit(BITMAP_BITS))
    segment = F.shiftright(bit, 15)
    place = F.pmod(bit, F.lit(SEGMENT_BITS))
    bits = wanted.select(segment.alias("_segment"), place.alias("_place"))
    bits = bits.groupBy("_segment").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_place") + 1)).alias("_bits"))
    marked = rows.withColumn("_segment", segment).join(F.broadcast(bits), "_segment")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte, F.pmod(place, F.lit(8))) == 1).select(rows.columns)


def resolved(source: Source, held: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of the source, all of which the
    state has seen."""
    rows = stored(source.batch().select("doc_id", "path", "row", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")), "digests")
    rows = rows.withColumn("digest", source.key(F.col("text_sha256")))
    stays = (F.col("path") == F.col("keep_path")) & (F.col("row") == F.col("keep_row"))
    rows = stored(rows.join(held, "digest").withColumn("kept", stays).drop("keep_path", "keep_row"), "told")

    hits = rows.where("held > 1")
    texts = _maybe(source.batch(), hits.select("path", "row")).select("path", "row", normalised(F.col("text")).alias("text"))
    texts = hits.join(texts, ["path", "row"])
    first = texts.where("kept").select("digest", F.col("text").alias("first"))
    other = texts.where("NOT kept").join(first, "digest").where(F.col("text") != F.col("first"))
    other = stored(other.select("digest", "path", "row", "doc_id", "text", "text_sha256"), "same-digest")

    lost = other.groupBy("digest").agg(F.count("*").alias("lost"))
    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    equal = rows.join(other.select("path", "row"), ["path", "row"], "left_anti").join(lost, "digest", "left")
    equal = equal.withColumn("group_size", F.col("held") - F.coalesce("lost", F.lit(0))).select(*result)

    owner = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "path", "row"))
    apart = other.groupBy("digest", "text").agg(owner.alias("owner"), F.count("*").alias("group_size"))
    mine = (F.col("path") == F.col("owner.path")) & (F.col("row") == F.col("owner.row"))
    apart = other.join(apart, ["digest", "text"]).withColumn("kept", mine).withColumn("keep_id", F.col("owner.doc_id"))
    return equal.unionByName(apart.select(*result))


def deduplicate(source: Source, state: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of the source. With a state folder of an earlier run only new files go
    through the stream; all rows are reported."""
    spark = source.spark
    state = state or work_path(spark, "state")
    ingest(source, state, batch_bytes)
    return settled(spark, lambda: resolved(source, owners(spark, state)), "deduplicated")


CHECK = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(n) AS text_sha256
FROM t WINDOW same AS (PARTITION BY n)
"""


@query("op13_exact_dedup", CHECK)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicate(Source(spark, f"{sf}/documents.parquet"))
