"""Files as tables: listings, heads, whole contents.

A listing never opens a file. A head opens each file for its first bytes only, on the
executors, so sorting out binaries, error logs and dumps costs no second read of the
evidence. Paths may be anything both Spark and Arrow can open (local, HDFS, S3).
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import hashlib
import io
import lzma
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed

_HEAD_SCHEMA = ("path string, length long, mtime long, head binary, first_line string, first_lines array<string>,"
                " compressed boolean, error string")
_OPENERS = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
CHUNK_BYTES = 4 * 1024 * 1024
_LINE_SCHEMA = "path string, block long, pos long, value string"


def listing(spark: SparkSession, targets: list[str]) -> DataFrame:
    """path, length, mtime of every file below the targets. Content is not read.

    Spark's scan passes over names that begin with a dot or an underscore. In evidence
    those are the ones to look at (.htaccess), so they are listed beside it."""
    seen = _scan(spark, targets).select(plain_path().alias("path"), "length", F.unix_seconds("modificationTime").alias("mtime"))
    return _without_links(seen, targets).unionByName(hidden(spark, targets))


def literal(target: str) -> str:
    """A target whose name the scan does not read as a pattern."""
    return re.sub(r"([\\[\]{}*?])", r"\\\1", target)


def _scan(spark: SparkSession, targets: list[str]) -> DataFrame:
    for target in targets:
        system, inner = _filesystem(target)
        if system.get_file_info(inner).type.name == "NotFound":
            raise FileNotFoundError(target)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([literal(t) for t in targets])


def _linked(path: str, bases: list[str]) -> bool:
    """Whether a local path leads over a symbolic link below its target."""
    base = next((b for b in bases if path.startswith(b + "/")), None)
    if base is None or "://" in path:
        return False
    parts = path[len(base) + 1:].split("/")
    return any(os.path.islink("/".join([base, *parts[:k + 1]])) for k in range(len(parts)))


def _without_links(files: DataFrame, targets: list[str]) -> DataFrame:
    """Files reached without a symbolic link: a link may lead out of the evidence or in a
    circle. Only local file systems have them; other paths pass untouched."""
    bases = [t.rstrip("/") for t in targets if "://" not in t]
    if not bases:
        return files

    def keep(frames):
        for frame in frames:
            yield frame[[not _linked(p, bases) for p in frame["path"]]]

    return files.mapInPandas(keep, files.schema)


def plain_path(column: str = "path"):
    """A path as people write it: without the scheme of the local file system."""
    return F.regexp_replace(F.col(column), r"^file:/+", "/")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _is_hidden(inner: str, base: str) -> bool:
    return any(part.startswith((".", "_")) for part in inner[len(base):].split("/"))


def _walk(frames):
    from pyarrow import fs

    for frame in frames:
        for folder, base in frame[["folder", "base"]].itertuples(index=False):
            system, inner = _filesystem(folder)
            prefix = folder[: len(folder) - len(inner)]
            infos = system.get_file_info(fs.FileSelector(inner, recursive=True))
            if prefix == "" or prefix.endswith("//"):
                base = base[len(prefix):]
            rows = [(prefix + i.path, i.size, int(i.mtime.timestamp()) if i.mtime else 0) for i in infos
                    if i.type == fs.FileType.File and _is_hidden(i.path, base) and not (prefix == "" and _linked(i.path, [base.rstrip("/")]))]
            yield pd.DataFrame(rows, columns=["path", "length", "mtime"]).astype({"length": "int64", "mtime": "int64"})


def hidden(spark: SparkSession, targets: list[str]) -> DataFrame:
    """Files with a name, or below a folder, that begins with a dot or an underscore.

    The driver lists the first level of each target only; every folder below it is walked
    by a task."""
    from pyarrow import fs

    folders, here = [], []
    for target in targets:
        system, inner = _filesystem(target)
        if system.get_file_info(inner).type != fs.FileType.Directory:
            continue
        prefix, base = target[: len(target) - len(inner)], target.rstrip("/")
        for info in system.get_file_info(fs.FileSelector(inner)):
            if info.type == fs.FileType.Directory:
                folders.append((prefix + info.path, base))
            elif _is_hidden(info.path, inner.rstrip("/")):
                here.append((prefix + info.path, info.size, int(info.mtime.timestamp()) if info.mtime else 0))
    schema = "path string, length long, mtime long"
    direct = spark.createDataFrame(here, schema)
    if not folders:
        return direct
    spread = spark.createDataFrame(folders, "folder string, base string").repartition(min(len(folders), 512))
    return direct.unionAll(spread.mapInPandas(_walk, schema))


def _read_whole(frames):
    for frame in frames:
        for path, length in frame[["path", "length"]].itertuples(index=False):
            try:
                system, inner = _filesystem(path)
                with system.open_input_stream(inner, compression=None) as stream:
                    data = stream.read()
            except OSError:
                data = None  # listed but not readable: a rule of its own says so
            yield pd.DataFrame({"path": [path], "length": [length], "content": [data]})


def contents(spark: SparkSession, targets: list[str], root: str, max_bytes: int = fixed.MAX_CONTENT_BYTES, large_digests: bool = True) -> DataFrame:
    """Files with their bytes up to a size. Larger ones have NULL content here, but a digest, unless
    that is not asked for; `ranges` reads them whole, by many tasks. A file that cannot be read has
    neither.

    The size filter is pushed into the scan of the small ones."""
    scan = _scan(spark, targets)
    names = _without_links(scan.select(plain_path().alias("path"), "length"), targets).unionByName(hidden(spark, targets).select("path", "length"))
    small = names.filter(F.col("length") <= max_bytes).mapInPandas(_read_whole, "path string, length long, content binary")
    large = names.filter(F.col("length") > max_bytes)
    none = F.lit(None).cast("string").alias("digest")
    large = large.mapInPandas(_digest, "path string, length long, digest string") if large_digests else large.select("path", "length", none)
    both = small.withColumn("digest", F.sha2("content", 256)).unionByName(large.withColumn("content", F.lit(None).cast("binary")))
    return both.select("path", F.lit(root).alias("root"), "length", "content", "digest")


def _digest(frames):
    for frame in frames:
        for path, length in frame[["path", "length"]].itertuples(index=False):
            seen: str | None = None
            try:
                system, inner = _filesystem(path)
                state = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as stream:
                    while data := stream.read(CHUNK_BYTES):
                        state.update(data)
                seen = state.hexdigest()
            except OSError:
                pass
            yield pd.DataFrame({"path": [path], "length": [length], "digest": pd.Series([seen], dtype=object)})


def _read_range(frames):
    for frame in frames:
        for path, root, length, number, offset, size in frame[["path", "root", "length", "range_no", "offset", "own"]].itertuples(index=False):
            try:
                system, inner = _filesystem(path)
                before = min(offset, fixed.RANGE_CONTEXT)
                with system.open_input_file(inner) as handle:
                    handle.seek(offset - before)
                    data = handle.read(before + size + fixed.RANGE_OVERLAP)
            except OSError:
                continue  # a finding says that the file could not be read
            yield pd.DataFrame({"path": [path], "root": [root], "length": [length], "range_no": [number], "offset": [offset], "before": [before], "own": [size], "content": [data]})


def ranges(files: DataFrame, max_bytes: int = fixed.MAX_CONTENT_BYTES, range_bytes: int = fixed.RANGE_BYTES) -> DataFrame:
    """path, root, length, range_no, offset, before, own, content: the files above a size as byte
    ranges that tasks seek to, however long a line is. content has ``before`` bytes in front of the
    range's ``own`` ones and the next RANGE_OVERLAP behind them."""
    rows = files.filter((F.col("length") > max_bytes) & F.col("content").isNull())
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    rows = rows.select("path", "root", "length", F.posexplode(starts).alias("range_no", "offset"))
    rows = rows.withColumn("range_no", F.col("range_no").cast("long")).withColumn("own", F.least(F.lit(range_bytes), F.col("length") - F.col("offset")))
    return rows.repartition("path", "range_no").mapInPandas(
        _read_range, "path string, root string, length long, range_no long, offset long, before long, own long, content binary")


def cut_ranges(files: DataFrame, range_bytes: int, overlap: int, context: int) -> DataFrame:
    """The same of files whose content is in a column."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    rows = files.filter(F.col("content").isNotNull()).select("path", "root", "length", "content", F.posexplode(starts).alias("range_no", "offset"))
    before, own = F.least("offset", F.lit(context)), F.least(F.lit(range_bytes), F.col("length") - F.col("offset"))
    part = F.substring(F.col("content"), (F.col("offset") - before + 1).cast("int"), (before + own + overlap).cast("int"))
    return rows.select("path", "root", "length", F.col("range_no").cast("long"), "offset", before.cast("long").alias("before"), own.cast("long").alias("own"), part.alias("content"))


def _open(path: str):
    filesystem, inner = _filesystem(path)
    raw = filesystem.open_input_stream(inner, compression=None)
    opener = next((o for ending, o in _OPENERS.items() if path.lower().endswith(ending)), None)
    return (opener(raw, "rb") if opener else raw), opener is not None


def _heads(frames):
    for frame in frames:
        rows = []
        for path, length, mtime in frame[["path", "length", "mtime"]].itertuples(index=False):
            head, first, lines, packed, error = b"", None, [], False, None
            try:
                stream, packed = _open(path)
                with stream:
                    head = stream.read(fixed.HEAD_BYTES)
                    data = head
                    # A first line is looked for beyond the head only while all is blank.
                    while data and not data.strip():
                        data = stream.read(fixed.HEAD_BYTES)
                    text = data.removeprefix(codecs.BOM_UTF8).decode("utf-8", "replace")
                    lines = text.split("\n")[: fixed.SNIFF_LINES]
                    first = next((line for line in text.split("\n") if line.strip()), None)
                    if first is not None and first == text.split("\n")[-1]:  # the line may go on
                        first += io.BytesIO(stream.read(1 << 16)).readline().decode("utf-8", "replace").rstrip("\n")
            except (OSError, EOFError, ValueError, lzma.LZMAError) as problem:
                error = f"read error: {problem}"[:200]
            rows.append((path, length, mtime, bytes(head), first, lines, packed, error))
        yield pd.DataFrame(rows, columns=["path", "length", "mtime", "head", "first_line", "first_lines", "compressed", "error"])


def heads(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """The first 8 KiB, the first non-empty line and the first few lines of each file."""
    rows = files.select("path", "length", "mtime")
    return (rows.repartition(tasks) if tasks else rows).mapInPandas(_heads, _HEAD_SCHEMA)


def binary(files_heads: DataFrame) -> DataFrame:
    """Files with a NUL in their head; a compressed file is never one."""
    text = F.decode("head", "ISO-8859-1")
    return files_heads.filter(~F.col("compressed") & (F.instr(text, "\0") > 0)).select("path")


def _expand(frames):
    for frame in frames:
        for path in frame["path"]:
            stream, _ = _open(path)
            with stream:
                reader = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="\n")
                batch, at = [], 0
                for line in reader:
                    batch.append(line.rstrip("\n").removesuffix("\r"))
                    if len(batch) == 20000:
                        yield pd.DataFrame({"path": path, "block": 0, "pos": range(at, at + len(batch)), "value": batch})
                        at, batch = at + len(batch), []
                if batch:
                    yield pd.DataFrame({"path": path, "block": 0, "pos": range(at, at + len(batch)), "value": batch})


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text lines: path, block (start of the split), pos (order), value.

    Plain, gzip and bzip2 files are read by Spark's own text scan, split where the format
    allows. Only ``.xz``, for which it has no codec, is expanded in Python, as a stream."""
    xz = [p for p in paths if p.lower().endswith(".xz")]
    plain = [p for p in paths if not p.lower().endswith(".xz")]
    parts = []
    if plain:
        # Names are literal, so what a glob would read as a pattern is escaped; the scan
        # reports them percent-encoded.
        text = spark.read.text([re.sub(r"([\\[\]{}*?])", r"\\\1", p) for p in plain])
        # Both kinds of line ends are the text scan's own business.
        encoded = F.col("_metadata.file_path")
        name = F.when(encoded.contains("%"), F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))).otherwise(encoded)
        local = F.when(name.startswith("file:///"), F.substr(name, F.lit(8))).when(
            name.startswith("file:/"), F.substr(name, F.lit(6))).otherwise(name)
        parts.append(text.select(
            local.alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"), F.make_valid_utf8("value").alias("value")))
    if xz:
        names = spark.createDataFrame([(p,) for p in xz], "path string").repartition(len(xz))
        parts.append(names.mapInPandas(_expand, _LINE_SCHEMA))
    if not parts:
        return spark.createDataFrame([], _LINE_SCHEMA)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
