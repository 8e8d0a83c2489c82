"""Rules over the files of a web root.

Files arrive as path, root, length, content. Bytes are read as Latin-1, so a pattern
sees exactly one character per byte. A file that no rule can hit is dropped by one test
per rule on the whole text; only the few that remain are cut into lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import predicates as is_, uris
from webtrail.functions.text import any_of, computed_once, fingerprint, truncate

_STRUCTURAL = {rule_id: severity for rule_id, severity, _ in fixed.STRUCTURAL_RULES}


def typed(files: DataFrame) -> DataFrame:
    """Files with name, site path and the type that decides which rules apply. Content
    above the limit is not looked at (and not kept)."""
    base = F.lower(uris.basename(F.col("path")))
    return files.select(
        "path", "root", "length",
        F.when(F.col("length") <= fixed.MAX_CONTENT_BYTES, F.col("content")).alias("content"),
        base.alias("base"), uris.site_path(F.col("path"), F.col("root")).alias("site"),
        is_.is_php_name(base).alias("is_php"), is_.is_image_name(base).alias("is_image"),
        (base == ".htaccess").alias("is_htaccess"), is_.double_extension(base).alias("double_ext"))


def latin(files: DataFrame) -> DataFrame:
    """Typed files with their text instead of their bytes, decoded once."""
    kept = [c for c in files.columns if c not in ("content", "root")]
    return computed_once(files.select(*kept, F.decode("content", "ISO-8859-1").alias("text")))


def _plain_php() -> Column:
    """PHP files the content rules are for, with bytes to look at."""
    return F.col("is_php") & ~F.col("is_image") & ~F.col("is_htaccess") & F.col("content").isNotNull()


def readable(line: Column) -> Column:
    """A Latin-1 line as the UTF-8 text it was, invalid bytes replaced."""
    return F.make_valid_utf8(F.encode(line, "ISO-8859-1").cast("string"))


def _finding(rule_id: str, evidence: Column) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(_STRUCTURAL[rule_id]).alias("severity"),
        F.lit(fixed.STRUCTURAL_TEXT[rule_id]).alias("rule"), F.lit(None).cast("long").alias("line"),
        evidence.alias("evidence"))


def structural_findings(files: DataFrame) -> DataFrame:
    """Findings about a file's place, name or readability. A content of NULL below the
    size limit means the bytes could not be read."""
    t = latin(typed(files))
    upload = is_.in_upload_directory(F.col("site"))
    too_large = F.col("length") > fixed.MAX_CONTENT_BYTES
    unread = F.col("text").isNull()
    image_hit = F.lower("text").contains("<?php") | is_.short_tag_is_source(F.col("text"))
    dropped = (F.col("is_php") & ~F.col("is_image") & ~F.col("is_htaccess") & upload & ~unread
               & ~is_.cms_guard(F.col("text")) & is_.executable_surface(F.col("text")))
    found = F.array_compact(F.array(
        F.when(F.col("double_ext"), _finding("webshell.double_ext", F.col("base"))),
        F.when(F.col("is_php") & upload & too_large, _finding("webshell.too_large", F.col("base"))),
        F.when(F.col("is_php") & upload & ~too_large & unread, _finding("webshell.unreadable", F.col("base"))),
        F.when(F.col("is_image") & ~unread & image_hit, _finding("webshell.php_in_image", F.concat(
            F.lit("'<?php' tag found in "), is_.extension(F.col("base")), F.lit(" file")))),
        F.when(dropped, _finding("webshell.upload_php", F.col("base"))),
    ))
    return t.select("path", F.inline(found))


def inert_files(files: DataFrame) -> DataFrame:
    """Unguarded PHP in an upload directory that can execute nothing."""
    t = latin(typed(files).filter(_plain_php()))
    inert = (is_.in_upload_directory(F.col("site")) & ~is_.cms_guard(F.col("text"))
             & ~is_.executable_surface(F.col("text")))
    return t.filter(inert).select("path", _inert_reason())


def _inert_reason() -> Column:
    return F.concat(
        F.lit("no executable surface ("), F.col("length").cast("string"), F.lit(" bytes"),
        F.when(F.col("length") <= fixed.GUARD_BYTES, ", likely a directory stub)").otherwise(")")).alias("reason")


def skipped_files(files: DataFrame) -> DataFrame:
    """What was not examined, with the reason: not examined is not clean."""
    t = typed(files).filter(F.col("is_php") | F.col("is_image") | F.col("is_htaccess"))
    return t.filter(F.col("content").isNull()).select(
        F.lit("webshell").alias("source"), "path",
        F.when(F.col("length") > fixed.MAX_CONTENT_BYTES, F.concat(
            F.lit("too large for content scan ("), F.col("length").cast("string"), F.lit(" bytes)")))
        .otherwise("read error").alias("reason"))


def line_findings(texts: DataFrame, rules) -> DataFrame:
    """One finding per (rule, line). ``texts``: path, text; ``rules``: (id, severity,
    name, pattern) with patterns that stay within a line."""
    candidates = texts.filter(any_of([F.col("text").rlike(p) for _, _, _, p in rules]))
    lines = candidates.select("path", F.posexplode(F.split("text", "\n")).alias("n", "content_line"))
    hits = F.array_compact(F.array(*[
        F.when(F.col("content_line").rlike(pattern), F.struct(
            F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(name).alias("rule")))
        for rule_id, severity, name, pattern in rules]))
    return lines.select("path", "n", "content_line", F.explode(hits).alias("h")).select(
        "path", "h.rule_id", "h.severity", "h.rule", (F.col("n") + 1).cast("long").alias("line"),
        truncate(readable(F.col("content_line")), 160).alias("evidence"))


# --- large files, by byte ranges --------------------------------------------------


def _range_texts(ranges: DataFrame) -> DataFrame:
    """Ranges (`sources.files.ranges`) with the type of their file and their text, decoded once.
    early: line breaks before the range's own bytes; late: those before their end; limit: how much
    of the line that stands there belongs to the range."""
    base = F.lower(uris.basename(F.col("path")))
    rows = computed_once(ranges.select(
        "path", "length", "range_no", "offset", "before", "own", base.alias("base"), uris.site_path(F.col("path"), F.col("root")).alias("site"),
        F.decode("content", "ISO-8859-1").alias("text")))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    upto = F.left("text", (F.col("before") + F.col("own")).cast("int"))
    return computed_once(rows.select(
        "*", is_.is_php_name(F.col("base")).alias("is_php"), is_.is_image_name(F.col("base")).alias("is_image"), (F.col("base") == ".htaccess").alias("is_htaccess"),
        breaks(F.left("text", F.col("before").cast("int"))).alias("early"), breaks(upto).alias("late"), F.length(F.substring_index(upto, "\n", -1)).alias("limit")))


def _inner(pattern: str) -> str:
    """The pattern where bytes stand before it: what begins earlier in a range's text is a match of
    the range before, and its own beginning may be cut off."""
    return r"(?<=(?s:.{%d}))(?:%s)" % (fixed.RANGE_GUARD, pattern)


def _met(pattern: str) -> Column:
    # The plain pattern goes ahead: it looks at what stands before a match nowhere.
    return F.col("text").rlike(pattern) & ((F.col("range_no") == 0) | F.col("text").rlike(_inner(pattern)))


def range_marks(ranges: DataFrame) -> DataFrame:
    """One narrow row per range: its line breaks, the beginning of the line that runs over its end
    (null where that began in an earlier range), and what rules of whole files ask."""
    t = _range_texts(ranges)
    text, inside = F.col("text"), F.col("before") + F.col("own")
    begun = F.substr("text", (inside - F.col("limit") + 1).cast("int"), F.lit(1 << 16))
    head = F.left(F.substring_index(F.regexp_replace(begun, r"^[ \t\r\x0b\x0c]+", ""), "\n", 1), F.lit(400))
    # A short tag whose readable text is cut off is one of the next range, unless the file ends here.
    ends = F.col("offset") + F.col("own") >= F.col("length")
    seen = F.when(ends, text).otherwise(F.regexp_replace("text", r"(?s)<\?=(?!.{48})", ""))
    return t.select(
        "path", "range_no", "length", "base", "site", "is_php", "is_image", "is_htaccess", (F.col("late") - F.col("early")).cast("long").alias("breaks"),
        F.when((F.col("late") > 0) | (F.col("range_no") == 0), head).alias("head"), F.contains("text", F.lit("<?")).alias("open_tag"),
        ((F.col("range_no") == 0) & is_.cms_guard(text)).alias("guarded"), _met(fixed.EXEC_SURFACE).alias("surface"),
        (F.contains(F.lower("text"), F.lit("<?php")) | is_.short_tag_is_source(seen)).alias("image_hit"))


def _marked(pattern: str, mark: str) -> Column:
    """The range's text with a mark before each match."""
    plain = F.translate("text", mark, " ")
    return F.when(F.col("range_no") == 0, F.regexp_replace(plain, f"({pattern})", mark + "$1")).otherwise(F.regexp_replace(plain, f"({_inner(pattern)})", mark + "$1"))


def _range_lines(texts: DataFrame, rules) -> DataFrame:
    """path, range_no, n (line breaks of the range before the line), continues (the line began in an
    earlier range), rule_id, severity, rule, content_line: lines on which a match begins among the
    range's own bytes. ``rules``: (condition on the range, id, severity, name, pattern, spanning); a
    match of a spanning rule may run over lines. All rules stand in one pass over the ranges."""
    mark = "\u0001"
    found = []
    for condition, rule_id, severity, name, pattern, spanning in rules:
        row = F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(name).alias("rule"), F.lit(pattern).alias("whole"),
                       F.lit(_inner(pattern)).alias("inner"), F.lit(spanning).alias("spanning"), F.split(_marked(pattern, mark) if spanning else F.col("text"), "\n").alias("lines"))
        found.append(F.when(condition & _met(pattern), row))
    rows = texts.select("path", "range_no", "early", "late", "limit", F.explode(F.array_compact(F.array(*found))).alias("r"))
    rows = rows.select("path", "range_no", "early", "late", "limit", "r.rule_id", "r.severity", "r.rule", "r.whole", "r.inner", "r.spanning", F.posexplode("r.lines").alias("i", "line"))
    rows = rows.filter(F.col("i").between(F.col("early"), F.col("late")))
    continues = (F.col("i") == 0) & (F.col("range_no") > 0)
    at = F.when(F.col("spanning"), F.instr("line", mark)).when(continues, F.regexp_instr("line", F.col("inner"))).otherwise(F.regexp_instr("line", F.col("whole")))
    rows = computed_once(rows.select("path", "range_no", "early", "late", "limit", "i", "line", "spanning", "rule_id", "severity", "rule", continues.alias("continues"), at.alias("at")))
    hit = (F.col("at") > 0) & ((F.col("i") < F.col("late")) | (F.col("at") <= F.col("limit")))
    return rows.filter(hit).select(
        "path", "range_no", (F.col("i") - F.col("early")).cast("long").alias("n"), "continues", "rule_id", "severity", "rule",
        F.left(F.when(F.col("spanning"), F.translate("line", mark, "")).otherwise(F.col("line")), F.lit(1 << 16)).alias("content_line"))


def _by_file(marks: DataFrame) -> DataFrame:
    flags = [F.bool_or(c).alias(c) for c in ("open_tag", "guarded", "surface", "image_hit")]
    return marks.groupBy("path", "length", "base", "site", "is_php", "is_image", "is_htaccess").agg(*flags)


def _upload_php(guarded: Column, surface: Column) -> Column:
    return F.col("is_php") & ~F.col("is_image") & ~F.col("is_htaccess") & is_.in_upload_directory(F.col("site")) & ~guarded & surface


def large_findings(ranges: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """All content rules over files of any size, by byte ranges that overlap: line rules, the
    negation over the whole file, handlers, images and dropped PHP. Line numbers are a prefix sum of
    the ranges' line breaks. A match on the border of two ranges is found once. ``marks``: the rows
    of `range_marks`, if they are stored."""
    texts, marks = _range_texts(ranges), range_marks(ranges) if marks is None else marks
    php, conf = F.col("is_php") & ~F.col("is_image") & ~F.col("is_htaccess"), F.col("is_htaccess")
    no_php, (prepend, handler) = fixed.NO_PHP_RULE, (fixed.HTACCESS_PREPEND, fixed.HTACCESS_HANDLER)
    hits = _range_lines(texts, [
        *((php, *rule, False) for rule in fixed.CONTENT_RULES), (php & ~F.contains("text", F.lit("<?")), *no_php, r"(?i)<html", False),
        (conf, *prepend, fixed.HTACCESS_PREPEND_PATTERN, False), *((conf, *handler, p, True) for p in fixed.HTACCESS_HANDLER_PATTERNS)])
    opened = marks.filter("open_tag").select("path", F.lit(no_php[0]).alias("rule_id")).distinct()
    hits = hits.join(opened, ["path", "rule_id"], "left_anti")
    before = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    placed = marks.select("path", "range_no", F.coalesce(F.sum("breaks").over(before), F.lit(0)).alias("base_line"), F.last("head", ignorenulls=True).over(before).alias("begun"))
    lines = hits.join(placed, ["path", "range_no"])
    shown = truncate(readable(F.when(F.col("continues"), F.coalesce("begun", "content_line")).otherwise(F.col("content_line"))), 160)
    lines = lines.select("path", "rule_id", "severity", "rule", (F.col("base_line") + F.col("n") + 1).alias("line"), shown.alias("evidence"))
    lines = lines.groupBy("path", "rule_id", "severity", "rule", "line").agg(F.max("evidence").alias("evidence"))
    image = _finding("webshell.php_in_image", F.concat(F.lit("'<?php' tag found in "), is_.extension(F.col("base")), F.lit(" file")))
    files = _by_file(marks).select("path", F.inline(F.array_compact(F.array(
        F.when(F.col("is_image") & F.col("image_hit"), image),
        F.when(_upload_php(F.col("guarded"), F.col("surface")), _finding("webshell.upload_php", F.col("base")))))))
    return lines.unionByName(files.select(lines.columns))


def large_inert(marks: DataFrame) -> DataFrame:
    """`inert_files` for files of any size, from `range_marks`."""
    inert = _upload_php(F.col("guarded"), ~F.col("surface"))
    return _by_file(marks).filter(inert).select("path", _inert_reason())


def large_own_findings(ranges: DataFrame, rules, limit: int = fixed.OWN_RULE_MATCHES) -> DataFrame:
    """`own_rule_findings` for files of any size. Matches are counted in the range that they begin
    in."""
    t = _range_texts(ranges)
    mark, found = "\u0001", []
    for rule_id, name, severity, pattern in rules:
        found.append(F.when(_met(pattern), F.struct(
            F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule"), F.lit(fixed.MEDIUM if severity is None else severity).alias("severity"),
            F.split(_marked(pattern, mark), mark).alias("parts"))))
    rows = t.select("path", "offset", "before", "own", F.explode(F.array_compact(F.array(*found))).alias("r"))
    sizes = F.transform(F.slice("r.parts", F.lit(1), F.size("r.parts") - 1), lambda p: F.length(p).cast("long"))
    rows = rows.select("path", "offset", "before", "own", "r.rule_id", "r.rule", "r.severity", sizes.alias("sizes"))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"), F.array().cast("array<long>").alias("at"))

    def add(seen: Column, size: Column) -> Column:
        """One more match: it begins where the lengths before it end. Only the first ones are kept."""
        begin = seen["end"] + size
        own = (begin >= F.col("before")) & (begin < F.col("before") + F.col("own"))
        kept = F.when(own & (F.size(seen["at"]) < limit), F.concat(seen["at"], F.array(begin - F.col("before") + F.col("offset")))).otherwise(seen["at"])
        return F.struct(begin.alias("end"), (seen["n"] + own.cast("long")).alias("n"), kept.alias("at"))

    rows = computed_once(rows.select("path", "rule_id", "rule", "severity", F.aggregate("sizes", none, add).alias("m"))).filter("m.n > 0")
    each = rows.groupBy("path", "rule_id", "severity", "rule").agg(
        F.sum("m.n").cast("long").alias("matches"), F.slice(F.array_sort(F.flatten(F.collect_list("m.at"))), 1, limit).alias("at"))
    return each.select("path", "rule_id", "severity", "rule", "matches", F.array_join(F.transform("at", lambda o: F.concat(F.col("rule_id"), F.lit("@"), o.cast("string"))), ", ").alias("evidence"))


def content_findings(files: DataFrame) -> DataFrame:
    """The content rules, on PHP files only."""
    texts = latin(typed(files).filter(_plain_php())).select("path", "text")
    rule_id, severity, name = fixed.NO_PHP_RULE
    page = texts.filter(~F.col("text").contains("<?"))  # whole-file negation, then the line with the tag
    return line_findings(texts, fixed.CONTENT_RULES).unionByName(
        line_findings(page, [(rule_id, severity, name, r"(?i)<html")]))


def offset_findings(texts: DataFrame, rule, patterns) -> DataFrame:
    """A rule whose match may span lines: one finding per line a match begins on.

    Every match is replaced by a mark, so the lines are those that hold a mark."""
    rule_id, severity, name = rule
    mark = "\u0001"
    marked = [F.regexp_replace(F.translate("text", mark, " "), "(" + p + ")", mark + "$1") for p in patterns]
    rows = texts.filter(any_of([F.col("text").rlike(p) for p in patterns])).select("path", F.explode(F.array(*marked)).alias("m"))
    lines = rows.select("path", F.posexplode(F.split("m", "\n")).alias("n", "content_line")).filter(F.col("content_line").contains(mark))
    return lines.groupBy("path", "n").agg(F.min(F.translate("content_line", mark, "")).alias("content_line")).select(
        "path", F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(name).alias("rule"),
        (F.col("n") + 1).cast("long").alias("line"), truncate(readable(F.col("content_line")), 160).alias("evidence"))


def htaccess_findings(files: DataFrame) -> DataFrame:
    texts = latin(typed(files).filter(F.col("is_htaccess") & F.col("content").isNotNull())).select("path", "text")
    rule_id, severity, name = fixed.HTACCESS_PREPEND
    return offset_findings(texts, fixed.HTACCESS_HANDLER, fixed.HTACCESS_HANDLER_PATTERNS).unionByName(
        line_findings(texts, [(rule_id, severity, name, fixed.HTACCESS_PREPEND_PATTERN)]))


def own_rule_findings(files: DataFrame, rules, limit: int = fixed.OWN_RULE_MATCHES) -> DataFrame:
    """The analyst's regular expressions over every file: the evidence is where a match
    begins, never what matched. ``rules``: (id, name, severity or None, pattern).

    The report lists the first matches of a file; ``matches`` counts them all."""
    texts = latin(typed(files).filter(F.col("content").isNotNull())).select("path", "text")
    mark = "\u0001"
    per_rule = F.array(*[F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule"),
        F.lit(fixed.MEDIUM if severity is None else severity).alias("severity"),
        F.when(F.col("text").rlike(pattern), F.split(F.regexp_replace(
            F.translate("text", mark, " "), "(" + pattern + ")", mark + "$1"), mark)).alias("parts"))
        for rule_id, name, severity, pattern in rules])
    hits = texts.select("path", F.explode(F.filter(per_rule, lambda r: r["parts"].isNotNull())).alias("r"))
    offsets = F.slice(F.transform(
        F.sequence(F.lit(1), F.size("r.parts") - 1),
        lambda i: F.length(F.array_join(F.slice(F.col("r.parts"), F.lit(1), i), ""))), 1, limit)
    return hits.select(
        "path", "r.rule_id", "r.severity", "r.rule", (F.size("r.parts") - 1).cast("long").alias("matches"),
        F.array_join(F.transform(offsets, lambda o: F.concat(F.col("r.rule_id"), F.lit("@"), o.cast("string"))), ", ").alias("evidence"))


def findings(files: DataFrame, disabled: list[str] | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """All built-in file rules as findings on the file. `ranges`: large files by byte ranges."""
    rows = structural_findings(files).unionByName(content_findings(files)).unionByName(htaccess_findings(files))
    if ranges is not None:
        rows = rows.unionByName(large_findings(ranges))
    rows = rows.filter(is_.rule_enabled(F.col("rule_id"), disabled or []))
    return rows.select(
        F.lit("webshell").alias("source"), "severity", "rule", "rule_id", F.lit("file").alias("artifact_kind"),
        F.col("path").alias("artifact"), "line", "evidence", F.lit("webshell").alias("engine")).withColumn(
        "fingerprint", fingerprint(F.col("source"), F.col("rule"), F.col("artifact"), F.col("line")))


def digests(files: DataFrame, flagged: DataFrame) -> DataFrame:
    """SHA-256 of flagged files only: the semi join stands before the hash."""
    wanted = flagged.select(F.col("artifact").alias("path")).distinct()
    known = files.join(wanted, "path", "left_semi").select(F.col("path").alias("artifact"), _digest_of(files).alias("sha256"))
    return known.filter(F.col("sha256").isNotNull())


def _digest_of(files: DataFrame) -> Column:
    """The digest that was made where the file was read, else that of its content."""
    return F.coalesce(F.col("digest"), F.sha2("content", 256)) if "digest" in files.columns else F.sha2("content", 256)


# --- comparison with a reference tree ------------------------------------------


def range_digests(ranges: DataFrame) -> DataFrame:
    """(path, digest) of large files: SHA-256 over the digests of their ranges in order, so that
    many tasks take part in one file. Files compare equal by it if they were cut alike; it is not
    the file's own SHA-256. A file of which a range could not be read has none."""
    own = F.sha2(F.substring(F.col("content"), F.col("before").cast("int") + 1, F.col("own").cast("int")), 256)
    each = ranges.select("path", "length", "range_no", "own", own.alias("d"))
    files = each.groupBy("path", "length").agg(F.array_sort(F.collect_list(F.struct("range_no", "d"))).alias("parts"), F.sum("own").alias("read"))
    whole = F.array_join(F.transform("parts", lambda p: p["d"]), "")
    return files.filter(F.col("read") == F.col("length")).select("path", F.concat(F.lit("ranges:"), F.sha2(whole, 256)).alias("digest"))


def tree(files: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """rel, size and digest of one tree. The digest is computed where the bytes are
    read, so content never crosses a shuffle; a file that was not read has none. `ranges`: large
    files by byte ranges, which get their digests from these."""
    root = F.rtrim(uris.forward_slashes(F.col("root")), F.lit("/"))
    rows = files.select("path", F.substr(uris.forward_slashes(F.col("path")), F.length(root) + 2).alias("rel"), F.col("length").alias("size"),
                        _digest_of(files).alias("digest"))
    if ranges is not None:
        large = range_digests(ranges).select(F.col("path"), F.col("digest").alias("large"))
        rows = rows.join(large, "path", "left").withColumn("digest", F.coalesce("large", "digest"))
    return rows.select("rel", "size", "digest")


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both trees by relative path: extra, missing, modified, identical, or, where sizes are
    equal and a side was not read, too_big (above the size for digests) or unread. Every path
    is kept; the size decides before the digest does."""
    l = left.select("rel", F.col("size").alias("l_size"), F.col("digest").alias("l_digest"))
    r = right.select("rel", F.col("size").alias("r_size"), F.col("digest").alias("r_digest"))
    status = (
        F.when(F.col("r_size").isNull(), "extra").when(F.col("l_size").isNull(), "missing")
        .when(F.col("l_size") != F.col("r_size"), "modified")
        .when(F.col("l_digest") == F.col("r_digest"), "identical")
        .when(F.col("l_digest").isNotNull() & F.col("r_digest").isNotNull(), "modified")
        .when(F.col("l_size") > fixed.HASH_CAP_BYTES, "too_big").otherwise("unread")
    )
    return l.join(r, "rel", "full_outer").select(
        "rel", status.alias("status"), F.coalesce("l_size", F.lit(0)).cast("long").alias("size"),
        F.coalesce("r_size", F.lit(0)).cast("long").alias("ref_size"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def diff_view(diff: DataFrame, hide=(), search: str = "") -> DataFrame:
    out = diff.filter(F.col("status") != "identical")
    if hide:
        out = out.filter(~F.col("status").isin(*hide))
    return out.filter(F.lower("rel").contains(search.strip().lower())) if search.strip() else out


def diff_order() -> list[Column]:
    rank = F.when(F.col("status") == "modified", 0).when(F.col("status") == "extra", 1).when(
        F.col("status") == "too_big", 2).otherwise(3)
    return [rank, F.asc("rel")]


def missing_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """The two path-set differences alone, without reading a byte."""
    extra = left.select("rel").join(right.select("rel"), "rel", "left_anti").withColumn("status", F.lit("extra"))
    return extra.unionByName(right.select("rel").join(left.select("rel"), "rel", "left_anti").withColumn(
        "status", F.lit("missing")))


def evidence_inventory(listing: DataFrame, roots: list[str]) -> DataFrame:
    """Files and bytes per registered evidence root, without a time box."""
    root = F.lit(None).cast("string")
    for path in sorted(roots, key=len):
        base = path.rstrip("/")
        root = F.when((F.col("path") == base) | F.col("path").startswith(base + "/"), base).otherwise(root)
    return listing.withColumn("root", root).filter("root is not null").groupBy("root").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).filter("_n = 1").drop("_n")
