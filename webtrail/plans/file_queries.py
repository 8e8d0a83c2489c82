"""Queries over web-root files, error logs, reference trees and CMS inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import indicators as ind, predicates as is_, uris
from webtrail.functions.text import computed_once, truncate
from webtrail.operators import cms, errorlog, rules, webroot
from webtrail.plans import bindings as b
from webtrail.plans.registry import query
from webtrail.sources import files as file_source


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_IS_PHP = "regexp_matches(base, '(?i)\\.(php\\d?|phtml|phar|inc)(\\.|$)')"
_UPLOAD = f"(regexp_matches(site, {lit(fixed.UPLOAD_SEGMENT)}) AND NOT regexp_matches(site, {lit(fixed.UPLOAD_EXCLUDED)}))"
_GUARD = f"regexp_matches(substr(text, 1, 4096), {lit(fixed.CMS_GUARD)})"
_SURFACE = f"regexp_matches(text, {lit(fixed.EXEC_SURFACE)})"
_IMAGE = "base LIKE '%.png'"
_CUT = "CASE WHEN length(t) <= 160 THEN t ELSE substr(t, 1, 160) || '…' END"

_RULES = ", ".join(f"({lit(i)}, {s}, {lit(n)}, {lit(p)})" for i, s, n, p in fixed.CONTENT_RULES)
_LINES = """flines AS (SELECT path, base, site, i AS line, l[i] AS content_line FROM (SELECT *, string_split(text, chr(10)) AS l FROM files) x,
 unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS g(i))"""
_TRIM = "trim(content_line, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_CONTENT = f"""content AS (SELECT path, id AS rule_id, severity, name AS rule, line, {_CUT.replace('t ', 't ')} AS evidence FROM (
 SELECT f.path, r.id, r.severity, r.name, f.line, {_TRIM} AS t FROM flines f
 JOIN (VALUES {_RULES}) r(id, severity, name, rx) ON regexp_matches(f.content_line, r.rx) WHERE {_IS_PHP} AND NOT {_IMAGE}
 UNION ALL SELECT path, 'webshell.no_php', 1, 'PHP file containing no PHP, only an HTML page', line, {_TRIM} FROM flines
  WHERE {_IS_PHP} AND path NOT IN (SELECT path FROM files WHERE contains(text, '<?')) AND content_line ILIKE '%<html%'))"""
_HTACCESS = f"""htaccess AS (SELECT path, rule_id, severity, rule, line, {_CUT} AS evidence FROM (
 SELECT path, 'webshell.htaccess_handler' AS rule_id, 0 AS severity, {lit(fixed.HTACCESS_HANDLER[2])} AS rule, line, {_TRIM} AS t FROM flines
  WHERE base = '.htaccess' AND regexp_matches(content_line, {lit(fixed.HTACCESS_HANDLER_PATTERNS[0])})
 UNION ALL SELECT path, 'webshell.htaccess_prepend', 0, {lit(fixed.HTACCESS_PREPEND[2])}, line, {_TRIM} FROM flines
  WHERE base = '.htaccess' AND regexp_matches(content_line, '(?i)auto_(prepend|append)_file')))"""
_STRUCT = f"""structural AS (SELECT path, 'webshell.double_ext' AS rule_id, 0 AS severity, {lit(fixed.STRUCTURAL_TEXT['webshell.double_ext'])} AS rule,
  CAST(NULL AS BIGINT) AS line, base AS evidence FROM files WHERE regexp_matches(base, {lit(fixed.DOUBLE_EXTENSION)})
 UNION ALL SELECT path, 'webshell.php_in_image', 0, 'PHP code hidden inside image file', NULL, '''<?php'' tag found in .png file' FROM files
  WHERE {_IMAGE} AND (contains(lower(text), '<?php') OR contains(text, '<?='))
 UNION ALL SELECT path, 'webshell.upload_php', 0, {lit(fixed.STRUCTURAL_TEXT['webshell.upload_php'])}, NULL, base FROM files
  WHERE {_IS_PHP} AND NOT {_IMAGE} AND {_UPLOAD} AND NOT {_GUARD} AND {_SURFACE})"""
_ALL = ",\n".join([b.FILES_SQL, _LINES, _CONTENT, _HTACCESS, _STRUCT])


def _sql(body: str) -> str:
    return f"WITH {_ALL}\n{body}"


@query("file_content_rules", "R6 R7 R8 R9 R10 R11 R12 R13 R14 R15 R16 R17 R18 R19 P34 P41", _sql("SELECT * FROM content"))
def file_content_rules(spark, sf):
    return webroot.content_findings(b.files(spark, sf))


@query("file_structural_rules", "R1 R2 R3 R4 R5 F15 F16 F17 F18 F19 P10", _sql("SELECT * FROM structural"))
def file_structural_rules(spark, sf):
    return webroot.structural_findings(b.files(spark, sf))


@query("htaccess_rules", "R20 R21", _sql("SELECT * FROM htaccess"))
def htaccess_rules(spark, sf):
    return webroot.htaccess_findings(b.files(spark, sf))


FILE_FINDINGS_SQL = _ALL + """,
ffinds AS (SELECT 'webshell' AS source, severity, rule, rule_id, 'file' AS artifact_kind, path AS artifact, CAST(line AS BIGINT) AS line, evidence,
 'webshell' AS engine, substr(sha1('webshell' || chr(31) || rule || chr(31) || path || chr(31) || coalesce(CAST(line AS VARCHAR), '')), 1, 16) AS fingerprint
 FROM (SELECT * FROM content UNION ALL SELECT * FROM htaccess UNION ALL SELECT * FROM structural))"""


@query("file_findings", "R22 F27 P32 S7", f"WITH {FILE_FINDINGS_SQL}\nSELECT * FROM ffinds WHERE rule_id <> 'webshell.goto'")
def file_findings(spark, sf):
    return webroot.findings(b.files(spark, sf), ["webshell.goto"])


@query("inert_files", "R1 K10", _sql(f"""SELECT path, 'no executable surface (' || CAST(octet_length(encode(text)) AS VARCHAR) || ' bytes' ||
 CASE WHEN octet_length(encode(text)) <= 4096 THEN ', likely a directory stub)' ELSE ')' END AS reason FROM files
 WHERE {_IS_PHP} AND NOT {_IMAGE} AND {_UPLOAD} AND NOT {_GUARD} AND NOT {_SURFACE}"""))
def inert_files(spark, sf):
    return webroot.inert_files(b.files(spark, sf))


@query("flagged_digests", "R24", f"""WITH {FILE_FINDINGS_SQL}
SELECT path AS artifact, sha256(text) AS sha256 FROM files WHERE path IN (SELECT artifact FROM ffinds)""")
def flagged_digests(spark, sf):
    files = b.files(spark, sf)
    return webroot.digests(files, webroot.findings(files))


# --- large files ------------------------------------------------------------------

#: Files of _EACH pages, each with a name of its kind: with line breaks, or (kind 3) in one line.
_EACH, _RANGE, _OVERLAP = 20, 10_000, 4_000
_BIG_NAMES = ("/wp-content/uploads/big{}.php", "/lib/big{}.jpg.php", "/images/big{}.png", "/lib/big{}.phtml", "/lib/big{}.txt", "/images/big{}/.htaccess", "/wp-content/uploads/big{}.inc.php", "/lib/page{}.php", "/wp-content/uploads/stub{}.php")


def large_files(spark, sf):
    """The files of the web root put together to large ones, of a bounded number of pages each."""
    number = F.regexp_extract("path", r"/f(\d+)", 1).cast("long")
    g = F.floor(F.col("n") / _EACH)
    kind = (g % len(_BIG_NAMES)).cast("int")
    rows = b.files(spark, sf).select(number.alias("n"), F.decode("content", "UTF-8").alias("text"))
    # Kind 7 holds pages without any PHP, kind 8 pages without the code in front of them.
    rows = rows.select("n", g.alias("g"), kind.alias("kind"), F.when(kind == 8, F.regexp_replace("text", r"^[^\n]*\n", "")).when(kind == 7, F.replace("text", F.lit("<?"), F.lit("< ?"))).when(kind == 3, F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(F.col("text")).alias("text"))
    rows = rows.groupBy("g", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t"))
    texts = F.transform("t", lambda x: x["text"])
    whole = F.when(F.col("kind") == 3, F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n"))
    path = F.lit(None)
    for k, name in enumerate(_BIG_NAMES):
        low, high = name.split("{}")
        path = F.when(F.col("kind") == k, F.concat(F.lit("/srv/copy" + low), F.col("g").cast("string"), F.lit(high))).otherwise(path)
    rows = computed_once(rows.select(path.alias("path"), whole.cast("binary").alias("content")))
    return rows.select("path", F.lit("/srv/copy").alias("root"), F.length("content").cast("long").alias("length"), "content")


def large_ranges(spark, sf):
    return file_source.cut_ranges(large_files(spark, sf), _RANGE, _OVERLAP, fixed.RANGE_CONTEXT)


_BIG_PATH = "CASE kind " + " ".join(f"WHEN {k} THEN '/srv/copy" + n.replace("{}", "' || g || '") + "'" for k, n in enumerate(_BIG_NAMES)) + " END"
_BIG = b.FILES_SQL + f""",
big0 AS (SELECT page_id // {_EACH} AS g, (page_id // {_EACH}) % {len(_BIG_NAMES)} AS kind, page_id, text FROM files),
big1 AS (SELECT g, kind, CASE kind WHEN 3 THEN string_agg(replace(text, chr(10), ' '), ' ' ORDER BY page_id) WHEN 7 THEN string_agg(replace(text, '<?', '< ?'), chr(10) ORDER BY page_id)
  WHEN 8 THEN string_agg(substr(text, strpos(text, chr(10)) + 1), chr(10) ORDER BY page_id) ELSE string_agg(text, chr(10) ORDER BY page_id) END AS text FROM big0 GROUP BY g, kind),
bigs AS (SELECT path, lower(split_part(path, '/', -1)) AS base, substr(path, 10) AS site, text FROM (SELECT {_BIG_PATH} AS path, text FROM big1))"""
_BIG_ALL = ",\n".join([_BIG, *(x.replace(" FROM files", " FROM bigs") for x in (_LINES, _CONTENT, _HTACCESS, _STRUCT))])


@query("large_file_rules", "S7 R1 R6 R7 R8 R9 R10 R11 R12 R13 R14 R15 R16 R17 R18 R19 R20 R21", f"""WITH {_BIG_ALL}
SELECT path, rule_id, severity, rule, line, evidence FROM (SELECT * FROM content UNION ALL SELECT * FROM htaccess UNION ALL SELECT * FROM structural WHERE rule_id <> 'webshell.double_ext')""")
def large_file_rules(spark, sf):
    """Every rule of the content over ranges of 10,000 bytes."""
    ranges = large_ranges(spark, sf)
    marks = b.stored(spark, sf, "large_marks", lambda: webroot.range_marks(ranges))
    return webroot.large_findings(ranges, marks).select("path", "rule_id", "severity", "rule", "line", "evidence")


@query("large_inert_files", "R1 K10", f"""WITH {_BIG_ALL}
SELECT path, 'no executable surface (' || CAST(octet_length(encode(text)) AS VARCHAR) || ' bytes' || CASE WHEN octet_length(encode(text)) <= 4096 THEN ', likely a directory stub)' ELSE ')' END AS reason
 FROM bigs WHERE {_IS_PHP} AND NOT {_IMAGE} AND {_UPLOAD} AND NOT {_GUARD} AND NOT {_SURFACE}""")
def large_inert_files(spark, sf):
    return webroot.large_inert(b.stored(spark, sf, "large_marks", lambda: webroot.range_marks(large_ranges(spark, sf))))


@query("large_tree_diff", "R26 S8", f"""WITH {_BIG}
SELECT substr(path, 11) AS rel, CASE WHEN contains(path, '/lib/') THEN 'modified' ELSE 'identical' END AS status,
 octet_length(encode(text))::BIGINT AS size, octet_length(encode(text))::BIGINT AS ref_size FROM bigs""")
def large_tree_diff(spark, sf):
    """Large files against a tree in which some differ in their last byte."""
    left = large_files(spark, sf)
    last = F.when(F.contains("path", F.lit("/lib/")), F.concat(F.substring(F.col("content"), F.lit(1), F.col("length").cast("int") - 1), F.encode(F.lit("\u0002"), "UTF-8"))).otherwise(F.col("content"))
    right = left.withColumn("content", last)
    cut = lambda files: file_source.cut_ranges(files, _RANGE, _OVERLAP, fixed.RANGE_CONTEXT)
    bare = lambda files: files.withColumn("content", F.lit(None).cast("binary"))
    return webroot.tree_diff(webroot.tree(bare(left), cut(left)), webroot.tree(bare(right), cut(right)))


_OWN = [("own.track", "Tracker call", None, r"track\(\d+\)"), ("own.any", "Any anchor", 2, r"(?i)<a href")]


@query("own_file_rules", "R23", f"""WITH {b.FILES_SQL}
SELECT path, rule_id, severity, rule, len(regexp_extract_all(text, rx)) AS matches FROM files,
 (VALUES ('own.track', 1, 'Tracker call', 'track\\(\\d+\\)'), ('own.any', 2, 'Any anchor', '(?i)<a href')) r(rule_id, severity, rule, rx)
 WHERE regexp_matches(text, rx) AND (base = '.htaccess' OR base LIKE '%.%')""")
def own_file_rules(spark, sf):
    return webroot.own_rule_findings(b.files(spark, sf), _OWN).drop("evidence")


@query("large_own_rules", "R23", f"""WITH {_BIG}
SELECT path, rule_id, severity, rule, len(regexp_extract_all(text, rx)) AS matches,
 array_to_string(list_transform(range(0, least(20, len(regexp_extract_all(text, rx)))), lambda k: rule_id || '@' || (octet_length(encode(array_to_string(string_split_regex(text, rx)[1:k + 1], ''))) +
  octet_length(encode(array_to_string(regexp_extract_all(text, rx)[1:k], ''))))), ', ') AS evidence FROM bigs,
 (VALUES ('own.track', 1, 'Tracker call', 'track\\(\\d+\\)'), ('own.any', 2, 'Any anchor', '(?i)<a href')) r(rule_id, severity, rule, rx) WHERE regexp_matches(text, rx)""")
def large_own_rules(spark, sf):
    return webroot.large_own_findings(large_ranges(spark, sf), _OWN)


_CATALOGUE = ", ".join(f"({lit(i)}, {lit(e)}, {s}, {lit(n)}, {lit(f)})" for i, e, s, n, f, _ in rules.rule_rows())


@query("rule_catalogue", "R27 U5", f"""WITH {FILE_FINDINGS_SQL}
SELECT c.*, coalesce(n.n, 0) AS findings FROM (VALUES {_CATALOGUE}) c(id, engine, severity, name, format)
 LEFT JOIN (SELECT rule_id, count(*) AS n FROM ffinds GROUP BY rule_id) n ON n.rule_id = c.id""")
def rule_catalogue(spark, sf):
    """The rules and how many findings each has on the derived files."""
    hits = webroot.findings(b.files(spark, sf)).groupBy(F.col("rule_id").alias("id")).agg(F.count(F.lit(1)).alias("findings"))
    return rules.catalogue(spark).join(hits, "id", "left").select(
        "id", "engine", "severity", "name", "format", F.coalesce("findings", F.lit(0)).alias("findings"))


@query("file_paths", "P8 P9 P10 W4", f"""WITH {b.FILES_SQL}
SELECT path, lower(CASE WHEN path LIKE '/srv/copy/lib/%' THEN substr(path, 15) ELSE substr(path, 11) END) AS web,
 CASE WHEN path LIKE '/srv/copy/lib/%' THEN substr(path, 15) ELSE substr(path, 11) END AS evidence, site FROM files""")
def file_paths(spark, sf):
    roots = ["/srv/copy", "/srv/copy/lib/", "/other"]
    return b.files(spark, sf).select(
        "path", uris.web_path(F.col("path"), roots).alias("web"), uris.evidence_path(F.col("path"), roots).alias("evidence"),
        uris.site_path(F.col("path"), F.col("root")).alias("site"))


@query("evidence_inventory", "S12 S1", f"""WITH {b.FILES_SQL}
SELECT CASE WHEN path LIKE '/srv/copy/images/%' THEN '/srv/copy/images' ELSE '/srv/copy' END AS root, count(*) AS files,
 sum(octet_length(encode(text)))::BIGINT AS bytes FROM files GROUP BY 1""")
def evidence_inventory(spark, sf):
    return webroot.evidence_inventory(b.files(spark, sf), ["/srv/copy", "/srv/copy/images/"])


# --- reference tree -------------------------------------------------------------

_RIGHT_SQL = """rgt AS (SELECT CASE page_id % 10 WHEN 0 THEN substr(path, 11) || '.orig' ELSE substr(path, 11) END AS rel,
 CASE page_id % 10 WHEN 1 THEN text || 'x' WHEN 2 THEN 'Z' || substr(text, 2) ELSE text END AS text FROM files),
lft AS (SELECT substr(path, 11) AS rel, text FROM files),
diff AS (SELECT coalesce(l.rel, r.rel) AS rel, CASE WHEN r.rel IS NULL THEN 'extra' WHEN l.rel IS NULL THEN 'missing'
 WHEN sha256(l.text) <> sha256(r.text) THEN 'modified' ELSE 'identical' END AS status,
 coalesce(octet_length(encode(l.text)), 0)::BIGINT AS size, coalesce(octet_length(encode(r.text)), 0)::BIGINT AS ref_size
 FROM lft l FULL OUTER JOIN rgt r ON r.rel = l.rel)"""


def _trees(spark, sf):
    files = b.files(spark, sf)
    number = F.regexp_extract("path", r"/f(\d+)", 1).cast("long") % 10
    text = F.decode("content", "UTF-8")
    changed = F.when(number == 1, F.concat(text, F.lit("x"))).when(
        number == 2, F.concat(F.lit("Z"), F.substr(text, F.lit(2)))).otherwise(text).cast("binary")
    right = files.select(F.when(number == 0, F.concat("path", F.lit(".orig"))).otherwise(F.col("path")).alias("path"),
                         "root", F.length(changed).cast("long").alias("length"), changed.alias("content"))
    return webroot.tree(files), webroot.tree(right)


@query("tree_diff", "R26 J11 S8", f"WITH {b.FILES_SQL},\n{_RIGHT_SQL}\nSELECT * FROM diff")
def tree_diff(spark, sf):
    return webroot.tree_diff(*_trees(spark, sf))


@query("tree_diff_counts", "A29", f"WITH {b.FILES_SQL},\n{_RIGHT_SQL}\nSELECT status, count(*) AS n FROM diff GROUP BY status")
def tree_diff_counts(spark, sf):
    return webroot.diff_counts(webroot.tree_diff(*_trees(spark, sf)))


@query("tree_diff_page", "T7 F26 T3", f"""WITH {b.FILES_SQL},\n{_RIGHT_SQL}
SELECT * FROM diff WHERE status NOT IN ('identical', 'missing') AND contains(lower(rel), 'inc')
 ORDER BY CASE status WHEN 'modified' THEN 0 WHEN 'extra' THEN 1 ELSE 3 END, rel LIMIT 15""")
def tree_diff_page(spark, sf):
    view = webroot.diff_view(webroot.tree_diff(*_trees(spark, sf)), ["missing"], "INC")
    return view.orderBy(*webroot.diff_order()).limit(15)


@query("tree_path_sets", "U3", f"""WITH {b.FILES_SQL},\n{_RIGHT_SQL}
SELECT rel, 'extra' AS status FROM lft WHERE rel NOT IN (SELECT rel FROM rgt)
UNION ALL SELECT rel, 'missing' FROM rgt WHERE rel NOT IN (SELECT rel FROM lft)""")
def tree_path_sets(spark, sf):
    return webroot.missing_paths(*_trees(spark, sf))


# --- error log ------------------------------------------------------------------


def error_lines(spark, sf):
    """The derived requests as an error log: three shapes of lines, some naming files."""
    r = b.table(spark, sf, "pages")
    n = F.col("page_id")
    files = b.files(spark, sf).select(F.regexp_extract("path", r"/f(\d+)", 1).cast("long").alias("page_id"), "path")
    named = r.select("page_id").join(files, "page_id").withColumn(
        "server", F.concat(F.lit("/var/www/site"), F.substr("path", F.lit(10))))
    server = F.col("server")
    upper = F.when(n % 4 == 0, F.upper(server)).otherwise(server)
    text = (F.when(n % 5 == 0, F.concat(F.lit("PHP Fatal error: Uncaught x in "), upper, F.lit(":12")))
            .when(n % 5 == 1, F.concat(F.lit("PHP Warning: y in "), upper, F.lit(" on line 7")))
            .when(n % 5 == 2, F.concat(F.lit("PHP Notice: z in /elsewhere/other"), n.cast("string"), F.lit(".php on line 3")))
            .when(n % 5 == 3, F.concat(F.lit("File does not exist: "), upper))
            .otherwise(F.concat(F.lit("PHP Parse error: p in "), upper, F.lit(" on line 0"))))
    minute = F.format_string("%02d", (n % 60).cast("int"))
    apache = F.concat(F.lit("[Mon Jan 06 08:"), minute, F.lit(":00.123456 2026] [php:error] [pid 1] [client 203.0.113.7:4711] "), text)
    nginx = F.concat(F.lit("2026/01/07 09:"), minute, F.lit(":00 [error] 12#34: "), text)
    value = F.when(n % 3 == 0, nginx).otherwise(apache)
    return computed_once(named.select(F.lit("/logs/error.log").alias("source"), n.alias("pos"), value.alias("value")))


_EXT = "(php|phtml|inc|phar)"
_ERR = f"""elog AS (SELECT page_id, path, '/var/www/site' || substr(path, 10) AS p0, page_id % 5 AS k FROM files_raw),
enamed AS (SELECT page_id AS pos, CASE WHEN k = 2 THEN '/elsewhere/other' || CAST(page_id AS VARCHAR) || '.php' WHEN page_id % 4 = 0 THEN upper(p0) ELSE p0 END AS logged,
 k, path, CASE WHEN page_id % 3 = 0 THEN 1767776400 ELSE 1767686400 END + 60 * (page_id % 60) AS "at",
 CASE k WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 0 END AS line, k IN (0, 4) AS hard,
 CASE WHEN page_id % 3 = 0 THEN '' ELSE '203.0.113.7' END AS client
 FROM elog WHERE k <> 3 AND (k = 2 OR regexp_matches(path, '(?i)\\.{_EXT}$')))"""
_EWITH = f"WITH {b.FILES_SQL},\n{_ERR}\n"


@query("error_log_paths", "S6 P36 P37 P38 F20", _EWITH + 'SELECT pos, "at", client, logged, CAST(line AS INT) AS line, hard FROM enamed')
def error_log_paths(spark, sf):
    return errorlog.named_paths(error_lines(spark, sf)).select("pos", "at", "client", "logged", "line", "hard")


def _webroot(spark, sf):
    return b.files(spark, sf).select("path", F.substr("path", F.lit(11)).alias("rel"), F.lit(0).alias("root_rank"))


@query("error_log_resolved", "J10 W4", _EWITH + "SELECT DISTINCT logged, CASE WHEN k = 2 THEN NULL ELSE path END AS artifact FROM enamed")
def error_log_resolved(spark, sf):
    return errorlog.resolve(errorlog.named_paths(error_lines(spark, sf)), _webroot(spark, sf))


@query("error_log_findings", "A26 R25", _EWITH + """SELECT severity, rule, rule_id, path AS artifact, CAST(line AS BIGINT) AS line,
 substr('1× in the error log as ' || logged || ' · ' || CASE k WHEN 0 THEN 'PHP Fatal error: Uncaught x in ' || logged || ':12'
  WHEN 1 THEN 'PHP Warning: y in ' || logged || ' on line 7' ELSE 'PHP Parse error: p in ' || logged || ' on line 0' END, 1, 400) AS evidence
 FROM (SELECT *, CASE WHEN hard THEN 1 ELSE 2 END AS severity, CASE WHEN hard THEN 'PHP error names this file (fatal/parse)' ELSE 'PHP error names this file' END AS rule,
 CASE WHEN hard THEN 'errorlog.hard' ELSE 'errorlog.soft' END AS rule_id FROM enamed WHERE k <> 2)""")
def error_log_findings(spark, sf):
    paths = errorlog.named_paths(error_lines(spark, sf))
    found = errorlog.findings(errorlog.per_file(paths, errorlog.resolve(paths, _webroot(spark, sf))))
    return found.select("severity", "rule", "rule_id", "artifact", "line", "evidence")


@query("error_log_unresolved", "J10", _EWITH + "SELECT count(*) AS unresolved FROM enamed WHERE k = 2")
def error_log_unresolved(spark, sf):
    paths = errorlog.named_paths(error_lines(spark, sf))
    return errorlog.unresolved(paths, errorlog.resolve(paths, _webroot(spark, sf)))


@query("finding_evidence_cut", "P34", f"""WITH {b.FILES_SQL}, {_LINES}
SELECT DISTINCT {_CUT} AS evidence FROM (SELECT {_TRIM} AS t FROM flines)""")
def finding_evidence_cut(spark, sf):
    lines = webroot.latin(webroot.typed(b.files(spark, sf))).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(truncate(webroot.readable(F.col("line")), 160).alias("evidence")).distinct()


# --- CMS ------------------------------------------------------------------------

_CMS_LAYERS = [[
    ("page_id", "page_id"),
    ("'/srv/s' || CAST(CAST(floor(page_id / 10) AS BIGINT) AS STRING) || CASE page_id % 10"
     " WHEN 0 THEN CASE WHEN page_id % 20 = 0 THEN '/wp-includes/version.php' ELSE '/libraries/src/Version.php' END"
     " WHEN 1 THEN '/wp-content/plugins/hello.php' WHEN 2 THEN '/wp-content/plugins/shop/shop.php'"
     " WHEN 3 THEN '/wp-content/plugins/bare/readme.txt' WHEN 4 THEN '/wp-content/themes/deep/style.css'"
     " WHEN 5 THEN '/wp-content/themes/deep/inc/slider/slider.php' WHEN 6 THEN '/wp-content/themes/deep/inc/vendor/x.php'"
     " WHEN 7 THEN '/modules/mod_a/mod_a.xml' WHEN 8 THEN '/plugins/system/cache/cache.php'"
     " ELSE '/administrator/components/com_x/x.xml' END", "path"),
    ("CASE page_id % 10 WHEN 0 THEN CASE WHEN page_id % 20 = 0 THEN '<?php $wp_version = \"6.' || CAST(page_id % 7 AS STRING) || '\";'"
     " ELSE 'const MAJOR_VERSION = 5; const MINOR_VERSION = 1; const PATCH_VERSION = ' || CAST(page_id % 9 AS STRING) || ';' END"
     " WHEN 1 THEN '<?php' || {newline} || ' * Plugin Name: Hello ' || CAST(page_id AS STRING) || {newline} || ' * Version: 1.' || CAST(page_id % 3 AS STRING)"
     " WHEN 2 THEN '/* Plugin Name: Shop */' WHEN 4 THEN 'Theme Name: Deep' || {newline} || 'Version: 2.0'"
     " WHEN 5 THEN 'Plugin Name: Slider' || {newline} || 'Version: 4.2' WHEN 6 THEN 'Plugin Name: Hidden'"
     " WHEN 7 THEN '<?xml version=\"1.0\"?><extension type=\"module\"><name>Mod A</name><version>3.1</version></extension>'"
     " WHEN 9 THEN '<other><name>no</name></other>' ELSE '' END || {newline} || html", "text"),
]]
_CMS_SQL = "WITH " + b._ctes("cf", "pages", _CMS_LAYERS) + """,
inst AS (SELECT regexp_replace(path, '(?i)/(wp-includes|libraries/src)/version\\.php$', '') AS root, CASE WHEN page_id % 20 = 0 THEN 'WordPress' ELSE 'Joomla' END AS cms,
 CASE WHEN page_id % 20 = 0 THEN '6.' || CAST(page_id % 7 AS VARCHAR) ELSE '5.1.' || CAST(page_id % 9 AS VARCHAR) END AS version, path AS version_source
 FROM cf WHERE page_id % 10 = 0),
placed AS (SELECT i.root, i.cms, f.path, f.page_id % 10 AS k, f.page_id FROM cf f JOIN inst i ON starts_with(f.path, i.root || '/')),
items AS (SELECT root, CASE k WHEN 4 THEN 'Theme' WHEN 5 THEN 'Plugin (bundled in theme deep)' ELSE 'Plugin' END AS type,
 CASE k WHEN 1 THEN 'Hello ' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'Shop */' WHEN 3 THEN 'bare' WHEN 4 THEN 'Deep' ELSE 'Slider' END AS name,
 CASE k WHEN 1 THEN 'hello' WHEN 2 THEN 'shop' WHEN 3 THEN 'bare' WHEN 4 THEN 'deep' ELSE 'slider' END AS slug,
 CASE k WHEN 1 THEN '1.' || CAST(page_id % 3 AS VARCHAR) WHEN 4 THEN '2.0' WHEN 5 THEN '4.2' ELSE '(unknown)' END AS version,
 CASE k WHEN 3 THEN root || '/wp-content/plugins/bare' WHEN 4 THEN root || '/wp-content/themes/deep' WHEN 5 THEN root || '/wp-content/themes/deep/inc/slider' ELSE path END AS path,
 CASE k WHEN 3 THEN '' ELSE path END AS version_source FROM placed WHERE cms = 'WordPress' AND k BETWEEN 1 AND 5
 UNION ALL SELECT root, CASE k WHEN 7 THEN 'Module' WHEN 8 THEN 'Plugin (system)' ELSE 'Component' END,
 CASE k WHEN 7 THEN 'Mod A' WHEN 8 THEN 'cache' ELSE 'com_x' END, CASE k WHEN 7 THEN 'mod_a' WHEN 8 THEN 'cache' ELSE 'com_x' END,
 CASE k WHEN 7 THEN '3.1' ELSE '(unknown)' END, CASE k WHEN 7 THEN path WHEN 8 THEN root || '/plugins/system/cache' ELSE root || '/administrator/components/com_x' END,
 CASE k WHEN 7 THEN path ELSE '' END FROM placed WHERE cms = 'Joomla' AND k >= 7),
arts AS (SELECT path AS artifact, CAST(page_id % 3 AS INT) AS worst FROM cf)"""


def _cms_files(spark, sf):
    rows = b._apply(b.table(spark, sf, "pages"), _CMS_LAYERS)
    return computed_once(rows.select("page_id", "path", F.col("text").cast("binary").alias("content")))


@query("cms_installs", "B21 S11", _CMS_SQL + "\nSELECT * FROM inst")
def cms_installs(spark, sf):
    return cms.installs(_cms_files(spark, sf))


def _items(files, found):
    return cms.wordpress_items(files, found).unionByName(cms.joomla_items(files, found))


@query("cms_items", "B22 B23 B24 S11", _CMS_SQL + "\nSELECT * FROM items")
def cms_items(spark, sf):
    files = _cms_files(spark, sf)
    return _items(files, cms.installs(files))


@query("cms_flagged_items", "J12 P39", _CMS_SQL + """
SELECT root, type, slug, count(a.artifact) AS flagged, min(worst) AS worst FROM (SELECT *, lower(CASE
  WHEN type = 'Plugin' AND slug = 'hello' THEN path WHEN type = 'Plugin' AND slug = 'shop' THEN regexp_replace(path, '/[^/]+$', '')
  WHEN type = 'Module' THEN regexp_replace(path, '/[^/]+$', '') ELSE path END) AS scope FROM items) i
 LEFT JOIN arts a ON lower(a.artifact) = scope OR (slug <> 'hello' AND starts_with(lower(a.artifact), scope || '/')) GROUP BY root, type, slug""")
def cms_flagged_items(spark, sf):
    files = _cms_files(spark, sf)
    arts = files.select(F.col("path").alias("artifact"), F.lit("file").alias("artifact_kind"), (F.col("page_id") % 3).cast("int").alias("worst"))
    flagged = cms.flagged_items(_items(files, cms.installs(files)), arts)
    return flagged.select("root", "type", "slug", "flagged", F.get("artifacts", F.lit(0))["worst"].alias("worst"))


@query("cms_overrides", "J13", _CMS_SQL + """
SELECT root, type, slug, version AS version_parsed, CASE WHEN slug = 'shop' THEN '9.9' ELSE version END AS version FROM items""")
def cms_overrides(spark, sf):
    files = _cms_files(spark, sf)
    items = _items(files, cms.installs(files))
    overrides = items.filter("slug = 'shop'").select(cms.item_key().alias("key"), F.lit("9.9").alias("set_version"), F.lit("seen").alias("set_note"))
    return cms.with_overrides(items, cms.item_key(), overrides).select("root", "type", "slug", "version_parsed", "version")


@query("cms_totals", "A30", _CMS_SQL + """
SELECT (SELECT count(*) FROM inst) AS installs, (SELECT count(*) FROM items) AS items,
 (SELECT count(*) FROM items WHERE version = '(unknown)') AS unknown_versions""")
def cms_totals(spark, sf):
    files = _cms_files(spark, sf)
    found = cms.installs(files)
    return cms.totals(found, _items(files, found))


# --- indicators in names ---------------------------------------------------------


@query("file_types", "F18 R22", f"""WITH {b.FILES_SQL}
SELECT path, {_IS_PHP} AS php, {_IMAGE} AS image, base = '.htaccess' AS htaccess FROM files""")
def file_types(spark, sf):
    return webroot.typed(b.files(spark, sf)).select(
        "path", F.col("is_php").alias("php"), F.col("is_image").alias("image"), F.col("is_htaccess").alias("htaccess"))


@query("defanged_urls", "P31", """SELECT page_id, replace(regexp_replace(url, '^http(s?)://', 'hxxp\\1://'), '.', '[.]') AS safe FROM pages""")
def defanged_urls(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", ind.defang(F.col("url"), F.lit("url")).alias("safe"))


@query("upload_places", "F15", f"""WITH {b.FILES_SQL}
SELECT split_part(site, '/', 2) AS folder, {_UPLOAD} AS upload, count(*) AS n FROM files GROUP BY 1, 2""")
def upload_places(spark, sf):
    site = uris.site_path(F.col("path"), F.col("root"))
    return b.files(spark, sf).groupBy(
        F.split(site, "/")[1].alias("folder"), is_.in_upload_directory(site).alias("upload")).agg(F.count(F.lit(1)).alias("n"))
