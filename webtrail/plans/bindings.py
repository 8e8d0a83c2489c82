"""Evidence derived from the supplied star-schema tables.

No supplied table is an access log. These layers of expressions turn the tables into
one, row for row, by integer arithmetic and CASE that mean the same in Spark SQL and in
the SQL of the check. The expressions are written once and rendered for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.functions import uris
from webtrail.functions.text import computed_once
from webtrail.session import shared_dir

_SPARK_EPOCH = ("CAST(unix_date(CAST(ts AS DATE)) AS BIGINT) * 86400 + hour(ts) * 3600"
                " + minute(ts) * 60 + CAST(second(ts) AS BIGINT)")
_DUCK_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"
T0 = 1704067200  # 2024-01-01, the first day of the events


def _cases(subject: str, values: dict, other: str) -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in values.items())
    return f"CASE {subject} {arms} ELSE {other} END"


_URIS = {
    0: "'/wp-login.php'", 1: "'/administrator/index.php'",
    2: "'/administrator/index.php?option=com_content&view=articles'",
    3: "'/wp-admin/edit.php?post_type=page'", 4: "'/wp-admin/admin-ajax.php?action=x'",
    5: "'/index.php?id=1+union+select+password'", 6: "'/download.php?f=../../etc/passwd'",
    7: "'/images/stories/x.php?cmd=id'", 8: "'/templates/evil.php'",
    9: "'/wp-content/uploads/2026/01/kb-media.php'",
    10: "'/index.php?option=com_jce&task=profiles.import'",
    11: "'/index.php?option=com_ajax&plugin=helix3'", 12: "'/xmlrpc.php'",
    13: "'/shop/index.php'", 14: "'/'", 15: "'/index.php'",
    16: "'/a/b?x=%2e%2e%2f%2E%2E%2Fetc'", 17: "'/modules/mod_x/helper.php'",
    18: "'/plugins/shell.php?x'", 19: "'/about/#team'", 20: "'-'",
    21: "'/index.php?option=com_users&task=user.login'",
    22: "'/administrator/index.php?option=com_login'", 23: "'/media/system/js/core.js'",
    24: "'/wp-admin/'", 25: "'/wp-admin/css/login.min.css'",
    26: "'/search?q=%27 or 1=1'", 27: "'/p?x=sleep(5)'", 28: "'/Images/Shell.PHP5?x=1'",
    29: "'/administrator/components/x.phtml'", 30: "'/index.php?option=com_jce&view=popup'",
    31: "'/shop/wp-content/uploads/2026/01/kb-media.php'",
    32: "'/wp-admin/network/settings.php'", 33: "'/administrator/'",
}
_AGENTS = {
    0: "'Mozilla/5.0 (X11; Linux x86_64)'", 1: "'Mozilla/5.0 (Windows NT 10.0)'",
    2: "'curl/8.5.0'", 3: "'Mozilla/5.00 (Nikto/2.1.6)'",
    4: "CASE WHEN e % 2 = 0 THEN 'sqlmap/1.7#stable (http://sqlmap.org)' ELSE 'Nuclei - Open-source' END",
    5: "'-'", 6: "'Mozilla/5.0 (iPhone)'",
    7: "CASE e % 7 WHEN 0 THEN 'WPScan v3.8' WHEN 1 THEN 'ffuf/2.1' WHEN 2 THEN 'gobuster/3' "
       "WHEN 3 THEN 'zgrab/0.x' WHEN 4 THEN 'httpx - 1' WHEN 5 THEN 'masscan/1.3' ELSE 'wfuzz/3' END",
}

_REQUEST_LAYERS = [
    [
        ("event_id", "e"), ("user_id", "u"), ("event_type", "t"), ("{epoch}", "s"),
        ("CASE user_id % 25 WHEN 7 THEN 1 WHEN 8 THEN 2 ELSE 0 END", "storm"),
        ("CAST(user_id % 256 AS STRING)", "low"),
        ("CAST(CAST(floor(user_id / 256) AS BIGINT) % 256 AS STRING)", "high"),
    ],
    [
        (_cases("u % 6", {
            0: "'10.0.' || high || '.' || low", 1: "'203.0.113.' || low",
            2: "'192.168.' || high || '.' || low", 3: "'45.12.' || high || '.' || low",
            4: "'172.16.' || high || '.' || low"}, "'91.20.' || high || '.' || low"), "ip"),
        # Whole days are pushed apart so that the series has holes; a storm of one kind
        # falls into a single hour, the other keeps its month.
        (f"CASE WHEN e % 97 = 0 THEN NULL WHEN storm = 1 THEN {T0} + 86400 * (u % 20) + (e * 7919) % 3600"
         f" ELSE s + CASE WHEN s >= {T0 + 864000} THEN 40000 ELSE 0 END"
         f" + CASE WHEN s >= {T0 + 1728000} THEN 20000 ELSE 0 END END", "epoch"),
        ("CAST(CASE WHEN e % 97 = 0 THEN NULL ELSE "
         + _cases("u % 4", {0: "0", 1: "7200", 2: "-18000"}, "19800") + " END AS INT)", "tz"),
        ("CASE WHEN storm > 0 THEN CASE WHEN t = 'view' THEN 'GET' ELSE 'POST' END"
         " WHEN e % 40 = 20 THEN '-' WHEN t IN ('signup', 'purchase') THEN 'POST'"
         " WHEN e % 29 = 0 THEN 'HEAD' ELSE 'GET' END", "method"),
        ("CASE WHEN storm > 0 THEN CASE WHEN t = 'view' THEN '/administrator/index.php?option=com_content'"
         " WHEN u % 2 = 0 THEN '/wp-login.php' ELSE '/administrator/index.php' END ELSE "
         + _cases("e % 40", _URIS, "'/page/' || CAST(e % 97 AS STRING) || '.html'") + " END", "uri"),
        ("CAST(CASE WHEN t = 'error' THEN " + _cases("e % 5", {0: 404, 1: 403, 2: 500, 3: 503}, "404")
         + " WHEN t = 'click' THEN " + _cases("e % 3", {0: 301, 1: 302}, "303")
         + " WHEN e % 11 = 0 THEN 206 ELSE 200 END AS INT)", "status"),
        ("CASE WHEN e % 7 = 0 THEN NULL ELSE (e * 37) % 5000 END", "size"),
        ("CASE WHEN e % 6 = 0 THEN '-' ELSE 'https://example.test/p' || CAST(e % 13 AS STRING) END", "referrer"),
        (_cases("u % 9", _AGENTS, "'Mozilla/5.0 (Macintosh)'"), "agent"),
        (_cases("e % 3", {0: "'/logs/a/access.log'", 1: "'/logs/b/access.log'"}, "'/logs/b/other.log'"), "source"),
        ("e", "pos"),
    ],
]

_FILE_SNIPPETS = {
    0: "'<?php eval(base64_decode($x));'", 1: "'<?php $f($_POST[1]);'",
    2: "'<?php system($_GET[c]);'", 3: "'<?php preg_replace(\"/.*/e\", $a, $b);'",
    4: "'<?php call_user_func($_GET[f]);'", 5: "'<?php create_function(\"$a\", $b);'",
    6: "'<?php file_put_contents(\"x\", $_POST[d]);'",
    7: "'<?php move_uploaded_file($t, $_POST[p]);'",
    8: "'<?php $x = gzinflate(base64_decode($y));'", 9: "'<?php goto a1;'",
    10: "'<?php echo chr(1).chr(2).chr(3).chr(4).chr(5).$x;'", 11: "'<?php passthru($c);'",
    12: "'<?php defined(\"ABSPATH\") or die; $_GET[1];'", 13: "'<?php // nothing here'",
    14: "'auto_prepend_file x.php'", 15: "'AddHandler application/x-httpd-php .jpg'",
    16: "'<?= \"plain readable text that goes on and on for a while\" ?>'",
}
_FILE_DIRS = {0: "'/images'", 1: "'/wp-content/uploads'", 2: "'/lib'", 3: "'/media/system'",
              4: "'/administrator/components'", 5: "'/tmp/install_x'"}
_FILE_NAMES = {0: "'.php'", 1: "'.jpg.php'", 2: "'.png'", 3: "'.phtml'", 4: "'.txt'", 5: "'/.htaccess'"}
_FILE_LAYERS = [[
    ("page_id", "page_id"),
    ("'/srv/copy' || " + _cases("page_id % 8", _FILE_DIRS, "'/shop/inc'") + " || '/f' || CAST(page_id AS STRING) || "
     + _cases("page_id % 7", _FILE_NAMES, "'.php'"), "path"),
    (_cases("page_id % 19", _FILE_SNIPPETS, "'nothing'") + " || {newline} || html", "text"),
]]

_ACCOUNT_LAYERS = [[
    ("CAST(c_custkey AS STRING)", "user_id"),
    ("lower(replace(c_name, '#', '.'))", "login"),
    ("CASE WHEN c_custkey % 11 = 0 THEN '' ELSE lower(c_mktsegment) || CAST(c_custkey AS STRING)"
     " || '@example.test' END", "email"),
    (_cases("c_custkey % 6", {
        0: "'$2y$10$abcdefghij'", 1: "'$P$Babcdefghij'", 2: "'5f4dcc3b5aa765d61d8327deb882cf99'",
        3: "'$argon2id$v=19'", 4: "'plain'"}, "'$wp$2y$10$x'"), "pass"),
    ("CASE WHEN c_custkey % 13 = 0 THEN '0000-00-00 00:00:00' ELSE '2024-01-' ||"
     " CASE WHEN c_custkey % 28 < 9 THEN '0' ELSE '' END || CAST(c_custkey % 28 + 1 AS STRING)"
     " || ' 0' || CAST(c_custkey % 10 AS STRING) || ':17:00' END", "registered"),
    ("CASE WHEN c_custkey % 17 = 0 THEN '1' ELSE '0' END", "status"),
    ("CASE WHEN c_custkey % 19 = 0 THEN '8' ELSE '2' END", "group_id"),
    ("c_nationkey", "nation"),
]]


def _render(expression: str, duck: bool) -> str:
    return (expression.replace("{epoch}", _DUCK_EPOCH if duck else _SPARK_EPOCH)
            .replace("{newline}", "chr(10)"))


def _apply(df: DataFrame, layers) -> DataFrame:
    for layer in layers:
        df = df.selectExpr(*[f"{_render(x, False)} AS `{a}`" for x, a in layer])
    return df


def _ctes(name: str, table: str, layers) -> str:
    out, source = [], table
    for i, layer in enumerate(layers):
        label = name if i == len(layers) - 1 else f"{name}_{i}"
        columns = ", ".join(f'{_render(x, True)} AS "{a}"' for x, a in layer)
        out.append(f"{label} AS (SELECT {columns} FROM {source})")
        source = label
    return ",\n".join(out)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The same rows over twice as many tasks as there are cores: a table of few files or row groups is
    read by as few tasks, and all that is derived from its rows would run in them. The number is a
    stated one, as rows that are small as they lie here are costly in what is derived from them."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


_WRITTEN: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A table of the derived case, written once per application and read back.

    Findings, accounts and the index are stored tables in any real case: later questions
    read them and do not repeat the scans. The folder is the shared one of the cluster, so
    the tables outlive the executors that wrote them."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        path = "/".join([shared_dir(spark), "webtrail", key[0], sf.strip("/").replace("/", "_"), name])
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """`events` as access-log requests."""
    rows = _apply(spread(table(spark, sf, "events"), "event_id"), _REQUEST_LAYERS)
    return rows.withColumn("leaf", uris.leaf(F.col("uri")))


_DUCK_LEAF = "lower(split_part(rtrim(split_part(split_part(uri, '?', 1), '#', 1), '/'), '/', -1))"
_REQ = _ctes("req_raw", "events", _REQUEST_LAYERS) + (
    f",\nreq AS (SELECT *, {_DUCK_LEAF} AS leaf,"
    " CAST(floor((epoch + tz) / 86400.0) AS BIGINT) AS dayno,"
    " status BETWEEN 200 AND 299 AS ok FROM req_raw)")
# Fixed values again, in the check's regular-expression dialect, which has no
# look-around: each negative look-ahead is a second test.
_FLAGS = r"""flagged AS (SELECT *,
  (regexp_matches(uri, '(?i)(wp-login\.php|xmlrpc\.php|option=com_login|task=user\.login|option=com_users)')
   OR (regexp_matches(uri, '(?i)/administrator/(index\.php)?(\?|\s|$)')
       AND NOT regexp_matches(uri, '(?i)/administrator/(index\.php)?\?[^\s]*option=com_'))) AS f_login,
  ((regexp_matches(uri, '(?i)/administrator/index\.php\?[^\s]*option=com_')
    AND NOT regexp_matches(uri, '(?i)option=com_(login|users\b)'))
   OR (regexp_matches(uri, '(?i)/wp-admin/(?:network/|user/)?(?:[a-z0-9_-]+\.php|)(?:[?\s]|$)')
       AND NOT regexp_matches(uri, '(?i)/wp-admin/(?:network/|user/)?(?:admin-ajax|admin-post|load-scripts|load-styles|install|upgrade|setup-config|async-upload)\.php'))) AS f_admin,
  regexp_matches(uri, '(?i)(union[+%20\s]+select|information_schema|concat\s*\(|%27\s*or\s*1=1|''\s*or\s*1=1|benchmark\s*\(|sleep\s*\()') AS f_sqli,
  regexp_matches(uri, '(?i)(?:\.\./|\.\.%2f|%2e%2e%2f){2,}') AS f_traversal,
  regexp_matches(uri, '(?i)/(images|tmp|cache|media|files|assets|upload|uploads|wp-content/uploads|wp-content/cache)/[^?\s]*\.ph(p\d?|tml|ar)\b') AS f_upload_php,
  regexp_matches(uri, '(?i)^/?(?:administrator/)?(?:templates|modules|plugins|components)/[^/?\s]+\.ph(?:p\d?|tml|ar)(?:[?\s]|$)') AS f_cms_dir_php,
  regexp_matches(agent, '(?i)(sqlmap|nikto|nmap|masscan|dirbuster|gobuster|feroxbuster|wpscan|joomscan|hydra|acunetix|nessus|nuclei|zgrab|censys|httpx|wfuzz|ffuf)') AS f_scanner
 FROM req)"""

_KINDS = ("sqli", "traversal", "upload_php", "cms_dir_php")
_ACTORS = (
    "posts AS (SELECT * FROM flagged WHERE f_login AND method = 'POST'),\n"
    "bursts AS (SELECT ip, max(n) AS login_burst FROM (SELECT ip, count(*) OVER (PARTITION BY ip ORDER BY epoch"
    " RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM posts WHERE epoch IS NOT NULL) GROUP BY ip),\n"
    "statuses AS (SELECT ip, string_agg(CAST(status AS VARCHAR) || ' ×' || CAST(n AS VARCHAR), ', ' ORDER BY status)"
    " AS breakdown FROM (SELECT ip, status, count(*) AS n FROM posts GROUP BY ip, status) GROUP BY ip),\n"
    "scan_uas AS (SELECT DISTINCT ip, agent FROM flagged WHERE f_scanner),\n"
    "scans AS (SELECT ip, string_agg(agent, '|' ORDER BY agent) FILTER (WHERE rk <= 5) AS scanner_uas, count(*) AS n_uas"
    " FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY agent) AS rk FROM scan_uas) GROUP BY ip),\n"
    "actors AS (SELECT f.ip, count(*) AS requests, min(epoch) AS first_epoch, max(epoch) AS last_epoch,"
    " coalesce(arg_max(tz, epoch * 1000000 + tz), 0) AS tz,"
    " count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS err4, count(*) FILTER (WHERE status >= 500) AS err5,"
    " CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE size IS NULL) AS bytes_unknown,"
    " count(*) FILTER (WHERE method = 'POST') AS posts,"
    " count(*) FILTER (WHERE f_login AND method = 'POST') AS login_posts,"
    " count(*) FILTER (WHERE f_login AND method = 'POST' AND status IN (301, 302, 303)) AS login_redirects,"
    " min(epoch) FILTER (WHERE f_login AND method = 'POST') AS login_first,"
    " max(epoch) FILTER (WHERE f_login AND method = 'POST') AS login_last,"
    " count(*) FILTER (WHERE f_admin AND ok) AS admin_ok, count(DISTINCT agent) AS agents, "
    + ", ".join(
        f"count(*) FILTER (WHERE f_{k}) AS {k}_attempts, count(*) FILTER (WHERE f_{k} AND ok) AS {k}_ok,"
        f" min(size) FILTER (WHERE f_{k} AND ok) AS {k}_size_min, max(size) FILTER (WHERE f_{k} AND ok) AS {k}_size_max,"
        f" count(size) FILTER (WHERE f_{k} AND ok) AS {k}_sized,"
        f" count(*) FILTER (WHERE f_{k} AND ok AND size IS NULL) AS {k}_unsized,"
        f" coalesce(arg_min(uri, coalesce(epoch, 9000000000) * 100000000 + CASE source WHEN '/logs/a/access.log' THEN 0"
        f" WHEN '/logs/b/access.log' THEN 30000000 ELSE 60000000 END + pos) FILTER (WHERE f_{k}), '') AS {k}_example"
        for k in _KINDS)
    + ", coalesce(any_value(b.login_burst), 0) AS login_burst, any_value(s.breakdown) AS breakdown,"
    " coalesce(any_value(c.scanner_uas), '') AS scanner_uas"
    " FROM flagged f LEFT JOIN bursts b ON b.ip = f.ip LEFT JOIN statuses s ON s.ip = f.ip"
    " LEFT JOIN scans c ON c.ip = f.ip GROUP BY f.ip)"
)


def _words(c: str) -> str:
    return (f"CASE WHEN {c} < 90 THEN CAST({c} AS VARCHAR) || ' s' WHEN {c} < 5400 THEN CAST({c} // 60 AS VARCHAR) || ' min'"
            f" WHEN {c} < 172800 THEN printf('%.0f', {c} / 3600.0) || ' h' ELSE printf('%.0f', {c} / 86400.0) || ' d' END")


_RATE = "(login_posts / ((login_last - login_first) / 3600.0))"
_LOGIN_RATE = (
    "CASE WHEN login_first IS NULL OR login_last IS NULL THEN '' WHEN login_last - login_first <= 0 THEN"
    f" 'within one second ' ELSE 'over ' || {_words('(login_last - login_first)')} || ' (' ||"
    f" CASE WHEN {_RATE} >= 100 THEN format('{{:,}}', CAST(round_even({_RATE}, 0) AS BIGINT)) ELSE printf('%.3g', {_RATE}) END"
    " || '/h) ' END")


def _span(k: str) -> str:
    return (
        f"CASE WHEN {k}_sized + {k}_unsized = 0 THEN '' WHEN {k}_sized = 0 THEN ', the log records no response size for"
        f" any of them, so nothing can be said about what came back' ELSE ', responses ' || CASE WHEN {k}_size_min = {k}_size_max"
        f" THEN format('{{:,}}', {k}_size_min) ELSE format('{{:,}}', {k}_size_min) || '-' || format('{{:,}}', {k}_size_max) END"
        f" || ' bytes' || CASE WHEN {k}_unsized > 0 THEN '; ' || CAST({k}_unsized AS VARCHAR) || ' further answer(s) logged no size'"
        " ELSE '' END END")


def _of(k: str, text: str, tail: str = "") -> str:
    end = f" || '{tail}'" if tail else ""
    return f"CAST({k}_ok AS VARCHAR) || ' of ' || CAST({k}_attempts AS VARCHAR) || ' {text}' || {_span(k)}{end}"


_SUCCESS = "login_posts >= 30 AND login_burst >= 30 AND admin_ok > 0"
_ALERTS = (
    "alerts AS (\nSELECT ip, 'login_flood' AS kind, 1 AS severity, CAST(login_posts AS VARCHAR) || ' POSTs against login"
    f" endpoints ' || {_LOGIN_RATE} || '(status: ' || breakdown || ')' AS detail, '' AS example FROM actors WHERE login_posts >= 30\n"
    "UNION ALL SELECT ip, 'login_success', 0, CAST(login_posts AS VARCHAR) || ' login POSTs, ' || CAST(login_burst AS VARCHAR)"
    " || ' of them inside 24 h, then ' || CAST(admin_ok AS VARCHAR) || ' request(s) to the admin backend answered 2xx"
    f" — a page an unauthenticated session does not get. Verify!', '' FROM actors WHERE {_SUCCESS}\n"
    "UNION ALL SELECT ip, 'upload_php', 0, "
    + _of("upload_php", "request(s) for PHP in upload/cache directories were answered 2xx", " — access to a dropped shell?")
    + ", upload_php_example FROM actors WHERE upload_php_ok > 0\n"
    "UNION ALL SELECT ip, 'cms_dir_php', 0, "
    + _of("cms_dir_php", "request(s) for a PHP file lying directly in templates/, modules/, plugins/ or components/ were answered 2xx",
          " — the CMS ships nothing at that depth")
    + ", cms_dir_php_example FROM actors WHERE cms_dir_php_ok > 0\n"
    "UNION ALL SELECT ip, 'sqli', 1, " + _of("sqli", "SQL injection patterns in URIs were answered 2xx")
    + ", sqli_example FROM actors WHERE sqli_ok > 0\n"
    "UNION ALL SELECT ip, 'traversal', 1, " + _of("traversal", "path traversal patterns were answered 2xx")
    + ", traversal_example FROM actors WHERE traversal_ok > 0\n"
    "UNION ALL SELECT ip, 'scanner_ua', 3, 'UA: ' || agent, '' FROM scan_uas)"
)


def sql(body: str, upto: str = "req", more: str = "") -> str:
    """A check query over the derived evidence: ``upto`` names the last step it needs."""
    steps = {"req": [_REQ], "flagged": [_REQ, _FLAGS], "actors": [_REQ, _FLAGS, _ACTORS],
             "alerts": [_REQ, _FLAGS, _ACTORS, _ALERTS]}[upto]
    parts = steps + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n" + body


def files(spark: SparkSession, sf: str) -> DataFrame:
    """`pages` as web-root files: path, root, length, content bytes."""
    rows = _apply(table(spark, sf, "pages"), _FILE_LAYERS)
    content = F.col("text").cast("binary")
    return computed_once(rows.select("path", F.lit("/srv/copy").alias("root"), F.length(content).cast("long").alias("length"),
                                     content.alias("content")))


FILES_SQL = _ctes("files_raw", "pages", _FILE_LAYERS) + (
    ",\nfiles AS (SELECT *, lower(split_part(path, '/', -1)) AS base, substr(path, 10) AS site FROM files_raw)")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """`customer` as the rows of a user table."""
    return _apply(spread(table(spark, sf, "customer"), "c_custkey"), _ACCOUNT_LAYERS)


ACCOUNTS_SQL = _ctes("acc", "customer", _ACCOUNT_LAYERS)
