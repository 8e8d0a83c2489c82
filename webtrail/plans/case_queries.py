"""Queries over exports, accounts, findings, decisions, indicators and the chronology."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtrail.functions import indicators as ind, times
from webtrail.functions.text import computed_once, fingerprint
from webtrail.operators import (
    accounts as account_ops, actors, alerts, chronology, dumps, findings as finding_ops, hunt,
    iocs, report, search, touches, webroot,
)
from webtrail.plans import bindings as b, file_queries, log_queries
from webtrail.plans.registry import query
from webtrail.sinks import exports

# --- stored tables of the case ---------------------------------------------------


def index(spark, sf):
    """The stored requests with their flags."""
    return b.stored(spark, sf, "requests", lambda: actors.flagged(b.requests(spark, sf)))


def actor_rows(spark, sf):
    return b.stored(spark, sf, "actors", lambda: actors.actor_table(index(spark, sf)))


def alert_rows(spark, sf):
    return b.stored(spark, sf, "alerts", lambda: alerts.alerts(index(spark, sf), actor_rows(spark, sf)))


def account_table(spark, sf):
    return b.stored(spark, sf, "accounts", lambda: account_ops.accounts(account_rows(spark, sf)))


# --- exports --------------------------------------------------------------------


def _quoted(column):
    escaped = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def _post_text():
    """A page as a value with everything that can break a reader: a line break, a free
    looking ``;``, quotes, a backslash before a letter, nested brackets."""
    return F.concat(F.col("html"), F.lit("\nx;y 'q' C:\\new (a, b);"), F.when(F.col("page_id") % 2 == 0, "''").otherwise(""))


_POST_SQL = "html || chr(10) || 'x;y ''q'' C:\\new (a, b);' || CASE WHEN page_id % 2 = 0 THEN '''''' ELSE '' END"


def _as_lines(pages, dump, statement, every=20):
    """A text of each page as lines of a dump, in blocks of a few pages."""
    lines = computed_once(pages.select("page_id", F.split(statement, "\n").alias("l"))).select("page_id", F.posexplode("l").alias("i", "value"))
    return lines.select(F.lit(dump).alias("dump"), F.floor(F.col("page_id") / every).cast("long").alias("block"),
                        (F.col("page_id") * 100000 + F.col("i")).alias("pos"), "value")


_CALLS = "NOW(a(b(c(d(e(f(g(h(i(j(k(1, 2))))))))))))"


def dump_lines(spark, sf):
    """`pages` as the lines of two exports: one as a tool writes it, its statements over lines and
    blocks, and one with comments of every kind, both quotes, nested calls and several or indented
    INSERTs in a line."""
    pages = computed_once(b.table(spark, sf, "pages").select("page_id", "url", "html", _post_text().alias("text")))
    page = F.col("page_id").cast("string")
    tool = F.concat(
        F.when(F.col("page_id") == 0, "-- MySQL dump 10.13\n-- It's a comment; Host: localhost\nCREATE TABLE `wp_posts` (\n  `ID` bigint,\n"
               "  `post_content` longtext COMMENT 'a, (b)', -- it's; one\n  `guid` varchar(255),\n  PRIMARY KEY (`ID`, `guid`)\n);\n").otherwise(""),
        F.lit("INSERT INTO `wp_posts` VALUES\n("), page, F.lit(","), _quoted(F.col("text")), F.lit(","),
        _quoted(F.col("url")), F.lit("),\n("), page, F.lit(",NULL,'it''s');"))
    double = F.concat(F.lit('"'), F.replace(F.replace("html", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    mixed = F.concat(
        F.lit("/* it's page "), page, F.lit("; \" ( */ INSERT INTO `notes` VALUES ("), page, F.lit(",\"it's; \\\"x\\\" \"\"y\"\"\"," + _CALLS + ");INSERT INTO `marks` (`id`, `t`) VALUES ("),
        page, F.lit(",'a;b'); -- don't; stop\n   INSERT INTO `notes` VALUES ("), page, F.lit(", "), double, F.lit(", NULL) # it's \"the\" end;\n/* one;\n' two */  ,("),
        page, F.lit(",'x', \"\");"))
    return _as_lines(pages, "/dumps/site.sql", tool).unionAll(_as_lines(pages, "/dumps/mixed.sql", mixed, 7))


def dump_statements(spark, sf):
    return dumps.statements(dump_lines(spark, sf), lambda df, name: b.stored(spark, sf, f"dump_{name}", lambda: df))


def dump_inserts(spark, sf):
    return b.stored(spark, sf, "dump_inserts", lambda: dumps.insert_rows(dump_statements(spark, sf)))


@query("dump_rows", "S9 P29 B10 A28 W5", f"""SELECT '/dumps/site.sql' AS dump, 'wp_posts' AS "table", row_number() OVER (ORDER BY page_id, k) AS row_no, 'ID,post_content,guid' AS columns,
 CAST(page_id AS VARCHAR) AS v1, CASE k WHEN 0 THEN {_POST_SQL} END AS v2, CASE k WHEN 0 THEN url ELSE 'it''s' END AS v3
 FROM pages, (VALUES (0), (1)) t(k)
UNION ALL SELECT '/dumps/mixed.sql', 'notes', row_number() OVER (ORDER BY page_id, k), 'col1,col2,col3',
 CAST(page_id AS VARCHAR), CASE k WHEN 0 THEN 'it''s; "x" "y"' WHEN 1 THEN html ELSE 'x' END, CASE k WHEN 0 THEN '{_CALLS}' WHEN 2 THEN '' END FROM pages, (VALUES (0), (1), (2)) t(k)
UNION ALL SELECT '/dumps/mixed.sql', 'marks', row_number() OVER (ORDER BY page_id), 'id,t', CAST(page_id AS VARCHAR), 'a;b', NULL FROM pages""")
def dump_rows(spark, sf):
    rows = dumps.dump_rows(dump_inserts(spark, sf), dumps.created_columns(dump_statements(spark, sf)))
    return rows.select("dump", "table", "row_no", F.array_join("columns", ",").alias("columns"),
                       F.col("values")[0].alias("v1"), F.col("values")[1].alias("v2"), F.get("values", F.lit(2)).alias("v3"))


@query("dump_inventory", "A27 S10", """SELECT '/dumps/site.sql' AS dump, 'wp_posts' AS "table", 2 * count(*) AS rows, 3 AS columns, count(*) + 1 AS statements FROM pages
UNION ALL SELECT '/dumps/mixed.sql', 'notes', 3 * count(*), 0, 3 * count(*) FROM pages UNION ALL SELECT '/dumps/mixed.sql', 'marks', count(*), 0, 3 * count(*) FROM pages""")
def dump_inventory(spark, sf):
    statements = dump_statements(spark, sf)
    table = dumps.inventory(statements, dump_inserts(spark, sf), dumps.created_columns(statements))
    return table.select("dump", "table", "rows", "columns", "statements")


@query("broken_dumps", "S9 K10", """SELECT dump, (CASE dump WHEN '/dumps/value.sql' THEN 1 ELSE 2 END * count(*))::BIGINT AS stmt_no, reason, (CASE dump WHEN '/dumps/value.sql' THEN 1 ELSE 2 END * count(*))::BIGINT AS rows
 FROM pages, (VALUES ('/dumps/value.sql', 'unclosed value'), ('/dumps/note.sql', 'unclosed comment')) t(dump, reason) GROUP BY dump, reason""")
def broken_dumps(spark, sf):
    """Exports that end inside a value and inside a comment: what was whole is read, the rest is
    reported."""
    pages = b.table(spark, sf, "pages").select("page_id", "html")
    row = F.concat(F.lit("INSERT INTO `b` VALUES ("), F.col("page_id"), F.lit(","), _quoted(F.col("html")), F.lit(");"))
    last = b.table(spark, sf, "pages").groupBy().agg(F.max("page_id").alias("page_id"))
    tail = lambda text: last.select((F.col("page_id") + 1).alias("page_id"), F.lit(text).alias("line"))
    part = lambda dump, text, rows: _as_lines(rows.unionByName(tail(text)), dump, F.col("line"))
    lines = part("/dumps/value.sql", "INSERT INTO `b` VALUES (1,'; it\\'s", pages.select("page_id", row.alias("line"))).unionAll(
        part("/dumps/note.sql", "/* it's; INSERT INTO `b` VALUES (1);", pages.select("page_id", F.concat(row, row).alias("line"))))
    read = dumps.insert_rows(dumps.statements(lines)).groupBy("dump").agg(F.count("values").alias("rows"))
    return dumps.unclosed(lines).join(read, "dump").select("dump", "stmt_no", "reason", "rows")


def account_lines(spark, sf):
    """`customer` as single-line INSERT statements of a WordPress user table."""
    a = b.accounts(spark, sf)
    cells = [F.col("user_id"), _quoted(F.col("login")), _quoted(F.col("pass")), F.lit("'n'"), _quoted(F.col("email")), F.lit("''"),
             _quoted(F.col("registered")), F.lit("''"), F.col("status"), _quoted(F.lit("A \\ B; (c)"))]
    value = F.concat(F.lit("INSERT INTO `wp_users` (`ID`, `user_login`, `user_pass`, `user_nicename`, `user_email`, `user_url`,"
                           " `user_registered`, `user_activation_key`, `user_status`, `display_name`) VALUES ("),
                     F.concat_ws(",", *cells), F.lit(");"))
    pos = F.col("user_id").cast("long")
    return computed_once(a.select(F.lit("/dumps/users.sql").alias("dump"), F.coalesce(F.floor(pos / 1000).cast("long"), F.lit(0)).alias("block"),
                                  pos.alias("pos"), value.alias("value")))


@query("dump_rows_by_line", "S9 P29 B10", f"""WITH {b.ACCOUNTS_SQL}
SELECT 'wp_users' AS "table", user_id AS v1, login AS v2, pass AS v3, email AS v5, registered AS v7, 'A \\ B; (c)' AS v10, 10 AS width FROM acc""")
def dump_rows_by_line(spark, sf):
    lines = account_lines(spark, sf)
    rows = dumps.insert_rows(dumps.statements(lines))
    v = F.col("values")
    return rows.select("table", v[0].alias("v1"), v[1].alias("v2"), v[2].alias("v3"), v[4].alias("v5"), v[6].alias("v7"),
                       v[9].alias("v10"), F.size("values").alias("width"))


def injected_rows(spark, sf):
    """`pages` and `documents` as rows of content tables, some with seeded values."""
    seed = (F.when(F.col("k") == 0, "<?php echo 1;").when(F.col("k") == 1, "x eval(base64_decode('a'))")
            .when(F.col("k") == 2, "gzinflate( str_rot13(1))").when(F.col("k") == 3, "a system (1)")
            .when(F.col("k") == 4, "create_function('a')").when(F.col("k") == 5, "<iframe src=\"//zaehler.example.test/t\">")
            .when(F.col("k") == 6, "document . write(1)").when(F.col("k") == 7, "abc").otherwise("plain"))
    pages = b.table(spark, sf, "pages").select(
        F.lit("/dumps/a.sql").alias("dump"), F.lit("wp_posts").alias("table"), F.col("page_id").alias("row_no"), F.col("html").alias("t"),
        (F.col("page_id") % 9).alias("k"))
    docs = b.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, "/dumps/a.sql").otherwise("/dumps/b.sql").alias("dump"), F.lit("wp_comments").alias("table"),
        F.floor(F.col("doc_id") / 2).cast("long").alias("row_no"), F.col("text").alias("t"), (F.floor(F.col("doc_id") / 2) % 9).alias("k"))
    both = pages.unionAll(docs)
    return computed_once(both.select("dump", "table", "row_no", F.array(F.lit("ID"), F.lit("body"), F.lit("extra")).alias("columns"),
                                     F.array(F.col("row_no").cast("string"), F.col("t"), seed).alias("values")))


_INJ = r"""vals AS (SELECT '/dumps/a.sql' AS dump, 'wp_posts' AS tbl, page_id AS row_no, html AS t, page_id % 9 AS k FROM pages
 UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN '/dumps/a.sql' ELSE '/dumps/b.sql' END, 'wp_comments', doc_id // 2, text, (doc_id // 2) % 9 FROM documents),
cells AS (SELECT dump, tbl, row_no, t AS v FROM vals UNION ALL SELECT dump, tbl, row_no, CASE k WHEN 0 THEN '<?php echo 1;' WHEN 1 THEN 'x eval(base64_decode(''a''))'
 WHEN 2 THEN 'gzinflate( str_rot13(1))' WHEN 3 THEN 'a system (1)' WHEN 4 THEN 'create_function(''a'')' WHEN 5 THEN '<iframe src="//zaehler.example.test/t">'
 WHEN 6 THEN 'document . write(1)' WHEN 7 THEN 'abc' ELSE 'plain' END FROM vals),
rx AS (SELECT *, CASE WHEN regexp_matches(v, '<\?php|<\?=') THEN 0
 WHEN regexp_matches(v, '(?i)\b(eval|assert)\s*\(\s*(base64_decode|gzinflate|gzuncompress|str_rot13|\$_)') THEN 1
 WHEN regexp_matches(v, '(?i)(base64_decode|gzinflate|gzuncompress|str_rot13)\s*\(\s*(base64_decode|gzinflate|str_rot13|[''"])') THEN 2
 WHEN regexp_matches(v, '(?i)\b(system|shell_exec|passthru|proc_open|popen|pcntl_exec)\s*\(') THEN 3
 WHEN regexp_matches(v, '(?i)create_function\s*\(') THEN 4 WHEN regexp_matches(v, '(?i)<script[\s>]') THEN 5
 WHEN regexp_matches(v, '(?i)<iframe[\s>]') THEN 6 WHEN regexp_matches(v, '(?i)document\s*\.\s*write\s*\(') THEN 7 END AS n FROM cells),
rn(n, rule_id, severity, rule, pat) AS (VALUES (0, 'sqldb.php_tag', 0, 'PHP open tag in database value', '<\?php|<\?='),
 (1, 'sqldb.eval_input', 0, 'eval/assert on decoded or request input', '(?i)\b(eval|assert)\s*\(\s*(base64_decode|gzinflate|gzuncompress|str_rot13|\$_)'),
 (2, 'sqldb.obfuscation', 0, 'Obfuscation decode chain', '(?i)(base64_decode|gzinflate|gzuncompress|str_rot13)\s*\(\s*(base64_decode|gzinflate|str_rot13|[''"])'),
 (3, 'sqldb.cmd_call', 0, 'Command execution call in database value', '(?i)\b(system|shell_exec|passthru|proc_open|popen|pcntl_exec)\s*\('),
 (4, 'sqldb.create_function', 0, 'create_function / dynamic callback', '(?i)create_function\s*\('),
 (5, 'sqldb.script', 1, 'Inline <script> in database value', '(?i)<script[\s>]'),
 (6, 'sqldb.iframe', 1, 'Injected <iframe> in database value', '(?i)<iframe[\s>]'),
 (7, 'sqldb.document_write', 1, 'document.write (script injection)', '(?i)document\s*\.\s*write\s*\(')),
dhit AS (SELECT dump, tbl, row_no, rule_id, severity, rule, v, regexp_extract(v, pat) AS m, instr(v, regexp_extract(v, pat)) AS p FROM rx JOIN rn USING (n)),
hits AS (SELECT dump, tbl AS "table", row_no, rule_id, severity, rule, substr(translate(CASE WHEN p > 71 THEN '…' ELSE '' END ||
 substr(v, greatest(1, p - 70), least(length(v) + 1, p + length(m) + 70) - greatest(1, p - 70)) ||
 CASE WHEN p + length(m) + 70 <= length(v) THEN '…' ELSE '' END, chr(10) || chr(13), '  '), 1, 200) AS evidence FROM dhit)"""


@query("injected_values", "B1 B2 B3 B4 B5 B6 B7 B8 P33", f"WITH {_INJ}\nSELECT * FROM hits")
def injected_values(spark, sf):
    return dumps.value_findings(injected_rows(spark, sf))


_DFINDS = _INJ + """,
dfinds AS (SELECT 'sqldb' AS source, severity, rule, rule_id, 'table' AS artifact_kind, "table" AS artifact, row_no AS line, 'sqldump' AS engine,
 substr(sha1('sqldb' || chr(31) || rule || chr(31) || "table" || chr(31) || CASE WHEN row_no = 0 THEN '' ELSE CAST(row_no AS VARCHAR) END), 1, 16) AS fingerprint,
 substr(min(evidence) || ' · ' || string_agg(DISTINCT 'dump: ' || split_part(dump, '/', -1), ', ' ORDER BY 'dump: ' || split_part(dump, '/', -1)), 1, 400) AS evidence
 FROM hits GROUP BY ALL)"""


@query("injected_findings", "B9 P32", f"WITH {_DFINDS}\nSELECT * FROM dfinds")
def injected_findings(spark, sf):
    return dumps.findings(dumps.value_findings(injected_rows(spark, sf)))


# --- accounts -------------------------------------------------------------------


def account_rows(spark, sf):
    """`customer` as the user tables of three systems: WordPress, Joomla and one whose
    layout only its column names tell."""
    a = computed_once(b.accounts(spark, sf))
    n = F.col("user_id").cast("long")
    last = F.when(n % 3 == 0, "0000-00-00 00:00:00").otherwise("2024-01-20 10:00:00")
    text = lambda c: F.lit(c)
    tables = [
        ("/dumps/wp.sql", "wp_users", "ID user_login user_pass user_nicename user_email user_url user_registered user_activation_key user_status display_name",
         [F.col("user_id"), F.col("login"), F.col("pass"), text("n"), F.col("email"), text(""), F.col("registered"), text(""), F.col("status"), text("D")]),
        ("/dumps/wp.sql", "wp_usermeta", "umeta_id user_id meta_key meta_value",
         [F.col("user_id"), F.col("user_id"), F.when(F.col("group_id") == "8", "wp_capabilities").when(n % 5 == 0, "session_tokens").otherwise("last_login"),
          F.when(F.col("group_id") == "8", 'a:1:{s:13:"administrator";b:1;}').when(n % 5 == 0, "x").otherwise((n * 1000 + b.T0).cast("string"))]),
        ("/dumps/joomla.sql", "jos_users", "id name username email password block sendEmail registerDate lastvisitDate",
         [F.col("user_id"), text("N"), F.col("login"), F.col("email"), F.col("pass"), F.col("status"), text("0"), F.col("registered"), last]),
        ("/dumps/joomla.sql", "jos_user_usergroup_map", "user_id group_id", [F.col("user_id"), F.col("group_id")]),
        ("/dumps/joomla.sql", "jos_content", "id title", [F.col("user_id"), text("t")]),
        ("/dumps/other.sql", "site_people", "uid nick e_mail pwd crdate last_access active",
         [F.col("user_id"), F.col("login"), F.col("email"), F.col("pass"), F.col("registered"), last, F.col("status")]),
        ("/dumps/other.sql", "orders", "id name email total", [F.col("user_id"), F.col("login"), F.col("email"), text("1")]),
    ]
    out = None
    for dump, table, columns, values in tables:
        part = a.select(F.lit(dump).alias("dump"), F.lit(table).alias("table"), (n + 1).alias("row_no"),
                        F.array(*[F.lit(c) for c in columns.split()]).alias("columns"), F.array(*values).alias("values"))
        out = part if out is None else out.unionAll(part)
    return out


_SCHEME = ("CASE WHEN starts_with(pass, '$2y$') THEN 'bcrypt' WHEN starts_with(pass, '$P$') THEN 'phpass' WHEN starts_with(pass, '$wp$') THEN 'wp-hash'"
           " WHEN starts_with(pass, '$argon') THEN 'argon2' WHEN regexp_matches(pass, '^[0-9a-f]{32}$') THEN 'md5 (weak!)' ELSE 'other' END")
_ACCOUNTS = b.ACCOUNTS_SQL + f""",
base AS (SELECT *, CAST(user_id AS BIGINT) AS n, {_SCHEME} AS scheme, CASE WHEN registered LIKE '0000%' THEN '-' ELSE registered END AS reg,
 CASE WHEN email = '' THEN '-' ELSE email END AS mail FROM acc),
accounts AS (
 SELECT '/dumps/wp.sql' AS dump, 'wp_users' AS "table", n + 1 AS row_no, 'WordPress' AS cms, user_id, login, mail AS email,
  CASE WHEN email = '' THEN CASE WHEN registered LIKE '0000%' THEN '-' ELSE registered END ELSE reg END AS registered,
  CASE WHEN email = '' THEN CASE WHEN starts_with(pass, '$') THEN scheme ELSE '-' END ELSE scheme END AS hash_type, group_id = '8' AS admin,
  CASE WHEN group_id <> '8' AND n % 5 <> 0 THEN strftime(make_timestamp(({b.T0} + n * 1000) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS last_login,
  CASE WHEN email <> '' AND status = '1' THEN 1 ELSE 0 END AS blocked, CASE WHEN group_id <> '8' AND n % 5 = 0 THEN 1 ELSE 0 END AS sessions FROM base
 UNION ALL SELECT '/dumps/joomla.sql', 'jos_users', n + 1, 'Joomla', user_id, login, mail, reg, scheme, group_id = '8',
  CASE WHEN n % 3 = 0 THEN '' ELSE '2024-01-20 10:00:00' END, CASE WHEN status = '1' THEN 1 ELSE 0 END, 0 FROM base
 UNION ALL SELECT '/dumps/other.sql', 'site_people', n + 1, 'unknown', user_id, login, mail, CASE WHEN reg = '-' THEN '-' ELSE reg END, scheme, false,
  CASE WHEN n % 3 = 0 THEN '' ELSE '2024-01-20 10:00:00' END, CASE WHEN status = '1' THEN 0 ELSE 1 END, 0 FROM base),
refd AS (SELECT max(registered) AS r FROM accounts WHERE registered <> '-'),
sig AS (SELECT a.*, array_to_string(list_filter([CASE WHEN admin THEN 'admin' END,
 CASE WHEN registered <> '-' AND date_diff('second', CAST(registered AS TIMESTAMP), CAST(r AS TIMESTAMP)) // 86400 BETWEEN 0 AND 30 THEN 'young' END,
 CASE WHEN contains(hash_type, 'weak') THEN 'weak_hash' END, CASE WHEN admin AND last_login = '' AND cms = 'Joomla' THEN 'never' END,
 CASE WHEN sessions > 0 THEN 'session' END, CASE WHEN blocked > 0 THEN 'blocked' END], lambda x: x IS NOT NULL), ', ') AS signals FROM accounts a, refd),
ranked AS (SELECT *, CASE WHEN admin THEN 4 ELSE 0 END + CASE WHEN contains(signals, 'young') THEN 3 ELSE 0 END + CASE WHEN contains(signals, 'weak') THEN 1 ELSE 0 END
 + CASE WHEN contains(signals, 'never') THEN 2 ELSE 0 END + CASE WHEN sessions > 0 THEN 2 ELSE 0 END AS rank FROM sig)"""


@query("accounts", "B13 B14 B15 B16 B17 B18 J14 P27 P28", f"WITH {_ACCOUNTS}\nSELECT * FROM accounts")
def all_accounts(spark, sf):
    return account_ops.accounts(account_rows(spark, sf))


def _signalled(spark, sf):
    found = account_table(spark, sf)
    return account_ops.with_signals(found, account_ops.reference_seconds(found))


@query("account_signals", "B19 T8 P16", f"""WITH {_ACCOUNTS}
SELECT dump, user_id, login, cms, signals, rank FROM ranked ORDER BY rank DESC, cms, lower(login), dump, user_id LIMIT 200""")
def account_signals(spark, sf):
    return _signalled(spark, sf).orderBy(*account_ops.account_order()).limit(200).select(
        "dump", "user_id", "login", "cms", F.array_join("signals", ", ").alias("signals"), "rank")


@query("account_csv", "K7 P30", f"""WITH {_ACCOUNTS}
SELECT login AS "Login", email AS "E-mail", 'administrator' AS "Role", cms AS "CMS", "table" AS "Table", registered AS "Registered",
 last_login AS "Last login", hash_type AS "Hash scheme", CASE WHEN blocked > 0 THEN 'yes' ELSE 'no' END AS "Blocked", signals AS "Conspicuous"
 FROM ranked WHERE admin""")
def account_csv(spark, sf):
    return exports.account_cells(_signalled(spark, sf), admins_only=True)


@query("account_indicators", "B20 U7", f"""WITH {_ACCOUNTS},
mine AS (SELECT * FROM accounts WHERE cms = 'Joomla' AND admin)
SELECT login AS value, 'user' AS type, 'account,analyst' AS tags, 'marked by the analyst — Joomla account from jos_users (administrator)' AS origin FROM mine
UNION ALL SELECT email, 'email', 'analyst,derived', 'e-mail of account ' || login FROM mine""")
def account_indicators(spark, sf):
    chosen = account_table(spark, sf).filter("cms = 'Joomla' and admin")
    rows, _ = iocs.flag_accounts(chosen, 1)
    return rows.select("value", "type", F.array_join(F.array_sort("tags"), ",").alias("tags"), "origin")


_TABLES = """tabs(dump, tbl) AS (VALUES ('/dumps/wp.sql', 'wp_users'), ('/dumps/wp.sql', 'wp_usermeta'), ('/dumps/joomla.sql', 'jos_users'),
 ('/dumps/joomla.sql', 'jos_user_usergroup_map'), ('/dumps/joomla.sql', 'jos_content'), ('/dumps/other.sql', 'site_people'), ('/dumps/other.sql', 'orders'))"""


@query("dump_cms", "B12 P40", """SELECT dump, cms FROM (VALUES ('/dumps/wp.sql', 'WordPress'), ('/dumps/joomla.sql', 'Joomla'), ('/dumps/other.sql', '')) t(dump, cms)
 WHERE (SELECT count(*) FROM customer) > 0""")
def dump_cms(spark, sf):
    found = dumps.cms_of(account_rows(spark, sf).select("dump", "table").distinct())
    return found.select("dump", F.array_join("cms", ",").alias("cms"))


#: Exports of every kind: with a header, shipped with an extension, with the placeholder in names,
#: with the placeholder in values only, with the placeholder in names but a header, and without rows.
_KINDS = (("/dumps/export.sql", "-- MySQL dump 10.13", "jos_users"), ("/web/com_x/sql/install.sql", "-- Notes", "jos_ext"), ("/dumps/template.sql", "-- Notes", "#__users"),
          ("/dumps/plain.sql", "-- Notes", "notes"), ("/web/com_x/sql/update.sql", "-- Server version: 8.0.36", "#__menu"))


def kind_lines(spark, sf):
    """`customer` as rows of exports of each kind, `nation` as tables without rows."""
    customer = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), "c_name")
    value = F.concat(F.lit(",'"), F.col("c_name"), F.lit(" in #__content');"))
    lines = None
    for dump, first, table in _KINDS:
        top = F.when(F.col("page_id") == 1, f"{first}\n").otherwise("")
        part = _as_lines(customer, dump, F.concat(top, F.lit(f"INSERT INTO `{table}` VALUES ("), F.col("page_id"), value), 1000)
        lines = part if lines is None else lines.unionAll(part)
    empty = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("page_id"))
    return lines.unionAll(_as_lines(empty, "/dumps/empty.sql", F.concat(F.lit("CREATE TABLE `t"), F.col("page_id"), F.lit("` (`a` int, `b` text);"))))


@query("database_view", "N17 J15 A30 B11", """WITH n AS (SELECT count(*)::BIGINT AS n FROM customer)
SELECT dump, kind, 1::BIGINT AS tables, n AS rows, flagged FROM n, (VALUES ('/dumps/export.sql', 'export', 5), ('/web/com_x/sql/install.sql', 'schema', 0), ('/dumps/template.sql', 'schema', 0),
 ('/dumps/plain.sql', 'export', 0), ('/web/com_x/sql/update.sql', 'export', 0)) t(dump, kind, flagged)
UNION ALL SELECT '/dumps/empty.sql', 'schema', count(*), 0, 0 FROM nation""")
def database_view(spark, sf):
    lines = kind_lines(spark, sf)
    statements = dumps.statements(lines, lambda df, name: b.stored(spark, sf, f"kind_{name}", lambda: df))
    # The first lines of a dump are those of its first text, whose page_id is 1.
    heads = lines.filter(F.floor(F.col("pos") / 100000) == 1).select("dump", (F.col("pos") % 100000).alias("line_no"), "value")
    tables = dumps.kinds(heads, dumps.insert_rows(statements), dumps.created_columns(statements))
    arts = tables.filter(F.col("table") == "jos_users").select(
        F.col("table").alias("artifact"), F.lit("table").alias("artifact_kind"), F.lit(5).alias("findings"), F.lit(0).alias("worst"), F.lit("new").alias("triage"))
    return account_ops.database_view(tables, arts)


@query("dump_totals", "A30", f"""WITH {_ACCOUNTS}, {_TABLES}
SELECT 3 AS dumps, 0 AS schema_files, 7 AS tables, (7 * (SELECT count(*) FROM customer))::BIGINT AS rows, count(*) AS accounts,
 count(*) FILTER (WHERE admin) AS admins FROM accounts""")
def dump_totals(spark, sf):
    rows = account_rows(spark, sf)
    tables = rows.groupBy("dump", "table").agg(F.count(F.lit(1)).alias("rows"))
    kinds = tables.groupBy("dump").agg(F.sum("rows").alias("n")).select("dump", dumps.kind_of_dump(
        F.col("dump"), [F.lit("")], F.lit(False), F.col("n")).alias("kind"))
    return account_ops.dump_totals(kinds, tables, account_table(spark, sf))


# --- findings and decisions -----------------------------------------------------

RUNS = [("logindex", 1, True), ("webshell", 2, True), ("sqldump", 3, True), ("logindex", 4, True), ("webshell", 5, False)]
NOW = 1_700_000_000


def found(spark, sf):
    """Findings of the three engines over the derived evidence."""
    return (alerts.findings_from_alerts(alert_rows(spark, sf)),
            b.stored(spark, sf, "file_findings", lambda: webroot.findings(b.files(spark, sf))),
            dumps.findings(dumps.value_findings(injected_rows(spark, sf))))


def stored_findings(spark, sf):
    """The findings table after its runs, each a new version of the table. The second run
    over the logs had the SQL injection rule switched off, and so retires what that rule
    had found."""
    logs, files, tables = found(spark, sf)
    first = b.stored(spark, sf, "findings_v1", lambda: finding_ops.upsert(finding_ops.empty_findings(spark), logs, 1, NOW))
    second = b.stored(spark, sf, "findings_v2", lambda: finding_ops.upsert(first, files.unionByName(tables), 2, NOW))
    again = logs.filter("rule_id <> 'logs.sqli'").withColumn("evidence", F.concat("evidence", F.lit(" (again)")))
    return b.stored(spark, sf, "findings_v3", lambda: finding_ops.upsert(second, again, 4, NOW + 100))


def decisions(findings):
    """Decisions derived from the artifacts' own names."""
    a = F.col("artifact")
    state = (F.when(a.startswith("10.0.") | a.contains("/images/") | (a == "wp_posts"), "confirmed")
             .when(a.startswith("45.12.") | a.contains("/lib/"), "dismissed").when(a.startswith("91.20."), "reviewed"))
    note = F.when(a.startswith("10.0."), F.concat(F.lit("seen "), a))
    return findings.select("artifact").distinct().withColumns({"state": state, "note": note}).filter("state is not null")


def case(spark, sf):
    """(findings, completed runs, artifacts) of the derived case after its decisions."""
    undecided = stored_findings(spark, sf)
    rows = b.stored(spark, sf, "findings_v4", lambda: finding_ops.decide(undecided, decisions(undecided), NOW + 200))
    done = finding_ops.completed_runs(spark.createDataFrame(RUNS, "engine string, run long, completed boolean"))
    return rows, done, finding_ops.artifacts(rows, done)


_STORED = log_queries.ALERT_FINDINGS_SQL + ",\n" + file_queries.FILE_FINDINGS_SQL + ",\n" + _DFINDS + f""",
every AS (SELECT fingerprint, source, severity, rule, rule_id, artifact_kind, artifact, line, evidence, engine FROM finds
 UNION ALL SELECT fingerprint, source, severity, rule, rule_id, artifact_kind, artifact, line, evidence, engine FROM ffinds
 UNION ALL SELECT fingerprint, source, severity, rule, rule_id, artifact_kind, artifact, line, evidence, engine FROM dfinds),
onerow AS (SELECT fingerprint, source, severity, rule, rule_id, artifact_kind, artifact, line, max(evidence) AS evidence, engine FROM every GROUP BY ALL),
stored AS (SELECT fingerprint, source, severity, rule, rule_id, artifact_kind, artifact, line,
 CASE WHEN engine = 'logindex' AND rule_id <> 'logs.sqli' THEN evidence || ' (again)' ELSE evidence END AS evidence, {NOW} AS created,
 CASE WHEN engine = 'logindex' AND rule_id <> 'logs.sqli' THEN {NOW + 100} ELSE {NOW} END AS last_seen,
 CASE WHEN starts_with(artifact, '10.0.') OR contains(artifact, '/images/') OR artifact = 'wp_posts' THEN 'confirmed'
  WHEN starts_with(artifact, '45.12.') OR contains(artifact, '/lib/') THEN 'dismissed' WHEN starts_with(artifact, '91.20.') THEN 'reviewed' ELSE 'new' END AS triage,
 CASE WHEN starts_with(artifact, '10.0.') THEN 'seen ' || artifact ELSE '' END AS triage_note, engine,
 CASE engine WHEN 'webshell' THEN 2 WHEN 'sqldump' THEN 2 ELSE CASE WHEN rule_id = 'logs.sqli' THEN 1 ELSE 4 END END AS seen_run FROM onerow),
lively AS (SELECT *, seen_run >= CASE engine WHEN 'logindex' THEN 4 WHEN 'webshell' THEN 2 ELSE 3 END AS live FROM stored),
arts AS (SELECT artifact, min(artifact_kind) AS artifact_kind, coalesce(min(severity) FILTER (WHERE live), min(severity)) AS worst,
 min(source) AS source, count(*) FILTER (WHERE live) AS findings, count(*) FILTER (WHERE NOT live) AS retired,
 count(*) FILTER (WHERE live AND rule_id NOT IN ('logs.scanner_ua', 'webshell.standalone_exec')) AS active,
 max(triage_note) AS triage_note, max(last_seen) AS last_seen, max(triage) AS triage FROM lively GROUP BY artifact)"""
_STORED_COLUMNS = ("fingerprint, source, severity, rule, rule_id, artifact_kind, artifact, line, evidence, created, last_seen, triage,"
                   " triage_note, engine, seen_run")


@query("stored_findings", "K2 N2 N4 F24 U7", b.sql(f"SELECT {_STORED_COLUMNS} FROM stored", "alerts", _STORED))
def stored(spark, sf):
    return case(spark, sf)[0].select(*_STORED_COLUMNS.split(", "))


MUTED = ["logs.scanner_ua", "webshell.standalone_exec"]


def _muted_case(spark, sf):
    rows, done, _ = case(spark, sf)
    return rows, finding_ops.artifacts(rows, done, MUTED)


@query("artifact_fold", "A24 N1 N2 F24", b.sql("SELECT * FROM arts", "alerts", _STORED))
def artifact_fold(spark, sf):
    return _muted_case(spark, sf)[1].drop("triaged_at")


@query("facet_counts", "A25", b.sql("""SELECT 'severity' AS facet, CAST(worst AS VARCHAR) AS value, count(*) AS n FROM arts GROUP BY worst
 UNION ALL SELECT 'triage', triage, count(*) FROM arts GROUP BY triage UNION ALL SELECT 'source', source, count(DISTINCT artifact) FROM stored GROUP BY source""", "alerts", _STORED))
def facet_counts(spark, sf):
    rows, arts = _muted_case(spark, sf)
    return finding_ops.facet_counts(arts, rows)


_LISTED = """worst <> 3 AND triage <> 'dismissed' AND artifact IN (SELECT artifact FROM stored WHERE source IN ('logs', 'webshell'))
 AND artifact IN (SELECT artifact FROM stored WHERE contains(lower(rule), '2xx') OR contains(lower(artifact), '2xx') OR contains(lower(evidence), '2xx'))"""
_FILTERS = dict(hide_severity=[3], hide_triage=["dismissed"], sources=["logs", "webshell"], search="2XX")


@query("work_list", "F22 F23 T3", b.sql(f"""SELECT artifact, worst, triage, findings FROM arts WHERE {_LISTED} AND (active > 0 OR triage <> 'new')
 ORDER BY worst, artifact LIMIT 50 OFFSET 3""", "alerts", _STORED))
def work_list(spark, sf):
    rows, arts = _muted_case(spark, sf)
    listed = finding_ops.work_list(arts, rows, **_FILTERS)
    return listed.orderBy("worst", "artifact").offset(3).limit(50).select("artifact", "worst", "triage", "findings")


@query("hidden_counts", "N3 F23", b.sql("""SELECT count(*) FILTER (WHERE shown) AS total, count(*) FILTER (WHERE NOT shown AND findings = 0 AND retired > 0) AS retired_hidden,
 count(*) FILTER (WHERE NOT shown) - count(*) FILTER (WHERE NOT shown AND findings = 0 AND retired > 0) AS muted_hidden
 FROM (SELECT *, active > 0 OR triage <> 'new' AS shown FROM arts)""", "alerts", _STORED))
def hidden_counts(spark, sf):
    rows, arts = _muted_case(spark, sf)
    return finding_ops.hidden_counts(arts, rows)


@query("dashboard", "A32", b.sql("""SELECT 'severity' AS measure, CAST(worst AS VARCHAR) AS value, count(*) AS n FROM arts WHERE triage <> 'dismissed' GROUP BY worst
 UNION ALL SELECT 'triage', triage, count(*) FROM arts GROUP BY triage
 UNION ALL SELECT 'confirmed_kind', artifact_kind, count(*) FROM arts WHERE triage = 'confirmed' GROUP BY artifact_kind
 UNION ALL SELECT 'confirmed_severity', CAST(worst AS VARCHAR), count(*) FROM arts WHERE triage = 'confirmed' GROUP BY worst""", "alerts", _STORED))
def dashboard(spark, sf):
    return finding_ops.dashboard(case(spark, sf)[2])


@query("balanced_preview", "W1", b.sql("""SELECT artifact, artifact_kind, worst, kind_rank FROM (SELECT *, row_number() OVER (PARTITION BY artifact_kind ORDER BY worst, lower(artifact)) AS kind_rank
 FROM arts WHERE triage = 'confirmed') ORDER BY kind_rank, CASE artifact_kind WHEN 'file' THEN 0 WHEN 'table' THEN 1 WHEN 'dump' THEN 2 ELSE 3 END, worst, lower(artifact) LIMIT 6""", "alerts", _STORED))
def balanced_preview(spark, sf):
    return finding_ops.balanced_preview(case(spark, sf)[2])


@query("case_summary", "K11 A32", b.sql("""SELECT count(*) AS findings, count(DISTINCT artifact) AS artifacts, count(DISTINCT artifact) FILTER (WHERE triage = 'confirmed') AS confirmed,
 count(DISTINCT artifact) FILTER (WHERE triage = 'dismissed') AS dismissed,
 (SELECT count(*) FROM (SELECT min(severity) AS w FROM stored WHERE triage <> 'dismissed' GROUP BY artifact) WHERE w = 0) AS severity_0,
 (SELECT count(*) FROM (SELECT min(severity) AS w FROM stored WHERE triage <> 'dismissed' GROUP BY artifact) WHERE w = 1) AS severity_1,
 'logs:/logs, webroot:/srv/copy' AS evidence FROM stored""", "alerts", _STORED))
def case_summary(spark, sf):
    rows = case(spark, sf)[0]
    evidence = spark.createDataFrame([("webroot", "/srv/copy"), ("logs", "/logs")], "kind string, path string")
    box = rows.select(F.col("artifact").alias("value"))
    return finding_ops.case_summary(rows, box, evidence).select(
        "findings", "artifacts", "confirmed", "dismissed", "severity_0", "severity_1", "evidence")


@query("decision_events", "N4", b.sql("""SELECT artifact, artifact_kind, 'new' AS from_state, triage AS to_state, triage_note AS note FROM arts WHERE triage <> 'new'""", "alerts", _STORED))
def decision_events(spark, sf):
    rows = stored_findings(spark, sf)
    done = finding_ops.completed_runs(spark.createDataFrame(RUNS, "engine string, run long, completed boolean"))
    events = finding_ops.decision_events(finding_ops.artifacts(rows, done), decisions(rows), NOW)
    return events.select("artifact", "artifact_kind", "from_state", "to_state", "note")


@query("artifacts_by_fingerprint", "N4", b.sql("""SELECT DISTINCT artifact FROM stored WHERE rule_id = 'logs.traversal' OR artifact = 'wp_posts'""", "alerts", _STORED))
def artifacts_by_fingerprint(spark, sf):
    rows = stored_findings(spark, sf)
    prints = rows.filter("rule_id = 'logs.traversal'").select("fingerprint")
    return finding_ops.artifacts_of(rows, rows.filter("artifact = 'wp_posts'").select("artifact"), prints)


@query("finding_categories", "P43", b.sql("""SELECT source, rule, CASE source WHEN 'logs' THEN CASE WHEN contains(rule, 'upload/cache directory') OR contains(rule, 'CMS extension directory') THEN 'shell_access'
  WHEN contains(rule, 'brute-force') OR contains(rule, 'login POST flood') THEN 'bruteforce' WHEN contains(rule, 'Scanner tool') THEN 'scanner' ELSE 'probes' END
 WHEN 'webshell' THEN CASE WHEN contains(rule, 'Obfuscation decode') OR contains(rule, 'chr() conc') OR contains(rule, 'goto-based') OR contains(rule, 'Hex/octal') THEN 'obfuscation'
  WHEN contains(rule, '.htaccess') THEN 'htaccess' ELSE 'webshell' END
 ELSE CASE WHEN contains(rule, 'Inline <script>') OR contains(rule, 'Injected <iframe>') OR contains(rule, 'document.write') THEN 'db_markup' ELSE 'db_injected' END END AS category,
 count(*) AS n FROM stored GROUP BY ALL""", "alerts", _STORED))
def finding_categories(spark, sf):
    rows = stored_findings(spark, sf)
    return rows.groupBy("source", "rule", ind.finding_category(F.col("source"), F.col("rule")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("fingerprints", "P32", """SELECT doc_id, substr(sha1('yara' || chr(31) || lang || chr(31) || source || chr(31) ||
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END), 1, 16) AS fingerprint FROM documents""")
def fingerprints(spark, sf):
    line = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, 0)).otherwise(F.col("doc_id"))
    return b.table(spark, sf, "documents").select("doc_id", fingerprint(F.lit("yara"), F.col("lang"), F.col("source"), line).alias("fingerprint"))


# --- files and clients ----------------------------------------------------------

_TARGETS = ["/srv/copy/wp-content/uploads/2026/01/KB-Media.php", "/srv/copy/templates/evil.php", "/srv/copy/index.php",
            "/srv/copy/images/stories/x.php", "/srv/copy/plugins/shell.php", "/srv/copy/never/seen.php"]
_ROOTS = ["/srv/copy"]


def target_files(spark):
    return spark.createDataFrame([(t, "file", "new") for t in _TARGETS], "artifact string, artifact_kind string, triage string")


_TOUCH = """targets(artifact) AS (VALUES """ + ", ".join(f"('{t}')" for t in _TARGETS) + """),
met AS (SELECT t.artifact, r.* FROM (SELECT *, lower(trim(split_part(split_part(uri, '?', 1), '#', 1))) AS path FROM req) r
 JOIN (SELECT artifact, lower(substr(artifact, 11)) AS rel FROM targets) t ON CASE WHEN contains(rel, '/') THEN ends_with(path, '/' || rel) ELSE path = '/' || rel END),
touch AS (SELECT artifact, ip, count(*) AS hits, count(*) FILTER (WHERE ok) AS ok_hits, min(epoch) AS first_epoch, max(epoch) AS last_epoch,
 min(epoch) FILTER (WHERE ok) AS first_ok, max(epoch) FILTER (WHERE ok) AS last_ok FROM met GROUP BY artifact, ip)"""


def touched(spark, sf):
    return touches.touches(index(spark, sf), touches.web_files(target_files(spark), _ROOTS))


@query("file_touches", "J4 P6 P8 A23", b.sql("SELECT * FROM touch", "req", _TOUCH))
def file_touches(spark, sf):
    return touched(spark, sf).drop("tz")


@query("file_facts", "A23 J3", b.sql("""SELECT leaf, uri, ip, min(epoch) AS first_epoch, max(epoch) AS last_epoch, max(tz) AS tz, count(*) AS hits,
 count(*) FILTER (WHERE ok) AS ok_hits, min(epoch) FILTER (WHERE ok) AS first_ok, max(epoch) FILTER (WHERE ok) AS last_ok FROM req
 WHERE leaf IN ('kb-media.php', 'evil.php', 'index.php', 'x.php', 'shell.php', 'seen.php') GROUP BY leaf, uri, ip"""))
def file_facts(spark, sf):
    return chronology.file_facts(index(spark, sf), target_files(spark).select(F.col("artifact").alias("name")))


@query("propagation", "N5 J5", b.sql("""SELECT ip AS artifact, 'client' AS artifact_kind, previous, max(hits) FILTER (WHERE best) AS hits, max(ok_hits) AS ok_hits,
 CASE WHEN max(ok_hits) > 0 THEN 'linked' ELSE 'suggested' END AS outcome FROM (SELECT t.*, a.triage AS previous,
 row_number() OVER (PARTITION BY ip ORDER BY ok_hits DESC, hits DESC, t.artifact DESC) = 1 AS best FROM touch t JOIN arts a ON a.artifact = t.ip
 WHERE a.triage IN ('new', 'reviewed') AND a.artifact_kind = 'client' AND t.artifact IN ('/srv/copy/templates/evil.php', '/srv/copy/index.php')) GROUP BY ip, previous""",
    "alerts", _STORED + ",\n" + _TOUCH))
def propagation(spark, sf):
    arts = case(spark, sf)[2].select("artifact", "artifact_kind", "triage").unionByName(target_files(spark))
    decided = target_files(spark).filter(F.col("artifact").isin("/srv/copy/templates/evil.php", "/srv/copy/index.php")).select("artifact")
    return touches.propagate(arts, decided, touched(spark, sf)).select("artifact", "artifact_kind", "previous", "hits", "ok_hits", "outcome")


@query("propagation_to_files", "N5 J5", b.sql("""SELECT t.artifact, 'file' AS artifact_kind, max(ok_hits) AS ok_hits, CASE WHEN max(ok_hits) > 0 THEN 'linked' ELSE 'suggested' END AS outcome
 FROM touch t JOIN arts a ON a.artifact = t.ip WHERE a.triage = 'confirmed' GROUP BY t.artifact""", "alerts", _STORED + ",\n" + _TOUCH))
def propagation_to_files(spark, sf):
    arts = case(spark, sf)[2].select("artifact", "artifact_kind", "triage").unionByName(target_files(spark))
    decided = arts.filter("triage = 'confirmed' and artifact_kind = 'client'").select("artifact")
    return touches.propagate(arts, decided, touched(spark, sf)).select("artifact", "artifact_kind", "ok_hits", "outcome")


@query("related_addresses", "J19 P25", b.sql("""SELECT artifact, ip, place FROM (SELECT artifact, ip, row_number() OVER (PARTITION BY artifact ORDER BY pr, a, h, ip) AS place FROM (
 SELECT artifact, ip, 1 AS pr, -ok_hits AS a, -hits AS h FROM touch))""", "req", _TOUCH))
def related_addresses(spark, sf):
    none = finding_ops.empty_findings(spark)
    box = none.select(F.col("artifact").alias("value"), F.lit("ip").alias("type"))
    return touches.related_addresses(target_files(spark), none, touched(spark, sf), box).select("artifact", "ip", "place")


@query("hunt_correlation", "J9 J8", b.sql("""SELECT l.pattern_id, l.ip, coalesce(a.triage, '') AS triage, coalesce(a.findings, 0) AS finding_count, starts_with(l.ip, '10.0.') AS in_box
 FROM lib l LEFT JOIN arts a ON a.artifact = l.ip AND a.artifact_kind = 'client'""", "alerts", _STORED + ",\n" + log_queries._LIBRARY))
def hunt_correlation(spark, sf):
    arts = case(spark, sf)[2]
    box = arts.filter(F.col("artifact").startswith("10.0.")).select(F.col("artifact").alias("value"), F.lit("ip").alias("type"))
    hits = hunt.library_hunt(index(spark, sf), log_queries.ENTRIES)
    return hunt.correlate(hits, arts, box).select("pattern_id", "ip", "triage", "finding_count", "in_box")


# --- indicators -----------------------------------------------------------------


def collected(spark, sf):
    rows, _, arts = case(spark, sf)
    # Each is asked for by all three parts.
    digests = b.stored(spark, sf, "finding_digests", lambda: webroot.digests(b.files(spark, sf), rows.filter("artifact_kind = 'file'")))
    asked = b.stored(spark, sf, "touched", lambda: touched(spark, sf))
    parts = iocs.collect_confirmed(rows.filter("triage = 'confirmed'"), asked, digests, _ROOTS, NOW)
    return tuple(b.stored(spark, sf, name, lambda p=part: p) for name, part in zip(("iocs", "links", "provenance"), parts))


_BOX = """conf AS (SELECT artifact, artifact_kind, max(CASE WHEN source = 'webshell' THEN 1 ELSE 0 END) AS web,
 max(CASE WHEN contains(lower(rule), 'scanner') THEN 1 ELSE 0 END) AS scanner,
 max(CASE WHEN contains(lower(rule), 'flood') OR contains(lower(rule), 'brute') THEN 1 ELSE 0 END) AS brute,
 max(CASE WHEN contains(lower(rule), 'successful') THEN 1 ELSE 0 END) AS succ FROM stored WHERE triage = 'confirmed' GROUP BY artifact, artifact_kind),
box AS (SELECT CASE artifact_kind WHEN 'file' THEN substr(artifact, 11) ELSE artifact END AS value, CASE artifact_kind WHEN 'file' THEN 'path' WHEN 'client' THEN 'ip' ELSE 'other' END AS type,
 array_to_string(list_sort(list_filter(['confirmed', 'finding', CASE WHEN artifact_kind = 'file' AND web = 1 THEN 'webshell' END, CASE WHEN artifact_kind = 'client' AND scanner = 1 THEN 'scanner' END,
  CASE WHEN artifact_kind = 'client' AND brute = 1 THEN 'brute-force' END, CASE WHEN artifact_kind = 'client' AND succ = 1 THEN 'successful' END,
  CASE WHEN artifact_kind = 'table' THEN 'injected-code' END], lambda x: x IS NOT NULL)), ',') AS tags FROM conf
 UNION ALL SELECT DISTINCT sha256(text), 'hash', 'confirmed,derived' FROM files JOIN conf ON conf.artifact = files.path
 UNION ALL SELECT DISTINCT host, 'domain', 'derived,injected-code' FROM (SELECT unnest(regexp_extract_all(evidence, '(?:https?:)?//([A-Za-z0-9][A-Za-z0-9.\\-]{1,250}\\.[A-Za-z]{2,24})', 1)) AS host
  FROM stored WHERE triage = 'confirmed' AND artifact_kind = 'table'))"""


@query("collected_indicators", "N6 N8 U7 P9 P25", b.sql("SELECT * FROM box", "alerts", _STORED + ",\n" + _BOX))
def collected_indicators(spark, sf):
    rows, _, _ = collected(spark, sf)
    merged = iocs.merge(rows.limit(0), rows)
    return merged.select("value", "type", F.array_join("tags", ",").alias("tags"))


_EDGES = """edges AS (SELECT DISTINCT sha256(text) AS src, 'hash' AS src_type, substr(path, 11) AS dst, 'path' AS dst_type, 'hash-of' AS kind FROM files JOIN conf ON conf.artifact = files.path
 UNION ALL SELECT value, 'domain', 'wp_posts', 'other', 'host-in' FROM box WHERE type = 'domain')"""


@query("indicator_edges", "J16 N6", b.sql("SELECT * FROM edges", "alerts", _STORED + ",\n" + _BOX + ",\n" + _EDGES))
def indicator_edges(spark, sf):
    rows, links, _ = collected(spark, sf)
    return iocs.edges(iocs.merge(rows.limit(0), rows), links).drop("note")


@query("indicator_readings", "J16", b.sql("""SELECT src AS value, CASE kind WHEN 'hash-of' THEN 'is the SHA-256 of' ELSE 'appears in the code of' END AS relation, dst AS other FROM edges
 UNION ALL SELECT dst, CASE kind WHEN 'hash-of' THEN 'has the SHA-256' ELSE 'points to' END, src FROM edges""", "alerts", _STORED + ",\n" + _BOX + ",\n" + _EDGES))
def indicator_readings(spark, sf):
    rows, links, _ = collected(spark, sf)
    return iocs.readings(iocs.edges(iocs.merge(rows.limit(0), rows), links)).select("value", "relation", "other")


@query("withdrawn_indicators", "N7", b.sql("""SELECT value, type, true AS removable FROM box WHERE type = 'ip'""", "alerts", _STORED + ",\n" + _BOX))
def withdrawn_indicators(spark, sf):
    rows, _, provenance = collected(spark, sf)
    withdrawn = case(spark, sf)[2].filter("artifact_kind = 'client' and triage = 'confirmed'").select("artifact")
    return iocs.removable(iocs.merge(rows.limit(0), rows), iocs.retire(provenance, withdrawn), withdrawn)


@query("visible_indicators", "K9 F21", b.sql("""SELECT value, type, tags FROM box WHERE type <> 'hash' AND tags <> 'confirmed,finding' AND contains(lower(value), '0')""",
    "alerts", _STORED + ",\n" + _BOX))
def visible_indicators(spark, sf):
    rows, _, _ = collected(spark, sf)
    shown = iocs.visible(iocs.merge(rows.limit(0), rows).withColumn("origin", F.lit("")), ["hash"], ["confirmed", "finding"], "0")
    return shown.select("value", "type", F.array_join("tags", ",").alias("tags"))


_SPANS_SQL = """sp AS (SELECT ip, CAST(DATE '1970-01-01' + CAST(floor((first_epoch + tz) / 86400.0) AS INT) AS VARCHAR) AS a,
 CAST(DATE '1970-01-01' + CAST(floor((last_epoch + tz) / 86400.0) AS INT) AS VARCHAR) AS z FROM actors WHERE first_epoch IS NOT NULL)"""


@query("indicator_csv", "K4 J18 P30", b.sql("""SELECT b.value AS "Value", type AS "Type", replace(tags, ',', ' ') AS "Tags", coalesce(sp.a, '') AS "First seen (log date)",
 coalesce(sp.z, '') AS "Last seen (log date)", coalesce(e.related, '') AS "Related" FROM box b LEFT JOIN sp ON sp.ip = b.value AND b.type = 'ip'
 LEFT JOIN (SELECT value, string_agg(DISTINCT w, '; ' ORDER BY w) AS related FROM (SELECT src AS value, CASE kind WHEN 'hash-of' THEN 'is the SHA-256 of ' ELSE 'appears in the code of ' END || dst AS w FROM edges
  UNION ALL SELECT dst, CASE kind WHEN 'hash-of' THEN 'has the SHA-256 ' ELSE 'points to ' END || src FROM edges) GROUP BY value) e ON e.value = b.value""",
    "alerts", _STORED + ",\n" + _BOX + ",\n" + _EDGES + ",\n" + _SPANS_SQL))
def indicator_csv(spark, sf):
    rows, links, _ = collected(spark, sf)
    box = iocs.merge(rows.limit(0), rows)
    spans = actors.actor_spans(actor_rows(spark, sf))
    return exports.ioc_csv(box, iocs.edges(box, links), spans).drop("Note", "Origin", "Added")


@query("stix_patterns", "K6", b.sql("""SELECT value, type || ': ' || value AS name, CASE type WHEN 'ip' THEN '[ipv4-addr:value = ''' || value || ''']' WHEN 'hash' THEN '[file:hashes.''SHA-256'' = ''' || value || ''']'
 WHEN 'domain' THEN '[domain-name:value = ''' || value || ''']' ELSE '[file:name = ''' || split_part(value, '/', -1) || ''']' END AS pattern FROM box WHERE type <> 'other'""",
    "alerts", _STORED + ",\n" + _BOX))
def stix_patterns(spark, sf):
    rows, _, _ = collected(spark, sf)
    box = iocs.merge(rows.limit(0), rows)
    spans = actors.actor_spans(actor_rows(spark, sf))
    return exports.stix_indicators(box, spans).select("value", "name", "pattern")


@query("stix_bundle", "K6", None)
def stix_bundle(spark, sf):
    rows, links, _ = collected(spark, sf)
    box = iocs.merge(rows.limit(0), rows)
    spans = actors.actor_spans(actor_rows(spark, sf))
    shown = exports.stix_indicators(box, spans)
    return exports.stix_objects(shown, exports.stix_relationships(iocs.edges(box, links), shown), "2026-01-01T00:00:00.000Z")


@query("indicator_json", "K5", None)
def indicator_json(spark, sf):
    rows, links, _ = collected(spark, sf)
    box = iocs.merge(rows.limit(0), rows)
    spans = actors.actor_spans(actor_rows(spark, sf))
    return exports.ioc_json(box, iocs.edges(box, links), spans).unionAll(exports.chain_json(story(spark, sf)[1]))


def case_indicators(spark, sf):
    """Every typed word of `documents` as an indicator of the case its source is."""
    words = b.table(spark, sf, "documents").select(
        F.col("source").alias("case"), F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))).alias("value")).distinct()
    typed = computed_once(iocs.with_ipv6(words, "value").withColumn("type", ind.classify(F.col("value"), F.col("ipv6"))).drop("ipv6"))
    return b.stored(spark, sf, "case_indicators", lambda: typed.filter(F.col("type") != "other"))


_EXTRACT = r"""ext AS (SELECT DISTINCT source AS "case", value, type FROM (
 SELECT source, unnest(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b|\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4})?\b')) AS value, 'ip' AS type FROM documents
 UNION ALL SELECT source, unnest(regexp_extract_all(text, '(?:https?:)?//([A-Za-z0-9][A-Za-z0-9.\-]{1,250}\.[A-Za-z]{2,24})', 1)), 'domain' FROM documents))"""


@query("extracted_indicators", "P25", f'WITH {_EXTRACT}\nSELECT * FROM ext')
def extracted_indicators(spark, sf):
    return iocs.extract(b.table(spark, sf, "documents"), "text", "source")


_WORD6 = "[0-9A-Fa-f]{1,4}"
_IPV6 = "^(" + "|".join([f"({_WORD6}:){{7}}{_WORD6}", f"({_WORD6}:){{1,7}}:", *(f"({_WORD6}:){{1,{7 - n}}}(:{_WORD6}){{1,{n}}}" for n in range(1, 7)), f":((:{_WORD6}){{1,7}}|:)"]) + ")(%[^%]+)?$"
_CLASSED = f"CASE WHEN contains(v, ':') AND regexp_matches(v, '{_IPV6}') THEN 'ip' " + r"""WHEN regexp_matches(v, '^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$') THEN 'ip'
 WHEN regexp_matches(v, '^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$') THEN 'hash' WHEN regexp_matches(v, '(?i)^https?://') THEN 'url'
 WHEN regexp_matches(v, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email' WHEN contains(v, '/') OR contains(v, '\') THEN 'path'
 WHEN regexp_matches(v, '^[\w.\- ()\[\]{}@#%+~!$]{1,255}\.[A-Za-z0-9]{1,12}$') THEN 'path' ELSE 'other' END"""


_CASES = f"""cw AS (SELECT DISTINCT source AS "case", unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS v FROM documents),
ci AS (SELECT "case", v AS value, {_CLASSED} AS kind FROM cw),
ck AS (SELECT *, CASE WHEN kind IN ('hash', 'domain', 'email') THEN lower(value) ELSE value END AS k FROM ci WHERE kind <> 'other'),
cm AS (SELECT * FROM ck WHERE "case" <> 'src10' AND (kind, k) IN (SELECT (kind, k) FROM ck WHERE "case" = 'src10'))"""


@query("cross_case_matches", "J17 P26", f'WITH {_CASES}\nSELECT "case", kind, k AS "key", value FROM cm')
def cross_case_matches(spark, sf):
    return iocs.cross_case(case_indicators(spark, sf), "src10")


@query("cross_case_summary", "J17", f"""WITH {_CASES}
SELECT count(DISTINCT (kind, k)) AS matched_iocs, count(*) AS matches, count(DISTINCT "case") AS matched_cases,
 (SELECT count(DISTINCT "case") FROM ck WHERE "case" <> 'src10') AS cases_scanned FROM cm""")
def cross_case_summary(spark, sf):
    return iocs.cross_case_summary(case_indicators(spark, sf), "src10")


@query("classified_values", "P24", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS v FROM documents)
SELECT v AS value, {_CLASSED} AS type FROM w""")
def classified_values(spark, sf):
    words = b.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))).alias("value")).distinct()
    return iocs.with_ipv6(words, "value").select("value", ind.classify(F.col("value"), F.col("ipv6")).alias("type"))


@query("manual_indicators", "N8 P24", """SELECT DISTINCT url AS value, 'url' AS type, 'analyst' AS tags FROM pages""")
def manual_indicators(spark, sf):
    entries = b.table(spark, sf, "pages").select(F.concat(F.lit(" "), "url").alias("value"), F.lit("").alias("type"), F.lit("n").alias("note")).distinct()
    return iocs.manual(entries, NOW).select("value", "type", F.array_join("tags", ",").alias("tags"))


def indicator_events(spark, sf):
    """`customer` as a log of changes, in phases: a retype too early, additions, edits, deletions, and
    additions again. Who has which is told by the key."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    tags = lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    host = F.concat(F.lit("host"), k, F.lit(".example.test"))
    rows = b.table(spark, sf, "customer").select(k, host.alias("value"), (k % 5).alias("g"))
    event = lambda phase, which, action, kind, note, t, origin: rows.filter(which).select(
        (F.lit(phase * 10**12) + F.col("c_custkey")).alias("seq"), "value", F.lit(action).alias("action"), kind.alias("type"), note.alias("note"), t.alias("tags"), origin.alias("origin"),
        F.lit(NOW + phase).cast("long").alias("added"))
    text = F.lit
    parts = [event(1, "g = 4", "retype", text("email"), none, tags(), none), event(2, "true", "add", text("domain"), text("n"), tags("a"), text("first")),
             event(4, "g = 1", "retype", text("url"), none, tags(), none), event(5, "g IN (1, 3)", "note", none, text("edited"), tags(), none),
             event(6, "g IN (2, 3)", "delete", none, none, tags(), none), event(7, "g = 3", "add", text("other"), text("again"), tags("c"), text("second")),
             event(7, "g = 4", "add", text("other"), text("again"), tags("b", "a"), text("second")), event(8, "g = 4", "retype", text("no type"), none, tags(), none)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    link = lambda phase, step, kind: rows.select(
        (F.lit(phase * 10**12) + F.col("c_custkey")).alias("seq"), F.col("value").alias("src"), F.concat(F.lit("host"), F.col("c_custkey") + step, F.lit(".example.test")).alias("dst"),
        F.lit(kind).alias("kind"), F.lit("").alias("note"))
    return whole, link(3, 1, "derived").unionAll(link(9, 2, "derived"))


_LOG = """log AS (SELECT c_custkey AS k, c_custkey % 5 AS g, 'host' || c_custkey || '.example.test' AS value FROM customer),
held AS (SELECT k, value, CASE g WHEN 1 THEN 'url' WHEN 3 THEN 'other' ELSE 'domain' END AS type, CASE g WHEN 1 THEN 'edited' WHEN 3 THEN 'again' ELSE 'n' END AS note,
 CASE g WHEN 3 THEN 'c' WHEN 4 THEN 'a,b' ELSE 'a' END AS tags, CASE g WHEN 3 THEN 'second' ELSE 'first' END AS origin FROM log WHERE g <> 2)"""


@query("indicator_log", "N8", f"WITH {_LOG}\nSELECT value, type, note, tags, origin FROM held")
def indicator_log(spark, sf):
    box = iocs.fold(indicator_events(spark, sf)[0])
    return box.select("value", "type", "note", F.array_join("tags", ",").alias("tags"), "origin")


@query("indicator_log_edges", "N8 K9", f"""WITH {_LOG}
SELECT s.value AS src, s.type AS src_type, d.value AS dst, d.type AS dst_type FROM held s JOIN held d ON (d.k = s.k + 2 OR (d.k = s.k + 1 AND s.k % 5 NOT IN (2, 3) AND d.k % 5 NOT IN (2, 3)))
 WHERE s.type <> 'url' AND d.type <> 'url'""")
def indicator_log_edges(spark, sf):
    """Edges that outlived the deletions, without those whose end is hidden."""
    events, links = indicator_events(spark, sf)
    shown = iocs.visible(iocs.fold(events), hide_types=("url",))
    return iocs.edges(shown, iocs.fold_links(events, links)).select("src", "src_type", "dst", "dst_type")


@query("actor_indicators", "N8 D12", b.sql(f"""SELECT ip AS value, 'actor: ' || CAST(requests AS VARCHAR) || ' request(s)' AS origin,
 array_to_string(list_filter(['actor', CASE WHEN scanner_uas <> '' THEN 'scanner' END, CASE WHEN login_posts >= 30 THEN 'brute-force' END,
 CASE WHEN {b._SUCCESS} THEN 'successful' END], lambda x: x IS NOT NULL), ',') AS tags FROM actors""", "actors"))
def actor_indicators(spark, sf):
    rows = iocs.collect_actors(actor_rows(spark, sf), NOW)
    return rows.select("value", "origin", F.array_join("tags", ",").alias("tags"))


@query("flagged_file_indicators", "N8", f"""WITH {b.FILES_SQL}
SELECT substr(path, 11) AS value, 'path' AS type, 'marked by the analyst in the file browser' AS origin FROM files
UNION ALL SELECT sha256(text), 'hash', 'sha-256 of ' || split_part(path, '/', -1) FROM files""")
def flagged_file_indicators(spark, sf):
    files = b.files(spark, sf).select("path", F.sha2("content", 256).alias("sha256"), F.lit("").alias("note"))
    return iocs.flag_files(files, _ROOTS, NOW)[0].select("value", "type", "origin")


_RANGES = """rng AS (SELECT n_nationkey AS k, 755761152 + n_nationkey * 40000 AS "first", 755761152 + n_nationkey * 40000 + 39999 AS "last", n_name AS iso FROM nation
 UNION ALL SELECT 100 + n_nationkey, 1528037376 + n_nationkey * 300, 1528037376 + n_nationkey * 300 + 199, 'x' || n_name FROM nation)"""


def country_ranges(spark, sf):
    nation = b.table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("long")
    wide = nation.select((F.lit(755761152) + k * 40000).alias("first"), (F.lit(755761152) + k * 40000 + 39999).alias("last"), F.col("n_name").alias("iso"))
    narrow = nation.select((F.lit(1528037376) + k * 300).alias("first"), (F.lit(1528037376) + k * 300 + 199).alias("last"), F.concat(F.lit("x"), "n_name").alias("iso"))
    return wide.unionAll(narrow)


@query("countries", "J21 P44", b.sql("""SELECT c.ip, CASE WHEN c.ip LIKE '203.0.113.%' THEN 'documentation' WHEN c.ip LIKE '10.%' OR c.ip LIKE '192.168.%' OR c.ip LIKE '172.16.%' THEN 'private' ELSE '' END AS range, min(iso) AS iso
 FROM (SELECT DISTINCT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS num FROM req) c
 LEFT JOIN rng ON num BETWEEN "first" AND "last" AND (c.ip LIKE '45.%' OR c.ip LIKE '91.%') GROUP BY c.ip""", "req", _RANGES))
def countries(spark, sf):
    return iocs.country_of(index(spark, sf).select("ip"), country_ranges(spark, sf))


#: Spellings of addresses, their shortest form and the class of their range; {h}: hexadecimal key,
#: {d}: one byte of it.
_SPELT = (
    ("2001:0DB8:0000:0000:0000:0000:0000:{h}", "2001:db8::{h}", "documentation"), ("fe80::{h}", "fe80::{h}", "link-local"), ("FF02:0:0:0:0:0:0:{h}", "ff02::{h}", "multicast"),
    ("fd00:1:2:3:4:5:6:{h}", "fd00:1:2:3:4:5:6:{h}", "private"), ("2a00:1450:0:0:1:0:0:{h}", "2a00:1450::1:0:0:{h}", ""), ("::ffff:10.1.2.{d}", "::ffff:10.1.2.{d}", "private"),
    ("::FFFF:45.12.0.{d}", "::ffff:45.12.0.{d}", ""), ("2a00:1450:4001:81b:0:0:0:{h}", "2a00:1450:4001:81b::{h}", ""), ("1:2:3:{h}", None, None), ("{h}::1::", None, None),
    ("2001:20::{h}", "2001:20::{h}", ""), ("2001:0:1:0:0:2:0:{h}", "2001:0:1::2:0:{h}", "private"), ("64:ff9b::1.2.3.{d}", "64:ff9b::102:3{x}", ""))


def _spelt(values):
    fill = lambda t: t if t is None else "'" + t.replace("{h}", "' || h || '").replace("{d}", "' || d || '").replace("{x}", "' || x || '") + "'"
    return f"CASE k % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else fill(v)}" for i, v in enumerate(values)) + " END"


_SIX = f"""six AS (SELECT {_spelt([x for x, _, _ in _SPELT])} AS value, {_spelt([y for _, y, _ in _SPELT])} AS short, {_spelt([z for _, _, z in _SPELT])} AS range, n
 FROM (SELECT c_custkey AS k, lower(to_hex(c_custkey % 60000 + 1)) AS h, CAST(c_custkey % 256 AS VARCHAR) AS d, lpad(lower(to_hex(c_custkey % 256)), 2, '0') AS x, c_nationkey AS n FROM customer))"""


def ipv6_clients(spark, sf):
    """`customer` as addresses in many spellings, some of them none."""
    rows = b.table(spark, sf, "customer").selectExpr("c_custkey AS k", "lower(hex(c_custkey % 60000 + 1)) AS h", "CAST(c_custkey % 256 AS STRING) AS d", "lpad(lower(hex(c_custkey % 256)), 2, '0') AS x")
    return rows.selectExpr(f"{_spelt([x for x, _, _ in _SPELT])} AS value")


@query("ipv6_addresses", "P24 P44", f"WITH {_SIX}\nSELECT value, short, range, CASE WHEN short IS NULL THEN 'other' ELSE 'ip' END AS type FROM six")
def ipv6_addresses(spark, sf):
    v = F.col("value")
    rows = iocs.with_ipv6(ipv6_clients(spark, sf), "value")
    return rows.select("value", F.col("ipv6").alias("short"), ind.ipv6_range(v).alias("range"), ind.classify(v, F.col("ipv6")).alias("type"))


@query("ipv6_countries", "J21", f"""WITH {_SIX}
SELECT DISTINCT value AS ip, range, CASE WHEN range <> '' THEN NULL WHEN value LIKE '2a00:1450:4001:81b:%' THEN 'x81b' WHEN value LIKE '2a00:1450:%' THEN (SELECT min(n_name) FROM nation) END AS iso FROM six WHERE short IS NOT NULL""")
def ipv6_countries(spark, sf):
    """Networks in one another: the longest one that holds an address answers."""
    name = b.table(spark, sf, "nation").agg(F.min("n_name").alias("iso"))
    fixed_rows = lambda network, iso: name.select(F.lit(network).alias("network"), iso.alias("iso"))
    networks = (fixed_rows("2a00:1450::/32", F.col("iso")).unionAll(fixed_rows("2a00:1450:4001:800::/56", F.lit("x800"))).unionAll(fixed_rows("2a00:1450:4001:81b::/64", F.lit("x81b")))
                .unionAll(fixed_rows("fd00::/8", F.lit("no"))).unionAll(fixed_rows("::/1", F.lit("rest")).limit(0)))
    return iocs.country_of_ipv6(ipv6_clients(spark, sf).withColumnRenamed("value", "ip"), networks)


# --- chronology -----------------------------------------------------------------


def story(spark, sf):
    """(confirmed, events): confirmed clients of the case, six target files that count as
    confirmed, and the administrator accounts of one export."""
    r, table = index(spark, sf), actor_rows(spark, sf)
    clients = table.filter(F.col("ip").startswith("10.0.")).select(F.col("ip").alias("artifact"), F.lit("client").alias("artifact_kind"), F.lit(0).alias("worst"))
    confirmed = clients.unionAll(target_files(spark).select("artifact", "artifact_kind", F.lit(0)))
    timed = chronology.alert_times(alerts.severity_by_kind(alerts.counter_alerts(table)), r)
    found_accounts = account_table(spark, sf).filter("cms = 'Joomla' and admin")
    span = actors.index_totals(r).select("first_epoch", "last_epoch", F.lit(0).alias("tz"))
    events = lambda: chronology.file_events(confirmed, touched(spark, sf), _ROOTS).unionByName(
        chronology.client_events(confirmed, table, timed)).unionByName(chronology.account_events(found_accounts, span))
    return confirmed, b.stored(spark, sf, "story", events)  # asked for more than once by most questions


_STORY = _TOUCH + ",\n" + _ACCOUNTS + """,
ft AS (SELECT t.artifact, min(t.first_epoch) AS first_any, max(t.last_epoch) AS last_any, min(first_ok) AS first_ok, sum(hits)::BIGINT AS n, sum(ok_hits)::BIGINT AS ok,
 any_value(o.tz) AS tz FROM touch t JOIN (SELECT artifact, coalesce(arg_max(tz, abs(tz) * 10 + CASE WHEN tz > 0 THEN 1 ELSE 0 END), 0) AS tz FROM met GROUP BY artifact) o ON o.artifact = t.artifact
 WHERE first_epoch IS NOT NULL GROUP BY t.artifact),
atimes AS (SELECT a.*, m.epoch FROM alerts a LEFT JOIN (SELECT ip, uri, min(epoch) AS epoch FROM req GROUP BY ip, uri) m ON m.ip = a.ip AND m.uri = a.example WHERE a.kind <> 'scanner_ua'),
events AS (SELECT first_ok + tz AS "at", 'success' AS kind, artifact FROM ft WHERE first_ok IS NOT NULL
 UNION ALL SELECT first_any + tz, 'attempt', artifact FROM ft WHERE first_ok IS NULL
 UNION ALL SELECT last_any + tz, 'last_access', artifact FROM ft WHERE last_any <> coalesce(first_ok, first_any)
 UNION ALL SELECT first_epoch + tz, 'first_contact', ip FROM actors WHERE ip LIKE '10.0.%' AND first_epoch IS NOT NULL
 UNION ALL SELECT last_epoch + tz, 'last_access', ip FROM actors WHERE ip LIKE '10.0.%' AND first_epoch IS NOT NULL
 UNION ALL SELECT atimes.epoch + actors.tz, 'alert', atimes.ip FROM atimes JOIN actors ON actors.ip = atimes.ip WHERE atimes.ip LIKE '10.0.%' AND atimes.epoch IS NOT NULL AND severity < 3
 UNION ALL SELECT s, 'account', '' FROM (SELECT date_diff('second', TIMESTAMP '1970-01-01', CAST(registered AS TIMESTAMP)) AS s FROM accounts WHERE cms = 'Joomla' AND admin AND registered <> '-')
  WHERE s BETWEEN (SELECT min(epoch) FROM req) AND (SELECT max(epoch) FROM req)),
confirmed AS (SELECT ip AS artifact, 'client' AS artifact_kind FROM actors WHERE ip LIKE '10.0.%' UNION ALL SELECT artifact, 'file' FROM targets)"""


@query("chronology", "N9 N10 N11 P12 P15 J20", b.sql('SELECT "at", kind, artifact FROM events', "alerts", _STORY))
def chronology_events(spark, sf):
    return story(spark, sf)[1].select("at", "kind", "artifact")


@query("alert_times", "J20", b.sql("SELECT ip, kind, severity, detail, example, epoch FROM atimes", "alerts", _STORY))
def alert_times(spark, sf):
    return chronology.alert_times(alerts.counter_alerts(actor_rows(spark, sf)), index(spark, sf))


@query("missing_from_story", "N12", b.sql("""SELECT c.artifact, artifact_kind, CASE WHEN artifact IN (SELECT artifact FROM events) THEN 'beyond_cap' ELSE 'undated.' || artifact_kind END AS why FROM confirmed c
 WHERE artifact NOT IN (SELECT artifact FROM (SELECT * FROM events ORDER BY "at", kind, artifact LIMIT 80))""", "alerts", _STORY))
def missing_from_story(spark, sf):
    return chronology.missing_from_story(*story(spark, sf), 80)


@query("story_page", "N12 T3", b.sql('SELECT "at", kind, artifact FROM (SELECT "at", kind, artifact FROM events ORDER BY "at", kind, artifact LIMIT 80)', "alerts", _STORY))
def story_page(spark, sf):
    return chronology.capped(story(spark, sf)[1], 80).select("at", "kind", "artifact")


@query("story_gaps", "N13", b.sql("""SELECT (SELECT count(*) FROM confirmed) = 0 AS none_confirmed, (SELECT count(*) FROM events) = 0 AS no_times,
 (SELECT min("at") FROM events) - (SELECT min(epoch) FROM req) < 60 AS at_log_start, (SELECT count(*) FROM events WHERE kind = 'success') = 0 AS only_attempts,
 (SELECT count(*) FROM events) > 80 AS truncated, true AS logs_clock_set, false AS dump_clock_set, (SELECT count(*) FROM events) AS total_events""", "alerts", _STORY))
def story_gaps(spark, sf):
    start = index(spark, sf).select(F.min("epoch"))
    return chronology.gap_statements(*story(spark, sf), start, 80, clock_logs=3600)


@query("milestones", "N14", b.sql("""SELECT role, "at", kind FROM (
 SELECT 1 AS n, 'first' AS role, "at", kind, artifact FROM (SELECT * FROM events ORDER BY "at", kind, artifact LIMIT 1)
 UNION ALL SELECT 2, 'first_success', "at", kind, artifact FROM (SELECT * FROM events WHERE kind = 'success' ORDER BY "at", artifact LIMIT 1)
 UNION ALL SELECT 3, 'account', "at", kind, artifact FROM (SELECT * FROM events WHERE kind = 'account' ORDER BY "at", artifact LIMIT 1)
 UNION ALL SELECT 4, 'first_alert', "at", kind, artifact FROM (SELECT * FROM events WHERE kind = 'alert' ORDER BY "at", artifact LIMIT 1)
 UNION ALL SELECT 5, 'last', "at", kind, artifact FROM (SELECT * FROM events ORDER BY "at" DESC, kind DESC, artifact DESC LIMIT 1))
 QUALIFY row_number() OVER (PARTITION BY "at", kind, artifact ORDER BY n) = 1""", "alerts", _STORY))
def milestones(spark, sf):
    return chronology.milestones(story(spark, sf)[1]).select("role", "at", "kind")


# --- search, report, exports ----------------------------------------------------


@query("global_search", "T6", b.sql("""SELECT 'artifacts' AS "group", artifact AS value, CAST(worst AS VARCHAR) AS extra FROM (SELECT * FROM arts WHERE contains(lower(artifact), '10') ORDER BY worst, artifact LIMIT 8)
 UNION ALL SELECT 'iocs', value, type FROM (SELECT * FROM box WHERE contains(lower(value), '10') ORDER BY value LIMIT 8)
 UNION ALL SELECT 'accounts', login, email FROM (SELECT * FROM accounts WHERE contains(lower(login), '10') OR contains(lower(email), '10') ORDER BY login, user_id, email LIMIT 8)
 UNION ALL SELECT 'actors', ip, CAST(requests AS VARCHAR) FROM (SELECT * FROM actors WHERE contains(ip, '10') ORDER BY requests DESC, ip LIMIT 8)""",
    "alerts", _STORED + ",\n" + _BOX + ",\n" + _ACCOUNTS))
def global_search(spark, sf):
    rows, _, _ = collected(spark, sf)
    box = iocs.merge(rows.limit(0), rows)
    return search.global_search("10", case(spark, sf)[2], box, account_table(spark, sf), actor_rows(spark, sf))


@query("report_decisions", "N19", b.sql("""SELECT artifact_kind, CASE artifact_kind WHEN 'file' THEN lower(substr(artifact, 11)) ELSE artifact END AS artifact, min(severity) AS severity,
 string_agg(DISTINCT replace(rule, '/srv/copy', '[evidence]') || ' [' || rule_id || ']', '|' ORDER BY replace(rule, '/srv/copy', '[evidence]') || ' [' || rule_id || ']') AS rules,
 coalesce(string_agg(DISTINCT nullif(triage_note, ''), '|'), '') AS notes FROM stored WHERE triage = 'confirmed' GROUP BY 1, 2""", "alerts", _STORED))
def report_decisions(spark, sf):
    sections = report.decisions(case(spark, sf)[0], _ROOTS)
    return sections.select("artifact_kind", "artifact", "severity", F.array_join("rules", "|").alias("rules"), F.array_join("notes", "|").alias("notes"))


@query("trace_export", "K3 P30", b.sql(f"""SELECT ip AS "Client", CASE WHEN epoch IS NULL THEN '' ELSE strftime(make_timestamp((epoch + tz) * 1000000), '%Y-%m-%d %H:%M:%S') END AS "Time",
 CASE WHEN method = '-' THEN '''-' ELSE method END AS "Method", CASE WHEN uri = '-' THEN '''-' ELSE uri END AS "URI", status AS "Status", coalesce(CAST(size AS VARCHAR), '') AS "Size",
 CASE WHEN referrer = '-' THEN '''-' ELSE referrer END AS "Referrer", CASE WHEN agent = '-' THEN '''-' ELSE agent END AS "User-Agent", split_part(source, '/', -1) AS "Source"
 FROM req WHERE {log_queries._TRACED_SQL}"""))
def trace_export(spark, sf):
    from webtrail.operators import trace

    return exports.trace_cells(trace.trace_columns(trace.trace(index(spark, sf), log_queries._TRACED)))


@query("trace_manifest", "K3", None)
def trace_manifest(spark, sf):
    return exports.trace_manifest(trace_export(spark, sf), {"Clients": ", ".join(log_queries._TRACED), "Sort": "time"})


@query("naive_stamps", "P15 P16", b.ACCOUNTS_SQL.join(["WITH ", """
SELECT user_id, CASE WHEN registered NOT LIKE '0000%' THEN date_diff('second', TIMESTAMP '1970-01-01', CAST(registered AS TIMESTAMP)) END AS naive,
 CASE WHEN registered NOT LIKE '0000%' THEN date_diff('second', TIMESTAMP '1970-01-01', CAST(registered AS TIMESTAMP)) END AS exported,
 CASE WHEN registered NOT LIKE '0000%' THEN date_diff('second', TIMESTAMP '1970-01-01', CAST(registered[:10] AS TIMESTAMP)) END AS german FROM acc"""]))
def naive_stamps(spark, sf):
    a = b.accounts(spark, sf)
    day = F.substring("registered", 1, 10)
    german = F.concat_ws(".", F.substring(day, 9, 2), F.substring(day, 6, 2), F.substring(day, 1, 4))
    return a.select("user_id", times.naive_seconds(F.col("registered")).alias("naive"),
                    times.export_seconds(F.col("registered")).alias("exported"), times.export_seconds(german).alias("german"))


@query("index_changes", "U4", b.sql("""SELECT source || CASE WHEN source LIKE '%other%' THEN '.1' ELSE '' END AS path, count(*) AS length, 'added' AS change FROM req WHERE source LIKE '%other%' GROUP BY source
 UNION ALL SELECT source, count(*), 'gone' FROM req WHERE source LIKE '%other%' GROUP BY source"""))
def index_changes(spark, sf):
    from webtrail.sources import logs

    old = index(spark, sf).groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("length")).withColumn("mtime", F.lit(1))
    new = old.withColumn("path", F.when(F.col("path").contains("other"), F.concat("path", F.lit(".1"))).otherwise(F.col("path")))
    return logs.index_status(old, new).select("path", "length", "change")


@query("pattern_library", "S13 U6 F25", b.sql("""SELECT patterns, 'any' AS match, 'leaf' AS name, 'own' AS origin FROM (SELECT DISTINCT leaf AS patterns FROM req WHERE length(leaf) >= 3)
 UNION ALL VALUES ('*option=com_jce*,*task=profiles.import*', 'all', 'Joomla JCE editor RCE', 'bundled'),
 ('*plugin=helix3*', 'any', 'Joomla Helix3 unauthenticated ajax handler', 'bundled')"""))
def pattern_library(spark, sf):
    """The library of patterns with what each reaches in the derived logs."""
    from webtrail.sources import rules

    own = rules.line_patterns(index(spark, sf).select(F.concat(F.col("leaf"), F.lit(" | leaf")).alias("value")).distinct())
    library = hunt.library_union(rules.bundled_patterns(spark), hunt.usable_paths(own), [])
    return library.select(F.array_join("patterns", ",").alias("patterns"), "match", "name", "origin")


@query("enabled_rules", "F27 U5 R27", b.sql(f"""SELECT c.id, c.severity, coalesce(n.n, 0) AS findings FROM (VALUES {file_queries._CATALOGUE}) c(id, engine, severity, name, format)
 LEFT JOIN (SELECT rule_id, count(*) AS n FROM stored GROUP BY rule_id) n ON n.rule_id = c.id WHERE c.id <> 'webshell.goto'""", "alerts", _STORED))
def enabled_rules(spark, sf):
    """Rules that are on, with their findings in the derived case."""
    from webtrail.operators import rules

    hits = stored_findings(spark, sf).groupBy(F.col("rule_id").alias("id")).agg(F.count(F.lit(1)).alias("findings"))
    off = spark.createDataFrame([("webshell.goto",), ("no.such.rule",)], "id string")
    return rules.switched(rules.catalogue(spark), off).join(hits, "id", "left").select("id", "severity", F.coalesce("findings", F.lit(0)).alias("findings"))


@query("skipped_and_inert", "K10", f"""WITH {b.FILES_SQL}
SELECT count(*) FILTER (WHERE octet_length(encode(text)) > 5242880) AS skipped FROM files""")
def skipped_and_inert(spark, sf):
    return webroot.skipped_files(b.files(spark, sf)).agg(F.count(F.lit(1)).alias("skipped"))
