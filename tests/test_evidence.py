"""Files on disk: sorting out, log index, web root, trees, exports, inventories."""

import bz2
import gzip
import lzma
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from webtrail.functions import sqltext
from webtrail.operators import accounts, actors, cms, coverage, dumps, errorlog, webroot
from webtrail.sinks import exports, index
from webtrail.sources import candidates, dumps as dump_source, files, logs, rules

LINE = '{ip} - - [10/Jun/2026:22:{m:02d}:11 +0200] "GET /p{m} HTTP/1.1" 200 5 "-" "ua"'


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as handle:
        handle.write(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def log_folder(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("logs"))
    text = "\n".join(LINE.format(ip="1.1.1.1", m=m) for m in range(10)) + "\n"
    write(f"{base}/a/access.log", "\ufeff" + text)
    write(f"{base}/b/access.log", "fragment of a record\n\n" + text)
    write(f"{base}/b/old.log.gz", gzip.compress(text.encode()))
    write(f"{base}/b/old.log.bz2", bz2.compress(text.encode()))
    write(f"{base}/b/old.log.xz", lzma.compress(text.encode()))
    write(f"{base}/d [1] +%20x/acc {{x}}.log", text)
    write(f"{base}/b/pic.log", b"\x00\x01binary")
    write(f"{base}/b/bad.log", text.encode() + b'1.1.1.1 - - [10/Jun/2026:22:59:11 +0200] "GET /\xff HTTP/1.1" 200 5 "-" "ua"\n')
    write(f"{base}/c/error.log", "\n[Mon Jan 06 08:00:00 2026] [error] PHP Fatal error: x in /var/www/site/Images/x.php on line 3\n"
          "2026/01/06 08:00:01 [error] 1#1: PHP Warning: y in /gone/z.php:4\n")
    return base


def test_logs_are_sorted_out_and_parsed(spark, log_folder):
    found = logs.find(spark, [log_folder])
    names = {os.path.relpath(p, log_folder) for p in found.access}
    assert names == {"a/access.log", "b/access.log", "b/old.log.gz", "b/old.log.bz2", "b/old.log.xz", "b/bad.log", "d [1] +%20x/acc {x}.log"}
    assert [os.path.basename(p) for p in found.error] == ["error.log"]
    assert {r.reason for r in logs.skipped(found.sorted_files).collect()} == {
        "binary/unreadable file", "Apache/Nginx error log (not an access-log format)"}
    lines = logs.access_lines(spark, found.access)
    counts = {os.path.relpath(r.source, log_folder): (r.lines, r.unparsed) for r in actors.source_counts(lines).collect()}
    assert counts["a/access.log"] == (10, 0) and counts["b/access.log"] == (10, 1)
    assert counts["b/old.log.xz"] == counts["b/old.log.gz"] == counts["b/old.log.bz2"] == (10, 0) and counts["b/bad.log"] == (11, 0)
    requests = logs.requests(lines)
    assert requests.count() == 71 and {r.ip for r in requests.select("ip").distinct().collect()} == {"1.1.1.1"}
    heads = found.sorted_files.filter("kind = 'access'").withColumnRenamed("first_line", "value")
    from webtrail.functions import loglines
    first = loglines.with_record(heads).withColumnRenamed("value", "first_line")
    assert [os.path.relpath(r.path, log_folder) for r in coverage.truncated_heads(first).collect()] == ["b/access.log"]
    table = logs.sources_table(found.sorted_files, actors.source_counts(lines))
    assert table.filter("lines = 10").count() == 6


def test_index_is_written_and_read_back(spark, log_folder, tmp_path):
    requests = logs.requests(logs.access_lines(spark, logs.find(spark, [log_folder]).access))
    paths = exports.write_index(requests, str(tmp_path / "index"))
    back = spark.read.parquet(paths["requests"])
    assert back.count() == 71 and "f_login" in back.columns
    assert spark.read.parquet(paths["actors"]).first().requests == 71
    plan = back.filter("ip = '1.1.1.1' and status = 200").select("uri")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(ip,1.1.1.1)" in plan
    status = logs.index_status(files.listing(spark, [log_folder]).limit(0), files.listing(spark, [log_folder]))
    assert status.count() == 9


def test_index_reads_changed_files_only(spark, tmp_path):
    base, folder = tmp_path / "logs", str(tmp_path / "index")
    line = LINE.format(ip="1.1.1.1", m=5) + "\n"
    for name, n in (("a.log", 3), ("b.log", 2), ("c.log", 1)):
        write(f"{base}/{name}", line * n + "no log line\n\n")
    write(f"{base}/pic.log", b"\x00binary")
    now = lambda: files.listing(spark, [str(base)])
    state = lambda: tuple(index.status(spark, folder, now()).first())
    held = lambda: {os.path.basename(r.path): (r.lines, r.unparsed, r.build) for r in index.sources(spark, folder).collect()}
    assert state() == (False, False, 4, 0, 0)
    assert index.update(spark, now(), folder) == 1 and state() == (True, True, 0, 0, 0)
    assert held() == {"a.log": (3, 1, 1), "b.log": (2, 1, 1), "c.log": (1, 1, 1), "pic.log": (0, 0, 1)}
    assert index.update(spark, now(), folder) == 1  # nothing to do
    write(f"{base}/b.log", line * 5)
    os.remove(base / "c.log")
    write(f"{base}/d.log", line)
    assert state() == (True, False, 1, 1, 1)
    # The unchanged file is not opened again: it is not there to be read under its name.
    listed = now().cache()
    assert listed.count() == 4
    os.rename(base / "a.log", base / "away")
    assert index.update(spark, listed, folder) == 2
    os.rename(base / "away", base / "a.log")
    assert held() == {"a.log": (3, 1, 1), "b.log": (5, 0, 2), "d.log": (1, 0, 2), "pic.log": (0, 0, 1)}
    assert index.requests(spark, folder).count() == 9 and index.unparsed(spark, folder).count() == 1
    paths = index.derive(spark, folder)
    assert spark.read.parquet(paths["actors"]).first().requests == 9
    assert index.vacuum(spark, folder) == 2 and index.requests(spark, folder).count() == 9 and index.vacuum(spark, folder) == 0


def test_error_log_meets_the_copy(spark, log_folder):
    lines = logs.error_lines(spark, logs.find(spark, [log_folder]).error)
    paths = errorlog.named_paths(lines)
    root = spark.createDataFrame([("/copy/images/X.php", "images/X.php", 0), ("/copy/x.php", "x.php", 0)], "path string, rel string, root_rank int")
    resolved = errorlog.resolve(paths, root)
    (row,) = errorlog.findings(errorlog.per_file(paths, resolved)).collect()
    assert (row.artifact, row.rule_id, row.line) == ("/copy/images/X.php", "errorlog.hard", 3)
    assert errorlog.unresolved(paths, resolved).first().unresolved == 1


SHELLS = {
    "images/a.php": b"<?php $_GET[1];", "images/guarded.php": b"<?php defined('_JEXEC') or die; $_GET[1];", "images/empty.php": b"<?php // x",
    "media/system/ok.php": b"<?php $_GET[1];", "lib/b.php": b"<?php\n\teval(base64_decode($x));\n\xff eval(gzinflate(1)); eval(gzinflate(2));",
    "lib/plain.php": b"<!DOCTYPE html>\n<html>\n<body>", "lib/text.php": b"changelog", "img/logo.jpg.php": b"<?php", "img/p.png": b"\x89\x00<?= system text here ok ok ok ok ?>",
    "img/q.png": b"\x89<?=\x00\x01\x02\x03\x04\x05", "x/.htaccess": b"<Files \"a.jpg\">\n  SetHandler x-httpd-php\n</Files>\nphp_value auto_prepend_file a\n",
    "y/.htaccess": b"AddHandler application/x-httpd-ea-php81 .php .php8 .phtml\n", "tmp/big.php": b"<?php " + b"x" * (5 * 1024 * 1024),
}


@pytest.fixture(scope="module")
def web_root(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("uploads")) + "/site"
    for name, data in SHELLS.items():
        write(f"{base}/{name}", data)
    return base


def test_file_rules(spark, web_root):
    content = files.contents(spark, [web_root], web_root).cache()
    found = webroot.findings(content)
    got = {(os.path.relpath(r.artifact, web_root), r.rule_id, r.line) for r in found.collect()}
    assert got == {
        ("images/a.php", "webshell.upload_php", None), ("lib/b.php", "webshell.eval_input", 2), ("lib/b.php", "webshell.eval_input", 3),
        ("lib/plain.php", "webshell.no_php", 2), ("img/logo.jpg.php", "webshell.double_ext", None), ("img/p.png", "webshell.php_in_image", None),
        ("x/.htaccess", "webshell.htaccess_handler", 1), ("x/.htaccess", "webshell.htaccess_prepend", 4), ("tmp/big.php", "webshell.too_large", None)}
    assert {r.evidence for r in found.filter("line = 3").collect()} == {"\ufffd eval(gzinflate(1)); eval(gzinflate(2));"}
    assert [os.path.relpath(r.path, web_root) for r in webroot.inert_files(content).collect()] == ["images/empty.php"]
    (skip,) = webroot.skipped_files(content).collect()
    assert skip.reason.startswith("too large")
    assert webroot.digests(content, found).count() == 7  # the large file has a digest too
    own = webroot.own_rule_findings(content, [("own.x", "X", None, "x")]).filter(F.col("path").endswith("text.php"))
    assert own.count() == 0
    content.unpersist()


def test_unreadable_file(spark):
    df = spark.createDataFrame([("/r/uploads/a.php", "/r", 10, None)], "path string, root string, length long, content binary")
    (row,) = webroot.structural_findings(df).collect()
    assert row.rule_id == "webshell.unreadable"


def test_tree_diff(spark):
    schema = "path string, root string, length long, content binary"
    left = spark.createDataFrame([("/a/x", "/a", 1, b"1"), ("/a/y", "/a", 1, b"1"), ("/a/z", "/a", 2, b"12"), ("/a/only", "/a", 1, b"1"),
                                  ("/a/huge", "/a", 40 * 2**20, None)], schema)
    right = spark.createDataFrame([("/b/x", "/b/", 1, b"1"), ("/b/y", "/b/", 1, b"2"), ("/b/z", "/b/", 3, b"123"), ("/b/gone", "/b/", 1, b"1"),
                                   ("/b/huge", "/b/", 40 * 2**20, None)], schema)
    diff = {r.rel: r.status for r in webroot.tree_diff(webroot.tree(left), webroot.tree(right)).collect()}
    assert diff == {"x": "identical", "y": "modified", "z": "modified", "only": "extra", "gone": "missing", "huge": "too_big"}


DUMP = r"""-- MySQL dump 10.13  Distrib 8.0.36
-- Host: localhost    Database: shop_prod
--
-- Server version	8.0.36
-- It's a comment

CREATE TABLE `wp_users` (
  `ID` bigint NOT NULL,
  `user_login` varchar(60) NOT NULL DEFAULT 'a,(b)',
  `user_email` enum('x','y'),
  PRIMARY KEY (`ID`), KEY `k` (`user_login`,`user_email`)
);
INSERT INTO `wp_users` VALUES
(1,'it''s \'q\' ; done','C:\\new'),
(2,'line
break; INSERT INTO `x` VALUES (9)','a\\\\nb'),(3,NULL,NOW());
INSERT IGNORE INTO other (a, `b`) VALUES ('CREATE TABLE `z` (`c` int)', -1.5e3);INSERT INTO other VALUES ('#__content',2);
INSERT INTO wp_users VALUES (4,'','tail')"""


def reference_statements(text):
    """Statements by the plain one-character rule, for comparison."""
    out, begin, inside, i = [], 0, False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            i += 2
            continue
        if c == "'":
            inside = not inside
        elif c == ";" and not inside:
            out.append(text[begin:i + 1])
            begin = i + 1
        i += 1
    tail = text[begin:].strip()
    return out + ([tail] if tail else [])


def as_lines(spark, text, dump="/d/a.sql", per_block=3):
    return spark.createDataFrame([(dump, i // per_block, i, v) for i, v in enumerate(text.split("\n"))], "dump string, block long, pos long, value string")


MIXED = r"""/* it's a "dump" */ INSERT INTO a VALUES (1,'x') /* ; */;INSERT INTO b VALUES (1,"it's; x", NOW(a(b(c(d(e(f(g(h(i(j(k(1, 2)))))))))))) ) -- it's
, (2, 'a\'b', "c""d
e;")
, ( 3 , NULL ,'') ON DUPLICATE KEY UPDATE a=VALUES(a);
/*!40000 ALTER TABLE `x;'` DISABLE KEYS */;
# it's; a (note
CREATE TABLE `t` ( -- it's; a
 `a;` int, `b` varchar(3) DEFAULT ',' /* ' */, KEY `k` (`b`));
/* over
'lines; */
  INSERT INTO `#__t` (`a`, b)VALUES(1,'\\'),(2,'--no'),(3,1-2),('x' 'y',-- none
4/2)"""
MIXED_ROWS = {
    ("a", 1): ["1", "x"], ("b", 1): ["1", "it's; x", "NOW(a(b(c(d(e(f(g(h(i(j(k(1, 2))))))))))))"], ("b", 2): ["2", "a'b", 'c"d\ne;'],
    ("b", 3): ["3", None, ""], ("#__t", 1): ["1", "\\"], ("#__t", 2): ["2", "--no"], ("#__t", 3): ["3", "1-2"], ("#__t", 4): ["x' 'y", "4/2"]}


@pytest.mark.parametrize("per_block", [1, 2, 3, 100])
def test_statements_across_lines_and_blocks(spark, per_block):
    got = [r.statement.strip() for r in dumps.statements(as_lines(spark, DUMP.replace("-- It's a comment", "-- a comment"), per_block=per_block)).orderBy("stmt_no").collect()]
    assert got == [s.strip() for s in reference_statements(DUMP.replace("-- It's a comment", "-- a comment"))]
    # With an apostrophe in a comment the statements are the same, but for the comment.
    got = [r.statement.strip().replace("It's", "a") for r in dumps.statements(as_lines(spark, DUMP, per_block=per_block)).orderBy("stmt_no").collect()]
    assert got == [s.strip() for s in reference_statements(DUMP.replace("It's", "a"))]


@pytest.mark.parametrize("per_block", [1, 2, 4, 100])
def test_comments_quotes_and_calls(spark, per_block):
    lines = as_lines(spark, MIXED, per_block=per_block).unionAll(as_lines(spark, MIXED, "/d/b.sql", 3))
    statements = dumps.statements(lines)
    rows = dumps.dump_rows(dumps.insert_rows(statements), dumps.created_columns(statements)).collect()
    for dump in ("/d/a.sql", "/d/b.sql"):
        assert {(r.table, r.row_no): r["values"] for r in rows if r.dump == dump} == MIXED_ROWS
    assert {tuple(r["columns"]) for r in rows if r.table == "#__t"} == {("a", "b")}
    assert {(r.table, tuple(r["columns"])) for r in dumps.created_columns(statements).collect()} == {("t", ("a;", "b"))}
    assert dumps.unclosed(lines).collect() == []


@pytest.mark.parametrize("tail, reason", [("'it", "value"), ('"it', "value"), ("`it", "name"), ("/* it", "comment")])
def test_what_never_ends_is_reported(spark, tail, reason):
    text = "INSERT INTO a VALUES (1);\nINSERT INTO a VALUES (2);INSERT INTO a VALUES (3," + tail + "\nINSERT INTO a VALUES (4);\n" * 5
    for per_block in (1, 100):
        lines = as_lines(spark, text, per_block=per_block)
        assert [tuple(r) for r in dumps.unclosed(lines).collect()] == [("/d/a.sql", 2, f"unclosed {reason}")]
        assert {tuple(r["values"]) for r in dumps.insert_rows(dumps.statements(lines)).collect()} == {("1",), ("2",)}


def test_summaries_compose_as_lines_do():
    """Any text of the characters that matter, cut anywhere: composed summaries against one state
    machine that reads character by character."""
    def plain(text, state):
        ends, i = 0, 0
        while i < len(text):
            c, two = text[i], text[i:i + 2]
            if state in (1, 2, 3):
                quote = "'\"`"[state - 1]
                if c == "\\" and state != 3:
                    i += 1
                elif two == quote * 2:
                    i += 1
                elif c == quote:
                    state = 0
            elif state == 4:
                if two == "*/":
                    state, i = 0, i + 1
            elif state == 5:
                state = 0 if c == "\n" else 5
            elif c in "'\"`":
                state = "'\"`".index(c) + 1
            elif two == "/*" and text[i + 2:i + 3] != "!":
                state, i = 4, i + 1
            elif (two == "--" and text[i + 2:i + 3] in ("", " ", "\n")) or (c == "#" and text[i + 1:i + 3] != "__"):
                state = 5
            elif two == "*/":
                i += 1
            elif c == ";":
                ends += 1
            i += 1
        return (0 if state == 5 else state), ends

    dice = random.Random(3)
    for _ in range(3000):
        text = "".join(dice.choices("'\"`;-#/*\\a _!\n", k=dice.randint(0, 24)))
        lines = text.split("\n")
        cut = dice.randint(0, len(lines))
        for state in range(5):
            first = sqltext.summary(lines[:cut])[state]
            second = sqltext.summary(lines[cut:])[first[0]]
            assert (second[0], first[1] + second[1]) == plain(text + "\n", state), (text, state)


def test_rows_of_a_dump(spark):
    statements = dumps.statements(as_lines(spark, DUMP))
    rows = dumps.dump_rows(dumps.insert_rows(statements), dumps.created_columns(statements))
    got = {(r.table, r.row_no): (r["columns"], r["values"]) for r in rows.collect()}
    users = ["ID", "user_login", "user_email"]
    assert got == {
        ("wp_users", 1): (users, ["1", "it's 'q' ; done", "C:\\new"]),
        ("wp_users", 2): (users, ["2", "line\nbreak; INSERT INTO `x` VALUES (9)", "a\\\\nb"]),
        ("wp_users", 3): (users, ["3", None, "NOW()"]),
        ("wp_users", 4): (users, ["4", "", "tail"]),
        ("other", 1): (["a", "b"], ["CREATE TABLE `z` (`c` int)", "-1.5e3"]),
        ("other", 2): (["a", "b"], ["#__content", "2"]),
    }
    table = {r.table: (r.rows, r["columns"]) for r in dumps.inventory(statements, dumps.insert_rows(statements), dumps.created_columns(statements)).collect()}
    assert table == {"wp_users": (4, 3), "other": (2, 0)}


def test_dump_files_from_disk(spark, tmp_path):
    write(f"{tmp_path}/sql/site.sql", DUMP.replace("-- It's a comment", "-- a comment"))
    listing = dump_source.dump_files(files.listing(spark, [str(tmp_path)]))
    path = listing.first().path
    statements, rows, created = dump_source.read_rows(spark, [path])
    assert dumps.dump_rows(rows, created).count() == 6
    head = dumps.header(dump_source.head_lines(files.heads(listing))).first()
    assert (head.tool, head.server, head.host.startswith("localhost")) == ("MySQL dump", "8.0.36", True)


def test_dump_kind(spark):
    def kind(path, tool, placeholder, rows):
        return spark.range(1).select(dumps.kind_of_dump(F.lit(path), [F.lit(tool)], F.lit(placeholder), F.lit(rows)).alias("k")).first().k

    assert kind("/x/sql/install.sql", "", False, 5) == "schema" and kind("/x/sql/install.sql", "MySQL dump", True, 0) == "export"
    assert kind("/x/a.sql", "", True, 5) == "schema" and kind("/x/a.sql", "", False, 0) == "schema" and kind("/x/a.sql", "", False, 1) == "export"


def test_generic_accounts(spark):
    drupal = ["uid", "name", "mail", "pass", "created", "access", "status"]
    rows = spark.createDataFrame([
        ("d", "users_field_data", 1, drupal, ["1", "admin", "a@x.test", "$2y$10$x", "2026-01-01 00:00:00", "1", "1"]),
        ("d", "users_field_data", 2, drupal, ["2", "bob", "b@x.test", "5f4dcc3b5aa765d61d8327deb882cf99", "5", "2026-01-02 00:00:00", "0"]),
        ("d", "node_field_data", 1, ["nid"], ["1"]),
        ("d", "orders", 1, ["id", "name", "email", "total"], ["1", "n", "c@x.test", "3"]),
    ], "dump string, table string, row_no long, columns array<string>, values array<string>")
    got = {r.login: (r.cms, r.user_id, r.email, r.registered, r.hash_type, r.last_login, r.blocked) for r in accounts.accounts(rows).collect()}
    assert got == {"admin": ("Drupal", "1", "a@x.test", "2026-01-01 00:00:00", "bcrypt", "", 0),
                   "bob": ("Drupal", "2", "b@x.test", "-", "md5 (weak!)", "2026-01-02 00:00:00", 1)}


def test_joomla_legacy_admin_by_position(spark):
    rows = spark.createDataFrame([
        ("d", "jos_users", 1, [], ["62", "N", "admin", "a@x.test", "h", "0", "1", "2026-01-01 00:00:00", "0000-00-00 00:00:00"]),
        ("d", "jos_users", 2, ["id", "name", "username", "email", "password", "usertype", "block", "gid"], ["63", "N", "old", "o@x.test", "h", "Registered", "1", "25"]),
        ("d", "jos_content", 1, ["id"], ["1"]), ("d", "jos_extensions", 1, ["id"], ["1"]),
    ], "dump string, table string, row_no long, columns array<string>, values array<string>")
    got = {r.login: (r.registered, r.last_login, r.blocked, r.admin) for r in accounts.accounts(rows).collect()}
    assert got == {"admin": ("2026-01-01 00:00:00", "", 0, False), "old": ("-", "", 1, True)}


def test_cms_scope(spark):
    items = [("/s/wp-content/plugins/hello.php", "hello"), ("/s/wp-content/plugins/shop/shop.php", "shop"), ("/s/modules/mod_a", "mod_a"), ("/s/x/readme", "y")]
    df = spark.createDataFrame(items, "path string, slug string")
    kind, scope = cms.extension_scope(F.col("path"), F.col("slug"))
    assert [tuple(r) for r in df.select(kind, scope).collect()] == [
        ("file", "/s/wp-content/plugins/hello.php"), ("dir", "/s/wp-content/plugins/shop"), ("dir", "/s/modules/mod_a"), ("dir", "/s/x/readme")]


def test_evidence_candidates(spark, tmp_path, log_folder):
    base = str(tmp_path)
    for name in ("wp-config.php", "wp-includes/version.php", "wp-content/plugins/a/a.php", "wp-admin/index.php", "shop/configuration.php"):
        write(f"{base}/www/{name}", "<?php")
    write(f"{base}/db/x.sql", "-- MySQL dump\nCREATE TABLE `a` (`b` int);\n")
    write(f"{base}/db/empty.sql", "nothing")
    listing = files.listing(spark, [base])
    (root,) = candidates.web_roots(spark, listing).collect()
    assert (root.dir, root.cms, root.score) == (f"{base}/www", "wordpress", 15)
    assert [os.path.basename(r.path) for r in candidates.dump_candidates(files.heads(listing)).collect()] == ["x.sql"]
    heads = files.heads(files.listing(spark, [log_folder]))
    found = {os.path.relpath(r.dir, log_folder): r.files for r in candidates.log_directories(heads, log_folder).collect()}
    assert found == {"a": 1, "b": 6, "d [1] +%20x": 1}


def test_pattern_libraries(spark, tmp_path):
    write(f"{tmp_path}/lib.json", '[{"pattern": "/abc*", "label": "old", "note": "CVE-1"}, {"patterns": ["/x/y", "/z"], "match": "ALL", "name": "new"}, {"name": "none"}]')
    write(f"{tmp_path}/obj.json", '{"patterns": [{"id": "p1", "patterns": ["/abc*"], "about": "text"}]}')
    listed = {r.name: (r.patterns, r.match, r.cve) for r in rules.json_patterns(spark, f"{tmp_path}/lib.json").collect()}
    assert listed == {"old": (["/abc*"], "any", "CVE-1"), "new": (["/x/y", "/z"], "all", "")}
    assert rules.json_patterns(spark, f"{tmp_path}/obj.json").first().description == "text"
    text = spark.createDataFrame([("# comment",), ("/abc | name | CVE-2 | rest",), ("",)], "value string")
    (row,) = rules.line_patterns(text).collect()
    assert (row.patterns, row.name, row.cve) == (["/abc"], "name", "CVE-2 | rest")


def test_sigma_files():
    usable, broken = rules.load_sigma({
        "good.yml": "title: T\nid: a\nlevel: high\ndetection:\n  s:\n    c-uri|contains: x\n  condition: s\n",
        "off.yml": "title: T\nid: b\ndetection:\n  s:\n    c-uri: x\n  condition: s\n", "bad.yml": "title: [", "agg.yml": "title: T\nid: c\ndetection:\n  s:\n    c-uri: x\n  condition: s | count()\n"}, ["b"])
    assert [r["id"] for r in usable] == ["a"] and [b[1] for b in broken] == ["agg.yml", "bad.yml"]


def test_large_files_are_scanned_and_compared(spark, tmp_path):
    pad = b"<?php // padding\n" * 400_000  # 6.8 MB
    for side, tail in (("a", b""), ("b", b"")):
        (tmp_path / side / "lib").mkdir(parents=True)
        (tmp_path / side / "lib" / "same.php").write_bytes(pad + b"<?php system($_GET['c']);\n")
        (tmp_path / side / "lib" / "huge.bin").write_bytes(b"x" * (40 * 2**20))
        (tmp_path / side / "lib" / "other.php").write_bytes(pad + (b"1" if side == "a" else b"2"))
    left, right = (files.contents(spark, [f"{tmp_path}/{s}"], f"{tmp_path}/{s}") for s in "ab")
    diff = {r.rel: r.status for r in webroot.tree_diff(webroot.tree(left), webroot.tree(right)).collect()}
    assert diff == {"lib/same.php": "identical", "lib/huge.bin": "identical", "lib/other.php": "modified"}
    assert webroot.findings(left).filter("line is not null").count() == 0
    found = webroot.findings(left, ranges=files.ranges(left)).filter("line is not null").collect()
    assert found and {(os.path.basename(r.artifact), r.line) for r in found} == {("same.php", 400_001)}


def test_accounts_of_a_table_in_one_file_are_read_by_many_tasks(spark, tmp_path):
    from webtrail.plans import bindings

    rows = [(k, f"Customer#{k}", 1, 0.0, "AUTO") for k in range(100)] + [(7, "Customer#7", 1, 0.0, "AUTO"), (None, None, 1, 0.0, None)]
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = bindings.accounts(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert got.count() == len(rows)


RANGES = "path string, root string, length long, content binary"


def test_all_rules_read_the_ranges_in_one_pass(spark, tmp_path):
    text = b"<?php\n" + b"x\n" * 40 + b"system($_GET['c']);\n" + b"<html>\n" * 3
    conf = b"a\n" * 40 + b"auto_prepend_file x\nAddHandler application/x-httpd-php .jpg\n"
    rows = [("/r/a.php", "/r", len(text), text), ("/r/b.php", "/r", len(text) - 2, text[2:]), ("/r/.htaccess", "/r", len(conf), conf)]
    spark.createDataFrame(rows, RANGES).write.parquet(f"{tmp_path}/files")
    ranges = files.cut_ranges(spark.read.parquet(f"{tmp_path}/files"), 60, 40, 64)
    webroot.range_marks(ranges).write.parquet(f"{tmp_path}/marks")
    found = webroot.large_findings(ranges, spark.read.parquet(f"{tmp_path}/marks"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("content#") > 0
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert leaves.count("content#") == 1
    got = sorted((os.path.basename(r.path), r.rule_id, r.line) for r in found.filter("line IS NOT NULL").collect())
    assert got == [(".htaccess", "webshell.htaccess_handler", 42), (".htaccess", "webshell.htaccess_prepend", 41), ("a.php", "webshell.cmd_input", 42),
                   *[("b.php", "webshell.cmd_input", 42)], *[("b.php", "webshell.no_php", n) for n in (43, 44, 45)]]


def test_many_matches_in_a_range_are_counted_by_one_running_sum(spark):
    many = 20_000
    text = b"ab " * many
    ranges = files.cut_ranges(spark.createDataFrame([("/r/a.txt", "/r", len(text), text)], RANGES), 1 << 20, 64, 64)
    begun = time.monotonic()
    (row,) = webroot.large_own_findings(ranges, [("r", "R", None, "ab")], 3).collect()
    assert (row.matches, row.evidence) == (many, "r@0, r@3, r@6")
    assert time.monotonic() - begun < 60  # a sum per match took the square of the matches


def test_links_brackets_and_missing_targets(spark, tmp_path):
    root = tmp_path / "g[1]"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.php").write_text("<?php")
    (root / "sub" / ".htaccess").write_text("x")
    os.symlink(root, root / "sub" / "loop")
    os.symlink(root / "sub" / "a.php", root / "link.php")
    got = sorted(os.path.relpath(r.path, root) for r in files.listing(spark, [str(root)]).collect())
    assert got == ["sub/.htaccess", "sub/a.php"]
    with pytest.raises(FileNotFoundError):
        files.listing(spark, [str(tmp_path / "absent")])


def test_trees_that_were_not_read_are_not_called_modified(spark):
    schema = "path string, root string, length long, content binary"
    left = spark.createDataFrame([("/a/x", "/a", 5, None), ("/a/y", "/a", 5, b"12345")], schema)
    right = spark.createDataFrame([("/b/x", "/b", 5, None), ("/b/y", "/b", 5, None)], schema)
    assert {r.status for r in webroot.tree_diff(webroot.tree(left), webroot.tree(right)).collect()} == {"unread"}


def test_long_patterns_stay_and_skipped_entries_say_why(spark):
    from webtrail.operators import hunt

    library = spark.createDataFrame([("nine", [f"/path{k}" for k in range(9)]), ("short", ["a*"]), ("none", [])], "name string, patterns array<string>")
    assert [r.name for r in hunt.usable_paths(library).collect()] == ["nine"]
    assert {(r.name, r.reason[:7]) for r in hunt.skipped_entries(library).collect()} == {("short", "a path "), ("none", "no path")}


TRAPS = r"""-- Bob's export
CREATE TABLE `a` (`x` int, `y` text);
# it's a comment
INSERT INTO `a` VALUES (1,f(g(h(2),'(')),'v'); INSERT INTO `b` VALUES (7,'b;b');
   INSERT INTO `b` VALUES (8,'it''s
-- not a comment, it\'s a value
-- closes here'),(9,'#');
-- that's all; INSERT INTO `c` VALUES (5);
INSERT INTO `a` VALUES (3,NULL,'w');"""


def test_traps_of_a_dump(spark, tmp_path):
    (tmp_path / "t.sql").write_text(TRAPS)
    stmts, rows, created = dump_source.read_rows(spark, [str(tmp_path / "t.sql")])
    got = {(r.table, r.row_no): r["values"] for r in dumps.dump_rows(rows, created).collect()}
    assert got == {
        ("a", 1): ["1", "f(g(h(2),'('))", "v"], ("a", 2): ["3", None, "w"], ("b", 1): ["7", "b;b"],
        ("b", 2): ["8", "it's\n-- not a comment, it's a value\n-- closes here"], ("b", 3): ["9", "#"]}
    assert dumps.unclosed(dump_source.dump_lines(spark, [str(tmp_path / "t.sql")])).collect() == []
