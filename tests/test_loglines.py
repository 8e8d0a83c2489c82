"""Log lines by example: formats, vhost tokens, malformed requests, times."""

import ipaddress
import random

from pyspark.sql import functions as F

from webtrail.functions import indicators, loglines, times, uris
from webtrail.functions.text import excerpt, fingerprint, spreadsheet_safe

T = "10/Jun/2026:22:58:11 +0200"


def parse(spark, *lines):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "pos long, value string")
    return [r.record for r in loglines.with_record(df).orderBy("pos").collect()]


def test_formats(spark):
    combined = f'203.0.113.7 - - [{T}] "GET /a?b=1 HTTP/1.1" 200 512 "-" "sqlmap/1.7"'
    vhost = f'www.example.test 203.0.113.7 - - [{T}] "POST /x HTTP/1.1" 302 - "ref" "UA \\"q\\"" 0.01 trailer'
    panel = f'203.0.113.7 - - [{T}] "GET /p HTTP/2.0" 200 7 panel "r" "ua"'
    common = f'203.0.113.7 - - [{T}] "GET /c HTTP/1.0" 404 12'
    malformed = f'203.0.113.7 - - [{T}] "" 408 - "-" "-"'
    raw = f'203.0.113.7 - - [{T}] "\\x16\\x03\\x01" 400 226 "-" "-"'
    junk = "cut record 200 12"
    a, b, c, d, e, f, g = parse(spark, combined, vhost, panel, common, malformed, raw, junk)
    assert (a.ip, a.method, a.uri, a.status, a.size, a.agent) == ("203.0.113.7", "GET", "/a?b=1", 200, 512, "sqlmap/1.7")
    assert (b.ip, b.size, b.agent) == ("203.0.113.7", None, 'UA \\"q\\"')
    assert (c.uri, c.referrer) == ("/p", "r")
    assert (d.uri, d.status, d.agent) == ("/c", 404, "")
    assert (e.method, e.uri) == ("-", "-")
    assert (f.method, f.uri) == ("-", "\\x16\\x03\\x01")
    assert g is None
    assert (a.epoch, a.tz) == (1781125091, 7200)


def test_long_fields_do_not_recurse(spark):
    agent = 'a\\"' * 4000
    (r,) = parse(spark, f'1.2.3.4 - - [{T}] "GET /{"b" * 60000} HTTP/1.1" 200 1 "-" "{agent}"')
    assert len(r.uri) == 60001 and len(r.agent) == 12000


def test_unreadable_time_keeps_the_request(spark):
    a, b, c = parse(
        spark, '1.2.3.4 - - [06/Xxx/2026:08:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "-"',
        '1.2.3.4 - - [06/Jan/2026:08:00:00 -0530] "GET / HTTP/1.1" 200 1 "-" "-"',
        '1.2.3.4 - - [31/Feb/2026:08:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "-"')
    assert a.epoch is None and a.tz is None and a.ip == "1.2.3.4"
    assert b.tz == -19800 and b.epoch == 1767686400 + 19800
    assert c.epoch is None


def test_error_lines(spark):
    lines = [
        "[Mon Jan 06 08:00:00.000000 2026] [php:error] [pid 1] [client 203.0.113.7:4711] PHP Fatal error: x in /var/www/a.php on line 3",
        "[Fri Jun  6 05:19:59 2026] [error] [client [2001:db8::1]:80] PHP Notice: y in C:\\www\\b.inc:9",
        "2026/06/30 11:52:26 [error] 7#8: PHP Parse error in /x/c.phtml.bak",
        '203.0.113.7 - - [x] "GET / HTTP/1.1" 200 1',
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "pos long, value string")
    rows = loglines.with_error_record(df).withColumn("p", loglines.php_paths(F.col("message"))).orderBy("pos").collect()
    assert [r.client for r in rows] == ["203.0.113.7", "2001:db8::1", ""]
    assert [r.epoch_naive for r in rows] == [1767686400, 1780723199, 1782820346]
    assert [[tuple(p) for p in r.p] for r in rows] == [
        [("/var/www/a.php", 3)], [("C:\\www\\b.inc", 9)], [("/x/c.phtml.bak", None)]]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_uri_parts(spark):
    assert one(spark, uris.leaf(F.lit("/A/Shell.PHP/?x=/y"))) == "shell.php"
    assert one(spark, uris.uri_query(F.lit("/a"))) == ""
    assert one(spark, uris.suffixes(F.lit("/a/b/c.php"))) == ["a/b/c.php", "b/c.php", "c.php"]
    assert one(spark, uris.prefixes(F.lit("/a/b"))) == ["", "/a", "/a/b"]
    assert one(spark, uris.web_path(F.lit("/ev/site/Images/X.php"), ["/ev", "/ev/site"])) == "images/x.php"
    assert one(spark, uris.web_path(F.lit("/else/X.php"), ["/ev"])) == "x.php"
    assert one(spark, uris.evidence_path(F.lit("/ev/site"), ["/ev/site"])) == "site"


def test_times(spark):
    assert one(spark, times.offset_label(F.lit(-19800))) == "UTC-05:30"
    assert one(spark, times.render(F.lit(0), F.lit(0))) == "—"
    for text, want in (("2026-01-06 08:00:00", 1767686400), ("06.01.2026", 1767657600),
                       ("Jan 06, 2026 at 08:00 AM", 1767686400), ("2026-01-06T08:00:00", 1767686400), ("soon", None)):
        assert one(spark, times.export_seconds(F.lit(text))) == want, text
    for seconds, want in ((89, "89 s"), (5399, "89 min"), (7200, "2 h"), (23 * 86400, "23 d")):
        assert one(spark, times.span_words(F.lit(seconds))) == want
    rate = times.login_rate(F.lit(92), F.lit(1000), F.lit(1000 + 23 * 86400))
    assert one(spark, rate) == "over 23 d (0.167/h) "
    assert one(spark, times.login_rate(F.lit(40), F.lit(5), F.lit(5))) == "within one second "


def test_text(spark):
    assert one(spark, fingerprint(F.lit("logs"), F.lit("r"), F.lit("a"), F.lit(None).cast("int"))) == one(
        spark, fingerprint(F.lit("logs"), F.lit("r"), F.lit("a"), F.lit(0)))
    assert one(spark, spreadsheet_safe(F.lit("=cmd"))) == "'=cmd"
    assert one(spark, excerpt(F.lit("a" * 100 + "<iframe " + "b" * 100), r"<iframe[\s>]")).startswith("…aaa")


def test_indicator_types(spark):
    cases = {"1.2.3.4": "ip", "d41d8cd98f00b204e9800998ecf8427e": "hash", "https://a.test/x": "url", "a@b.test": "email",
             "/x/y": "path", "shell.php": "path", "a.b.co-uk": "domain", "x": "other", "999.1.1.1": "path"}
    for value, want in cases.items():
        assert one(spark, indicators.classify(F.lit(value))) == want, value
    assert one(spark, indicators.defang(F.lit("https://a.test"), F.lit("url"))) == "hxxps://a[.]test"
    assert one(spark, indicators.ipv4_range(F.lit("203.0.113.9"))) == "documentation"
    six = spark.createDataFrame([("2001:0DB8:0:0:0:0:0:1",), ("8:8",), ("::1",)], "v string")
    got = six.select(indicators.compressed_ipv6(F.col("v")).alias("c"), indicators.ipv6_range(F.col("v")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("2001:db8::1", "documentation"), (None, None), ("::1", "loopback")]


def test_ipv6_against_the_library(spark):
    """Any text of the characters of an address, and addresses in random spellings."""
    dice = random.Random(8)
    texts = {"::", "::1", "1::", "0:0:1::", "::ffff:1.2.3.4", "::ffff:127.0.0.1", "::ffff:203.0.113.9", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.04", "fe80::1%eth0", "fe80::1%",
             ":::", "1:::2", "12345::", "2002:a00:1::", "2001:20::1", "2001:3::", "2001:4:112::7", "2001:5::", "100::7", "100:0:0:1::", "fbff::", "febf::1", "fec0::", "ff00::", "", "1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8"}
    for _ in range(400):
        words = [dice.choice(["0", "0", "0000", "%x" % dice.randrange(1 << 16), "%04X" % dice.randrange(1 << 16), "2001", "db8", "fe80", "ff02"]) for _ in range(dice.choice([8, 8, 8, 3, 7, 9]))]
        text = ":".join(words)
        if dice.random() < 0.5 and len(words) > 2:
            k = dice.randrange(len(words))
            text = ":".join(words[:k]) + "::" + ":".join(words[k + dice.randint(1, 3):])
        texts.add(text)
        texts.add("".join(dice.choices("0:1fG.", k=dice.randint(1, 12))))

    def compressed(v):
        try:
            return ipaddress.IPv6Address(v).compressed
        except ValueError:
            return None

    def special(v):
        try:
            a = ipaddress.IPv6Address(v)
        except ValueError:
            return None
        tests = (("documentation", a in ipaddress.ip_network("2001:db8::/32")), ("loopback", a.is_loopback), ("link-local", a.is_link_local), ("multicast", a.is_multicast),
                 ("private", a.is_private), ("reserved", not a.is_global))
        return next((name for name, holds in tests if holds), "")

    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    got = rows.select("v", indicators.compressed_ipv6(F.col("v")).alias("c"), indicators.ipv6_range(F.col("v")).alias("r")).collect()
    for r in got:
        assert (r.v, r.c) == (r.v, compressed(r.v))
        assert (r.v, r.r) == (r.v, special(r.v))
