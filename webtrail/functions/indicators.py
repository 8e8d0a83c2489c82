"""Indicator values: type, match key, STIX pattern, defanging, address ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed


def is_ipv4(value: Column) -> Column:
    return value.rlike("^" + fixed.IPV4 + "$")


_ZONE = r"^([^%]*)%([^%]+)$"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ipv6_words(value: Column) -> Column:
    """The eight 16-bit words of an IPv6 address (whatever its zone), NULL for anything else."""
    none = F.array().cast("array<string>")
    side = lambda part: F.when(part == "", none).otherwise(F.split(part, ":", -1))

    def undotted(text):
        last = F.substring_index(text, ":", -1)
        four = lambda p: F.concat(
            F.left(text, F.length(text) - F.length(last)), F.lower(F.hex(p[0] * 256 + p[1])), F.lit(":"), F.lower(F.hex(p[2] * 256 + p[3])))
        return F.when(text.rlike("^.*:" + fixed.IPV4 + "$"), _let(F.transform(F.split(last, r"\."), lambda x: x.cast("int")), four)).otherwise(text)

    def words(groups):
        given = F.size(groups["l"]) + F.size(groups["r"])
        whole = F.concat(groups["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - given)), groups["r"])
        fits = (~groups["short"] & (given == 8)) | (groups["short"] & (given <= 7))
        return F.when(fits & F.forall(whole, lambda w: w.rlike("^[0-9a-f]{1,4}$")), F.transform(whole, lambda w: F.conv(w, 16, 10).cast("long")))

    def cut(parts):
        right = F.when(F.size(parts) == 2, side(F.get(parts, F.lit(1)))).otherwise(none)
        groups = F.struct(side(parts[0]).alias("l"), right.alias("r"), (F.size(parts) == 2).alias("short"))
        return F.when(F.size(parts) <= 2, _let(groups, words))

    text = F.lower(F.when(value.rlike(_ZONE), F.regexp_extract(value, _ZONE, 1)).otherwise(value))
    return _let(_let(text, undotted), lambda body: _let(F.split(body, "::", -1), cut))


def ipv6_halves(words: Column) -> tuple[Column, Column]:
    """The address as two longs."""
    half = lambda at: F.shiftleft(words[at], 48).bitwiseOR(F.shiftleft(words[at + 1], 32)).bitwiseOR(F.shiftleft(words[at + 2], 16)).bitwiseOR(words[at + 3])
    return half(0), half(4)


def _is_mapped(words: Column) -> Column:
    return F.forall(F.slice(words, 1, 5), lambda w: w == 0) & (words[5] == 0xFFFF)


def _mapped_ipv4(words: Column) -> Column:
    byte = lambda w, high: F.shiftright(w, 8) if high else w.bitwiseAND(255)
    return F.concat_ws(".", byte(words[6], True), byte(words[6], False), byte(words[7], True), byte(words[7], False))


def compressed_ipv6(value: Column) -> Column:
    """The shortest spelling of an IPv6 address, NULL for anything else: the first of the longest runs
    of zero words is left out; an address that stands for an IPv4 one ends in that."""
    def shortened(line):
        short = line
        for n in range(2, 9):
            run = ":0" * n + ":"
            cut = F.concat(F.substring_index(line, run, 1), F.lit("::"), F.substr(line, F.instr(line, run) + len(run)))
            short = F.when(F.contains(line, F.lit(run)), cut).otherwise(short)
        return short

    def bare(short):
        first = F.when(short.startswith("::"), short).otherwise(F.substr(short, F.lit(2)))
        return F.when(short.endswith("::"), first).otherwise(F.left(first, F.length(first) - 1))

    def spelt(words):
        line = F.concat(F.lit(":"), F.array_join(F.transform(words, lambda w: F.lower(F.hex(w))), ":"), F.lit(":"))
        return F.when(_is_mapped(words), F.concat(F.lit("::ffff:"), _mapped_ipv4(words))).otherwise(_let(_let(line, shortened), bare))

    zone = F.when(value.rlike(_ZONE), F.concat(F.lit("%"), F.regexp_extract(value, _ZONE, 2))).otherwise("")
    return F.concat(_let(ipv6_words(value), lambda w: F.when(w.isNotNull(), spelt(w))), zone)


# IPv6 ranges that never belong to a country, and the parts of the private one that do.
IPV6_RANGES = (
    ("documentation", ("2001:db8::/32",)),
    ("loopback", ("::1/128",)),
    ("link-local", ("fe80::/10",)),
    ("multicast", ("ff00::/8",)),
    ("private", ("::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2002::/16", "fc00::/7")),
)
IPV6_GLOBAL = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def prefix_mask(length: int) -> tuple[int, int]:
    """The two halves of a mask of that many leading bits, as signed longs."""
    whole = ((1 << length) - 1) << (128 - length)
    return _signed(whole >> 64), _signed(whole & ((1 << 64) - 1))


def _inside_ipv6(halves: tuple[Column, Column], network: str) -> Column:
    net = ipaddress.ip_network(network)
    number = int(net.network_address)
    first, second = prefix_mask(net.prefixlen)
    hit = halves[0].bitwiseAND(F.lit(first)) == F.lit(_signed(number >> 64))
    return hit & (halves[1].bitwiseAND(F.lit(second)) == F.lit(_signed(number & ((1 << 64) - 1)))) if net.prefixlen > 64 else hit


def ipv6_range(value: Column) -> Column:
    """Special-range class of an IPv6 address ('' for a plain one, NULL for junk). An address that
    stands for an IPv4 one has that one's class; what documents there is private here."""
    def ranged(address):
        halves = address["hi"], address["lo"]
        result = None
        for name, networks in IPV6_RANGES:
            for network in networks:
                hit = _inside_ipv6(halves, network)
                if network == "2001::/23":
                    for part in IPV6_GLOBAL:
                        hit = hit & ~_inside_ipv6(halves, part)
                result = F.when(hit, name) if result is None else result.when(hit, name)
        return result.otherwise("")

    def classed(words):
        high, low = ipv6_halves(words)
        mapped = _let(ipv4_range(_mapped_ipv4(words)), lambda inner: F.when(inner == "documentation", "private").otherwise(F.coalesce(inner, F.lit(""))))
        return F.when(_is_mapped(words), mapped).otherwise(_let(F.struct(high.alias("hi"), low.alias("lo")), ranged))

    return _let(ipv6_words(value), lambda w: F.when(w.isNotNull(), classed(w)))


def may_be_ipv6(value: Column) -> Column:
    return value.rlike(r"^[0-9A-Fa-f:.]+(%\w+)?$") & value.contains(":")


def classify(value: Column, ipv6: Column | None = None) -> Column:
    """Indicator type; the order of the tests decides.

    ``ipv6`` is the compressed form when the caller has computed it already.
    """
    text = F.trim(value)
    six = ipv6.isNotNull() if ipv6 is not None else F.lit(False)
    return (
        F.when(is_ipv4(text) | six, "ip")
        .when(text.rlike(fixed.HASH_SHAPE), "hash")
        .when(text.rlike(fixed.URL_SHAPE), "url")
        .when(text.rlike(fixed.EMAIL_SHAPE), "email")
        .when(text.contains("/") | text.contains("\\"), "path")
        .when(text.rlike(fixed.FILENAME_SHAPE), "path")
        .when(text.rlike(fixed.DOMAIN_SHAPE), "domain")
        .otherwise("other")
    )


def match_value(kind: Column, value: Column, ipv6: Column | None = None) -> Column:
    """Equality key across cases: paths and user names keep their case."""
    text = F.trim(value)
    folded = F.when(kind.isin("hash", "domain", "email"), F.lower(text)).otherwise(text)
    if ipv6 is None:
        return folded
    return F.when((kind == "ip") & ipv6.isNotNull(), ipv6).otherwise(folded)


def hosts_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.HOST_ANYWHERE), F.lit(1)))


def addresses_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.IP_ANYWHERE), F.lit(0))


def defang(value: Column, kind: Column) -> Column:
    scheme = F.regexp_replace(value, r"(?i)^http(s?)://", "hxxp$1://")
    dotted = F.replace(F.when(kind == "url", scheme).otherwise(value), F.lit("."), F.lit("[.]"))
    return (
        F.when(kind.isin("ip", "domain", "url"), dotted)
        .when(kind == "email", F.replace(dotted, F.lit("@"), F.lit("[at]")))
        .otherwise(value)
    )


def ipv4_number(value: Column) -> Column:
    """Dotted IPv4 as an integer, NULL for anything else."""
    part = F.split(value, r"\.")
    number = sum((part[i].try_cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0))
    return F.when(is_ipv4(value), number)


def _inside(number: Column, network: str) -> Column:
    net = ipaddress.ip_network(network)
    return number.between(int(net.network_address), int(net.broadcast_address))


# IPv4 ranges that never belong to a country, most specific statement
# first (documentation, then the class of the range).
IPV4_RANGES = (
    ("documentation", fixed.DOCUMENTATION_NETS),
    ("loopback", ("127.0.0.0/8",)),
    ("link-local", ("169.254.0.0/16",)),
    ("multicast", ("224.0.0.0/4",)),
    ("private", ("0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16",
                 "198.18.0.0/15", "240.0.0.0/4")),
    ("reserved", ("100.64.0.0/10",)),
)


def ipv4_range(value: Column) -> Column:
    """Special-range class of an IPv4 address, NULL for a plain one."""
    def ranged(number):
        result = None
        for name, networks in IPV4_RANGES:
            for network in networks:
                hit = _inside(number, network)
                result = F.when(hit, name) if result is None else result.when(hit, name)
        return result

    return _let(ipv4_number(value), ranged)


def stix_pattern(value: Column, kind: Column) -> Column:
    """STIX 2.1 pattern text, NULL for a type STIX has no object for."""
    def quoted(c):
        return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))

    def pattern(head, body):
        return F.concat(F.lit("[" + head + " = '"), body, F.lit("']"))

    text = quoted(value)
    scheme = (F.when(F.length(value) == 32, "MD5").when(F.length(value) == 40, "SHA-1")
              .otherwise("SHA-256"))
    name = F.substring_index(F.rtrim(F.translate(value, "\\", "/"), F.lit("/")), "/", -1)
    return (
        F.when((kind == "ip") & value.contains(":"), pattern("ipv6-addr:value", text))
        .when(kind == "ip", pattern("ipv4-addr:value", text))
        .when(kind == "domain", pattern("domain-name:value", text))
        .when(kind == "url", pattern("url:value", text))
        .when(kind == "email", pattern("email-addr:value", text))
        .when(kind == "user", pattern("user-account:account_login", text))
        .when(kind == "hash", F.concat(F.lit("[file:hashes.'"), scheme, F.lit("' = '"), text, F.lit("']")))
        .when(kind == "path", pattern("file:name", quoted(name)))
    )


def password_scheme(value: Column) -> Column:
    return (
        F.when(value.isNull() | (value == ""), "-")
        .when(value.startswith("$2y$") | value.startswith("$2a$") | value.startswith("$2b$"), "bcrypt")
        .when(value.startswith("$P$") | value.startswith("$H$"), "phpass")
        .when(value.startswith("$wp$"), "wp-hash")
        .when(value.startswith("$argon"), "argon2")
        .when(value.rlike("^[0-9a-fA-F]{32}$"), "md5 (weak!)")
        .otherwise("other")
    )


def finding_category(source: Column, rule: Column) -> Column:
    result = None
    for src, needle, category in fixed.CATEGORY_RULES:
        hit = (source == src) & rule.contains(needle) if needle else source == src
        result = F.when(hit, category) if result is None else result.when(hit, category)
    return result.otherwise("other")
