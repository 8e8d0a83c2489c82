"""Personal data in texts by weak supervision, in DataFrame functions alone.

Candidates come from regular expressions: the four base kinds, and looser forms of the same
kinds. On every candidate five labellers vote: the strict form of the kind (regex), a
gazetteer (top-level domains, issuers, country codes, reserved networks), words before it
(context), what touches it (boundary) and whether it is a base match. Counts of the vote
patterns over all candidates, at most 4 * 3 ** 5, feed an expectation-maximisation that
estimates how far each labeller can be trusted for each kind; its posteriors weight a final
span classifier over hashed features (votes, shape, the word before), whose weights are grouped
sums. Base matches stay whatever it says; of the looser candidates it decides.

Base kinds, leftmost and without overlap in a kind, follow the patterns in BASE; possessive
forms give the same matches without backtracking over long runs. Offsets are code points.

Defined cases: null and empty texts have no spans. A looser candidate that overlaps a base
match is dropped. Repeated rows are answered each. Without any candidate the classifier knows
nothing and nothing is added. An empty table gives an empty result. Other columns are ignored
(`redact` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm.common import query, scratch, stored, table

KINDS = ("email", "ip", "card", "phone")
BUCKETS = 512
CONTEXT = 40
ACCEPT = 0.5

# The base patterns of the kinds, as possessive forms.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms of the same kinds.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}|[0-9A-Fa-f:]+)$",
    "card": r"^(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|\(dot\)|\[dot\]) ?(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|co|me|tv|eu|uk|us|ca|au|nz|ie|de|at|ch|fr|be|nl|lu|es|pt|it|pl|cz|se|no|dk|fi|ru|ua|tr|gr|in|cn|jp|kr|br|mx|ar|cl|za)$",
    "ip": r"^(?!0\.|255\.|22[4-9]\.|23[0-9]\.|24[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65|62)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-69]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})|\(?[2-9])",
}
HINTS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|adresse|client|from)\b",
    "card": r"(?i)\b(?:card|visa|master ?card|amex|credit|debit|pay|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|teléfono|téléphone)\b",
}
AGAINST = r"(?i)\b(?:version|release|isbn|serial|order|invoice|id|ref|sku|section|figure|table)\b[ :#.]*$"
VOTES = ("strict", "gazetteer", "context", "boundary", "base")
#: A base form has @, or a digit followed by five characters of its kind.
GATE = {"email": r"@", "digits": r"[0-9][0-9\x20().-]{5}"}
SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    each = f"transform(split(reverse({digits}), ''), (c, k) -> IF(k % 2 = 0, CAST(c AS INT), IF(CAST(c AS INT) > 4, 2 * CAST(c AS INT) - 9, 2 * CAST(c AS INT))))"
    return f"aggregate({each}, 0, (a, x) -> a + x) % 10 = 0"


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(m, '\\\\.'), x -> length(ltrim('0', x)) <= 3 AND coalesce(CAST(nullif(ltrim('0', x), '') AS INT), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}
LOOSE_VALID = {"email": "true", "ip": "true", "card": _luhn(_DIGITS), "phone": "true"}


def _vote(kind: int) -> tuple[str, str]:
    """Votes of the labellers and hashed features of a candidate (m, before, after, base)."""
    name = KINDS[kind]
    votes = ("array("
             f"IF(m RLIKE {_quote(STRICT[name])}, 1, -1), "
             f"IF(m RLIKE {_quote(GAZETTEER[name])}, 1, -1), "
             f"CASE WHEN before RLIKE {_quote(AGAINST)} THEN -1 WHEN before RLIKE {_quote(HINTS[name])} THEN 1 ELSE 0 END, "
             "IF(before RLIKE '[\\\\p{L}\\\\p{N}_]$' OR after RLIKE '^[\\\\p{L}\\\\p{N}_]', -1, 1), "
             "IF(base, 1, 0))")
    shape = "regexp_replace(regexp_replace(regexp_replace(left(m, 32), '[0-9]', '9'), '[A-Za-z]+', 'a'), '9{4,}', '9999')"
    word = "lower(regexp_extract(before, '([\\\\p{L}]{1,20})[^\\\\p{L}]{0,3}$', 1))"
    features = ", ".join(f"CAST(pmod(xxhash64({kind}, {source}), {BUCKETS}) AS INT)" for source in (f"'shape', {shape}", f"'word', {word}"))
    return votes, f"array({features})"


def _candidates(kind: int, matches: str, pieces: str, base: bool) -> str:
    """The valid matches of one pattern as spans. `pieces` is the text between the matches, so
    offsets are running sums and what stands around a match is the end and start of a piece."""
    name = KINDS[kind]
    ends = f"aggregate(zip_with({matches}, slice({pieces}, 1, size({matches})), (m, p) -> length(m) + length(p)), array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    votes, features = _vote(kind)
    plain = f"transform({matches}, (m, k) -> named_struct('m', m, 'k', k))"
    valid = VALID[name] if base else LOOSE_VALID[name]
    kept = f"filter({plain}, s -> exists(array(s.m), m -> {valid}))"
    # One level of transform per name keeps each part computed once.
    with_place = (f"transform({kept}, s -> named_struct('m', s.m, 'end', element_at({name}_{'b' if base else 'l'}_ends, s.k + 2),"
                  f" 'before', right(element_at({pieces}, s.k + 1), {CONTEXT}), 'after', left(element_at({pieces}, s.k + 2), 8), 'base', {str(base).lower()}))")
    voted = (f"transform({with_place}, s -> named_struct('kind', {kind}, 'start', s.end - length(s.m), 'end', s.end, 'base', s.base, 'votes', "
             f"{votes.replace('before', 's.before').replace('after', 's.after').replace('(m ', '(s.m ').replace('base,', 's.base,')}, 'features', "
             f"{features.replace('before', 's.before').replace('left(m', 'left(s.m')}))")
    return ends, voted


def detect(docs: DataFrame) -> DataFrame:
    """The rows with `candidates`, an array of SPAN: all base matches by kind and start, then
    looser candidates that overlap none of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_text", text)
    rows = rows.withColumn("_digits", F.col("_text").rlike(GATE["digits"])).withColumn("_at", F.col("_text").contains("@"))
    none = F.lit(None).cast("array<string>")
    sources = []
    for kind, name in enumerate(KINDS):
        for base, patterns in ((True, BASE), (False, LOOSE)):
            tag = f"{name}_{'b' if base else 'l'}"
            gate = F.col("_at") if name == "email" and base else F.col("_text").rlike(r"(?i)[(\[]at[)\]]") if name == "email" else F.col("_text").contains(":") & F.col("_text").rlike("(?:[0-9A-Fa-f]{1,4}:){7}") if name == "ip" and not base else F.col("_digits")
            if name == "phone" and base:
                gate = gate & F.col("_text").contains("+")
            sources.append((kind, base, tag, patterns[name], gate))
    rows = rows.select("*", *(F.when(gate, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{tag}_m") for _, _, tag, pattern, gate in sources))
    rows = rows.select("*", *(F.when(F.size(f"{tag}_m") > 0, F.split("_text", pattern, -1)).alias(f"{tag}_p") for _, _, tag, pattern, _ in sources))
    parts = {tag: _candidates(kind, f"{tag}_m", f"{tag}_p", base) for kind, base, tag, _, _ in sources}
    rows = rows.select("*", *(F.expr(f"CASE WHEN size({tag}_m) > 0 THEN {ends} END").alias(f"{tag}_ends") for tag, (ends, _) in parts.items()))
    empty = f"CAST(array() AS array<{SPAN}>)"
    rows = rows.select("*", *(F.expr(f"CASE WHEN size({tag}_m) > 0 THEN CAST({voted} AS array<{SPAN}>) ELSE {empty} END").alias(f"{tag}_s") for tag, (_, voted) in parts.items()))
    base = "concat(" + ", ".join(f"{name}_b_s" for name in KINDS) + ")"
    loose = "concat(" + ", ".join(f"{name}_l_s" for name in KINDS) + ")"
    rows = rows.withColumn("_base", F.expr(base)).withColumn("_loose", F.expr(loose))
    kept = F.expr("CASE WHEN size(_loose) = 0 THEN _base ELSE concat(_base, filter(_loose, l -> NOT exists(_base, b -> b.start < l.end AND l.start < b.end))) END")
    return rows.select(*docs.columns, kept.alias("candidates"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) by expectation-maximisation over counted patterns."""
    post = {}
    for kind in range(len(KINDS)):
        mine = [(votes, n) for k, votes, n in patterns if k == kind]
        if not mine:
            continue
        total = sum(n for _, n in mine)
        belief = 0.1 * total + 1
        p = {votes: 0.95 if votes[4] == 1 and votes[0] == 1 else 0.6 if sum(votes) > 0 else 0.2 for votes, _ in mine}
        for _ in range(rounds):
            share = min(0.999, max(0.001, (sum(n * p[v] for v, n in mine) + 0.5 * belief) / (total + belief)))
            like = []
            for labeller in range(len(VOTES)):
                right = [0.8, 0.2]  # a vote for is likelier on personal data, before any data
                tables = []
                for positive in (True, False):
                    weight = lambda v: p[v] if positive else 1 - p[v]  # noqa: E731, B023
                    yes = sum(n * weight(v) for v, n in mine if v[labeller] == 1) + belief * right[0 if positive else 1]
                    no = sum(n * weight(v) for v, n in mine if v[labeller] == -1) + belief * right[1 if positive else 0]
                    tables.append({1: yes / (yes + no), -1: no / (yes + no), 0: 1.0})
                like.append(tables)
            for votes, _ in mine:
                odds = math.log(share / (1 - share)) + sum(math.log(like[h][0][v] / like[h][1][v]) for h, v in enumerate(votes))
                p[votes] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        post.update({(kind, votes): value for votes, value in p.items()})
    return post


def fit(spans: DataFrame) -> tuple[list[float], float]:
    """spans: kind, votes, features, one row per candidate -> weights of the buckets and bias."""
    counted = spans.groupBy("kind", "votes").count().collect()  # at most 4 * 3 ** 5 rows
    if not counted:
        return [0.0] * BUCKETS, -1.0
    post = reliabilities([(r["kind"], tuple(r["votes"]), r["count"]) for r in counted])
    small = spans.sparkSession.createDataFrame([(k, list(v), p) for (k, v), p in post.items()], "kind int, votes array<int>, post double")
    weighted = spans.join(small, ["kind", "votes"]).select("post", F.explode(_all_features(F.col("kind"), F.col("votes"), F.col("features"))).alias("bucket"))
    sums = weighted.groupBy("bucket").agg(F.sum("post").alias("yes"), F.sum(1 - F.col("post")).alias("no")).collect()  # BUCKETS rows
    yes = sum(r["yes"] for r in sums)
    no = sum(r["no"] for r in sums)
    weights = [0.0] * BUCKETS
    for r in sums:
        weights[r["bucket"]] = math.log((r["yes"] + 1) / (yes + BUCKETS) * (no + BUCKETS) / (r["no"] + 1))
    return weights, math.log((yes + 1) / (no + 1))


def _all_features(kind, votes, features):
    voted = F.transform(votes, lambda v, k: F.pmod(F.xxhash64(kind, F.lit("vote"), k, v), F.lit(BUCKETS)).cast("int"))
    return F.concat(voted, features)


def score(spans, weights: list[float], bias: float):
    """The array of spans with the classifier's score; base spans and accepted ones stay."""
    known = F.array(*(F.lit(w) for w in weights))
    def one(s):
        total = F.aggregate(_all_features(s["kind"], s["votes"], s["features"]), F.lit(bias), lambda a, f: a + F.get(known, f))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), (1 / (1 + F.exp(-total))).alias("score"))
    kept = F.filter(F.transform(spans, one), lambda s: s["base"] | (s["score"] >= ACCEPT))
    return F.array_sort(kept)  # by kind, then start


def text_of(spans):
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, found (array with scores)."""
    seen = stored(detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "candidates"), "spans")
    weights, bias = fit(seen.select(F.explode("candidates").alias("s")).select("s.kind", "s.votes", "s.features"))
    rows = seen.select("doc_id", score(F.col("candidates"), weights, bias).alias("found"))
    base = F.filter("found", lambda s: s["base"])
    rows = rows.withColumn("_base", base)
    counts = [F.expr(f"CAST(size(filter(_base, s -> s.kind = {k})) AS LONG) AS n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(text_of(F.col("_base")), 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every span of `text` replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; spans
    that overlap are replaced as one, by a tag for each of their kinds as they begin."""
    def fitted() -> tuple[list[float], float]:
        # Stored before it is exploded: else the filter on its size repeats all patterns.
        seen = stored(detect(docs.select("text")).select("candidates"), "spans").where(F.size("candidates") > 0)
        return fit(seen.select(F.explode("candidates").alias("s")).select("s.kind", "s.votes", "s.features"))

    with scratch(docs.sparkSession):
        weights, bias = fitted()
    # The caller's columns travel in one, so that none of their names can meet those used here.
    rows = detect(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs["text"].cast("string").alias("text")))
    rows = rows.withColumn("_found", F.when(F.size("candidates") > 0, score(F.col("candidates"), weights, bias)))
    ordered = "array_sort(transform(_found, s -> named_struct('start', s.start, 'back', -s.end, 'kind', s.kind)))"
    flat = (f"aggregate({ordered}, CAST(array() AS array<struct<start:int,back:int,kinds:array<int>>>),"
            " (a, s) -> IF(size(a) > 0 AND s.start < -get(a, size(a) - 1).back,"
            " concat(slice(a, 1, size(a) - 1), array(named_struct('start', get(a, size(a) - 1).start, 'back', least(get(a, size(a) - 1).back, s.back),"
            " 'kinds', array_union(get(a, size(a) - 1).kinds, array(s.kind))))),"
            " concat(a, array(named_struct('start', s.start, 'back', s.back, 'kinds', array(s.kind))))))")
    rows = rows.withColumn("_flat", F.expr(f"CASE WHEN size(_found) > 0 THEN {flat} END"))
    tags = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    pieces = ("transform(_flat, (s, k) -> concat(substring(text, IF(k = 0, 0, -element_at(_flat, k).back) + 1, s.start - IF(k = 0, 0, -element_at(_flat, k).back)),"
              f" array_join(transform(s.kinds, j -> get({tags}, j)), '')))")
    done = F.expr(f"CASE WHEN size(_flat) > 0 THEN concat(array_join({pieces}, ''), substring(text, 1 - element_at(_flat, -1).back)) ELSE text END")
    return rows.select("_row", done.alias("_done")).select(*(F.col("_done").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


@query("op5_pii")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return find(table(spark, sf, "documents")).drop("found")
