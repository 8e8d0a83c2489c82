"""Main text of web pages by wrappers inferred per host.

A page is a stream of tags and texts. The streams of all different pages of a host are aligned
into a union-free regular expression, the wrapper: equal neighbours become repeated
groups, what only some pages have becomes optional, texts that differ become slots. The part
of the wrapper whose slots hold most of the varying text is where the host keeps its articles;
every page of the host is then read there as a whole.

The part of a page that stands there is read with all its instances (a repeated group is read
whole). Whole containers whose text is the same on all pages of the host are no part of an article.

A wrapper is fitted on every page of its host. Pages are dealt by their digest to bins of about
BIN_PAGES, each bin is aligned in one task, and the wrappers of FAN_IN bins are aligned with one
another until a host has one: no task sees a host as a whole, and how the table is cut into files
changes nothing. Copies count once. A page that does not follow its host's wrapper is judged by its own tags.

Within the article, menus, headers without a heading, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out; character references are decoded;
white space inside a block becomes one space; blocks are joined by an empty line. Names in class
and id decide on containers only, by whole names ("sidebar", "ad-box"; not "with-sidebar" or
"comment-on-law"), never on headings and paragraphs, and not where a container holds the heading
of the page, its main element or (but for comments) most of its text.

Trees are walked with stacks of their own: nesting may be of any depth.

Defined cases: a null or empty html gives an empty text; broken markup is closed as browsers
do; a quote without end in a tag ends with the tag; a null url is a host of its own; repeated rows
are answered each; other columns of the input are kept out of the result; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm.common import query, stored, table, text_pass

BIN_PAGES = 128
FAN_IN = 16
KNOWN_DIGESTS = 1 << 18  # that a task remembers to leave out copies before the shuffle
FEWEST_PAGES = 3  # different pages that make a container fixed

# Elements of HTML by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OUTSIDE = {"head", "nav", "footer", "aside", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas", *RAW}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
         "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
         "popup", "promo", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
         "subscribe", "toolbar", "widget"}
# Words that beside these names still name a container of them, and names of what readers wrote.
PLAIN = {"area", "bar", "block", "body", "bottom", "box", "container", "content", "wrap", "wrapper", "inner", "item", "items", "left", "link", "links", "list", "outer",
         "panel", "posts", "primary", "right", "secondary", "section", "site", "top", "unit", "zone"}
READERS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "nav", "aside", "form", "html"}

# A quote opens a value only behind an equals sign, and only if it is closed.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    key: str  # class and id
    role: str
    kids: list = field(default_factory=list)  # nodes and texts


def parse(source: str) -> Node:
    """A tree; inline elements are dropped and their text kept, script-like ones are dropped whole."""
    root = Node("html", "", "")
    stack = [root]
    at = 0
    raw = None
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].kids.append(source[at:m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in INLINE or name in VOID:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name not in SCOPES and stack[k].tag in SCOPES:
                    break
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in INLINE:
            continue
        if name == "br":
            stack[-1].kids.append("\n")
            continue
        if name in VOID:
            continue
        if name == "html":
            continue
        if name in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[name]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        elif stack[-1].tag in PARAGRAPHS or (len(stack) > 1 and stack[-1].tag in HEADINGS and name in HEADINGS):
            stack.pop()
        key = role = ""
        if m[3] and ("class" in m[3] or "id" in m[3] or "role" in m[3] or "CLASS" in m[3]):
            parts = []
            for a in _ATTRIBUTE.finditer(m[3]):
                value = (a[2] or a[3] or a[4] or "").lower()
                if a[1].lower() == "role":
                    role = value.strip()
                elif a[1].lower() != "hidden":
                    parts.append(value)
            key = " ".join(parts)
        node = Node(name, key, role)
        stack[-1].kids.append(node)
        if not m[3].endswith("/"):
            stack.append(node)
    if at < len(source):
        stack[-1].kids.append(source[at:])
    return root


def run(walk: Generator):
    """A recursive walk written as a generator, which yields the walks below it and gets their
    results: the calls stand on a list, not on the interpreter's stack."""
    stack, value = [walk], None
    while stack:
        try:
            below = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(below)
            value = None
    return value


def below(node: Node) -> Iterator[Node]:
    """All nodes under a node."""
    waiting = [node]
    while waiting:
        for kid in waiting.pop().kids:
            if isinstance(kid, Node):
                yield kid
                waiting.append(kid)


def _size(node: Node) -> int:
    return sum(len(k) for n in (node, *below(node)) for k in n.kids if isinstance(k, str))


def named_out(key: str) -> str:
    """"", "page" or "readers": what a container's class and id say."""
    found = ""
    for token in key.split():
        words = _WORD.findall(token)
        if words and not NAMES.isdisjoint(words) and all(w in NAMES or w in PLAIN for w in words):
            if not READERS.isdisjoint(words):
                return "readers"
            found = "page"
    return found


def left_out(node: Node, inside: bool, page_size: int) -> bool:
    """Whether an element is no part of an article; inside: it stands in one. page_size: characters of
    the whole page."""
    tag = node.tag
    if tag in OUTSIDE or (node.role in ROLES and node.role != "form"):
        return True
    if tag == "header":
        return not (inside and any(n.tag in HEADINGS for n in below(node)))
    if tag in ("html", "body", "main") or tag in HEADINGS or tag in PARAGRAPHS or (tag == "article" and not inside):
        return False
    form = tag == "form" or node.role == "form"
    name = "page" if form else named_out(node.key) if node.key else ""
    if not name:
        return False
    # A container of the page's own heading or main part is a frame around the article.
    if any(n.tag in ("h1", "main") or (n.tag == "article" and not named_out(n.key)) for n in below(node)):
        return False
    return name == "readers" or _size(node) * 2 <= page_size


def blocks(node: Node, out: list[list[str]], page_size: int, fixed: set[tuple[str, str]]) -> None:
    """Texts of the blocks below a node, in page order."""
    out.append([])
    stack = [iter(node.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
            out.append([])
        elif isinstance(kid, str):
            out[-1].append(kid)
        elif not left_out(kid, True, page_size) and not (fixed and (step(kid), _plain(kid)) in fixed):
            out.append([])
            stack.append(iter(kid.kids))


def _plain(node: Node) -> str:
    """All text of a container in page order, to compare it; nothing of other elements."""
    if node.tag not in CONTAINERS:
        return ""
    parts, stack = [], [iter(node.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
        elif isinstance(kid, str):
            parts.append(kid)
        else:
            parts.append(" ")
            stack.append(iter(kid.kids))
    return " ".join("".join(parts).split())


def clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def text_of(nodes: list[Node], page_size: int, fixed: set[tuple[str, str]] = frozenset()) -> str:
    out: list[list[str]] = []
    for node in nodes:
        blocks(node, out, page_size, fixed)
    return "\n\n".join(t for t in map(clean, out) if t)


def step(node: Node) -> str:
    return f"{node.tag}.{node.key}" if node.key else node.tag


# --- wrappers --------------------------------------------------------------------------


@dataclass(slots=True)
class Part:
    """A part of a wrapper: an element, or a text that is fixed or a slot."""

    name: str  # step of the element, "#" for a text
    kids: list[Part] = field(default_factory=list)
    literal: str | None = None
    optional: bool = False
    repeated: bool = False
    outside: bool = False
    size: int = 0  # characters of varying text below
    chars: int = 0  # characters of a text's instances on all pages


def generalise(node: Node) -> Part:
    """The page as a wrapper of its own."""
    return run(_generalise(node, False, _size(node)))


def _generalise(node: Node, inside: bool, page_size: int):
    part = Part(step(node), outside=left_out(node, inside, page_size))
    for kid in node.kids:
        if isinstance(kid, str):
            literal = " ".join(kid.split())
            if not literal:
                continue
            new = Part("#", literal=literal, chars=len(literal))
        else:
            new = yield _generalise(kid, inside or kid.tag == "article", page_size)
        if part.kids and part.kids[-1].name == new.name:
            part.kids[-1] = yield _merge(part.kids[-1], new)
            part.kids[-1].repeated |= new.name != "#"
        else:
            part.kids.append(new)
    return part


def merge(a: Part, b: Part) -> Part:
    """Both parts in one: the alignment of their children, mismatches optional."""
    return run(_merge(a, b))


def _merge(a: Part, b: Part):
    out = Part(a.name, literal=a.literal, optional=a.optional or b.optional, repeated=a.repeated or b.repeated, outside=a.outside or b.outside)
    if a.name == "#":
        out.chars = a.chars + b.chars
        if a.literal is None or b.literal is None or a.literal != b.literal:
            out.literal, out.size = None, out.chars
        return out
    x, y = a.kids, b.kids
    alike = len(x) == len(y) and all(m.name == n.name for m, n in zip(x, y))
    best = [] if alike else [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(-1 if alike else len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].name == y[j].name else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    merged: list[Part] = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].name == y[j].name:
            both = yield _merge(x[i], y[j])
            merged.append(both)
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            merged.append(x[i])
            merged[-1].optional = True
            i += 1
        else:
            merged.append(y[j])
            merged[-1].optional = True
            j += 1
    for kid in merged:
        if out.kids and out.kids[-1].name == kid.name:
            kid = yield _merge(out.kids.pop(), kid)
            kid.repeated |= kid.name != "#"
        out.kids.append(kid)
    return out


def weigh(part: Part) -> int:
    return run(_weigh(part))


def _weigh(part: Part):
    total = 0
    for kid in part.kids:
        total += yield _weigh(kid)
    if part.outside:
        part.size = 0
    elif part.name != "#":
        part.size = total
    return part.size


def expression(part: Part) -> str:
    """The wrapper as a regular expression over tags, #TEXT slots and fixed texts."""
    return run(_expression(part))


def _expression(part: Part):
    if part.name == "#":
        inner = "#TEXT" if part.literal is None else json.dumps(part.literal, ensure_ascii=False)
    else:
        parts = []
        for kid in part.kids:
            parts.append((yield _expression(kid)))
        inner = f"<{part.name}>{''.join(parts)}</>"
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[part.optional, part.repeated]
    return f"({inner}){mark}" if mark else inner


def place(wrapper: Part) -> list[str]:
    """Steps from the root to where the articles stand: an article or main element if the
    wrapper has one with varying text, else as deep as half of the varying text goes."""
    weigh(wrapper)
    named: list[tuple[int, list[str]]] = []
    waiting: list[tuple[Part, tuple]] = [(wrapper, ())]
    while waiting:
        part, path = waiting.pop()
        for kid in reversed(part.kids):
            if kid.name != "#" and not kid.outside:
                if kid.name.split(".")[0] in ("article", "main") and kid.size:
                    named.append((kid.size, _steps((path, kid.name))))
                waiting.append((kid, (path, kid.name)))
    articles = [x for x in named if x[1][-1].split(".")[0] == "article"]
    if articles or named:
        return max(articles or named, key=lambda x: (x[0], -len(x[1])))[1]
    path, part = [], wrapper
    while part.size:
        inner = [k for k in part.kids if k.name != "#" and not k.repeated and k.size * 2 > part.size]
        if not inner or inner[0].name.split(".")[0] in ("p", *HEADINGS):
            break
        part = inner[0]
        path.append(part.name)
    return path


def _steps(linked: tuple) -> list[str]:
    """A path kept as (path above, step), which shares what is above."""
    out = []
    while linked:
        linked, name = linked
        out.append(name)
    return out[::-1]


def fixed_containers(wrapper: Part, path: list[str]) -> list[list[str]]:
    """Containers below the place of the articles that have one text on all pages, as step and text."""
    here = [wrapper]
    for name in path:
        here = [k for p in here for k in p.kids if k.name == name]
    found, waiting = [], list(here)
    while waiting:
        for kid in waiting.pop().kids:
            if kid.name == "#" or kid.outside or kid.optional:
                continue
            if kid.name.split(".")[0] in CONTAINERS and not kid.repeated:
                text = run(_literal(kid))
                if text:
                    found.append([kid.name, " ".join(text.split())])
                    continue
            waiting.append(kid)
    return found


def _literal(part: Part):
    """The text of a part that is fixed and stands on every page, else None."""
    if part.name == "#":
        return part.literal
    parts = []
    for kid in part.kids:
        one = None if kid.optional or kid.repeated else (yield _literal(kid))
        if one is None:
            return None
        parts.append(one)
    return " ".join(parts)


def follow(node: Node, path: list[str]) -> list[Node]:
    """All instances of the place that a path leads to, in page order."""
    here = [node]
    for name in path:
        here = [k for n in here for k in n.kids if isinstance(k, Node) and step(k) == name]
    return here


def own_place(root: Node, page_size: int) -> list[Node]:
    """Where a page that follows no wrapper has its article: its articles, else its main elements."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [iter(root.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
        elif isinstance(kid, Node) and not left_out(kid, False, page_size):
            if kid.tag in found and not (kid.tag == "article" and named_out(kid.key)):
                found[kid.tag].append(kid)
            if kid.tag != "article":
                stack.append(iter(kid.kids))
    if found["article"]:
        return found["article"]
    if found["main"]:
        return found["main"][:1] if len(found["main"]) == 1 else [max(found["main"], key=_size)]
    return [next((k for k in root.kids if isinstance(k, Node) and k.tag == "body"), root)]


def main_text(source: str | None, path: list[str], fixed: set[tuple[str, str]] = frozenset()) -> str:
    if not source:
        return ""
    root = parse(source)
    size = _size(root)
    nodes = follow(root, path) if path else []
    return text_of(nodes, size, fixed) if nodes else text_of(own_place(root, size), size)


# --- jobs ------------------------------------------------------------------------------

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def rows_of(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def packed(part: Part) -> bytes:
    """A wrapper as bytes: its parts in page order, each with its depth."""
    rows, waiting = [], [(0, part)]
    while waiting:
        depth, one = waiting.pop()
        rows.append((depth, one.name, one.literal, one.optional | one.repeated << 1 | one.outside << 2, one.size, one.chars))
        waiting += [(depth + 1, kid) for kid in reversed(one.kids)]
    return zlib.compress(json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode(), 1)


def unpacked(data: bytes) -> Part:
    path: list[Part] = []
    for depth, name, literal, flags, size, chars in json.loads(zlib.decompress(data)):
        part = Part(name, [], literal, bool(flags & 1), bool(flags & 2), bool(flags & 4), size, chars)
        del path[depth:]
        if path:
            path[-1].kids.append(part)
        path.append(part)
    return path[0]


def _forms(rows: DataFrame) -> DataFrame:
    """host, n_pages, digest, form: the wrapper that a page is by itself."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for whole in batches:
            for low in range(0, len(whole), 256):
                batch = whole.slice(low, 256)
                at, digests, forms = [], [], []
                for k, (host, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                    if not (text := source.as_py()):
                        continue
                    digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
                    mine = hashlib.blake2b(digest + host.encode(), digest_size=16).digest()
                    if mine in met:
                        continue
                    if len(met) >= KNOWN_DIGESTS:
                        met.clear()
                    met.add(mine)
                    at.append(k)
                    digests.append(digest)
                    forms.append(packed(generalise(parse(text))))
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(digests, pa.binary()), pa.array(forms, pa.binary())], ["host", "n_pages", "digest", "form"])

    return text_pass(rows.select("host", "n_pages", "html"), work, "host string, n_pages long, digest binary, form binary")


def _aligned(group: pa.Table) -> tuple[Part, int]:
    """The wrapper of the forms of one bin, in the order of their digests, and how many different
    pages it stands for; of copies one tells as much as all."""
    forms = {d: (f, n) for d, f, n in zip(group["digest"].to_pylist(), group["form"].to_pylist(), group["different"].to_pylist())}
    wrapper = None
    for digest in sorted(forms):
        page = unpacked(forms[digest][0])
        wrapper = page if wrapper is None else merge(wrapper, page)
    return wrapper, sum(n for _, n in forms.values())


def wrappers(pages: DataFrame) -> DataFrame:
    """host, n_pages, path (JSON), fixed (JSON), wrapper: one row per host."""
    rows = rows_of(pages)
    counts = stored(rows.groupBy("host").agg(F.count("*").alias("n_pages")), "hosts")
    largest = counts.agg(F.max("n_pages")).first()[0] or 0  # one number comes to the driver
    # Only (host, count) meets the pages here; what is shuffled are forms, each once per task.
    bins = F.ceil(F.col("n_pages") / BIN_PAGES).cast("long")
    dealt = _forms(rows.join(counts, "host")).select("host", F.pmod(F.xxhash64("digest"), bins).alias("bin"), "digest", "form", F.lit(1).cast("long").alias("different"))

    def joined(group: pa.Table) -> pa.Table:
        wrapper, different = _aligned(group)
        return pa.table({"host": group["host"].slice(0, 1), "bin": group["bin"].slice(0, 1), "form": pa.array([packed(wrapper)], pa.binary()), "different": pa.array([different], pa.int64())})

    def learn(group: pa.Table) -> pa.Table:
        wrapper, different = _aligned(group)
        path, text = place(wrapper), expression(wrapper)
        fixed = fixed_containers(wrapper, path) if different >= FEWEST_PAGES else []
        return pa.table({"host": group["host"].slice(0, 1), "path": [json.dumps(path)], "fixed": [json.dumps(fixed)], "wrapper": [text]})

    width = -(-largest // BIN_PAGES)
    while width > 1:
        dealt = dealt.groupBy("host", "bin").applyInArrow(joined, "host string, bin long, form binary, different long")
        number = F.encode(F.lpad(F.col("bin").cast("string"), 20, "0"), "UTF-8")
        dealt = dealt.select("host", F.floor(F.col("bin") / FAN_IN).alias("bin"), number.alias("digest"), "form", "different")
        width = -(-width // FAN_IN)
    learnt = dealt.groupBy("host").applyInArrow(learn, "host string, path string, fixed string, wrapper string")
    none = lambda name, text: F.coalesce(name, F.lit(text)).alias(name)
    return counts.join(learnt, "host", "left").select("host", "n_pages", none("path", "[]"), none("fixed", "[]"), none("wrapper", ""))


def extract(pages: DataFrame, learnt: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = rows_of(pages).join(learnt.select("host", "path", "fixed"), "host", "left").select("page_id", "url", "html", "path", "fixed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {(None, None): ([], frozenset())}
        for whole in batches:
            for low in range(0, len(whole), 256):
                batch = whole.slice(low, 256)
                texts = []
                for source, *how in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    if (key := tuple(how)) not in known:
                        known[key] = json.loads(how[0]), frozenset(map(tuple, json.loads(how[1])))
                    texts.append(main_text(source.as_py(), *known[key]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return text_pass(rows, work, "page_id long, url string, text string, n_chars long")


@query("op10_html_extraction")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return extract(pages, stored(wrappers(pages), "wrappers"))
