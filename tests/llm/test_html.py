import random
import re

import pytest

from webtrail.llm import html

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">'
        '<nav><ul><li><a href="/">Home</a></li><li>x</li></ul></nav><div class="ad">buy {n}</div><article><h1>Title {n}</h1><p><b>First {n} &amp; &eacute;<br><p>'
        'Second\n  {n}</p><aside>note</aside><div class="comments"><p>me too</p></div></article><footer>&copy; f</footer>')
WANT = "Title {n}\n\nFirst {n} & é\n\nSecond {n}"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text_of_a_host(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n)) for n in range(30)]
    rows += [(100, "http://h.example/e", ""), (101, None, None), (102, "http://h.example/o", "<p>plain only"), (0, "http://h.example/0", PAGE.format(n=0))]
    frame = pages(spark, rows).selectExpr("*", "'x' AS path", "'y' AS host", "1 AS n_pages")
    learnt = html.wrappers(frame)
    seen = {r.host: r for r in learnt.collect()}
    assert "<article>" in seen["h.example"].wrapper and '["body.has-sidebar", "article"]' == seen["h.example"].path
    got = {}
    for r in html.extract(frame, learnt).collect():
        got.setdefault(r.page_id, r)
        assert r.n_chars == len(r.text)
    for n in range(30):
        assert got[n].text == WANT.format(n=n)
    assert got[100].text == "" and got[101].text == "" and got[102].text == "plain only"
    assert html.extract(frame, learnt).count() == len(rows)


def test_wrapper_without_article_elements():
    made = [html.generalise(html.parse(f'<body><div id="menu">m</div><div class="left">fixed</div><div class="text"><h2>h {n}</h2><p>{"word " * 9}{n}</p>'
                                       + "<p>more</p>" * n + "</div></body>")) for n in range(1, 5)]
    wrapper = made[0]
    for page in made[1:]:
        wrapper = html.merge(wrapper, page)
    assert html.place(wrapper) == ["body", "div.text"]
    expression = html.expression(wrapper)
    assert '"fixed"' in expression and "(<p>#TEXT</>)+" in expression


def test_mismatches_become_optional():
    a, b = (html.generalise(html.parse(s)) for s in ("<body><h1>x</h1><p>a</p></body>", "<body><h1>x</h1><table><tr><td>1</table><p>b</p></body>"))
    assert "(<table>" in html.expression(html.merge(a, b)) and ")?" in html.expression(html.merge(a, b))


def test_broken_markup_and_long_texts():
    assert html.main_text("<article><ul><li>a<li>b</ul>c</article", []) == "a\n\nb\n\nc"
    assert html.main_text("<div><article>" + "<p>x y" * 5000, []).count("x y") == 5000
    assert html.main_text("a < b &lt; c &nbsp; d", []) == "a < b < c d"
    assert html.main_text("<!-- <article>no</article> --><article>yes<!-- no --></article>", []) == "yes"


LONG = "A sentence of the article with some words in it. "


@pytest.mark.parametrize("source, want", [
    # Names that only look like those of a menu or of comments.
    (f'<body><div class="content with-sidebar"><h1>T</h1><p>{LONG}</p></div></body>', f"T|{LONG}"),
    (f'<body><div class="widget-area"><h1>T</h1><p>{LONG}</p></div><div class="widget">w</div></body>', f"T|{LONG}"),
    (f'<body><div class="widget-area"><p>{LONG * 5}</p></div><div class="widget">w</div></body>', LONG * 5),
    (f'<article><div class="post-header"><h1>T</h1></div><p>{LONG}</p></article>', f"T|{LONG}"),
    (f'<article><h2 id="related-work">R</h2><p id="notice-period">N</p><section class="comment-on-law"><p>{LONG}</p></section></article>', f"R|N|{LONG}"),
    # Names that are meant.
    (f'<article><h1>T</h1><p>{LONG}</p><div class="ad-box">buy</div><section id="comments"><article class="comment"><p>{LONG * 9}</p></article></section><ul class="share-links"><li>s</ul></article>', f"T|{LONG}"),
    # A form around everything, and one in the article.
    (f'<body><form id="aspnetForm"><div><h2>T</h2><p>{LONG * 3}</p><form><p>mail</p></form></div></form></body>', f"T|{LONG * 3}"),
    (f'<body><form id="f"><nav>n</nav><article><p>{LONG}</p><form>search</form></article></form></body>', LONG),
    (f"<body><main><article><p>One. {LONG}</p></article><article><p>Two.</p></article></main><aside><article>no</article></aside></body>", f"One. {LONG}|Two."),
    # Quotes that a browser takes as they are, or that never end.
    (f"<article><p data-x=it's>{LONG}</p><p title='a>b' class=\"x\">two</p></article>", f"{LONG}|two"),
    (f'<article><p class="x>{LONG}</p><p>two</p></article>', f"{LONG}|two"),
    ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end</p></article>", "deep|end"),
    ("<div>" * 1200 + f"<p>{LONG}</p>", LONG),
])
def test_what_belongs_to_an_article(source, want):
    want = [w.strip() for w in want.split("|")]
    assert html.main_text(source, []).split("\n\n") == want
    # The same by a wrapper of pages of this kind.
    made = [html.generalise(html.parse(source.replace("A sentence", f"Sentence {k} of").replace("One.", f"{k}."))) for k in range(3)]
    wrapper = made[0]
    for page in made[1:]:
        wrapper = html.merge(wrapper, page)
    assert html.main_text(source, html.place(wrapper)).split("\n\n") == want


def test_fixed_containers_and_all_instances():
    page = '<body><div class="text"><div>Read our terms before you go on.</div><p>{a}</p></div><div class="text"><p>{b}</p><div>{b} own</div></div></body>'
    sources = [page.format(a=f"first {k} " * 9, b=f"second {k} " * 9) for k in range(4)]
    wrapper = html.generalise(html.parse(sources[0]))
    for source in sources[1:]:
        wrapper = html.merge(wrapper, html.generalise(html.parse(source)))
    path = html.place(wrapper)
    assert path == ["body"] or path == ["body", "div.text"]
    fixed = {tuple(f) for f in html.fixed_containers(html.merge(html.generalise(html.parse(sources[0])), html.generalise(html.parse(sources[1]))), ["body"])}
    assert html.main_text(sources[2], ["body", "div.text"], {("div", "Read our terms before you go on.")}).split("\n\n")[0].startswith("first 2")
    assert not any("own" in text for _, text in fixed)


def plain_wrapper(streams):
    """Names that all, or only some, of the flat token streams have in this order: the longest common
    subsequences by trying all."""
    def common(x, y):
        if not x or not y:
            return 0
        return common(x[1:], y[1:]) + 1 if x[0] == y[0] else max(common(x[1:], y), common(x, y[1:]))
    return common(*streams)


def test_alignment_of_token_streams():
    """Of two flat pages a wrapper keeps as many elements in common as any alignment can, and every
    other one is optional; both pages fit it."""
    dice = random.Random(2)
    for _ in range(150):
        streams = [[dice.choice("abcd") for _ in range(dice.randint(0, 6))] for _ in range(2)]
        streams = [[t for k, t in enumerate(x) if not k or x[k - 1] != t] for x in streams]  # repeats are groups
        made = [html.Part("body", [html.Part(t) for t in x]) for x in streams]
        wrapper = html.merge(*made)
        if any(p.repeated for p in wrapper.kids):
            continue
        assert sum(not p.optional for p in wrapper.kids) == plain_wrapper(streams)
        pattern = re.compile("".join(p.name + ("?" if p.optional else "") for p in wrapper.kids))
        assert all(pattern.fullmatch("".join(x)) for x in streams)


def test_wrappers_know_every_page_of_a_host(spark, monkeypatch):
    """What differs on two pages of 300 is not fixed; bins, their levels and the cut of the table
    change nothing."""
    note = lambda n: "Read the terms of this site." if n not in (70, 210) else f"Note {n}."
    rows = [(n, f"http://n.example/{n}", f'<body><div class="text"><div>{note(n)}</div><p>Own words of {n} {"and more " * (n % 7)}</p><div>Same on all.</div></div></body>') for n in range(300)]
    rows += rows[:40] + [(900, "http://e.example/", None)]
    frame = pages(spark, rows)
    want = {n: "\n\n".join([note(n), f"Own words of {n} {'and more ' * (n % 7)}".strip()]) for n in range(300)}
    seen = set()
    for pages_of_bin, fan_in, parts in ((128, 16, 3), (7, 3, 5), (1000, 16, 1)):
        monkeypatch.setattr(html, "BIN_PAGES", pages_of_bin, raising=False)
        monkeypatch.setattr(html, "FAN_IN", fan_in, raising=False)
        learnt = html.wrappers(frame.repartition(parts))
        found = {r.host: (r.n_pages, r.path, r.fixed) for r in learnt.collect()}
        assert found["e.example"] == (1, "[]", "[]") and found["n.example"][0] == 340
        seen.add(found["n.example"])
    assert len(seen) == 1
    got = {r.page_id: r.text for r in html.extract(frame, learnt).collect()}
    assert {n: got[n] for n in want} == want


def test_wrappers_as_bytes():
    part = html.merge(*(html.generalise(html.parse(s)) for s in ("<div>" * 3000 + "a<p>b</p>", "<div>" * 3000 + "a<p>c</p><p>d</p>")))
    again = html.unpacked(html.packed(part))
    assert html.expression(again) == html.expression(part) and html.place(again) == html.place(part)


def test_empty_table(spark):
    empty = pages(spark, [])
    assert html.extract(empty, html.wrappers(empty)).collect() == []
