"""Wrapper inference and extraction."""

from stratagraph.llm import wrappers as W


def text(html):
    return W.main_text(W.Page(html), {})


def test_blocks_and_boilerplate():
    assert text('<article><header>by me</header><h1>T</h1><div class="ad">x</div><p>a &lt; b < c <a href="x>y">link</a></p><ul><li>1<li>2</ul><section class="comments"><p>no</section><script>if(a<b){}</script><p>end</article><aside>z</aside>') == "T\na < b < c link\n1\n2\nend"
    assert text("<nav>m</nav><main><p> a \n\t b </p><p></p><p>c<br>d</main><footer>f") == "a b\nc\nd"
    assert text("<body><div id='cookie-notice'>ok?</div><p>one<p>two<form>q</form></body>") == "one\ntwo"
    assert text("") == "" and text("plain &amp; simple") == "plain & simple" and text("<article><p>cut off &am") == "cut off &am"
    assert text('<article><p class="adventure shadow">kept</p></article>') == "kept"
    assert text('<body class="page has-sidebar no-ads"><div class="with-sidebar"><p>kept</p></div><div class="page-header">gone</div></body>') == "kept"
    assert text("<p title='a>b>c</p><p>d</p>").endswith("d")  # a quote that isn't closed


def wrapper(*pages):
    out = W.Wrapper()
    for p in pages:
        out.add(W.Page(p))
    return out


def test_inference_finds_repeats_options_and_slots():
    w = wrapper("<ul><li>a<li>b</ul><p>x</p>", "<ul><li>a</ul><p>y</p>", "<ul><li>c<li>d<li>e</ul><h2>t</h2><p>z</p>")
    assert W.expression(w.items) == "<ul>(<li>#>ul>li</li>)+</ul>(<h2>#>h2</h2>)?<p>#>p</p>"
    assert w.slots[">p"][3] is None and w.pages == 3


def test_merging_partial_wrappers_is_as_one():
    pages = ["<p>1</p>", "<p>1</p><p>2</p>", "<h1>t</h1><p>3</p>"]
    a, b = wrapper(*pages[:2]), wrapper(pages[2])
    a.merge(W.Wrapper.load(b.dump()))
    one = wrapper(*pages)
    assert a.slots == one.slots and W.expression(a.items) == W.expression(one.items)


def test_constant_and_linked_slots_are_not_main():
    w = wrapper(*(f"<div><h4>All rights</h4><p>text {i}</p><dl><dt><a href=x>go {i}</a></dl></div>" for i in range(4)))
    rules = w.rules()
    bare = {path: r[2] for path, r in rules.items()}
    assert bare[">div>p"] and not bare[">div>h4"] and not bare[">div>dl>dt"]
    assert W.main_text(W.Page("<div><h4>All rights</h4><p>new</p></div>"), rules) == "new"


def test_names_of_containers():
    assert text("<article><p>s</p><article><p>reader</p></article></article>") == "s"
    assert text('<article><p>s</p></article><article class="comment"><p>c</p></article><article class="related promo"><p>r</p></article>') == "s"
    assert text('<article><section id="search-results"><p>a</p></section><div class="table-header">b</div><div class="comment-list">c</div><div class="site-footer">d</div><p class="no-comments">e</p></article>') == "a\nb\ne"


def lcs(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_alignments_are_longest_common_subsequences(monkeypatch):
    import random

    draw = random.Random(3)
    for held in (1 << 30, 1, 20):
        monkeypatch.setattr(W, "HELD_BITS", held)
        for _ in range(150):
            x, y = (draw.choices("abcd", k=draw.randint(0, 12)) for _ in range(2))
            pairs = W.common(x, y)
            assert len(pairs) == lcs(x, y) and all(x[i] == y[j] for i, j in pairs)
            assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_repeats_of_any_length():
    group = [f"<{c}>" for c in "abcdefghijklmnopqrstuvwxyz"]
    assert W.collapse(["x", *group * 3, "y"]) == ["x", ("+", tuple(group)), "y"]
    assert W.absorb([("?", tuple(group)), *group]) == [("+", tuple(group))]


def test_the_text_comes_through_the_expression(spark):
    """Notices and menus inside articles are told by comparison; with another expression the same page has another text."""
    page = lambda i, notice: f"<article><h1>Same title</h1><p>body {i}, long enough to be most of it</p><div>{notice}</div><ul><li><a href=x>go {i}</a></ul></article>"
    rows = [(i, f"http://a.org/{i}", page(i, "All rights reserved")) for i in range(5)] + [(10 + i, f"http://b.org/{i}", page(i, f"remark {i}")) for i in range(2)] + [(20 + i, f"http://c.org/{i}", page(7, "copied")) for i in range(4)]
    by = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by[3] == "Same title\nbody 3, long enough to be most of it"
    assert by[11] == "Same title\nbody 1, long enough to be most of it\nremark 1\ngo 1"  # too few pages to tell
    assert by[21] == "Same title\nbody 7, long enough to be most of it\ncopied"  # copies say nothing
    pages = [W.Page(html) for i, _, html in rows[:5]]
    w = wrapper(*(html for _, _, html in rows[:5]))
    forms = [W.Form(w.dump()), W.Form(wrapper(rows[3][2]).dump())]
    for f in forms:
        for p in pages:
            f.add(p)
    forms[0].wrapper.pages = 5
    assert forms[0].text(pages[3]) == by[3] and forms[1].text(pages[3]) != by[3]


def test_extract(spark):
    rows = [(i, f"http://h.org/{i}", f"<div><h4>Same</h4><p>body {i}</p></div>", "z") for i in range(5)] + [(9, None, None, "z"), (9, None, None, "z"), (10, "http://k.org", "<article><p>k", "z")]
    got = W.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[3] == "body 3" and by[9] == "" and by[10] == "k"
    assert W.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_page():
    n = 20_000
    page = W.Page("<article>" + "<p>word</p>" * n)
    assert W.main_text(page, {}).count("\n") == n - 1


def test_an_expression_spells_each_of_its_pages():
    import random

    draw = random.Random(5)
    part = lambda: draw.choice(["<p>a</p>", "<h2>b</h2>", "<ul>" + "<li>c" * draw.randint(1, 4) + "</ul>", "<div><p>d</p></div>", "<table><tr><td>e<td>f</table>"])
    for most in (4, 12):
        pages = ["<div>" + "".join(part() for _ in range(draw.randint(0, most))) + "</div><p>end</p>" for _ in range(40)]
        w = wrapper(*pages[:25])
        w.merge(W.Wrapper.load(wrapper(*pages[25:]).dump()))
        for p in map(W.Page, pages):
            assert len(w.matcher().slots(p.tokens)) == len(p.blocks)


def test_long_expressions_stay_whole():
    page = "".join(f"<{a}><{b}><{c}>t</{c}></{b}></{a}>" for a in ("div", "section", "table", "dl") for b in ("h1", "h2", "h3", "h4", "h5", "h6") for c in ("p", "pre", "ul", "ol", "address", "center", "hgroup", "dd", "dt", "li"))
    w = wrapper(page, page + "<h2>more</h2>")
    assert len(w.items) > 600 and all(w.matcher().slots(W.Page(p).tokens) for p in (page, page + "<h2>more</h2>"))


def test_places_with_like_containers_are_apart(spark):
    """The paragraph after the table is another slot than the body, which has the same path."""
    page = lambda i, note: f"<div><h1>t{i}</h1><p>body {i}</p><table><tr><td>cell {i}</table><p>{note}</p></div>"
    rows = [(i, f"http://a.org/{i}", page(i, "All rights")) for i in range(4)] + [(10 + i, f"http://b.org/{i}", page(i, f"<a href=x>many words about where to go next {i}</a>")) for i in range(4)]
    by = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by[2] == "t2\nbody 2\ncell 2" and by[12] == "t2\nbody 2\ncell 2"


def test_constants_of_any_length():
    for n in (200, 201, 5000):
        rules = wrapper(*(f"<div><pre>{'c' * n}</pre><p>text {i} {'t' * n}</p></div>" for i in range(4))).rules()
        assert not rules[">div>pre"][2] and rules[">div>p"][2]
    w = wrapper(*(f"<div><h4>{'c' * 300}{i}</h4></div>" for i in range(4)))
    assert w.rules()[">div>h4"][2] and len(w.dump()) < 400
