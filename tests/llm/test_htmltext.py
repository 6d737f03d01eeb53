from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.llm.htmltext import extract, render


def text(html, **kw):
    return render(html, **kw)[1]


def test_blocks_and_inline():
    assert text("<p>Hello <b>big</b>  \n world<p>Next<br>line<div>a</div><div>b</div>") == "Hello big world\n\nNext\nline\n\na\nb"
    assert text("a<span> b</span>c &lt;&amp;&eacute;") == "a bc <&é"
    assert text("<h1>T</h1>x<h2>U</h3>y") == "T\n\nx\n\nU\n\ny"


def test_implied_tags():
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "- a\n- b\n  - c\n- d"
    assert text("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>") == "a    bb\nccc  d"
    assert text("<dl><dt>t<dd>d<dt>u</dl>") == "t\n    d\nu"
    assert text("<title>T</title>body text") == "body text" and render("<title>A &amp; B</title>x")[0] == "A & B"
    assert text("a</p>b") == "a\n\nb"


def test_lists():
    assert text("<ol start=9><li>a<li>b<li value=3>c</ol>") == "9. a\n10. b\n3. c"
    assert text("<ol type=a><li>x<li>y</ol><ol type=I><li>z</ol>") == "a. x\nb. y\n\nI. z"
    assert text("<ol reversed><li>x<li>y</ol>") == "2. x\n1. y"
    assert text("<ul><li><p>one</p><p>two</p></ul>") == "- one\n\n  two"


def test_tables():
    assert text("<table><caption>C</caption><tr><th>Name<th>N</tr><tr><td>x<td>10<tr><td colspan=2>wide one here</table>") == "C\nName  N\nx     10\nwide one here"
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert text("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>") == "日本   x\nabcde  y"
    assert text("<table><tr><td>in<table><tr><td>p<td>q</table><td>out</table>") == "in    out\np  q"
    assert text("<table><tr>stray<td>cell<td>x</table>") == "stray\n\ncell  x"
    assert text("<table><tr><td>only</td></tr><tr><td>column</td></tr></table>") == "only\ncolumn"


def test_visibility():
    assert text("a<script>b</script><style>c</style><template>d</template><p hidden>e<p style='display: none'>f<p>g") == "a\n\ng"
    assert text("<style>.x{display:none} #y, p.z {visibility:hidden}</style><p class='q x'>1<p id=y>2<p class=z>3<div class=z>4</div>") == "4"
    assert text("<style>@media print {p{display:none}} p{color:red}</style><p>1") == "1"
    assert text("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>") == "b"
    assert text("<details><summary>s</summary>t</details><details open><summary>u</summary>v</details>") == "s\nu\nv"
    assert text("<dialog>a</dialog><dialog open>b</dialog><input type=hidden value=c><input type=submit value=d>") == "b\nd"
    assert text("x<noscript>n</noscript>m") == "xnm" and text("<noscript>n</noscript>m", scripting=True) == "m"
    assert text("<select><option>a<option selected>b</select>") == "b"


def test_pre_and_broken_markup():
    assert text("<pre>\n a\n\tb  c</pre>x") == " a\n        b  c\n\nx"
    assert text("a < b <3 <!-- x > y --> c <! d> e <") == "a < b <3 c e <"
    assert text('<a title="x > y" href=\'z\'>t</a> <p class=">u">v') == "t\n\nv"
    assert text("x<div") == "x"
    assert text("<span><p>a</span>b</p>c") == "ab\n\nc"
    assert text("<b><p>a</b>b</p>c") == "ab\n\nc"
    assert text("<textarea>\n<b>t</b></textarea>") == "<b>t</b>"


def test_depth_is_bounded():
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000 + "after") in ("deep\nafter", "deepafter")
    assert "x" in text("<table><tr><td>" * 500 + "x")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<div>", "</div>", "<h1>", "</h2>", "<select>", "<option>", "<br>", "w1", " w2 ", "<a>", "</a>", "<dl><dt>", "<body>", "<head>", "</html>", "<!--", "-->", "<pre>", "\n", "&amp;"]), max_size=40).map("".join))
def test_any_markup_renders(html):
    out = text(html)
    assert all(line == line.rstrip(" ") for line in out.split("\n"))
    if "<!--" not in html and "<select>" not in html and "<option>" not in html:
        assert out.count("w1") == html.count("w1")


def test_query_edge_cases(spark):
    rows = [(1, "u", "<p>a", "t"), (2, None, None, "t"), (3, "u", "", "t"), (3, "u", "", "t"), (4, "u", "<p>" + "x " * 200_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(1, 1), (2, 0), (3, 0), (3, 0), (4, 399_999)]
    assert extract(df.limit(0)).count() == 0


# A plain renderer of a subset, to compare with: words, spans, breaks, hidden elements, divisions and paragraphs.

words = st.sampled_from(["ab", "c ", " d", "&amp;", " e  f ", "\n"])
inline = st.recursive(words, lambda x: st.tuples(st.sampled_from(["b", "span", "br", "hidden", "unseen"]), st.lists(x, max_size=3)), max_leaves=6)
block = st.recursive(inline, lambda x: st.one_of(st.tuples(st.just("div"), st.lists(x, max_size=4)), st.tuples(st.just("p"), st.lists(inline, max_size=4))), max_leaves=12)


def written(node):
    if isinstance(node, str):
        return node
    tag, children = node
    body = "".join(map(written, children))
    if tag == "br":
        return "<br>"
    name, attr = {"hidden": ("span", " style='display:none'"), "unseen": ("i", " class=gone")}.get(tag, (tag, ""))
    return f"<{name}{attr}>{body}</{name}>"


def plain(nodes):
    parts = []  # texts, and numbers of line ends

    def walk(node):
        if isinstance(node, str):
            parts.append(node.replace("&amp;", "&"))
        elif node[0] == "br":
            parts.append("\0")
        elif node[0] not in ("hidden", "unseen"):
            edge = {"div": 1, "p": 2}.get(node[0], 0)
            parts.append(edge)
            for x in node[1]:
                walk(x)
            parts.append(edge)

    for n in nodes:
        walk(n)
    out, gap, run = "", 0, ""

    def flush():
        nonlocal out, gap, run
        text = "\n".join(" ".join(line.split()) for line in run.split("\0"))
        text = text[:-1] if text.endswith("\n") else text  # a break at the end of a block ends its line and no more
        if text.strip() or "\0" in run:
            out += ("\n" * gap if out else "") + text
            gap = 0
        run = ""

    for p in [*parts, 1]:
        if isinstance(p, str):
            run += p
        elif p:
            flush()
            gap = max(gap, p)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(block, max_size=5))
def test_matches_a_plain_renderer(nodes):
    html = "<style>.gone{display:none}</style><body>" + "".join(map(written, nodes))
    if "<br>" in html:  # blank lines at block edges are laid out in their own way
        assert text(html).split() == plain(nodes).split()
    else:
        assert text(html) == plain(nodes)


def test_cascade_of_style_sheets():
    assert text("<style>#a{display:block} .x{display:none}</style><p id=a class=x>1<p class=x>2") == "1"
    assert text("<style>.x{display:none !important} #a{display:block}</style><p id=a class=x>1<p>2") == "2"
    assert text("<style>.x{display:none!important}</style><p class=x style='display:block'>1<p style='display:none'>2<p>3") == "3"
    assert text("<style>.x{display:none} p.x{display:block}</style><p class=x>1<i class=x>2</i>") == "1"
    assert text("<style>@import 'a'; .x{display:none} @media print{.y{display:none}} /* .z{display:none} */</style><p class=x>1<p class=y>2<p class=z>3") == "2\n\n3"
    assert text("<style>.x{display:none</style><p class=x>1") == "1"


def test_combinators_and_media():
    assert text("<style>.a .b{display:none}</style><div class=a><p class=b>1<p>2</div><p class=b>3") == "2\n\n3"
    assert text("<style>div>p{display:none}</style><div><p>1</p><section><p>2</p></section></div><p>3") == "2\n\n3"
    assert text("<style>.a > .b .c{visibility:hidden}</style><div class=a><div class=b><i><u class=c>1</u></i></div><i><div class=b><u class=c>2</u></div></i></div>") == "2"
    # the nearest .b isn't a child of .a, but one further up is
    assert text("<style>.a>.b .c{display:none}</style><div class=a><div class=b><div class=b><u class=c>1</u>2</div></div></div>") == "2"
    assert text("<style>@media screen{.x{display:none}} @media only screen, print {.y{display:none}} @media screen and (min-width:9px){.z{display:none}} @media print{.w{display:none}}</style><p class=x>1<p class=y>2<p class=z>3<p class=w>4") == "3\n\n4"
    assert text("<style>@media all{@media print{p{display:none}} .x{display:none}} .y{display:none}</style><p>1<p class=x>2<p class=y>3") == "1"
    assert text("<style>#a .x{display:block} .a .x.x{display:none}</style><div id=a class=a><p class=x>1</div><div class=a><p class=x>2</div>") == "1"
    assert text("<style>a:hover{display:none} p~p{display:none} [x]{display:none} .q{display:none}</style><p>1<p>2<p x>3<p class=q>4") == "1\n\n2\n\n3"


def test_spans_take_no_more_room_than_their_cells():
    assert text("<table><tr><td colspan=100>Title<td>b<tr><td>x<td colspan=99>y<td>z</table>") == "Title  b\nx  y   z"
    for rows, row in ((60, "<tr><td colspan=1000 rowspan=65534>a<td>b"), (500, "<tr><td rowspan=65534>a<td>b"), (2000, "<tr><td rowspan=65534>a")):
        out = text("<table>" + row * rows)
        assert len(out) <= 8 * rows * len(row) + (1 << 16) and out.count("a") == rows
    wide = "<table><tr><td>" + "w" * 20_000 + "<td>end" + "<tr><td>a<td>b" * 5_000
    assert len(text(wide)) < 8 * len(wide) + (1 << 16) and text(wide).count("b") == 5_000
    nested = "x"
    for _ in range(60):
        nested = "<table>" + "<tr><td>a<td>b" * 20 + "<tr><td>" + nested + "<td>c</table>"
    assert len(text(nested)) < 8 * len(nested) + (1 << 16)


def test_hostile_pages_take_linear_time():
    import time

    for html in ("<a" * 2_500_000, "</a" * 1_600_000, "<a\"" * 1_600_000, "<table>" + "<tr><td colspan=1000 rowspan=65534>a<td>b" * 100_000, "<table>" + "<tr><td rowspan=9999>" * 200_000, "<style>.a .b{display:none}</style>" + "<div class=a>" * 150 + "<p class=b>x" * 300_000, "<style>none " + "a b, " * 1_000_000, "<style>none " + "a{b:c " * 800_000, "<p>x<style>none" + "</style " * 600_000, "<a " * 1_600_000, "<" * 5_000_000, "<!--" * 1_200_000, "<style>none @m{" + "a{b}" * 1_000_000, "&" * 5_000_000):
        start = time.process_time()
        render(html)
        assert time.process_time() - start < 15, html[:60]
    rules = "<style>" + "".join(f".c{i}{{display:none}}" for i in range(20_000)) + "</style>" + "<p class=c5>x" * 20_000
    start = time.process_time()
    assert render(rules)[1] == "" and time.process_time() - start < 5


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<title>T</title><p>a", "x", "y", "z")], "page_id long, url string, html string, text string, title string, n_chars string")
    assert [tuple(r) for r in extract(df).collect()] == [(1, "u", "T", "a", 1)]
