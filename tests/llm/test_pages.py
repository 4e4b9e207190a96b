import re
from html import escape

from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm.pages import extract, page_text


def test_blocks_and_inline_text():
    assert page_text("<p>one<p>two <i>three</i><br>four<div>five</div>six") == "one\n\ntwo three\nfour\n\nfive\nsix"
    assert page_text("a <b> b</b>  c\n\nd") == "a b c d"
    assert page_text("<h1>T</h1><section>x</section><section>y</section>") == "T\n\nx\ny"
    assert page_text("<pre>a\n  b</pre>") == "a\n  b"


def test_lists():
    page = "<ul><li>a<li>b<ol start=3><li>x<p>y</p><li>z</ol></ul>end"
    assert page_text(page) == "- a\n- b\n  3. x\n\n     y\n  4. z\n\nend"


def test_tables():
    page = "<table><caption>C</caption><tr><th>Name<th>Long column<tr><td>a<td>b<td>c<tr><td colspan=2>wide<td>d<tr><td rowspan=2>r<td>1<td>2<tr><td>3<td>4</table>"
    assert page_text(page).split("\n") == [
        "C",
        "Name | Long column",
        "a    | b           | c",
        "wide               | d",
        "r    | 1           | 2",
        "     | 3           | 4",
    ]
    assert page_text("<table><td>lone<p>cell</table>") == "lone\n\ncell"


def test_lines_of_cells_stay_apart():
    assert page_text("<table><tr><td><pre>a\nbcd</pre><td>z<tr><td>e<td><ul><li>f<li>g<ol><li>h</ol></ul>i") == "a   | z\nbcd |\ne   | - f\n    | - g\n    |   1. h\n    |\n    | i"
    assert page_text("<table><tr><td><p>a<p>b<td>c<br>d") == "a | c\n  | d\nb |"
    assert page_text("<table><tr><td><table><tr><td>a<td>b<tr><td>c<td>d</table><td>x") == "a | b | x\nc | d |"


def test_columns_of_any_width():
    long = " ".join(["word"] * 100)
    assert page_text(f"<table><tr><td>{long}<td>x<tr><td>a<td>y<tr><td>{'b' * 600}<td>z").split("\n") == [f"{long:600} | x", f"{'a':600} | y", f"{'b' * 600} | z"]
    assert page_text(f"<table><tr><td colspan=2>{long}<td>x<tr><td>a<td>b<td>c").split("\n") == [f"{long} | x", f"a | {'b':{len(long) - 4}} | c"]
    wide = page_text("<table><tr><td colspan=300>s<td>end<tr>" + "".join(f"<td>{i}" for i in range(300)) + "<td>last").split("\n")
    assert wide[0].index("end") == wide[1].index("last") and wide[0].startswith("s ") and len(wide) == 2
    assert page_text("<table><tr><td colspan=99999999>s<td>e") == "s | e" and page_text("<table><tr><td rowspan=70000>s<td>e<tr><td>f") == "s | e\n  | f"


def test_blanks_are_bounded_and_no_text_is_lost():
    rows = "".join(f"<tr><td>r{i}<td>{i}" for i in range(20_000))
    long = "word " * 20_000
    laid = page_text(f"<table><tr><td>{long}<td>x{rows}</table>")
    assert len(laid) < 40 * (len(long) + len(rows)) and laid.split("\n")[0] == f"{long.strip()} | x"
    assert re.findall(r"\w+", laid) == re.findall(r"\w+", long) + ["x"] + [w for i in range(20_000) for w in (f"r{i}", str(i))]


    stairs = page_text("<table>" + "".join(f"<tr><td rowspan=60000>a{i}<td>b{i}" for i in range(3000)))
    assert stairs.split("\n") == [f"a{i} | b{i}" for i in range(3000)]


def test_buttons_show_their_value():
    assert page_text('a<input type="SUBMIT" value="Go"><input type=button value=Stop hidden><input value=no><input type=reset>b') == "a Go b"


def test_rows_outside_a_table():
    rows = "<tbody>\n<tr><td>a<td>bb</tr>\n<tr><td>ccc<td>d</tr>\n</tbody>"
    laid = "a   | bb\nccc | d"
    assert page_text(f"<div>{rows}</div>after") == f"{laid}\nafter"
    assert page_text(rows) == page_text(f"<table>{rows}</table>") == laid
    for tag in ("form", "center", "div", "b"):
        assert page_text(f"<table><{tag}>{rows}</table>") == laid
    assert page_text("<p>x<thead><tr><td>y") == "x\ny"


def test_drawings_and_formulas():
    svg = "<svg><title>no</title><desc>no</desc><metadata>no</metadata><style>no</style><defs><text>no</text></defs>no<path/><g><text>a<tspan>b</tspan></text><text>c</text></g>"
    assert page_text(f"x{svg}<foreignObject><div>d</div></foreignObject></svg>y") == "x ab c\nd\ny"
    assert page_text(f"{svg}<p>unclosed") == "ab c\n\nunclosed"
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>no</annotation></semantics></math>"
    assert page_text(f"<p>so {math} holds") == "so x = 1 2 holds"
    assert page_text("<text>t</text><desc>u</desc>") == "tu"
    assert page_text(f"<div hidden>{svg}</svg>{math}</div>z") == "z"
    assert page_text("<div>" * 600 + svg + "</svg>") == "ab c"


def test_what_is_not_displayed():
    page = """<head><title>T</title><style>p{}</style></head><body>a<script>var t="</p>"</script><div hidden>no</div><span style="display : none">no</span>
    <div style="visibility:hidden">no<b style="visibility:visible">yes</b></div><template>no</template><noscript>no</noscript><!-- no -->
    <details><summary>s</summary>no</details><details open><summary>t</summary>u</details><dialog>no</dialog>"""
    assert re.findall(r"\w+", page_text(page)) == ["a", "yes", "s", "t", "u"]


def test_broken_and_deep_pages():
    assert page_text("</p></table>x<td>y</b><p") == "x\ny" or "x" in page_text("</p></table>x<td>y</b><p")
    assert page_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert page_text("<table><tr><td>" * 300 + "in" + "</table>" * 300) == "in"
    assert page_text("<b>" * 600 + "a<p>b") == "a\nb"
    assert page_text("&lt;p&gt; &amp;amp; &copy;") == "<p> &amp; ©"
    assert page_text(None) == page_text("") == ""


words = st.lists(st.text("abcdéß&<", min_size=1, max_size=5), min_size=1, max_size=4).map(" ".join)
SEPARATE = ("p", "div", "li", "td", "h2", "section", "blockquote", "dd")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SEPARATE), words, st.booleans()), max_size=12))
def test_every_visible_word_once_and_in_order(elements):
    page = "".join(f"<{tag}{' hidden' if hide else ''}>{escape(text)}</{tag}>" for tag, text, hide in elements)
    want = [w for _, text, hide in elements if not hide for w in text.split()]
    assert [w for w in re.split(r"[\s|]+|^- ", page_text(page)) if w and w != "-"] == want


def test_table_of_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "v", "<p>" + "x " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_lines")
    got = extract(pages).collect()
    assert sorted((repr(r.page_id), r.text[:3], r.n_lines) for r in got) == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("None", "x x", 1)]
    assert extract(pages.where("false")).count() == 0
