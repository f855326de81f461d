"""Rendering of small pages."""

import pytest

from matchlens.llm.html import visible_text

CASES = {
    "implied tags": (
        "<p>one<p>two<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>",
        "one\n\ntwo\n\n- a\n- b\n\n  3. x\n  4. y",
    ),
    "inline and breaks": ("a <b>big</b>\n  word<br>next<i>!</i>", "a big word\nnext!"),
    "hidden": (
        "<p style='Display : NONE'>x<b>y</b></p><div hidden>z</div><dialog>d</dialog>"
        "<input value=v><select><option>o</select><p>seen<span style='visibility:hidden'>no</span>",
        "seen",
    ),
    "raw elements": (
        "<title>t</title><script>if (a<b) '</p>'</script><style>p{}</style>ok<!-- <p>no -->!",
        "ok!",
    ),
    "table": (
        "<table><caption>Cap</caption><tr><th>Name<th>Qty<th>Of<tr><td>apple pie<td>3<td>a<br>b"
        "<tr><td colspan=2>wide<td>z</table>after",
        "Cap\nName       Qty  Of\napple pie  3    a\n                b\nwide            z\n\nafter",
    ),
    "wide characters": ("<table><tr><td>中<td>x<tr><td>ab<td>y</table>", "中  x\nab  y"),
    "entities": ("a&nbsp;&lt;b&gt; &amp; &eacute;", "a <b> & é"),
    "preformatted": ("<pre>\n a\n   b</pre>c", " a\n   b\n\nc"),
    "image": ("<img alt='a cat' src=x>!", "a cat!"),
    "stray tags": ("</p></div>x</table><td>y", "xy"),
    "unclosed": ("<div><p>a<b>c", "ac"),
    "rows spanned": (
        "<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td>s<td>3</table>", "r  1\n   2\ns  3",
    ),
    "rows spanned to the end of a group": (
        "<table><tbody><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g<td>h</table>",
        "a  b  c\nd     e\nf  g  h",
    ),
    "wide and tall": (
        "<table><tr><td colspan=2 rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f<td>g<tr><td colspan=2000>h<td>i</table>",
        "ab     c\n       d\ne   f  g\nh         i",
    ),
    "drawing and formula": (
        "<svg><title>no</title><desc>no</desc><text>one</text><text>two</text></svg> <math><mi>x</mi>"
        "<mo>=</mo><mn>1</mn><annotation>no</annotation></math><object>instead</object>",
        "one two x=1instead",
    ),
    "list box": ("pick<select multiple><option>a<option>b</select>now", "pick\na\nb\nnow"),
    "shown again": (
        "<div style='visibility: hidden'>no<p style='visibility:visible'>yes<b>too</b><i style="
        "'visibility:hidden'>no</i></p><img alt=no></div><div hidden><p style='visibility:visible'>no</div>",
        "yestoo",
    ),
    "hidden cell": (
        "<table><tr><td style='visibility:hidden'>abc<td>x<tr><td>d<td>y</table>", "   x\nd  y",
    ),
    "no tag": ("1 < 2 <3 <", "1 < 2 <3 <"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, wanted = CASES[name]
    assert [line.rstrip() for line in visible_text(page).split("\n")] == wanted.split("\n")


def test_cells_of_deep_tables_stay_apart():
    for depth in (1, 5, 19, 20, 21, 30, 40, 200):
        page = "<table><tr><td>" * depth + "a<td>b<td>c" + "</table>" * depth
        assert visible_text(page).split() == ["a", "b", "c"], depth


def test_wide_and_long_tables():
    row = "<tr>" + "<td colspan=1000>x" * 500
    assert visible_text(f"<table>{row * 20}</table>").split() == ["x"] * 10_000
    tall = "<table><tr><td rowspan=65534>a<td>b" + "<tr><td>c" * 5000 + "</table>"
    lines = visible_text(tall).split("\n")
    assert lines[0] == "a  b" and lines[1:] == ["   c"] * 5000


def test_deep_pages():
    for start in ("<div>", "<ul><li>", "<table><tr><td>", "<b>", "<blockquote>"):
        assert visible_text(start * 20_000 + "deep").endswith("deep")
    assert visible_text("<div hidden>" + "<p>" * 300 + "no" + "</div>yes").endswith("yes")
