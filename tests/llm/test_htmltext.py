"""Layout-aware text: layout cases, the table against plain tag stripping, odd rows."""

import html
import os
import re

import pytest

from touchline.llm import htmltext

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

CASES = [
    ("<p>One\n two<p>Three <b>bold</b>er", "One two\n\nThree bolder"),
    ("<h1>T</h1>text<div>a</div><div>b</div>", "T\n\ntext\na\nb"),
    ("<ul><li>a<li>b<ol start=3><li>c</li><li>d<br>e</ol><li>f</ul>", "- a\n- b\n  3. c\n  4. d\n     e\n- f"),
    ("<table><tr><th>Name<th>Qty<tr><td>Pear<td>3<tr><td>Fig<td>12</table>", "Name  Qty\nPear  3\nFig   12"),
    ("<table><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide     x\na     b  c"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td><p>a<p>b</td><td>c</td></tr></table>after", "a  c\n\nb\n\nafter"),
    ("<head><title>no</title><style>p{}</style></head><body><script>var t='</p>';</script>yes", "yes"),
    ("a<span hidden>b</span><span style='display: none'>c</span><template>d</template>e", "ae"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>", "b"),
    ("<pre>  x\n    y</pre>z", "  x\n    y\n\nz"),
    ("<details><summary>s</summary>hidden<p>too</details><details open><summary>t</summary>seen</details>", "s\nt\nseen"),
    ("a<!-- no --> &amp; b &lt;i&gt; &nbsp;c&#233;", "a & b <i>  cé"),
    ("<dl><dt>t<dd>one<dd>two<dt>u</dl>", "t\n  one\n  two\nu"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<p>a</b></div>b</p></i>c", "ab\n\nc"),
    ("<select><option>x<option>y</select><input type=submit value=Go><input type=hidden value=no>", "x\ny\nGo"),
    ("a<br><br>b<hr>c", "a\n\nb\n\nc"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\n\nin"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    assert htmltext.page_text(page) == text


def plain_words(page):
    """Visible words of the generated pages: head, scripts and comments out, blocks apart."""
    body = re.sub(r"(?is)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->", " ", page)
    body = re.sub(r"(?i)</?(?:b|a|i|span)(?: [^>]*)?>", "", body)
    return html.unescape(re.sub(r"<[^>]*>", " ", body)).split()


def test_table_keeps_all_visible_words(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = htmltext.op4_layout_text(spark, SF).collect()
    assert {r.page_id for r in out} == set(pages) and len(out) == len(pages)
    for r in out:
        words = re.sub(r"(?m)^- ", "", r.text).split()
        assert words == plain_words(pages[r.page_id] or "")
        assert "\n\n\n" not in r.text and r.text == r.text.strip("\n")


def test_odd_rows(spark):
    deep = "<div><b>" * 30_000 + "deep" + "</b>" * 10
    rows = [(1, None, "x"), (2, "", "y"), (3, deep, None), (None, "<p>a", "z"), (5, "no tags < here > & there", "z"), (5, "no tags < here > & there", "z"), (6, "<table><tr><td colspan=99999999>a<td rowspan=0>b", "")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = {(r.page_id, r.text) for r in htmltext.extract_text(pages).collect()}
    assert out == {(1, ""), (2, ""), (3, "deep"), (None, "a"), (5, "no tags < here > & there"), (6, "a  b")}
    assert htmltext.extract_text(pages.where("page_id < 0")).count() == 0


def test_text_of_an_image_map_is_seen():
    assert htmltext.page_text("a<map name=m><area href=x><a href=y>link</a> b</map>c") == "alink bc"
