from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwarden.llm.html import extract, to_text
from driftwarden.llm.queries import op1_html

CASES = {
    "<p>One<p>Two <b>bold</b> text": "One\n\nTwo bold text",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>": "- a\n- b\n  3. c\n  4. d\n- e",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1</table>": "Name       N\nlong name  1",
    "<table><td>a<td>b</table>": "a  b",
    "<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>": "wide     x\n1     2  3",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\nd\nu\ne",
    "a<br>b<hr>c": "a\nb\n\nc",
    "<pre> x\n  y </pre>z": " x\n  y\n\nz",
    "<style>.x,#y{display:none}</style>a<i class='q x'>b</i><i id=y>c</i>d": "ad",
    "a<span hidden>b</span><span style='visibility: hidden'>c</span><input type=hidden value=v>d": "ad",
    "<script>if (a<b) {}</script><template>t</template><noscript>n</noscript>v": "v",
    "<details><summary>s</summary>h</details><details open><summary>t</summary>i</details>": "s\nt\ni",
    "x &lt; y &amp; z < 3": "x < y & z < 3",
    "<!-- no --><!doctype html>yes<!-- open": "yes",
    "</p>a</b></div>b": "ab",
    "<select><option>1<option>2</select>": "1\n2",
    "<a href=\"x>y\">in</a><img alt=pic>": "inpic",
    "<title>T</title><h1>H</h1>t": "H\n\nt",
    "<textarea>a <b></textarea>": "a <b>",
    "<ol start=--5><li>a</ol><ol start=-3><li>b<li value=7>c</ol>": "1. a\n\n-3. b\n7. c",
    "&#0000065;&#99999999999;b": "A\ufffdb",
    "<style>@media print{.a{display:none}} /* .b{} */ .c{display:none}</style><p class=a>A<p class=b>B<p class=c>C": "A\n\nB",
    "<style>@media (max-width:600px){.a{display:none}} @media screen{.b{display:none}}</style><i class=a>A</i><i class=b>B</i>": "A",
    "<style>p{display:none} .k{display:block} #z{display:none!important}</style><p>a<p class=k>b<p class=k id=z style='display:block'>c": "b",
    "<div style='visibility:hidden'>a <b style='visibility:visible'>b</b></div><p hidden style='display:block'>c": "b\n\nc",
    "<table><tr><th rowspan=2>Name<th>Size<tr><td>12<tr><td>q<td>3</table>": "Name  Size\n      12\nq     3",
    "<table><tr><td>a<td><p>one</p><ul><li>x<li>y</ul></table>": "a  one\n\n   - x\n   - y".replace("\n\n", "\n"),
    "<table>stray<caption>Cap</caption><tr><td>1<td><table><tr><td>2<td>3</table></table>": "stray\nCap\n1  2  3",
    "<table><tr><td>" + "w" * 90 + "<td>b<tr><td>c<td>d</table>": "w" * 90 + "\n   b\nc  d",
    "<table><tr><td><details><summary>s</summary>h</details><td>x</table>": "s  x",
}


@pytest.mark.parametrize("source", CASES)
def test_rendering(source):
    assert to_text(source)[0] == CASES[source]


def test_depth_and_breaks():
    assert to_text("<div>" * 20_000 + "deep") == ("deep", "")
    assert to_text("x<a \"" * 3000)[0] == "x"
    assert to_text("<table>" * 3000 + "x")[0].strip() == "x"
    assert to_text("<title>A &amp; B</title>") == ("", "A & B")


class Seen(HTMLParser):
    """Words outside elements that are never shown."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words = []

    def handle_data(self, data):
        self.words += data.split()


TAGS = "div p b i ul ol li table tr td th tbody caption span h1 dl dt dd pre section a blockquote".split()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_no_visible_word_is_lost(seed):
    r = random.Random(seed)
    parts = []
    for k in range(r.randrange(60)):
        parts.append(r.choice([f"<{r.choice(TAGS)}>", f"</{r.choice(TAGS)}>", f" w{k} ", f"<td colspan={r.randrange(4)} rowspan={r.randrange(4)}>c{k} ", "<br>", "<!-- c -->"]))
    source = "".join(parts)
    want = Seen()
    want.feed(source)
    want.close()
    got = [w for w in to_text(source)[0].split() if not (w == "-" or w[:-1].isdigit())]
    assert sorted(got) == sorted(want.words)


@settings(max_examples=300, deadline=None)
@given(st.text("<>/ab&#;0x=\"'-! \n{}@.:", max_size=200), st.lists(st.sampled_from(["<style>", "</style>", "<td colspan=", "<ol start=", "<li value=-", "&#", "<table>", "<!--", "9" * 5000, "style='display:"]), max_size=6))
def test_any_source_gives_text(text, more):
    r = random.Random(len(text))
    at = sorted(r.randrange(len(text) + 1) for _ in more)
    for k, x in zip(reversed(at), more, strict=True):
        text = text[:k] + x + text[k:]
    assert isinstance(to_text(text)[0], str)


@pytest.mark.parametrize("unit", ["<div>", "<p><table><td>", "<ul><li>", "a{", "<b>x</i>", "<table><tr><td>", "<td rowspan=3>a<tr>", "&#", "<a \"", "<style>.x{", "<!--", "/*"])
def test_time_grows_with_the_length(unit):
    def took(n: int) -> float:
        began = time.perf_counter()
        to_text("<style>" * (unit in ("a{", "/*")) + unit * n)
        return time.perf_counter() - began

    took(100)
    small, large = took(10_000), took(80_000)
    assert large < max(40 * small, 10)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "<p>x"), (3, "<p>x"), (4, "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'old' AS ht_text", "1 AS text")
    got = [(r.page_id, len(r.ht_text), r.text) for r in extract(pages).collect()]
    assert sorted(got) == [(1, 0, 1), (2, 0, 1), (3, 1, 1), (3, 1, 1), (4, 999_999, 1)]
    assert extract(pages.where("false")).count() == 0


def test_query_covers_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = op1_html(spark, sf).collect()
    assert len(rows) == pages.count()
    assert all("<p>" not in r.text and "track(" not in r.text for r in rows)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><tr><td>loose</td></tr>foster text</table>", "foster text\nloose"),
        ("<p>a</p><svg><title>t</title><text>drawn</text><desc>no</desc></svg>", "a\n\ndrawn"),
        ("<p>x <math><mi>y</mi><annotation>no</annotation></math></p>", "x y"),
        ("<ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>", "kanji"),
    ],
)
def test_stray_table_text_and_foreign_elements(source, text):
    assert to_text(source) == (text, "")


def test_rules_that_share_a_class_are_found_by_their_other_one():
    rules = "".join(f".x.a{i} {{ display: {'none' if i % 2 else 'block'} }}" for i in range(4000))
    page = f"<style>{rules} .x {{ display: none }} p.x.b {{ visibility: hidden }}</style>" + "".join(f"<p class='x a{i}'>w{i}</p>" for i in range(4000)) + "<p class='b x'>no</p>"
    start = time.perf_counter()
    assert to_text(page)[0].split() == [f"w{i}" for i in range(0, 4000, 2)]
    assert time.perf_counter() - start < 2
