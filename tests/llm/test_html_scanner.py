"""The page scanner: against the parser of the standard library, and on markup that never ends."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from lodestone.llm import html_text

P = " ".join(f"word{k}" for k in range(50))


class _Blocks(HTMLParser):
    """Blocks of well-formed pages."""

    HIDDEN = ("script", "style", "head", "noscript", "textarea", "iframe", "svg", "template", "select", "title")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.linked, self.links, self.hidden = [], [], 0, 0, 0

    def close_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((text, len(text.split()), min(1.0, self.linked / len(text.split()))))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag == "a":
            self.links = 1
        elif tag not in html_text._INLINE and tag not in self.HIDDEN:
            self.close_block()

    def handle_startendtag(self, tag, attrs):
        if tag not in html_text._INLINE:
            self.close_block()

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        if tag == "a":
            self.links = 0
        elif tag not in html_text._INLINE and tag not in self.HIDDEN:
            self.close_block()

    def handle_comment(self, data):
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            self.linked += len(data.split()) * self.links


def _parsed(page):
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    parser.close_block()
    return parser.out


def test_blocks_agree_with_a_parser(spark, sf_dir):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    assert len(pages) >= 50
    for page in pages:
        assert html_text.blocks(page) == _parsed(page)


@pytest.mark.parametrize(
    "page",
    [
        f"<div title='a > b'>{P}</div><p>one<br/>two</p>", f'<p>{P} <a href="x?a=1&b=2">link text</a> &amp; more &eacute;</p><!-- <p>no</p> --><ul><li>x<li>y</ul>', f"<h1>{P}</h1>a<b>b</b>c<!-- x -->d<script>if (a < b) document.write('<p>')</script><p>e</p>",
        f"<svg><text>no</text></svg><table><tr><td>{P}<td>c</table>", "<html><head><title>t</title><style>p {}</style></head><body>x</body></html>", "",
    ],
)
def test_small_pages_agree_with_a_parser(page):
    assert html_text.blocks(page) == _parsed(page)


@pytest.mark.parametrize("part", ["<script", "<a ", '<p title="x ', "<style ", "</a ", "<title", "<title>", '<a ">" ', "<a '", "<![CDATA[", "<textarea>", "<head>", "<svg>", "<a>", "<", '<a "> ', "<noscript></textarea>", "<title><", "<!", "<textarea></textarea "])
def test_a_million_characters_take_linear_time(part):
    page = part * (1_000_000 // len(part))
    for more in ("", ">", '">', "</textarea>", "</title>-->]]>"):
        began = time.process_time()
        html_text.extract_text(page + more)
        html_text.title(page + more)
        assert time.process_time() - began < 15


def test_titles():
    assert html_text.title("<TITLE lang='a>b'> A &amp;\n B </title><title>C</title>") == "A & B"
    assert html_text.title("<title>never closed") is None and html_text.title("<p>x</p>") is None and html_text.title("<title></title>") == ""


def test_attributes_that_look_like_markup():
    assert [b[0] for b in html_text.blocks(f"<p title='<script>'>{P}</p><p data-x=\"<!--\">end</p>")] == [P, "end"]
