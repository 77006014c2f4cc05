"""Links and text of pages whose attributes hold markup, against a full HTML parser."""

import time
from html.parser import HTMLParser

import pytest

from adflow.llm import warc


class Parsed(HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.links, self.words = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "area", "link"):
            self.links += [dict(reversed(attrs))["href"]] if "href" in dict(attrs) else []

    def handle_data(self, data):
        self.words += data.split()


PAGES = ['<p>one <a title="Home > News" href="/n">two</a> three', '<a href="/s?q=a>b">x</a> y',
         '<a data-href="/no" href="/yes">z</a>', """<a href="/s" onclick="if(a>b)go()">x</a><a HREF='/q"r'>w</a>""",
         '<area alt="a<b" href=/bare><link rel=x href="/l?a=1&amp;b=2"><a name=n>none</a>',
         "<p it's>a <a href = '/sp'>b</a> c</p>", '<a title="<!-- x" href="/c">d</a> <!-- <a href="/hidden"> --> e',
         '<img alt="<a href=/no>"><a href="/first" href="/second">f</a>', '<link href="/x"/><a href="">g</a>']


@pytest.mark.parametrize("page", PAGES)
def test_links_and_text(page):
    parsed = Parsed(page)
    assert warc.title_and_links(page)[1] == parsed.links
    assert "".join(warc.plain_text(page).split()) == "".join(parsed.words)


@pytest.mark.parametrize("part", ["<a x=\"<a' ", "<script", "<a b='", "<a =", "<!-", "<title>", "= \" <a "])
def test_time_is_linear(part):
    start = time.time()
    warc.title_and_links(part * 50_000), warc.plain_text(part * 50_000)
    assert time.time() - start < 5
