"""WARC derivatives: linked records, digests, exact file round trip."""

import base64
import hashlib
import json
from html.parser import HTMLParser

from adflow.llm import warc
from adflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Words(HTMLParser):
    """Visible words by a full HTML parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_query_against_a_parser(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op10_warc_derivatives"](spark, SF).collect()
    assert len(got) == 2 * len(pages) and len({r.record_id for r in got}) == len(got)
    source = {r.page_id: r for r in warc.responses(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    beside = {r.record_id for r in got if r.record_type == "conversion"}
    for r in got:
        page, s = pages[r.page_id], source[r.page_id]
        assert (r.refers_to, r.target_uri, r.warc_date) == (s.record_id, page.url, s.warc_date)
        assert (r.source_block_digest, r.source_payload_digest) == (s.block_digest, s.payload_digest)
        assert r.block_digest == sha1(r.block) and r.content_length == len(r.block.encode())
        assert s.payload_digest == sha1(page.html) and s.block.endswith("\r\n\r\n" + page.html)
        if r.record_type == "conversion":
            parser = Words()
            parser.feed(page.html)
            assert "".join(r.block.split()) == "".join(parser.words)
        else:
            about = json.loads(r.block)
            assert about["warc"]["WARC-Record-ID"] == s.record_id and r.concurrent_to in beside
            assert about["http"]["status"] == "HTTP/1.1 200 OK" and about["links"]


def test_odd_pages(spark):
    rows = [(1, None, None, "a"), (1, None, None, "a"), (2, "http://x/", "", "b"), (None, "http://y/", "<p>a<p>b", None),
            (3, "u", "<script>x</p>" + "<p>" * 5, None), (4, "u", "<" * 20_000 + "&lt;b&gt; &amp;", None),
            (5, "u", "<p>été</p><!-- c", None), (6, "u", "<script" * 5000, None), (7, "u", "word " * 300_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = warc.derivatives(pages).collect()
    assert len(got) == 2 * len(rows)
    text = {(r.page_id): r.block for r in got if r.record_type == "conversion"}
    assert (text[1], text[2], text[None], text[3], text[5]) == ("", "", "a\nb", "", "été")
    assert text[4].endswith("<b> &") and len(text[7]) == 5 * 300_000 - 1
    again = warc.derivatives(pages.repartition(3)).collect()
    assert sorted(r.record_id for r in got) == sorted(r.record_id for r in again)


def test_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    records = warc.responses(pages).unionByName(warc.derivatives(pages))
    warc.write_warc(records, str(tmp_path / "crawl"))
    back = warc.read_warc(spark, str(tmp_path / "crawl"))
    columns = [c for c in records.columns if c != "page_id"]
    assert sorted(map(str, records.select(columns).collect())) == sorted(map(str, back.select(columns).collect()))
    assert back.filter("NOT intact").count() == 0
    derived = warc.derive(back.filter("record_type = 'response'").withColumnRenamed("target_uri", "u")
                          .selectExpr("u AS page_id", "u AS target_uri", *[c for c in columns if c != "target_uri"]))
    assert {r.record_id for r in derived.collect()} == {r.record_id for r in warc.derivatives(pages).collect()}


def test_damaged_record_is_told(spark, tmp_path):
    one = warc.responses(spark.createDataFrame([(1, "u", "x\r\n\r\nWARC/1.0\r\ny")], "page_id long, url string, html string"))
    warc.write_warc(one, str(tmp_path / "bad"))
    assert not any(r.intact for r in warc.read_warc(spark, str(tmp_path / "bad")).collect())


def test_empty_table(spark):
    assert warc.derivatives(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
