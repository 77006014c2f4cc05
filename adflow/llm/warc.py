"""WARC derivatives: linked metadata and plain-text conversion records.

``responses`` turns a table of crawled pages into WARC response records (an HTTP
message each). ``derive`` gives two records for every response:

* ``metadata``: a JSON block with the source's WARC and HTTP headers, the title and
  the outgoing links of the page;
* ``conversion``: the plain text of the page.

Both name the response in WARC-Refers-To and keep its target URI, date, block and
payload digest; the metadata record also names the conversion record made beside
it (WARC-Concurrent-To). Record ids are name-based UUIDs of what they stand for,
so a repeated or retried task gives the same ids. Every record stands alone: the
work is a map over rows without any shuffle.

``write_warc`` and ``read_warc`` store the records as WARC files and read them back;
reading checks each record's length and block digest.

Defined results: a null page has an empty payload, a null URL no target URI (a null
column, no header). Repeated rows give repeated records with equal ids; there is no
order, so there are no ties. Empty pages give an empty conversion text. Very long pages
are read whole, one in a task at a time. An empty table gives no records. Columns are
taken by name into fresh ones, so that other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

CRLF = "\r\n"
#: Date of records whose page names none.
NO_DATE = "1970-01-01T00:00:00Z"

RECORD = ("record_type string, record_id string, target_uri string, warc_date string, refers_to string, "
          "concurrent_to string, content_type string, content_length long, block_digest string, "
          "payload_digest string, source_block_digest string, source_payload_digest string, block string")

#: The rest of a tag; a quoted value is a unit, whatever it holds. Possessive: time is linear.
_BODY = r"""(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')|=)*+(?:>|\Z)"""
#: One piece of markup, taken from left to right: comment, hidden element, tag, declaration.
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<hidden>script|style|noscript|template)(?=[\s/>]){_BODY}.*?(?:</(?P=hidden)\s*>|\Z)"
                     rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>{_BODY})|<[/!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_BREAKS = frozenset("p div br li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr td th table section article header footer nav aside main "
                    "title head body html blockquote pre form figure hr".split())
_LINKS = frozenset(("a", "area", "link"))
_GAP = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """The text of a page: hidden elements and tags removed, block elements on lines
    of their own, entities decoded, white space collapsed."""
    def instead(m: re.Match) -> str:
        name = (m["name"] or "").lower()
        return "\n" if name in _BREAKS else "" if name else " " if m["hidden"] or m[0].startswith("<!--") else ""

    text = _MARKUP.sub(instead, page)
    lines = (_GAP.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _href(rest: str) -> str | None:
    """The first attribute href of a tag, None without one."""
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        if name.lower() == "href":
            return html.unescape(a or b or c)
    return None


def title_and_links(page: str) -> tuple[str, list[str]]:
    titles, links, opened = [], [], None
    for m in _MARKUP.finditer(page):
        name = (m["name"] or "").lower()
        if name == "title" and m["end"] and opened is not None:
            titles.append(page[opened:m.start()])
            opened = None
        elif name == "title" and not m["end"] and opened is None:
            opened = m.end()
        elif name in _LINKS and not m["end"] and (href := _href(m["rest"])) is not None:
            links.append(href)
    found = titles[:1] or ([page[opened:]] if opened is not None else [])
    title = _GAP.sub(" ", html.unescape(_MARKUP.sub("", found[0])).replace("\n", " ")).strip() if found else ""
    return title, links


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
              warc_date: Column | None = None) -> DataFrame:
    """Response records of ``pages``, with the page's id in column ``page_id``."""
    date = F.lit(NO_DATE) if warc_date is None else warc_date
    kept = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.col(f"`{page}`").cast("string").alias("html"), date.cast("string").alias("warc_date"))

    schema = T.StructType([T.StructField("page_id", kept.schema["page_id"].dataType), *_record_fields()])

    def response(r: dict) -> dict:
        page = r["html"] or ""
        payload = page.encode("utf-8", "surrogatepass")
        head = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
                          f"Content-Length: {len(payload)}", "", ""])
        block, paid = head.encode() + payload, digest(payload)
        return {"page_id": r["page_id"], "record_type": "response", "target_uri": r["url"],
                "record_id": name_id("response", str(r["page_id"]), r["url"] or "", paid),
                "warc_date": r["warc_date"] or NO_DATE, "content_type": "application/http; msgtype=response",
                "content_length": len(block), "block_digest": digest(block), "payload_digest": paid,
                "block": head + page}

    return kept.mapInArrow(_mapper(lambda r: [response(r)], schema), schema)


def _record_fields() -> list[T.StructField]:
    return [T.StructField(name, T.LongType() if kind == "long" else T.StringType())
            for name, kind in (field.split() for field in RECORD.split(", "))]


def _mapper(made, schema: T.StructType):
    """A mapInArrow function that gives the rows ``made(row)`` for every row."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for b in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_pylist([x for r in b.to_pylist() for x in made(r)], schema=target)

    return run


def _derived(r: dict) -> list[dict]:
    """The metadata and the conversion record of one response record."""
    head, _, page = (r["block"] or "").partition(CRLF * 2)
    status, *fields = head.split(CRLF)
    title, links = title_and_links(page)
    conversion, metadata = name_id("conversion", r["record_id"] or ""), name_id("metadata", r["record_id"] or "")
    source = {name: r[column] for name, column in _HEADERS if r[column] is not None}
    about = {"warc": source, "title": title, "links": links,
             "http": {"status": status, "headers": [list(f.partition(": ")[::2]) for f in fields if f]}}
    rows = []
    for kind, own, beside, content, block in (
            ("metadata", metadata, conversion, "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True)),
            ("conversion", conversion, None, "text/plain; charset=utf-8", plain_text(page))):
        data = block.encode("utf-8", "surrogatepass")
        rows.append({"record_type": kind, "record_id": own, "target_uri": r["target_uri"], "warc_date": r["warc_date"],
                     "refers_to": r["record_id"], "concurrent_to": beside, "content_type": content,
                     "content_length": len(data), "block_digest": digest(data), "payload_digest": digest(data),
                     "source_block_digest": r["block_digest"], "source_payload_digest": r["payload_digest"],
                     "block": block})
    return rows


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """``key`` and the metadata and conversion records of the response records."""
    schema = T.StructType([T.StructField(key, records.schema[key].dataType), *_record_fields()])

    def made(r: dict) -> list[dict]:
        return [{key: r[key], **x} for x in _derived(r)] if r["record_type"] == "response" else []

    return records.select(schema.names).mapInArrow(_mapper(made, schema), schema)


_HEADERS = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"),
            ("WARC-Date", "warc_date"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"),
            ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"),
            ("WARC-Source-Block-Digest", "source_block_digest"),
            ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"),
            ("Content-Length", "content_length"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one per partition, into the new folder ``path``."""
    lines = [F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit(CRLF)) for name, column in _HEADERS]
    text = F.concat(F.lit(f"WARC/1.0{CRLF}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF),
                    F.coalesce(F.col("block"), F.lit("")))
    records.select(text.alias("value")).write.option("lineSep", CRLF * 2).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at ``path``, and ``intact``: the block has the
    stated length and digest. Files are split at the line that opens a record, so a
    large file is read by many tasks; a block that holds such a line is not intact."""
    between = f"{CRLF}{CRLF}WARC/1.0{CRLF}"
    raw = spark.read.option("lineSep", between).text(path)
    whole = F.regexp_replace(F.regexp_replace("value", r"^WARC/1\.0\r\n", ""), r"\r\n\r\n$", "")
    # The separator takes the last record's line ends only between records.
    split = raw.select(F.when(F.col("value").endswith(CRLF * 2), whole).otherwise(
        F.regexp_replace("value", r"^WARC/1\.0\r\n", "")).alias("r"))
    head = F.concat(F.lit("\r\n"), F.substring_index("r", CRLF * 2, 1), F.lit(CRLF))
    block = F.substring(F.col("r"), F.length(F.substring_index("r", CRLF * 2, 1)) + 5, F.length("r"))
    fields = []
    for name, column in _HEADERS:
        value = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        present = head.contains(f"\r\n{name}: ")
        value = F.when(present, value)
        fields.append((value.cast("long") if column == "content_length" else value).alias(column))
    parsed = split.select(*fields, block.alias("block"))
    sha = F.concat(F.lit("sha1:"), _base32(F.sha1(F.col("block").cast("binary"))))
    return parsed.withColumn("intact", F.coalesce((F.octet_length("block") == F.col("content_length"))
                                                  & (F.col("block_digest") == sha), F.lit(False)))


def _base32(hexadecimal: Column) -> Column:
    """Base 32 of 20 bytes given as 40 hex digits: 5 bits a digit."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hexadecimal, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(5)])
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(alphabet, F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1))
                      for i in range(32)])


def derivatives(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id and the metadata and conversion records of a table of pages."""
    return derive(responses(pages, page_id, url, page))
