"""Web-archive derivatives: responses become linked metadata and plain-text conversion records.

Both derivatives refer to the response by its record id and repeat its target URI, date and payload digest;
each has a block digest of its own. Every record is made from one row, so nothing is shuffled.

A page is read in one pass from tag to tag, in time linear in its length. A tag ends at the first ``>``;
comments, scripts, styles and templates are skipped to their ends, or to the page's end where they have none,
so links, title and language are those of what a reader sees.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, table

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs
MARK = re.compile(r"<(?:(!--.*?(?:-->|\Z))|(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)(?:>|\Z)|[/!?][^>]*(?:>|\Z))", re.DOTALL)
SKIPPED = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "noscript", "template")}
BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer title head body html blockquote pre br".split())
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")


@dataclass
class Page:
    """What one pass finds: text with a line for each block, links, the first title, the language that ``<html lang>`` names; null: none."""

    text: str
    links: list[str]
    title: str
    lang: str


def attribute(source: str, name: str) -> str | None:
    """The value of a tag's first attribute of that name, its entities resolved."""
    for m in ATTRIBUTE.finditer(source):
        if m[1].lower() == name:
            return html.unescape(m[2] or m[3] or m[4] or "")
    return None


def read(source: str) -> Page:
    out, links, title, lang, at = [], [], None, None, 0
    while (m := MARK.search(source, at)) is not None:
        if m.start() > at:
            out.append(source[at : m.start()])
        name, at = (m[3] or "").lower(), m.end()
        if m[1]:
            out.append(" ")
        elif name in SKIPPED and not m[2]:
            end = SKIPPED[name].search(source, at)
            at = end.end() if end else len(source)
            out.append(" ")
        elif name in BLOCKS:
            out.append("\n")
        if m[2] or not name:
            continue
        if name == "a" and (link := attribute(m[4], "href")) is not None:
            links.append(link)
        elif name == "html" and lang is None:
            lang = attribute(m[4], "lang")
        elif name == "title" and title is None:
            end = source.find("<", at)
            title = html.unescape(source[at : end if end >= 0 else len(source)])
    out.append(source[at:])
    text = LINES.sub("\n", BLANKS.sub(" ", html.unescape("".join(out)))).strip()
    return Page(text, links, title or "", lang or "")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def header(value: str) -> str:
    """A header's value cannot hold line ends."""
    return " ".join(value.split())


def record(kind: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = "".join(f"{k}: {header(v)}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (page_id, url, html): record_id, target_uri, date, http_header, payload. Null urls and pages count as empty.

    The record id depends on page_id, url and page alone, so a task that runs again writes the same.
    """

    def make():
        def batch(keys, urls, bodies):
            own = [(b or "").encode("utf-8", "surrogatepass") for b in bodies]
            ids = [f"<urn:uuid:{uuid.uuid5(SPACE, f'{k} {u or ""} {hashlib.sha1(b).hexdigest()}')}>" for k, u, b in zip(keys, urls, own, strict=True)]
            heads = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(b)}\r\n\r\n" for b in own]
            return keys, ids, [u or "" for u in urls], [date] * len(keys), heads, [b or "" for b in bodies]

        return batch

    return map_rows(pages, ["page_id", "url", "html"], "page_id long, record_id string, target_uri string, date string, http_header string, payload string", make)


def derivatives(found: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record.

    page_id, record_type, record_id, refers_to, target_uri, source_digest (of the payload), block_digest,
    content_length, n_links, record (the whole record as text). Empty pages give empty conversions, responses
    that repeat give derivatives that repeat, ids included, and no responses give none.
    """
    schema = "page_id long, record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, n_links long, record string"

    def make():
        def batch(keys, ids, uris, dates, heads, payloads):
            rows = []
            for key, source, uri, date, head, payload in zip(keys, ids, uris, dates, heads, payloads, strict=True):
                raw = payload.encode("utf-8", "surrogatepass")
                payload_digest = digest(raw)
                page = read(payload)
                status, _, sent = head.partition("\r\n")
                facts = [("source-status", status), *(("source-" + k.lower(), v) for k, _, v in (x.partition(": ") for x in sent.split("\r\n") if x))]
                facts += [("title", page.title), ("html-lang", page.lang), *(("outlink", x) for x in page.links)]
                meta = "".join(f"{k}: {header(v)}\r\n" for k, v in facts).encode("utf-8", "surrogatepass")
                text = page.text.encode("utf-8", "surrogatepass")
                for kind, block, form in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
                    own = f"<urn:uuid:{uuid.uuid5(SPACE, source + ' ' + kind)}>"
                    fields = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", payload_digest), ("Content-Type", form)]
                    whole = record(kind, block, fields).decode("utf-8", "surrogatepass")
                    rows.append((key, kind, own, source, uri, payload_digest, digest(block), len(block), len(page.links), whole))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 10

        return batch

    return map_rows(found, ["page_id", "record_id", "target_uri", "date", "http_header", "payload"], schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages").select("page_id", F.col("url"), F.col("html"))))
