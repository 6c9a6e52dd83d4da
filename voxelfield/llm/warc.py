"""WARC derivatives: metadata and plain-text conversion records of responses.

Responses are rows (record_id, target_uri, date, http_headers, payload). Each
gives two records that name it in WARC-Refers-To: ``metadata`` (title, base,
outlinks, size of the text) and ``conversion`` (the text). Both carry the
source's target, date, payload digest and HTTP headers; the conversion names
its metadata record in WARC-Concurrent-To. Files are written and read by
Spark's text source with the record boundary as line separator.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelfield.llm.text import map_slices

VERSION = "WARC/1.0"
NEWLINE = "\r\n"
# What a tag starts with; anything else after "<" is text.
OPENING = re.compile(r"</?([a-zA-Z]\w*)|<[a-zA-Z/!?]")
HIDDEN = frozenset("script style template noscript title".split())
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr"
    " html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
HREF = re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"""\"([^\"]*)\"|'([^']*)'|([^\s"'>]+)""")
SPACES = re.compile(r"[^\S\n]+")
LINES = re.compile(r"\s*\n\s*")
ZEROS = re.compile(r"&#0+(?=[0-9])")
LONG_NUMBER = re.compile(r"&#[0-9]{8,};?")

RECORD = (
    "source_id string, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, "
    "date string, content_type string, content_length long, block_digest string, source_payload_digest string, "
    "source_headers string, block string"
)


@dataclass
class Page:
    """What one pass over a page's tags finds: text pieces, the first title, the first base and all links as written."""

    pieces: list[str] = field(default_factory=list)
    title: str | None = None
    base: str | None = None
    links: list[str] = field(default_factory=list)


def scanned(page: str) -> Page:
    """Read a page tag by tag, once; a page of unclosed tags costs no more than any other.

    A tag ends at its first ">"; without one the rest of the page is text. An
    unclosed comment or hidden element hides the rest. What is hidden has no
    links.
    """
    out, at, shown = Page(), 0, 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            out.pieces += [page[shown:at], " "]
            at = shown = len(page) if end < 0 else end + 3
            continue
        opening = OPENING.match(page, at)
        if opening is None:
            at += 1
            continue
        end = page.find(">", at)
        if end < 0:
            break
        out.pieces.append(page[shown:at])
        name, first = (opening.group(1) or "").lower(), page[at + 1] != "/"
        if first and name in HIDDEN:
            close = CLOSING[name].search(page, end + 1)
            if name == "title" and out.title is None and close:
                out.title = page[end + 1 : close.start()]
            out.pieces.append(" ")
            at = shown = close.end() if close else len(page)
            continue
        if name in BREAKS:
            out.pieces.append("\n")
        elif first and name in ("a", "base") and (href := HREF.search(page, opening.end(), end)):
            value = VALUE.match(page, href.end())
            target = next((g for g in value.groups() if g is not None), "") if value else ""
            if name == "a":
                out.links.append(target)
            elif out.base is None:
                out.base = target
        at = shown = end + 1
    out.pieces.append(page[shown:])
    return out


def unescaped(text: str) -> str:
    """Entities resolved; a number beyond all characters, however long, is U+FFFD."""
    return html.unescape(LONG_NUMBER.sub("\ufffd", ZEROS.sub("&#", text))) if "&" in text else text


def plain_text(page: str | Page) -> str:
    """Visible text of a page: block elements end lines, entities are resolved, blank lines go."""
    page = scanned(page) if isinstance(page, str) else page
    return LINES.sub("\n", SPACES.sub(" ", unescaped("".join(page.pieces)))).strip()


def outlinks(page: str | Page, uri: str | None) -> list[str]:
    """Absolute targets of the page's links, in order, each once; a <base> counts."""
    page = scanned(page) if isinstance(page, str) else page
    root = _join(uri or "", unescaped(page.base)) if page.base else uri or ""
    found: dict[str, None] = {}
    for link in page.links:
        target = unescaped(link).strip()
        if target and not target.lower().startswith(("javascript:", "mailto:", "#")):
            found.setdefault(re.sub(r"\s", "%20", _join(root, target)))
    return list(found)


def _join(root: str, target: str) -> str:
    try:
        return urljoin(root, target)
    except ValueError:  # not a parsable address: kept as it is written
        return target


def digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def record_id(source: str, kind: str) -> str:
    """A name that depends on the source record and the kind only, so a retry gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def responses(pages: DataFrame, date: str, key: str = "page_id") -> DataFrame:
    """Response records of ``pages`` (key, url, html): identity, target, date, HTTP headers and payload."""
    payload = F.coalesce("html", F.lit(""))
    name = F.md5(F.concat_ws("\n", F.col(key).cast("string"), "url", payload).cast("binary"))
    urn = F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">")
    )
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "),
        F.octet_length(payload).cast("string"),
    )
    return pages.select(
        F.col(key).alias("key"), urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        headers.alias("http_headers"), payload.alias("payload"),
    )


def derivatives(source: DataFrame) -> DataFrame:
    """Two records per response, in the columns of ``RECORD``.

    ``source`` has record_id, target_uri, date, http_headers and payload;
    further columns are ignored. A NULL payload reads as empty and gives empty
    text; a NULL target or date stays NULL; a response without record_id gets
    the id of its content. Rows that repeat a response give equal records.
    Empty input, empty result.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        columns = (part.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "http_headers", "payload"))
        for source_id, uri, date, headers, payload in zip(*columns):
            page = payload or ""
            source_digest = digest(page.encode("utf-8", "surrogatepass"))
            source_id = source_id or record_id(f"{uri}\n{source_digest}", "response")
            read = scanned(page)
            text = plain_text(read)
            title = SPACES.sub(" ", unescaped(read.title or "").replace("\n", " ").replace("\r", " ")).strip()
            fields = [f"title: {title}", f"text-chars: {len(text)}", f"text-words: {len(text.split())}"]
            fields += [f"outlink: {link} L a/@href" for link in outlinks(read, uri)]
            blocks = {"metadata": "".join(f + NEWLINE for f in fields), "conversion": text}
            kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
            for kind, block in blocks.items():
                data = block.encode("utf-8", "surrogatepass")
                other = record_id(source_id, "metadata") if kind == "conversion" else None
                out.append((
                    source_id, kind, record_id(source_id, kind), source_id, other, uri, date, kinds[kind], len(data),
                    digest(data), source_digest, headers, block,
                ))
        columns = list(zip(*out)) if out else [[] for _ in names]
        types = [pa.int64() if n == "content_length" else pa.string() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return map_slices(source.select("record_id", "target_uri", "date", "http_headers", "payload"), handle, RECORD, "payload")


def serialised(records: DataFrame) -> DataFrame:
    """Records as WARC text, up to the two line ends that close a record."""
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(NEWLINE)), F.lit(""))
    folded = F.regexp_replace("source_headers", r"\r\n", " | ")
    return records.withColumn("source_headers", folded).select(
        F.concat(
            F.lit(VERSION + NEWLINE), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"),
            line("WARC-Refers-To", "refers_to"), line("WARC-Concurrent-To", "concurrent_to"), line("WARC-Target-URI", "target_uri"),
            line("WARC-Date", "date"), line("WARC-Block-Digest", "block_digest"),
            line("WARC-Source-Payload-Digest", "source_payload_digest"), line("WARC-Source-Headers", "source_headers"),
            line("Content-Type", "content_type"), line("Content-Length", "content_length"), F.lit(NEWLINE), F.col("block"),
        ).alias("value")
    )


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file per partition."""
    serialised(records).write.option("lineSep", NEWLINE * 2).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block, complete) of all records under ``path``.

    Uncompressed files are split between tasks at record starts. ``complete``
    is false where the block is shorter than its Content-Length, as in a cut
    file or a block that itself holds a record start.
    """
    lines = spark.read.option("lineSep", VERSION + NEWLINE).text(path).where("length(value) > 0").select(F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, blocks, complete = [], [], []
            for value in batch.column("value").to_pylist():
                head, _, rest = value.partition(b"\r\n\r\n")
                headers = [tuple(x.split(": ", 1)) for x in head.decode("utf-8", "replace").split(NEWLINE) if ": " in x]
                size = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), 0)
                maps.append(headers)
                blocks.append(rest[:size])
                complete.append(len(rest) >= size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(maps, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary()), pa.array(complete, pa.bool_())],
                names=["headers", "block", "complete"],
            )

    return lines.mapInArrow(run, "headers map<string,string>, block binary, complete boolean")
