import hashlib
import time
from html.parser import HTMLParser

from voxelfield.llm import queries, warc
from voxelfield.llm.storage import place

SF = "/root/testdata/sf0.001"


class Visible(HTMLParser):
    """Words a page shows, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words, self.links = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title", "template", "noscript")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title", "template", "noscript")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_pages_against_the_standard_parser(spark):
    pages = {r.url: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    records = queries.op2_warc_derivatives(spark, SF).collect()
    assert len(records) == 2 * len(pages)
    texts = {r.target_uri: r for r in records if r.record_type == "conversion"}
    metadata = {r.target_uri: r for r in records if r.record_type == "metadata"}
    for url, page in pages.items():
        parser = Visible()
        parser.feed(page)
        assert "".join(texts[url].block.split()) == "".join(parser.words)
        assert metadata[url].block.count("outlink: ") == len(set(parser.links))
        assert texts[url].source_payload_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest()


def test_links_between_records(spark):
    records = queries.op2_warc_derivatives(spark, SF).collect()
    assert len({r.record_id for r in records}) == len(records)
    by_id = {r.record_id: r for r in records}
    for r in records:
        assert r.refers_to == r.source_id and r.source_headers.startswith("HTTP/1.1 200 OK")
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        if r.record_type == "conversion":
            assert by_id[r.concurrent_to].record_type == "metadata" and by_id[r.concurrent_to].refers_to == r.refers_to


def test_odd_pages(spark):
    rows = [
        (1, None, "<p>a&amp;b<br>c</p>", "x"), (2, "http://h/x/", None, None), (3, "http://h/", "", None),
        (4, "http://h/x/", "<script>never closed <p>", None), (5, "http://h/x/", "<base href='/y/'><a href=z>1</a><A HREF=\"z\">2</A> 3 < 4", None),
        (5, "http://h/x/", "<base href='/y/'><a href=z>1</a><A HREF=\"z\">2</A> 3 < 4", None), (None, None, None, None),
        (6, "http://h/", "<p>" + "word " * 200_000, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    found = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z")).collect()
    assert len(found) == 2 * len(rows)
    text = {(r.target_uri, r.source_payload_digest): r.block for r in found if r.record_type == "conversion"}
    blocks = sorted(text.values(), key=len)
    assert "a&b\nc" in blocks and "12 3 < 4" in blocks and len(blocks[-1].split()) == 200_000
    links = [r.block for r in found if "outlink" in r.block]
    assert len(links) == 2 and all("outlink: http://h/y/z L" in b for b in links)
    none = spark.createDataFrame([], pages.schema)
    assert warc.derivatives(warc.responses(none, "2024-01-01T00:00:00Z")).collect() == []


def test_files_round_trip(spark):
    records = queries.op2_warc_derivatives(spark, SF)
    for compression in ("none", "gzip"):
        path = place(spark, "warc")
        warc.write_warc(records, path, compression)
        back = warc.read_warc(spark, path).collect()
        assert all(r.complete for r in back)
        got = {r.headers["WARC-Record-ID"]: (r.headers["WARC-Refers-To"], bytes(r.block).decode()) for r in back}
        assert got == {r.record_id: (r.refers_to, r.block) for r in records.collect()}


def test_unclosed_tags_cost_in_proportion():
    def seconds(page):
        started = time.process_time()
        warc.outlinks(page, "http://h/")
        warc.plain_text(page)
        return time.process_time() - started

    for part in ("<a ", "<p ", "<title>", "<a href=", '<a href="', "<!--", "<script", "<style>", "</title ", "<"):
        once = min(seconds(part * 100_000) for _ in range(2))
        assert seconds(part * 400_000) < 10 * once + 0.5, part


def test_one_scan_of_odd_markup():
    page = warc.scanned("a<!-- <title>no</title> <a href=x> --><title>yes</title><title>later</title>b<a title=1 href='p?q=1&amp;r'>c</a><base href=/d/>")
    assert page.title == "yes" and page.links == ["p?q=1&amp;r"] and page.base == "/d/" and warc.plain_text(page) == "a bc"
    assert warc.outlinks(page, "http://h/") == ["http://h/d/p?q=1&r"]
    assert warc.plain_text("1 < 2 <3 <p>x<script>gone") == "1 < 2 <3\nx"
    assert warc.plain_text("&#" + "9" * 10_000 + ";&#" + "0" * 10_000 + "65;") == "�A"
    assert warc.plain_text("no end <b and more") == "no end <b and more" and warc.scanned("").pieces == [""]
