"""Derived records: links, digests, text, and the round trip through files."""

import gzip
import html
import json
import random
import re
import time
import zlib
from pathlib import Path

from voxward.llm import warc
from voxward.llm.warc import Record, derivatives, packed, plain_text, read_warc, response_record, responses, serialized, write_derivatives

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:y}</style><script>var t="</p>";</script></head>
<body><nav><a href="/one">One</a> <a class=x href='/two?a=1&amp;b=2'>Two</a></nav><!-- note --><p>First   line<br>second<p>1 &lt; 2</body></html>"""


def test_text_and_outline():
    assert plain_text(PAGE) == "One Two\nFirst line\nsecond\n1 < 2"
    assert warc.outline(PAGE) == {"title": "A & B", "links": ["/one", "/two?a=1&b=2"]}
    assert plain_text("") == "" and plain_text("no tags at all < 3") == "no tags at all < 3"
    assert warc.outline("<p>") == {"title": None, "links": []}


def test_records_refer_to_their_response():
    row = {"record_id": "<urn:uuid:x>", "target_uri": "http://h/\n1", "date": "2024-01-01T00:00:00Z", "head": "HTTP/1.1 200 OK\r\nX-A: b", "body": PAGE.encode()}
    source = response_record(row)
    metadata, conversion = derivatives(source)
    for record, kind in ((metadata, "metadata"), (conversion, "conversion")):
        h = record.headers
        assert (h["WARC-Type"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Date"]) == (kind, "<urn:uuid:x>", "http://h/ 1", row["date"])
        assert h["WARC-Payload-Digest"] == source.headers["WARC-Payload-Digest"] == warc.sha1(PAGE.encode())
        assert h["WARC-Block-Digest"] == warc.sha1(record.block)
    assert metadata.headers["WARC-Record-ID"] != conversion.headers["WARC-Record-ID"]
    facts = json.loads(metadata.block)
    assert facts["headers"] == [["X-A", "b"]] and facts["status"] == "HTTP/1.1 200 OK" and facts["payload_length"] == len(PAGE)
    assert conversion.block.decode() == plain_text(PAGE)
    assert derivatives(source) == (metadata, conversion)


def test_bytes_of_a_record(tmp_path):
    record = Record({"WARC-Type": "conversion"}, b"a\r\n\r\nb")
    assert gzip.decompress(packed(record)) == serialized(record) == b"WARC/1.1\r\nWARC-Type: conversion\r\nContent-Length: 6\r\n\r\na\r\n\r\nb\r\n\r\n"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(packed(record) * 3 + packed(Record({}, b"z" * 5_000_000)))
    with path.open("rb") as file:
        assert [len(r.block) for r in warc.records(file, 100)] == [6, 6, 6, 5_000_000]


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", PAGE.replace("First", f"First{i}"), "own") for i in range(40)]
    rows += [(50, None, "x", None), (51, "http://h", None, None), (52, "http://h", "", None), (None, "http://n", "n", None), (3, rows[3][1], rows[3][2], None), (60, "u", "<p>w" * 200_000, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_id string").repartition(3)
    made = responses(pages)
    manifest = write_derivatives(made, str(tmp_path / "out"))
    got = read_warc(manifest).collect()
    assert len(got) == 2 * len(rows) and all(r.digest_ok for r in got)
    by_source = {r.record_id: r for r in made.collect()}
    assert {r.refers_to for r in got} == set(by_source)
    for r in got:
        source = by_source[r.refers_to]
        assert r.target_uri == source.target_uri and r.payload_digest == warc.sha1(bytes(source.body)) and r.n_bytes == len(r.block)
        if r.kind == "conversion":
            assert bytes(r.block).decode() == plain_text(bytes(source.body).decode())
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(got)
    for entry in manifest.collect():
        # Members of the file itself are records, which any reader of such files can take one by one.
        data = Path(entry.path).read_bytes()
        assert entry.bytes == len(data) and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    none = write_derivatives(made.limit(0), str(tmp_path / "none"))
    assert none.count() == 0 and read_warc(none).count() == 0


def test_same_as_plain_patterns():
    """The scanners against the patterns they stand for, which take long on pages without ends."""
    dropped = re.compile(r"<!--.*?-->|<(script|style|head|noscript|template)\b.*?</\1\s*>", re.S | re.I)
    title = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
    link = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
    parts = ["<!--", "-->", "<script>", "</script >", "<HEAD>", "</head>", "<header>", "<a ", "<A x=1 ", "href=", "href = 'q'", 'href="v w"', ">", "<", "<p>", "</div>", "text", " ", "\n", "<title>", "</TITLE>", "'", '"', "<x y>", "<style", "İ", "&amp;"]
    rng = random.Random(8)
    for _ in range(4000):
        page = "".join(rng.choices(parts, k=rng.randrange(14)))
        text = html.unescape(warc._TAG.sub("", warc._BREAKS.sub("\n", dropped.sub(" ", page))))
        assert plain_text(page) == warc._LINES.sub("\n", warc._BLANKS.sub(" ", text)).strip(), page
        found = title.search(page)
        links = [html.unescape(next(v for v in m.groups() if v is not None)) for m in link.finditer(page)]
        assert warc.outline(page) == {"title": html.unescape(found.group(1)).strip() if found else None, "links": links}, page


def test_long_pages_without_ends():
    start = time.process_time()
    for unit in ("<!--", "<script>", "<a ", "<a href", "<p ", "<title>", "<title ", "<x ", '<a href="', "<!-- <script> <a ", "</script ", "&", "< ", "\n "):
        for tail in ("", ">", "<p>"):
            page = unit * (700_000 // len(unit)) + tail
            plain_text(page)
            warc.outline(page)
    assert time.process_time() - start < 60
    page = "<!--<script><a <p " * 600_000
    start = time.process_time()
    plain_text(page)
    warc.outline(page)
    assert time.process_time() - start < 10


def test_pages_are_read_by_their_headers():
    text = "<title>é</title><p>日本 ü"
    for head, body in (
        ([["Content-Type", "text/html; charset=shift_jis"]], text.replace("é", "e").replace("ü", "u").encode("shift_jis")),
        ([["content-type", 'text/html;charset="UTF-16"']], text.encode("utf-16")),
        ([["Content-Encoding", "gzip"]], gzip.compress(text.encode())),
        ([["Content-Encoding", "deflate"]], zlib.compress(text.encode())),
        ([["Content-Encoding", "gzip"], ["Content-Type", "text/html; charset=no-such"]], text.encode()),
        ([], text.encode()),
    ):
        assert warc.decoded(head, body) in (text, text.replace("é", "e").replace("ü", "u"))


def test_response_files_as_input(spark, tmp_path):
    rows = [{"record_id": f"<urn:uuid:{i}>", "target_uri": f"http://h/{i}", "date": "2024-01-01T00:00:00Z", "head": "HTTP/1.1 200 OK\r\nX-A: b", "body": f"{PAGE}{i}".encode()} for i in range(20)]
    for k in range(2):
        parts = [packed(Record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<w>"}, b"software: x"))]
        parts += [packed(response_record(r)) for r in rows[k::2]]
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(parts))
    files = spark.createDataFrame([(str(tmp_path / f"{k}.warc.gz"),) for k in range(2)], "path string")
    found = warc.read_responses(files)
    assert sorted(found.collect(), key=lambda r: int(r.record_id[10:-1])) == [tuple(r.values()) for r in rows]
    got = read_warc(write_derivatives(found, str(tmp_path / "out"))).collect()
    assert len(got) == 40 and {r.refers_to for r in got} == {r["record_id"] for r in rows} and all(r.target_uri and r.date == rows[0]["date"] for r in got)


def test_query_gives_each_page_its_two_records(spark, tmp_path):
    """Repeated pages, equal addresses with other pages, nulls, against the records made one by one."""
    from voxward.llm.queries import op7_warc_derivatives

    rows = [(1, "http://a", PAGE), (1, "http://a", PAGE), (1, "http://a", PAGE), (2, "http://a", PAGE), (1, "http://a", "other"), (None, None, None), (None, "u", ""), (3, None, "<p>x")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = op7_warc_derivatives(spark, str(tmp_path)).collect()
    want = []
    pages = spark.read.parquet(str(tmp_path / "pages.parquet"))
    for r in responses(pages).collect():
        for record in derivatives(response_record(r.asDict())):
            h = record.headers
            want.append((h["WARC-Refers-To"], r.page_id, h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Target-URI"), h["WARC-Date"], h["WARC-Payload-Digest"], h["WARC-Block-Digest"], len(record.block), True))
    assert len(got) == 2 * len(rows) and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
