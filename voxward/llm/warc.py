"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response record becomes a metadata record (JSON of its HTTP headers, title and
links) and a conversion record (its text). Both refer to the response by its
identifier, keep its target, date and payload digest, and have identifiers of
their own that follow from the response's, so a repeated run makes the same
files. Records are gzip members, so each can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxward.llm.tables import stored

VERSION = "WARC/1.1"
#: Name space of derived record identifiers.
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_GZIP, _LEVEL = 31, 1

_OPENS = re.compile(r"<!--|<(script|style|head|noscript|template)\b", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "head", "noscript", "template", "title")}
_ENDS["--"] = re.compile("-->")
_BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|blockquote|pre)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b", re.I)
_ANCHOR = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


@dataclass
class Record:
    """A WARC record: its headers in order, and its block."""

    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """An identifier that follows from the parts."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


def serialized(record: Record) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in record.headers.items())
    return f"{VERSION}\r\n{head}Content-Length: {len(record.block)}\r\n\r\n".encode() + record.block + b"\r\n\r\n"


def packed(record: Record) -> bytes:
    """A record as one gzip member."""
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
    return packer.compress(serialized(record)) + packer.flush()


def parsed(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return Record(headers, rest[: int(headers.pop("Content-Length"))])


def records(file: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[Record]:
    """The records of an open file of gzip members; one record is held at a time."""
    data = file.read(chunk)
    while data:
        unpacker, parts = zlib.decompressobj(_GZIP), []
        while not unpacker.eof:
            if not data and not (data := file.read(chunk)):
                raise ValueError("the file ends inside a record")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
        yield parsed(b"".join(parts))
        data = data or file.read(chunk)


def _without_dropped(page: str) -> str:
    """The page with a blank for each comment, script, style, template and head. An end that is missing is looked for once."""
    kept, at, missing = [], 0, set()
    for opened in _OPENS.finditer(page):
        name = (opened.group(1) or "--").lower()
        if opened.start() < at or name in missing:
            continue
        end = _ENDS[name].search(page, opened.end())
        if end is None:
            missing.add(name)
            continue
        kept += page[at : opened.start()], " "
        at = end.end()
    return "".join([*kept, page[at:]])


def _replaced(pattern: re.Pattern, by: str, text: str) -> str:
    """Tags replaced; behind the last ``>`` there are none, and before it each ends, so a text is passed over once."""
    cut = text.rfind(">") + 1
    return pattern.sub(by, text[:cut]) + text[cut:]


def plain_text(page: str) -> str:
    """The text of an HTML page: without scripts, styles and head, a line for each block."""
    text = html.unescape(_replaced(_TAG, "", _replaced(_BREAKS, "\n", _without_dropped(page))))
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip()


def _title(page: str) -> str | None:
    """What the first title element holds; if that has no end, no later one has."""
    opened = _TITLE.search(page)
    inside = page.find(">", opened.end()) + 1 if opened else 0
    end = _ENDS["title"].search(page, inside) if inside else None
    return html.unescape(page[inside : end.start()]).strip() if end else None


def _links(page: str) -> Iterator[str]:
    """Addresses of the anchors. The next one found is remembered, so tags that have none are not searched again and again."""
    at, href = 0, None
    while opened := _ANCHOR.search(page, at):
        end = page.find(">", opened.end())
        end = len(page) if end < 0 else end
        if href is None or href.start() < opened.end():
            href = _HREF.search(page, opened.end())
            if href is None:
                return
        if href.start() < end:
            yield html.unescape(next(v for v in href.groups() if v is not None))
            at = href.end()
        else:
            at = end


def outline(page: str) -> dict:
    """Title and links of an HTML page, in order."""
    return {"title": _title(page), "links": list(_links(page))}


def decoded(headers: list[list[str]], body: bytes) -> str:
    """The page of a response, by the encodings its headers name; what can't be unpacked or read so is taken as it is, as UTF-8."""
    named = {k.lower(): v for k, v in headers}
    coding = named.get("content-encoding", "").strip().lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        # 32 takes both gzip and zlib heads.
        for window in (32 + zlib.MAX_WBITS, -zlib.MAX_WBITS):
            try:
                body = zlib.decompressobj(window).decompress(body)
                break
            except zlib.error:
                continue
    charset = _CHARSET.search(named.get("content-type", ""))
    try:
        return body.decode(charset.group(1) if charset else "utf-8", errors="replace")
    except (LookupError, UnicodeError):
        return body.decode(errors="replace")


def derivatives(response: Record) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response record."""
    source = response.headers["WARC-Record-ID"]
    head, _, body = response.block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    sent = [line.split(": ", 1) for line in lines[1:] if ": " in line]
    page = decoded(sent, body)
    kept = {k: response.headers[k] for k in ("WARC-Target-URI", "WARC-Date") if k in response.headers}
    payload = response.headers.get("WARC-Payload-Digest") or sha1(body)
    facts = {
        "status": lines[0],
        "headers": sent,
        "payload_digest": payload,
        "payload_length": len(body),
        **outline(page),
    }
    made = []
    for kind, content, block in (
        ("metadata", "application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True).encode(errors="replace")),
        ("conversion", "text/plain", plain_text(page).encode(errors="replace")),
    ):
        headers = {
            "WARC-Type": kind,
            "WARC-Record-ID": record_id(source, kind),
            "WARC-Refers-To": source,
            **kept,
            "WARC-Payload-Digest": payload,
            "WARC-Block-Digest": sha1(block),
            "Content-Type": content,
        }
        made.append(Record(headers, block))
    return made[0], made[1]


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", http_head: Column | None = None) -> DataFrame:
    """Raw pages (``page_id, url, html``) as rows ``record_id, target_uri, date, head, body``.

    Identifiers follow from ``page_id`` and ``url``; a null page is empty, a null
    address stays null. ``http_head`` are status line and headers. Repeated rows
    have one identifier and stay as many rows.
    """
    head = http_head if http_head is not None else F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8")
    key = F.sha1(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit(""))))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    named = F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-a"), parts[3], F.lit("-"), parts[4], F.lit(">"))
    return pages.select(
        "page_id", named.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("head"),
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("body"),
    )


def response_record(row: dict) -> Record:
    block = row["head"].encode("latin-1", errors="replace") + b"\r\n\r\n" + bytes(row["body"])
    headers = {"WARC-Type": "response", "WARC-Record-ID": row["record_id"]}
    if row["target_uri"] is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", row["target_uri"])
    headers |= {
        "WARC-Date": row["date"],
        "WARC-Payload-Digest": sha1(bytes(row["body"])),
        "Content-Type": "application/http; msgtype=response",
    }
    return Record(headers, block)


def write_derivatives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the derivatives of response rows to ``folder``; returns the stored manifest ``path, kind, n_records, bytes``.

    Each task writes one metadata and one conversion file under a name of its
    own attempt, record by record, and the manifest lists those that counted.
    ``folder`` must be reachable by all executors. Repeated rows make repeated
    records; an empty table gives an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        kinds = ("metadata", "conversion")
        paths = [f"{name}.{kind}.warc.gz" for kind in kinds]
        fs, _ = FileSystem.from_uri(folder)
        places = [FileSystem.from_uri(path)[1] for path in paths]
        fs.create_dir(places[0].rsplit("/", 1)[0])
        # Records are compressed one by one, so the stream must not do it again.
        files, n, size = [fs.open_output_stream(place, compression=None) for place in places], 0, [0, 0]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    for k, record in enumerate(derivatives(response_record(row))):
                        data = packed(record)
                        files[k].write(data)
                        size[k] += len(data)
                    n += 1
        for file, place in zip(files, places, strict=True):
            file.close()
            if not n:
                fs.delete_file(place)
        if n:
            yield pa.RecordBatch.from_pydict({"path": paths, "kind": list(kinds), "n_records": [n, n], "bytes": size})

    shape = "path string, kind string, n_records bigint, bytes bigint"
    return stored(rows.select("record_id", "target_uri", "date", "head", "body").mapInArrow(run, shape), "warc")


def read_warc(files: DataFrame, keep_block: bool = True) -> DataFrame:
    """The records of all files (column ``path``): identifiers, headers, digest check and block.

    ``digest_ok`` tells whether the block has the digest its header names. A
    task reads whole files, one record at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = FileSystem.from_uri(path)
                with fs.open_input_stream(place, compression=None) as file:
                    rows = []
                    for record in records(file):
                        h = record.headers
                        rows.append((
                            h.get("WARC-Type"), h.get("WARC-Record-ID"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Date"),
                            h.get("WARC-Payload-Digest"), h.get("WARC-Block-Digest"), len(record.block),
                            h.get("WARC-Block-Digest") in (None, sha1(record.block)), record.block,
                        )[: len(names)])
                        if len(rows) == 256:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    texts = ["kind", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest"]
    names = [*texts, "n_bytes", "digest_ok"] + ["block"] * keep_block
    types = [pa.string()] * len(texts) + [pa.int64(), pa.bool_()] + [pa.binary()] * keep_block
    shape = ", ".join(f"{c} string" for c in texts) + ", n_bytes bigint, digest_ok boolean" + ", block binary" * keep_block
    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, shape)


def read_responses(files: DataFrame) -> DataFrame:
    """The response records of WARC files (column ``path``) as rows for ``write_derivatives``.

    Identifier, address and date are those of the record; the block is cut into the head of the answer and its body. A
    block without a head is all body. Records of other kinds are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                head, found, body = row.pop("block").partition(b"\r\n\r\n")
                rows.append(row | {"head": head.decode("latin-1") if found else "", "body": body if found else head})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    names = ("record_id", "target_uri", "date", "head")
    shape = pa.schema([*((n, pa.string()) for n in names), ("body", pa.binary())])
    found = read_warc(files).where("kind = 'response'").select("record_id", "target_uri", "date", "block")
    return found.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", body binary")
