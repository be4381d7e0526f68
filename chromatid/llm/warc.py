"""WARC derivatives: every response record gives a metadata record and a plain-text conversion record that refer to it.

Both keep the response's target address, date, HTTP headers (the metadata record as JSON) and payload digest, name it in
WARC-Refers-To, and have a block digest of their own. Record ids are name-based UUIDs of the response's id, so reruns agree.

Each response is turned on its own: no shuffle, whatever their sizes. Null body: empty; null address, date or headers: left out;
repeated responses give repeated records; an empty table gives an empty result; extra columns are ignored.

From WARC files, payloads stay bytes and digests are the source's own (or else made from these bytes). Text is decoded by the HTTP headers only for the
records' contents; payloads that aren't text, or are in an encoding unknown here (as br), have none. Files are read by Spark's readers line by
line and records put together as they come: a task holds a record and a batch of lines, not a file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromatid.llm.common import only
from chromatid.llm.html_extract import page_text

_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LINK = re.compile(r"<(a|link|img|script|iframe|form|area|source)\b([^>]*)>", re.I)
_TARGET = re.compile(r"\b(href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_RECORD = (
    "source_id string, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string,"
    " source_headers string, source_digest string, block_digest string, content_length long, block string"
)


def digest(data: bytes) -> str:
    """A labelled SHA-1 in base 32, as WARC files have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def links(page: str) -> list[dict[str, str]]:
    out = []
    for m in _LINK.finditer(_COMMENT.sub("", page)):
        for t in _TARGET.finditer(m[2]):
            out.append({"path": f"{m[1].upper()}@/{t[1].lower()}", "url": entities.unescape(t[2] or t[3] or t[4] or "")})
    return out


def _lines(raw: str) -> list[tuple[str, str]]:
    """(name, value) of header lines behind the first line, in order; lines that begin with white space continue the one before."""
    unfolded = re.sub(r"\r?\n[ \t]+", " ", raw)
    pairs = (line.partition(":") for line in re.split(r"\r?\n", unfolded)[1:] if ":" in line)
    return [(k.strip(), v.strip()) for k, _, v in pairs]


def _headers(raw: str) -> dict[str, str | list[str]]:
    """Values by name; a list where a name comes several times."""
    out: dict[str, str | list[str]] = {}
    for k, v in _lines(raw):
        known = out.get(k)
        out[k] = v if known is None else [*known, v] if isinstance(known, list) else [known, v]
    return out


def _value(headers: dict[str, str | list[str]], name: str) -> str | None:
    """The first value of a name in any case."""
    v = next((x for k, x in headers.items() if k.lower() == name.lower()), None)
    return v[0] if isinstance(v, list) else v


def derive(
    record_id: str, uri: str | None, date: str | None, http: str | None, body: str | None, payload: str | None = None, source_block: str | None = None
) -> list[tuple]:
    """The two records of one response, in _RECORD's order without source_id. payload: its digest, made from body if it isn't known; source_block: its block's, if known."""
    page, http = body or "", http or ""
    payload = payload or digest(page.encode("utf-8", "replace"))
    title = _TITLE.search(page)
    meta = {
        "Envelope": {
            "WARC-Header-Metadata": {k: v for k, v in (("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", source_block)) if v},
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Status": http.split("\r\n")[0],
                    "Headers": _headers(http),
                    "HTML-Metadata": {"Title": " ".join(entities.unescape(title[1]).split()) if title else "", "Links": links(page)},
                }
            },
        }
    }
    out = []
    for kind, content_type, block in (
        ("metadata", "application/json", json.dumps(meta, ensure_ascii=False, separators=(",", ":"))),
        ("conversion", "text/plain", page_text(page)),
    ):
        data = block.encode("utf-8", "replace")
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{kind}')}>"
        out.append((kind, name, record_id, uri, date, content_type, http, payload, digest(data), len(data), block))
    return out


def _derive_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = re.findall(r"(\w+) (?:string|long)", _RECORD)
    for pdf in batches:
        for k in range(0, len(pdf), 256):
            rows = [
                (r.source_id, *x)
                for r in pdf.iloc[k : k + 256].itertuples(index=False)
                for x in derive(r.record_id, r.target_uri, r.warc_date, r.http_headers, r.body, getattr(r, "payload_digest", None), getattr(r, "source_block_digest", None))
            ]
            yield pd.DataFrame(rows, columns=names)


def derivatives(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of responses (source_id, record_id, target_uri, warc_date, http_headers, body, and payload_digest and source_block_digest if there), all strings."""
    known = [c for c in responses.columns if c in ("payload_digest", "source_block_digest")]
    return only(responses, "source_id", "record_id", "target_uri", "warc_date", "http_headers", "body", *known).mapInPandas(_derive_all, _RECORD)


def responses_of_pages(pages: DataFrame, warc_date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages (page_id, url, html); their ids are made from page_id and url."""
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    urn = F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">")
    )
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n"))
    return only(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("string").alias("source_id"), urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(warc_date).alias("warc_date"),
        http.alias("http_headers"), F.col("html").alias("body"),
    )


def serialize(r: dict) -> bytes:
    """One record as a gzip member of a WARC file. The source's payload digest and HTTP headers are fields of their own names."""
    data = r["block"].encode("utf-8", "replace")
    fields = (
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]),
        ("WARC-Date", r["warc_date"]), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Source-Payload-Digest", r.get("source_digest")),
        *(("WARC-Source-Header", f"{k}: {v}") for k, v in _lines(r.get("source_headers") or "")), ("Content-Type", r["content_type"]), ("Content-Length", str(len(data))),
    )
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + "\r\n"
    return gzip.compress(head.encode() + data + b"\r\n\r\n", mtime=0)


def write_members(records: DataFrame, path: str) -> None:
    """Writes records as gzip members in Parquet (record_id, member), by Spark's committers: members laid end to end are a WARC file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"record_id": pdf["record_id"], "member": [serialize(r) for r in pdf.to_dict("records")]})

    records.mapInPandas(run, "record_id string, member binary").write.parquet(path)


#: Bytes that are unpacked at once.
_PIECE = 1 << 22


def gunzip(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of gzip members laid end to end, or plain chunks as they are."""
    first = b""
    while len(first) < 2 and (piece := next(chunks, None)) is not None:
        first += piece
    if first[:2] != b"\x1f\x8b":
        yield from itertools.chain([first], chunks)
        return
    member, over = zlib.decompressobj(31), b""
    for chunk in itertools.chain([first], chunks):
        data = over + chunk
        over = b""
        while data:
            if member.eof:
                if len(data) < 2:  # may be half of a member's first bytes
                    over = data
                    break
                if data[:2] != b"\x1f\x8b":
                    return
                member = zlib.decompressobj(31)
            yield (out := member.decompress(data, _PIECE))
            while not member.eof and len(out) == _PIECE:
                yield (out := member.decompress(member.unconsumed_tail, _PIECE))
            data = member.unused_data


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str | list[str]], bytes]]:
    """(headers, block) of the records of a WARC file that comes in pieces, gzip members or plain; one record is held at a time."""
    data, rest = bytearray(), gunzip(iter(chunks))

    def more() -> bool:
        piece = next(rest, None)
        data.extend(piece or b"")
        return piece is not None

    while True:
        while (at := data.find(b"WARC/")) < 0:
            del data[:-4]
            if not more():
                return
        del data[:at]
        start = 0
        while (end := data.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(data) - 3)
            if not more():
                return
        head = _headers(data[:end].decode("utf-8", "replace"))
        stop = end + 4 + int(_value(head, "Content-Length") or 0)
        while len(data) < stop and more():
            pass
        yield head, bytes(data[end + 4 : stop])
        del data[:stop]


def parse(data: bytes) -> list[dict[str, str | list[str]]]:
    """Records of a WARC file, gzip members or plain: their headers, and the block under ``block``."""
    return [head | {"block": block.decode("utf-8", "replace")} for head, block in records(iter([data]))]


def _unchunked(data: bytes) -> bytes:
    """The contents of HTTP's chunks; data as it is where they don't fit."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            n = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data
        if n == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return data


def decoded(http: str, payload: bytes) -> str:
    """The text of a payload by its HTTP headers: chunks, compression and charset (or the page's own, or UTF-8, or else Windows-1252)."""
    head = {k.lower(): ", ".join(v) if isinstance(v, list) else v for k, v in _headers(http).items()}
    kind = head.get("content-type", "").lower()
    if kind and not re.match(r"\s*(text/|[\w.+-]+/[\w.+-]*(xml|html|json|javascript))", kind):
        return ""
    if "chunked" in head.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    for coding in reversed([x.strip() for x in head.get("content-encoding", "").lower().split(",")]):
        if coding in ("gzip", "x-gzip"):
            if payload[:2] == b"\x1f\x8b":  # crawlers may keep the header of what they have unpacked
                try:
                    payload = b"".join(gunzip(iter([payload])))
                except zlib.error:
                    return ""
        elif coding == "deflate":
            for bits in (15, -15):
                try:
                    payload = zlib.decompressobj(bits).decompress(payload)
                    break
                except zlib.error:
                    pass
        elif coding not in ("", "identity"):
            return ""
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind)
    own = re.search(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]+)|<\?xml[^>]{0,100}?encoding\s*=\s*[\"']([\w.:-]+)", payload[:2048], re.I)
    if payload[:3] == b"\xef\xbb\xbf":
        return payload[3:].decode("utf-8", "replace")
    if payload[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return payload.decode("utf-16", "replace")
    for charset in (named and named[1], own and (own[1] or own[2]).decode("ascii", "replace")):
        if charset:
            try:
                return payload.decode(charset, "replace")
            except (LookupError, UnicodeError):  # unknown here, or not a charset
                pass
    try:
        return payload.decode("utf-8")
    except UnicodeDecodeError:
        return payload.decode("cp1252", "replace")


#: Rows and bytes of payloads that read_responses() hands over at once.
_ROWS, _BYTES = 256, 1 << 24
_RESPONSE = (
    "source_id string, record_id string, target_uri string, warc_date string, http_headers string, body string, payload binary, payload_digest string,"
    " source_block_digest string"
)


def _responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = re.findall(r"(\w+) (?:string|binary)", _RESPONSE)
    pieces = ((file, b"\n".join([*part["line"], b""])) for pdf in batches for file, part in pdf.groupby("file", sort=False))
    rows, size = [], 0
    for _, own in itertools.groupby(pieces, key=lambda x: x[0]):
        for head, block in records(x[1] for x in own):
            if _value(head, "WARC-Type") != "response":
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            http = http.decode("utf-8", "replace")
            key, uri, date, own, of_block = (_value(head, f"WARC-{x}") for x in ("Record-ID", "Target-URI", "Date", "Payload-Digest", "Block-Digest"))
            rows.append((key, key, uri, date, http, decoded(http, payload), payload, own or digest(payload), of_block))
            size += len(payload)
            if len(rows) >= _ROWS or size >= _BYTES:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files at path, as derivatives() takes them, with the payload as it came.

    A task streams a .gz file, which can't be split; other files' lines are sorted back to their order, which spills if it must.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    whole = F.lower("file").endswith(".gz")
    split = lines.where(~whole).withColumn("k", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "start", "k")
    return lines.where(whole).select("line", "file").mapInPandas(_responses, _RESPONSE).union(split.select("line", "file").mapInPandas(_responses, _RESPONSE))
