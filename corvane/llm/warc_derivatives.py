"""WARC derivative builder: metadata and plain-text conversion records of responses.

Input are whole WARC records as bytes.  Each response record gives one ``metadata``
record (application/warc-fields: status, source headers, digests, title, outlinks) and
one ``conversion`` record (the page's visible text as text/plain).  Both carry
``WARC-Refers-To`` the response's record id, its target URI and date, and digests of
their own blocks.  Their ids are derived from the response's id, so running a task
again gives the same records.

Defined results: a null or broken record, and records of other types, give nothing; a
response without a record id gets one from its digest; a payload in an unknown charset
is read as UTF-8 with replacement; empty payloads give an empty conversion; a compressed
payload is read to its last whole byte (all gzip members, deflate with or without its
wrapper, zstd) and at most ``MOST_BYTES`` of it, and one in a coding that can't be read
gives an empty conversion: both records say so in WARC-Truncated and the metadata in
``conversion-problem``; repeated records are converted each; an empty table gives an empty
table; extra columns are not carried.

``read_warc`` and ``write_warc`` read and write WARC files, each record a gzip member of its
own where they are compressed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import slices
from corvane.llm.html_layout import attributes, render

#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
CRLF = b"\r\n"
#: More of a payload is not unpacked: the standard's truncation by length.
MOST_BYTES = 1 << 28
_HREF = re.compile(r"<a\s[^>]*?href[^>]*>", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    return " ".join(value.split())


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF


def _header_list(head: bytes) -> list[tuple[str, str]]:
    """Headers in order, by lower-cased name; a repeated one stays as often as it comes."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif colon:
            out.append((name.strip().lower(), value.strip()))
    return out


def _headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _header_list(head):
        out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def parse_record(raw: bytes | None) -> tuple[dict[str, str], bytes] | None:
    """(headers by lower-cased name, block), or None if it is no whole WARC record."""
    if not raw or not raw.startswith(b"WARC/"):
        return None
    head, gap, rest = raw.partition(b"\r\n\r\n")
    headers = _headers(head)
    length = headers.get("content-length", "")
    if not gap or not length.isascii() or not length.isdigit() or len(rest) < int(length):
        return None
    return headers, rest[: int(length)]


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return b"".join(out)
        if n <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _inflated(data: bytes, wrapper: int, most: int) -> tuple[bytes, str]:
    """All members of zlib data, as far as they can be read, and what is wrong with them."""
    out, size = [], 0
    while data:
        member = zlib.decompressobj(wrapper)
        try:
            while data and not member.eof:
                part = member.decompress(data, min(1 << 20, most - size + 1))
                out.append(part)
                size += len(part)
                if size > most:
                    return b"".join(out)[:most], "longer than is unpacked"
                if not part and not member.unconsumed_tail:
                    break
                data = member.unconsumed_tail
        except zlib.error:
            # what follows a whole member and is none itself is padding
            return b"".join(out), "" if out and wrapper == 47 and not data.startswith(b"\x1f\x8b") else "broken"
        if not member.eof:
            return b"".join(out), "cut off"
        data = member.unused_data
    return b"".join(out), ""


def unpacked(body: bytes, coding: str, most: int | None = None) -> tuple[bytes, str]:
    """A payload without its content coding, and the problem where it is not all of it."""
    most = MOST_BYTES if most is None else most
    if coding in ("", "identity") or not body:
        return body, ""
    if coding in ("gzip", "x-gzip"):
        return _inflated(body, 47, most)
    if coding == "deflate":
        wrapped = _inflated(body, 15, most)
        return wrapped if wrapped[0] or not wrapped[1] else _inflated(body, -15, most)
    if coding == "zstd":
        import zstandard

        out, size = [], 0
        try:
            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True) as reader:
                while part := reader.read(min(1 << 20, most - size + 1)):
                    out.append(part)
                    size += len(part)
                    if size > most:
                        return b"".join(out)[:most], "longer than is unpacked"
        except zstandard.ZstdError:
            return b"".join(out), "broken"
        return b"".join(out), ""
    return b"", f"unknown content-encoding {coding}"


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes, str]:
    """(status, headers in order, payload as sent, payload decoded, problem)."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block, block, ""
    headers, found = _header_list(head), _headers(head)
    status = (head.split(CRLF)[0].decode("latin-1").split(" ", 2) + [""])[1]
    body, problem = _dechunked(payload) if "chunked" in found.get("transfer-encoding", "").lower() else payload, ""
    for coding in reversed([x.strip().lower() for x in found.get("content-encoding", "").split(",")]):
        body, problem = unpacked(body, coding) if not problem else (body, problem)
    return status, headers, payload, body, problem


def decoded(body: bytes, content_type: str) -> str:
    found = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I) or re.search(r"charset=[\"']?([\w.:-]+)", body[:1024].decode("latin-1"), re.I)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def _outlinks(html: str, base: str) -> list[str]:
    links = {}
    for m in _HREF.finditer(html):
        href = attributes(m[0][2:-1]).get("href", "").strip()
        if href and not href.startswith(("#", "javascript:", "mailto:", "data:")):
            try:
                links.setdefault(urljoin(base, href))
            except ValueError:
                continue
    return list(links)


def derive(raw: bytes | None) -> list[dict]:
    """The metadata and the conversion record of a response; [] for anything else."""
    found = parse_record(raw)
    if found is None or found[0].get("warc-type", "").lower() != "response":
        return []
    source, block = found
    status, http_list, payload, body, problem = parse_http(block)
    http = dict(reversed(http_list))  # of a repeated header the first counts
    payload_digest = source.get("warc-payload-digest") or digest(payload)
    block_digest = source.get("warc-block-digest") or digest(block)
    origin = source.get("warc-record-id") or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, block_digest)}>"
    uri, date = source.get("warc-target-uri", ""), source.get("warc-date", "")
    content_type = http.get("content-type", "")
    is_text = not content_type or any(x in content_type.lower() for x in ("html", "xml", "text/"))
    page = decoded(body, content_type) if is_text else ""
    is_html = "html" in content_type.lower() or not content_type or page.lstrip()[:1] == "<"
    title = _TITLE.search(page) if is_html else None
    fields = [("source-record-id", origin), ("source-status", status), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-payload-length", str(len(payload)))]
    fields += [(f"source-http-{k}", v) for k, v in http_list]
    fields += [(f"source-{k}", v) for k, v in source.items() if k in ("warc-ip-address", "warc-concurrent-to", "warc-truncated", "warc-identified-payload-type")]
    if problem:
        fields.append(("conversion-problem", problem))
    if title:
        fields.append(("title", _line(render(title[1]))))
    fields += [("outlink", x) for x in (_outlinks(page, uri) if is_html else ())]
    metadata = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode()
    text = (render(page) if is_html else page).encode()
    out = []
    for kind, mime, data in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text)):
        record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{origin} {uri} {payload_digest} {kind}')}>"
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", origin)]
        headers += [("WARC-Target-URI", uri)] * bool(uri) + [("WARC-Date", date)] * bool(date)
        headers += [("WARC-Truncated", "length" if problem.startswith("longer") else "unspecified")] * bool(problem)
        headers += [("WARC-Block-Digest", digest(data)), ("Content-Type", mime)]
        out.append({"warc_type": kind, "record_id": record_id, "refers_to": origin, "target_uri": uri or None, "warc_date": date or None, "source_payload_digest": payload_digest, "source_block_digest": block_digest, "block_digest": digest(data), "content_length": len(data), "record": write_record(headers, data)})
    return out


def response_record(url: str | None, html: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A page as a response record, for tables that hold pages and no records."""
    payload = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (url or '') + ' ' + digest(block))}>"
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id)] + [("WARC-Target-URI", url or "")] * bool(url)
    headers += [("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return write_record(headers, block)


_FIELDS = {"warc_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "warc_date": pa.string(), "source_payload_digest": pa.string(), "source_block_digest": pa.string(), "block_digest": pa.string(), "content_length": pa.int64(), "record": pa.binary()}
_DDL = ", ".join(f"{k} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for k, t in _FIELDS.items())


def derivatives(df: DataFrame, id_col: str, record_col: str = "record") -> DataFrame:
    """(id, warc_type, record_id, refers_to, ..., record) of every derived record."""
    source = df.select(F.col(id_col), F.col(record_col).alias("__record"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            ids, rows = [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r in derive(raw):
                    ids.append(i)
                    rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array([r[k] for r in rows], t) for k, t in _FIELDS.items())], [id_col, *_FIELDS])

    return source.mapInArrow(run, f"`{id_col}` {kind}, {_DDL}")


def responses(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record): pages as response records."""
    source = df.select(F.col(id_col), F.col(url_col).cast("string").alias("__url"), F.col(html_col).cast("string").alias("__html"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            raw = [response_record(u, h) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "record"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, record binary")


def split_records(data: bytes) -> list[tuple[int, int, bytes]]:
    """(offset, length in the file, record) of a WARC file, plain or of gzip members.

    What is no record, or only the beginning of one, is left out."""
    out, at = [], 0
    if data.startswith(b"\x1f\x8b"):
        while at < len(data):
            member = zlib.decompressobj(47)
            try:
                raw = member.decompress(memoryview(data)[at:])
            except zlib.error:
                break
            if not member.eof:
                break
            size = len(data) - at - len(member.unused_data)
            # a member may hold several records; they share its place
            out.extend((at, size, record) for _, _, record in split_records(raw) if not raw.startswith(b"\x1f\x8b"))
            at += size
        return out
    while (at := data.find(b"WARC/", at)) >= 0:
        gap = data.find(b"\r\n\r\n", at)
        length = _headers(data[at:gap]).get("content-length", "") if gap >= 0 else ""
        if not (length.isascii() and length.isdigit()):
            at += 5
            continue
        end = gap + 4 + int(length)
        if end > len(data):
            break
        out.append((at, min(end + 4, len(data)) - at, data[at:end] + CRLF + CRLF))
        at = end
    return out


def read_warc(spark, path: str) -> DataFrame:
    """(file, offset, length, record) of the records of WARC files; a file is one task's."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in slices(batches, 1):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split_records(data or b"")
                for lo in range(0, len(found), 100):
                    part = found[lo : lo + 100]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), *(pa.array([r[k] for r in part], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["file", "offset", "length", "record"])

    return files.mapInArrow(run, "file string, offset long, length long, record binary")


def write_warc(df: DataFrame, folder: str, record_col: str = "record") -> DataFrame:
    """Write records as gzip members, a file a partition; (file, offset, length) of each.

    A task writes under a name of its own and renames at the end, so one that is run
    again after a lost executor replaces its file as a whole.  Null records are left out."""
    from pyspark import TaskContext

    from corvane.llm._shared import staged
    from corvane.llm.token_files import _file_system, _rename

    def run(batches):
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        name, at, places = f"{root}/part-{part:06d}.warc.gz", 0, []
        with fs.open_output_stream(f"{name}.{own}", compression=None) as out:
            for batch in slices(batches):
                for raw in batch.column(0).to_pylist():
                    if raw is not None:
                        packed = gzip.compress(raw, mtime=0)
                        out.write(packed)
                        places.append((at, len(packed)))
                        at += len(packed)
        if not places:
            fs.delete_file(f"{name}.{own}")
            return
        _rename(fs, f"{name}.{own}", name)
        for lo in range(0, len(places), 10_000):
            some = places[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([a for a, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], ["file", "offset", "length"])

    return staged(df.select(F.col(record_col).alias("record")).mapInArrow(run, "file string, offset long, length long"), "warc_index")
