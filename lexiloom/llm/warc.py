"""Operator 5: WARC archives, written and read back with salvage.

Writing: every row becomes one record, a gzip member of its own; each task writes one archive in the shared folder and names it in
a table, so that an archive left by a lost or repeated attempt is never read. Of rows with equal payloads of at least LEAST_REVISIT
bytes the one with the largest id is a response, the others are revisits that refer to it and hold no payload.

Reading: archives stream through a fixed buffer, compressed member by member or plain. A record counts if its version line,
headers, block length and block digest are right. After a failed check the reader looks for the next gzip member or version line
that starts a right record, goes on there, and logs the gap it passed over as quarantined bytes.

Defined results: a null payload is empty; an id of null is written as an empty id and never refers or is referred to; rows with the
same id and payload are the same record several times over, all of the class's type. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_dir, mapped, written

LEAST_REVISIT = 1000
VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
READ_BYTES = 1 << 20
#: Bytes of a plain record that are looked at first for the end of its headers; doubled until it is found.
FIRST_HEADER = 1 << 16
_NAME = "urn:lexiloom:row:"


@dataclass
class Record:
    kind: str
    row_id: str
    refers_to: str
    payload_bytes: int
    payload_digest: str  # lower-case hex SHA-1 of the full payload
    payload: bytes | None  # None for a revisit
    target: str = ""


def base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_bytes(row_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP headers, with the full length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_NAME}{row_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32(digest)}"]
    head += [f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Window:
    """A stream seen through a buffer that grows only while one record needs it."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.ended = stream, bytearray(), 0, False

    def need(self, n: int) -> bool:
        while len(self.held) < n and not self.ended:
            more = self.stream.read(max(READ_BYTES, n - len(self.held)))
            self.ended = not more
            self.held += more
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def _record(head: dict, block: bytes) -> Record:
    kind = head.get("warc-type", "")
    name = lambda k: head.get(k, "").strip("<>").removeprefix(_NAME)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    want = head.get("warc-payload-digest", "").removeprefix("sha1:")
    hexed = base64.b32decode(want).hex() if want else hashlib.sha1(payload).hexdigest()
    return Record(kind, name("warc-record-id"), name("warc-refers-to"), size, hexed, None if kind == "revisit" else payload, head.get("warc-target-uri", ""))


def _parse(window: _Window, member: bool):
    """The record at the window's start and its stored length; None where a check fails."""
    if member:
        z, raw, used = zlib.decompressobj(31), bytearray(), 0
        try:
            while not z.eof:
                if not window.need(used + 1):
                    return None
                piece = bytes(window.held[used : used + READ_BYTES])
                raw += z.decompress(piece)
                used += len(piece)
                if len(raw) >= len(VERSION) and not raw.startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        used -= len(z.unused_data)
        get, have = lambda a, b: bytes(raw[a:b]), lambda n: len(raw) >= n
        cut = raw.find(b"\r\n\r\n")
    else:
        size, used, cut, more = FIRST_HEADER, 0, -1, True
        while cut < 0 and more:
            more = window.need(size)
            cut = window.held.find(b"\r\n\r\n", 0, size)
            size *= 2
        get, have = lambda a, b: bytes(window.held[a:b]), window.need
    if cut < 0 or get(0, 7) != b"WARC/1.":
        return None
    try:
        lines = get(0, cut).decode("utf-8").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(head["content-length"])
        if length < 0:
            return None
    except (ValueError, KeyError):
        return None
    if not have(cut + 4 + length + 4) or get(cut + 4 + length, cut + 8 + length) != b"\r\n\r\n":
        return None
    block = get(cut + 4, cut + 4 + length)
    digest = head.get("warc-block-digest", "")
    if digest and digest.removeprefix("sha1:") != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return None
    if member and len(raw) != cut + 8 + length:
        return None
    try:
        return _record(head, block), (used if member else cut + 8 + length)
    except ValueError:
        return None


def read_records(stream) -> Iterator[tuple[str, int, int, Record | None]]:
    """('record', offset, length, Record) for every right record, ('gap', offset, length, None) for every run of bytes that
    belongs to none."""
    window, gap = _Window(stream), None
    while window.need(1):
        found = None
        if window.need(3) and window.held[:3] == MEMBER:
            found = _parse(window, member=True)
        elif window.need(7) and window.held[:7] == b"WARC/1.":
            found = _parse(window, member=False)
        if found:
            if gap is not None:
                yield "gap", gap, window.at - gap, None
                gap = None
            record, used = found
            yield "record", window.at, used, record
            window.drop(used)
            continue
        if gap is None:
            gap = window.at
        starts = [k for k in (window.held.find(MEMBER, 1), window.held.find(b"WARC/1.", 1)) if k > 0]
        window.drop(min(starts) if starts else max(1, len(window.held) - 6))
    if gap is not None:
        yield "gap", gap, window.at - gap, None


def _store(path: str):
    """The file system of a URI, as tasks see it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes the archives; returns a table of them: path, records, bytes."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url_"), payload.alias("payload_"))
    rows = rows.withColumn("digest_", F.sha1("payload_"))
    keys = written(rows.select("id", "digest_", F.octet_length("payload_").alias("size_")), "payload_keys").where(F.col("size_") >= least)
    top = keys.groupBy("digest_").agg(F.max("id").alias("top_"), F.min("id").alias("low_")).where("top_ > low_").drop("low_")
    refers = keys.join(top, "digest_").where("id < top_").select("id", "digest_", "top_").distinct()
    rows = rows.join(refers, ["id", "digest_"], "left")
    folder = fresh_dir(pages.sparkSession, "warc")

    def run(batches):
        import pyarrow as pa

        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        path, out, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            out = out or store.open_output_stream(path, compression=None)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "url_", "payload_", "digest_", "top_")]
            for row_id, url, body, digest, top_id in zip(*(c.to_pylist() for c in cols)):
                raw = gzip_member(record_bytes("" if row_id is None else str(row_id), url, body, digest, None if top_id is None else str(top_id)))
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [folder + path[len(base) :]], "records": [n], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(mapped(rows, run, "path string, records long, bytes long"), "warc_files")


_READ = "path string, kind string, offset long, length long, row_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(files: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the archives that files names (column path), and the quarantined gaps: kind is record or gap."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("row_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        number = lambda x: int(x) if x.lstrip("-").isdigit() else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _store(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for kind, offset, length, r in read_records(stream):
                        row = (path, kind, offset, length) + ((None,) * 6 if r is None else (number(r.row_id), r.kind, number(r.refers_to), r.payload_bytes, r.payload_digest, r.payload if payloads else None))
                        rows.append(row)
                        held += len(r.payload or b"") if r and payloads else 0
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows], schema=schema)

    spread = files.select("path").repartition(max(2, files.count()), "path")
    return mapped(spread, run, _READ)


def read_back(files: DataFrame) -> DataFrame:
    """The records of archives that write has just written. Gaps among them mean lost rows: their table stays in the shared folder,
    and they are an error, as is a number of records other than was written."""
    rows = written(read(files), "warc_rows")
    records = rows.where("kind = 'record'")
    gaps, found = rows.where("kind = 'gap'").count(), records.count()
    want = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if gaps or found != want:
        raise RuntimeError(f"{gaps} quarantined gaps and {found} of {want} records, listed in {rows.inputFiles()[0].rpartition('/')[0]}")
    return records
