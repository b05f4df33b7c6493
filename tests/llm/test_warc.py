import hashlib
import io

import pytest

from lexiloom.llm import warc


def record(i, payload):
    return warc.record_bytes(str(i), f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None)


PAYLOADS = [b"a" * 10, b"", b"WARC/1.1 \x1f\x8b\x08" * 300, bytes(range(256)) * 9000]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.gzip_member(record(i, p)) if packed else record(i, p) for i, p in enumerate(PAYLOADS)]
    whole = b"".join(parts)
    assert [r[3].payload for r in warc.read_records(io.BytesIO(whole))] == PAYLOADS
    hurt = bytearray(whole)
    at = len(parts[0]) + len(parts[1]) // 2
    hurt[at : at + 6] = b"??????"
    got = list(warc.read_records(io.BytesIO(bytes(hurt))))
    assert [r[0] for r in got] == ["record", "gap", "record", "record"] and got[1][1:3] == (len(parts[0]), len(parts[1]))
    cut = list(warc.read_records(io.BytesIO(b"junk" + whole[:-5])))
    assert [r[0] for r in cut] == ["gap", "record", "record", "record", "gap"]
    assert sum(r[2] for r in cut) == len(whole) - 1  # every byte is in a record or a gap
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_write_and_read(spark):
    big = "é" * 600
    rows = [(1, "http://a/1", big, 0), (2, "http://a/2", big, 0), (9, "http://a 9\n", big, 0), (3, None, "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (None, "u", big, 0), (2, "http://a/2", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest_ int")
    got = warc.read(warc.write(pages), payloads=True).collect()
    assert all(r.kind == "record" for r in got)
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        revisit = i is not None and len(raw) >= 1000 and i < 9
        want.append((repr(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", repr(9 if revisit else None), None if revisit else raw))
    assert sorted((repr(r.row_id), r.payload_bytes, r.payload_digest, r.record_type, repr(r.refers_to), None if r.payload is None else bytes(r.payload)) for r in got) == sorted(want)
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    assert warc.read_back(warc.write(pages.limit(0))).count() == 0


def test_long_urls_and_lost_bytes(spark):
    pages = spark.createDataFrame([(1, "http://x/" + "q" * 100_000, "a"), (2, "data:" + "\n" * 70_000, "b" * 2000)], "page_id long, url string, html string")
    files = warc.write(pages)
    assert sorted(r.row_id for r in warc.read_back(files).collect()) == [1, 2]
    path = files.first().path.removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(30)
        f.write(b"????????")
    with pytest.raises(RuntimeError, match="1 quarantined gaps"):
        warc.read_back(files)


@pytest.mark.parametrize("packed", [True, False])
def test_headers_longer_than_the_first_look(packed):
    raw = warc.record_bytes("1", "http://x/" + "q" * 300_000, b"body", hashlib.sha1(b"body").hexdigest(), None)
    got = list(warc.read_records(io.BytesIO(warc.gzip_member(raw) if packed else raw)))
    assert [r[0] for r in got] == ["record"] and got[0][3].payload == b"body"
