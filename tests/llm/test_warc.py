import base64
import hashlib
import io

import pytest

from emberlog.llm.warc import arc_file, arc_records, archived, http_body, read_warc, warc_record, warc_records, write_warc

SCHEMA = "page_id bigint, url string, html string, first string, n int"
TRICKY = "a\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nb\nfiledesc://x 1 2 3 4\n"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(rows):
    data = [(i, f"http://h/{i} a", f"page {i % 5}", "x", i) for i in range(40)]
    data += [(100, None, None, None, None), (101, "u", "", None, None), (102, "u", TRICKY, None, None),
             (99, "u", TRICKY, None, None), (103, "http://h/é?q=1 2", "ß" * 100_000, None, None),
             (7, "http://h/7 a", "page 2", "x", 7), (None, "u", "alone", None, None)]
    got = archived(rows(data, SCHEMA)).collect()
    assert len(got) == len(data)
    first = {}
    for d in data:
        if d[0] is not None:
            first[d[2] or ""] = min(d[0], first.get(d[2] or "", d[0]))
    html = {d[0]: d[2] or "" for d in data}
    for r in got:
        text = html[r["page_id"]]
        to = first.get(text)
        revisit = r["page_id"] is not None and to < r["page_id"]
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (to if revisit else None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), digest(text))


def test_least_bytes_payloads_and_empty(spark, rows, tmp_path):
    df = rows([(1, "u", "short", None, 0), (2, "u", "short", None, 0), (3, "u", "long enough", None, 0), (4, "u", "long enough", None, 0)], SCHEMA)
    write_warc(df, f"file://{tmp_path}/w", least=6, records_per_file=2)
    got = {r["page_id"]: r for r in read_warc(spark, f"file://{tmp_path}/w", with_payload=True).collect()}
    assert [got[i]["refers_to"] for i in (1, 2, 3, 4)] == [None, None, None, 3]
    assert bytes(got[2]["payload"]) == b"short" and got[4]["payload"] is None
    assert archived(rows([], SCHEMA)).collect() == []


def test_header_lines_of_both_versions():
    body = b"HTTP/1.1 200 OK\r\n\r\n" + TRICKY.encode()
    for version in (1, 2):
        data = arc_file([("http://a/b c", "1.2.3.4", "20010203040506", "text/html", body), (None, "0.0.0.0", "20010203040506", "x/y", b"")], version)
        (one, block), (two, nothing) = arc_records(data)
        assert one["URL"] == "http://a/b%20c" and one["IP-address"] == "1.2.3.4" and block == body
        assert two["URL"] == "-" and nothing == b"" and ("Checksum" in one) == (version == 2)
        record = warc_record(one, block, 5)
        (head, payload), = warc_records(io.BytesIO(record))
        assert head["WARC-Date"] == "2001-02-03T04:05:06Z" and head["WARC-Type"] == "response"
        assert head["WARC-Payload-Digest"] == "sha1:" + digest(TRICKY) and http_body(payload) == TRICKY.encode()


def test_broken_archives_are_errors():
    data = arc_file([("u", "1.1.1.1", "20010203040506", "x/y", b"body")])
    with pytest.raises(ValueError):
        list(arc_records(data[:-3]))
    with pytest.raises(ValueError):
        list(warc_records(io.BytesIO(b"nonsense\r\n\r\n")))


def test_archives_are_read_as_streams(spark, rows, tmp_path):
    """No task asks for more than a buffer of an archive; payloads beyond a frame's size come whole."""
    class Slow(io.RawIOBase):
        """A stream that yields a few bytes at a time and remembers the largest read."""

        def __init__(self, path):
            self.file = open(path.removeprefix("file:"), "rb")

        def readable(self):
            return True

        def readinto(self, buffer):
            assert len(buffer) <= 1 << 20
            data = self.file.read(min(len(buffer), 7))
            buffer[:len(data)] = data
            return len(data)

    pages = rows([(i, f"http://h/{i}", f"{i}" * (3_000_000 if i < 4 else 10)) for i in range(40)],
                 "page_id bigint, url string, html string").coalesce(1)
    write_warc(pages, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in read_warc(spark, str(tmp_path / "w"), True, opener=Slow).collect()}
    assert len(got) == 40 and all(bytes(r["payload"]) == f"{i}".encode() * (3_000_000 if i < 4 else 10)
                                  for i, r in got.items())
