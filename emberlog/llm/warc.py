"""Legacy web archives (ARC) turned into WARC files, and WARC files read back.

An ARC file is a version block that states its version and the names of its header fields, followed by
records: one header line, then as many bytes as the line declares. `convert` parses header lines by the
version in force and synthesises what WARC has and ARC lacks: record identifiers, timestamps, types and
digests. Files are written by Spark's text writer, one record per row ended by the record's own last line
break, gzip-compressed, and read back by declared lengths, never by searching for separators.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm.common import new_path, only, saved
from emberlog.session import ship
from emberlog.sources.files import open_uri

#: The fields of ARC header lines by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location",
        "Offset", "Filename", "Archive-length"),
}
#: Fixed value: the media type of archived HTTP responses.
HTTP_RESPONSE = "application/http; msgtype=response"
#: Fixed value: the profile of revisits of an identical payload.
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def arc_file(records: list[tuple], version: int = 1, name: str = "pages.arc", date: str = "20200101000000"
             ) -> bytes:
    """An ARC file of (url, ip, date, content type, body) records."""
    fields = " ".join(ARC_FIELDS[version])
    head = f"{version} 0 emberlog\n{fields}\n".encode()
    kind = ["text/plain"] + ([] if version == 1 else ["200", "-", "-", "0", name])
    out = [f"filedesc://{name} 0.0.0.0 {date} {' '.join(kind)} {len(head)}\n".encode(), head, b"\n"]
    at = sum(map(len, out))
    for url, ip, when, media, body in records:
        more = [] if version == 1 else ["200", base32_sha1(body), "-", str(at), name]
        line = " ".join([quote(url or "-", safe="%/:?#[]@!$&'()*+,;=~"), ip, when, media, *more, str(len(body))])
        part = line.encode() + b"\n" + body + b"\n"
        out.append(part)
        at += len(part)
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of every record; the version block states which fields there are.

    Field names come from the block's own line where it has as many as the header line, else from the
    version. Values are cut from both ends of the line, so a URL may hold spaces.
    """
    at, fields = 0, ARC_FIELDS[1]
    while at < len(data):
        if data[at:at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        length = int(line.rsplit(" ", 1)[1])
        body = data[end + 1:end + 1 + length]
        if len(body) < length:
            raise ValueError(f"an ARC record declares {length} bytes and has {len(body)}")
        at = end + 1 + length
        if line.startswith("filedesc:"):
            lines = body.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0])
            named = tuple(lines[1].split()) if len(lines) > 1 else ()
            fields = named if named[-1:] == ("Archive-length",) else ARC_FIELDS[version]
            continue
        values = line.rsplit(" ", len(fields) - 1)
        yield dict(zip(fields, values)), body


def http_body(block: bytes) -> bytes:
    """What follows the HTTP header of a response; a block without one is all payload."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    return body


def record_id(*parts) -> str:
    """The same URN for the same parts in every run, so a task that runs again writes the same record."""
    return uuid.uuid5(uuid.NAMESPACE_URL, "\x1f".join(map(str, parts))).urn


def warc_record(fields: dict[str, str], block: bytes, key: int | None, refers_to: int | None = None
                ) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit of the record of page `refers_to`."""
    payload = http_body(block)
    digest = base32_sha1(payload)
    when = datetime.strptime(fields["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{record_id(key, digest)}>",
        "WARC-Date": when,
        "WARC-Target-URI": fields["URL"],
        "WARC-IP-Address": fields["IP-address"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": HTTP_RESPONSE,
        "X-Page-Id": "" if key is None else str(key),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        block = block[:len(block) - len(payload)]
        head |= {"WARC-Profile": IDENTICAL, "WARC-Truncated": "length",
                 "WARC-Refers-To": f"<{record_id(refers_to, digest)}>", "X-Refers-To-Page": str(refers_to)}
    head |= {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed WARC stream, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = value.strip()
        length = int(head["Content-Length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"a WARC record declares {length} bytes and has {len(block)}")
        yield head, block


def write_warc(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html",
               least: int = 0, date: str = "20200101000000", ip: str = "0.0.0.0",
               records_per_file: int = 10_000, frequent: int = 1000) -> None:
    """Pages as a legacy archive, converted to WARC files under `path`.

    Each page becomes an ARC record with an HTTP header (versions 1 and 2 in turn); `convert` then makes
    WARC of it. Of equal payloads of at least `least` bytes the page with the smallest id is written as
    response and the others as revisits of it; repeated rows of that page repeat the response. Pages
    without an id are responses that nothing refers to. Null html is empty.
    """
    ship(pages.sparkSession)
    rows = only(pages, id, url, html).toDF("page_id", "url", "html").withColumn(
        "html", F.coalesce("html", F.lit(""))).withColumn("sha", F.sha2(F.col("html"), 256))
    # counted before anything moves: one narrow row per payload and task
    repeats = saved(rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeats")
    # payloads with many pages are told apart where they are; no other has many rows to gather
    often = saved(repeats.orderBy(F.desc("n"), "sha").limit(frequent), "frequent")
    seldom = repeats.join(F.broadcast(often.select("sha")), "sha", "left_anti").select(
        F.col("sha").alias("key"), F.col("first").alias("second"))
    known = rows.join(F.broadcast(often.select("sha", "first")), "sha", "left").withColumn("key", F.when(
        F.col("first").isNull(), F.col("sha")).otherwise(F.concat(F.lit("#"), F.coalesce("page_id", F.lit(0)))))
    told = known.join(seldom, "key", "left").select("page_id", "url", "html", F.coalesce(
        "first", "second").alias("first")).withColumn("first", F.when(F.col("first") < F.col("page_id"), F.col("first")))

    def legacy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        for batch in batches:
            out = []
            for version in (1, 2):
                some = [r for n, r in enumerate(zip(batch["page_id"], batch["url"], batch["html"],
                                                    batch["first"])) if n % 2 == version - 1]
                data = arc_file([(u, ip, date, "text/html", head + h.encode("utf-8", "surrogatepass"))
                                 for _, u, h, _ in some], version)
                out += convert(data, [r[0] for r in some], [r[3] for r in some])
            yield pd.DataFrame({"value": out})

    ids = told.withColumn("page_id", F.col("page_id").cast("string")).withColumn(
        "first", F.col("first").cast("string"))
    ids.mapInPandas(legacy, "value string").write.option("lineSep", "\n").option(
        "compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def convert(data: bytes, keys: list, refers_to: list) -> list[str]:
    """An ARC file as WARC records, each without its last line break, which the writer adds."""
    number = lambda x: None if x is None or x != x else int(x)
    return [warc_record(fields, block, number(key), number(first))[:-1].decode("utf-8", "surrogatepass")
            for (fields, block), key, first in zip(arc_records(data), keys, refers_to, strict=True)]


def read_warc(spark: SparkSession, path: str, with_payload: bool = False,
              opener: Callable[[str], BinaryIO] = open_uri) -> DataFrame:
    """Records of the WARC files under a path: page_id, url, record_id, date, record_type, payload_bytes,
    payload_digest, refers_to, and the payload if wanted (null for revisits).

    Digests and lengths of responses are those of the bytes read; revisits state those of their payload.
    A response whose bytes don't match its stated digest raises an error. Archives may have any size: a task
    reads them as streams, one record after the other; `opener` opens a path on the executors. A folder
    without records gives no rows.
    """
    ship(spark)
    schema = ("page_id bigint, url string, record_id string, date string, record_type string, "
              "payload_bytes bigint, payload_digest string, refers_to bigint")
    schema += ", payload binary" if with_payload else ""

    def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
        with opener(uri) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            packed = stream.peek(2)[:2] == b"\x1f\x8b"
            yield from warc_records(io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20) if packed else stream)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["path"]:
                out, held = [], 0
                for head, block in records(uri):
                    kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = http_body(block) if kind == "response" else None
                    digest = stated if payload is None else base32_sha1(payload)
                    if digest != stated:
                        raise ValueError(f"{head['WARC-Record-ID']}: payload digest differs")
                    n = int(head["X-Payload-Length"]) if payload is None else len(payload)
                    out.append((number(head.get("X-Page-Id")), head["WARC-Target-URI"],
                                head["WARC-Record-ID"], head["WARC-Date"], kind, n, digest,
                                number(head.get("X-Refers-To-Page")))
                               + ((payload,) if with_payload else ()))
                    held += len(payload or b"") if with_payload else 0
                    if len(out) == 1000 or held >= 1 << 24:
                        yield frame(out)
                        out, held = [], 0
                if out:
                    yield frame(out)

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")], dtype=object)
        return made

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path").mapInPandas(parse, schema)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as WARC into the shared folder and read the archives back: one row per page.

    Null html is an empty payload, a null url is written as `-`; equal payloads, repeated rows and pages without
    an id are told apart as `write_warc` states. An empty table gives no rows.
    """
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
