"""WARC archives: write, normalise monolithic gzip, index, and read back by offset.

Pages are written as whole-file gzip streams, the form that cannot be read at random. The
normaliser inflates such a stream once, writes every record as a gzip member of its own and a
sidecar index of offsets beside it; readers then fetch records by offset.

Files go to a folder that all executors share. A task attempt writes under a name of its own and
only names in a written manifest count, so a retried or lost task leaves no half archive in use.
Records stream: memory is bounded by the longest record. Archives roll over at ``ROLL`` bytes, so
no task inflates more than that in one stream of ours. Payloads move at most once, in the join
with the groups of equal payloads; that join is a broadcast only if the planner sees a small table.

Defined cases: a null html is an empty payload; a null page_id is never preferred as response,
and if a group of equal payloads has only null ids all its records are responses; rows that repeat
a page_id and payload are all responses if that id is the largest; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas, materialize, new_path, table

#: Payloads below this many bytes are always written in full.
LEAST = 1000
#: Uncompressed bytes after which an archive is closed and the next begun.
ROLL = 256 << 20
CHUNK = 1 << 20
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_file(uri: str, mode: str):
    """A local file, or a stream of any store that Arrow knows."""
    if uri.startswith("file:") or "://" not in uri:
        return open(urlparse(uri).path if uri.startswith("file:") else uri, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_file(path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response, or a revisit of page refers_to: it has the HTTP head without the payload."""
    digest = hashlib.sha1(payload).digest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest.hex()}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "about:blank",
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}",
        "Content-Type": "application/http; msgtype=response",
    }
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest.hex()}')}>", "X-Refers-To-Page": str(refers_to)}
    else:
        block += payload
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def inflated(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip stream of one or more members, chunk by chunk."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            out = z.decompress(data, CHUNK)
            begun = True
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the gzip stream ends within a member")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an inflated stream into whole records, each with its closing blank lines."""
    held = bytearray()
    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            more = next(chunks, None)
            if more is None:
                if held.strip():
                    raise ValueError("the stream ends within a record's head")
                return
            held += more
        size = next((int(x[15:]) for x in bytes(held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if size is None or not held.startswith(b"WARC/"):
            raise ValueError("a record lacks its version or length")
        end = at + 4 + size + 4
        while len(held) < end:
            more = next(chunks, None)
            if more is None:
                raise ValueError("the stream ends within a record")
            held += more
        yield bytes(held[:end])
        del held[:end]


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise_file(source: str, target: str) -> tuple[str, int]:
    """Rewrite archive source as target with one member a record; write target + ``.idx`` with
    lines of offset, length. Returns the index's name and the number of records."""
    at, lines = 0, []
    with open_file(source, "rb") as stream, open_file(target, "wb") as out:
        for one in records(inflated(stream)):
            packed = member(one)
            out.write(packed)
            lines.append(f"{at}\t{len(packed)}\n")
            at += len(packed)
    with open_file(f"{target}.idx", "wb") as out:
        out.write("".join(lines).encode())
    return f"{target}.idx", len(lines)


def parse(one: bytes) -> dict:
    """Page id, payload size and digest, type and page referred to of one inflated record."""
    head, _, block = one.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page")}


def _resolved(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """(page_id, url, html, head): head is the response's page_id in a group of equal payloads."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= LEAST, F.sha1(F.col("html").cast("binary")))
    groups = rows.select("page_id", digest.alias("digest")).where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1").select("digest", "head"), "equal-payloads")
    return rows.withColumn("of", digest).join(groups, F.col("of") == F.col("digest"), "left").select("page_id", "url", "html", "head")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """rows as of _resolved. Writes monolithic archives; (path, records) of each that counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = path = z = None
        n = size = 0
        for batch in batches:
            for page_id, url, html, head in zip(batch["page_id"], batch["url"], batch["html"], batch["head"]):
                if out is None:
                    path, n, size = f"{folder}-mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = open_file(path, "wb"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                page_id, head = (None if pd.isna(x) else int(x) for x in (page_id, head))
                one = record(page_id, url, html.encode(), None if head == page_id else head)
                out.write(z.compress(one))
                n, size = n + 1, size + len(one)
                if size >= ROLL:
                    out.write(z.flush())
                    out.close()
                    yield pd.DataFrame({"path": [path], "records": [n]})
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    return materialize(map_pandas(rows, run, "path string, records long"), "monolithic-archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """archives: (path, ...). (path, index, records) of each normalised archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["path"]:
                target = f"{folder}-norm-{uuid.uuid4().hex}.warc.gz"
                index, n = normalise_file(source, target)
                yield pd.DataFrame({"path": [target], "index": [index], "records": [n]})

    spread = archives.select("path").repartition(max(1, min(archives.count(), 10_000)))
    return materialize(spread.mapInPandas(run, "path string, index string, records long"), "normalised-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, fetched by the offsets of the sidecar index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, index in zip(batch["path"], batch["index"]):
                with open_file(index, "rb") as f:
                    places = [tuple(map(int, x.split(b"\t"))) for x in f.read().splitlines()]
                found = []
                with open_file(path, "rb") as f:
                    for at, size in places:
                        f.seek(at)
                        found.append(parse(zlib.decompress(f.read(size), 31)))
                        if len(found) == 5000:
                            yield typed(found)
                            found = []
                if found:
                    yield typed(found)

    def typed(found: list[dict]) -> pd.DataFrame:
        kinds = {"page_id": "Int64", "payload_bytes": "Int64", "payload_digest": object, "record_type": object, "refers_to": "Int64"}
        return pd.DataFrame({c: pd.array([x[c] for x in found], dtype=k) if k == "Int64" else [x[c] for x in found] for c, k in kinds.items()})

    spread = archives.select("path", "index").repartition(max(1, min(archives.count(), 10_000)))
    return map_pandas(spread, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(normalise(write_archives(_resolved(pages, id_col, url, html), folder), folder))


def op8_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


SQL_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM m
"""
