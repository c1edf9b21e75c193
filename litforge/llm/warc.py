"""WARC archives: one gzip member per record, read back sequentially.

Writing: equal payloads are found by digest; the smallest key of a group keeps
the payload (``response``) and the others are ``revisit`` records that name it.
Every task writes archives of its own into the shared folder, under names that
no other attempt uses, and reports them in a manifest; readers open only what
the manifest names, so lost or repeated tasks leave no trace in the result.

Reading: an incremental zlib decoder feeds a parser that frames records by
Content-Length and verifies the block digest and the payload digest.

Cases: null html is an empty payload; rows whose key is null come after all
others in a group; rows that repeat the smallest key of a group are all
responses; no rows give archives without records; a damaged or truncated archive
raises ``WarcError``; a null url is written as an empty one and blanks in urls are
left out, as a header line can't hold them; payloads of any size are written and
read whole, one at a time; columns other than the key, url and html are dropped,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.llm.joins import hot_keys, with_facts
from litforge.session import materialize, shared_dir, table

#: Production parameters: payloads of fewer bytes are never revisits; an archive is closed beyond ROLL_BYTES.
MIN_REVISIT_BYTES = 0
ROLL_BYTES = 256 << 20
READ_BYTES = 256 << 10
#: The first keys of up to so many copied digests are broadcast (under 20 MB).
BROADCAST_DIGESTS = 200_000

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that isn't well-formed or whose digests don't hold."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _urn(key: int | None) -> str:
    return "<urn:page:none>" if key is None else f"<urn:page:{key}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    url = "".join((url or "").split())
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(key)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head[1:1] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(stream) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, read in small steps."""
    decoder, parts = zlib.decompressobj(31), []
    fresh = True
    while data := stream.read(READ_BYTES):
        while data:
            fresh = False
            try:
                parts.append(decoder.decompress(data))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            data = decoder.unused_data
            if decoder.eof:
                yield b"".join(parts)
                decoder, parts, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise WarcError("truncated gzip member")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the only record in a member."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0].encode() != VERSION:
        raise WarcError("no record header")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't frame the record")
    return fields, rest[:n]


def read_record(member: bytes) -> dict:
    """A record's fields and payload, its digests verified."""
    fields, block = parse(member)
    if fields["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
        raise WarcError("block digest doesn't hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise WarcError("payload digest doesn't hold")
    key = lambda urn: None if urn is None or urn == "<urn:page:none>" else int(urn[len("<urn:page:") : -1])
    return {"key": key(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": key(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, key: str = "page_id", min_bytes: int = MIN_REVISIT_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row of ``pages(key, url, html)``; returns the manifest ``(archive, records)``."""
    folder = f"{shared_dir(pages.sparkSession)}/litforge/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(key).alias("key"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Copies are counted before anything large moves.  The first keys of copied digests are broadcast while they are
    # few; beyond, those of hot digests are, and other rows are shuffled.
    counts = materialize(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1"), "warc-copies")
    firsts = counts.drop("n")
    if counts.count() <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        rows = with_facts(rows, firsts, hot_keys(counts, "digest"), "digest")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_bytes)
    rows = rows.select("key", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, path = open_fs(folder)
        where.create_dir(path, recursive=True)
        context = TaskContext.get()
        done: list[tuple[str, int]] = []
        out, size, count = None, 0, 0
        for batch in batches:
            for k, url, html, first in zip(batch["key"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    name = f"{context.partitionId():05d}-{context.taskAttemptId()}-{len(done)}.warc.gz"
                    out, size, count = where.open_output_stream(f"{path}/{name}"), 0, 0
                data = record(None if pd.isna(k) else int(k), url, html.encode("utf-8", "surrogatepass"), None if pd.isna(first) else int(first))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count))
        yield pd.DataFrame(done, columns=["archive", "records"])

    rows = rows.withColumns({"key": F.col("key").cast("decimal(20,0)").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return materialize(rows.mapInPandas(write, "archive string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """A row per record of the archives in the manifest; ``payload`` adds the bytes of responses."""
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    schema = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, records in zip(batch["archive"], batch["records"], strict=True):
                where, path = open_fs(archive)
                rows, held, seen = [], 0, 0
                with where.open_input_stream(path) as stream:
                    for member in members(stream):
                        rows.append(read_record(member))
                        seen, held = seen + 1, held + len(member) * payload
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if seen != records:
                    raise WarcError(f"{archive} has {seen} records of {records}")
                if rows:
                    yield _frame(rows, names)

    n = max(1, manifest.count())
    return manifest.select("archive", "records").repartition(n).mapInPandas(read, schema)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"key": "Int64", "refers_to": "Int64"})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL = {
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
       list_reduce(list_transform(range(8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * g + 1)::INTEGER, 5))::BIGINT) >> s) & 31)::INTEGER + 1, 1)),
         lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
""",
}
