"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader streams an archive: it inflates member after member, frames each record by its Content-Length and checks its
digests. It holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pylists, shared_path, ship, slices, small

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
CHUNK = 1 << 16


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record as one gzip member. A revisit holds the HTTP header alone."""
    block = HTTP + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").splitlines()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "X-Payload-Length": str(len(payload)),
        "X-No-URI": "1" if url is None else None,
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(text.encode() + block + b"\r\n\r\n") + c.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated members of a gzip stream, one after the other."""
    data = stream.read(CHUNK)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise ValueError("the archive ends within a member")
            parts.append(inflate.decompress(data))
            data = inflate.unused_data if inflate.eof else stream.read(CHUNK)
        yield b"".join(parts)
        data = data or stream.read(CHUNK)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record and its block; raises ValueError if framing or digests are wrong."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not sep or not version.startswith("WARC/"):
        raise ValueError("no record where one should begin")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the block's length isn't its Content-Length")
    block = rest[:n]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block doesn't match its digest")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise ValueError("the payload doesn't match its digest")
    return fields, block


def originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, digest and refers_to of the rows that revisit another; a row for each id and payload.

    Only digests are shuffled, and combined before that, so a payload with a third of all rows is one row from each task.
    """
    keys = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    keys = keys.where((F.col("n") >= least) & F.col("page_id").isNotNull()).drop("n")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return keys.join(first, "digest").where("page_id > refers_to").distinct()


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes an archive per task under ``folder`` and returns path and records of each.

    A task writes under a name of its attempt and renames at the end, so a task that is run again leaves whole files only.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    again = small(cut(originals(pages, least), "originals"))  # broadcast behind a count, so that the pages aren't shuffled
    rows = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(f"{folder}/warc")
        files.create_dir(root, recursive=True)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        n = 0
        with files.open_output_stream(f"{path}.tmp", compression=None) as out:
            for b in slices(batches):
                for page_id, url, html, refers in zip(*pylists(b, "page_id", "url", "html", "refers_to"), strict=True):
                    out.write(record(page_id, url, (html or "").encode(), refers))
                    n += 1
        files.move(f"{path}.tmp", path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    done = f"{folder}/manifest"
    rows.mapInArrow(run, "path string, records long").write.parquet(done)
    return spark.read.schema("path string, records long").parquet(done)


def read(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    archives: with a column path. A damaged record fails the job, as an archive that lost records must not pass for whole.
    """

    def page(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn[10:-1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(f"{folder}/warc")
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for (path,) in zip(*pylists(b, "path"), strict=True):
                rows = []
                with files.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        h, block = parse(member)
                        own = h["WARC-Type"] == "response"
                        payload = block.partition(b"\r\n\r\n")[2] if own else None
                        rows.append((page(h["WARC-Record-ID"]), None if "X-No-URI" in h else h["WARC-Target-URI"], payload, len(payload) if own else int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], h["WARC-Type"], page(h.get("WARC-Refers-To"))))
                        if len(rows) == 512:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # A task for each archive, by ranges of the paths: the list is small, but what stands behind a path isn't.
    ship(archives.sparkSession)
    return archives.select("path").repartitionByRange(max(1, archives.count()), "path").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back.

    Null html is an empty payload. Rows of equal payload: those with the smallest page_id are responses, the others revisit it; rows
    without a page_id are responses and never referred to. Repeated rows are recorded each. An empty table gives no rows.
    """
    folder = shared_path(pages.sparkSession, "archives")
    return read(write(pages, folder, least), folder)
