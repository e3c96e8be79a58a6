"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes its rows as gzip members of one or more WARC/1.1 files in a folder that driver and
executors share, and gives an index row per record: file, offset, length, URL, digest. Reading
starts from the (selected) index rows: they are sorted by file and offset, neighbouring ranges are
read with one request, and the records are cut out of it. A file's name is new for every attempt of
a task, so a lost or repeated task leaves at most a file that no index row names.

Of records with equal payloads of at least ``revisit_from`` bytes the one with the largest id is a
response and the others are revisits of it; equality is by SHA-256 and length.

Defined cases: a null payload is empty; a null URL gives no target header; control characters in a
URL are percent-encoded in the archive; rows that repeat the largest id are all responses; rows with
a null id revisit it too, or are responses if all ids are null; a very long payload is one record, held
in memory as its row is; an empty table gives no archive and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, field, map_arrow, record_batch, saved, shared_dir

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20


def _opened(folder: str):
    """Arrow's file system for a folder, under the names that Hadoop has for some of them too."""
    from pyarrow import fs

    if folder.startswith("dbfs:/"):
        folder = "file:///dbfs/" + folder.removeprefix("dbfs:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record, not compressed. With refers_to it is a revisit and holds the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda b: {k.lower(): v for k, _, v in (x.partition(": ") for x in b.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_from: int = 1000) -> DataFrame:
    """Rows (id, url, payload, sha1, refers_to)."""
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    long = rows.where(F.octet_length("payload") >= revisit_from)
    twice = long.groupBy(F.sha2("payload", 256).alias("k"), F.octet_length("payload").alias("n")).agg(F.max("id").alias("top"), F.count("*").alias("c")).where("c > 1 and top is not null")
    twice = saved(twice.select("k", "n", "top"), "warc-equal")
    keyed = rows.withColumn("key", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    joined = keyed.join(twice, (F.col("key") == F.col("k")) & (F.col("bytes") == F.col("n")), "left")
    refers = F.when(F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")), F.col("top"))
    return joined.select("id", "url", "payload", F.sha1("payload").alias("sha1"), refers.alias("refers_to"))


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives of roles() and gives their index: file, offset, length, url, digest, id.

    The index is saved, so the archives are written once.
    """
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), field(rows, "id")])
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                ids, urls, payloads, digests, refers = (c.to_pylist() for c in batch.columns)
                index: list[tuple] = []
                for i, url, payload, digest, ref in zip(ids, urls, payloads, digests, refers):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(i, url, payload, digest, ref)) + packer.flush()
                    out.write(member)
                    index.append((name, at, len(member), url, digest, i))
                    at += len(member)
                yield record_batch(to, [list(c) for c in zip(*index)] if index else [[] for _ in to])
        finally:
            if out is not None:
                out.close()

    return saved(map_arrow(rows, run, schema), "warc-index")


def coalesced(ranges: list[tuple[str, int, int]], gap: int = 64 << 10, most: int = 8 << 20) -> list[tuple[str, int, int, int, int]]:
    """(file, begin, end, first, last) of requests that hold the sorted ranges first..last-1."""
    out: list[list] = []
    for i, (name, offset, length) in enumerate(ranges):
        if out and out[-1][0] == name and offset - out[-1][2] <= gap and offset + length - out[-1][1] <= most:
            out[-1][2], out[-1][4] = max(out[-1][2], offset + length), i + 1
        else:
            out.append([name, offset, offset + length, i, i + 1])
    return [tuple(x) for x in out]


def read(index: DataFrame, folder: str, id_type: T.DataType | None = None, body: bool = False) -> DataFrame:
    """The records of the given index rows: id, payload_bytes, payload_digest, record_type, refers_to, and payload if asked."""
    id_type = id_type or index.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", id_type), *([T.StructField("payload", T.BinaryType())] if body else [])])
    to = arrow_schema(schema)
    whole = isinstance(id_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    as_id = lambda v: None if v is None else int(v) if whole else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        for batch in batches:
            ranges = list(zip(*(c.to_pylist() for c in batch.columns)))
            for name, begin, end, first, last in coalesced(ranges):
                with system.open_input_file(f"{path}/{name}") as f:
                    data = f.read_at(end - begin, begin)
                rows = []
                for _, offset, length in ranges[first:last]:
                    warc, http, payload = parsed(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if warc["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name} at {offset}: the payload doesn't fit its digest")
                    rows.append((as_id(warc.get("x-page")), int(http["content-length"]), digest, warc["warc-type"], as_id(warc.get("x-refers-to-page")), *([payload] if body else [])))
                yield record_batch(to, [list(c) for c in zip(*rows)])

    count = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length").repartitionByRange(count, "file", "offset").sortWithinPartitions("file", "offset")
    return map_arrow(dealt, run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_from: int = 1000) -> DataFrame:
    """Writes a record per page and reads them all back."""
    folder = shared_dir(pages.sparkSession, "warc")
    index = write(roles(pages, id_col, url_col, body_col, revisit_from), folder)
    return read(index, folder).withColumnRenamed("id", id_col)
