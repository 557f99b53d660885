"""WARC archives: write, normalise (one gzip member per record plus a sidecar offset index) and read back.

The first archives are monolithic: one gzip stream over the whole file, as many
crawlers and ``gzip`` itself leave them, so no record can be reached without inflating
everything before it.  ``normalise`` inflates such a stream once, in chunks,
rewrites every record as its own gzip member and writes a sidecar index
(record id, offset, length).  Afterwards any record is read by one seek.

Files are written by Spark tasks through pyarrow's file systems, so any scheme that
those know works (``file``, ``hdfs``, ``s3``, ``gs``); they go to the shared folder.  A
file's name depends only on its place, it is written under an attempt's own name and moved when complete,
and its path is listed only in the task's committed result: a lost or repeated task
leaves no half file in the list.

Records with equal payloads: the one with the largest id is the response, the others are
``revisit`` records that refer to it and carry the headers but no payload.  Copies
are found by one partial aggregate on the payload digest.  Its groups of two and more are counted: few are broadcast, so that
payloads need no shuffle, many are salted before they are joined back, so that a payload that a third of all pages share is spread.

Defined results: a null payload is empty; a null id is written as an empty id and read back as null (it
is the smallest); repeated rows are records of their own (equal ids: the
one written is a response only if no other row has a larger id, all others with that payload and a
smaller id revisit it); a null url leaves the target header out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.llm.common import map_arrow, materialize, table
from blendwise.session import scratch_path

SALT = 32
BROADCAST_ROWS = 100_000  # groups of copies that are sent to every task (4 MB); more are joined by a salted shuffle
CHUNK = 1 << 20
LEVEL = 3
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit's block is only the HTTP header."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an inflated byte stream into whole records; memory holds one record and one chunk."""
    buf = bytearray()
    need = None
    stream = iter(stream)
    while True:
        if need is None:
            end = buf.find(b"\r\n\r\n")
            if end >= 0:
                need = end + 4 + int(headers(bytes(buf[:end]))["content-length"]) + 4
        if need is not None and len(buf) >= need:
            yield bytes(buf[:need])
            del buf[:need]
            need = None
            continue
        chunk = next(stream, None)
        if chunk is None:
            if buf:
                raise ValueError("archive ends inside a record")
            return
        buf += chunk


def inflated(f, size: int = CHUNK) -> Iterator[bytes]:
    """Inflate a gzip file of one or more members, chunk by chunk, each compressed byte once."""
    z = zlib.decompressobj(31)
    while data := f.read(size):
        while data:
            out = z.decompress(data, size)
            if out:
                yield out
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    if out := z.flush():
        yield out


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Output:
    """A file that gets its name when it is complete."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId()}.part"
        self.f = self.fs.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.f.write(data)

    def done(self) -> None:
        self.f.close()
        self.fs.move(self.part, self.path)


def as_uri(path: str) -> str:
    """A URI for pyarrow: plain paths and Hadoop's ``file:/x`` become ``file:///x``."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return path if "://" in path else f"file://{path}"


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out, z = _Output(uri), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = (r["payload"] or "").encode()
                out.write(z.compress(record(r["id"], r["url"], payload, payload_digest(payload), r["refers_to"], r["revisit"])))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.done()
            yield pa.RecordBatch.from_pydict({"archive": [uri], "records": pa.array([n], pa.int64())})
    return write


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``rows(id, url, payload, refers_to, revisit)``, one whole-file gzip stream per partition; list of archives."""
    return materialize(map_arrow(rows, _writer(as_uri(folder)), "archive string, records bigint"), "warc-list")


def _normaliser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column("archive").to_pylist():
            fs, path = pafs.FileSystem.from_uri(uri)
            target = uri.removesuffix(".warc.gz") + ".records.warc.gz"
            out, index = _Output(target), []
            offset = 0
            with fs.open_input_stream(path, compression=None) as f:
                for rec in records_of(inflated(f)):
                    data = member(rec)
                    out.write(data)
                    head = headers(rec[:rec.index(b"\r\n\r\n")])
                    index.append((head["warc-record-id"], head["warc-type"], offset, len(data)))
                    offset += len(data)
            out.done()
            side = _Output(target + ".idx")
            side.write("".join(f"{i}\t{t}\t{o}\t{n}\n" for i, t, o, n in index).encode())
            side.done()
            yield pa.RecordBatch.from_pydict({"archive": [target], "index": [target + ".idx"],
                                              "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([offset], pa.int64())})


def normalise(archives: DataFrame) -> DataFrame:
    """Archives with one gzip member per record beside each ``archive``, with a sidecar index; list of both."""
    spark = archives.sparkSession
    n = max(spark.sparkContext.defaultParallelism, archives.count())
    return materialize(map_arrow(archives.select("archive").repartition(n, "archive"), _normaliser,
                                 "archive string, index string, records bigint, bytes bigint"), "warc-normal")


READ = "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text and text != "None" else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for b in batches:
        for archive, index in zip(b.column("archive").to_pylist(), b.column("index").to_pylist()):
            fs, path = pafs.FileSystem.from_uri(archive)
            fs2, side = pafs.FileSystem.from_uri(index)
            rows, held = [], 0
            with fs.open_input_file(path) as f, fs2.open_input_stream(side, compression=None) as lines:
                rest = b""
                for chunk in iter(lambda: lines.read(CHUNK), b""):
                    *whole, rest = (rest + chunk).split(b"\n")
                    for line in whole:
                        _, _, offset, length = line.decode().split("\t")
                        f.seek(int(offset))
                        rec = zlib.decompress(f.read(int(length)), 31)
                        cut = rec.index(b"\r\n\r\n") + 4
                        head = headers(rec[:cut - 4])
                        block = rec[cut:cut + int(head["content-length"])]
                        at = block.index(b"\r\n\r\n") + 4
                        http, payload, revisit = headers(block[:at - 4]), block[at:], head["warc-type"] == "revisit"
                        if not revisit and payload_digest(payload) != head["warc-payload-digest"].removeprefix("sha1:"):
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                        rows.append((_number(head["warc-record-id"]), int(http["content-length"]),
                                     head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"],
                                     _number(head.get("warc-refers-to")), None if revisit else payload))
                        held += len(block)
                        if held > 4 * CHUNK:
                            yield batch(rows)
                            rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of normalised archives, each reached through the index and checked against its digest."""
    n = max(archives.sparkSession.sparkContext.defaultParallelism, archives.count())
    return map_arrow(archives.select("archive", "index").repartition(n, "archive"), _reader, READ)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """Rows ``(id, url, payload, refers_to, revisit)``: of equal payloads of at least ``least_bytes`` the largest id is the response."""
    p = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"),
                     F.coalesce(payload_col, F.lit("")).alias("payload"))
    p = p.withColumn("key", F.unhex(F.sha1("payload"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    copies = p.filter(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.max("id").alias("refers_to"), F.count("*").alias("n"))
    copies = materialize(copies.filter("n > 1").drop("n"), "warc-copies")
    if copies.count() <= BROADCAST_ROWS:
        d = p.join(F.broadcast(copies), "key", "left")
    else:
        d = p.join(copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["key", "salt"], "left")
    revisit = F.col("refers_to").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("refers_to")))
    return d.select("id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    normal = normalise(write_monolithic(with_revisits(pages, "page_id", "url", "html"), folder))
    return read_archives(normal).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
