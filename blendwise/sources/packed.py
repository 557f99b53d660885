"""Packed blocks as Parquet (S6) and the packed binary chunk files.

Binary chunk file: 7-byte magic ``LITPKDS``, little-endian u64 version (1),
u8 dtype code, u64 chunk size, then the chunk's ids from byte 24.  A chunk is
one file, ``{split}_{source}_{process_id}_{chunk_id:010d}.bin``.

The files are a Spark data source.  Reading deals byte ranges: a large file is read by several tasks, each
seeking to the blocks that begin in its range, and small files share a task; filters on the columns that a file's name holds
remove files before anything is opened.  Writing goes through a commit: tasks write into attempt folders of their
own, and only when all have succeeded are the files of the committed attempts moved into place, so a failed
job, a repeated task or a speculative copy leaves nothing visible.  All IO goes through Arrow's file systems; no mounted folder is needed.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    WriterCommitMessage)

from blendwise.session import ship_package

# Fixed values of the packed chunk format.
HDR_MAGIC = b"LITPKDS"
HDR_SIZE = 24
VERSION = 1
DTYPE_CODES = {1: np.uint8, 2: np.int8, 3: np.int16, 4: np.int32, 5: np.int64, 6: np.float32, 7: np.float64, 8: np.uint16}
U16_VOCAB_LIMIT = 65500

FORMAT = "packed_chunks"
PARTITION_BYTES = 64 << 20
OPEN_COST = 1 << 18  # bytes that opening a file counts as, when small files are put together
SLAB_BYTES = 8 << 20
COMMIT_THREADS = 16
FILE_NAME = re.compile(r"^([^_]+)_(.*)_(\d+)_(\d{10})\.bin$")
BLOCK_ROWS_SCHEMA = "file string, split string, source string, process_id int, chunk_id bigint, block_in_chunk bigint, tokens array<bigint>"


def dtype_for_vocab(vocab_size: int):
    return np.uint16 if vocab_size < U16_VOCAB_LIMIT else np.int32


def code_of(dtype) -> int:
    for k, v in DTYPE_CODES.items():
        if np.dtype(v) == np.dtype(dtype):
            return k
    raise ValueError(f"unsupported dtype {dtype}")


def header(dtype, chunk_size: int) -> bytes:
    return HDR_MAGIC + struct.pack("<Q", VERSION) + struct.pack("<B", code_of(dtype)) + struct.pack("<Q", chunk_size)


def parse_header(buf: bytes) -> tuple[np.dtype, int]:
    if buf[: len(HDR_MAGIC)] != HDR_MAGIC:
        raise ValueError("not a packed chunk file: wrong magic bytes")
    (version,) = struct.unpack("<Q", buf[7:15])
    if version != VERSION:
        raise ValueError(f"unsupported packed-file version {version}")
    (code,) = struct.unpack("<B", buf[15:16])
    if code not in DTYPE_CODES:
        raise ValueError(f"unknown dtype code {code}")
    (chunk_size,) = struct.unpack("<Q", buf[16:24])
    return np.dtype(DTYPE_CODES[code]), chunk_size


def write_blocks(blocks: DataFrame, path: str, keys: Sequence[str] = ("split", "source"),
                 chunks_per_task: int = 64, mode: str = "overwrite") -> None:
    """Blocks as Parquet partitioned by split and source.

    The shuffle key is (keys, chunk bucket): a source holding most of the
    corpus is still written by many tasks; rows are sorted by block inside
    each task for locality and good encoding."""
    keys = list(keys)
    d = blocks.repartition(*[F.col(k) for k in keys], F.floor(F.col("chunk_id") / chunks_per_task))
    d = d.sortWithinPartitions(*keys, "chunk_id", "block_in_chunk")
    d.write.mode(mode).partitionBy(*keys).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a URI as Spark writes it (``file:/x``, ``hdfs://``, ``s3://``) or of a plain path."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def name_parts(name: str) -> dict:
    m = FILE_NAME.match(name)
    return dict(zip(("split", "source", "process_id", "chunk_id"), (m[1], m[2], int(m[3]), int(m[4])))) if m else {}


@dataclass
class FileRanges(InputPartition):
    """Ranges ``(path, start, stop)``: the blocks that begin in those bytes."""

    ranges: list[tuple[str, int, int]]


def deal_ranges(files: list[tuple[str, int]], partition_bytes: int, open_cost: int = OPEN_COST) -> list[FileRanges]:
    """Large files cut into ranges of ``partition_bytes``, small ones put together up to that."""
    out, held, size = [], [], 0
    for path, length in files:
        for start in range(0, max(length, 1), partition_bytes):
            stop = min(length, start + partition_bytes)
            cost = stop - start + open_cost
            if held and size + cost > partition_bytes + open_cost:
                out.append(FileRanges(held))
                held, size = [], 0
            held.append((path, start, stop))
            size += cost
    return out + ([FileRanges(held)] if held else [])


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class PackedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.block = int(options["blockSize"])
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and ``IN`` on the parts of a file's name prune files; every other filter stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("split", "source", "process_id", "chunk_id"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                have = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if have is None else have & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.path)
        found = system.get_file_info(pafs.FileSelector(path, recursive=True))
        files = []
        for info in found:
            if info.type != pafs.FileType.File or not info.base_name.endswith(".bin"):
                continue
            if any(x.startswith(("_", ".")) for x in info.path[len(path):].split("/")):  # attempts that are not committed
                continue
            parts = name_parts(info.base_name)
            if all(parts.get(k) in v for k, v in self.wanted.items()):
                files.append((info.path, info.size))
        return deal_ranges(sorted(files), self.partition_bytes)

    def read(self, partition: FileRanges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        held, size = [], 0  # small files' blocks go to Spark together
        for path, start, stop in partition.ranges:
            for b in self.blocks(system, path, start, stop):
                held.append(b)
                size += b.nbytes
                if size >= SLAB_BYTES:
                    yield joined(held)
                    held, size = [], 0
        if held:
            yield joined(held)

    def blocks(self, system: pafs.FileSystem, path: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        name = path.rsplit("/", 1)[-1]
        parts = name_parts(name)
        with system.open_input_file(path) as f:
            dtype, chunk = parse_header(f.read(HDR_SIZE))
            if dtype.kind == "f":
                raise ValueError(f"{name} holds {dtype} values, not ids")
            step = self.block * dtype.itemsize
            first = max(0, -(-(start - HDR_SIZE) // step))
            last = min(chunk // self.block, max(0, -(-(stop - HDR_SIZE) // step)))
            per_slab = max(1, SLAB_BYTES // step)
            for lo in range(first, last, per_slab):
                n = min(per_slab, last - lo)
                f.seek(HDR_SIZE + lo * step)
                raw = f.read(n * step)
                if len(raw) != n * step:
                    raise ValueError(f"{name} ends before its chunk does")
                ids = pa.array(np.frombuffer(raw, dtype).astype(np.int64))
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.block + 1, self.block, dtype=np.int32)), ids)
                cols = [pa.array([name] * n), *(pa.array([parts.get(k)] * n, t) for k, t in
                        (("split", pa.string()), ("source", pa.string()), ("process_id", pa.int32()), ("chunk_id", pa.int64()))),
                        pa.array(np.arange(lo, lo + n, dtype=np.int64)), tokens]
                yield pa.RecordBatch.from_arrays(cols, ["file", "split", "source", "process_id", "chunk_id", "block_in_chunk", "tokens"])


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of one task's successful attempt."""

    folder: str
    files: int


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        import uuid

        self.path = options["path"].rstrip("/")
        self.chunk = int(options["chunkSize"])
        self.vocab = int(options["vocabSize"])
        self.overwrite = overwrite
        self.job = f"{self.path}/_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        from pyspark import TaskContext

        context = TaskContext.get()
        folder = f"{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        dtype = dtype_for_vocab(self.vocab)
        head, n = header(dtype, self.chunk), 0
        for b in iterator:
            rows = zip(*(b.column(c).to_pylist() for c in ("split", "source", "process_id", "chunk_id")), b.column("tokens"))
            for split, source, process, chunk, tokens in rows:
                ids = tokens.values.to_numpy(zero_copy_only=False).astype(dtype)
                if len(ids) != self.chunk:
                    raise ValueError(f"chunk {source}/{chunk} has {len(ids)} ids, expected {self.chunk}")
                with system.open_output_stream(f"{path}/{split}_{source}_{process}_{chunk:010d}.bin") as f:
                    f.write(head)
                    f.write(ids.tobytes(order="C"))
                n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, path = file_system(self.path)
        if self.overwrite:
            for info in system.get_file_info(pafs.FileSelector(path, recursive=False)):
                if info.type == pafs.FileType.File and info.base_name.endswith(".bin"):
                    system.delete_file(info.path)
        def put(m: Attempt) -> None:
            for info in system.get_file_info(pafs.FileSelector(file_system(m.folder)[1])):
                system.move(info.path, f"{path}/{info.base_name}")

        with ThreadPoolExecutor(COMMIT_THREADS) as pool:  # a file is a call to the file system, and there is one for each chunk
            list(pool.map(put, [m for m in messages if m is not None and m.files]))
        self._clean(system)
        with system.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clean(file_system(self.path)[0])

    def _clean(self, system: pafs.FileSystem) -> None:
        job = file_system(self.job)[1]
        if system.get_file_info(job).type == pafs.FileType.Directory:
            system.delete_dir(job)


class PackedChunks(DataSource):
    """``format("packed_chunks")``: options ``path``; to read ``blockSize`` and ``partitionBytes``, to write ``chunkSize`` and ``vocabSize``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return BLOCK_ROWS_SCHEMA

    def reader(self, schema: T.StructType) -> PackedReader:
        return PackedReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedChunks)


def write_packed_files(chunk_rows: DataFrame, directory: str, vocab_size: int, chunk_size: int,
                       split: str = "train", process_id: int | str = 0, source: str = "source", mode: str = "append") -> None:
    """Write each chunk ``(source, chunk_id, tokens)`` as one packed file; ``process_id`` is a number or the
    name of a column (one builder per input file).  Every chunk must be whole (pack with ``remainder='pad'``)."""
    register(chunk_rows.sparkSession)
    pid = F.col(process_id) if isinstance(process_id, str) else F.lit(process_id)
    rows = chunk_rows.select(F.lit(split).alias("split"), F.col(source).alias("source"), pid.cast("int").alias("process_id"),
                             F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("tokens").cast("array<bigint>").alias("tokens"))
    rows.write.format(FORMAT).mode(mode).option("path", directory).option("chunkSize", chunk_size).option("vocabSize", vocab_size).save()


def read_packed_files(spark: SparkSession, directory: str, block_size: int, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Blocks of the packed chunk files under ``directory``, with what their names say.

    Header checked per file (magic, version, dtype); a chunk gives ``chunk_size // block_size`` blocks, the rest is not read."""
    register(spark)
    return spark.read.format(FORMAT).option("path", directory).option("blockSize", block_size).option("partitionBytes", partition_bytes).load()
