"""Streaming pack (P11): documents arriving over time become blocks.

A pack key (a source, or a source and an input file) has one builder.  Its state is the open chunk, as a list
with one entry per document piece that is appended to and never rewritten until the chunk is full, and four
counters.  A chunk is emitted when a later id overflows it; the open chunk is emitted when
the key is complete, so that the stream loses nothing and equals the batch packer with the same tail rule:

* ``remainder='keep'`` (default): the last chunk at its true length;
* ``remainder='pad'``: the last chunk filled with ``sep``;
* ``remainder='drop'``: the packed format's own rule, the open chunk is lost.

A key is complete when it has seen as many documents as its end marker says: a row without ids whose
``expected`` column holds the key's number of documents.  Markers may arrive before, with or after the
documents, in any micro-batch.  Documents that come after a key was completed open its next chunk, which a later
marker with the higher number closes.  Without markers the open chunk stays in the state.

Order inside a micro-batch is not defined, so each key's new documents are sorted by ``order``.  Keys
with several builders (one per input file, as the packed format restarts per file) spread a hot source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blendwise.session import ship_package

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTERS = "counter long, length long, seen long, expected long"


class ChunkBuilder(StatefulProcessor):
    """One builder per key."""

    def __init__(self, schema: T.StructType, chunk_size: int, block_size: int, order: str, ids: str, expected: str,
                 remainder: str, sep: int):
        self.schema, self.chunk, self.block = schema, chunk_size, block_size
        self.order, self.ids, self.expected = order, ids, expected
        self.remainder, self.sep = remainder, sep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", COUNTERS)
        self.open = handle.getListState("open", "ids array<int>")

    def blocks(self, key: tuple, counter: int, ids: np.ndarray) -> list[tuple]:
        reach = ids[: self.chunk // self.block * self.block]
        return [(*key, counter, j, reach[lo:lo + self.block]) for j, lo in enumerate(range(0, len(reach), self.block))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.counters.get() if self.counters.exists() else None
        counter, length, seen, expected = now if now is not None else (0, 0, 0, None)
        pdf = pd.concat(list(rows)).sort_values(self.order)
        if self.expected in pdf and pdf[self.expected].notna().any():
            expected = max(int(pdf[self.expected].max()), expected or 0)
        docs = [np.asarray(x, dtype=np.int32) for x in pdf[self.ids] if x is not None]
        seen += len(docs)
        out: list[tuple] = []
        held: list[np.ndarray] = []  # pieces of the open chunk that are not in the state yet
        for ids in docs:
            held.append(ids)
            length += len(ids)
            if length <= self.chunk:
                continue
            stream = np.concatenate([*self._stored(), *held])
            whole = (length - 1) // self.chunk  # a chunk that is exactly full stays open
            for c in range(whole):
                out += self.blocks(key, counter + c, stream[c * self.chunk:(c + 1) * self.chunk])
            counter += whole
            length -= whole * self.chunk
            self.open.clear()
            held = [stream[whole * self.chunk:]]
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=self.schema.names)
                out = []
        complete = expected is not None and seen >= expected
        if complete and length and self.remainder != "drop":
            last = np.concatenate([*self._stored(), *held])
            if self.remainder == "pad":
                last = np.concatenate([last, np.full(self.chunk - len(last), self.sep, np.int32)])
            out += self.blocks(key, counter, last)
            self.open.clear()
            counter, length, held = counter + 1, 0, []
        if held:
            self.open.appendList([(x.tolist(),) for x in held])
        self.counters.update((int(counter), int(length), int(seen), expected))
        if out:
            yield pd.DataFrame(out, columns=self.schema.names)

    def _stored(self) -> list[np.ndarray]:
        return [np.asarray(x[0], dtype=np.int32) for x in self.open.get()] if self.open.exists() else []


def with_end_markers(docs: DataFrame, keys: Sequence[str] = ("source",), ids: str = "ids", expected: str = "expected") -> DataFrame:
    """``docs`` plus one end marker per key: a row without ids that holds the key's number of documents."""
    ends = docs.filter(F.col(ids).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias(expected))
    return docs.withColumn(expected, F.lit(None).cast("bigint")).unionByName(ends, allowMissingColumns=True)


def pack_stream(stream: DataFrame, chunk_size: int, block_size: int, keys: Sequence[str] = ("source",),
                order: str = "doc_id", ids: str = "ids", expected: str = "expected", remainder: str = "keep",
                sep: int = 0) -> DataFrame:
    """Blocks ``(keys..., chunk_id, block_in_chunk, tokens)`` in append mode.  The state lives in RocksDB, so a
    session that starts the query needs that provider; it is set here."""
    if remainder not in ("keep", "pad", "drop"):
        raise ValueError(f"remainder must be 'keep', 'drop' or 'pad', got {remainder!r}")
    keys = list(keys)
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ship_package(spark)
    schema = T.StructType([stream.schema[k] for k in keys] + [
        T.StructField("chunk_id", T.LongType()), T.StructField("block_in_chunk", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    cols = [*keys, order, ids, *([expected] if expected in stream.columns else [])]
    builder = ChunkBuilder(schema, chunk_size, block_size, order, ids, expected, remainder, sep)
    return stream.select(*cols).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=builder, outputStructType=schema, outputMode="Append", timeMode="None")
