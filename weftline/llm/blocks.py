"""Blocks of documents and packed exchanges.

A *block* is one row holding some megabytes of whole documents as a compressed Arrow table. Operators that look
for repeats make several passes: every block sends sorted arrays of 64-bit hashes to hash partitions (*parts*), each
part compares what the blocks sent, and answers the blocks. One row carries thousands of hashes, so the exchange costs
a few bytes a hash and is aggregated per block before it is shuffled: a hash that a third of all documents share is
sent once by a block, however often the block holds it. Blocks are checkpointed once, so all passes see the same ones
and a lost executor costs only the tasks it ran.

A null doc_id is carried as ``NO_ID``: it sorts after every other id and comes back as null.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed

NO_ID = np.iinfo(np.int64).max
LEVEL = 5
CODEC = pa.Codec("zstd", compression_level=LEVEL)
BLOCK_BYTES = 4 << 20
PART_BYTES = 16 << 20
SPREAD = 3  # partitions of blocks for each of the documents
REWRITE_ROWS = 500
BATCH_ROWS = 1000
BLOCK_SCHEMA = "block long, n_docs long, n_bytes long, payload binary"
SENT_SCHEMA = "part int, block long, payload binary"
ANSWER_SCHEMA = "block long, payload binary"


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept for other stages, and what one of them holds after a
    large block would be missed there."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(docs: DataFrame) -> None:
    """Let the session hand texts to Python ``BATCH_ROWS`` at a time at most: both sides hold whole batches."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def plain(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, without nulls."""
    small_batches(docs)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def with_null_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.expr(f"nullif(doc_id, {int(NO_ID)}L)"))


def press(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw).to_pybytes()


def unpress(raw: bytes) -> bytes:
    return CODEC.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Checkpointed blocks of (doc_id, text); a longer document has a block of its own. Null texts count as empty."""
    docs = plain(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < len(sizes):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + block_bytes, side="right")))
                part = batch.slice(start, stop - start)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_pydict(
                    {"block": [base + seq], "n_docs": [stop - start], "n_bytes": [int(ends[stop - 1] - before)], "payload": [sink.getvalue().to_pybytes()]},
                    schema=pa.schema([("block", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())]),
                )
                seq, start = seq + 1, stop
        give_back()

    # dealt by block once, so that no later pass moves the texts again: only what is sent to blocks is shuffled. A plan
    # that adapts would not tell the checkpoint how it is partitioned
    spark = docs.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SPREAD * docs.rdd.getNumPartitions())
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(docs.mapInArrow(run, BLOCK_SCHEMA).repartition(wide, "block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def rewrite(docs: DataFrame, change: Callable[[list[str | None]], tuple[list[bool], list[str | None]]]) -> DataFrame:
    """Rows of ``docs`` that ``change`` keeps, with the texts that it gives; other columns pass untouched, without a
    shuffle. ``n_chars``, where there is one, follows a text that has changed."""
    small_batches(docs)
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, REWRITE_ROWS) for k in range(0, len(whole), REWRITE_ROWS)):
                texts = batch.column(at).to_pylist()
                keep, after = change(texts)
                columns = list(batch.columns)
                if any(a is not b for a, b in zip(texts, after, strict=True)):
                    columns[at] = pa.array(after, batch.schema.field(at).type)
                    if counted is not None:
                        sizes = [n if a is b else len(b) for a, b, n in zip(texts, after, columns[counted].to_pylist(), strict=True)]
                        columns[counted] = pa.array(sizes, batch.schema.field(counted).type)
                out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield out if all(keep) else out.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, the start of each text (one more than texts), and all bytes."""
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    ids = table.column(0).to_numpy().astype(np.int64)
    if not len(ids):
        return ids, np.zeros(1, np.int64), np.zeros(0, np.uint8)
    texts = table.column(1).combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    raw = texts.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    starts = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    size = int(starts[-1])
    whole = np.frombuffer(data, np.uint8, size) if data is not None and size else np.zeros(0, np.uint8)
    return ids, starts - starts[0], whole[starts[0] :]


def total_bytes(blocks: DataFrame) -> int:
    return int(blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])


def part_count(n_bytes: int, part_bytes: int = PART_BYTES) -> int:
    return max(8, -(-n_bytes // part_bytes))


def key_bytes(n: int) -> int:
    """Bytes of a hash that filter ``n`` values with under one false match in 1,000; never fewer than 5."""
    return min(8, max(5, -(-(n.bit_length() + 10) // 8)))


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """The ``width`` high bytes of 64-bit values, all highest bytes first: in ascending order these compress well."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: bytes, width: int = 8) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view(">u8").reshape(-1).astype(np.uint64)


def split_by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``keys`` (ascending within each part) and the bounds of the parts in it. The part is in the high bits."""
    order = np.argsort(keys, kind="stable")
    width = -(-(1 << 64) // parts)
    edges = np.arange(1, parts, dtype=np.uint64) * np.uint64(width)
    return order, np.concatenate([[0], np.searchsorted(keys[order], edges), [len(keys)]]).astype(np.int64)


def each_block(blocks: DataFrame, fn: Callable[[int, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn(block, payload)`` yields tuples of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, payload in zip(frame["block"], frame["payload"], strict=True):
                rows = list(fn(int(block), payload))
                give_back()
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return blocks.select("block", "payload").mapInPandas(run, schema)


def each_part(sent: DataFrame, fn: Callable[[int, list[int], list[bytes]], Iterator[tuple]], schema: str = ANSWER_SCHEMA) -> DataFrame:
    """``fn(part, blocks, payloads)`` over what all blocks sent to a part, in the order of the blocks."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", kind="stable")
        out = pd.DataFrame(list(fn(int(frame["part"].iloc[0]), frame["block"].tolist(), frame["payload"].tolist())), columns=names)
        give_back()
        return out

    return sent.groupBy("part").applyInPandas(run, schema)


def each_answered(blocks: DataFrame, answers: DataFrame, fn: Callable[[int, bytes, list[bytes]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn(block, payload, answers)``; blocks without an answer get an empty list."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame([], columns=names)
        out = pd.DataFrame(list(fn(int(own["block"].iloc[0]), own["payload"].iloc[0], given["payload"].tolist())), columns=names)
        give_back()
        return out

    return blocks.select("block", "payload").groupBy("block").cogroup(answers.select("block", "payload").groupBy("block")).applyInPandas(run, schema)
