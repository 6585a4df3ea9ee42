"""Documents packed into blocks, so that block-wise exchanges move arrays instead of a row per word.

A block is one row: its number and an Arrow stream of its documents, whatever their columns. The table is written to the shared
folder, so a block keeps its number and its documents however often it is read again. An exchange sends
every part of the hash space one array from each block and gets an array of the same length back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronostrata.llm import words as W
from chronostrata.llm import workers
from chronostrata.llm.lineage import cut, ship

#: Text in a block: blocks times parts is the number of arrays exchanged, so it grows with the square root
#: of an input over LARGE, to MOST_BLOCK at most (a worker holds some ten arrays of a block's n-grams).
BLOCK_BYTES, MOST_BLOCK, LARGE = 4 << 20, 32 << 20, 1 << 40


def stated_size(docs: DataFrame) -> int:
    """Bytes that the plan states for docs: 1 << 60 or more where it knows none."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def block_bytes_for(docs: DataFrame) -> int:
    """From the size that the plan states for docs; the least where it knows none."""
    size = stated_size(docs)
    return BLOCK_BYTES if size >= 1 << 60 else min(MOST_BLOCK, BLOCK_BYTES * max(1, round((size / LARGE) ** 0.5)))


def packed(docs: DataFrame, block_bytes: int | None = None, count_words: bool = False) -> DataFrame:
    """block, payload, n_words (null unless asked for): the checkpointed blocks of docs, with all columns of
    docs: doc_id and text among them."""

    block_bytes = block_bytes or block_bytes_for(docs)
    text = docs.columns.index("text")

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table, n = pa.Table.from_batches(held).combine_chunks(), None
        if count_words:
            texts = [t or b"" for t in table.column(text).cast(pa.binary()).to_pylist()]
            n = sum(len(W.boundaries(W.joined(texts[i:j])[0])[0]) for i, j in W.pieces(texts))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([n], pa.int64())], ["payload", "n_words"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("blocks")
        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                held.append(b.slice(i, 64))
                size += held[-1].column(text).nbytes
                if size >= block_bytes:
                    yield row(held)
                    held, size = [], 0
                    workers.trim()
        if held:
            yield row(held)

    ship(docs.sparkSession)
    rows = docs.mapInArrow(pack, "payload binary, n_words long")
    return cut(rows.select(F.monotonically_increasing_id().alias("block"), "payload", "n_words"))


def held_in(table: DataFrame) -> tuple[int, int]:
    """How many blocks there are, and the bytes of their payloads."""
    return tuple(table.select(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first())


def opened(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def texts_of(table: pa.Table) -> list[bytes]:
    """The texts of a block; null is empty."""
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def parts_for(n_blocks: int, least: int = 64, most: int = 1 << 20) -> int:
    """Parts of the hash space, a power of two: about two blocks' worth of keys in each."""
    return min(most, max(least, 1 << max(0, (n_blocks // 2 - 1).bit_length())))


def slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's keys begin among sorted 64-bit keys (one more at the end)."""
    if parts == 1:
        return np.array([0, len(keys)])
    edges = np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - (parts.bit_length() - 1))
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as the first one and the steps from each to the next, in the fewest whole
    bytes that hold the largest step."""
    steps = np.diff(keys.astype(np.uint64))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), np.uint8)
    out[1:, :width] = steps
    out[0] = np.frombuffer(data, np.uint8, 8, 1)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def answered(blocks: DataFrame, replies: DataFrame, *more: str) -> DataFrame:
    """blocks with their replies (part, reply and ``more``) gathered: as many as there are parts, for each block."""
    own = replies.groupBy("block").agg(F.collect_list(F.struct("part", "reply", *more)).alias("replies"))
    return blocks.join(own, "block", "left")
