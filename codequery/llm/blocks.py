"""Documents as packed blocks of bounded bytes, and the compact rows that blocks and key ranges exchange.

A block is what one Python call holds in memory: consecutive rows of a partition, whole and with all their columns,
compressed into one value. Blocks are written once, so that every later pass over the documents reads the same ones,
and no text is shuffled to form them. Blocks send sorted 64-bit keys to ranges of the key space and get answers back
in their own order; the number of ranges is bounded, so the rows in between grow no faster than the bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Blocks of one partition are numbered below 1 << SEQ_BITS.
SEQ_BITS = 14
#: Beyond so many ranges a block's share of one would be a few hundred bytes.
MAX_RANGES = 1 << 17
#: Keys that go to one range of the key space, or so.
RANGE_BYTES = 16 << 20


def ipc(rows: pa.Table, level: int = 1) -> bytes:
    """The rows compressed, at zstd's level."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def opened(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


def _packs(block_bytes: int, make, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, held, size = TaskContext.get().partitionId() << SEQ_BITS, [], 0
    seq = 0

    def pack():
        nonlocal seq, held, size
        if seq >> SEQ_BITS:
            raise ValueError("a partition has too many blocks; read it in smaller splits")
        rows = pa.Table.from_batches(held)
        out = pa.RecordBatch.from_arrays([pa.array([first + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([make(rows)], pa.binary())], ["block", "bytes", "pack"])
        seq, held, size = seq + 1, [], 0
        return out

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rest = batch.slice(at)
            n = rest.num_rows
            if size + rest.nbytes > block_bytes and n > 1:
                n = max(1, min(n, int(n * max(0, block_bytes - size) / rest.nbytes)))
            held.append(rest.slice(0, n))
            size += held[-1].nbytes
            at += n
            if size >= block_bytes:
                yield pack()
    if held:
        yield pack()


def blocks(docs: DataFrame, block_bytes: int, make=ipc) -> DataFrame:
    """(block, bytes, pack): the rows in blocks of about so many bytes; no rows, no blocks.

    make turns the rows of a block into the bytes that later passes read.
    """
    return docs.mapInArrow(partial(_packs, block_bytes, make), "block long, bytes long, pack binary")


def packed(docs: DataFrame, block_bytes: int, make=ipc) -> DataFrame:
    """blocks(), written in the shared folder."""
    return stored(blocks(docs, block_bytes, make))


def ranges_for(packs: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """How many ranges the keys of these blocks are dealt into."""
    total = packs.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return int(min(MAX_RANGES, max(1, -(-total // range_bytes))))


def bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of the key space begins and ends in sorted unsigned 64-bit keys."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))


def _width(most: int) -> int:
    return next(w for w in (1, 2, 3, 4, 5, 6, 7, 8) if most < 1 << 8 * w)


def put_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in the fewest bytes that hold the largest; the first byte says how many."""
    if not len(x):
        return b""
    width = _width(int(x.max()))
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def get_numbers(data: bytes) -> np.ndarray:
    """int64 numbers of put_numbers()."""
    return _numbers(data).astype(np.int64)


def _numbers(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, "<u8")
    narrow = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, : data[0]] = narrow
    return wide.view("<u8").ravel()


def put_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys: the first, then the steps."""
    return keys[:1].tobytes() + put_numbers(np.diff(keys)) if len(keys) else b""


def get_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], "<u8"), _numbers(data[8:])]), dtype=np.uint64)
