"""Shared helpers: table access, folds, scratch tables, Arrow text blocks and
vectorised hashing of words.

The hashing functions work on the raw UTF-8 bytes of many texts at once, so a
pass over the corpus costs a few numpy operations per byte and no Python
object per word.  Word identity is a 64-bit hash: with a billion distinct
words the chance that any two share one is about three per cent, with the ten
million of a large monolingual corpus about 3e-6.
"""

from __future__ import annotations

import ctypes
import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

BROADCAST_ROWS = 2_000_000     # rows of one or two numbers that may be broadcast
BATCH_ROWS = 2_000             # rows of a batch handed to Python
BLOCK_BYTES = 1 << 20          # text bytes that one vectorised block holds


def short_batches(spark: SparkSession) -> None:
    """Rows here are long texts: unless the session says otherwise, hand them
    to Python in batches of ``BATCH_ROWS`` instead of Spark's 10,000, which
    bounds the Arrow buffers on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def crc_fold(id_col: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a NULL id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % F.lit(k)


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts
    lineage, survives lost executors and feeds several later passes."""
    short_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted ``rows`` are within the bound; beyond
    it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def worker_cache() -> dict:
    """State that outlives a task in its Python worker (functions of this
    package arrive anew with every task)."""
    name = "_panelforge_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on and
    would otherwise keep the peak of every operator it has served."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# --------------------------------------------------------------------------
# Arrow text batches -> byte blocks

def text_blocks(batch: pa.RecordBatch, column: str, max_bytes: int = BLOCK_BYTES):
    """Split a batch into runs of rows with at most ``max_bytes`` of text (one
    row at least).  Yields ``(first, stop, bytes, offsets)`` with the rows'
    UTF-8 bytes as uint8 and int64 offsets; NULL counts as empty text."""
    arr = batch.column(column)
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if len(arr) == 0:
        return
    _, off_buf, data_buf = arr.buffers()
    off = np.frombuffer(off_buf, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(arr):
        stop = int(np.searchsorted(off, off[first] + max_bytes, "right")) - 1
        stop = min(max(stop, first + 1), len(arr))
        lo, hi = off[first], off[stop]
        yield first, stop, data[lo:hi], off[first:stop + 1] - lo
        first = stop
    release()


# --------------------------------------------------------------------------
# word hashing

def byte_table(separators: bytes) -> np.ndarray:
    """256 entries: 0 for separators, else the byte with A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    t[0] = 0
    return t


#: words are runs without ASCII white space (NUL separates too)
SPACED = byte_table(bytes([32, *range(9, 14)]))
#: words are runs of ASCII letters and digits and of non-ASCII characters
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61),
                          *range(0x7B, 0x80)]))

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_cache()
    if kept.get("powers", (0,))[0] < n:
        size = -(-n // BLOCK_BYTES) * BLOCK_BYTES
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        kept["powers"] = size, up, down
    return kept["powers"][1:]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray):
    """First and stop byte of every word of a block in text order, and the
    folded bytes.  ``lut`` (see ``byte_table``) folds case and names separators."""
    folded = lut[data]
    inside = folded != 0
    breaks = offsets[1:-1][offsets[1:-1] < len(data)]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[breaks] |= inside[breaks]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    prev = breaks[breaks > 0] - 1
    stop[prev] |= inside[prev]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1, folded


def span_hashes(starts: np.ndarray, ends: np.ndarray, folded: np.ndarray) -> np.ndarray:
    """Hash of the folded bytes of every span."""
    up, down = _power_tables(len(folded) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(folded) + 1, np.uint64)
        np.cumsum(folded * up[:len(folded)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray):
    """Hashes of all words of a block in text order, and the number of words
    of each row.  Large blocks are hashed in pieces of whole rows."""
    n_rows = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_rows, np.int64)
    hashes, counts, a = [], [], 0
    while a < n_rows:
        b = int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1
        b = min(max(b, a + 1), n_rows)
        off = offsets[a:b + 1] - offsets[a]
        part = data[offsets[a]:offsets[b]]
        if len(part):
            starts, ends, folded = word_spans(part, off, lut)
            hashes.append(span_hashes(starts, ends, folded))
            counts.append(np.diff(np.searchsorted(starts, off)))
        else:
            counts.append(np.zeros(b - a, np.int64))
        a = b
    return np.concatenate(hashes), np.concatenate(counts)


class HashIndex:
    """Sorted distinct uint64 keys with a radix directory: vectorised lookup
    in about two probes instead of a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, int(max(len(keys), 1)).bit_length() + 1)
        self.shift = np.uint64(64 - self.bits)
        edges = np.arange((1 << self.bits) + 1, dtype=np.uint64)
        top = keys >> self.shift
        self.first = np.searchsorted(top, edges).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash among the keys, -1 where absent."""
        out = np.full(len(h), -1, np.int32)
        if len(self.keys) == 0 or len(h) == 0:
            return out
        slot = (h >> self.shift).astype(np.int64)
        pos, end = self.first[slot], self.first[slot + 1]
        todo = np.flatnonzero(pos < end)
        pos, end, want = pos[todo], end[todo], h[todo]
        while len(todo):
            hit = self.keys[pos] == want
            out[todo[hit]] = pos[hit]
            go = ~hit & (pos + 1 < end)
            todo, pos, end, want = todo[go], pos[go] + 1, end[go], want[go]
        return out


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` with the given lengths (0 for an
    empty run); float64, along axis 0."""
    out = np.zeros((len(counts),) + values.shape[1:], np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        ends = np.cumsum(counts)
        out[full] = np.add.reduceat(values, (ends - counts)[full], axis=0, dtype=np.float64)
    return out


def pack(a: np.ndarray) -> bytes:
    """Compress an integer array by byte planes (little-endian, zstd)."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(b: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    size = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], size, codec="zstd", asbytes=True) if size else b""
    planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
