"""Vectorised text work on Arrow buffers: words, 64-bit hashes, grouping of documents into blocks.

A *block* is a run of whole documents of about ``BLOCK_BYTES`` bytes taken from one
task's Arrow batches, so that memory is bounded by the block (or by one document, if
that is longer) and never by the partition. Words are maximal runs of bytes outside a
separator table; no byte of a multi-byte UTF-8 character is ever a separator.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import checkpointed

BLOCK_BYTES = 6_000_000
U64 = np.uint64
_M1, _M2, _M3 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)
_LOW_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Separators for similarity work: every ASCII byte that is no letter or digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit lanes."""
    h = h ^ (h >> U64(33))
    h = h * _M1
    h ^= h >> U64(33)
    h *= _M2
    h ^= h >> U64(33)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, back to back, and its n+1 offsets. Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, count=n + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    """Word i of the block is ``data[starts[i]:ends[i]]``; document d owns words ``first[d]:first[d+1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> Words:
    sep = separators[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(offsets), np.int64))
    before = np.empty(n, bool)
    before[0], before[1:] = True, sep[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, sep[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    np.logical_not(sep, out=sep)
    starts = np.flatnonzero(sep & before)
    ends = np.flatnonzero(sep & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def loads(data: np.ndarray) -> np.ndarray:
    """The little-endian 8 bytes that begin at each position (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,)))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes in every block."""
    at = loads(data) if at is None else at
    size = ends - starts
    h = mix(size.astype(U64) * _M3 + U64(seed * 2 + 1))
    live, pos, left = np.arange(len(starts)), starts, size
    while len(live):
        part = at[pos] & _LOW_MASK[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ part) * _M3 + _M1)
        more = left > 8
        live, pos, left = live[more], pos[more] + 8, left[more] - 8
    return h


def rolling(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Order-sensitive hash of each run of ``width`` consecutive values (runs may cross documents)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = U64((0x9E3779B97F4A7C15 * (2 * salt + 1) + 2 * salt) & (2**64 - 1) | 1)
    out = np.zeros(n, U64)
    for k in range(width):
        out *= base
        out += h[k : k + n]
    return mix(out ^ U64(width))


def valid_runs(first: np.ndarray, width: int) -> np.ndarray:
    """True for each start whose run of ``width`` words stays in one document."""
    total = int(first[-1]) if len(first) else 0
    n = max(0, total - width + 1)
    ok = np.zeros(n + 1, np.int64)
    size = np.diff(first)
    long = size >= width
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - width + 1, -1)
    return np.cumsum(ok)[:n] > 0


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum, np.maximum) over each run of ``width`` values, in log2(width) steps."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup a task's batches into tables of whole rows of about ``limit`` bytes of ``text``; a row counts 16 bytes at least."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        begin = 0
        for i, s in enumerate(sizes):
            if size and size + s > limit:
                held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, i
            size += int(s)
        if begin < len(sizes):
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def task_id() -> int:
    """The number of this task's partition, or 0 outside a task."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def to_bytes(table: pa.Table) -> bytes:
    """A table as one compressed value."""
    codec = pa.Codec("zstd", compression_level=3)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def from_bytes(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


#: A block's number is its task and its place in the task; a row's number is its block and its place in the block.
BLOCK_BITS = 20


def packed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` as stored blocks: block long, size long (bytes of text), n long (rows), body binary (the rows, compressed).

    Stored, so that a block stays what it is when a lost task runs again. What later steps find out about a block
    comes back to it by its number, and its rows travel compressed, one value a block."""

    def run(batches):
        for number, t in enumerate(blocks(batches, text)):
            size = pc.sum(pc.binary_length(t.column(text))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([(task_id() << BLOCK_BITS) + number]), pa.array([size]), pa.array([t.num_rows]), pa.array([to_bytes(t)], pa.binary())], ["block", "size", "n", "body"])

    return checkpointed(docs.mapInArrow(run, "block long, size long, n long, body binary"))


def with_answers(bodies: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks (block, body) and answers (block, part, answer), dealt by block; a block's rows lie together, its body
    first, with part -1. ``grouped`` splits them again."""
    both = bodies.select("block", F.lit(-1).cast("long").alias("part"), F.col("body").alias("answer")).unionByName(answers.select("block", "part", "answer"))
    return both.repartition("block").sortWithinPartitions("block", "part")


def longs(col, missing: int) -> np.ndarray:
    """An integer column as int64, with ``missing`` for null."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.int64()), missing).to_numpy(zero_copy_only=False).astype(np.int64)


NULL_ID = np.iinfo(np.int64).max


def ids_out(ids: np.ndarray) -> pa.Array:
    """int64 ids as a column in which ``NULL_ID`` is null again."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """Per document, its kept words joined by one space, as a string column."""
    kept = np.flatnonzero(keep)
    size = w.ends[kept] - w.starts[kept] + 1
    out_ends = np.cumsum(size)
    total = int(out_ends[-1]) if len(out_ends) else 0
    source = np.repeat(w.starts[kept] - (out_ends - size), size) + np.arange(total)
    data = np.r_[w.data, np.uint8(0x20)][source] if total else np.zeros(0, np.uint8)
    data[out_ends - 1] = 0x20
    upto = np.r_[0, np.cumsum(keep)][w.first]  # kept words before each document
    edge = np.r_[0, out_ends][upto]
    last = edge[1:][np.diff(upto) > 0] - 1  # the space after the last kept word of a document
    if total:
        data = np.delete(data, last)
    offsets = edge - np.r_[0, np.cumsum(np.diff(upto) > 0)]
    col = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return col.cast(pa.string())


def without(w: Words, gone: np.ndarray, offsets: np.ndarray, null: pa.Array) -> pa.Array:
    """Per document, its text without the words that are gone, each with the white space behind it; all other bytes stay."""
    n = len(w.data)
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(gone)
    if len(at):
        ahead = np.r_[w.starts[1:], n]
        last = np.zeros(len(gone), bool)
        last[w.first[1:][w.counts > 0] - 1] = True
        np.add.at(step, w.starts[at], 1)
        np.add.at(step, np.where(last, w.ends, ahead)[at], -1)
    keep = np.cumsum(step)[:-1] == 0
    new = np.r_[0, np.cumsum(keep)][offsets].astype(np.int64)
    col = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(new.tobytes()), pa.py_buffer(w.data[keep].tobytes())])
    return pc.if_else(null, pa.scalar(None, pa.string()), col.cast(pa.string()))


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.r_[True, col[1:] != col[:-1]]).tolist()
        for h, e in zip(heads, [*heads[1:], len(col)], strict=True):
            if held and col[h] != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(h, e - h))
            now = col[h]
    if held:
        yield pa.Table.from_batches(held)
