"""Packed exchange between chunks of texts and hash-range buckets.

A chunk sends records of a fixed width, sorted by 64-bit keys, to the buckets of their keys; a bucket answers each
record with one of another width.  The records for one bucket travel as one block, a slice of one buffer, and blocks
are cut, joined and put in order by array operations alone: where chunks and buckets are so many that a block holds
one record, the exchange becomes a plain shuffle of records and nothing loops over blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.llm import common as C

#: _kind 0: records and answers; 1: marks that a chunk sends itself by way of some bucket.
BLOCK = "_chunk int, _bucket int, _kind int, _blob binary"
_SCHEMA = pa.schema([("_chunk", pa.int32()), ("_bucket", pa.int32()), ("_kind", pa.int32()), ("_blob", pa.binary())])


def _blocks(chunk, bucket, kind: int, data: np.ndarray, off: np.ndarray) -> pa.Table:
    """Blocks of data, cut at off."""
    n = len(off) - 1
    blob = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    wide = lambda x: pa.array(np.full(n, x, np.int32) if np.isscalar(x) else np.asarray(x, np.int32))
    return pa.table([wide(chunk), wide(bucket), wide(kind), blob], schema=_SCHEMA)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all blobs in turn, offsets)."""
    blob = table["_blob"].combine_chunks()
    if not len(blob):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
    raw = np.frombuffer(blob.buffers()[2], np.uint8) if blob.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def empty() -> pa.Table:
    return _SCHEMA.empty_table()


def columns(*parts: tuple[np.ndarray, int]) -> np.ndarray:
    """Records made of the low bytes of several arrays of 64-bit (or one-byte) values."""
    out = np.empty((len(parts[0][0]), sum(w for _, w in parts)), np.uint8)
    at = 0
    for values, width in parts:
        raw = values.reshape(-1, 1).view(np.uint8) if values.dtype.itemsize > 1 else values.astype(np.uint8).reshape(-1, 1)
        out[:, at : at + width] = raw[:, :width]
        at += width
    return out


def column(records: np.ndarray, at: int, width: int, dtype: str = "<u8") -> np.ndarray:
    """One value of each record, as 64-bit numbers."""
    out = np.zeros((len(records), 8), np.uint8)
    out[:, :width] = records[:, at : at + width]
    return out.reshape(-1).view(dtype)


def send(chunk: int, keys: np.ndarray, records: np.ndarray, n_buckets: int, marks: np.ndarray | None = None) -> pa.Table:
    """Blocks of the records (a row for each of the ascending keys), and the marks of the chunk."""
    bucket = C.buckets_of(keys, n_buckets)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    out = _blocks(chunk, bucket[first], 0, records, np.r_[first, len(keys)] * records.shape[1])
    if marks is None:
        return out
    packed = np.packbits(marks)
    return pa.concat_tables([out, _blocks(chunk, np.array([chunk % n_buckets]), 1, packed, np.array([0, len(packed)]))])


def answer(table: pa.Table, width: int, f: Callable[[np.ndarray], np.ndarray]) -> pa.Table:
    """What a bucket says: f of all its records, a row each, sent back as they came; marks pass through."""
    own = pc.equal(table["_kind"], 0)
    asked = table.filter(own)
    data, off = _flat(asked)
    back = f(data.reshape(-1, width)) if len(data) else np.zeros((0, 1), np.uint8)
    out = _blocks(asked["_chunk"].to_numpy(), asked["_bucket"].to_numpy(), 0, back, off // width * back.shape[1])
    return pa.concat_tables([out, table.filter(pc.invert(own)).select(_SCHEMA.names).cast(_SCHEMA)])


def answers(told: pa.Table, width: int) -> np.ndarray:
    """At a chunk: the answers, in the order of the keys that it sent."""
    mine = told.filter(pc.equal(told["_kind"], 0)).sort_by("_bucket")
    return _flat(mine)[0].reshape(-1, width)


def marks(told: pa.Table, n: int) -> np.ndarray:
    """The marks that this chunk sent itself."""
    data, _ = _flat(told.filter(pc.equal(told["_kind"], 1)))
    return np.unpackbits(data, count=n).astype(bool) if len(data) else np.zeros(n, bool)
