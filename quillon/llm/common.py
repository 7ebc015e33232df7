"""Shared parts of the training-data operators: shared storage, words, hashes, chunked exchange."""

from __future__ import annotations

import ctypes
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.storage import materialize, new_path, shared_dir  # noqa: F401

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- memory

#: Most rows of an Arrow batch: texts may be long, and a worker holds a few batches.
BATCH_ROWS = 1000
pa.set_memory_pool(pa.system_memory_pool())  # so that what is freed can go back to the system
_trimmed = [0.0]


def trim(now: bool = False) -> None:
    """Give freed memory of this worker back, four times a second at most: idle workers are kept for later stages."""
    if now or time.monotonic() - _trimmed[0] > 0.25:
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:
            pass  # another C library
        _trimmed[0] = time.monotonic()


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20, rows: int = BATCH_ROWS):
    """Slices of a batch of about `most` bytes of text and `rows` rows, a row at least: what a kernel holds at once."""
    if not len(batch):
        return
    size = pa.compute.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.maximum((np.cumsum(size) - size) // most, 0) + np.arange(len(size)) // rows
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def gathered(batches, text: str, most: int):
    """Batches joined or cut to about `most` bytes of text each: kernels that look up each distinct word once gain by it."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch, text, most):
            held.append(part)
            size += pa.compute.sum(pa.compute.binary_length(part[text])).as_py() or 0
            if size >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    yield from pa.Table.from_batches(held).combine_chunks().to_batches() if held else []


def tidy(f):
    """f over an iterator of batches, followed by trim()."""

    def run(batches):
        yield from f(batches)
        trim(now=True)

    return run


def tidy_group(f):
    """f over a group, followed by trim()."""

    def run(table):
        out = f(table)
        trim()
        return out

    return run


def tidy_pair(f):
    """f over two groups of a key, followed by trim()."""

    def run(left, right):
        out = f(left, right)
        trim()
        return out

    return run


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands Python workers BATCH_ROWS rows at once at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


# ---------------------------------------------------------------- storage


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles() if shared_dir(spark).split("://")[-1].lstrip("/") in f}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)


#: Most ids that drop_ids() broadcasts (about 40 MB as a table of a join); beyond it the join is a shuffle.
IDS_TO_SEND = 250_000


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is among ids (one column); rows without an id stay."""
    ids = ids.toDF("_dropped").filter("_dropped is not null").distinct()
    ids = materialize(ids, "dropped")
    if ids.count() <= IDS_TO_SEND:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["_dropped"], "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running(df: DataFrame, by: list[str], order: str, before: dict[str, tuple[str, str]], width: int = 4096) -> DataFrame:
    """df with aggregates over all earlier rows (by `order`, a long from 0 on) of the same `by`, null in the first.

    before: for each new column "sum" or "max" and the column it is of.  Two levels: ranges of `width` rows are
    aggregated, a scan over the ranges gives what stands before each, and a scan within a range the rest; so no task
    gets all rows.
    """
    of = {"sum": F.sum, "max": F.max}
    part, inside = free_name(df, "_part"), {k: free_name(df, f"_in_{k}") for k in before}
    dealt = df.withColumn(part, F.expr(f"{order} div {width}"))
    here = Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, part).agg(*(of[how](c).alias(k) for k, (how, c) in before.items()))
    ranges = totals.select(*by, part, *(of[how](k).over(earlier).alias(k) for k, (how, _) in before.items()))
    both = dealt.withColumns({inside[k]: of[how](c).over(here) for k, (how, c) in before.items()}).join(ranges, [*by, part])
    plus = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).otherwise(F.col(a) + F.coalesce(b, F.lit(0)))
    return both.withColumns({k: plus(k, inside[k]) if how == "sum" else F.greatest(k, inside[k]) for k, (how, _) in before.items()}).select(*df.columns, *before)


# ---------------------------------------------------------------- words


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, step: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse, n at least; those of a common length are kept."""
    if not _tables:
        _tables.append((_powers(2 * _PIECE), _powers(2 * _PIECE, _BACK)))
    return _tables[0] if n <= 2 * _PIECE else (_powers(n), _powers(n, _BACK))


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of many texts: byte offsets of each word, and where each text's words begin."""

    def __init__(self, texts: pa.Array):
        trim()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = texts.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.data, self.text_off = data, off - off[0]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.text_off] = True
        solid = np.zeros(len(data) + 1, bool)
        solid[:-1] = ~_WS[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge))
        self.end = np.flatnonzero(before & (~solid | edge))
        self.off = np.searchsorted(self.start, self.text_off)

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.off)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.n)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, by its bytes (A-Z as a-z if lower)."""
        table = _BYTE_LOWER if lower else _BYTE
        out = np.zeros(len(self.start), np.uint64)
        if not len(out):
            return out
        size = self.end - self.start
        # a word's sum of byte * step^k is a difference of running sums, brought back by the inverse power of its start
        cuts = np.searchsorted(self.start, np.arange(_PIECE, len(self.data), _PIECE))
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(out)], strict=True):
            if a < b:
                lo, hi = int(self.start[a]), int(self.end[b - 1])
                power, back = _power_table(hi - lo)
                run = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(table[self.data[lo:hi]] * power[: hi - lo], out=run[1:])
                s = self.start[a:b] - lo
                out[a:b] = (run[self.end[a:b] - lo] - run[s]) * back[s]
        return mix(out + size.astype(np.uint64))


def rolling(h: np.ndarray, width: int, step: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Hash of each run of `width` consecutive hashes (by position; the caller masks runs that cross texts)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, s = np.zeros(n, np.uint64), np.uint64(step)
    for k in range(width):
        out *= s
        out += h[k : k + n]
    return mix(out)


# ---------------------------------------------------------------- chunks


def chunk_count(docs: DataFrame, text: str, chunk_bytes: int) -> tuple[int, int]:
    """(chunks, bytes of text): how many groups of about chunk_bytes the texts make."""
    got = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(1, -(-(got["b"] + 64 * got["n"]) // chunk_bytes)), got["b"]


def chunked(docs: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """id, text and _chunk.  A chunk is a function of a row and of the input partition that it lies in, so that rows
    that are equal in all respects do not all meet in one; all passes read the chunks from one shuffle."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.spark_partition_id()), F.lit(n)).cast("int").alias("_chunk"))


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit key by its high 32 bits: ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + size[i] - 1, for all i in turn."""
    size = np.asarray(size)
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(np.asarray(start) - first, size)
