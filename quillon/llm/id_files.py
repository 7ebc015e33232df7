"""Token-id shards with a minimal perfect hash index, and flat token files.

A shard holds the documents of one range of ids in ascending order.  Its file is

    8 bytes   magic "QIDSHRD1"
    6 x u64   id width in bytes, rows, ids, distinct keys, bytes of the index, keys in the overflow list
    payload   ids, little-endian, `width` bytes each, every document closed by the end id
    rows      u64 first id of each row and a closing one; i64 key of each row; u8 key is null
    index     u8 levels, then for each level u64 bits, its bit array and a u32 running count per 512 bits;
              u32 fingerprint, u32 first row and u32 rows of each slot; i64 overflow keys

The index is a minimal perfect hash of cascaded bit arrays: at each level a key that shares its bit with no
other key settles there, the rest go on; a slot is the rank of the bit.  A lookup is a bit test a level
(1.6 on average), a rank, and a comparison of the stored fingerprint, which turns away foreign keys but one
in 2^32.  The payload is raw: ids of width 2 where the vocabulary has at most 65,536 entries, else 4.

Files are written under a name of the task's attempt and then renamed, so a repeated task replaces its own
file and a reader never sees half of one.  The folder's file system must be one that pyarrow.fs opens.

Defined results: a null text is empty (its row holds the end id alone); rows of one id stay together, in
the order of a hash of their texts, and a lookup returns them all; rows without an id come first and are
found by no key; very long texts are encoded whole and make their shard as large as they are; an empty table
gives no shard rows.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import io
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common as C
from quillon.llm.encoder import encoder

MAGIC = b"QIDSHRD1"
LEVELS = 24
GAMMA = 2.0
#: Bytes of text in a shard, about.
SHARD_BYTES = 8 << 20
_ROWS_A_BATCH = 1000
#: Bytes of text that are encoded at once, about.
ENCODE_BYTES = 7 << 20


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def _publish(folder: str, name: str, write) -> str:
    """Write folder/name through write(stream) and rename it into place."""
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    ctx = TaskContext.get()
    temp = posixpath.join(base, f".{name}.{ctx.taskAttemptId() if ctx else 0}")
    with fs.open_output_stream(temp) as out:
        write(out)
    target = posixpath.join(base, name)
    fs.move(temp, target)
    return f"{folder.rstrip('/')}/{name}"


# ---------------------------------------------------------------- minimal perfect hash


class PerfectHash:
    """Slot 0 .. n-1 of each of n distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray], overflow: np.ndarray):
        self.levels, self.overflow = levels, overflow  # bits of each level as 64-bit words
        self.ranks, at = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(at + np.cumsum(ones) - ones)
            at += int(ones.sum())
        self.settled = at

    @staticmethod
    def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (C.mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.unique(keys.astype(np.uint64)), []
        while len(left) and len(levels) < LEVELS:
            words = max(1, int(len(left) * GAMMA + 63) // 64)
            spot = cls._spot(left, len(levels), words * 64)
            alone = np.bincount(spot, minlength=words * 64)[spot] == 1
            bits = np.zeros(words * 64, np.uint8)
            bits[spot[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        return cls(levels, np.sort(left.astype(np.int64)))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a foreign key -1 or any slot."""
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            spot = self._spot(keys[left], i, len(bits) * 64)
            word, bit = spot >> 6, (spot & 63).astype(np.uint64)
            here = ((bits[word] >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.ranks[i][word] + below)[here]
            left = left[~here]
        if len(left) and len(self.overflow):
            k = keys[left].view(np.int64)
            at = np.minimum(np.searchsorted(self.overflow, k), len(self.overflow) - 1)
            hit = self.overflow[at] == k
            out[left[hit]] = self.settled + at[hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (C.mix(np.asarray(keys).astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("<u4")


# ---------------------------------------------------------------- shards


def shard_bytes(width: int, payload: list[bytes], first: np.ndarray, keys: np.ndarray, null: np.ndarray) -> Iterator[bytes]:
    """The parts of a shard file; keys ascend, null ones first."""
    lead = int(null.sum())
    distinct, at, count = np.unique(keys[lead:], return_index=True, return_counts=True)
    ph = PerfectHash.build(distinct.view(np.uint64))
    slot = ph.slot(distinct)
    table = np.zeros((3, len(distinct)), "<u4")
    table[0][slot], table[1][slot], table[2][slot] = fingerprint(distinct), at + lead, count
    index = io.BytesIO()
    index.write(bytes([len(ph.levels)]))
    for bits, rank in zip(ph.levels, ph.ranks, strict=True):
        index.write(np.uint64(len(bits)).tobytes() + bits.tobytes() + rank[::8].astype("<u4").tobytes())
    index.write(table.tobytes() + ph.overflow.astype("<i8").tobytes())
    yield MAGIC + np.array([width, len(keys), first[-1], len(distinct), index.tell(), len(ph.overflow)], "<u8").tobytes()
    yield from payload
    yield first.astype("<u8").tobytes() + keys.astype("<i8").tobytes() + null.astype(np.uint8).tobytes()
    yield index.getvalue()


class Shard:
    """A shard file opened for reading: get(keys) by the index, or rows()."""

    def __init__(self, path: str):
        self.fs, name = open_folder(path)
        self.file = self.fs.open_input_file(name)
        head = self.file.read(8 + 48)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no id shard")
        self.width, self.rows, self.ids, self.n_keys, n_index, n_over = map(int, np.frombuffer(head[8:], "<u8"))
        self.dtype, self.base = np.dtype(f"<u{self.width}"), 56
        self.file.seek(self.base + self.ids * self.width)
        self.first = np.frombuffer(self.file.read(8 * (self.rows + 1)), "<u8").astype(np.int64)
        self.keys = np.frombuffer(self.file.read(8 * self.rows), "<i8")
        self.null = np.frombuffer(self.file.read(self.rows), np.uint8).astype(bool)
        raw, at, levels = self.file.read(n_index), 1, []
        for _ in range(raw[0]):
            n = int(np.frombuffer(raw, "<u8", 1, at)[0])
            levels.append(np.frombuffer(raw, "<u8", n, at + 8))
            at += 8 + 8 * n + 4 * ((n + 7) // 8)
        self.table = np.frombuffer(raw, "<u4", 3 * self.n_keys, at).reshape(3, -1)
        self.hash = PerfectHash(levels, np.frombuffer(raw, "<i8", n_over, at + 12 * self.n_keys))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, rows) of each key; 0 rows if the fingerprint says that it is not here."""
        slot = self.hash.slot(keys)
        known = slot >= 0
        known[known] = self.table[0][slot[known]] == fingerprint(np.asarray(keys)[known])
        row, n = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        row[known], n[known] = self.table[1][slot[known]], self.table[2][slot[known]]
        return row, n

    def read(self, first_id: int, last_id: int) -> np.ndarray:
        self.file.seek(self.base + first_id * self.width)
        return np.frombuffer(self.file.read((last_id - first_id) * self.width), self.dtype)

    def get(self, key: int) -> list[np.ndarray]:
        (row,), (n,) = self.find(np.array([key], np.int64))
        return [self.read(self.first[r], self.first[r + 1]) for r in range(row, row + n)]


MANIFEST = "shard int, path string, n_rows long, n_ids long, least_key long, most_key long"


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text and write the shards; the manifest (one row a shard) as a table in the folder."""
    n = C.chunk_count(docs, text_col, text_bytes)[0]
    rows = C.small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.repartitionByRange(n, F.col("_id"), F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, payload, sizes, keys = encoder(vocabulary), [], [], []
        for part in C.gathered(batches, "_text", ENCODE_BYTES):
            ids, size = enc.encode(part["_text"])
            ids = np.insert(ids, np.cumsum(size), end_id)
            payload.append(ids.tobytes())
            sizes.append(size + 1)
            keys.append(part["_id"])
        if not sizes:
            return
        size = np.concatenate(sizes)
        key = pa.concat_arrays(keys)
        null = np.asarray(key.is_null())
        key = key.fill_null(0).to_numpy()
        shard = TaskContext.get().partitionId()
        path = _publish(folder, f"{shard:07d}.qids", lambda out: [out.write(x) for x in shard_bytes(enc.width, payload, np.r_[0, np.cumsum(size)], key, null)])
        some = key[~null]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_rows": [len(size)], "n_ids": [int(size.sum())], "least_key": pa.array([int(some[0]) if len(some) else None], pa.int64()), "most_key": pa.array([int(some[-1]) if len(some) else None], pa.int64())})

    manifest = f"{folder.rstrip('/')}/manifest"
    rows.mapInArrow(C.tidy(write), MANIFEST).write.mode("overwrite").parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, found by its key through the index: doc_id, start, n_tokens, ids_crc32, shard."""
    placed = C.running(manifest.withColumn("_all", F.lit(0)), ["_all"], "shard", {"_before": ("sum", "n_ids")}).withColumn("_before", F.coalesce("_before", F.lit(0)))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                lead = int(shard.null.sum())
                keys = np.unique(shard.keys[lead:])
                first, count = shard.find(keys)
                if count.sum() != shard.rows - lead or not (shard.keys[first] == keys).all():
                    raise ValueError(f"{row['path']}: the index does not give back the keys of the rows")
                order = np.r_[np.arange(lead), C.ragged(first, count)]
                for part in np.array_split(order, max(1, len(order) // _ROWS_A_BATCH)):
                    if not len(part):
                        continue
                    at = shard.first[part[0]]  # rows are in the order of their keys, so a part is one range of the payload
                    ids = shard.read(at, shard.first[part[-1] + 1]).astype("<u4")
                    crc = [zlib.crc32(ids[shard.first[r] - at : shard.first[r + 1] - at]) for r in part]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(shard.keys[part], pa.int64(), mask=shard.null[part]), "start": pa.array(row["_before"] + shard.first[part], pa.int64()),
                        "n_tokens": pa.array(shard.first[part + 1] - shard.first[part], pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array([row["shard"]] * len(part), pa.int32()),
                    })

    return placed.repartition(n).mapInArrow(C.tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """Ids of the documents with these keys: doc_id, ids.  Only shards whose range holds a key are opened."""
    wanted = np.unique(np.asarray(keys, np.int64))
    near = manifest.filter(F.exists(F.lit(wanted.tolist()).cast("array<long>"), lambda k: k.between(F.col("least_key"), F.col("most_key"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, mine = Shard(row["path"]), wanted[(wanted >= row["least_key"]) & (wanted <= row["most_key"])]
                got = [(int(k), ids.astype(np.int64)) for k in mine for ids in shard.get(int(k))]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in got], pa.int64()), "ids": pa.array([x for _, x in got], pa.list_(pa.int64()))})

    return near.mapInArrow(C.tidy(read), "doc_id long, ids array<long>")


def encode_and_read(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """write_shards(), then read_shards()."""
    spark: SparkSession = docs.sparkSession
    return read_shards(write_shards(docs, folder or C.new_path(spark, "ids"), vocabulary, end_id))
