"""Token counts of documents in flat token files that have no index, by a scan for separators.

A file is ids of 2 or 4 bytes, little-endian, each document closed by the end-of-document id.  Files are cut
into blocks; a block's separators are found by one vector comparison.  A prefix scan over the blocks of a
file (running maximum of separator positions, running count of separators) then gives each block the place
where the document that runs into it began and the ordinal of its first document, so documents may span
any number of blocks.  Blocks are the unit of work; each is read once, by its own task, and the scan runs over one
small row for each block, range by range (common.running), so no task gets a whole file or all of its separators.

Defined results: two separators in a row are an empty document of 0 tokens; ids after the last separator are
a document with complete = false; an empty file has none; a null text is an empty document; ids of the
manifest may be null or repeat; repeated rows are documents of their own; very long documents span blocks; an
empty table gives no rows.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as C
from quillon.llm.encoder import encoder
from quillon.llm.id_files import ENCODE_BYTES, _publish, open_folder

BLOCK_IDS = 1 << 21


def write_flat(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One flat file a partition, without a shuffle.  The manifest has path, width, n_ids, and the packed ids of its documents in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, keys, count = encoder(vocabulary, True), [], [0]

        def pour(out) -> None:
            for part in C.gathered(batches, "_text", ENCODE_BYTES):
                ids, size = enc.encode(part["_text"])
                if end_id in ids:
                    raise ValueError("a text holds the end-of-document id")
                out.write(np.insert(ids, np.cumsum(size), end_id).astype(enc.dtype).tobytes())
                keys.append(part["_id"])
                count[0] += len(ids) + len(size)

        path = _publish(folder, f"{TaskContext.get().partitionId():07d}.ids", pour)
        if keys:
            key = pa.concat_arrays(keys)
            packed = np.asarray(key.is_null()).astype(np.uint8).tobytes() + key.fill_null(0).to_numpy().astype("<i8").tobytes()
            yield pa.RecordBatch.from_pydict({"path": [path], "width": pa.array([enc.width], pa.int32()), "n_ids": pa.array([count[0]], pa.int64()), "doc_ids": [zlib.compress(packed, 1)]})

    rows = C.small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = "path string, width int, n_ids long, doc_ids binary"
    manifest = f"{folder.rstrip('/')}/manifest"
    rows.mapInArrow(C.tidy(write), schema).write.mode("overwrite").parquet(manifest)
    return docs.sparkSession.read.schema(schema).parquet(manifest)


def scan(files: DataFrame, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """path, ordinal, start, n_tokens and complete of each document; files has path, width and n_ids."""
    blocks = files.filter("n_ids > 0").select("path", "width", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ids - 1) div {block_ids}"))).alias("block"))
    blocks = blocks.repartition(F.col("path"), F.col("block"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = open_folder(row["path"])
                at, w = row["block"] * block_ids, row["width"]
                with fs.open_input_file(name) as f:
                    f.seek(at * w)
                    ids = np.frombuffer(f.read(min(block_ids, row["n_ids"] - at) * w), f"<u{w}")
                here = np.flatnonzero(ids == end_id) + at
                yield pa.RecordBatch.from_pydict({
                    "path": [row["path"]], "n_ids": pa.array([row["n_ids"]], pa.int64()), "block": pa.array([row["block"]], pa.int64()),
                    "ends": pa.array([here], pa.list_(pa.int64())), "n": pa.array([len(here)], pa.int64()), "last": pa.array([int(here[-1]) if len(here) else None], pa.int64()),
                })

    found = C.materialize(blocks.mapInArrow(C.tidy(find), "path string, n_ids long, block long, ends array<long>, n long, last long"), "separators")
    carried = C.running(found.select("path", "block", "n", "last"), ["path"], "block", {"_last": ("max", "last"), "_base": ("sum", "n")}).select("path", "block", F.coalesce(F.col("_last") + 1, F.lit(0)).alias("_from"), F.coalesce("_base", F.lit(0)).alias("_base"))
    stitched = found.filter("n > 0").join(carried, ["path", "block"])
    closed = stitched.select("path", "_base", "_from", "ends", F.posexplode("ends").alias("_k", "_end")).select(
        "path", (F.col("_base") + F.col("_k")).alias("ordinal"),
        F.when(F.col("_k") == 0, F.col("_from")).otherwise(F.try_element_at("ends", F.greatest(F.col("_k"), F.lit(1))) + 1).alias("start"), "_end",
    ).select("path", "ordinal", "start", (F.col("_end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("complete"))
    rest = found.groupBy("path").agg(F.max("n_ids").alias("_n"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"), F.sum("n").alias("ordinal")).filter("_n > start")
    return closed.unionByName(rest.select("path", "ordinal", "start", (F.col("_n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete")))


def end_of(vocabulary: str, token: str = "<|endoftext|>") -> int:
    """The id of a vocabulary's end-of-document token."""
    found = encoder(vocabulary, True).tok.token_to_id(token)
    if found is None:
        raise ValueError(f"{vocabulary} has no token {token}")
    return found


def count_documents(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, n_tokens, file and ordinal of each document, counted in the flat files that are written first."""
    manifest = write_flat(docs, folder or C.new_path(docs.sparkSession, "flat"), vocabulary, end_id)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = zlib.decompress(row["doc_ids"])
                n = len(raw) // 9
                null = np.frombuffer(raw, np.uint8, n).astype(bool)
                yield pa.RecordBatch.from_pydict({"path": [row["path"]] * n, "ordinal": pa.array(np.arange(n)), "doc_id": pa.array(np.frombuffer(raw, "<i8", n, n), mask=null)})

    names = manifest.select("path", "doc_ids").mapInArrow(C.tidy(unfold), "path string, ordinal long, doc_id long")
    # the packed ids look far smaller to the planner than what they unfold to, a row a document: never broadcast them
    got = scan(manifest, end_id, block_ids).join(names.hint("merge"), ["path", "ordinal"])
    return got.select("doc_id", "n_tokens", F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "ordinal", "start", "complete")
