"""Line dedup by pairwise alignment.

Documents overlap if a line or a block of lines of one stands in the other, however common it is.  Of all
documents that hold a line or block, each later one is paired with the first (the one of smallest id), so pairs
are as many as shared seeds, not as pairs of copies: a line in a third of all documents gives each of them one
partner.  Seeds are lines of `seed_chars` bytes and, at each line, the shortest runs of lines that start and that
end there and reach `least_chars` bytes.  Every line of a common block of that size stands in such a run within the
block, so it is found with the first holder of the run, whichever documents hold the run's lines alone.  Each pair
is aligned by patience diff over line hashes (lines that are unique in both sides anchor the alignment, the
longest increasing chain of anchors is kept, equal neighbours extend it; what is left is aligned again, for blocks
that stand in another order), and aligned common blocks of at least `least_chars` bytes are deleted from the later
document.

Lines are compared without ASCII white space at their ends.  Defined results: a null or empty text has no
lines; a null id counts as later than every id and comes back null; rows of one id are not aligned with
each other, and equal rows of one id lose the same lines; of documents that tie as first holder of a line there is
only one id, the least; very long texts are aligned whole; an empty table gives an empty result.  Other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as C

SEED_CHARS, LEAST_CHARS = 20, 40
_LAST = np.iinfo(np.int64).max


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """(signed 64-bit hash, bytes) of each line."""
    raw = [x.strip() for x in text.encode().split(b"\n")] if text else []
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in raw], [len(x) for x in raw]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned equal lines of a and b, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        ca, cb = Counter(a[i:i2]), Counter(b[j:j2])
        where = {b[k]: k for k in range(j, j2) if cb[b[k]] == 1}
        both = [(k, where[a[k]]) for k in range(i, i2) if ca[a[k]] == 1 and a[k] in where]
        if not both:
            continue
        tails, back, last = [], [], []
        for n, (_, y) in enumerate(both):
            k = bisect_left(tails, y)
            back.append(last[k - 1] if k else -1)
            if k == len(tails):
                tails.append(y)
                last.append(n)
            else:
                tails[k], last[k] = y, n
        chain, n = [], last[-1]
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        chain.reverse()
        ends = [(i, j), *((x + 1, y + 1) for x, y in chain)]
        for (x, y), (x2, y2) in zip(ends, [*chain, (i2, j2)], strict=True):
            todo.append((x, x2, y, y2))
        out.extend(chain)
    return sorted(out)


def common_blocks(a: list[int], size: list[int], b: list[int], least_chars: int) -> list[int]:
    """Lines of a in aligned blocks of at least least_chars bytes.

    One alignment keeps the order of both sides; what is left of a is aligned once more as long as blocks are found,
    so that blocks that stand in another order are found too.
    """
    out, left = [], list(a)
    there = set(b)
    while True:
        found, block, before = [], [], None
        for i, j in [*patience(left, b), (-1, -1)]:
            if before is not None and (i, j) != (before[0] + 1, before[1] + 1):
                if sum(size[k] for k in block) >= least_chars:
                    found.extend(block)
                block = []
            block.append(i)
            before = (i, j)
        if not found:
            return sorted(out)
        out.extend(found)
        for k in found:
            left[k] = None  # equal to no line
        if sum(s for x, s in zip(left, size, strict=True) if x in there) < least_chars:
            return sorted(out)


def seeds_of(lines: list[int], sizes: list[int], seed_chars: int, least_chars: int) -> np.ndarray:
    """Distinct hashes of the lines of seed_chars bytes, and of the shortest runs from and up to each line that reach least_chars."""
    packed, size = np.array(lines, np.int64), np.array(sizes, np.int64)
    raw, end = packed.tobytes(), np.r_[0, np.cumsum(size)]
    at = np.arange(len(size))
    stop = np.maximum(np.searchsorted(end, end[:-1] + least_chars), at + 1)  # the run from i is lines i to stop[i] - 1
    start = np.minimum(np.searchsorted(end, end[1:] - least_chars, side="right") - 1, at)  # the run up to i is lines start[i] to i
    whole = stop <= len(size)
    runs = {*zip(at[whole].tolist(), stop[whole].tolist(), strict=True), *zip(start[start >= 0].tolist(), (at[start >= 0] + 1).tolist(), strict=True)}
    found = [lines[i] if j == i + 1 else xxhash.xxh3_64_intdigest(raw[8 * i : 8 * j]) - (1 << 63) for i, j in runs]
    return np.unique(np.r_[packed[size >= seed_chars], np.array(found, np.int64)])


def _seeds(seed_chars: int, least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [seeds_of(a, s, seed_chars, least_chars) for a, s in zip(batch["lines"].to_pylist(), batch["sizes"].to_pylist(), strict=True)]
            at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
            yield pa.RecordBatch.from_pydict({"_id": batch["_id"].take(at), "_k": batch["_k"].take(at), "line": pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))})

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [line_hashes(t) for t in batch["_text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"_id": batch["_id"], "_k": batch["_k"], "lines": pa.array([h for h, _ in got], pa.list_(pa.int64())), "sizes": pa.array([s for _, s in got], pa.list_(pa.int32()))})


def _align(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [common_blocks(a, s, b, least_chars) for a, s, b in zip(*(batch[c].to_pylist() for c in ("lines", "sizes", "first")), strict=True)]
            yield pa.RecordBatch.from_pydict({"_id": batch["_id"], "_k": batch["_k"], "gone": pa.array(gone, pa.list_(pa.int32()))})

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kept, n, removed = batch["_text"].to_pylist(), [], [], []
        for text, gone in zip(texts, batch["gone"].to_pylist(), strict=True):
            lines = text.split("\n") if text else []
            n.append(len(lines))
            removed.append(len(gone or ()))
            drop = set(gone or ())
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
        yield pa.RecordBatch.from_pydict({"_out": batch["_out"], "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})


def remove_common_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed_chars: int = SEED_CHARS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """id_col, n_lines, n_removed and kept_text of each row."""
    rows = C.small_batches(docs).select(F.col(id_col).cast("long").alias("_out"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_k", F.xxhash64("_text"))
    seqs = C.materialize(rows.select("_id", "_k", "_text").mapInArrow(C.tidy(_sequences), "_id long, _k long, lines array<long>, sizes array<int>").dropDuplicates(["_id", "_k"]), "lines")
    seeds = C.materialize(seqs.select("_id", "_k", "lines", "sizes").mapInArrow(C.tidy(_seeds(seed_chars, least_chars)), "_id long, _k long, line long"), "seeds")
    first = seeds.groupBy("line").agg(F.min("_id").alias("own"), F.max("_id").alias("last")).filter("own < last").select("line", "own")
    pairs = seeds.join(first, "line").filter("own < _id").select("_id", "_k", "own").distinct()
    owners = seqs.select(F.col("_id").alias("own"), F.col("lines").alias("first"))
    both = pairs.select("_id", "_k", "own").join(owners, "own").join(seqs, ["_id", "_k"]).select("_id", "_k", "lines", "sizes", "first")
    gone = both.mapInArrow(C.tidy(_align(least_chars)), "_id long, _k long, gone array<int>").filter(F.size("gone") > 0)
    # one row for each line of a document at most, however many partners found it
    gone = C.materialize(gone.select("_id", "_k", F.explode("gone").alias("line")).distinct().groupBy("_id", "_k").agg(F.collect_list("line").alias("gone")), "gone")
    # a merge join at every size: what is removed grows with the corpus, so it is never broadcast
    out = rows.join(gone.hint("merge"), ["_id", "_k"], "left").select("_out", "_text", "gone").mapInArrow(C.tidy(_keep), "_out long, n_lines long, n_removed long, kept_text string")
    return out.withColumnRenamed("_out", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the sha256 of the kept text."""
    return remove_common_blocks(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
