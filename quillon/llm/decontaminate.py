"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern of word positions, some of which are ignored; the hash of a window under a mask is the same
whatever stands at the ignored positions.  Every window of every benchmark item and every training document is hashed
under all masks; windows whose hashes agree seed a diagonal (offset of the document against the item), and each
diagonal is verified once: the best segment of it, where a matching word counts 1 and a substituted one -3, has to
reach `least` matching words (or `share` of a shorter item).  Several masks with their gaps at different places find
overlaps with substitutions that no run of equal words shows.

A benchmark of at most BENCH_WORDS words, counted first, is broadcast as a sorted table of seeds and the documents are
scanned in one pass without a shuffle.  A larger one is joined by hash (`joined`): chunks of documents ask the hash
ranges which of their windows the benchmark has, the windows that it has are joined with the seeds, and only texts
with a diagonal are moved; nothing of the benchmark is collected, and the documents are read in one pass whatever its
size.

Repeated words give many hits: diagonals are made distinct while hits are expanded, HITS at a time, and verified as
rows of one matrix, CELLS at a time, so that memory is bounded and no step is taken for each diagonal.

Defined results: null or empty texts and items match nothing.  Items shorter than a mask are seeded by masks of their
own length, without a gap and, from five words on, with a gap at each place.  Rows of one document id, equal or not,
each give their rows.  Rows of one item id are one item: one result for a document, its best overlap (most matching
words, then the shortest, then the first).  Null ids are given as they are, and items without an id are one item.
Empty tables give no rows; very long texts are taken whole.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as C
from quillon.llm import exchange as X

MASKS = ("1101101011", "1110010111", "1011101101")
BENCH_WORDS = 1_000_000
LEAST, SHARE, PENALTY = 13, 0.8, 3
HITS, CELLS = 1 << 21, 1 << 20
_BITS = 22
FOUND = "start long, item_start long, n_words long, n_matched long, n_item_words long"


def masked(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash under the mask of the window at each position."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.full(n, len(mask) * 1000003 + int(mask, 2), np.uint64), np.uint64(0x9FB21C651E98DF25)
    for k, bit in enumerate(mask):
        if bit == "1":
            out *= step
            out += h[k : k + n]
    return C.mix(out)


def masks_of(n: int) -> list[str]:
    """Masks of an item of n words, fewer than a mask of MASKS has."""
    return ["1" * n, *("1" * k + "0" + "1" * (n - k - 1) for k in range(n if n >= 5 else 0))]


def all_masks(short: set[int]) -> list[str]:
    return [*MASKS, *(m for n in sorted(short) for m in masks_of(n))]


def windows(w: C.Words, h: np.ndarray, mask: str, items: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the windows within one text; of items, only those that the mask is for."""
    x, owner = masked(h, mask), w.doc_of()
    inside = owner[: len(x)] == owner[len(mask) - 1 :][: len(x)]
    if items and mask not in MASKS:
        inside &= w.n[owner[: len(x)]] == len(mask)
    pos = np.flatnonzero(inside)
    return x[pos], pos


def best_overlap(own: np.ndarray, ref: np.ndarray, shifts: np.ndarray, least: int, share: float) -> tuple[int, int, int, int] | None:
    """(matching words, -words, -first word in the text, first word in the item) of the best of these diagonals that is long enough."""
    best, enough = None, max(1, min(least, int(np.ceil(share * len(ref)))))
    for part in np.array_split(shifts, -(-len(shifts) * len(ref) // CELLS) or 1):
        at = part[:, None] + np.arange(len(ref))
        same = (at >= 0) & (at < len(own))
        same &= own[np.clip(at, 0, len(own) - 1)] == ref
        run = np.zeros((len(part), len(ref) + 1), np.int64)
        np.cumsum(np.where(same, 1, -PENALTY), axis=1, out=run[:, 1:])
        low = np.minimum.accumulate(run, axis=1)
        row, end = np.arange(len(part)), np.argmax(run - low, axis=1)
        bottom = (run == low[row, end][:, None]) & (np.arange(len(ref) + 1) <= end[:, None])
        start = len(ref) - np.argmax(bottom[:, ::-1], axis=1)
        count = np.zeros_like(run)
        np.cumsum(same, axis=1, out=count[:, 1:])
        matching = count[row, end] - count[row, start]
        for i in np.flatnonzero(matching == max(enough, matching.max())):
            got = (int(matching[i]), int(start[i] - end[i]), -int(part[i] + start[i]), int(start[i]))
            best = got if best is None or got > best else best
    return best


class Seeds:
    """Items of a small benchmark, and their windows by hash."""

    def __init__(self, ids: list, texts: list):
        w = C.Words(pa.array(texts, pa.large_string()))
        self.ids, self.h, self.off = ids, w.hashes(lower=True), w.off
        self.masks = all_masks({int(n) for n in w.n if 0 < n < len(MASKS[0])})
        found = [windows(w, self.h, mask, True) for mask in self.masks]
        key, pos = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.argsort(key, kind="stable")
        item = np.repeat(np.arange(len(ids)), w.n)[pos]
        self.key, self.item, self.at = key[order].astype(np.uint64), item[order], (pos - self.off[item])[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.key & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def diagonals(self, w: C.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, shift) of each diagonal with a hit, distinct and in order."""
        text_of = w.doc_of()
        reach = int(w.n.max(initial=0)) + 1
        wide = reach + int(np.diff(self.off).max(initial=0)) + 1
        codes = []
        for mask in self.masks:
            x = masked(h, mask)
            maybe = np.flatnonzero(self.seen[(x & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            maybe = maybe[text_of[maybe] == text_of[maybe + len(mask) - 1]]
            a, b = np.searchsorted(self.key, x[maybe]), np.searchsorted(self.key, x[maybe], "right")
            hits = np.cumsum(b - a)
            cuts = np.searchsorted(hits, np.arange(HITS, int(hits[-1]) if len(hits) else 0, HITS))
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(maybe)], strict=True):
                seed, pos = C.ragged(a[i:j], (b - a)[i:j]), np.repeat(maybe[i:j], (b - a)[i:j])
                text = text_of[pos]
                codes.append(np.unique((text * len(self.ids) + self.item[seed]) * wide + (pos - w.off[text] - self.at[seed]) + wide - reach))
        code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        pair = code // wide
        return pair // max(1, len(self.ids)), pair % max(1, len(self.ids)), code % wide - (wide - reach)

    def overlaps(self, w: C.Words, least: int, share: float) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """(text, number of the item id's text, first word in the text, in the item, words, matching words, words of the item), the best of each text and item id."""
        h = w.hashes(lower=True)
        text, item, shift = self.diagonals(w, h)
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]) if len(text) else np.zeros(0, np.int64)
        best: dict[tuple, tuple] = {}
        for a, b in zip(first, np.r_[first[1:], len(text)][: len(first)], strict=True):
            t, i = int(text[a]), int(item[a])
            got = best_overlap(h[w.off[t] : w.off[t + 1]], self.h[self.off[i] : self.off[i + 1]], shift[a:b], least, share)
            if got and got > best.get((t, self.ids[i]), ((),))[0]:
                best[t, self.ids[i]] = (got, i)
        for (t, _), ((matching, size, at, item_at), i) in best.items():
            yield t, i, -at, item_at, -size, matching, int(self.off[i + 1] - self.off[i])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, share: float = SHARE, bench_words: int = BENCH_WORDS) -> DataFrame:
    """doc_id, item_id, start, item_start, n_words, n_matched and n_item_words of each document and item that overlap."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), F.col(item_text).alias("_text"))
    words = items.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("_text", F.lit("")), r"[\x20\x09-\x0D]+"))), F.lit(0)).alias("w")).first()["w"]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    if words > bench_words:
        out = joined(rows, items, least, share)
    else:
        got = items.sort("_item", "_text").collect()  # bench_words words at most
        sent = spark.sparkContext.broadcast(([r["_item"] for r in got], [r["_text"] for r in got]))
        out = C.small_batches(rows).mapInArrow(C.tidy(_scan(sent, least, share)), f"_id long, _item long, {FOUND}")
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})


def _scan(sent, least: int, share: float):
    opened: dict[str, Seeds] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "s" not in opened:
            opened["s"] = Seeds(*sent.value)
        seeds = opened["s"]
        for batch in batches:
            for part in C.pieces(batch, "_text"):
                got = list(seeds.overlaps(C.Words(part["_text"]), least, share)) if len(seeds.key) else []
                ids = part["_id"].to_pylist()
                cols = {"_id": [ids[g[0]] for g in got], "_item": [seeds.ids[g[1]] for g in got]}
                for j, name in enumerate(("start", "item_start", "n_words", "n_matched", "n_item_words"), 2):
                    cols[name] = [g[j] for g in got]
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()})

    return run


# ---------------------------------------------------------------- benchmarks of any size


def joined(docs: DataFrame, items: DataFrame, least: int, share: float, chunk_bytes: int | None = None) -> DataFrame:
    """The same rows by joins on hashes; docs: _id and _text, items: _item and _text."""
    total = C.chunk_count(docs, "_text", 1)[1] + C.chunk_count(items, "_text", 1)[1]
    size = chunk_bytes or min(8 << 20, max(1 << 20, total // 2000))
    n, n_buckets = max(1, -(-total // size)), max(1, -(-total // (8 * size)))
    n_words = F.size(F.filter(F.split(F.coalesce("_text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    masks = all_masks({r["n"] for r in items.select(n_words.alias("n")).filter(f"n > 0 and n < {len(MASKS[0])}").distinct().collect()})  # 9 rows at most

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "_text"):
                w = C.Words(part["_text"])
                h = w.hashes(lower=True)
                for mask in masks:
                    key, pos = windows(w, h, mask, True)
                    owner = w.doc_of()[pos]
                    yield pa.RecordBatch.from_pydict({"h": key.view(np.int64), "_bucket": pa.array(C.buckets_of(key, n_buckets).astype(np.int32)), "_item": part["_item"].take(pa.array(owner)), "_ik": part["_ik"].take(pa.array(owner)), "at": pos - w.off[owner]})

    keyed_items = items.withColumn("_ik", F.xxhash64("_item", "_text"))
    seeds = C.materialize(C.small_batches(keyed_items).mapInArrow(C.tidy(seeds_of), "h long, _bucket int, _item long, _ik long, at long").distinct(), "seeds")
    rows = C.chunked(docs, "_id", "_text", n).withColumn("_k", F.xxhash64("_id", "_text"))

    def keys_of(table: pa.Table) -> tuple[C.Words, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        w = C.Words(table["_text"])
        h = w.hashes(lower=True)
        found = [windows(w, h, mask, False) for mask in masks]
        return w, found, np.unique(np.concatenate([k for k, _ in found]))

    def ask(table: pa.Table) -> pa.Table:
        keys = keys_of(table)[2]
        return X.send(table["_chunk"][0].as_py(), keys, X.columns((keys, 8)), n_buckets)

    def tell(asked: pa.Table, had: pa.Table) -> pa.Table:
        known = had["h"].to_numpy().view(np.uint64) if len(had) else np.zeros(0, np.uint64)
        return X.answer(asked, 8, lambda r: np.isin(X.column(r, 0, 8), known).astype(np.uint8)[:, None]) if len(asked) else X.empty()

    def hits_of(table: pa.Table, told: pa.Table) -> pa.Table:
        out = {"h": [], "_id": [], "_k": [], "pos": []}
        if len(table):
            w, found, keys = keys_of(table)
            yes = keys[X.answers(told, 1)[:, 0] > 0]
            for key, pos in found:
                at = np.flatnonzero(np.isin(key, yes))
                owner = w.doc_of()[pos[at]]
                for name, v in (("h", pa.array(key[at].view(np.int64))), ("_id", table["_id"].combine_chunks().take(pa.array(owner))), ("_k", table["_k"].combine_chunks().take(pa.array(owner))), ("pos", pa.array(pos[at] - w.off[owner]))):
                    out[name].append(v)
        return pa.table({k: pa.chunked_array(v, pa.int64()) for k, v in out.items()})

    asked = rows.groupBy("_chunk").applyInArrow(C.tidy_group(ask), X.BLOCK)
    told = asked.groupBy("_bucket").cogroup(seeds.select("_bucket", "h").distinct().groupBy("_bucket")).applyInArrow(C.tidy_pair(tell), X.BLOCK)
    hits = rows.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(C.tidy_pair(hits_of), "h long, _id long, _k long, pos long")
    lines = hits.distinct().join(seeds.drop("_bucket"), "h").select("_k", "_id", "_ik", "_item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    lines = lines.groupBy("_k", "_id", "_ik", "_item").agg(F.collect_list("shift").alias("shifts"))  # as many as words of the two texts
    texts = rows.groupBy("_k").agg(F.min("_text").alias("own"))
    refs = keyed_items.groupBy("_ik").agg(F.min("_text").alias("ref"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "own", rows=50):
                a, b = C.Words(part["own"]), C.Words(part["ref"])
                ha, hb = a.hashes(lower=True), b.hashes(lower=True)
                got = [best_overlap(ha[a.off[i] : a.off[i + 1]], hb[b.off[i] : b.off[i + 1]], np.sort(np.array(s)), least, share) for i, s in enumerate(part["shifts"].to_pylist())]
                at = [i for i, g in enumerate(got) if g]
                some = pa.array(at, pa.int64())
                cols = {c: part[c].take(some) for c in ("_k", "_id", "_ik", "_item")}
                for name, f in (("start", lambda g: -g[2]), ("item_start", lambda g: g[3]), ("n_words", lambda g: -g[1]), ("n_matched", lambda g: g[0])):
                    cols[name] = pa.array([f(got[i]) for i in at], pa.int64())
                yield pa.RecordBatch.from_pydict({**cols, "n_item_words": pa.array(b.n[at], pa.int64())})

    both = C.small_batches(lines.join(texts, "_k").join(refs, "_ik")).select("_k", "_id", "_ik", "_item", "shifts", "own", "ref")
    found = both.mapInArrow(C.tidy(verify), f"_k long, _id long, _ik long, _item long, {FOUND}")
    better = F.struct("n_matched", -F.col("n_words"), -F.col("start"), "item_start", "_ik")
    names = [x.split()[0] for x in FOUND.split(", ")]
    best = found.groupBy("_k", "_item").agg(F.max_by(F.struct(*names), better).alias("_b"))
    return rows.select("_k", "_id").join(best, "_k").select("_id", "_item", "_b.*")
