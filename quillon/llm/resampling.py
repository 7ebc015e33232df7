"""Quality by importance resampling.

Two generative models of hashed word n-grams, one of the target texts (those that the labelled table calls
good) and one of all raw texts, give each document its importance weight, the ratio of its likelihoods under
the two: the log weight is the sum over its n-grams of log p_target - log p_raw, divided by `temperature`
(1: the ratio itself; larger: closer to even sampling).  Documents are then sampled without replacement in
proportion to their weights by Gumbel top-k: a Gumbel number that is a function of the id is added, and the k
largest sums are kept.

N-grams are single words and pairs of neighbours (A-Z lower-cased), hashed into BUCKETS; a word that repeats
the one before it counts as one mark, whatever the word.  Counts cover every document: each task sums its
own and sends BUCKETS numbers at most.  k is found exactly, by counts of the leading bits of the sums, in
passes over (id, sum) rows; no sort, no window, nothing collected but the counts.

Defined results: a null or empty text has log weight 0; without target texts all weights are equal; rows
whose sums tie at the k-th are all kept, so repeated rows (same id, same text) are kept or left together; a
null id gets the Gumbel number of a null and is never a target; very long texts are counted whole; an empty
table gives an empty result.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as C

BUCKETS = 10_000
TEMPERATURE = 1.0
#: Most target ids that are broadcast to mark target texts (about 40 MB as a table of a join); beyond it the join is a shuffle.
LABELS_TO_SEND = 250_000
_REPEAT = np.uint64(0x2545F4914F6CDD1D)


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each n-gram."""
    w = C.Words(texts)
    h, text = w.hashes(lower=True), w.doc_of()
    if not len(h):
        return text, np.zeros(0, np.int64)
    same = np.r_[False, text[1:] == text[:-1]]
    x = np.where(same & np.r_[False, h[1:] == h[:-1]], _REPEAT, h)
    pair = C.mix(x[:-1] * np.uint64(0x9FB21C651E98DF25) + x[1:])[same[1:]]
    keys = np.r_[C.mix(x), pair]
    return np.r_[text, text[1:][same[1:]]], (keys % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in C.pieces(batch, "_text"):
            target = part["_target"].to_numpy(zero_copy_only=False)
            text, bucket = buckets(part["_text"])
            total[1] += np.bincount(bucket, minlength=BUCKETS)
            total[0] += np.bincount(bucket[target[text]], minlength=BUCKETS)
    some = np.flatnonzero(total[1])
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "target": total[0][some], "raw": total[1][some]})


def log_ratios(docs: DataFrame, good: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """log p_target - log p_raw of each bucket; good: ids of the target texts."""
    ids = good.select(F.col(id_col).cast("long").alias("_id")).filter("_id is not null").distinct().withColumn("_target", F.lit(True))
    if ids.count() <= LABELS_TO_SEND:
        ids = F.broadcast(ids)
    marked = C.small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id", "left").select("_text", F.coalesce("_target", F.lit(False)).alias("_target"))
    rows = marked.mapInArrow(C.tidy(_count), "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()  # BUCKETS rows at most
    count = np.zeros((2, BUCKETS))
    for r in rows:
        count[:, r["bucket"]] = r["target"], r["raw"]
    if not count[0].sum():
        return np.zeros(BUCKETS)
    p = (count + 1) / (count.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(p[0]) - np.log(p[1])


def gumbel(id_col: str, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def threshold(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest of a column of doubles, exactly; None keeps all."""
    if k <= 0:
        return float("inf")
    state = keys.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if state["n"] <= k:
        return None
    lo, hi, above = state["lo"], state["hi"], 0
    bins = 4096
    while lo < hi:  # the k-th largest lies in lo..hi; `above` rows lie over hi
        width = (hi - lo) / bins
        inside = keys.filter(F.col(column).between(lo, hi))
        if width == 0 or lo + width == lo or hi - width == hi:
            few = sorted((r[0] for r in inside.groupBy(column).agg(F.count(F.lit(1)).alias("c")).select(F.struct(column, "c")).collect()), reverse=True)  # neighbouring doubles only
            for value, c in few:
                above += c
                if above >= k:
                    return value
        b = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        for r in sorted(inside.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["b"]):
            if above + r["c"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["c"]
    return lo


def resample(docs: DataFrame, good: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, temperature: float = TEMPERATURE) -> DataFrame:
    """id_col, n_grams, log_weight, sampling_key and kept of every document; k are kept."""
    ratio = log_ratios(docs, good, id_col, text_col)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, "_text"):
                text, bucket = buckets(part["_text"])
                n = np.bincount(text, minlength=len(part))
                total = np.bincount(text, ratio[bucket], minlength=len(part))
                yield pa.RecordBatch.from_pydict({id_col: part["_id"], "n_grams": pa.array(n, pa.int64()), "log_weight": pa.array(total / temperature, pa.float64())})

    weighed = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(C.tidy(weigh), f"{id_col} long, n_grams long, log_weight double")
    keys = C.materialize(weighed.withColumn("sampling_key", F.col("log_weight") + gumbel(id_col, seed)), "weights")
    least = threshold(keys, "sampling_key", k)
    return keys.withColumn("kept", F.lit(True) if least is None else F.col("sampling_key") >= least)


def resample_to_labelled_share(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Keep as large a share of the documents as the labelled table calls good."""
    known = labels.filter("quality is not null")
    share = known.agg(F.coalesce(F.avg(F.col("quality").cast("double")), F.lit(1.0)).alias("s")).first()["s"]
    return resample(docs, known.filter("quality = 1"), round(share * docs.count()))
