"""Toxicity scores by a linear classifier that is regularised with counterfactuals.

Features of a text are the distinct words it holds and their beginnings of 3 to 7 bytes, lower-cased (A-Z)
and without ASCII punctuation at the ends; each is a 64-bit hash.  Those that toxic training texts hold
significantly oftener than others, and those of the identity terms, get a weight each.  For every training
text that names a group, a twin is made in which identity terms are swapped for others of their set, and
the fit pays `balance` times the squared difference of the two log-odds.  So a group's name cannot carry
weight of its own, however often it stands in toxic texts, and neutral mentions are not rejected for it.

The classifier is fitted on a bounded sample of labelled rows: TRAIN_ROWS rows and TRAIN_BYTES of text,
about, chosen by a hash of the id.  Every whole text is scored where it lies, without a shuffle; what is
broadcast is the model, of at most MAX_FEATURES weights.

Defined results: a null or empty text has no features and gets the score of the intercept, between 0 and 1 (under
the threshold as long as well under a third of the labelled texts are toxic); labels that are null, or of no
document, are not used; a null id is not held out; repeated rows are scored alike, and equal rows of one id are
fitted on once; very long texts are scored whole.  Without toxic and other labels the score is the share of toxic
labels (0 if there are none).  An empty table gives an empty result.  Other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.llm import common as C

TRAIN_ROWS, TRAIN_BYTES, MAX_FEATURES = 12_000, 64 << 20, 60_000
THRESHOLD = 0.3
LENGTHS = (3, 4, 5, 6, 7)
#: Sets of terms that are swapped for one another.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian"), ("muslim", "christian", "jewish", "hindu"), ("muslims", "christians", "jews", "hindus"), ("black", "white", "asian"), ("immigrants", "natives"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos"), ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "juifs"), ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"),
)
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}<>*_-|/`~#+=&%$@^\\")] = True


def features(texts: pa.Array) -> tuple[C.Words, np.ndarray]:
    """(words, array of a row per word and a column per feature; 0 where the word is too short)."""
    w = C.Words(texts)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(6):  # punctuation at the ends
        start += (start < end) & _EDGE[w.data[np.minimum(start, len(w.data) - 1)]] if len(start) else start
        end -= (start < end) & _EDGE[w.data[np.maximum(end - 1, 0)]] if len(end) else end
    out = np.zeros((len(start), len(LENGTHS) + 1), np.uint64)
    size = end - start
    power = C._powers(max(int(size.max()) if len(size) else 0, max(LENGTHS)))
    h = np.zeros(len(start), np.uint64)
    last = len(w.data) - 1
    for k in range(max(LENGTHS)):
        more = size > k
        h[more] += C._BYTE_LOWER[w.data[np.minimum(start[more] + k, last)]] * power[k]
        if k + 1 in LENGTHS:
            out[more, LENGTHS.index(k + 1)] = C.mix(h[more] + np.uint64(k + 1))
    long = np.flatnonzero(size > max(LENGTHS))
    for part in np.array_split(long, len(long) // 200_000 + 1) if len(long) else []:
        rest = size[part] - max(LENGTHS)
        first = np.cumsum(rest) - rest
        at = C.ragged(np.full(len(part), max(LENGTHS)), rest)
        h[part] += np.add.reduceat(C._BYTE_LOWER[w.data[at + np.repeat(start[part], rest)]] * power[at], first)
    out[:, -1] = np.where(size > 0, C.mix((h + size.astype(np.uint64)) ^ C.GOLDEN), np.uint64(0))
    return w, out


class Model:
    """Weights by feature hash, and the intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, w: C.Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of the weight), distinct."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = self.seen[(found & np.uint64((1 << 22) - 1)).astype(np.int64)] & (found != 0)
        row, col = np.nonzero(maybe)
        key = found[row, col]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[at] == key
        text = np.searchsorted(w.off, row[ok], "right") - 1
        pair = np.unique(text.astype(np.int64) * len(self.keys) + at[ok])
        return pair // len(self.keys), pair % len(self.keys)

    def score(self, texts: pa.Array) -> np.ndarray:
        w, found = features(texts)
        text, at = self.hits(w, found)
        z = self.bias + np.bincount(text, self.weights[at], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _swapped(w: C.Words, found: np.ndarray, sets: Sequence[Sequence[str]]) -> np.ndarray | None:
    """The features after each identity term has become the next one of its set; None if there is none."""
    terms = [t for s in sets for t in s]
    own = features(pa.array(terms))[1]
    nxt = np.array([i for k, s in enumerate(sets) for i in np.roll(np.arange(len(s)), -1) + sum(len(x) for x in sets[:k])], int)
    order = np.argsort(own[:, -1])
    at = np.minimum(np.searchsorted(own[order, -1], found[:, -1]), len(order) - 1)
    is_term = own[order[at], -1] == found[:, -1]
    if not is_term.any():
        return None
    out = found.copy()
    out[is_term] = own[nxt[order[at[is_term]]]]
    return out


def objective(weight: np.ndarray, bias: float, toxic: np.ndarray, has: tuple, twin_has: tuple, is_twin: np.ndarray, balance: float, ridge: float) -> tuple[float, np.ndarray, float]:
    """(loss, its gradient by the weights, by the intercept).  has, twin_has: (text, weight) of the features of texts and twins.

    The loss is the mean of the log loss and of `balance` times the squared difference of a text's and its twin's
    log-odds, and a ridge on the weights.
    """
    n, (row, col), (trow, tcol) = len(toxic), has, twin_has
    z = bias + np.bincount(row, weight[col], minlength=n)
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    d = np.where(is_twin, z - bias - np.bincount(trow, weight[tcol], minlength=n), 0.0)
    g = p - toxic
    grad = (np.bincount(col, g[row] + 2 * balance * d[row], minlength=len(weight)) - 2 * balance * np.bincount(tcol, d[trow], minlength=len(weight))) / n + ridge * weight / 100
    loss = (np.logaddexp(0, z) - toxic * z + balance * d * d).mean() + ridge / 200 * (weight @ weight)
    return float(loss), grad, float(g.mean())


def fit(texts: pa.Array, toxic: np.ndarray, identity: Sequence[Sequence[str]] = IDENTITY, balance: float = 1.0, ridge: float = 0.02, steps: int = 400) -> Model:
    """Fit the weights on labelled texts."""
    n, base = len(toxic), float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < base < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if base else -40.0)
    n1 = int(toxic.sum())

    def distinct(rows: np.ndarray) -> Iterator[np.ndarray]:
        for part in np.array_split(rows, len(rows) // 500 + 1):
            w, found = features(texts.take(pa.array(part)))
            text = np.repeat(np.arange(len(part), dtype=np.uint64), w.n)
            flat, text = found.ravel(), np.repeat(text, found.shape[1])
            pair = np.unique(np.stack([flat, text], axis=1)[flat != 0], axis=0)
            yield pair[:, 0]

    keys, c1 = np.unique(np.concatenate(list(distinct(np.flatnonzero(toxic)))), return_counts=True)
    often = c1 >= max(3, n1 // 400)
    keys, c1 = keys[often], c1[often]
    c0 = np.zeros(len(keys))
    for k in distinct(np.flatnonzero(toxic == 0)):
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        c0 += np.bincount(at[keys[at] == k], minlength=len(keys)) if len(keys) else 0
    p1, p0 = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n - n1 + 1)
    gain = c1 * np.log(p1 / p0)
    strong = (p1 > 3 * p0) & (gain > 8)
    picked = np.flatnonzero(strong)[np.argsort(-gain[strong])[: MAX_FEATURES - 1000]]
    terms = features(pa.array([t for s in identity for t in s]))[1].ravel() if identity else np.zeros(0, np.uint64)
    keys = np.unique(np.r_[keys[picked], terms[terms != 0]])
    model = Model(keys, np.zeros(len(keys)), 0.0)

    row, col, twin_row, twin_col, twins = [], [], [], [], []
    for part in np.array_split(np.arange(n), n // 500 + 1):
        w, found = features(texts.take(pa.array(part)))
        t, f = model.hits(w, found)
        row.append(part[t])
        col.append(f)
        other = _swapped(w, found, identity) if identity else None
        if other is not None:
            changed = np.unique(np.searchsorted(w.off, np.flatnonzero((other != found).any(axis=1)), "right") - 1)
            t, f = model.hits(w, other)
            mine = np.isin(t, changed)
            twin_row.append(part[t[mine]])
            twin_col.append(f[mine])
            twins.append(part[changed])
    row, col = np.concatenate(row), np.concatenate(col)
    twins = np.concatenate(twins) if twins else np.zeros(0, int)
    trow, tcol = (np.concatenate(x) if x else np.zeros(0, int) for x in (twin_row, twin_col))
    is_twin = np.zeros(n, bool)
    is_twin[twins] = True

    weight, bias = np.zeros(len(keys)), float(np.log(base / (1 - base)))
    m, v, mb, vb, rate = np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0, 0.1
    for step in range(1, steps + 1):
        _, grad, gb = objective(weight, bias, toxic, (row, col), (trow, tcol), is_twin, balance, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        now = rate * (1 if step < steps // 2 else 0.2)
        weight -= now * fix * m / (np.sqrt(v) + 1e-8)
        bias -= now * fix * mb / (np.sqrt(vb) + 1e-8)
    used = np.abs(weight) > 1e-6
    return Model(keys[used], weight[used], bias)


def held_out(id_col: str | Column) -> Column:
    """True for ids whose crc32, as text, leaves 2 by division by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", identity: Sequence[Sequence[str]] = IDENTITY, balance: float = 1.0) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out; the fit itself is one task of bounded size."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    share = TRAIN_ROWS / max(1, known.count())
    order = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30))
    few = known.filter(order < F.lit(int(min(1.0, share) * (1 << 30)))).limit(2 * TRAIN_ROWS)
    mine = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")  # at most 2 * TRAIN_ROWS rows
    # an id may repeat: equal rows count once, and the rest is thinned by a hash of id and text
    mine = mine.groupBy("_id", "_y", F.xxhash64("_text").alias("_k")).agg(F.min("_text").alias("_text"))
    got = mine.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    part = min(1.0, TRAIN_BYTES / max(1, got["b"]), 2 * TRAIN_ROWS / max(1, got["n"]))
    if part < 1:
        mine = mine.filter(F.pmod(F.xxhash64("_id", "_k", F.lit(12)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))

    def fit_one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_id", "ascending"), ("_k", "ascending"), ("_y", "ascending")]).combine_chunks()
        C.trim(now=True)
        model = fit(t["_text"].combine_chunks().cast(pa.large_string()).fill_null(""), t["_y"].to_numpy().astype(float).clip(0, 1), identity, balance)
        C.trim(now=True)
        return pa.table({"model": pa.array([np.r_[model.keys.view(np.float64), model.weights, model.bias].tobytes()], pa.binary())})

    got = mine.select("_id", "_k", "_text", "_y", F.lit(0).alias("_all")).groupBy("_all").applyInArrow(fit_one, "model binary").collect()
    if not got:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    raw = np.frombuffer(got[0]["model"], np.float64)
    n = (len(raw) - 1) // 2
    return Model(raw[:n].copy().view(np.uint64), raw[n : 2 * n].copy(), float(raw[-1]))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(np.r_[model.keys.view(np.float64), model.weights, model.bias].tobytes(), 1))
    opened: dict[str, Model] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "m" not in opened:
            raw = np.frombuffer(zlib.decompress(sent.value), np.float64)
            n = (len(raw) - 1) // 2
            opened["m"] = Model(raw[:n].copy().view(np.uint64), raw[n : 2 * n].copy(), float(raw[-1]))
        for batch in batches:
            for part in C.pieces(batch, text_col):
                yield part.append_column(score_col, pa.array(opened["m"].score(part[text_col]), pa.float64()))

    return C.small_batches(docs).mapInArrow(C.tidy(run), StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
