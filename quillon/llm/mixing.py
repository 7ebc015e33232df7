"""Mixing to target weights with soft membership.

A classifier fitted on a bounded sample of labelled texts gives every document the posterior of each domain.
With t the tokens and p the posterior of a document, the expected tokens of domain k under rates r are
S_k = sum r t p_k.  Rates r >= 0 are fitted by projected gradient steps on the squared distance of S from
the targets, from r = 1: every step computes S and the K x K curvature of the documents whose rates can move in
distributed aggregations, moves each rate along the gradient scaled by the (damped) inverse curvature, and clips
it at 0.  A rate is a fold of the steps over the document's own posterior, so no state is kept between steps:
the driver holds K numbers a step, the executors the posterior table.

Defined results: a null or empty text has 0 tokens, the prior as posterior, and the rate that follows; a
target for a domain without tokens cannot be met and is left at 0; without labelled texts the posteriors
are uniform; null ids and repeated rows are treated like others (a copy count depends on id and text, so equal
rows, which tie in it, get equal counts); very long texts are weighed whole; an empty table gives an empty result.
Targets that the bounds on rates keep out of reach are met as nearly as they allow, and a warning says how far off
they are.  Other columns are kept or not looked at, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quillon.llm import common as C

FIT_ROWS, FIT_BYTES, DIMENSIONS = 4_000, 32 << 20, 4096
STEPS, TOLERANCE = 40, 1e-6
#: Share of all tokens by which a target may be missed without a warning.
MISSED = 0.005


def _profile(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, square roots of its shares of hashed words, as rows of DIMENSIONS)."""
    w = C.Words(texts)
    h = (w.hashes(lower=True) % np.uint64(DIMENSIONS)).astype(np.int64)
    n = w.n
    flat = np.bincount(w.doc_of() * DIMENSIONS + h, minlength=len(n) * DIMENSIONS).reshape(len(n), DIMENSIONS)
    return n, np.sqrt(flat / np.maximum(n, 1)[:, None]).astype(np.float32)


def fit(texts: pa.Array, labels: np.ndarray, k: int, steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Softmax regression: weights of DIMENSIONS + 1 rows and k columns."""
    x = np.concatenate([_profile(texts.slice(a, 500))[1] for a in range(0, len(texts), 500)])
    y = np.eye(k, dtype=np.float32)[labels]
    prior = np.log((y.sum(axis=0) + 1) / (len(y) + k))
    w, b = np.zeros((DIMENSIONS, k), np.float32), prior.astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (z / z.sum(axis=1, keepdims=True) - y) / len(y) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-8)
    return np.vstack([w, b])


def train(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str, domain_col: str) -> np.ndarray:
    """Fit on about FIT_ROWS labelled rows (and FIT_BYTES of text), chosen by a hash of the id; one bounded task."""
    known = labels.select(F.col(id_col).alias("_id"), F.array_position(F.lit(domains), F.col(domain_col).cast("string")).cast("int").alias("_y")).filter("_id is not null and _y > 0")
    share = min(1.0, FIT_ROWS / max(1, known.count()))
    few = known.filter(F.pmod(F.xxhash64("_id", F.lit(21)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * FIT_ROWS)
    mine = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")  # 2 * FIT_ROWS rows at most
    # an id may repeat: equal rows count once, and the rest is thinned by a hash of id and text
    mine = mine.groupBy("_id", "_y", F.xxhash64("_text").alias("_k")).agg(F.min("_text").alias("_text"))
    got = mine.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    part = min(1.0, FIT_BYTES / max(1, got["b"]), 2 * FIT_ROWS / max(1, got["n"]))
    if part < 1:
        mine = mine.filter(F.pmod(F.xxhash64("_id", "_k", F.lit(22)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))
    k = len(domains)

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_id", "ascending"), ("_k", "ascending"), ("_y", "ascending")]).combine_chunks()
        C.trim(now=True)
        w = fit(t["_text"].combine_chunks().cast(pa.large_string()).fill_null(""), t["_y"].to_numpy() - 1, k)
        C.trim(now=True)
        return pa.table({"w": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    got = mine.select("_text", "_y", "_id", "_k", F.lit(0).alias("_all")).groupBy("_all").applyInArrow(one, "w binary").collect()
    return np.frombuffer(got[0]["w"], "<f4").reshape(DIMENSIONS + 1, k) if got else np.zeros((DIMENSIONS + 1, k), np.float32)


def _softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = (x @ w[:-1] + w[-1]).astype(np.float64)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def posteriors(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """_id, _key (a hash of the text), n_tokens (words) and posterior of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for part in C.pieces(batch, "_text", rows=250):
                n, x = _profile(part["_text"])
                p = _softmax(x, w)
                yield pa.RecordBatch.from_pydict({"_id": part["_id"], "_key": part["_key"], "n_tokens": pa.array(n, pa.int64()), "posterior": pa.array(list(p), pa.list_(pa.float64()))})

    rows = C.small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(C.tidy(run), "_id long, _key long, n_tokens long, posterior array<double>")


def rate(steps: list[list[float]], posterior: str = "posterior", least: float = 0.0, most: float = float("inf")) -> Column:
    """The rate after these steps: from 1, less the step along the posterior each time, never under `least` or over `most`."""
    if not steps:
        return F.lit(1.0)
    p = F.col(posterior)
    return F.aggregate(F.lit(steps), F.lit(1.0).cast("double"), lambda r, g: F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), r - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0).cast("double"), lambda s, x: s + x))))


def fit_rates(table: DataFrame, targets: np.ndarray, least: float = 0.0, most: float = float("inf")) -> list[list[float]]:
    """Projected-gradient steps; table has n_tokens and posterior, targets the tokens of each domain.

    A step that does not bring the sums nearer to the targets is taken back and the next is damped, down to a plain
    gradient step, so that the fit also settles where bounds keep the targets out of reach.
    """
    k, scale = len(targets), max(1.0, float(targets.sum()))
    p = [F.col("posterior")[i] for i in range(k)]

    def error_of(steps: list[list[float]]) -> np.ndarray:
        r = rate(steps, least=least, most=most)
        got = table.agg(*(F.sum(r * F.col("n_tokens") * p[i]).alias(f"s{i}") for i in range(k))).first()
        return np.array([x or 0.0 for x in got]) - targets

    def curvature(steps: list[list[float]], error: np.ndarray) -> np.ndarray:
        """K x K, over the documents whose rate can move: at first all, later those that no bound holds."""
        free = F.lit(True)
        if steps:
            pull = sum((x * float(e) for x, e in zip(p, error, strict=True)), F.lit(0.0))
            free = ((F.col("_r") > least) | (pull < 0)) & ((F.col("_r") < most) | (pull > 0))
        parts = [F.sum(F.when(free, F.col("n_tokens") * p[i] * p[j]).otherwise(0.0)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        got = table.withColumn("_r", rate(steps, least=least, most=most)).agg(*parts).first()
        return np.array([[got[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    steps: list[list[float]] = []
    error = error_of(steps)
    h = curvature(steps, error)
    top, damp, flat, passes = float(np.linalg.eigvalsh(h)[-1]) if k else 0.0, 0.0, 0, 0
    while passes < STEPS and flat < 4 and np.abs(error).max(initial=0.0) > TOLERANCE * scale and damp <= 16 * top:
        step = np.linalg.lstsq(h + (damp + 1e-12 * scale) * np.eye(k), error, rcond=1e-10)[0]
        new = error_of([*steps, [float(x) for x in step]])
        passes += 1
        if np.linalg.norm(new) < np.linalg.norm(error):
            flat = flat + 1 if np.linalg.norm(new) > 0.99 * np.linalg.norm(error) else 0
            steps.append([float(x) for x in step])
            error, damp = new, damp / 4 if damp > 4e-4 * top else 0.0
            if np.abs(error).max() > TOLERANCE * scale:
                h = curvature(steps, error)
        else:
            damp = max(4 * damp, top / 64) or np.inf
    missed = float(np.abs(error).max(initial=0.0)) / scale
    if missed > MISSED:
        warnings.warn(f"the mixture is off its targets by up to {missed:.1%} of all tokens", stacklevel=2)
    return steps


def _drawn(steps: list[list[float]], least: float, seed: int, *key: str, posterior: str = "posterior", most: float = float("inf")) -> Column:
    """Copies of a document: its rate, rounded up or down at random by a hash of the key columns."""
    r = rate(steps, posterior, least, most)
    u = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    return (F.floor(r) + (u < r - F.floor(r)).cast("int")).cast("int")


def plan_mix(table: DataFrame, domains: list[str], weights: dict[str, float], total: float | None, least: float, slack: float = 0.0, most: float = float("inf")) -> list[list[float]]:
    """The steps that bring the posterior table to the target shares; slack: see repeated()."""
    share = np.array([weights[d] for d in domains], float)
    share /= share.sum()
    if total is None:
        got = table.agg(*(F.sum(F.col("n_tokens") * F.col("posterior")[i]).alias(f"s{i}") for i in range(len(domains)))).first()
        has = np.array([got[f"s{i}"] or 0.0 for i in range(len(domains))])
        total = float(np.max(np.where(share > 0, has / np.maximum(share, 1e-12), 0.0), initial=0.0)) * (1 + slack)
    return fit_rates(table, share * total, least, most)


def repeated(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", least: float = 0.0, slack: float = 0.0, most: float = float("inf"), seed: int = 5) -> DataFrame:
    """docs itself, each row as often as its rate says (see mix).  slack: share by which a total of None is raised,
    so that rates of at least 1 can meet the targets although posteriors are not quite 0 or 1.  most: the most
    that a document is repeated; targets that would need more are met as far as it goes."""
    domains = sorted(weights)
    model = train(docs, labels, domains, id_col, text_col, domain_col)
    table = C.materialize(posteriors(docs, model, id_col, text_col), "posteriors")
    steps = plan_mix(table, domains, weights, total, least, slack, most)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    posterior, copy = C.free_name(docs, "_posterior"), C.free_name(docs, "_copy")
    own = StructType([*docs.schema.fields, StructField(posterior, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.pieces(batch, text_col, rows=250):
                yield part.append_column(posterior, pa.array(list(_softmax(_profile(part[text_col])[1], sent.value)), pa.list_(pa.float64())))

    copies = _drawn(steps, least, seed, id_col, text_col, posterior=posterior, most=most)
    return C.small_batches(docs).mapInArrow(C.tidy(run), own).withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", least: float = 0.0, seed: int = 5) -> DataFrame:
    """_id, _key, n_tokens, posterior, rate and copies of each document.

    labels: id_col and domain_col of the labelled texts.  total: tokens of the mixture; None takes the least
    total for which no domain is thinned out.  least: the least rate of a document (1: none is thinned out, only
    repeated).  copies is the rate rounded up or down at random, by a hash.
    """
    domains = sorted(weights)
    table = C.materialize(posteriors(docs, train(docs, labels, domains, id_col, text_col, domain_col), id_col, text_col), "posteriors")
    steps = plan_mix(table, domains, weights, total, least)
    return table.withColumns({"rate": rate(steps, least=least), "copies": _drawn(steps, least, seed, "_id", "_key")})


def mixture_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, posterior, rate and copies of every document."""
    known = labels.select("doc_id").distinct().join(docs.select("doc_id", "lang"), "doc_id")
    return mix(docs, known, weights).select(F.col("_id").alias("doc_id"), "n_tokens", "posterior", "rate", "copies")
