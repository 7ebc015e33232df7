"""Operators that SQL cannot express, against plain versions on small tables; and the edges of each."""

from __future__ import annotations

import collections
import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from quillon.llm import common as C
from quillon.llm import decontaminate, exchange, id_files, line_dedup, mixing, resampling, token_counts, toxicity, vector_dedup
from quillon.llm.queries import QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- exchange, running aggregates


def test_exchange_gives_each_chunk_its_answers():
    rng = np.random.default_rng(1)
    sent, keys = [], []
    for chunk in range(6):
        k = np.unique(rng.integers(0, 2**64, rng.integers(0, 40), dtype=np.uint64))
        keys.append(k)
        sent.append(exchange.send(chunk, k, exchange.columns((k, 8), ((k % np.uint64(7)).astype(np.uint8), 1)), 5, np.arange(9) % (chunk + 2) == 0))
    every = pa.concat_tables(sent)
    told = pa.concat_tables([exchange.answer(every.filter(pa.compute.equal(every["_bucket"], b)), 9, lambda r: (exchange.column(r, 0, 8) % np.uint64(11)).astype(np.uint8)[:, None]) for b in range(5)])
    for chunk, k in enumerate(keys):
        mine = told.filter(pa.compute.equal(told["_chunk"], chunk))
        assert exchange.answers(mine, 1)[:, 0].tolist() == (k % np.uint64(11)).tolist()
        assert exchange.marks(mine, 9).tolist() == (np.arange(9) % (chunk + 2) == 0).tolist()


def test_running(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(0, 9), rng.choice([None, rng.randint(0, 99)])) for k in "ab" for i in range(25)]
    got = C.running(spark.createDataFrame(rows, "k string, i long, n long, m long"), ["k"], "i", {"s": ("sum", "n"), "t": ("max", "m")}, width=4).collect()
    assert len(got) == 50
    for r in got:
        before = [x for x in rows if x[0] == r.k and x[1] < r.i]
        assert r.s == (sum(x[2] for x in before) if before else None)
        assert r.t == max((x[3] for x in before if x[3] is not None), default=None)


# ---------------------------------------------------------------- op3


def test_token_counts_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.encode_special_tokens = True
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, DATA).collect()}
    assert got == {d.doc_id: len(tok.encode(d.text or "", add_special_tokens=False).ids) for d in docs}
    odd = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (None, "b " * 30_000, "z")], "doc_id long, text string, path string")
    assert sorted(r.n_tokens for r in token_counts.count_documents(odd, vocabulary(), token_counts.end_of(vocabulary()), block_ids=1000).collect()) == [1, 1, 30_001]
    assert id_files.encode_and_read(odd, vocabulary()).count() == 3


# ---------------------------------------------------------------- op4


def test_toxicity_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    n, k = 12, 5
    has, twin = (np.nonzero(rng.random((n, k)) < 0.5) for _ in range(2))
    toxic, is_twin, w = (rng.random(n) < 0.4).astype(float), rng.random(n) < 0.5, rng.normal(size=k)
    twin = tuple(x[is_twin[twin[0]]] for x in twin)
    f = lambda w, b: toxicity.objective(w, b, toxic, has, twin, is_twin, 1.5, 0.02)
    _, grad, gb = f(w, 0.3)
    for i in range(k):
        e = np.eye(k)[i] * 1e-5
        assert grad[i] == pytest.approx((f(w + e, 0.3)[0] - f(w - e, 0.3)[0]) / 2e-5, abs=1e-7)
    assert gb == pytest.approx((f(w, 0.3 + 1e-5)[0] - f(w, 0.3 - 1e-5)[0]) / 2e-5, abs=1e-7)


def test_toxicity_rows_that_repeat(spark):
    rows = [(i, ("awful words here" if i % 3 == 0 else "kind words here") + f" {i}", "x") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    once, often = (toxicity.score_documents(spark.createDataFrame(r, "doc_id long, text string, score string"), labels).distinct().collect() for r in (rows, rows * 4))
    assert {(r.doc_id, round(r.score, 9), r.predicted) for r in once} == {(r.doc_id, round(r.score, 9), r.predicted) for r in often}


# ---------------------------------------------------------------- op5


def _leaky(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(rng.choice([3, 6, 9, 14, 25])))) for k in range(8)]
    items += [(3, items[5][1]), (None, "one two three four five"), (9, None), (10, "a a a a a a a a a a a a a a a")]
    docs = []
    for i in range(50):
        w = [rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(rng.randint(0, 20))]
        mid = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 1, 2])):
            if mid:
                mid[rng.randrange(len(mid))] = "zz"
        docs.append((i // 2, " ".join(w[:5] + mid[rng.randint(0, 3) :] + w[5:])))
    return [*docs, (100, None), (101, ""), (None, "One two three four five"), (102, "a " * 40)], items


@pytest.mark.parametrize(("seed", "bench_words"), [(1, 10_000), (2, 10_000), (1, 5)])
def test_decontamination_against_all_diagonals(spark, seed, bench_words):
    docs, items = _leaky(seed)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, _k int")
    got = decontaminate.contaminated(frame, bench, bench_words=bench_words).collect()
    masks = lambda n: decontaminate.MASKS if n >= 10 else decontaminate.masks_of(n)
    want = brute.diagonal_overlaps(docs, items, masks)
    assert sorted(map(str, ((docs[r][0], item, *v) for (r, item), v in want.items()))) == sorted(str((r.doc_id, r.item_id, r.n_matched, -r.n_words, -r.start, r.item_start)) for r in got)
    every = brute.diagonal_overlaps(docs, items, masks, seeded=False)
    assert len(want) >= 0.97 * len(every)


def test_decontamination_of_repeated_words(spark):
    docs = spark.createDataFrame([(1, "spam " * 20_000), (2, "ham spam " * 10_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "spam " * 1000), (8, "ham spam " * 500)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_matched) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got[1, 7] == (0, 1000) and got[2, 8] == (0, 1000)


# ---------------------------------------------------------------- op6


def _grams(text):
    w = brute.words(brute.lower(text))
    marked = ["<again>" if i and x == w[i - 1] else x for i, x in enumerate(w)]
    return marked + list(zip(marked, marked[1:], strict=False))


def test_resampling_weights_and_ties(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("pqrstu") for _ in range(rng.randint(1, 9)))) for i in range(40)] + [(40, None), (41, ""), (None, "p q"), (3, None)]
    docs += [(7, docs[7][1]), (7, docs[7][1])]
    good = [1, 2, 3, 5, 8, 13, 21, 34]
    frame = spark.createDataFrame([(i, t, 0, 0.5) for i, t in docs], "doc_id long, text string, n_grams int, kept double")
    got = resampling.resample(frame, spark.createDataFrame([(i,) for i in good], "doc_id long"), 15).collect()
    raw, target = collections.Counter(), collections.Counter()
    for i, t in docs:
        raw.update(_grams(t))
        target.update(_grams(t) if i in good else [])
    ratio = lambda g: math.log((target[g] + 1) / (sum(target.values()) + resampling.BUCKETS)) - math.log((raw[g] + 1) / (sum(raw.values()) + resampling.BUCKETS))
    want = sorted((str(i), round(sum(map(ratio, _grams(t))), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), round(r.log_weight, 6)) for r in got) == want
    keys = sorted((r.sampling_key for r in got), reverse=True)
    assert all(r.kept == (r.sampling_key >= keys[14]) for r in got)
    assert len({r.kept for r in got if r.doc_id == 7}) == 1
    empty = resampling.resample(frame.limit(0), frame.select("doc_id").limit(0), 3)
    assert empty.count() == 0


# ---------------------------------------------------------------- op8


def test_vectors_edges(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (1, [0.0, 1.0], "c"), (2, [2.0, 0.0], "d"), (None, [1.0, 0.0], "e")]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit string")).collect()
    assert sorted((str(r.vec_id), r.component_id) for r in got) == [("1", 1), ("1", 1), ("1", 1), ("2", 1), ("None", None)]
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vector_query_finds_the_links(spark):
    """Recall on the whole table, where trees are built."""
    data = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    assert vector_dedup.depth_of(len(rows), vector_dedup.LEAF_ROWS) >= 3
    n, label = brute.cosine_links([r.embedding for r in rows])
    got = {r.vec_id: r for r in QUERIES["op8_embedding_near_dedup"](spark, data).collect()}
    mine = np.array([got[r.vec_id].n_links for r in rows])
    assert (mine <= n).all() and mine.sum() >= 0.98 * n.sum()
    ids = np.array([r.vec_id for r in rows])
    assert np.mean([got[r.vec_id].component_id == ids[label[i]] for i, r in enumerate(rows)]) > 0.98


@pytest.mark.parametrize("dim", [16, 64])
def test_recall_holds_in_deep_trees(dim):
    """A pair at cosine 0.9 down one tree of 18 levels, each cut fitted on rows of the node that it stands in."""
    rng = np.random.default_rng(dim)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    left, levels, pairs = [], 18, 60
    for t in range(pairs):
        a = unit(rng.normal(size=dim))
        b = unit(rng.normal(size=dim))
        b = 0.9 * a + np.sqrt(1 - 0.81) * unit(b - (b @ a) * a)
        rows, together = unit(rng.normal(size=(4000, dim))), 1.0
        for level in range(levels):
            way, low, high = vector_dedup.fit(rows, 1, vector_dedup.SPILL, 2.0, 1000 * t + level)
            p, q = a @ way[0], b @ way[0]
            sides = [(p <= high[0], q <= high[0]), (p >= low[0], q >= low[0])]
            both = [k for k, s in enumerate(sides) if all(s)]
            if not both:
                together = 0.0
                break
            side = rows @ way[0]
            rows = rows[side <= high[0] if both[0] == 0 else side >= low[0]]
            while len(rows) < 2000:  # more rows of the same region: small steps that stay on the side of the cut
                more = unit(rows + 0.3 * rng.normal(size=rows.shape) / np.sqrt(dim))
                side = more @ way[0]
                rows = np.r_[rows, more[side <= high[0] if both[0] == 0 else side >= low[0]]][:4000]
        left.append(together)
    n = vector_dedup.LEAF_ROWS // 4 * 2**levels
    trees = vector_dedup.trees_for(n, vector_dedup.LEAF_ROWS)
    assert trees > vector_dedup.TREES
    assert 1 - (1 - np.mean(left)) ** trees >= 0.95


# ---------------------------------------------------------------- op9


def _common(docs, first_only):
    """Lines removed of each document: aligned with all earlier ones, or with the first holders of its seeds."""
    docs = sorted(docs)
    seqs = {i: line_dedup.line_hashes(t) for i, t in docs}
    seeds = {i: set(line_dedup.seeds_of(*s, line_dedup.SEED_CHARS, line_dedup.LEAST_CHARS).tolist()) for i, s in seqs.items()}
    out = {}
    for i, _ in docs:
        earlier = [j for j in seqs if j < i]
        if first_only:
            earlier = sorted({min(j for j in seqs if s in seeds[j]) for s in seeds[i]} - {i})
        gone = set()
        for j in earlier:
            gone.update(line_dedup.common_blocks(*seqs[i], seqs[j][0], line_dedup.LEAST_CHARS))
        out[i] = gone
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_against_all_earlier(spark, seed):
    rng = random.Random(seed)
    lines = [f"line {i} " + "x" * rng.randint(0, 40) for i in range(25)] + [""]
    docs = []
    for i in range(60):
        own = [rng.choice(lines) for _ in range(rng.randint(1, 6))]
        if docs and rng.random() < 0.6:
            other = rng.choice(docs)[1].split("\n")
            k = rng.randrange(len(other))
            own[1:1] = other[k : k + rng.randint(1, 5)]
        docs.append((i, "\n".join(own)))
    rows = [(i, t, 0, "x") for i, t in docs]
    got = {r.doc_id: r for r in line_dedup.remove_common_blocks(spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, _k int, lines string")).collect()}
    want, every = _common(docs, True), _common(docs, False)
    for i, text in docs:
        raw = text.split("\n")
        assert (got[i].n_removed, got[i].kept_text) == (len(want[i]), "\n".join(x for k, x in enumerate(raw) if k not in want[i]))
    assert all(want[i] <= every[i] for i, _ in docs)
    assert sum(map(len, want.values())) >= 0.95 * sum(map(len, every.values()))


# ---------------------------------------------------------------- op10


@pytest.mark.parametrize(("least", "targets"), [(0.0, [60.0, 500.0, 90.0]), (1.0, [900.0, 700.0, 800.0]), (0.0, [0.0, 300.0, 100.0])])
def test_rates_against_projected_gradient(spark, least, targets):
    rng = np.random.default_rng(7)
    p, t = rng.dirichlet([0.3] * 3, 60), rng.integers(1, 20, 60)
    table = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(t, p, strict=True)], "n_tokens long, posterior array<double>").cache()
    steps = mixing.fit_rates(table, np.array(targets), least)
    got = np.array([r[0] for r in table.select(mixing.rate(steps, least=least)).collect()])
    a = p.T * t
    r, pace = np.ones(60), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20_000):
        r = np.maximum(least, r - pace * a.T @ (a @ r - targets))
    assert (got >= least - 1e-9).all()
    assert np.linalg.norm(a @ got - targets) <= np.linalg.norm(a @ r - targets) + 0.01 * sum(targets)


def test_mixing_says_when_targets_are_out_of_reach(spark):
    table = spark.createDataFrame([(100, [1.0, 0.0]), (100, [1.0, 0.0])], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="off its targets"):
        mixing.fit_rates(table, np.array([100.0, 100.0]))


# ---------------------------------------------------------------- stages


def test_stages_with_clashing_names_and_repeated_rows(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    few = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:])).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    odd = few.select("*", *(F.lit(7).alias(c) for c in ("_score", "_posterior", "_copy", "_dropped", "_chunk", "_id", "n", "node", "start")))
    now = C.materialize(odd, "odd")
    for name, stage in P.STAGES:
        out = C.materialize(stage(spark, now, DATA), name)
        assert out.count() > 0
        if name != P.STAGES[-1][0]:
            assert out.columns == odd.columns
            assert {r[0] for r in out.select("_copy").distinct().collect()} == {7}
            assert out.filter("doc_id is null").count() >= 1
            now = out


def test_toxicity_and_token_stages(spark):
    pytest.importorskip("corpus_pipeline")
    import zlib

    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in text}
    ids = sorted(marked)
    model = toxicity.fit(pa.array([text[i] or "" for i in ids], pa.large_string()), np.array([float(marked[i]) for i in ids]))
    every = sorted(text)
    score = model.score(pa.array([text[i] or "" for i in every], pa.large_string()))
    kept = {r.doc_id for r in P.drop_toxic(spark, docs, DATA).collect()}
    assert kept == {i for i, s in zip(every, score, strict=True) if s < toxicity.THRESHOLD}
    tok, start = Tokenizer.from_file(vocabulary()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in P.write_ids(spark, docs, DATA).collect()}
    for i in every:
        x = tok.encode(text[i] or "", add_special_tokens=False).ids + [0]
        assert got[i] == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
