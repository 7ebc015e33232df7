from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from quillon.llm import decontaminate, mixing, resampling, toxicity

DATA = "/root/testdata/sf0.1"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_toxicity_on_held_out_labels(spark):
    docs, labels = tables(spark)
    got = toxicity.score_documents(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    both = labels.toPandas().merge(got, on="doc_id")
    both = both[both.held_out]
    assert both[both.toxic == 1].predicted.mean() > 0.85
    assert both[both.toxic == 0].predicted.mean() < 0.01


def test_counterfactuals_spare_neutral_mentions():
    """A group's name stands mostly in toxic texts; with the penalty a neutral mention scores lower."""
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(300)]
    texts, y = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = rng.sample(filler, 12) + (["awful"] if bad and rng.random() < 0.6 else []) + (["women"] if bad and rng.random() < 0.8 else ["men"] if rng.random() < 0.1 else [])
        rng.shuffle(w)
        texts.append(" ".join(w))
        y.append(float(bad))
    neutral = pa.array(["women " + " ".join(rng.sample(filler, 12)) for _ in range(50)])
    with_, without = (toxicity.fit(pa.array(texts, pa.large_string()), np.array(y), balance=b).score(neutral).mean() for b in (5.0, 0.0))
    assert with_ < 0.7 * without


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "idiot"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score_documents(docs, none).collect()} == {0}
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r.item_id: r.text.split() for r in bench.collect()}
    rng, docs = random.Random(1), []
    for i in range(120):
        item = rng.choice([k for k in items if len(items[k]) >= 20])
        w = list(items[item])
        for p in range(rng.randint(3, 9), len(w), rng.randint(8, 12)):
            w[p] = f"zz{p}"
        docs.append((i, " ".join(["filler"] * 30 + w + ["end"] * 9), item))
    clean = [(1000 + i, " ".join(f"c{rng.randint(0, 5000)}" for _ in range(200)), -1) for i in range(50)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string, item_id long"), bench).collect()}
    assert {(i, k) for i, _, k in docs} <= got and not {d for d, _ in got if d >= 1000}
    assert got == {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string, item_id long"), bench, bench_words=500).collect()}


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "only three words"), (None, "only three words")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Only three words"), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(3, 1), (None, 1)}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_resampling(spark):
    docs, labels = tables(spark)
    got = resampling.resample_to_labelled_share(docs, labels).toPandas()
    both = labels.toPandas().merge(got, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.93 and both[both.quality == 0].kept.mean() < 0.3
    k = int(got.kept.sum())
    assert set(got[got.kept].sampling_key) == set(got.sampling_key.nlargest(k))


def test_threshold_is_the_kth_largest(spark):
    rng = random.Random(9)
    values = [rng.choice([rng.random(), rng.gauss(0, 1e9), 1.5, 1e-300 * rng.random()]) for _ in range(700)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").cache()
    for k in (1, 2, 100, 400, 699):
        assert resampling.threshold(frame, "v", k) == sorted(values, reverse=True)[k - 1]
    assert resampling.threshold(frame, "v", 700) is None and resampling.threshold(frame, "v", 0) == float("inf")


def test_mixing_meets_its_targets(spark):
    docs, labels = tables(spark)
    weights = {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}
    got = mixing.mixture_rates(docs, labels, weights).toPandas()
    total = (got.rate.to_numpy() * got.n_tokens.to_numpy()) @ np.stack(got.posterior)
    assert np.allclose(total / total.sum(), [weights[k] for k in sorted(weights)], atol=1e-4)
    assert (got.rate >= 0).all() and ((got.copies - got.rate).abs() < 1).all()
    lang = docs.select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    assert np.mean(np.array(sorted(weights))[np.stack(lang.posterior).argmax(axis=1)] == lang.lang) > 0.9


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "idiot", "y"), (2, "", "z")], "doc_id long, text string, posterior string")
    none = spark.createDataFrame([], "doc_id long, lang string")
    assert mixing.mix(docs, none, {"a": 1, "b": 1}).count() == 3
    assert mixing.repeated(docs, none, {"a": 1, "b": 1}).columns == docs.columns
    assert mixing.mix(docs.limit(0), none, {"a": 1, "b": 1}).count() == 0
