from __future__ import annotations

import pytest

pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    import brute
    import corpus_pipeline as P
    from quillon.llm import common as C
    from quillon.llm import decontaminate

    docs = source = spark.read.parquet(f"{DATA}/documents.parquet")
    after = {}
    for name, stage in P.STAGES:
        docs = C.materialize(stage(spark, docs, DATA), name)
        after[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == source.columns
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in after.items()}
    rows = [(r.doc_id, r.text) for r in after["toxicity"].collect()]
    comp = brute.jaccard_components(rows)
    assert ids["near_copies"] == {i for i, (_, c) in comp.items() if i == c}
    leaks = {r.doc_id for r in decontaminate.contaminated(after["near_copies"], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert ids["decontamination"] == ids["near_copies"] - leaks
    assert ids["mixing"] == ids["decontamination"] == ids["token_ids"]
    assert after["token_ids"].count() == after["mixing"].count()
    empty = source.limit(0)
    for name, stage in P.STAGES:
        empty = C.materialize(stage(spark, empty, DATA), name)
        assert empty.count() == 0


def test_near_copies_of_common_passages(spark, monkeypatch):
    """Texts made of the same passages, in tasks of few texts: one of each group is kept, and no join of the stage lists pairs."""
    import itertools
    from functools import partial

    import brute
    import corpus_pipeline as P
    from quillon.llm import ngram_join
    from test_dedup import rows_of_joins

    texts = [" ".join(f"p{k}w{i}" for k in some for i in range(60 + 7 * k)) for size in (3, 4) for some in itertools.combinations(range(9), size)]
    rows = [*enumerate(texts), (len(texts), texts[0] + " end")]
    docs, kept = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(ngram_join, "link_components", partial(ngram_join.link_components, chunk_bytes=20_000, part_grams=1 << 12, probe_grams=1 << 13))
    made = rows_of_joins(spark, lambda: kept.extend(r.doc_id for r in dict(P.STAGES)["near_copies"](spark, docs, DATA).collect()))
    want = brute.jaccard_components(rows)
    assert sorted(kept) == [i for i, (_, c) in sorted(want.items()) if i == c]
    assert made <= sum(ngram_join._reach(n, 75) for n, _ in want.values())


def test_mixing_meets_the_targets(spark, tmp_path):
    """Tokens by language come to the target shares although one language has to be repeated many times."""
    import corpus_pipeline as P
    import numpy as np
    from pyspark.sql import functions as F
    from quillon.llm import mixing
    from quillon.llm.queries import MIXTURE

    rng = np.random.default_rng(1)
    size = {lang: 40 for lang in MIXTURE} | {"en": 900, "es": 20}
    langs = [lang for lang, n in size.items() for _ in range(n)]
    docs = [(i, " ".join(f"{lang}{k}" for k in rng.integers(0, 30, 40)), lang) for i, lang in enumerate(langs)]
    spark.createDataFrame([(i, 1, 0) for i, _, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    source = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = P.mix_to_weights(spark, source, str(tmp_path)).cache()
    assert out.select("doc_id").distinct().count() == len(docs)
    domains = sorted(MIXTURE)
    model = mixing.train(source, source, domains, "doc_id", "text", "lang")
    table = mixing.posteriors(out, model, "doc_id", "text")
    got = np.array(table.agg(*(F.sum(F.col("n_tokens") * F.col("posterior")[i]) for i in range(len(domains)))).first())
    assert got / got.sum() == pytest.approx(np.array([MIXTURE[d] for d in domains]) / sum(MIXTURE.values()), rel=0.1)
