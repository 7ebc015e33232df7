from __future__ import annotations

import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from quillon.llm import components, line_dedup, ngram_join, substring_dedup, vector_dedup
from quillon.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mutated(n, letters, seed, edits=3):
    """Texts cut from a few long ones, with edits, nulls, empty and repeated rows."""
    rng = random.Random(seed)
    base = [[rng.choice(LETTERS[:letters]) for _ in range(rng.randint(1, 60))] for _ in range(max(3, n // 10))]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(LETTERS[:letters])
        w = w[rng.randint(0, 5) :] if rng.random() < 0.3 else w
        docs.append((i, None if rng.random() < 0.03 else rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t ", "\x0b"]).join(w)))
    return docs


@pytest.mark.parametrize("letters", [2, 8, 40])
def test_substring_dedup(spark, letters):
    docs = mutated(150, letters, letters)
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=1500).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256) h", "removed_spans").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.h) for r in got} == brute.kept_words(docs)
    assert all(sum(s.end - s.start for s in r.removed_spans) == r.n_removed for r in got)


def test_substring_dedup_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    docs = spark.createDataFrame([(1, "a", long), (None, "b", long), (1, "c", long), (2, "d", "x\ty"), (3, "e", None)], "doc_id long, _chunk string, text string")
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {(1, 60_000, 0), (None, 60_000, 60_000), (2, 2, 0), (3, 0, 0)}
    assert substring_dedup.digest(docs.limit(0)).count() == 0


def test_symbols_agree_between_texts():
    """The same window holds the same symbols, by place and name, wherever it stands; names span more words by level."""
    rng = np.random.default_rng(1)
    spans = []
    for level in (1, 2, 3):
        seen = {}
        for _ in range(200):
            h = rng.integers(0, 4, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            off = np.array([0, 25, 60])
            x = substring_dedup.symbols(h, off, 13, level)
            for s in np.flatnonzero(substring_dedup.window_starts(off, 13)):
                inside = np.flatnonzero((x.lo >= s) & (x.hi <= s + 13))
                here = [(int(x.lo[i] - s), int(x.hi[i] - s), int(x.name[i])) for i in inside]
                assert seen.setdefault(tuple(h[s : s + 13]), here) == here
            spans.append((level, 60 / len(x.name)))
    means = [np.mean([v for k, v in spans if k == level]) for level in (1, 2, 3)]
    assert means[0] < means[1] < means[2]


def test_words_hash_as_a_polynomial():
    from quillon.llm import common as C

    texts = ["aB \u00e9\t" + "x" * 300_000, None, "", " aB", "Ab"]
    w = C.Words(pa.array(texts))
    for lower, table in ((False, C._BYTE), (True, C._BYTE_LOWER)):
        words = [b for t in texts for b in brute.words(t)]
        want = []
        for b in words:
            raw = np.frombuffer(b.encode(), np.uint8)
            want.append(C.mix(np.array([(table[raw] * C._powers(len(raw))).sum(dtype=np.uint64) + np.uint64(len(raw))]))[0])
        assert w.hashes(lower).tolist() == [int(x) for x in want]


@pytest.mark.parametrize("letters", [3, 30])
def test_ngram_join(spark, letters):
    docs = mutated(140, letters, letters)
    got = ngram_join.link_components(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=900).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components(docs)


def test_ngram_join_query_and_edges(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_ngram_jaccard_join"](spark, DATA).collect()}
    assert got == brute.jaccard_components(docs)
    odd = spark.createDataFrame([(1, "A b"), (2, "a B"), (None, "a b"), (3, "")], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.link_components(odd).collect()} == {(1, 1, 1), (2, 1, 1), (None, 1, None), (3, 0, 3)}
    assert ngram_join.link_components(odd.limit(0)).count() == 0


def test_tree_finds_what_sets_say():
    rng = np.random.default_rng(2)
    for _ in range(100):
        base = [np.sort(rng.permutation(60)[: rng.integers(8, 40)]) for _ in range(3)]
        sets = [np.unique(np.r_[rng.choice(b, rng.integers(1, len(b) + 1), replace=False), rng.integers(0, 60, 2)]) for b in base for _ in range(6)]
        tree = ngram_join.Tree(sets[1:], np.array([len(s) + 1 for s in sets[1:]]), 75)  # one more n-gram each, of one document alone
        got = sorted(tree.walk(sets[0], len(sets[0]) + 1, iter(tree.order.tolist())))
        want = [i for i, s in enumerate(sets[1:]) if 100 * len(np.intersect1d(sets[0], s)) >= 75 * (len(np.union1d(sets[0], s)) + 2)]
        assert got == want


@pytest.mark.parametrize(("part", "probe"), [(1 << 20, 1 << 22), (60, 100)])
def test_ngram_join_of_a_large_group(spark, part, probe):
    """Near copies of one text, a third of all rows, in tries of one task and in tries dealt over many."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(240):
        w = list(base) if i % 3 == 0 else [f"w{rng.randrange(90)}" for _ in range(60)]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{rng.randrange(5)}"
        docs.append((i, " ".join(w)))
    docs += [(7, " ".join(base)), (7, " ".join(base[:50])), (500, " ".join(base[2:]))]  # one id with several texts
    frame = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in docs], "doc_id long, text string, part int, prefix string, n int").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(frame, chunk_bytes=2000, part_grams=part, probe_grams=probe).collect()}
    renamed = [(i if k < 240 else 10_000 + k, t) for k, (i, t) in enumerate(docs)]
    want = brute.jaccard_components(renamed)
    same = {}
    for k, (i, _) in enumerate(docs):
        same.setdefault(want[renamed[k][0]][1], set()).add(i)
    assert {min(v) for v in same.values() if 0 in v} == {0}
    group = next(v for v in same.values() if 0 in v)
    assert 7 in group and all(got[i] == 0 for i in group)
    assert all(got[i] == want[i][1] for i in range(240) if i not in group and i != 7)


def rows_of_joins(spark, run):
    """Most rows that one join of run() makes, by Spark's own metrics."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    bus.waitUntilEmpty()
    before = {e.executionId() for e in each(store.executionsList())}
    run()
    bus.waitUntilEmpty()
    made = [0]
    for k in {e.executionId() for e in each(store.executionsList())} - before:
        values = store.executionMetrics(k)
        for node in each(store.planGraph(k).allNodes()):
            if "Join" in node.name():
                made += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in each(node.metrics()) if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return max(made)


@pytest.mark.parametrize(("part", "probe", "few"), [(1 << 12, 1 << 13, True), (300, 2000, False)])
def test_ngram_join_of_common_passages(spark, part, probe, few):
    """Texts made of the same passages share n-grams across many tries: no join makes more rows than the prefixes have n-grams.

    Not so where a block holds three texts (few is false), since each block meets all others; the result holds.
    """
    rng = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(60, 120))] for k in range(9)]
    docs = [(i, " ".join(w for k in some for w in passages[k])) for i, some in enumerate(s for size in (3, 4) for s in itertools.combinations(range(9), size))]
    want, got = brute.jaccard_components(docs), {}
    frame = spark.createDataFrame(docs, "doc_id long, text string")

    def run():
        got.update({r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(frame, chunk_bytes=20_000, part_grams=part, probe_grams=probe).collect()})

    made = rows_of_joins(spark, run)
    assert got == want
    assert len(docs) > len({c for _, c in want.values()}) > 1
    assert not few or made <= sum(ngram_join._reach(n, 75) for n, _ in want.values())


@pytest.mark.parametrize("leaf_rows", [2048, 100])
def test_vectors(spark, leaf_rows):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(25, 16))
    rows = [(i, [float(x) for x in base[i % 25] + rng.normal(size=16) * 0.25 * (i % 7 > 0)]) for i in range(500)]
    odd = [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0, 2.0]), (504, [2.0, 4.0]), (505, [1.0, None] + [0.0] * 14), (506, [])]
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), leaf_rows=leaf_rows).collect()}
    n, label = brute.cosine_links([v for _, v in rows])
    assert all(got[i].n_links <= n[i] for i in range(500))
    assert sum(got[i].n_links for i in range(500)) >= 0.98 * n.sum()
    assert [got[i].component_id for i in range(500)] == label.tolist()
    assert [tuple(got[i])[1:] for i in range(500, 507)] == [(0, 500, True), (0, 501, True), (0, 502, True), (1, 503, True), (1, 503, False), (0, 505, True), (0, 506, True)]


def test_vectors_of_a_group_larger_than_a_leaf(spark):
    """Near copies of one vector, a third of all rows and many leaves large, keep their links."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=32))
    x = np.r_[unit(centre + 0.204 * unit(rng.normal(size=(1000, 32)))), unit(rng.normal(size=(2000, 32)))]
    rows = [(i, v.tolist()) for i, v in enumerate(x[rng.permutation(3000)])]
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf_rows=100).collect()}
    n, label = brute.cosine_links([v for _, v in rows])
    assert all(got[i].n_links <= n[i] for i in range(3000))
    assert sum(got[i].n_links for i in range(3000)) >= 0.98 * n.sum()
    assert [got[i].component_id for i in range(3000)] == label.tolist()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 300)]}


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_dedup.patience([5, 1, 2], [1, 2, 5]) == [(1, 0), (2, 1)]
    assert line_dedup.patience([], [1]) == []


def test_line_dedup(spark):
    line = "a line that is long enough to be a seed, number {}"
    first = "\n".join(line.format(i) for i in range(4))
    docs = [(1, first), (2, "own words here\n" + first + "\nmore of them"), (3, line.format(1)), (4, None), (5, ""), (None, first)]
    got = {r.doc_id: r for r in line_dedup.remove_common_blocks(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].kept_text) == (0, first)
    assert (got[2].n_lines, got[2].n_removed, got[2].kept_text) == (6, 4, "own words here\nmore of them")
    assert got[3].n_removed == 1 and got[4].n_lines == 0 and got[5].n_lines == 0 and got[None].kept_text == ""
    assert line_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_blocks(spark):
    """A block goes although each of its lines has an earlier owner, and although its lines are too short for seeds."""
    x, y, verse = "a line of thirty bytes, called x"[:30], "a line of thirty bytes, named yy"[:30], "\n".join(f"short line {i}" for i in range(9))
    docs = [(1, f"{x}\nown of one"), (2, f"{y}\nown of two"), (3, f"own of three\n{x}\n{y}"), (4, f"own of four\n{x}\n{y}\nmore of four")]
    docs += [(5, f"head of five\n{verse}"), (6, f"{verse}\ntail of six"), (7, "short line 1\n\nshort line 3"), (8, f"{x}\nown of eight")]
    got = {r.doc_id: r for r in line_dedup.remove_common_blocks(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {1: 0, 2: 0, 3: 0, 4: 2, 5: 0, 6: 9, 7: 0, 8: 0}
    assert got[4].kept_text == "own of four\nmore of four" and got[6].kept_text == "tail of six"


def test_line_seeds_cover_common_blocks():
    """Each line of a common block that reaches least_chars lies in a run of the block that is a seed of both."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = {k: int(rng.integers(0, 30)) for k in range(8)}
        block, around = rng.integers(0, 8, rng.integers(1, 7)).tolist(), rng.integers(0, 8, (4, 3)).tolist()
        a, b = [*around[0], *block, *around[1]], [*around[2], *block, *around[3]]
        both = np.intersect1d(*(line_dedup.seeds_of(v, [size[k] for k in v], 20, 40) for v in (a, b)))
        runs = [(i, j) for i in range(len(block)) for j in range(i + 1, len(block) + 1) if sum(size[k] for k in block[i:j]) >= 40]
        seen = {k for i, j in runs if np.isin(line_dedup.seeds_of(block[i:j], [size[k] for k in block[i:j]], 99, 40), both).all() for k in range(i, j)}
        assert seen == {k for i, j in runs for k in range(i, j)}


def test_line_dedup_common_line(spark):
    """A line in more than 64 documents that share nothing else goes from all but the first."""
    common = "This line stands in a great many documents."
    docs = [(i, f"own head {i} of a document\n{common}\nown tail {i} of a document") for i in range(90)]
    got = {r.doc_id: r for r in line_dedup.remove_common_blocks(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0
    assert all(got[i].n_removed == 1 and common not in got[i].kept_text for i in range(1, 90))
