from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from quillon.llm import common as C
from quillon.llm import id_files, token_counts
from quillon.llm.encoder import Encoder
from quillon.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def enc():
    return Encoder(vocabulary(), False)


def test_pieces_equal_whole_texts(enc):
    rng = random.Random(1)
    parts = [" ", "\n", "a", "b", "'s", "1", "é", "!", "\t", "  ", " x", "\x85", "日本", "\x1c"]
    texts = [None, "", " ", "<|endoftext|> a<|endoftext|>", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000))]
    ids, n = enc.encode(pa.array(texts))
    off = np.r_[0, np.cumsum(n)]
    want = [x.ids for x in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 50_000))
    ph = id_files.PerfectHash.build(keys.view(np.uint64))
    assert np.array_equal(np.sort(ph.slot(keys)), np.arange(len(keys)))
    assert len(id_files.PerfectHash.build(keys[:0].view(np.uint64)).slot(keys[:3])) == 3


def test_shards_round_trip(spark, enc):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    manifest = id_files.write_shards(docs, C.new_path(spark, "t"), vocabulary(), text_bytes=60_000)
    assert manifest.count() > 4
    got, start = {r.doc_id: r for r in id_files.read_shards(manifest).collect()}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = enc.tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id for r in id_files.lookup(manifest, [5, 10**9, -3]).collect()} == {5}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "q"), (2, None), (1, "c")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id is None, r.n_tokens) for r in id_files.encode_and_read(docs, vocabulary()).collect())
    assert [x[1] for x in got] == [True, False, False, False, False] and got[-1][2] == 1
    assert sorted(r.n_tokens for r in token_counts.count_documents(docs, vocabulary(), 50256).collect()) == [0, 1, 1, 2, 2]
    assert id_files.encode_and_read(docs.limit(0), vocabulary()).count() == token_counts.count_documents(docs.limit(0), vocabulary(), 50256).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    files, want = [], set()
    for k in range(3):
        sizes = [rng.choice([0, 1, 2, 9, 30]) for _ in range(20)]
        tail = rng.choice([0, 4])
        ids = [x for n in sizes for x in [5] * n + [9]] + [5] * tail
        path = tmp_path / f"{k}.ids"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        files.append((str(path), 2, len(ids)))
        want |= {(str(path), i, n, True) for i, n in enumerate(sizes)} | ({(str(path), len(sizes), tail, False)} if tail else set())
    got = token_counts.scan(spark.createDataFrame(files, "path string, width int, n_ids long"), 9, block)
    assert {(r.path, r.ordinal, r.n_tokens, r.complete) for r in got.collect()} == want
