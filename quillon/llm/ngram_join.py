"""Jaccard self-join of documents over word n-grams, by a prefix-tree join.

1.  Global order.  Chunks of documents send the hash-range buckets their distinct n-grams once, four bytes each, and
    get one byte back: a class of the n-gram's document frequency.  N-grams are ordered by it, rare ones first, and
    then by hash: one order for the whole table.
2.  Prefixes.  Two sets of Jaccard similarity >= t share one of the first n - ceil(t n) + 1 n-grams of each in that
    order.  N-grams of one document alone link nothing, so a document whose prefix holds only such is done; only the
    others go on, with their compressed text and the frequency classes of its n-grams.  Equal sets become one class.
3.  Tries.  A class is stored once, in the trie of the first n-gram of its path (the set in global order without the
    n-grams of one document).  Small tries share a task; one of more than PART_GRAMS n-grams is dealt over several.
    Neighbours in a trie, which share the longest paths, are joined first: that contracts groups of near copies to
    few components at a cost that grows with their members.
4.  Probes.  If the first n-gram that two sets share stands at place i of a set of n, the other has at most
    (100 + percent) (n - i) / percent - n n-grams.  A class leaves an n-gram where that, or the same seen from the
    others, excludes every class that has it.  A prefix n-gram that still meets two components sends the classes that
    have it to its centre, the one among them of least hash: n-grams that the same classes share have one centre, so
    a class is sent to few, and at most once for each of its n-grams, however many tries hold them.  The classes
    around a centre are stored in a trie; each probes it, and visits the stored paths that share a prefix n-gram with
    it, in the order of the trie: the overlap of a shared path is counted once, and a subtree is left as soon as the
    overlap so far and the n-grams that remain on both sides cannot reach what the lengths ask for.  Neither pairs of
    a group nor pairs that share an n-gram are ever listed.  A centre of more than PROBE_GRAMS n-grams is dealt in
    blocks, two of which meet in a task.  Classes already in one component need no test, as they cannot change it.

The traversal is exact: it counts whole paths, so what reaches its length's overlap is a link and needs no other check.

Defined results: no text, no word: n_shingles 0 and linked with nothing.  Fewer words than n: one n-gram, the whole
sequence.  A null id: counted, linked with nothing, component null.  Rows of one id are one node, each of its texts
links; of tied (equal) sets the least id stands for all.  Very long texts are taken whole.  An empty table gives an
empty result.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as C
from quillon.llm import exchange as X
from quillon.llm.components import components, spanning
from quillon.llm.substring_dedup import _sorted

#: N-grams that the tries of one task hold, and those that two blocks of a large centre hold, about; a set is never divided.
PART_GRAMS, PROBE_GRAMS = 1 << 18, 1 << 19
#: Neighbours on each path that are joined before the exact probes.
NEAR = 16
LIVE = "_id long, n int, one long, two long, live boolean, first long, prefix binary, text binary, df binary"


def shingles(w: C.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes text by text, distinct and ascending in each; offsets)."""
    h, n = w.hashes(lower=True), w.n
    count = np.maximum(n - width + 1, 0)
    starts = C.ragged(w.off[:-1], count)
    key = C.rolling(h, width)[starts] if len(starts) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), count)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = []
        for i in short:
            x = np.array([n[i]], np.uint64)
            for k in range(w.off[i], w.off[i + 1]):
                x = C.mix(x * np.uint64(0x9FB21C651E98DF25) + h[k : k + 1])
            extra.append(x[0])
        key, doc = np.r_[key, np.array(extra, np.uint64)], np.r_[doc, short]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(len(n) + 1))


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two sets of sizes a and b with 100 * overlap >= percent * union."""
    total = np.asarray(a, np.int64) + np.asarray(b, np.int64)
    return -(-percent * total // (100 + percent))


def _frequency_class(df: np.ndarray) -> np.ndarray:
    return np.where(df < 64, df, np.minimum(255, 64 + np.floor(8 * np.log2(np.maximum(df, 64) / 64)))).astype(np.uint8)


def _ask_frequency(table: pa.Table, width: int, n_buckets: int) -> pa.Table:
    key, _ = shingles(C.Words(table["_text"]), width)
    keys, count = np.unique(key, return_counts=True)
    return X.send(table["_chunk"][0].as_py(), keys, X.columns((_within(keys, n_buckets), 4), (np.minimum(count, 255).astype(np.uint8), 1)), n_buckets)


def _within(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """32 bits of a key that its bucket does not give: the fraction of its high half, in the order of the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets)) & np.uint64(0xFFFFFFFF)


def _tell_frequency(table: pa.Table) -> pa.Table:
    def classes(records: np.ndarray) -> np.ndarray:
        _, inverse = np.unique(X.column(records, 0, 4), return_inverse=True)
        return _frequency_class(np.bincount(inverse, records[:, 4]))[inverse][:, None]

    return X.answer(table, 5, classes)


def _reach(n, percent: int):
    """Length of the prefix of a set of n: n - ceil(t n) + 1."""
    return n + (-percent * n // 100) + 1


def _prefixes(table: pa.Table, told: pa.Table, width: int, percent: int) -> pa.Table:
    names = ("_id", "n", "one", "two", "live", "first", "prefix", "text", "df")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    if not len(table):
        return pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
    table = _sorted(table)
    key, off = shingles(C.Words(table["_text"]), width)
    n = np.diff(off)
    inverse = np.unique(key, return_inverse=True)[1]
    df = X.answers(told, 1)[inverse, 0] if len(key) else np.zeros(0, np.uint8)
    doc = np.repeat(np.arange(len(n)), n)
    full = np.flatnonzero(n)
    fold = np.zeros((2, len(n)), np.uint64)
    if len(full):
        fold[0, full] = np.add.reduceat(C.mix(key), off[full])
        fold[1, full] = np.add.reduceat(C.mix(key ^ C.GOLDEN), off[full])
    ordered = key[np.lexsort((key, df, doc))]
    alone = np.diff(np.r_[0, np.cumsum(df == 1)][off])
    reach = _reach(n, percent)
    null = table["_id"].is_null().to_numpy(zero_copy_only=False)
    live = (n > 0) & (alone < reach) & ~null
    zipper = zstandard.ZstdCompressor(level=3)
    rows: list[list] = [[None] * len(n) for _ in range(4)]
    for i in np.flatnonzero(live):
        at = off[i] + alone[i]
        rows[0][i] = int(ordered[at].view(np.int64))
        rows[1][i] = ordered[at : off[i] + reach[i]].tobytes()
        rows[2][i] = zipper.compress(table["_text"][int(i)].as_py().encode())
        rows[3][i] = zipper.compress(df[off[i] : off[i + 1]].tobytes())
    cols = [table["_id"], pa.array(n, pa.int32()), pa.array(fold[0].view(np.int64)), pa.array(fold[1].view(np.int64)), pa.array(live)]
    return pa.table([*cols, *(pa.array(v, t) for v, t in zip(rows, kinds[5:], strict=True))], names=list(names))


def _largest(n, place, percent: int):
    """Most n-grams of a set that links with a set of n, if the first n-gram that they share is at this place of the latter."""
    return (100 + percent) * (n - place) // percent - n


# ---------------------------------------------------------------- tries


def paths_of(table: pa.Table, width: int) -> list[np.ndarray]:
    """Of rows with text and df: each set's path, as ascending ranks in the global order; n-grams of one document alone are left out."""
    unzip = zstandard.ZstdDecompressor()
    texts = pa.array([unzip.decompress(x) for x in table["text"].to_pylist()], pa.large_binary()).cast(pa.large_string())
    key, off = shingles(C.Words(texts), width)
    df = np.frombuffer(b"".join(unzip.decompress(x) for x in table["df"].to_pylist()), np.uint8)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    shared = df > 1
    key, df, doc = key[shared], df[shared], doc[shared]
    keys, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, df[at]))] = np.arange(len(keys))
    code = np.sort(doc * max(1, len(keys)) + rank[inverse])
    return np.split(code % max(1, len(keys)), np.searchsorted(code, np.arange(1, len(off) - 1) * max(1, len(keys))))


class Tree:
    """A trie of paths: the paths in lexicographic order, so that a subtree is a range of neighbours."""

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.paths, self.sizes, self.percent = paths, sizes, percent
        self.order = np.array(sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes()), np.int64)

    def walk(self, probe: np.ndarray, n: int, some: Iterator[int]) -> Iterator[int]:
        """Of these stored paths, in the order of the trie, those that link with the probe (a path of a set of n)."""
        last, seen, dead = np.zeros(0, np.int64), np.zeros(1, np.int64), None
        shortest = -(-self.percent * n // 100)
        for i in some:
            path = self.paths[i]
            m = min(len(path), len(last))
            differ = np.flatnonzero(path[:m] != last[:m])
            shared = int(differ[0]) if len(differ) else m
            if dead is not None and shared > dead:
                continue  # in the subtree that was left; the walk's path is as it was
            dead = None
            shared = min(shared, len(seen) - 1)
            tail = path[shared:]
            at = np.searchsorted(probe, tail)
            hit = probe[np.minimum(at, len(probe) - 1)] == tail if len(probe) else np.zeros(len(tail), bool)
            new = seen[shared] + np.cumsum(hit)
            seen, last = np.r_[seen[: shared + 1], new], path
            if seen[-1] >= needed(n, self.sizes[i], self.percent):
                yield i
                continue
            # the first depth from which no set of a size that may link can reach its overlap
            floor = needed(n, np.maximum(np.arange(shared + 1, len(path) + 1), shortest), self.percent)
            hopeless = np.flatnonzero(new + len(probe) - at - hit < floor)
            if len(hopeless):
                dead = shared + int(hopeless[0])


class _Union:
    """Components of nodes, joined as links are found."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _links(u: list[int], v: list[int]) -> pa.Table:
    a, b = spanning(np.array(u, np.int64), np.array(v, np.int64)) if u else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.table({"u": a, "v": b})


def _join_neighbours(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Links between paths of one trie and their nearest neighbours in it that are of other components by then."""
    table = table.sort_by([("node", "ascending"), ("one", "ascending"), ("two", "ascending")]).combine_chunks()
    nodes, sizes = table["node"].to_pylist(), table["n"].to_numpy().astype(np.int64)
    tree, joined, u, v = Tree(paths_of(table, width), sizes, percent), _Union(), [], []
    order = tree.order.tolist()
    for k, i in enumerate(order):
        path, near = tree.paths[i], []
        for j in reversed(order[max(0, k - NEAR) : k]):
            if tree.paths[j][0] != path[0]:
                break
            near.append(j)
        for j in tree.walk(path, int(sizes[i]), (j for j in reversed(near) if joined.find(nodes[j]) != joined.find(nodes[i]))):
            joined.join(nodes[i], nodes[j])
            u.append(nodes[i])
            v.append(nodes[j])
    return _links(u, v)


def _probe(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Rows of stored sets (is_probe is false), of probes (true), or of sets that are both (null): the links between sets of different components."""
    table = table.sort_by([("node", "ascending"), ("one", "ascending"), ("two", "ascending")]).combine_chunks()
    nodes, comps, sizes = table["node"].to_numpy(), table["comp"].to_pylist(), table["n"].to_numpy().astype(np.int64)
    both = table["is_probe"].is_null().to_numpy()
    asks = table["is_probe"].fill_null(True).to_numpy()
    stored, probes = np.flatnonzero(both | ~asks), np.flatnonzero(asks)
    if not len(stored) or not len(probes) or len(set(comps)) == 1:
        return _links([], [])
    paths = paths_of(table, width)
    tree, joined, u, v = Tree([paths[i] for i in stored], sizes[stored], percent), _Union(), [], []
    length = np.array([len(p) for p in paths])
    alone = sizes - length
    prefix = np.clip(_reach(sizes, percent) - alone, 0, length)
    place = np.empty(len(stored), np.int64)
    place[tree.order] = np.arange(len(stored))
    gram = np.concatenate([paths[i][: prefix[i]] for i in stored])
    at, of = np.repeat(place, prefix[stored]), np.repeat(stored, prefix[stored])
    most = _largest(sizes[of], C.ragged(alone[stored], prefix[stored]), percent)
    by = np.lexsort((at, gram))
    gram, at, size, most = gram[by], at[by], sizes[of][by], most[by]
    for i in probes.tolist():
        mine = paths[i][: prefix[i]]
        lo, hi = np.searchsorted(gram, mine), np.searchsorted(gram, mine, "right")
        held = C.ragged(lo, hi - lo)
        mine_most = np.repeat(_largest(sizes[i], alone[i] + np.arange(len(mine)), percent), hi - lo)
        held = held[(size[held] <= mine_most) & (most[held] >= sizes[i])]
        some = tree.order[np.unique(at[held])]
        if both[i]:
            n = tree.sizes[some]
            some = some[(n < sizes[i]) | ((n == sizes[i]) & (nodes[stored[some]] < nodes[i]))]
        for j in tree.walk(paths[i], int(sizes[i]), (j for j in some.tolist() if joined.find(comps[stored[j]]) != joined.find(comps[i]))):
            joined.join(comps[i], comps[stored[j]])
            u.append(int(nodes[i]))
            v.append(int(nodes[stored[j]]))
    return _links(u, v)


# ---------------------------------------------------------------- the join


def in_tries(classes: DataFrame, part_grams: int) -> DataFrame:
    """classes with `part`, the task of its trie: tries of one first n-gram, several to a task, or one dealt over several."""
    weight = classes.groupBy("first").agg(F.sum("n").alias("_w"))
    total = weight.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()["w"]
    slots = max(1, -(-total // part_grams))
    several = weight.filter(F.col("_w") > part_grams).select("first", F.ceil(F.col("_w") / F.lit(part_grams)).cast("int").alias("_k"))
    return classes.join(several, "first", "left").withColumn("part", F.when(F.col("_k").isNull(), F.pmod(F.xxhash64("first"), F.lit(slots))).otherwise(F.xxhash64("first", F.pmod(F.xxhash64("node", "one"), "_k")))).drop("_k")


def at_centres(open_: DataFrame, part_grams: int, probe_grams: int) -> DataFrame:
    """The classes of open_ once for each task (part, salt) that they meet others in: several centres to a task, or one dealt in blocks.

    open_: gram, centre and the columns of a class.  A block meets itself in one task, where its classes are stored
    and probe (is_probe is null), and each other block in one, where one of the two is stored and the other probes.
    """
    key = ["node", "one", "two", "comp", "n"]
    spokes = C.materialize(open_.select("centre", *key).distinct(), "spokes")
    weight = spokes.groupBy("centre").agg(F.sum("n").alias("_w"))
    total = weight.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()["w"]
    slots = max(1, -(-total // part_grams))
    several = weight.filter(F.col("_w") > probe_grams).select("centre", F.ceil(F.col("_w") * 2 / F.lit(probe_grams)).cast("int").alias("_k"))
    dealt = spokes.join(several, "centre", "left").withColumn("_block", F.pmod(F.xxhash64("node", "one", "two"), "_k").cast("int"))
    met = dealt.withColumn("_other", F.explode(F.when(F.col("_k").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_k") - 1))))
    part = F.when(F.col("_k").isNull(), F.pmod(F.xxhash64("centre"), F.lit(slots))).otherwise(F.xxhash64("centre"))
    salt = F.coalesce(F.least("_block", "_other").cast("long") * F.col("_k") + F.greatest("_block", "_other"), F.lit(-1).cast("long"))
    return met.select(*key, part.alias("part"), salt.alias("salt"), F.when(F.col("_block") != F.col("_other"), F.col("_block") > F.col("_other")).alias("is_probe")).distinct()


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, chunk_bytes: int | None = None, part_grams: int = PART_GRAMS, probe_grams: int = PROBE_GRAMS) -> DataFrame:
    """id_col, n_shingles and component_id of each row of docs; see the head of this file."""
    total = C.chunk_count(docs, text_col, 1)[1]
    size = chunk_bytes or min(8 << 20, max(1 << 20, total // 2000))
    n, n_buckets = max(1, -(-total // size)), max(1, -(-total // (8 * size)))
    rows = C.chunked(docs, id_col, text_col, n)
    asked = rows.groupBy("_chunk").applyInArrow(C.tidy_group(lambda t: _ask_frequency(t, width, n_buckets)), X.BLOCK)
    told = asked.groupBy("_bucket").applyInArrow(C.tidy_group(_tell_frequency), X.BLOCK)
    sets = C.materialize(rows.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(C.tidy_pair(lambda t, r: _prefixes(t, r, width, percent)), LIVE), "sets")

    live = sets.filter("live")
    one_each = live.groupBy("one", "two").agg(F.min_by(F.struct("n", "first", "prefix", "text", "df"), "_id").alias("_s"), F.min("_id").alias("node")).select("node", "one", "two", "_s.*")
    classes = C.materialize(in_tries(C.materialize(one_each, "classes"), part_grams), "tries")
    members = live.select(F.col("_id").alias("u"), "one", "two").join(classes.select(F.col("node").alias("v"), "one", "two"), ["one", "two"]).filter("u <> v").select("u", "v").distinct()

    near = lambda some: C.materialize(some.select("part", "node", "one", "two", "n", "text", "df").groupBy("part").applyInArrow(C.tidy_group(lambda t: _join_neighbours(t, width, percent)), "u long, v long"), "links")
    first = C.materialize(components(near(classes)), "components")
    dealt = classes.groupBy("first").agg(F.count_distinct("part").alias("k")).filter("k > 1").select("first")
    if not dealt.isEmpty():  # a trie dealt over several tasks: the heads of its components once more, now among each other
        heads = classes.drop("part").join(dealt, "first").join(first.withColumnRenamed("component", "comp"), "node", "left").filter("comp is null or comp = node").drop("comp")
        more = near(in_tries(heads, part_grams)).unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v")))
        first = C.materialize(components(more), "components")

    # prefix n-grams that two components share, of classes that may link by them
    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, n = batch["prefix"].to_pylist(), batch["n"].to_numpy().astype(np.int64)
            count = np.array([len(b) // 8 for b in blob], np.int64)
            at = np.repeat(np.arange(len(blob)), count)
            most = _largest(n[at], C.ragged(_reach(n, percent) - count, count), percent)
            yield pa.RecordBatch.from_pydict({"gram": np.frombuffer(b"".join(blob), np.int64), **{c: batch[c].take(pa.array(at)) for c in key}, "most": most})

    key = ["node", "one", "two", "comp", "n"]
    meet = [F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.min("n").alias("_least"), F.max("most").alias("_most")]
    may_link = (F.col("_a") != F.col("_b")) & (F.col("most") >= F.col("_least")) & (F.col("n") <= F.col("_most"))
    placed = classes.join(first.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    grams = placed.select(*key, "prefix").mapInArrow(C.tidy(unfold), "gram long, node long, one long, two long, comp long, n int, most long")
    open_ = C.materialize(grams.join(grams.groupBy("gram").agg(*meet).filter("_a <> _b"), "gram").filter(may_link).select("gram", *key, "most"), "open")
    centres = open_.groupBy("gram").agg(*meet, F.min_by("node", F.xxhash64("node")).alias("centre")).filter("_a <> _b")
    sent = at_centres(open_.join(centres, "gram").filter(may_link), part_grams, probe_grams).join(classes.select("node", "one", "two", "text", "df"), ["node", "one", "two"])
    more = sent.select("part", "salt", "is_probe", "node", "one", "two", "comp", "n", "text", "df").groupBy("part", "salt").applyInArrow(C.tidy_group(lambda t: _probe(t, width, percent)), "u long, v long")

    linked = members.unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v"))).unionByName(more)
    comp = components(linked).select(F.col("node").alias("_id"), "component")
    out = sets.select("_id", "n").join(comp, "_id", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"))
