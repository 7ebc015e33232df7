"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one class first, so that a third of all rows being one vector costs one row.  A tree splits
its vectors at the median of a random projection or, where vectors of its sample link, at the projection and
quantile that part the fewest links; vectors within `spill` quantiles of the cut go both ways, so near
neighbours are seldom parted.  A node whose vectors largely link (DENSE) and that no cut leaves intact (LOST) is not
split: a group of near copies larger than a leaf stays whole and is compared exactly, at a cost of its square.  Trees are fitted a few levels at a time on a bounded sample of
each node (SAMPLE rows): the first fit covers the whole table and is small enough to broadcast; leaves that
still hold over LEAF_ROWS vectors are fitted again from their own samples, in groups of bounded size, until
all leaves fit, and every vector is indexed.  Leaves that stay too large are compared block by block; rows that
shared an earlier leaf are not compared with each other again.

The deeper the forest, the more often a pair is parted, so the number of trees follows from the depth (trees_for): 10
up to 11 levels, 26 at 21 levels (a thousand million vectors).  Each level leaves a pair at cosine 0.9 together with
a chance of about 0.92, pairs that are closer more often.

Within a leaf all pairs are compared exactly.  A pair is counted in the first of the leaves that it shares,
which each vector's list of leaves tells without a shuffle of pairs, and a leaf gives back counts and the
stars that span its links: output grows with vectors, not with pairs.

Defined results: a vector that is null, zero, or holds null or non-finite components has no links and is its
own component; vectors of different lengths do not link; a null id gives a null component; rows of one id
are different vectors with one node; repeated rows link like others; vectors whose cosines tie with the threshold
link; vectors of any length are taken whole; an empty table gives an empty result.  Other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as C
from quillon.llm.components import components

#: Trees of a shallow forest; more are grown the deeper it is (trees_for).
TREES = 10
#: Share of pairs at cosine 0.9 that one level leaves together (measured: 0.55 after seven), and the recall to reach.
TOGETHER, RECALL = 0.918, 0.99
#: Rows of a node that a fit sees, levels of one fit, and sample rows that a split needs.
SAMPLE, LEVELS, LEAST_SAMPLE = 8192, 7, 48
#: Share of a node's vectors on either side of the median that go both ways.
SPILL = 0.04
LEAF_ROWS, MAX_FITS, BLOCK_ROWS = 512, 8, 2048
#: Where so large a share of a node's pairs link, and any cut parts more than LOST of the links, the node stays whole.
DENSE, LOST = 0.25, 0.02
#: Sample rows of a node whose links are looked at; directions and quantiles tried where there are any.
LINK_SAMPLE, WAYS, CUTS = 512, 8, (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9)
#: Bit of a leaf's code: not to be split again.
WHOLE = 1 << 55


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(flat.to_pylist()), "<f8").reshape(-1, dim) if len(flat) else np.zeros((0, dim))


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, dim, unit) of each vector; unit is null where it can't link."""
    for batch in batches:
        col = batch["_v"]
        off = col.offsets.to_numpy()
        values = col.values.cast(pa.float64())
        flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
        dims, units = [], []
        null = col.is_null().to_numpy(zero_copy_only=False)
        for i in range(len(col)):
            x = flat[off[i] : off[i + 1]]
            top = np.abs(x).max() if len(x) and not null[i] else 0.0
            if not np.isfinite(top) or top == 0:
                dims.append(0)
                units.append(None)
            else:
                y = x / top  # so that squares neither overflow nor vanish
                dims.append(len(x))
                units.append((y / np.sqrt(y @ y)).astype("<f8").tobytes())
        yield pa.RecordBatch.from_pydict({"_id": batch["_id"], "dim": pa.array(dims, pa.int32()), "unit": pa.array(units, pa.binary()), "raw": pa.array([None if u is None else flat[off[i] : off[i + 1]].tobytes() for i, u in enumerate(units)], pa.binary())})


# ---------------------------------------------------------------- trees


def _cut(x: np.ndarray, spill: float, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, float, float] | None:
    """(direction, low, high) of a split at the median or, where rows of x link, of one that parts few links; None if x stays whole."""
    few = x[rng.choice(len(x), LINK_SAMPLE, replace=False)] if len(x) > LINK_SAMPLE else x
    i, j = np.nonzero(np.triu(few @ few.T >= threshold, 1))
    share = len(i) / (len(few) * (len(few) - 1) / 2)
    best, found, fewest = np.inf, None, 1.0
    for _ in range(WAYS if len(i) else 1):
        direction = rng.standard_normal(x.shape[1]).astype(np.float32)
        p = x @ direction.astype(np.float64)
        q = few @ direction.astype(np.float64)
        least, most = np.minimum(q[i], q[j]), np.maximum(q[i], q[j])
        for cut in CUTS if len(i) else CUTS[:1]:
            a, m, b = np.quantile(p, [max(0.0, cut - spill), cut, min(1.0, cut + spill)])
            if not (p < m).any():
                continue  # nothing stands on the left: this projection can't split
            lost = float(((least < a) & (most > b)).mean()) if len(i) else 0.0
            fewest = min(fewest, lost)
            if lost + 0.05 * abs(cut - 0.5) < best:
                best, found = lost + 0.05 * abs(cut - 0.5), (direction, a, b)
    return None if share >= DENSE and fewest > LOST else found


def fit(x: np.ndarray, levels: int, spill: float, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, low, high) of the inner nodes of one tree, heap order; high < low marks a leaf."""
    rng = np.random.default_rng(seed)
    n = (1 << levels) - 1
    way, low, high = np.zeros((n, x.shape[1]), np.float32), np.full(n, 1.0), np.full(n, -1.0)
    rows = {0: np.arange(len(x))}
    for node in range(n):
        mine = rows.pop(node, None)
        if mine is None or len(mine) < LEAST_SAMPLE:
            continue
        cut = _cut(x[mine], spill, threshold, rng)
        if cut is None:
            continue
        way[node], low[node], high[node] = cut
        p = x[mine] @ way[node].astype(np.float64)
        if 2 * node + 2 < n:
            rows[2 * node + 1], rows[2 * node + 2] = mine[p <= high[node]], mine[p >= low[node]]
    return way, low, high


def descend(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, heap number of the leaf) for every leaf that a row falls in."""
    way, low, high = tree
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    done_row, done_node = [], []
    for _ in range(len(low).bit_length() + 1):
        leaf = node >= len(low)
        leaf[~leaf] = high[node[~leaf]] < low[node[~leaf]]
        done_row.append(row[leaf])
        done_node.append(node[leaf])
        row, node = row[~leaf], node[~leaf]
        if not len(row):
            break
        order = np.argsort(node, kind="stable")
        row, node = row[order], node[order]
        cut = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        p = np.concatenate([x[row[a:b]] @ way[node[a]].astype(np.float64) for a, b in zip(cut, np.r_[cut[1:], len(row)], strict=True)])
        left, right = p <= high[node], p >= low[node]
        row, node = np.r_[row[left], row[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2]
    return np.concatenate(done_row), np.concatenate(done_node)


def _next_code(code: int | np.ndarray, node: np.ndarray) -> np.ndarray:
    """Code of a leaf below another: a hash, with the tree's number kept in the top byte."""
    code = np.asarray(code).astype(np.int64).view(np.uint64)
    low = np.uint64(WHOLE - 1)
    return ((code & ~low) | (C.mix((code & low) * np.uint64(0x9E3779B97F4A7C15) + node.astype(np.uint64) + np.uint64(1)) & low)).view(np.int64)


ROWS = "_id long, w long, unit binary, code long"


def _placed(batch: pa.Table | pa.RecordBatch, dim: int, trees: list[tuple[int, tuple]]) -> pa.Table:
    x = _matrix(batch["unit"], dim)
    row, code = [], []
    for start, tree in trees:
        r, node = descend(x, tree)
        row.append(r)
        code.append(_next_code(np.full(len(node), start | WHOLE if (tree[1] > tree[2])[:1].any() else start), node))
    row, code = np.concatenate(row), np.concatenate(code)
    at = pa.array(row)
    return pa.table({"_id": batch["_id"].take(at), "w": batch["w"].take(at), "unit": batch["unit"].take(at), "code": code}).combine_chunks()


def depth_of(n: int, leaf_rows: int) -> int:
    """Levels that n vectors need, about: leaves are filled to a quarter, for spilled rows and uneven cuts."""
    return max(0, int(np.ceil(np.log2(max(1, n / (leaf_rows / 4))))))


def trees_for(n: int, leaf_rows: int) -> int:
    """Trees for which a pair at cosine 0.9 shares a leaf with probability RECALL, whatever the depth."""
    one = TOGETHER ** depth_of(n, leaf_rows)
    return max(TREES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-one)))) if one < 1 else TREES


def _leaves(classes: DataFrame, dim: int, trees: int | None, spill: float, leaf_rows: int, threshold: float) -> DataFrame:
    """A row for each class and leaf that it falls in."""
    n = classes.count()
    levels, trees = min(LEVELS, depth_of(n, leaf_rows)), trees or trees_for(n, leaf_rows)
    few = classes if n <= SAMPLE else classes.filter(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 20)) < F.lit(int((1 << 20) * SAMPLE / n) + 1))
    sample = _matrix(few.select("unit").limit(2 * SAMPLE).toArrow()["unit"], dim)  # SAMPLE expected; the limit is a bound only
    model = [(t << 56, fit(sample, levels, spill, threshold, 1000 + t)) for t in range(trees)]  # trees * 2^LEVELS directions at most

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _placed(batch, dim, model).to_batches()

    now = C.materialize(classes.select("_id", "w", "unit").mapInArrow(C.tidy(first), ROWS), "leaves")
    for k in range(MAX_FITS):
        size = now.filter(F.col("code").bitwiseAND(F.lit(WHOLE)) == 0).groupBy("code").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > leaf_rows)
        large = C.materialize(size, "large")
        if large.isEmpty():
            C.discard(large)
            return now
        mine = now.join(large, "code")
        part = F.pmod(F.xxhash64("_id", F.lit(k)), F.ceil(F.col("size") / F.lit(16 * SAMPLE))).cast("int")
        picked = mine.filter(F.pmod(F.xxhash64("_id", F.lit(100 + k)), F.lit(1 << 20)) < F.lit((1 << 20) * SAMPLE) / F.col("size"))

        def grow(t: pa.Table) -> pa.Table:
            code = t["code"][0].as_py()
            want = min(LEVELS, max(1, int(np.ceil(np.log2(t["size"][0].as_py() / (leaf_rows / 4))))))
            way, low, high = fit(_matrix(t["unit"], dim), want, spill, threshold, code & 0x7FFFFFFF)
            return pa.table({"code": pa.array([code], pa.int64()), "tree": pa.array([way.tobytes() + low.tobytes() + high.tobytes()], pa.binary())})

        grown = picked.select("code", "size", "unit").groupBy("code").applyInArrow(C.tidy_group(grow), "code long, tree binary")
        grown = grown.join(large, "code").select("code", "tree", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / F.lit(16 * SAMPLE)) - 1).cast("int"))).alias("part"))

        def split(rows: pa.Table, model: pa.Table) -> pa.Table:
            if not len(rows) or not len(model):
                return pa.schema([("_id", pa.int64()), ("w", pa.int64()), ("unit", pa.binary()), ("code", pa.int64())]).empty_table() if not len(rows) else rows.select(["_id", "w", "unit", "code"])
            raw = model["tree"][0].as_py()
            m = len(raw) // (4 * dim + 16)
            tree = np.frombuffer(raw, np.float32, m * dim).reshape(m, dim), np.frombuffer(raw, np.float64, m, 4 * m * dim), np.frombuffer(raw, np.float64, m, 4 * m * dim + 8 * m)
            return _placed(rows, dim, [(rows["code"][0].as_py(), tree)])

        again = mine.withColumn("part", part).select("code", "part", "_id", "w", "unit").groupBy("code", "part").cogroup(grown.groupBy("code", "part")).applyInArrow(C.tidy_pair(split), ROWS)
        new = C.materialize(now.join(large, "code", "left_anti").select("_id", "w", "unit", "code").unionByName(again), "leaves")
        C.discard(now)
        C.discard(large)
        now = new
    return now


# ---------------------------------------------------------------- leaves


def _stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row it is joined to) of a symmetric matrix of links: each row is looked at once, however many links it has."""
    root, unseen = np.arange(len(near)), np.ones(len(near), bool)
    for first in range(len(near)):
        if not unseen[first]:
            continue
        unseen[first] = False
        reached = np.array([first])
        while len(reached):
            reached = np.flatnonzero(near[reached].any(axis=0) & unseen)
            unseen[reached] = False
            root[reached] = first
    node = np.flatnonzero(root != np.arange(len(near)))
    return node, root[node]


def _links_in(ids, w, x, codes_flat, codes_off, code: int, split: int, threshold: float) -> pa.Table:
    """Counts and stars of one leaf, or of two blocks of it: rows before `split` against those after it if split > 0."""
    n = len(ids)
    near = np.zeros((n, n), bool)
    # rows that share an earlier leaf were compared there: of the commonest one's, only pairs with other rows are new
    owners, earlier = np.repeat(np.arange(n), np.diff(codes_off)), codes_flat < code
    names, times = np.unique(codes_flat[earlier], return_counts=True)
    new = np.ones(n, bool)
    if len(names):
        new[owners[earlier][codes_flat[earlier] == names[times.argmax()]]] = False
    at = np.flatnonzero(new)
    for a in range(0, len(at), 512):
        hit = x[at[a : a + 512]] @ x.T >= threshold
        near[at[a : a + 512]] = hit
        near[:, at[a : a + 512]] |= hit.T
    np.fill_diagonal(near, False)
    near &= ids[:, None] != ids[None, :]
    if split:
        near[:split, :split] = False
        near[split:, split:] = False
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    near = near[np.ix_(some, some)]
    size = codes_off[some + 1] - codes_off[some]
    flat, owner = codes_flat[C.ragged(codes_off[some], size)], np.repeat(np.arange(len(some)), size)
    before = flat < code
    flat, owner = flat[before], owner[before]
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a leaf of one row is shared by no pair
    names, column = np.unique(column[shared], return_inverse=True)
    held = np.zeros((len(some), max(1, len(names))), np.float32)
    held[owner[shared], column] = 1
    links, weight = np.zeros(len(some), np.int64), w[some].astype(np.float64)  # sums below 2^53 are exact
    for a in range(0, len(some), 256):
        links[a : a + 256] = (near[a : a + 256] & ~(held[a : a + 256] @ held.T > 0)).astype(np.float64) @ weight
    node, root = _stars(near)
    u, v = ids[some][node], ids[some][root]
    zero = np.zeros(len(u), np.int64)
    return pa.table({"u": np.r_[ids[some], u], "v": np.r_[ids[some], v], "n": np.r_[links, zero]})


def _compare(dim: int, threshold: float):
    def compare(t: pa.Table) -> pa.Table:
        low, high = t["low"][0].as_py(), t["high"][0].as_py()
        t = t.sort_by([("_b", "ascending"), ("_id", "ascending")]).combine_chunks()
        codes = t["codes"].combine_chunks()
        split = int((t["_b"].to_numpy() == low).sum()) if low < high else 0
        return _links_in(t["_id"].to_numpy(), t["w"].to_numpy(), _matrix(t["unit"], dim), codes.flatten().to_numpy(), np.r_[0, np.cumsum(codes.value_lengths().to_numpy())], t["code"][0].as_py(), split, threshold)

    return compare


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, trees: int | None = None, spill: float = SPILL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept; see the head of this file."""
    base = C.materialize(vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).mapInArrow(C.tidy(unit_rows), "_id long, dim int, unit binary, raw binary"), "units")
    sound = base.filter("unit is not null and _id is not null").withColumns({"_one": F.xxhash64("raw"), "_two": F.xxhash64("raw", F.lit(7))})
    classes = C.materialize(sound.groupBy("dim", "_one", "_two").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("w"), F.min("unit").alias("unit")), "classes")
    found = None
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        placed = _leaves(classes.filter(F.col("dim") == dim), dim, trees, spill, leaf_rows, threshold)
        lists = placed.groupBy("_id").agg(F.collect_set("code").alias("codes"))  # as many as the leaves of one vector
        size = placed.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
        mine = placed.join(lists, "_id").join(size, "code").withColumn("_b", F.pmod(F.xxhash64("_id"), "blocks").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o")
        rows = mine.select("code", "_id", "w", "unit", "codes", "_b", other).select("code", F.least("_b", "_o").alias("low"), F.greatest("_b", "_o").alias("high"), "_b", "_id", "w", "unit", "codes")

        part = rows.groupBy("code", "low", "high").applyInArrow(C.tidy_group(_compare(dim, threshold)), "u long, v long, n long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = base.sparkSession.createDataFrame([], "u long, v long, n long")
    found = C.materialize(found, "found")
    counts = found.filter("u = v").groupBy("u").agg(F.sum("n").alias("n"))
    members = sound.join(classes.select("dim", "_one", "_two", F.col("_id").alias("rep"), "w"), ["dim", "_one", "_two"]).select("_id", "rep", "w")
    comp = components(found.filter("u <> v").select("u", "v"))
    own = members.join(counts, members["rep"] == counts["u"], "left").join(comp, members["rep"] == comp["node"], "left")
    own = own.select("_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = base.filter("unit is null or _id is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return own.unionByName(rest).select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))
