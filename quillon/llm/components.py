"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as C

MAX_ROUNDS = 60


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that join the same nodes as these edges: (node, least node it is joined to), node > least."""
    nodes, code = np.unique(np.r_[u, v], return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    kept = root != np.arange(len(nodes))
    return nodes[kept], nodes[root[kept]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = spanning(batch["u"].to_numpy(), batch["v"].to_numpy())
        yield pa.RecordBatch.from_pydict({"u": u, "v": v})


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long, not null).  Returns node, component (the least node reachable) for each node of an edge u <> v.

    Each Arrow batch is first replaced by the stars that span it.  Every round is two aggregations with
    map-side minima and two equi-joins, written to the shared folder; the number of rounds is about the
    logarithm of the longest shortest path.
    """
    now = C.materialize(edges.select("u", "v").filter("u <> v").mapInArrow(C.tidy(_contract), "u long, v long").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = C.materialize(small, "edges")
        C.discard(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
