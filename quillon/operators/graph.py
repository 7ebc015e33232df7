"""Graph operators over edge tables: closures, levels, components, degrees and proof paths.

Loops run on the driver, one round a job; each round joins the frontier with the edges and drops what was
visited, and its result is written to the shared folder, so plans stay short.  The rounds are bounded.  Joins
shuffle: no table of nodes or edges goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.storage import materialize, shuffled

MAX_ROUNDS = 100


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """root, node, hops: every node reachable from each root (itself at 0).  edges: src, dst; seeds: root, node."""
    pairs = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    seen = frontier = materialize(seeds.select("root", "node").distinct().withColumn("hops", F.lit(0)), "reach")
    for k in range(1, max_rounds + 1):
        step = frontier.join(shuffled(pairs), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().join(shuffled(seen.select("root", "node")), ["root", "node"], "left_anti").withColumn("hops", F.lit(k))
        frontier = materialize(step, "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"closure is not done after {max_rounds} rounds")


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, hops: every node reachable from any seed, at its least distance; seeds: node."""
    return reach(edges, seeds.select(F.lit(0).alias("root"), "node"), max_rounds).select("node", "hops")


def roots_of(closure: DataFrame) -> DataFrame:
    """Inverse of reach(): node, roots."""
    return closure.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots"))


def load_order(edges: DataFrame, root: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, level, rank in breadth-first order; edges: src, dst, ordinal."""
    from pyspark.sql import Window

    spark = edges.sparkSession
    level = spark.createDataFrame([(root, 0, "")], "node string, level int, path string")
    seen = level
    for k in range(1, max_rounds + 1):
        step = level.join(shuffled(edges), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(k).alias("level"), F.concat("path", F.lpad(F.col("ordinal").cast("string"), 6, "0")).alias("path"))
        step = step.groupBy("node", "level").agg(F.min("path").alias("path")).join(shuffled(seen.select("node")), "node", "left_anti").select("node", "level", "path")
        level = materialize(step, "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    # one graph of a load set: as many rows as libraries in it
    return seen.withColumn("rank", F.row_number().over(Window.orderBy("level", "path", "node")) - 1).select("node", "level", "rank")


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, component (least node of its component), by least labels with pointer jumping; edges: src, dst."""
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src is not null and dst is not null").distinct(), "edges")
    label = materialize(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).select(F.col("src").alias("node"), "label"), "labels")
    for _ in range(max_rounds):
        near = both.join(shuffled(label.select(F.col("node").alias("dst"), "label")), "dst").groupBy("src").agg(F.min("label").alias("_near")).select(F.col("src").alias("node"), "_near")
        low = label.join(shuffled(near), "node").select("node", "label", F.least("label", "_near").alias("_low"))
        jump = low.join(shuffled(label.select(F.col("node").alias("_low"), F.col("label").alias("_jump"))), "_low", "left")
        new = materialize(jump.select("node", F.least(F.col("_low"), F.coalesce("_jump", "_low")).alias("label"), (F.least(F.col("_low"), F.coalesce("_jump", "_low")) != F.col("label")).alias("moved")), "labels")
        moved = not new.filter("moved").isEmpty()
        label = new.select("node", "label")
        if not moved:
            return label.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def fan_in(edges: DataFrame, top: int | None = None) -> DataFrame:
    """node, n: distinct sources of each node; the `top` largest, ties by node."""
    out = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n"))
    return out.orderBy(F.desc("n"), "node").limit(top) if top else out


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n"))


def proof_paths(edges: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, hops, path: a shortest path from a seed to each node, the least one in order of names."""
    pairs = edges.select("src", "dst").distinct()
    seen = frontier = materialize(seeds.select("node").distinct().select("node", F.lit(0).alias("hops"), F.array("node").alias("path")), "paths")
    for k in range(1, max_rounds + 1):
        step = frontier.join(shuffled(pairs), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = materialize(step.join(shuffled(seen.select("node")), "node", "left_anti").select("node", F.lit(k).alias("hops"), "path"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"paths are not done after {max_rounds} rounds")


def reconcile(removed: DataFrame, added: DataFrame, tiers: list[str]) -> DataFrame:
    """Pairs of removed and added nodes, tier by tier: a tier pairs what is alone with its key on both sides.

    Both have node and a column for each tier; what a tier has paired is not seen by the next.
    """
    from quillon.operators.match import unique_pairs

    out = None
    for k, tier in enumerate(tiers):
        a, b = (df.filter(F.col(tier).isNotNull()) for df in (removed, added))
        pairs = materialize(unique_pairs(a.select(F.col("node").alias("old_node"), tier), b.select(F.col("node").alias("new_node"), tier), [tier], "old_node", "new_node").withColumn("tier", F.lit(k)), "pairs")
        removed = removed.join(shuffled(pairs.select(F.col("old_node").alias("node"))), "node", "left_anti")
        added = added.join(shuffled(pairs.select(F.col("new_node").alias("node"))), "node", "left_anti")
        out = pairs if out is None else out.unionByName(pairs)
    return out
