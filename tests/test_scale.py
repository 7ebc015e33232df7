"""Steps that must not send a table to the driver, list all pairs or scan a name over and over."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from quillon.functions import text as T
from quillon.operators import detectors, graph, match
from quillon.plans import catalog, catalog_more
from quillon.storage import materialize

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_keys(df):
    """Keys of the joins planned as broadcasts, without the numbers of their columns."""
    return {re.sub(r"#\d+L?", "", k) for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan(df))}


@pytest.mark.parametrize("name", ["functions", "integer_model"])
def test_detectors_broadcast_pairs_only(spark, name):
    docs, pairs = catalog_more._catalogue(spark, DATA)
    empty = docs.selectExpr("*", "cast(null as string) platform", "array(named_struct('name', 'r', 'type_key', 'r', 'fields', array(named_struct('name', 'f', 'type', 'long')))) records", "array(named_struct('mangled', 'v', 'type', 'long')) variables", "map('A_INT', 'long') typedefs")
    pair = detectors.Pair(materialize(empty, "snapshots"), materialize(pairs, "pairs"), materialize)
    found = detectors.DETECTORS[name](pair)
    assert "SortMergeJoin" in plan(found)
    assert broadcast_keys(found) <= {"snapshot_id", "pair_id, _pe"}  # a row a pair


@pytest.mark.parametrize("parts", [1, 7])
def test_band_counts_equal_the_listed_pairs(spark, parts):
    """Also at the ends of the band, with ties, repeated and null keys and values that are no numbers."""
    rng = random.Random(5)
    inf, nan = float("inf"), float("nan")
    odd = [0.0, -0.0, -3.0, -3.1, None, inf, -inf, nan]
    xs = [rng.choice([rng.uniform(0.1, 3000), 900 + rng.randrange(1000) / 10]) for _ in range(150)] + odd
    ys = [y for x in xs[:150] for e in (x * 0.95, x / 0.95, x - 0.05 * x) for y in (e, math.nextafter(e, 0), math.nextafter(e, inf))] + odd
    a = spark.createDataFrame([(k % 140 if k % 9 else None, x) for k, x in enumerate(xs)], "k int, x double")
    b = spark.createDataFrame([(y,) for y in ys], "y double")
    want = a.join(b, F.abs(F.col("x") - F.col("y")) <= F.lit(0.05) * F.greatest("x", "y")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert {tuple(r) for r in match.band_counts(a, b, "k", "x", "y", 0.05).collect()} == {tuple(r) for r in want.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_rename_band_match_lists_no_pairs(spark):
    text = plan(catalog.QUERIES["rename_band_match"](spark, DATA))
    assert "Generate explode" not in text and "_band" not in text


def plain_names(name):
    """segments, stem and arity by one walk over the characters."""
    depth, cur, parts, depths = 0, "", [], []
    for c in name:
        depth += (c in "<([") - (c in ">)]")
        depths.append(depth)
        if c == ":" and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    first = name.find("<")
    close = next((i for i in range(first + 1, len(name)) if depths[i] == 0), -1) if first >= 0 else -1
    stem = name[:first] + name[close + 1 :] if close >= 0 else name
    arity = 1 + sum(c == "," and d == 1 for c, d in zip(name[first + 1 : close], depths[first + 1 : close], strict=True)) if close >= 0 else 0
    return [p for p in [*parts, cur] if p], stem, arity


def test_names_equal_a_walk_over_characters(spark):
    """Also unbalanced names, ones nested deeper than the patterns follow, and characters beyond the basic plane."""
    rng = random.Random(6)
    names = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for pool in ("<>()[],::ab", "<<>>,:a", "a:<é\U0001f600>,", "ab::,", "<>\n,:") for _ in range(400)]
    names += ["a::" + "b<x, " * k + "c::d" + ">" * k + "::e" for k in range(1, 12)] + ["", "a::operator<", "a->b<c>", "f(a<b, c>, d)::x<y>", "V<" + "int, " * 3000 + "W>::f"]
    name = F.col("name")
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", T.namespace_segments(name), T.template_stem(name), T.template_arity(name)).collect()
    assert len(got) == len(names)
    for n, *rest in got:
        assert tuple(rest) == plain_names(n), n
    none = spark.range(1).select(F.lit(None).cast("string").alias("name")).select(T.namespace_segments(name), T.template_stem(name), T.template_arity(name)).first()
    assert tuple(none) == (None, None, 0)


def test_names_cost_in_proportion_to_their_length(spark):
    """Names too deep for the patterns: a fold per character took the cube of their length."""

    def seconds(arguments):
        df = spark.range(0, 60, 1, 1).select(F.concat(F.lit("V<" * 10 + "a, " * arguments + "b" + ">" * 10 + "::f"), F.col("id").cast("string")).alias("name"))
        began = time.perf_counter()
        df.select(T.template_arity(F.col("name")), T.template_stem(F.col("name"))).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1)
    assert seconds(1600) < 10


@pytest.mark.parametrize("loop", ["components", "reach", "proof_paths", "load_order", "reconcile"])
def test_graph_loops_send_no_table_to_the_driver(spark, monkeypatch, loop):
    plans = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: (plans.append(plan(df)), materialize(df, name))[1])
    edges = spark.range(40).select(F.col("id").cast("string").alias("src"), F.floor(F.col("id") / 2).cast("string").alias("dst"), F.col("id").alias("ordinal"))
    seeds = spark.createDataFrame([("39", "39")], "root string, node string")
    kinds = spark.range(40).select(F.col("id").cast("string").alias("node"), F.col("id").alias("exact"))
    run = {
        "components": lambda: graph.components(edges), "reach": lambda: graph.reach(edges, seeds), "proof_paths": lambda: graph.proof_paths(edges, seeds), "load_order": lambda: graph.load_order(edges, "39"),
        "reconcile": lambda: graph.reconcile(kinds.filter("exact < 20"), kinds.filter("exact >= 10"), ["exact", "exact"]),
    }
    assert {"components": 40, "reach": 7, "proof_paths": 7, "load_order": 7, "reconcile": 10}[loop] == run[loop]().count()
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
