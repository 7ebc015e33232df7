"""Comparison of snapshot pairs: detectors, then the ordered steps over the findings table, then verdicts.

No step deletes a finding; each moves rows to another disposition (active, duplicate, renamed, redundant,
out_of_surface, suppressed), so what was found is always accounted for.  All pairs of a release go through in
one plan: pair_id is part of every key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import detectors, detectors_more, graph, rules  # noqa: F401  (detectors_more registers its own)
from quillon.plans import kinds
from quillon.storage import materialize, shuffled

RENAME_KINDS = ("abi_tag_changed", "long_double_abi_changed", "func_likely_renamed")


def findings(pair: detectors.Pair, names: Sequence[str] = ()) -> DataFrame:
    """UNION ALL of the detectors, in order of registration, with default verdicts."""
    parts = [f(pair).withColumns({"detector": F.lit(name), "detector_ord": F.lit(k)}) for k, (name, f) in enumerate(detectors.DETECTORS.items()) if not names or name in names]
    return detectors._union(parts).withColumns({"verdict": kinds.default_verdict(F.col("kind")), "disposition": F.lit("active")})


def deduplicated(found: DataFrame) -> DataFrame:
    """Of one kind, symbol and values, the finding of the first detector stays active."""
    w = Window.partitionBy("pair_id", "kind", "symbol", "old_value", "new_value").orderBy("detector_ord")
    return found.withColumn("_n", F.row_number().over(w)).withColumn("disposition", F.when((F.col("disposition") == "active") & (F.col("_n") > 1), "duplicate").otherwise(F.col("disposition"))).drop("_n")


def type_graph(pair: detectors.Pair, sides: Sequence[str] = ("old", "new")) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) among declarations and type names of all pairs, and the public roots (root = pair_id, node)."""
    edges, roots = [], []
    node = lambda tag, c: F.concat(F.col("pair_id"), F.lit(f"\u0001{tag}:"), c)
    for side in sides:
        f = pair.rows(side, "functions").filter("visibility = 'public'").select("pair_id", node("f", F.col("mangled")).alias("src"), F.explode(T.type_names(F.concat_ws(" , ", "return_type", F.transform(F.coalesce("params", F.array()), lambda x: x["type"])))).alias("t"))
        v = pair.rows(side, "variables").filter("visibility = 'public'").select("pair_id", node("v", F.col("mangled")).alias("src"), F.explode(T.type_names(F.col("type"))).alias("t"))
        roots += [f.select("pair_id", "src"), v.select("pair_id", "src")]
        r = pair.rows(side, "records").select("pair_id", node("t", F.col("type_key")).alias("src"), F.explode(T.type_names(F.concat_ws(" , ", F.transform(F.coalesce("fields", F.array()), lambda x: x["type"]), "bases", "virtual_bases"))).alias("t"))
        d = pair.map(side, "typedefs").select("pair_id", node("t", F.col("key")).alias("src"), F.explode(T.type_names(F.col("value"))).alias("t"))
        edges += [x.select("src", node("t", F.col("t")).alias("dst")) for x in (f, v, r, d)]
        for name in ("records", "enums"):  # a short name leads to every type that ends in it
            k = pair.rows(side, name).filter(F.contains("type_key", F.lit("::")))
            edges.append(k.select(node("t", F.substring_index("type_key", "::", -1)).alias("src"), node("t", F.col("type_key")).alias("dst")))
    union = lambda x: reduce(DataFrame.unionByName, x)
    return materialize(union(edges).distinct(), "type_graph"), union(roots).distinct().select(F.col("pair_id").alias("root"), F.col("src").alias("node"))


def public_types(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """pair_id, type_key of what public declarations reach."""
    seen = graph.reach(edges, roots)
    return seen.filter(F.contains("node", F.lit("\u0001t:"))).select(F.col("root").alias("pair_id"), F.substring_index("node", "\u0001t:", -1).alias("type_key")).distinct()


def is_type_kind():
    return rules.is_type_kind(F.col("kind")) & ~F.startswith("kind", F.lit("typedef_"))


def scoped(found: DataFrame, public: DataFrame, pair: detectors.Pair) -> DataFrame:
    """Type findings about types that no public declaration reaches are out of the surface; not so where the surface is unknown."""
    known = pair.documents("old").select("pair_id", F.coalesce("elf_only_mode", F.lit(False)).alias("_blind"))
    pub = public.withColumn("_pub", F.lit(True))
    whole = found.join(shuffled(pub.withColumnRenamed("type_key", "symbol")), ["pair_id", "symbol"], "left").withColumn("_owner", F.regexp_replace("symbol", r"::[^:]*$", ""))
    owner = pub.select("pair_id", F.col("type_key").alias("_owner"), F.col("_pub").alias("_pub2"))
    seen = whole.join(shuffled(owner), ["pair_id", "_owner"], "left").join(known, "pair_id", "left")
    out = is_type_kind() & F.col("_pub").isNull() & F.col("_pub2").isNull() & ~F.coalesce("_blind", F.lit(False)) & (F.col("disposition") == "active")
    return seen.withColumns({"disposition": F.when(out, "out_of_surface").otherwise(F.col("disposition")), "public_reachable": ~is_type_kind() | F.col("_pub").isNotNull() | F.col("_pub2").isNotNull()}).drop("_pub", "_pub2", "_owner", "_blind")


def with_sources(found: DataFrame, pair: detectors.Pair) -> DataFrame:
    """findings with `source`: the header that declares the symbol or, for members, its owner; the new side's where both have one."""
    parts = []
    for k, side in enumerate(("new", "old")):
        for name, key in (("functions", "mangled"), ("records", "type_key"), ("enums", "type_key")):
            parts.append(pair.rows(side, name).filter("source_header is not null").select("pair_id", F.col(key).alias("_declared"), "source_header", F.lit(k).alias("_k")))
    of = reduce(DataFrame.unionByName, parts).groupBy("pair_id", "_declared").agg(F.min_by("source_header", "_k").alias("_h"))
    owner = of.select("pair_id", F.col("_declared").alias("_owner"), F.col("_h").alias("_h2"))
    out = found.withColumn("_owner", F.regexp_replace("symbol", r"::[^:]*$", "")).join(shuffled(of.withColumnRenamed("_declared", "symbol")), ["pair_id", "symbol"], "left").join(shuffled(owner), ["pair_id", "_owner"], "left")
    return out.withColumn("source", F.coalesce("_h", "_h2")).drop("_owner", "_h", "_h2")


def renames_consumed(found: DataFrame) -> DataFrame:
    """Removals and additions that a rename explains."""
    pairs = found.filter(F.col("kind").isin(*RENAME_KINDS))
    used = pairs.select("pair_id", F.col("old_value").alias("symbol"), F.lit("func_removed").alias("kind")).unionByName(pairs.select("pair_id", F.col("new_value").alias("symbol"), F.lit("func_added").alias("kind"))).distinct().withColumn("_used", F.lit(True))
    out = found.join(shuffled(used), ["pair_id", "symbol", "kind"], "left")
    return out.withColumn("disposition", F.when(F.col("_used") & (F.col("disposition") == "active"), "renamed").otherwise(F.col("disposition"))).drop("_used")


def redundant_collapsed(found: DataFrame) -> DataFrame:
    """Offsets and alignment that follow from a change of size of the same type are explained by it."""
    root = found.filter("kind = 'type_size_changed'").select("pair_id", F.col("symbol").alias("_owner")).distinct().withColumn("_root", F.lit(True))
    owner = F.when(F.col("kind") == "type_field_offset_changed", F.regexp_replace("symbol", r"::[^:]*$", "")).when(F.col("kind") == "type_alignment_changed", F.col("symbol"))
    out = found.withColumn("_owner", owner).join(shuffled(root), ["pair_id", "_owner"], "left")
    hit = F.coalesce("_root", F.lit(False)) & (F.col("disposition") == "active")
    return out.withColumns({"disposition": F.when(hit, "redundant").otherwise(F.col("disposition")), "caused_by_type": F.when(hit, F.col("_owner"))}).drop("_owner", "_root")


def affected_symbols(found: DataFrame, edges: DataFrame) -> DataFrame:
    """pair_id, type_key and the public functions that reach the changed type."""
    changed = found.filter(is_type_kind()).select("pair_id", F.regexp_replace("symbol", r"::[^:]*$", "").alias("a"), F.col("symbol").alias("b")).select("pair_id", F.explode(F.array("a", "b")).alias("type_key")).distinct()
    seeds = changed.select(F.concat("pair_id", F.lit("\u0001t:"), "type_key").alias("root")).withColumn("node", F.col("root"))
    back = graph.reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)
    hit = back.filter(F.contains("node", F.lit("\u0001f:")))
    return hit.groupBy("root").agg(F.array_sort(F.collect_set(F.substring_index("node", "\u0001f:", -1))).alias("affected")).select(F.substring_index("root", "\u0001t:", 1).alias("pair_id"), F.substring_index("root", "\u0001t:", -1).alias("type_key"), "affected")


def with_policy(found: DataFrame, overrides: dict[str, str] | None = None, frozen: Sequence[str] = ()) -> DataFrame:
    """Effective verdicts: overrides by kind (ignore: COMPATIBLE); a frozen namespace keeps at least the default."""
    override = F.lit(None).cast("string")
    for kind, verdict in (overrides or {}).items():
        name = {"break": "BREAKING", "risk": "COMPATIBLE_WITH_RISK", "ignore": "COMPATIBLE", "api_break": "API_BREAK"}.get(verdict, verdict)
        override = F.when(F.col("kind") == kind, name).otherwise(override)
    ice = F.lit(False)
    for ns in frozen:
        ice = ice | F.startswith("symbol", F.lit(ns + "::")) | (F.col("symbol") == ns)
    return found.withColumn("effective_verdict", rules.resolved_verdict(F.lit(None).cast("string"), override, F.col("verdict"), ice))


def soname_advice(found: DataFrame, pair: detectors.Pair) -> DataFrame:
    """Breaking without a bump: recommended.  A bump without breaking: unnecessary."""
    live = found.filter("disposition = 'active'").groupBy("pair_id").agg(F.max(F.col("effective_verdict") == "BREAKING").alias("breaks"), F.max(F.col("kind") == "soname_changed").alias("bumped"))
    have = pair.documents("old").select("pair_id", F.col("elf.soname").alias("soname")).filter("soname is not null")
    state = have.join(live, "pair_id", "left").na.fill({"breaks": False, "bumped": False})
    kind = F.when(F.col("breaks") & ~F.col("bumped"), "soname_bump_recommended").when(~F.col("breaks") & F.col("bumped"), "soname_bump_unnecessary")
    return state.withColumn("kind", kind).filter("kind is not null").select("pair_id", "kind", F.col("soname").alias("symbol"))


def recommendation(worst: DataFrame, found: DataFrame) -> DataFrame:
    """pair_id and the next version: none, patch, minor or major."""
    add = found.filter("disposition = 'active'").groupBy("pair_id").agg(F.max(F.col("kind").endswith("_added")).alias("_adds"))
    v = F.col("verdict")
    bump = F.when(v == "NO_CHANGE", "none").when(v.isin("BREAKING", "API_BREAK"), "major").when(F.coalesce("_adds", F.lit(False)), "minor").otherwise("patch")
    return worst.join(add, "pair_id", "left").select("pair_id", "verdict", bump.alias("release"))


@dataclass
class Result:
    findings: DataFrame
    verdicts: DataFrame
    advice: DataFrame
    releases: DataFrame


def compare(snapshots: DataFrame, pairs: DataFrame, suppressions: DataFrame | None = None, overrides: dict[str, str] | None = None, frozen: Sequence[str] = (), today: str = "1970-01-01", detectors_: Sequence[str] = ()) -> Result:
    """Compare all pairs.  snapshots as read_snapshots gives them; pairs: pair_id, old_id, new_id."""
    # documents are parsed once; the detectors then read only the columns of their relations
    pairs = materialize(pairs, "pairs")
    pair = detectors.Pair(materialize(snapshots, "snapshots"), pairs, materialize)
    edges, roots = type_graph(pair)
    found = materialize(deduplicated(findings(pair, detectors_)), "findings")
    found = redundant_collapsed(renames_consumed(scoped(found, public_types(edges, roots), pair)))
    found = with_policy(found, overrides, frozen)
    if suppressions is not None:
        found = materialize(with_sources(found, pair).withColumn("_key", F.xxhash64("pair_id", "kind", "symbol", "old_value", "new_value")), "sourced")
        breaks = F.col("public_reachable") & F.col("verdict").isin("BREAKING", "API_BREAK")
        live = rules.suppressed(found.filter("disposition = 'active'"), suppressions, ["_key"], today, breaks)
        hit = live.groupBy("_key").agg(F.min("rule_idx").alias("suppression_rule"), F.min("withheld_by").alias("withheld_by"))
        found = found.join(shuffled(hit), "_key", "left").drop("_key").withColumn("disposition", F.when(F.col("suppression_rule").isNotNull() & (F.col("disposition") == "active"), "suppressed").otherwise(F.col("disposition")))
    touched = affected_symbols(found, edges).withColumnRenamed("type_key", "symbol")
    found = materialize(found.join(shuffled(touched), ["pair_id", "symbol"], "left"), "findings")
    live = rules.worst_verdict(found.filter("disposition = 'active'"), ["pair_id"], "effective_verdict")
    worst = pairs.select("pair_id").join(live, "pair_id", "left").select("pair_id", F.coalesce("verdict", F.lit("NO_CHANGE")).alias("verdict"))
    return Result(found, worst, soname_advice(found, pair), recommendation(worst, found))


def compare_release(snapshots: DataFrame, old_release: str, new_release: str, **options) -> tuple[Result, DataFrame]:
    """Match the libraries of two releases by key and compare each; also removed and added libraries.

    snapshots: as above, version being the release.
    """
    side = lambda v, c: snapshots.filter(F.col("version") == v).select(T.library_key(F.col("library")).alias("pair_id"), F.col("snapshot_id").alias(c))
    grid = side(old_release, "old_id").join(side(new_release, "new_id"), "pair_id", "full_outer")
    only = grid.filter("old_id is null or new_id is null").select("pair_id", F.when(F.col("new_id").isNull(), "bundle_library_removed").otherwise("bundle_library_added").alias("kind"))
    return compare(snapshots, grid.filter("old_id is not null and new_id is not null"), **options), only


def pairs_of(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "pair_id string, old_id string, new_id string")
