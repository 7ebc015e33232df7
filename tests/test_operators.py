from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from quillon.functions import text as T
from quillon.operators import diff, graph, match, rollup, rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("struct Foo", "Foo"), ("const int *", "int const *"), ("  class   Bar  ", "Bar"), ("const unsigned long long", "unsigned long long const"), ("const ns::Type &", "ns::Type const &"), ("char const*", "char const *"), ("int*", "int *"), ("enum (unnamed enum at /a/old/foo.h:56:5)", "(unnamed enum)"), ("std::vector<const int>", "std::vector<const int>")])
def test_canonical_type(spark, given, want):
    assert one(spark, T.canonical_type(F.lit(given))) == want


@pytest.mark.parametrize(("a", "b", "le"), [("V_2", "V_2.0", True), ("V_2.0", "V_2", True), ("GLIBC_2.34", "GLIBC_2.5", False), ("GLIBC_2.5", "GLIBC_2.34", True), ("GLIBC_PRIVATE", "GLIBC_2.5", False), ("GLIBC_2.5", "GLIBC_PRIVATE", True)])
def test_version_le(spark, a, b, le):
    assert one(spark, T.version_le(T.tag_version(F.lit(a)), T.tag_version(F.lit(b)))) is le


@pytest.mark.parametrize(("name", "want"), [("libfoo-1a2b3c4d.so.1", "libfoo.so.1"), ("libfoo-100200.so.1", "libfoo-100200.so.1"), ("libfoo.so", "libfoo.so"), ("libz-abcdef0.1.dylib", "libz.1.dylib")])
def test_vendor_hash(spark, name, want):
    assert one(spark, T.strip_vendor_hash(F.lit(name))) == want


@pytest.mark.parametrize(("name", "ok"), [("_init", False), ("foo", True), ("H5C__flush", False), ("_ZN3foo3barEv", True), ("_ZNSt6vectorE", False), ("_ZThn8_N1AE", False), ("__svml_sin2", False), ("", False), ("_ZTISt9exception", False)])
def test_abi_relevant(spark, name, ok):
    assert one(spark, T.abi_relevant(F.lit(name))) is ok


def test_names(spark):
    assert one(spark, T.namespace_segments(F.lit("a::b<c::d>::e"))) == ["a", "b<c::d>", "e"]
    assert one(spark, T.template_stem(F.lit("ns::V<int, A<b> >::x"))) == "ns::V::x"
    assert one(spark, T.template_arity(F.lit("V<int, A<b, c> >"))) == 2
    assert one(spark, T.base_name(F.lit("a::b<c>::f(int)"))) == "f"
    assert one(spark, T.cv_only(F.lit("const int *"), F.lit("int *"))) is True
    assert one(spark, T.soname_major(F.lit("libx.so.12.3"))) == 12
    assert one(spark, T.integer_width(F.lit("unsigned long"), "LLP64"))["bits"] == 32
    assert one(spark, T.redact(F.lit("/home/ann/x token=abc"))) == "/home/<user>/x token=<redacted>"


def test_keyed_diff_is_null_safe(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, None), (4, "d")], "k int, v string")
    got = {(r.change, r.k, r.attr, r.old_value, r.new_value) for r in diff.keyed_diff(old, new, ["k"], ["v"]).collect()}
    assert got == {("removed", 1, None, None, None), ("changed", 2, "v", None, "b"), ("added", 4, None, None, None)}
    assert diff.keyed_diff(old.limit(0), new.limit(0), ["k"], ["v"]).count() == 0


def test_rename_match(spark):
    old = spark.createDataFrame([("a", 40, "h1"), ("b", 50, None), ("c", 4, "h9"), ("keep", 9, "k")], "name string, size int, hash string")
    new = spark.createDataFrame([("x", 40, "h1"), ("y", 50, "h2"), ("z", 4, "h9"), ("keep", 9, "k")], "name string, size int, hash string")
    assert {tuple(r) for r in match.rename_match(old, new).collect()} == {("a", "x", 1.0), ("b", "y", 0.8)}


def test_band_join_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    xs, ys = ([rng.uniform(1, 3000) for _ in range(300)] for _ in range(2))
    a, b = (spark.createDataFrame(list(enumerate(v)), f"{n} int, {n}v double") for n, v in (("x", xs), ("y", ys)))
    got = {(r.x, r.y) for r in match.band_join(a, b, "xv", "yv", 0.05).collect()}
    assert got == {(i, j) for i, p in enumerate(xs) for j, q in enumerate(ys) if abs(p - q) <= 0.05 * max(p, q)}


def test_binding(spark):
    imports = spark.createDataFrame([("app", "f", "V1", False), ("app", "g", "", True), ("app", "h", "", False), ("app", "m", "V9", False), ("app", "own", "", False)], "consumer string, symbol string, version string, weak boolean")
    exports = spark.createDataFrame([("l1", "f", "V0", True, False), ("l2", "f", "V1", True, False), ("l1", "h", "", True, True), ("l1", "m", "V1", True, False), ("app", "own", "", True, False)], "provider string, symbol string, version string, is_default boolean, hidden boolean")
    order = spark.createDataFrame([("app", 0), ("l1", 1), ("l2", 2)], "provider string, rank int")
    got = {r.symbol: (r.provider, r.status) for r in match.bind_symbols(imports, exports, order).collect()}
    assert got == {"f": ("l2", "interposed"), "g": (None, "weak_unresolved"), "h": (None, "visibility_blocked"), "m": ("l1", "version_mismatch"), "own": (None, "missing")}


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 1), ("c", "a", 2), ("x", "y", 3), ("a", "c", 4)], "src string, dst string, ordinal int")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.reachable(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {tuple(r) for r in graph.components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert {r.node: r.path for r in graph.proof_paths(edges, seeds).collect()}["c"] == ["a", "c"]
    assert [r.node for r in graph.load_order(edges, "a").orderBy("rank").collect()] == ["a", "b", "c"]
    assert graph.components(edges.limit(0)).count() == 0


def test_rules(spark):
    assert one(spark, rules.resolved_verdict(F.lit(None).cast("string"), F.lit("COMPATIBLE"), F.lit("BREAKING"), F.lit(True))) == "BREAKING"
    empty = spark.createDataFrame([], "verdict string")
    assert rules.worst_verdict(empty).first().verdict == "NO_CHANGE"
    assert one(spark, rules.compatibility_percent(F.lit(0), F.lit(3), F.lit(4))) == 25.0
    found = spark.createDataFrame([("ns::f", "removed", "src/a.c"), ("nsx::g", "removed", "lib/b.c")], "symbol string, kind string, source string")
    rule = spark.createDataFrame([(0, None, None, None, None, "ns", None), (1, None, None, None, "lib/*", None, None)], "rule_idx int, symbol string, symbol_pattern string, change_kind string, source_glob string, namespace string, expires date")
    assert {r.symbol: r.rule_idx for r in rules.suppressed(found, rule, ["symbol", "kind"], "2024-01-01").collect()} == {"ns::f": 0, "nsx::g": 1}
    held = rules.suppressed(found, rule, ["symbol", "kind"], "2024-01-01", F.col("kind") == "removed").collect()
    assert all(r.disposition == "active" and r.withheld_by is not None for r in held)


def test_rollups(spark):
    f = spark.createDataFrame([("t", "a", "i"), ("t", "b", "j")], "target string, profile string, identity string")
    c = spark.createDataFrame([("t", "a", True), ("t", "b", True), ("t", "c", False)], "target string, profile string, complete boolean")
    got = {r.identity: (r.affected, r.unaffected, r.undetermined, r.scope) for r in rollup.finding_matrix(f, c).collect()}
    assert got == {"i": (["a"], ["b"], ["c"], "undetermined"), "j": (["b"], ["a"], ["c"], "undetermined")}
    one_config = spark.createDataFrame([("f", "only")], "name string, config string")
    assert rollup.presence(one_config, "name", "config").count() == 0
