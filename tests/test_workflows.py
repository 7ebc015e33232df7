from __future__ import annotations

from pyspark.sql import functions as F
from quillon.operators import build, workflows


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_options_and_toolchains(spark):
    s = "key string, value string, abi_relevant boolean"
    old = df(spark, s, ("rtti:c++", "on", False), ("abi", "5", True), ("opt", "2", False), ("same", "x", True))
    new = df(spark, s, ("abi", "6", True), ("opt", "3", False), ("exceptions:c++", "off", False), ("same", "x", True))
    assert {(r.kind, r.key) for r in build.option_changes(old, new).collect()} == {("abi_relevant_build_flag_changed", "abi"), ("build_context_changed", "opt"), ("exceptions_mode_changed", "exceptions:c++")}
    t = "language string, compiler string, version string"
    assert build.toolchain_changes(df(spark, t, ("c", "gcc", "12")), df(spark, t, ("c", "gcc", "13"))).first().new_value == "gcc 13"
    u = "configuration string, cxx_std int"
    assert build.standard_floor(df(spark, u, ("a", 14), ("b", 17)), df(spark, u, ("a", 17), ("b", None))).first().old_value == 14
    assert build.standard_floor(df(spark, u, ("a", None)), df(spark, u, ("a", 17))).count() == 0


def test_source_facts(spark):
    s = "tu_id string, kind string, qualified_name string, header string, signature_hash string, body_hash string, type_hash string, value string"
    row = lambda kind, name, **k: ("t", kind, name, k.get("header", "/a/h.h"), k.get("sig"), k.get("body"), k.get("type"), k.get("value"))
    old = df(spark, s, row("macro", "A", value="1"), row("macro", "B", value="1"), row("inline", "f", sig="s", body="b1"), row("type", "T", type="x"), row("type", "O", type="1"), row("type", "O", type="2", header="/other/h.h"))
    new = df(spark, s, row("macro", "B", value="2"), row("inline", "f", sig="s", body="b2"), row("type", "T", type="x"), row("type", "T", type="y", header="/b/h.h"), row("type", "O", type="1"), row("type", "O", type="3"))
    assert {(r.kind, r.qualified_name) for r in build.source_changes(old, new).collect()} == {("public_macro_removed", "A"), ("public_macro_value_changed", "B"), ("inline_body_changed", "f")}
    assert build.source_changes(old, new.limit(0)).count() == 0
    assert [r.qualified_name for r in build.new_odr_conflicts(old, new).collect()] == ["T"]


def test_macros_leaks_coverage(spark):
    m = df(spark, "tu string, macro string, value string", ("a", "NDEBUG", "1"), ("b", "NDEBUG", "0"), ("c", "OTHER", "1"), ("d", "OTHER", "2"), ("e", "_GLIBCXX_X", "1"))
    assert {r.macro: r["values"] for r in build.macro_divergence(m).collect()} == {"NDEBUG": {"0": ["b"], "1": ["a"]}}
    i = df(spark, "public_header string, included string, class string", ("p.h", "x.h", "private"), ("p.h", "x.h", "private"), ("p.h", "s.h", "system"), ("p.h", "p.h", "private"))
    assert build.header_leaks(i).count() == 1
    c = df(spark, "tu_id string, family string, state string", ("a", "macros", "complete"), ("b", "macros", "partial"), ("a", "types", "odd"))
    assert {r.family: r.state for r in build.coverage_rollup(c).collect()} == {"macros": "partial", "types": "failed"}
    d = df(spark, "identity string", *[(f"d{k}",) for k in range(6)])
    assert build.provenance_mismatch(d, d.limit(1)).first().missing == 5
    assert build.provenance_mismatch(d, d).count() == 0


def test_stacks(spark):
    libs = df(spark, "path string, soname string, needed array<string>, search array<string>", ("/app", None, ["a.so", "b.so"], ["/x", "/y"]))
    folders = df(spark, "folder string, name string, path string", ("/y", "a.so", "/y/a.so"), ("/x", "a.so", "/x/a.so"))
    edges = workflows.dependency_edges(libs, folders)
    assert {(r.name, r.dst) for r in edges.collect()} == {("a.so", "/x/a.so"), ("b.so", None)}
    bind = df(spark, "status string", ("ok",))
    assert workflows.loadable(edges, bind).first().loadability == "FAIL"
    assert workflows.loadable(edges.filter("dst is not null"), bind).first().loadability == "PASS"
    a = df(spark, "soname string, digest string", ("a", "1"), ("b", "1"), ("c", None))
    b = df(spark, "soname string, digest string", ("a", "2"), ("c", None), ("d", "1"))
    assert {tuple(r) for r in workflows.stack_changes(a, b).collect()} == {("a", "content_changed"), ("b", "removed"), ("c", "content_changed"), ("d", "added")}
    s = df(spark, "cohort string, library string, old_soname string, new_soname string", ("k", "a", "a.so.1", "a.so.2"), ("k", "b", "b.so.1", "b.so.1"), ("m", "c", "c.so.1", "c.so.2"))
    assert [r.cohort for r in workflows.soname_skew(s).collect()] == ["k"]
    e = "library string, symbol string"
    got = workflows.bundle_findings(df(spark, e, ("app", "f"), ("app", "g")), df(spark, e, ("l1", "f"), ("l1", "g")), df(spark, e, ("l2", "g"))).collect()
    assert {(r.symbol, r.kind) for r in got} == {("f", "bundle_intra_dep_removed"), ("g", "bundle_provider_changed")}


def test_plans_and_decisions(spark):
    k = "channel string, target string, profile string"
    got = workflows.resolve_baselines(df(spark, k, ("c", "a", "p"), ("c", "b", "p"), ("c", "z", "p")), df(spark, k + ", path string", ("c", "a", "p", "1"), ("c", "b", "p", "2"), ("c", "b", "p", "3")))
    assert {r.target: (r.outcome, r.path) for r in got.collect()} == {"a": ("RESOLVED", "1"), "b": ("AMBIGUOUS", None), "z": ("MISSING", None)}
    plan = workflows.run_plan(df(spark, "target string, profiles array<string>", ("t", ["p", "q"])), df(spark, "profile string, channel string, depth string", ("p", "main", "l2"), ("q", "main", "l0")), df(spark, "profile string, check string", ("p", "abi"), ("q", "abi"), ("q", "api")))
    assert sorted(r.check_id for r in plan.collect()) == ["t@p#main@l2", "t@q#main@l0", "t@q#main@l0"]
    d = "key string, relevance string"
    got = workflows.compare_decisions(df(spark, d, ("a", "IN_CONTRACT"), ("b", "UNKNOWN"), ("c", "IN_CONTRACT"), ("d", "NOT_APPLICABLE"), ("e", "UNKNOWN")), df(spark, d, ("a", "IN_CONTRACT"), ("b", "IN_CONTRACT"), ("c", "UNKNOWN"), ("d", "UNKNOWN"), ("f", "UNKNOWN")))
    assert {r.key: r.outcome for r in got.collect()} == {"a": "agreed", "b": "strengthened", "c": "weakened", "d": "disagreed", "e": "only_in_original", "f": "only_in_replay"}


def test_symbols_files(spark):
    s = "symbol string, version_node string, tags array<string>, min_version string"
    old, new = df(spark, s, ("f", "V", [], "1"), ("g", "V", ["optional"], "1"), ("h", "V", [], "1")), df(spark, s, ("f", "V", [], "2"), ("h", "V", ["c++"], "1"))
    assert {tuple(r) for r in workflows.validate_symbols(old, df(spark, "symbol string, version_node string", ("f", "V"), ("n", "V"))).collect()} == {("missing", "h", "V"), ("new", "n", "V")}
    assert {(r.change, r.symbol) for r in workflows.diff_symbols(old, new).collect()} == {("version_changed", "f"), ("removed", "g"), ("removed", "h"), ("added", "h")}


def test_python_api(spark):
    s = "qualname string, kind string, params array<struct<name:string,kind:string,has_default:boolean>>"
    p = lambda n, k="positional", d=False: {"name": n, "kind": k, "has_default": d}
    old = df(spark, s, ("f", "function", [p("a"), p("b", d=True)]), ("gone", "function", []), ("K", "class", []))
    new = df(spark, s, ("f", "function", [p("a", "keyword_only"), p("b"), p("c"), p("d", d=True)]), ("K", "class", []), ("K.m", "method", []))
    assert {(r.kind, r.symbol, r.detail) for r in workflows.python_api_diff(old, new).collect()} == {("python_api_function_removed", "gone", None), ("python_api_method_added", "K.m", None), ("python_api_parameter_kind_changed", "f", "a"), ("python_api_default_removed", "f", "b"), ("python_api_parameter_added", "f", "c")}


def test_idioms(spark):
    f = df(spark, "mangled string, name string, return_type string, visibility string, params array<struct<name:string,type:string>>", ("1", "ctx_create", "Ctx *", "public", []), ("2", "ctx_destroy", "void", "public", [("c", "Ctx *")]), ("3", "names", "std::vector<int>", "public", [("f", "void (*)(int)")]))
    r = df(spark, "type_key string, is_opaque boolean, bases array<string>, virtual_bases array<string>, vtable array<string>, fields array<struct<name:string,type:string>>", ("Ctx", True, [], [], [], []), ("W", False, ["B"], [], [], [("d", "WImpl *")]), ("B", False, [], [], ["f"], []))
    assert {tuple(x) for x in workflows.idioms(f, r).collect()} == {("Ctx", "opaque_pointer"), ("W", "pimpl"), ("ctx_create", "factory"), ("ctx_create", "create_destroy"), ("names", "callback")}
    assert {tuple(x) for x in workflows.antipatterns(f, r).collect()} == {("public_api_exposes_stl_by_value", "3"), ("polymorphic_type_non_virtual_dtor", "B")}


def test_templates_and_impact(spark):
    n = "name string"
    assert [r.stem for r in workflows.template_leaks(df(spark, n, ("a::detail::f<int>",)), df(spark, n, ("a::detail::f<long>",))).collect()] == ["a::detail::f"]
    assert [r.stem for r in workflows.mandatory_template_parameter(df(spark, n, ("V<int>",)), df(spark, n, ("V<int, 3>",))).collect()] == ["V"]
    assert [r.base for r in workflows.overloads_rerouted(df(spark, n, ("ns::f(int)",)), df(spark, n, ("ns::f(long)",))).collect()] == ["f"]
    inc = df(spark, "file string, included string", ("a.h", "b.h"), ("b.h", "c.h"))
    got = workflows.changed_path_impact(inc, df(spark, "entry string, file string", ("f", "a.h"), ("g", "z.h")), df(spark, "file string", ("c.h",)))
    assert [tuple(r) for r in got.collect()] == [("f", "c.h")]
    t = workflows.source_targets(df(spark, "file string, object string", ("a.c", "a.o"), ("b.c", "b.o")), df(spark, "object string, archive string", ("b.o", "l.a")), df(spark, "input string, target string", ("a.o", "x"), ("l.a", "y")))
    assert {r.file: r.targets for r in t.collect()} == {"a.c": ["x"], "b.c": ["y"]}
    assert spark.range(1).select(workflows.risk_score(F.lit("PASS"), F.lit("WARN")).alias("x")).first().x == "medium"
