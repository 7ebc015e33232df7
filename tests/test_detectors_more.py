"""Detectors over families of names and binaries, on small snapshots; suppression gates; rename match against a walk."""

from __future__ import annotations

import random

import pytest
import snapshots as S
from pyspark.sql import functions as F
from quillon.operators import detectors, detectors_more, match, rules
from quillon.plans import catalog, catalog_more, kinds  # noqa: F401
from quillon.plans import compare as P

SYM = {"binding": "global", "sym_type": "func", "visibility": "default", "size": 8, "version": "", "is_default": True}


@pytest.fixture(scope="module")
def found(spark):
    a, b = S.context(), S.context()
    friend = lambda on: S.function("fr", mangled="_Z2frv", is_hidden_friend=on)
    a["functions"] += [friend(False), S.function("seek", mangled="_Z4seekl", params=("off_t",)), S.function("n::go", mangled="_ZN1n2goEv"), S.function("mk", mangled="_Z2mkv", ret="auto")]
    b["functions"] += [friend(True), S.function("seek", mangled="_Z4seekl", params=("off_t",)), S.function("mk", mangled="_Z2mkv", ret="int")]
    b["variables"].append({"mangled": "_ZN1n2goE", "name": "n::go", "type": "go_fn", "visibility": "public", "is_const": True, "access": "public"})
    a["functions"] += [S.function(f"sort{i}_avx2", mangled=f"_Z10sort{i}_avx2v") for i in range(3)] + [S.function(f"sort{i}_sse2", mangled=f"_Z10sort{i}_sse2v") for i in range(3)]
    b["functions"] += [S.function(f"sort{i}_sse2", mangled=f"_Z10sort{i}_sse2v") for i in range(3)]
    a["functions"] += [S.function("run", mangled=f"_Z3runRN4sycl5queueE{c}", params=("sycl::queue &", t)) for c, t in (("i", "int"), ("d", "double"))] + [S.function("run", mangled="_Z3runi")]
    b["functions"] += [S.function("run", mangled="_Z3runi")]
    a["functions"] += [S.function("bar", mangled="_ZN3Foo3barB5cxx11Ev"), S.function("baz", mangled="_ZN3FooB5cxx113bazEv")]
    b["functions"] += [S.function("bar", mangled="_ZN3Foo3barEv"), S.function("qux", mangled="_ZN3FooB5cxx113quxEv")]
    a |= {"typedefs": {"off_t": "long", "MKL_INT": "int"}, "constants": {"A_tag": "1"}}
    b |= {"typedefs": {"off_t": "long long", "MKL_INT": "long long"}, "constants": {"A_tag": "2"}}
    head = {"soname": "l.so", "needed": [], "machine": "EM_386", "elf_class": 32, "hash_styles": ["gnu", "sysv"], "versions_defined": ["V_1"]}
    sym = lambda name, **k: {"name": name} | SYM | k
    a |= {"elf": head, "elf_symbols": [sym("f", version="V_1"), sym("dep", origin_lib="libc.so.6"), sym("tab", sym_type="object", value_alignment=32)]}
    b |= {"elf": head | {"versions_defined": [], "hash_styles": ["gnu"], "has_dt_relr": True, "min_kernel": "4.0"}, "elf_symbols": [sym("f"), sym("_Znwm"), sym("tab", sym_type="object", value_alignment=8), sym("_ZN1nUlvE_clEv"), sym("_Z3Ul_v")]}
    docs = S.frame(spark, S.snapshot("a", **a), S.snapshot("b", **b))
    return {(r.kind, r.symbol): r for r in P.compare(docs, P.pairs_of(spark, [("p", "a", "b")])).findings.collect()}


@pytest.mark.parametrize(("kind", "symbol"), [
    ("hidden_friend_added", "_Z2frv"), ("time64_abi_changed", "__time64_abi"), ("integer_model_changed", "__integer_model"), ("cpo_kind_changed", "n::go"), ("unspecified_return_now_named", "mk"), ("cpu_dispatch_isa_dropped", "<isa:avx2>"),
    ("sycl_overload_set_removed", "run"), ("abi_tag_changed", "_ZN3Foo3barB5cxx11Ev"), ("serialization_tag_changed", "A_tag"), ("hash_style_removed", "ELF_HEADER"), ("version_script_missing", "<version-script>"),
    ("symbol_leaked_from_dependency_changed", "dep"), ("allocator_replacement_added", "_Znwm"), ("exported_object_alignment_reduced", "tab"), ("unnamed_type_in_public_abi", "_ZN1nUlvE_clEv"),
])
def test_kind(found, kind, symbol):
    assert (kind, symbol) in found


def test_what_is_not_reported(found):
    assert ("unnamed_type_in_public_abi", "_Z3Ul_v") not in found
    assert ("dt_relr_introduced", "ELF_HEADER") in found and ("elf_machine_changed", "ELF_HEADER") not in found
    assert ("abi_tag_changed", "_ZN3FooB5cxx113bazEv") not in found and found["func_removed", "_ZN3FooB5cxx113bazEv"].disposition == "active"


def test_kinds_are_complete(spark):
    assert len(kinds.VERDICT) == 396
    with pytest.raises(Exception, match="unknown kind of change: no_such_kind"):
        spark.createDataFrame([("no_such_kind",)], "kind string").select(kinds.default_verdict(F.col("kind"))).collect()


def test_suppression_gates(spark):
    rows = [("func_removed", "n::f", "BREAKING", True, "src/a.h"), ("func_removed", "n::g", "BREAKING", False, "src/b.h"), ("type_size_changed", "n::T", "BREAKING", True, None), ("func_added", "n::h", "COMPATIBLE", True, "src/a.h")]
    f = spark.createDataFrame(rows, "kind string, symbol string, verdict string, public_reachable boolean, source string")
    breaks = F.col("public_reachable") & (F.col("verdict") == "BREAKING")

    def hidden(rule):
        row = spark.createDataFrame([tuple({"rule_idx": 0, **rule}.get(c) for c in ("rule_idx", *rules.SELECTORS))], "rule_idx int, " + ", ".join(f"{c} {t}" for c, t in rules.SELECTORS.items())).withColumn("expires", F.lit(None).cast("date"))
        got = rules.suppressed(f, row, ["kind", "symbol"], "2024-01-01", breaks).collect()
        return {r.symbol for r in got if r.disposition == "suppressed"}, {r.symbol for r in got if r.withheld_by is not None}

    assert hidden({"namespace": "n"}) == ({"n::g", "n::h"}, {"n::f", "n::T"})
    assert hidden({"namespace": "n", "allow_public_break": True}) == ({"n::f", "n::g", "n::T", "n::h"}, set())
    assert hidden({"symbol": "n::f"}) == ({"n::f"}, set())
    assert hidden({"source_glob": "src/a.*"}) == ({"n::h"}, {"n::f"})
    assert hidden({"type_pattern": "n::.*"}) == ({"n::T"}, set())
    assert hidden({"member_name": "[fg]"}) == ({"n::f", "n::g"}, set())
    assert hidden({"change_kind": "func_removed"}) == ({"n::g"}, {"n::f"})
    assert hidden({"symbol_pattern": "n::.", "reachability": "unreachable-only"}) == ({"n::g"}, {"n::f", "n::T", "n::h"})


def test_source_of_a_finding_is_matched(spark):
    old, new = S.context(), S.context()
    old["functions"].append(S.function("f", mangled="_Z1fi", visibility="public", source_header="include/gone.h"))
    new["functions"].append(S.function("g", mangled="_Z1gi", source_header="include/gone.h"))
    rule = spark.createDataFrame([(0, "include/*", None)], "rule_idx int, source_glob string, expires date")
    out = P.compare(S.frame(spark, S.snapshot("a", **old), S.snapshot("b", **new)), P.pairs_of(spark, [("p", "a", "b")]), suppressions=rule, detectors_=["functions"])
    got = {r.symbol: (r.disposition, r.withheld_by) for r in out.findings.collect()}
    assert got == {"_Z1fi": ("active", 0), "_Z1gi": ("suppressed", None)}


def _walk(old, new, similar=None):
    """Three passes over sorted old names."""
    a = {n: (s, h) for n, s, h in old if n not in {x[0] for x in new} and s >= 8}
    b = {n: (s, h) for n, s, h in new if n not in {x[0] for x in old} and s >= 8}
    used, out = set(), {}
    fits = [lambda x, y: x[1] and x == y, lambda x, y: x[0] == y[0] and (not x[1] or not y[1] or x[1] == y[1]), lambda x, y: abs(x[0] - y[0]) <= 0.05 * max(x[0], y[0])]
    for k, (fit, sure) in enumerate(zip(fits, (1.0, 0.8, 0.5), strict=True)):
        for o in sorted(a):
            c = [n for n in b if n not in used and o not in out and fit(a[o], b[n]) and (not k or similar is None or similar(o, n))]
            if len(c) == 1:
                used.add(c[0])
                out[o] = (c[0], sure)
    return {(o, n, c) for o, (n, c) in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_rename_match_against_a_walk(spark, seed):
    rng = random.Random(seed)
    row = lambda side, i: (f"{side}{i:03d}", rng.choice([4, 8, 9, 40, 41, 60, 100, 300, 310, 900]), rng.choice(["", "", "p", "q", "r"]))
    old, new = [row("o", i) for i in range(25)], [row("n", i) for i in range(18)]
    frames = [spark.createDataFrame(x, "name string, size int, hash string") for x in (old, new)]
    assert {tuple(r) for r in match.rename_match(*frames).collect()} == _walk(old, new)
    if seed == 0:
        similar = F.substring("old_name", -1, 1) == F.substring("new_name", -1, 1)
        assert {tuple(r) for r in match.rename_match(*frames, similar=similar).collect()} == _walk(old, new, lambda o, n: o[-1] == n[-1])


def test_fields_renamed_one_to_one(spark):
    old, new = S.context(), S.context()
    u = lambda doc: next(r for r in doc["records"] if r["type_key"] == "U")
    base = u(old)["fields"][0]
    u(old)["fields"] = [base | {"name": n} for n in ("a", "b")]
    u(new)["fields"] = [base | {"name": n} for n in ("c", "d")]
    out = P.compare(S.frame(spark, S.snapshot("a", **old), S.snapshot("b", **new)), P.pairs_of(spark, [("p", "a", "b")]), detectors_=["fields"])
    assert {(r.old_value, r.new_value) for r in out.findings.collect() if r.kind == "field_renamed"} == {("a", "c"), ("b", "d")}


def test_each_catalog_query_calls_the_library():
    """Each query, itself or through a helper beside it, calls a function of operators, functions, sources, streaming or plans."""
    import inspect

    modules = ("diff", "match", "graph", "rollup", "rules", "build", "detectors", "detectors_more", "workflows", "readers", "ingest", "compare", "T")

    def reaches(f) -> bool:
        helpers = [f.__globals__[n] for n in f.__code__.co_names if inspect.isfunction(f.__globals__.get(n)) and f.__globals__[n].__module__ == f.__module__ and n != "table"]
        return any(f"{m}." in inspect.getsource(f) for m in modules) or any(map(reaches, helpers))

    assert [name for name, f in catalog.QUERIES.items() if not reaches(f)] == []


def test_registered_kinds_exist():
    assert set(detectors.DETECTORS) >= {"elf_contract", "elf_exports", "time64_abi", "hidden_friends"}
    assert detectors_more.X86_LEVELS[0] == "x86-64-baseline"
