"""Mutations of snapshots: each must be reported as its kind, the context never, in both directions."""

from __future__ import annotations

import copy

import pytest
import snapshots as S
from quillon.plans import compare as P
from quillon.plans import kinds


def change(name):
    old, new = S.context(), S.context()

    def f(doc, **kw):
        doc["functions"].append(S.function("f", mangled="_Z1fi", **kw))

    def rec(doc, key):
        return next(r for r in doc["records"] if r["type_key"] == key)

    if name == "parameter":
        f(old), f(new, params=("long long",))
    elif name == "return":
        f(old), f(new, ret="long long")
    elif name == "removed":
        f(old)
    elif name == "added":
        f(new)
    elif name == "noexcept":
        f(old, is_noexcept=False), f(new, is_noexcept=True)
    elif name == "size":
        rec(new, "S")["size_bits"] = 128
    elif name == "field_type":
        rec(new, "S")["fields"][0]["type"] = "double"
    elif name == "field_renamed":
        rec(new, "S")["fields"][0]["name"] = "renamed"
    elif name == "enum_value":
        new["enums"][1]["members"][0]["value"] = 7
    elif name == "enum_added":
        new["enums"][1]["members"].append({"name": "C", "value": 9})
    elif name == "enum_renamed":
        new["enums"][1]["members"][0]["name"] = "AA"
    elif name == "var_removed":
        old["variables"].append({"mangled": "v", "name": "v", "type": "int", "visibility": "public", "is_const": False, "access": "public"})
    elif name == "vtable":
        rec(new, "V")["vtable"] = ["m0", "m1"]
    elif name == "base":
        rec(new, "S")["bases"] = ["Base"]
    elif name == "virtual":
        f(old), f(new, is_virtual=True)
    elif name == "pure":
        f(old, is_virtual=True), f(new, is_virtual=True, is_pure_virtual=True)
    elif name == "virtual_method":
        f(new, is_virtual=True)
    elif name == "overload":
        f(old)
        f(new)
        new["functions"].append(S.function("f", mangled="_Z1fd", params=("double",)))
    elif name == "union_field":
        rec(new, "U")["fields"].append(rec(new, "U")["fields"][0] | {"name": "d", "type": "float"})
    elif name == "typedef":
        old["typedefs"], new["typedefs"] = {"T": "int"}, {"T": "long"}
    elif name == "constant":
        old["constants"], new["constants"] = {"N": "1"}, {"N": "2"}
    elif name == "default":
        f(old), f(new)
        old["functions"][-1]["params"][0]["default"] = "3"
    return old, new


#: mutation, kind, kind of the reverse direction (None: only that nothing of the context is named)
MUTATIONS = [
    ("parameter", "func_params_changed", "func_params_changed"), ("return", "func_return_changed", "func_return_changed"), ("removed", "func_removed", "func_added"), ("added", "func_added", "func_removed"), ("noexcept", "func_noexcept_added", "func_noexcept_removed"),
    ("size", "type_size_changed", "type_size_changed"), ("field_type", "type_field_type_changed", "type_field_type_changed"), ("field_renamed", "field_renamed", "field_renamed"), ("enum_value", "enum_member_value_changed", "enum_member_value_changed"), ("enum_added", "enum_member_added", "enum_member_removed"),
    ("enum_renamed", "enum_member_renamed", "enum_member_renamed"), ("var_removed", "var_removed", "var_added"), ("vtable", "type_vtable_changed", "type_vtable_changed"), ("base", "type_base_changed", "type_base_changed"), ("virtual", "func_virtual_added", "func_virtual_removed"),
    ("pure", "func_virtual_became_pure", None), ("virtual_method", "virtual_method_added", "func_removed"), ("overload", "overload_added", "func_removed"), ("union_field", "union_field_added", "union_field_removed"), ("typedef", "typedef_base_changed", "typedef_base_changed"),
    ("constant", "constant_changed", "constant_changed"), ("default", "param_default_value_removed", None),
]


@pytest.fixture(scope="module")
def result(spark):
    docs, pairs = [], []
    for name, *_ in MUTATIONS:
        old, new = change(name)
        docs += [S.snapshot(f"{name}-old", **old), S.snapshot(f"{name}-new", **new)]
        pairs += [(name, f"{name}-old", f"{name}-new"), (f"{name}-back", f"{name}-new", f"{name}-old"), (f"{name}-same", f"{name}-old", f"{name}-old")]
    out = P.compare(S.frame(spark, *docs), P.pairs_of(spark, pairs))
    return out.findings.collect(), {r.pair_id: r.verdict for r in out.verdicts.collect()}


@pytest.mark.parametrize(("name", "kind", "back"), MUTATIONS)
def test_mutation(result, name, kind, back):
    found, verdicts = result
    here = {r.kind for r in found if r.pair_id == name and r.disposition == "active"}
    assert kind in here
    if back:
        assert back in {r.kind for r in found if r.pair_id == f"{name}-back" and r.disposition == "active"}
    assert not [r for r in found if r.pair_id == f"{name}-same"]
    assert verdicts[f"{name}-same"] == "NO_CHANGE"
    assert not [r for r in found if r.pair_id.startswith(name) and r.symbol.startswith("ctx_")]
    if kinds.VERDICT[kind] == "BREAKING":
        assert verdicts[name] == "BREAKING"


def test_unreachable_types_leave_the_surface(spark):
    old, new = S.context(), S.context()
    for doc, size in ((old, 64), (new, 128)):
        doc["records"].append(S.record("Hidden", size))
    out = P.compare(S.frame(spark, S.snapshot("a", **old), S.snapshot("b", **new)), P.pairs_of(spark, [("p", "a", "b")]), detectors_=["types"])
    (row,) = [r for r in out.findings.collect() if r.symbol == "Hidden"]
    assert row.disposition == "out_of_surface"
    assert out.verdicts.first().verdict == "NO_CHANGE"


def test_suppression_policy_and_affected(spark):
    old, new = S.context(), S.context()
    next(r for r in new["records"] if r["type_key"] == "S")["size_bits"] = 128
    new["constants"] = {"N": "2"}
    docs, pairs = S.frame(spark, S.snapshot("a", **old, elf={"soname": "libx.so.1", "needed": []}), S.snapshot("b", **new, elf={"soname": "libx.so.1", "needed": []})), P.pairs_of(spark, [("p", "a", "b")])
    some = {"detectors_": ["types", "constants"]}
    out = P.compare(docs, pairs, **some)
    (size,) = [r for r in out.findings.collect() if r.kind == "type_size_changed"]
    assert size.affected == ["_Z4_apii"]
    assert [r.kind for r in out.advice.collect()] == ["soname_bump_recommended"]
    assert out.releases.first().release == "major"
    rules = spark.createDataFrame([(0, "S", None, "type_size_changed", None, None, None)], "rule_idx int, symbol string, symbol_pattern string, change_kind string, source_glob string, namespace string, expires date")
    quiet = P.compare(docs, pairs, suppressions=rules, **some)
    assert {r.kind: r.disposition for r in quiet.findings.collect()}["type_size_changed"] == "suppressed"
    assert quiet.verdicts.first().verdict == "COMPATIBLE"
    assert P.compare(docs, pairs, overrides={"type_size_changed": "ignore"}, **some).verdicts.first().verdict == "COMPATIBLE"
    assert P.compare(docs, pairs, overrides={"type_size_changed": "ignore"}, frozen=["S"], **some).verdicts.first().verdict == "BREAKING"


def test_elf_and_kabi(spark):
    sym = lambda n, **k: {"name": n, "binding": "global", "sym_type": "func", "visibility": "default", "size": 8, "version": "V_1", "is_default": True} | k
    elf = {"soname": "libx-0abc12.so.1", "needed": ["liba.so.1", "libb.so.2"], "versions_defined": ["V_1"], "versions_required": {"libc.so.6": ["GLIBC_2.17"]}, "rpath": "/x", "runpath": "", "relro": "full", "bind_now": True}
    crc = {"crc": "0x1", "symbol": "k", "module": "vmlinux", "export_type": "EXPORT_SYMBOL", "namespace": ""}
    a = S.snapshot("a", elf=elf, elf_symbols=[sym("f"), sym("t", sym_type="object", size=16), sym("_ZTV1A", sym_type="object", size=32)], elf_imports=[sym("i", binding="weak")], kabi=[crc, crc | {"symbol": "dead"}])
    b = copy.deepcopy(a) | {"snapshot_id": "b"}
    b["elf"] |= {"soname": "libx-9def34.so.1", "needed": ["libb.so.2", "liba.so.1"], "versions_required": {"libc.so.6": ["GLIBC_2.34"]}, "rpath": "", "runpath": "/x", "relro": "partial", "bind_now": False}
    b["elf_symbols"] = [sym("f", binding="weak", version="V_2"), sym("t", sym_type="object", size=24, version="V_2"), sym("_ZTV1A", sym_type="object", size=40, version="V_2")]
    b["elf_imports"] = [sym("i")]
    b["kabi"] = [crc | {"crc": "0x2", "export_type": "EXPORT_SYMBOL_GPL", "namespace": "NS"}]
    found = P.compare(S.frame(spark, a, b), P.pairs_of(spark, [("p", "a", "b")]), detectors_=["elf_header", "elf_symbols", "elf_imports", "kabi"]).findings.collect()
    got = {r.kind for r in found}
    want = {"needed_order_changed", "rpath_type_changed", "relro_weakened", "bind_now_disabled", "symbol_version_required_added", "runtime_floor_raised", "symbol_binding_changed", "symbol_size_changed", "vtable_slot_count_changed", "symbol_moved_version_node", "symbol_version_node_removed", "imported_symbol_added", "kabi_crc_changed", "kabi_export_type_changed", "kabi_symbol_namespace_changed", "kabi_symbol_removed"}
    assert sorted(want - got) == []
    assert not got & {"soname_changed", "needed_added", "needed_removed", "rpath_changed", "symbol_version_defined_removed"}


def test_release_and_reports(spark):
    import json

    from quillon.sinks import report

    old, new = S.context(), S.context()
    new["functions"].pop()
    docs = S.frame(spark, *(S.snapshot(f"{lib}{v}", **d) | {"library": lib, "version": v} for lib, v, d in (("liba.so.1", "1", old), ("liba.so.2", "2", new), ("libold.so", "1", old), ("libnew.so", "2", old))))
    out, only = P.compare_release(docs, "1", "2", detectors_=["functions", "types"])
    assert {(r.pair_id, r.kind) for r in only.collect()} == {("libold.so", "bundle_library_removed"), ("libnew.so", "bundle_library_added")}
    assert {r.pair_id: r.verdict for r in out.verdicts.collect()} == {"liba.so": "BREAKING"}
    doc = json.loads(report.sarif(out.findings).first().document)
    assert doc["version"] == "2.1.0" and any(r["ruleId"] == "func_removed" and r["level"] == "error" for r in doc["runs"][0]["results"])
    assert "**func_removed** `_Z4_apii`" in report.markdown(out.findings).first().document
    assert "failures=" in report.junit(out.findings).first().document
    assert "<table>" in report.html(out.findings).first().document
    back = json.loads(report.json_report(out.findings, limit=1).first().document)
    assert len(back["changes"]) == 1 and back["truncated"] == (back["n_changes"] > 1)
    assert report.annotations(out.findings, 1).first().line.startswith("::error title=")
    assert report.suggest_suppressions(out.findings, "2024-01-01").count() >= 1


def test_machine_reports_are_whole(spark):
    import json
    import re

    from quillon.sinks import report

    n = report.LIMIT + 5
    found = spark.range(n).selectExpr("'p' as pair_id", "'func_removed' as kind", "concat('f', id) as symbol", "cast(null as string) as old_value", "cast(null as string) as new_value", "'BREAKING' as effective_verdict", "'active' as disposition", "'functions' as detector")
    assert len(json.loads(report.sarif(found).first().document)["runs"][0]["results"]) == n
    back = json.loads(report.json_report(found).first().document)
    assert len(back["changes"]) == n and not back["truncated"]
    assert len(re.findall("<testcase ", report.junit(found).first().document)) == n
    assert report.html(found).first().document.count("<td>func_removed</td>") == n
    assert "5 more findings are not shown." in report.markdown(found).first().document
