"""Small snapshot documents for tests."""

from __future__ import annotations

import copy
import json

from quillon.sources import schemas


def function(name, mangled=None, ret="int", params=("int",), **more):
    base = {"mangled": mangled or f"_Z{len(name)}{name}i", "name": name, "return_type": ret, "params": [{"name": f"a{i}", "type": t, "pointer_depth": t.count("*"), "is_restrict": False, "is_va_list": False} for i, t in enumerate(params)], "visibility": "public", "access": "public"}
    flags = ("is_virtual", "is_noexcept", "is_extern_c", "is_static", "is_const", "is_volatile", "is_pure_virtual", "is_deleted", "is_inline")
    return base | dict.fromkeys(flags, False) | more


def record(name, size=64, fields=(("x", "int", 0),), **more):
    fs = [{"name": n, "type": t, "offset_bits": o, "is_bitfield": False, "is_const": False, "is_volatile": False, "is_mutable": False, "access": "public"} for n, t, o in fields]
    return {"type_key": name, "name": name, "kind": "struct", "size_bits": size, "alignment_bits": 32, "is_union": False, "is_opaque": False, "fields": fs, "bases": [], "virtual_bases": [], "vtable": []} | more


def enum(name, members, **more):
    return {"type_key": name, "name": name, "underlying_type": "int", "is_scoped": False, "members": [{"name": k, "value": v} for k, v in members]} | more


def snapshot(snapshot_id, **lists):
    base = {"snapshot_id": snapshot_id, "library": "libctx.so.1", "version": snapshot_id, "from_headers": True, "elf_only_mode": False, "schema_version": 18, "functions": [], "variables": [], "records": [], "enums": [], "typedefs": {}, "constants": {}, "elf_symbols": [], "elf_imports": [], "kabi": []}
    return base | copy.deepcopy(lists)


def context():
    """Declarations that never change and must never be reported."""
    return {
        "functions": [function("ctx_f", ret="ctx_T *", params=("ctx_T *", "ctx_E")), function("_api", params=("S *", "E", "V *", "U"))],
        "records": [record("ctx_T"), record("S", 64, (("a", "int", 0), ("b", "int", 32))), record("V", 64, vtable=["m0"], vptr_offset_bits=0), record("U", 32, (("i", "int", 0),), is_union=True, kind="union")],
        "enums": [enum("ctx_E", [("ctx_A", 0)]), enum("E", [("A", 0), ("B", 1)])], "variables": [{"mangled": "ctx_v", "name": "ctx_v", "type": "int", "visibility": "public", "is_const": False, "access": "public"}],
    }


def frame(spark, *docs):
    rows = spark.sparkContext.parallelize([json.dumps(d) for d in docs], 1)
    return spark.read.schema(schemas.SNAPSHOT).json(rows)
