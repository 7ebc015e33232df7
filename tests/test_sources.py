from __future__ import annotations

import json
import struct

import pytest
import snapshots as S
from pyspark.sql import functions as F
from quillon.operators import detectors
from quillon.sinks import report
from quillon.sources import readers
from quillon.streaming import ingest


def test_symvers_and_kabi(spark, tmp_path):
    (tmp_path / "a").write_text("0x1\tf\tvmlinux\tEXPORT_SYMBOL\n\nbroken line\n0x2\tg\tm\tEXPORT_SYMBOL_GPL\tNS\n0x3\tf\tvmlinux\tEXPORT_SYMBOL\n")
    (tmp_path / "b").write_text("0x3\tf\tvmlinux\tEXPORT_SYMBOL_GPL\n")
    a, b = (readers.read_symvers(spark, str(tmp_path / x)) for x in "ab")
    assert {(r.symbol, r.crc, r.namespace) for r in a.collect()} == {("f", "0x3", ""), ("g", "0x2", "NS")}
    assert {(r.kind, r.symbol) for r in detectors.kabi_diff(a, b).collect()} == {("kabi_export_type_changed", "f"), ("kabi_symbol_removed", "g")}


def test_line_formats(spark, tmp_path):
    (tmp_path / "s").write_text('libfoo.so.1 libfoo1 #MINVER#\n f@V_1 1.0\n (c++|optional)"g(int)@V_2" 1.1\n (c++)"h(int)"@V_2 1.2\n')
    assert {(r.symbol, r.version_node, r.min_version) for r in readers.read_debian_symbols(spark, str(tmp_path / "s")).collect()} >= {("f", "V_1", "1.0"), ("h(int)", "V_2", "1.2")}
    (tmp_path / "d").write_text("a.o: a.c \\\n  inc/a.h inc/b\\ c.h\n")
    assert {r.include for r in readers.read_depfiles(spark, str(tmp_path / "d")).collect()} == {"a.c", "inc/a.h", "inc/b c.h"}
    (tmp_path / "m").write_text("#define A 1\n#define F(x) ((x)+1)\nint x;\n#define E\n")
    assert {(r.macro, r.value) for r in readers.read_macros(spark, str(tmp_path / "m")).collect()} == {("A", "1"), ("F", "(x) ((x)+1)"), ("E", "")}
    (tmp_path / "c.json").write_text(json.dumps([{"directory": "/b", "file": "x.cc", "arguments": ["c++", "-DA=1", "-DB", "-Iinc", "-std=c++20", "x.cc"]}]))
    row = readers.read_compile_commands(spark, str(tmp_path / "c.json")).first()
    assert (row.defines, row.includes, row.std) == ({"A": "1", "B": "1"}, ["inc"], "c++20")
    (tmp_path / "x.h").write_text("#pragma pack(1)\nstruct A {\n  unsigned b : 3;\n  virtual void f();\n};\n")
    assert {(r.line_no, r.fact) for r in readers.scan_source(spark, str(tmp_path / "x.h")).collect()} == {(1, "pragma_pack"), (3, "bit_field"), (4, "virtual_method")}


def test_snapshot_version_gate(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps(S.snapshot("a", functions=[S.function("f")])))
    doc = readers.read_snapshots(spark, str(tmp_path / "ok.json"))
    assert readers.relation(doc, "functions").first().name == "f"
    (tmp_path / "new.json").write_text(json.dumps(S.snapshot("a") | {"schema_version": 99}))
    with pytest.raises(Exception, match="schema version 99"):
        readers.read_snapshots(spark, str(tmp_path / "new.json")).collect()
    report.write_snapshots(doc, str(tmp_path / "out"))
    assert readers.read_snapshots(spark, str(tmp_path / "out")).first() == doc.first()


def tiny_elf() -> bytes:
    """A 64-bit shared object of nothing but its dynamic section, dynamic symbols and strings."""
    strings = b"\0libx.so.1\0libc.so.6\0f\0g\0"
    dyn = b"".join(struct.pack("<qQ", t, v) for t, v in ((14, 1), (1, 11), (0, 0)))
    sym = bytes(24) + struct.pack("<IBBHQQ", 21, (1 << 4) | 2, 0, 5, 0x10, 8) + struct.pack("<IBBHQQ", 23, (2 << 4) | 0, 0, 0, 0, 0)
    bodies = [(3, strings, 0), (6, dyn, 1), (11, sym, 1)]
    at, blobs, heads = 64, b"", struct.pack("<IIQQQQIIQQ", *[0] * 10)
    for kind, body, link in bodies:
        heads += struct.pack("<IIQQQQIIQQ", 0, kind, 0, 0, at + len(blobs), len(body), link, 0, 8, 0)
        blobs += body
    head = b"\x7fELF" + bytes([2, 1, 1]) + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, at + len(blobs), 0, 64, 0, 0, 64, 4, 0)
    return head + blobs + heads


def test_elf_and_classification(spark, tmp_path):
    (tmp_path / "libx.so").write_bytes(tiny_elf())
    (tmp_path / "x.json").write_text("{}")
    row = readers.read_elf(spark, str(tmp_path)).first()
    assert (row.soname, row.needed, [s.name for s in row.symbols], [(s.name, s.binding) for s in row.imports]) == ("libx.so.1", ["libc.so.6"], ["f"], [("g", "weak")])
    assert {r.path.rsplit("/", 1)[1]: r.format for r in readers.classify_files(spark, str(tmp_path)).collect()} == {"libx.so": "elf", "x.json": "json"}


def test_stubs_and_preference(spark, tmp_path):
    (tmp_path / "m.pyi").write_text("def f(a, /, b=1, *, c): ...\nclass K:\n    def m(self): ...\n")
    got = {r.qualname: [(p.name, p.kind, p.has_default) for p in r.params] for r in readers.read_stubs(spark, str(tmp_path)).collect()}
    assert got == {"f": [("a", "positional_only", False), ("b", "positional", True), ("c", "keyword_only", False)], "K": [], "K.m": [("self", "positional", False)]}
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert {tuple(r) for r in readers.first_available([a, b], "k").collect()} == {("x", 1), ("y", 3)}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fact = {"tu_id": "t", "kind": "macro", "qualified_name": "A", "type_hash": "h"}
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in (fact, fact, fact | {"qualified_name": "B"})))
    stream = ingest.deduplicated_facts(ingest.fact_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("facts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.qualified_name for r in spark.table("facts").collect()} == {"A", "B"} and spark.table("facts").count() == 2
    from quillon.operators import diff

    base = spark.createDataFrame([("t", "A"), ("t", "C")], "tu_id string, qualified_name string")
    q = ingest.compare_against_baseline(ingest.fact_stream(spark, str(tmp_path / "in")), base, lambda o, n: diff.keyed_diff(o, n.select("tu_id", "qualified_name").distinct(), ["tu_id", "qualified_name"]), str(tmp_path / "out"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert {(r.change, r.qualified_name) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("removed", "C"), ("added", "B")}


def test_windowed_counts_need_a_watermark(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in ingest.windowed_counts(e, "t", "k").collect()) == [1, 2]


def test_debian_symbols_document(spark):
    e = spark.createDataFrame([("libx.so.1", "g", "V_1"), ("libx.so.1", "f", "")], "library string, name string, version string")
    assert report.debian_symbols(e, "libx1").first().document == "libx.so.1 libx1 #MINVER#\n f@Base #MINVER#\n g@V_1 #MINVER#\n"
