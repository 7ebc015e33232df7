"""Readers of the formats that interface descriptions come in, each as a relation.

Line formats are read with the text source and built-in functions, so files split and filters push down;
binary formats are read with binaryFile, one file a row, and parsed in Arrow batches.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import schemas

#: Newest document version that is read.
SCHEMA_VERSION = 18


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents (one JSON document a file).  Missing version: 1; a newer major version than ours is refused."""
    docs = spark.read.schema(schemas.SNAPSHOT).option("multiLine", True).json(path).withColumn("schema_version", F.coalesce("schema_version", F.lit(1)))
    return docs.withColumn("schema_version", F.when(F.col("schema_version") > SCHEMA_VERSION, F.raise_error(F.concat(F.lit("snapshot schema version "), F.col("schema_version").cast("string"), F.lit(" is not known")))).otherwise(F.col("schema_version")))


def relation(docs: DataFrame, name: str) -> DataFrame:
    """One nested list of the documents as rows, with snapshot_id and ordinal (lists have an order, tables none)."""
    return docs.select("snapshot_id", F.posexplode(name).alias("ordinal", "_e")).select("snapshot_id", "ordinal", "_e.*")


def read_symvers(spark: SparkSession, path: str) -> DataFrame:
    """Module.symvers: crc, symbol, module, export_type, namespace.  Lines of under four fields are skipped; the last of a symbol counts."""
    part = F.split("value", "\t")
    field = lambda i: F.trim(F.coalesce(F.try_element_at(part, F.lit(i)), F.lit("")))
    rows = spark.read.text(path).filter(F.size(part) >= 4).select(field(1).alias("crc"), field(2).alias("symbol"), field(3).alias("module"), field(4).alias("export_type"), field(5).alias("namespace"), F.monotonically_increasing_id().alias("_at"))
    last = rows.filter("symbol <> ''").groupBy("symbol").agg(F.max_by(F.struct("crc", "module", "export_type", "namespace"), "_at").alias("_r"))
    return last.select("_r.crc", "symbol", "_r.module", "_r.export_type", "_r.namespace")


def read_debian_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Debian symbols files: library, package, tags, symbol, version_node, min_version."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"))
    head = lines.filter(~F.startswith("value", F.lit(" ")) & F.col("value").rlike(r"^\S+\s+\S+\s+\S")).select("_file", F.regexp_extract("value", r"^(\S+)\s+(\S+)", 1).alias("library"), F.regexp_extract("value", r"^(\S+)\s+(\S+)", 2).alias("package")).dropDuplicates(["_file"])
    row = r'^\s+(?:\(([^)]*)\))?(?:"([^"]+)"|([^\s"]+?))@(\S+)\s+(\S+)'
    got = lines.filter(F.col("value").rlike(row)).select(
        "_file", F.split(F.regexp_extract("value", row, 1), r"\|").alias("tags"), F.concat(F.regexp_extract("value", row, 2), F.regexp_extract("value", row, 3)).alias("symbol"),
        F.regexp_extract("value", row, 4).alias("version_node"), F.regexp_extract("value", row, 5).alias("min_version"),
    )
    return got.join(head, "_file").select("library", "package", F.filter("tags", lambda x: x != "").alias("tags"), "symbol", "version_node", "min_version")


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """compile_commands.json: file, directory, arguments, defines, includes, std, target."""
    raw = spark.read.schema("directory string, file string, command string, arguments array<string>, output string").option("multiLine", True).json(path)
    args = F.coalesce("arguments", F.filter(F.split(F.coalesce("command", F.lit("")), r"\s+"), lambda x: x != ""))
    out = raw.select("file", "directory", args.alias("arguments"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^-D([^=]+)", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, r"^-D[^=]+=(.*)$", 1)).otherwise("1").alias("v"))
    defines = F.aggregate(F.transform(F.filter("arguments", lambda x: x.rlike("^-D.")), pair), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    first = lambda pattern: F.element_at(F.concat(F.transform(F.filter("arguments", lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, 1)), F.array(F.lit(None).cast("string"))), 1)
    return out.select("file", "directory", "arguments", defines.alias("defines"), F.transform(F.filter("arguments", lambda x: x.rlike("^-I.")), lambda x: F.substring(x, 3, 4096)).alias("includes"), first("^-std=(.+)$").alias("std"), first("^--target=(.+)$").alias("target"))


def read_depfiles(spark: SparkSession, path: str) -> DataFrame:
    """Make-style dependency files: file, target, include."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\\\r?\n", " ").alias("_t"))
    rule = text.select("file", F.explode(F.split("_t", r"\r?\n")).alias("_l")).filter(F.col("_l").rlike(r"^[^:]+:(\s|$)"))
    deps = F.split(F.trim(F.regexp_replace(F.regexp_extract("_l", r"^[^:]+:\s*(.*)$", 1), r"\\ ", "\u0001")), r"\s+")
    return rule.select("file", F.trim(F.regexp_extract("_l", r"^([^:]+):", 1)).alias("target"), F.explode(deps).alias("include")).filter("include <> ''").withColumn("include", F.regexp_replace("include", "\u0001", " "))


def read_macros(spark: SparkSession, path: str) -> DataFrame:
    """Macro dumps (-dM -E): file, macro, value; function-like macros keep their parameters in the value."""
    row = r"^#define\s+([A-Za-z_]\w*)(\([^)]*\))?\s*(.*)$"
    return spark.read.text(path).filter(F.col("value").rlike(row)).select(F.input_file_name().alias("file"), F.regexp_extract("value", row, 1).alias("macro"), F.trim(F.concat_ws(" ", F.nullif(F.regexp_extract("value", row, 2), F.lit("")), F.regexp_extract("value", row, 3))).alias("value"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Fact packs, one JSON object a line; broken lines are kept in _corrupt_record for diagnostics."""
    return spark.read.schema(schemas.FACTS + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """changes[] of comparison reports: target, profile, check_id, complete, and the finding; a truncated report is not complete."""
    docs = spark.read.schema(schemas.REPORT).option("multiLine", True).json(path)
    return docs.select("target", "profile", "check_id", (~F.coalesce("truncated", F.lit(False))).alias("complete"), F.explode_outer("changes").alias("_c")).select("target", "profile", "check_id", "complete", "_c.*")


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and format (elf, pe, macho, archive, json, perl, text, other) by leading bytes."""
    files = spark.read.format("binaryFile").load(path)
    magic = F.hex(F.substring("content", 1, 4))
    head = F.ltrim(F.decode(F.substring("content", 1, 64), "ISO-8859-1"))
    kind = (
        F.when(magic == "7F454C46", "elf").when(F.startswith(magic, F.lit("4D5A")), "pe").when(magic.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE"), "macho")
        .when(magic == "213C6172", "archive").when(head.rlike(r"^[\[{]"), "json").when(head.rlike(r"^\$VAR1"), "perl").when(head.rlike(r"^[\x09\x0A\x0D\x20-\x7E]*$"), "text").otherwise("other")
    )
    return files.select("path", "length", kind.alias("format"))


def _cstr(table: bytes, at: int) -> str:
    end = table.find(b"\0", at)
    return table[at : end if end >= 0 else None].decode("utf-8", "replace")


#: Fixed values of the ELF format: symbol bindings, types and visibilities.
_BIND = {0: "local", 1: "global", 2: "weak", 10: "unique"}
_TYPE = {0: "notype", 1: "object", 2: "func", 5: "common", 6: "tls", 10: "ifunc"}
_VIS = {0: "default", 1: "internal", 2: "hidden", 3: "protected"}


def parse_elf(data: bytes) -> dict:
    """soname, needed, rpath, runpath, symbols and imports of a shared object; an empty dict if it is none."""
    if data[:4] != b"\x7fELF":
        return {}
    wide, end = data[4] == 2, "<" if data[5] == 1 else ">"
    off, size, num = (struct.unpack_from(end + "Q", data, 40)[0], *struct.unpack_from(end + "HH", data, 58)) if wide else (struct.unpack_from(end + "I", data, 32)[0], *struct.unpack_from(end + "HH", data, 46))
    names = "name type flags addr offset size link info align entsize".split()
    sections = [dict(zip(names, struct.unpack_from(end + ("IIQQQQIIQQ" if wide else "10I"), data, off + i * size), strict=True)) for i in range(num)]
    body = lambda s: data[s["offset"] : s["offset"] + s["size"]]
    out: dict = {"soname": None, "needed": [], "rpath": None, "runpath": None, "symbols": [], "imports": []}
    for s in sections:
        if s["type"] == 6:  # dynamic
            strings, entry = body(sections[s["link"]]), struct.Struct(end + ("qQ" if wide else "iI"))
            for tag, value in entry.iter_unpack(body(s)[: s["size"] // entry.size * entry.size]):
                if tag == 1:
                    out["needed"].append(_cstr(strings, value))
                elif tag in (14, 15, 29):
                    out[{14: "soname", 15: "rpath", 29: "runpath"}[tag]] = _cstr(strings, value)
        elif s["type"] == 11:  # dynsym
            strings, entry = body(sections[s["link"]]), struct.Struct(end + ("IBBHQQ" if wide else "IIIBBH"))
            for row in list(entry.iter_unpack(body(s)[: s["size"] // entry.size * entry.size]))[1:]:
                name, info, other, shndx, _, length = row if wide else (row[0], row[3], row[4], row[5], row[1], row[2])
                item = {"name": _cstr(strings, name), "binding": _BIND.get(info >> 4, str(info >> 4)), "sym_type": _TYPE.get(info & 15, str(info & 15)), "visibility": _VIS[other & 3], "size": length}
                (out["imports"] if shndx == 0 else out["symbols"]).append(item)
    return out


def read_elf(spark: SparkSession, path: str) -> DataFrame:
    """Shared objects: path, soname, needed, rpath, runpath, symbols, imports."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": p, **got} for p, c in zip(frame.path, frame.content, strict=True) if (got := parse_elf(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "soname", "needed", "rpath", "runpath", "symbols", "imports"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schemas.ELF)


def read_stubs(spark: SparkSession, path: str) -> DataFrame:
    """Python stub files: file, qualname, kind, params (name, kind, has_default)."""

    def walk(tree: ast.AST, prefix: str = "") -> Iterator[tuple]:
        for node in getattr(tree, "body", []):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a, plain = node.args, [*node.args.posonlyargs, *node.args.args]
                optional = len(plain) - len(a.defaults)
                params = [(p.arg, "positional_only" if i < len(a.posonlyargs) else "positional", i >= optional) for i, p in enumerate(plain)]
                params += [(a.vararg.arg, "var_positional", False)] if a.vararg else []
                params += [(p.arg, "keyword_only", d is not None) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
                params += [(a.kwarg.arg, "var_keyword", False)] if a.kwarg else []
                yield prefix + node.name, "method" if prefix else "function", [dict(zip(("name", "kind", "has_default"), p, strict=True)) for p in params]
            elif isinstance(node, ast.ClassDef):
                yield prefix + node.name, "class", []
                yield from walk(node, prefix + node.name + ".")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f, *x) for f, text in zip(frame.file, frame.value, strict=True) for x in walk(ast.parse(text))]
            yield pd.DataFrame(rows, columns=["file", "qualname", "kind", "params"])

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(parse, "file string, qualname string, kind string, params array<struct<name:string,kind:string,has_default:boolean>>")


#: Patterns of source constructs that put a binary interface at risk: (fact, Java regular expression).
PATTERNS = (
    ("pragma_pack", r"^\s*#\s*pragma\s+pack\b"), ("packed_attribute", r"__attribute__\s*\(\(.*\bpacked\b|\[\[gnu::packed\]\]"), ("alignas", r"\balignas\s*\("), ("bit_field", r"^\s*(?:unsigned|signed|int|u?int\d+_t)\s+\w*\s*:\s*\d+\s*;"),
    ("virtual_method", r"\bvirtual\b[^;{]*\("), ("inline_namespace", r"\binline\s+namespace\b"), ("extern_c", r"extern\s+\"C\""), ("std_container_by_value", r"\bstd::(?:vector|string|map|function|optional)\b[^&*;]*\s+\w+\s*;"), ("visibility_attribute", r"visibility\s*\(\s*\"\w+\"\s*\)"), ("long_double", r"\blong\s+double\b"),
)


def scan_patterns(lines: DataFrame, line: str = "line", patterns: tuple[tuple[str, str], ...] = PATTERNS) -> DataFrame:
    """A row for each line and pattern that it holds: the columns of lines, and fact."""
    facts = F.filter(F.array(*(F.when(F.col(line).rlike(p), F.lit(name)) for name, p in patterns)), lambda x: x.isNotNull())
    return lines.withColumn("fact", F.explode(facts))


def scan_source(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, fact of source files; one file is one row until its lines are exploded, so lines keep numbers."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("_n", "line"))
    return scan_patterns(lines.select("file", (F.col("_n") + 1).alias("line_no"), "line")).select("file", "line_no", "fact")


def read_descriptor(spark: SparkSession, path: str, row_tag: str = "descriptor") -> DataFrame:
    """XML descriptors: version, headers and libs."""
    return spark.read.format("xml").option("rowTag", row_tag).schema("version string, headers string, libs string").load(path)


def first_available(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that has their key; sources in order of preference, of one schema."""
    ranked = None
    for k, df in enumerate(sources):
        ranked = df.withColumn("_rank", F.lit(k)) if ranked is None else ranked.unionByName(df.withColumn("_rank", F.lit(k)), allowMissingColumns=True)
    rest = [c for c in ranked.columns if c not in (key, "_rank")]
    return ranked.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("_r")).select(key, "_r.*")
