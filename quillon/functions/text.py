"""Scalar functions over names, types, versions and paths, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and prefixes of symbols that toolchains emit, not libraries.
LINKER_NAMES = ("_init", "_fini", "__bss_start", "_edata", "_end")
THUNK_PREFIXES = ("_ZTh", "_ZTv", "_ZTc")
COMPILER_PREFIXES = ("ix86_", "x86_64_", "__cpu_model", "__cpu_features", "_ZGV", "__svml_", "__libm_sse2_", "__libm_avx_")
RUNTIME_PREFIXES = ("std::", "__gnu_cxx::", "__gnu_debug::", "__cxxabiv1::", "__cxx11::", "_ZNSt", "_ZNKSt", "_ZNVSt", "_ZNRSt", "_ZNKRSt", "_ZNVRSt", "_ZNSt3__1", "_ZdlPv", "_ZnwSt", "_ZnaSt", "_ZdaPv", "_ZTVN10__cxxabiv", "_ZSt")
# Symbol types of callables and of data.
FUNCTION_TYPES = ("func", "ifunc", "notype")
VARIABLE_TYPES = ("object", "tls", "common", "notype")
# Marks of version nodes that are not public.
PRIVATE_NODE_MARKS = ("PRIVATE", "INTERNAL")
# Types of compilers, namespaces of the standard library, marks of types without a name, beginnings of the
# names of C++ runtime libraries, and floating types that make a homogeneous aggregate.
COMPILER_TYPES = ("__va_list_tag", "__builtin_va_list", "__gnuc_va_list", "__int128", "__int128_t", "__uint128_t", "__NSConstantString_tag", "__NSConstantString")
STDLIB_NAMESPACES = ("std::", "__gnu_cxx::", "__gnu_debug::", "__cxxabiv1::", "__cxx11::")
ANONYMOUS_MARKS = ("<lambda", "{lambda", "(anonymous", "(unnamed", "<unnamed")
CXX_RUNTIMES = ("stdc++", "c++abi", "supc++", "c++")
HFA_TYPES = ("float", "double", "long double", "__fp16", "_Float16", "__bf16")
RTTI_PREFIXES = ("_ZTI", "_ZTS", "_ZTV", "_ZTT")


def _starts(col: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(col, F.lit(p))
    return out


def abi_relevant(name: Column, runtime_is_foreign: bool = True) -> Column:
    """False for symbols that are not a library's own: linker, thunk, compiler, runtime and private C names."""
    drop = name.isin(*LINKER_NAMES) | _starts(name, THUNK_PREFIXES) | _starts(name, COMPILER_PREFIXES)
    if runtime_is_foreign:
        drop = drop | _starts(name, RUNTIME_PREFIXES) | name.rlike("^_ZT[ISVT](St|NSt|N10__cxxabiv)")
    private = ~F.startswith(name, F.lit("_Z")) & F.contains(F.substring(name, 3, 1 << 30), F.lit("__"))
    return F.coalesce((F.length(name) > 0) & ~drop & ~private, F.lit(False))


def symbol_origin(name: Column) -> Column:
    """rtti, internal or public."""
    return F.when(_starts(name, RTTI_PREFIXES), "rtti").when(name.rlike(r"(?i)(8internal|6detail|4impl|internal::|detail::|impl::)"), "internal").otherwise("public")


def tag_version(tag: Column) -> Column:
    """Numbers after the last "_" of a tag such as GLIBC_2.34; null if a part is no number of 1 to 9 digits."""
    number = F.regexp_extract(tag, r"(?:^|_)([0-9]{1,9}(?:\.[0-9]{1,9})*)$", 1)
    return F.when(number != "", F.transform(F.split(number, r"\."), lambda x: x.cast("int")))


def padded(a: Column, b: Column) -> Column:
    """a, with zeros up to the length of b."""
    return F.concat(a, F.array_repeat(F.lit(0), F.greatest(F.size(b) - F.size(a), F.lit(0))))


def version_le(a: Column, b: Column) -> Column:
    """a <= b as dotted versions: 2 equals 2.0.  A null (unparseable) version is newer than all others."""
    return F.when(a.isNull(), b.isNull()).when(b.isNull(), F.lit(True)).otherwise(padded(a, b) <= padded(b, a))


def private_node(version: Column) -> Column:
    out = F.lit(False)
    for mark in PRIVATE_NODE_MARKS:
        out = out | F.contains(F.upper(version), F.lit(mark))
    return out


def strip_vendor_hash(name: Column) -> Column:
    """A library name without the content hash that wheel repair tools add."""
    return F.regexp_replace(name, r"-(?=[0-9a-f]*[a-f])[0-9a-f]{6,16}(?=\.(?:so|dylib)\b|\.\d)", "")


def library_key(name: Column) -> Column:
    """Key of a library across releases: lower-cased, unhashed, without what follows .so."""
    return F.regexp_replace(strip_vendor_hash(F.lower(name)), r"\.so(\..*)?$", ".so")


def soname_major(soname: Column) -> Column:
    return F.regexp_extract(soname, r"\.so\.(\d{1,9})", 1).try_cast("int")


def mangling(name: Column) -> Column:
    return F.when(name.rlike("^__?Z"), "itanium").when(F.startswith(name, F.lit("?")), "msvc").otherwise("none")


def normal_mangled(name: Column) -> Column:
    """Without the extra underscore of Mach-O."""
    return F.regexp_replace(name, "^__Z", "_Z")


def canonical_type(name: Column) -> Column:
    """One spelling of a C or C++ type: no tag word, const after its base, one space before * and &, no source place."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    tag = r"^(?:struct|class|union|enum)\s+"
    out = squeeze(F.regexp_replace(squeeze(name), r"\bat\s+\S+:\d+:\d+(?=\s*\))", ""))
    out = F.regexp_replace(F.regexp_replace(out, r" \)", ")"), tag, "")
    base = F.regexp_replace(F.trim(F.regexp_extract(out, r"^const\s+([\w\s:]+?)(?:\s*[*&].*)?$", 1)), tag, "")
    tail = F.regexp_extract(out, r"^const\s+[\w\s:]+?(\s*[*&].*)?$", 1)
    out = F.when(base != "", F.concat(base, F.lit(" const"), tail)).otherwise(out)
    return squeeze(F.regexp_replace(out, r"\s*([*&])\s*", " $1"))


def without_cv(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(canonical_type(name), r"\b(?:const|volatile)\b", ""), r"\s+", " "))


def cv_only(old: Column, new: Column) -> Column:
    """Spellings that differ in const and volatile only."""
    return (canonical_type(old) != canonical_type(new)) & (without_cv(old) == without_cv(new))


def type_names(name: Column) -> Column:
    """Candidate type names in a type string: qualified names and their last segments."""
    found = F.regexp_extract_all(name, F.lit(r"([A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)"), F.lit(1))
    known = F.filter(found, lambda x: ~x.isin("const", "volatile", "struct", "class", "union", "enum", "unsigned", "signed", "typename"))
    return F.array_distinct(F.concat(known, F.transform(known, lambda x: F.substring_index(x, "::", -1))))


def refers_to(type_name: Column, name: Column) -> Column:
    """The type string holds the name as a whole token."""
    return F.array_contains(type_names(type_name), name)


#: Levels of brackets that the patterns below follow; deeper or unbalanced names are folded token by token.
NESTED = 6
_PLAIN = r"[^<>()\[\]]"


def _bracketed(opening: str) -> str:
    """Pattern of a bracket with all that it holds; possessive, so it never goes back."""
    out = rf"{opening}{_PLAIN}*+[>)\]]"
    for _ in range(NESTED):
        out = rf"{opening}(?:{_PLAIN}++|{out})*+[>)\]]"
    return out


_GROUP = _bracketed(r"[<(\[]")
_BALANCED = rf"\A(?:{_PLAIN}++|{_GROUP})*+\z"
_SEGMENT = rf"(?:[^<>()\[\]:]++|{_GROUP})++"
#: What is before the first template arguments, these without their brackets, and the rest.
_TEMPLATE = rf"(?s)\A((?:{_PLAIN}++|" + _bracketed(r"[(\[]") + rf")*+)<((?:{_PLAIN}++|{_GROUP})*+)[>)\]](.*)\z"
_TOKEN = r"[<>()\[\],]|:+|[^<>()\[\],:]+"


def _fold(name: Column, zero: dict, step, finish) -> Column:
    """finish(name, state) after one pass over brackets, commas, colons and what is between.

    step(name, state, token, place of its first character, depth after it) gives the new values of zero's names.
    """

    def over(n):
        def merge(acc, t):
            depth = acc["depth"] + F.when(t.isin("<", "(", "["), 1).when(t.isin(">", ")", "]"), -1).otherwise(0)
            more = step(n, acc, t, acc["at"], depth)
            return F.struct((acc["at"] + F.length(t)).alias("at"), depth.alias("depth"), *(more[k].alias(k) for k in zero))

        start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), *(v.alias(k) for k, v in zero.items()))
        return F.aggregate(F.regexp_extract_all(n, F.lit(_TOKEN), F.lit(0)), start, merge, lambda acc: finish(n, acc))

    return F.element_at(F.transform(F.array(name), over), 1)  # so that name is computed once


def namespace_segments(name: Column) -> Column:
    """Segments between "::" that stand outside template arguments and parentheses."""
    zero = {"begin": F.lit(1), "parts": F.array().cast("array<string>")}

    def step(n, acc, t, at, depth):
        cut = F.startswith(t, F.lit(":")) & (depth == 0)
        return {"begin": F.when(cut, at + F.length(t)).otherwise(acc["begin"]), "parts": F.when(cut, F.concat(acc["parts"], F.array(F.substring(n, acc["begin"], at - acc["begin"])))).otherwise(acc["parts"])}

    last = lambda n, acc: F.filter(F.concat(acc["parts"], F.array(F.substring(n, acc["begin"], F.length(n)))), lambda x: x != "")
    return F.when(name.rlike(_BALANCED), F.regexp_extract_all(name, F.lit(_SEGMENT), F.lit(0))).otherwise(_fold(name, zero, step, last))


def base_name(name: Column) -> Column:
    """Last segment without template arguments and signature."""
    return F.regexp_extract(F.element_at(namespace_segments(name), -1), r"^(~?[A-Za-z_]\w*|operator[^(]+)", 1)


def _template(name: Column, finish) -> Column:
    """finish(name, state): places of the first "<" and of its end (0: none), and the commas of its own between them."""

    def step(n, acc, t, at, depth):
        inside = (acc["first"] > 0) & (acc["close"] == 0)
        return {
            "first": F.when((acc["first"] == 0) & (t == "<"), at).otherwise(acc["first"]), "close": F.when(inside & (depth == 0), at).otherwise(acc["close"]),
            "commas": acc["commas"] + F.when(inside & (t == ",") & (depth == 1), 1).otherwise(0),
        }

    return _fold(name, {k: F.lit(0) for k in ("first", "close", "commas")}, step, finish)


def template_stem(name: Column) -> Column:
    """Name without its first top-level template arguments."""
    cut = lambda n, x: F.when(x["close"] > 0, F.concat(F.substring(n, F.lit(1), x["first"] - 1), F.substring(n, x["close"] + 1, F.length(n)))).otherwise(n)
    return F.when(~F.contains(name, F.lit("<")), name).when(name.rlike(_TEMPLATE), F.regexp_replace(name, _TEMPLATE, "$1$3")).otherwise(_template(name, cut))


def template_arity(name: Column) -> Column:
    """Top-level arguments of the first template argument list; 0 without one."""
    own = F.regexp_replace(F.regexp_extract(name, _TEMPLATE, 2), _GROUP, "")
    commas = F.length(own) - F.length(F.replace(own, F.lit(","), F.lit("")))
    count = lambda n, x: F.when(x["close"] > 0, x["commas"] + 1).otherwise(0)
    return F.when(~F.contains(name, F.lit("<")), 0).when(name.rlike(_TEMPLATE), commas + 1).otherwise(F.coalesce(_template(name, count), F.lit(0)))


def cross_abi_name(name: Column, description: Column) -> Column:
    """Name of a declaration that does not depend on the mangling scheme: the demangled text, else the name."""
    return F.coalesce(F.nullif(F.regexp_extract(description, r"([A-Za-z_~][\w:~]*)\s*\(", 1), F.lit("")), normal_mangled(name))


def content_hash(*cols: Column | str) -> Column:
    """sha256 of the canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def edge_id(src: Column, dst: Column, kind: Column, role: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", src, dst, kind, F.coalesce(role, F.lit(""))), 256)


def redact(text: Column) -> Column:
    """Home folders and values of secret-like settings masked."""
    home = F.regexp_replace(text, r"(/home/|/Users/)[^/\s]+", "$1<user>")
    return F.regexp_replace(home, r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[=:]\s*)\S+", "$1<redacted>")


def expired(expires: Column, today: Column) -> Column:
    return F.coalesce(expires < today, F.lit(False))


def check_id(target: Column, profile: Column, channel: Column, depth: Column) -> Column:
    return F.concat(target, F.lit("@"), profile, F.lit("#"), channel, F.lit("@"), depth)


def glob_regex(glob: str) -> str:
    """Java and RE2 regular expression of a path glob (* and ? within names, ** across)."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else ("\\" + c if c in ".+^$(){}|[]\\" else c)
        i += 1
    return f"^{out}$"


def path_origin(path: Column, public_prefixes: tuple[str, ...]) -> Column:
    """PUBLIC_HEADER, GENERATED, SYSTEM_HEADER, PRIVATE_HEADER or UNKNOWN, in that order of precedence."""
    public = F.lit(False)
    for p in public_prefixes:
        public = public | F.startswith(path, F.lit(p.rstrip("/") + "/")) | F.contains(path, F.lit("/" + p.strip("/") + "/"))
    generated = path.rlike(r"(^|/)(generated|gen|autogen|build|cmake-build[^/]*)(/|$)")
    system = path.rlike(r"^(/usr/include|/usr/lib|/usr/local/include|/opt/[^/]+/include)(/|$)")
    return F.when(path.isNull() | (path == ""), "UNKNOWN").when(public, "PUBLIC_HEADER").when(generated, "GENERATED").when(system, "SYSTEM_HEADER").otherwise("PRIVATE_HEADER")


def integer_width(name: Column, model: str = "LP64") -> Column:
    """(bits, signed) of a built-in integer spelling under a data model, else null."""
    long_bits = 32 if model == "LLP64" else 64
    t = without_cv(name)
    unsigned = t.rlike(r"\bunsigned\b|^u?int\d+_t$") & ~t.rlike(r"^int\d+_t$")
    bits = (
        F.when(t.rlike(r"\blong long\b|^u?int64_t$"), 64).when(t.rlike(r"\blong\b") & ~t.rlike(r"\bdouble\b"), long_bits).when(t.rlike(r"\bshort\b|^u?int16_t$"), 16)
        .when(t.rlike(r"\bchar\b|^u?int8_t$"), 8).when(t.rlike(r"^(un)?signed( int)?$|\bint\b|^u?int32_t$"), 32)
    )
    return F.when(bits.isNotNull() & t.rlike(r"^(\w+ ?)+$"), F.struct(bits.alias("bits"), (~unsigned).alias("signed")))


def signature_cv_only(old: Column, new: Column) -> Column:
    """Spellings of a parameter or result that differ in const and volatile only, at any level; they name one function."""
    return cv_only(old, new)


def cxx_runtime(library: Column) -> Column:
    """The library (path, soname or short name) is a C++ runtime, whose own surface std:: is."""
    return F.coalesce(_starts(F.regexp_replace(F.substring_index(library, "/", -1), "^lib", ""), CXX_RUNTIMES), F.lit(False))


def non_abi_type(name: Column, exclude_stdlib: Column | None = None) -> Column:
    """Types that are no library's own surface: a compiler's, the standard library's (unless excluded from this), unnamed ones."""
    bare, pattern = F.trim(name), r"^typedef\s+(.+?)\s+([A-Za-z_][\w:]*)$"
    own = bare.isin(*COMPILER_TYPES) | (F.trim(F.regexp_extract(bare, pattern, 1)).isin(*COMPILER_TYPES) & F.regexp_extract(bare, pattern, 2).isin(*COMPILER_TYPES))
    out = own | (_starts(name, STDLIB_NAMESPACES) & (F.lit(True) if exclude_stdlib is None else exclude_stdlib))
    for mark in ANONYMOUS_MARKS:
        out = out | F.contains(name, F.lit(mark))
    return F.coalesce(out, F.lit(False))


def abi3_version(text: Column, known_minor: int = 15) -> Column:
    """(major, minor) of a floor such as 3 or 3.9, 3.2 at least; null if it is none or lies over ten releases beyond known_minor."""
    pattern = r"^\s*0*3(?:\.([0-9]{1,9}))?\s*$"
    minor = F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("int"), F.lit(0))
    return F.when(text.rlike(pattern) & (minor <= known_minor + 10), F.struct(F.lit(3).alias("major"), F.greatest(minor, F.lit(2)).alias("minor")))


def relation_key(src: Column, dst: Column, kind: Column, role: Column) -> Column:
    """Identity of an edge: the same ends and kind in another role are another edge."""
    return F.struct(src.alias("src"), dst.alias("dst"), kind.alias("kind"), F.coalesce(role, F.lit("")).alias("role"))


def hash_recipe(recipe: Column, producer: Column, producer_version: Column, family: Column, version: Column) -> Column:
    """Identity of the way in which hashes were made: the declared one, else producer and compiler with their versions."""
    parts = [F.coalesce(c, F.lit("")) for c in (producer, producer_version, family, version)]
    return F.coalesce(F.nullif(recipe, F.lit("")), F.concat_ws("|", *parts))


def aggregate_class(size: Column, members: Column) -> Column:
    """How AArch64 passes an aggregate by value: hfa<n>, hva<n>, register or indirect, from its size and its members' types."""
    some = F.filter(members, lambda x: F.coalesce(x != "", F.lit(False)))
    one = F.size(some).between(1, 4) & (F.size(F.array_distinct(some)) == 1)
    kind = F.lower(F.try_element_at(some, F.lit(1)))
    vector = kind.rlike(r"(?:u?int|float|poly|bfloat)\d+x\d+|vector|__simd")
    floating = F.try_element_at(some, F.lit(1)).isin(*HFA_TYPES)
    return F.when(one & floating, F.concat(F.lit("hfa"), F.size(some))).when(one & vector, F.concat(F.lit("hva"), F.size(some))).when(size > 16, "indirect").otherwise("register")
