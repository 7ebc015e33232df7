"""More detectors: the loader's and the processor's view of a binary, and patterns over whole families of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.detectors import Pair, _removed_added, _union, both, came, compared, detector, differs, gone, known, off, on
from quillon.storage import shuffled

# Operating systems that a loader treats alike, features of control-flow protection, levels of x86-64 from
# the least on, machines whose ABI flags are decoded, typedefs that time64 and large-file options resize, beginnings of
# global allocation functions, names of instruction sets (longer ones first), and endings of serialization tags.
BENIGN_OSABI = ("ELFOSABI_SYSV", "ELFOSABI_NONE", "ELFOSABI_GNU", "ELFOSABI_LINUX")
CET, BRANCH = ("IBT", "SHSTK"), ("BTI", "PAC")
X86_LEVELS = ("x86-64-baseline", "x86-64-v2", "x86-64-v3", "x86-64-v4")
DECODED = ("EM_ARM", "EM_RISCV", "EM_MIPS")
TIME64 = ("time_t", "suseconds_t", "off_t", "ino_t", "blkcnt_t", "fsblkcnt_t", "fsfilcnt_t", "rlim_t")
ALLOCATORS, PLACEMENT = "^_Zn[wa]|^_Zd[la]", "^_Zn[wa][jmy]Pv|^_Zd[la]Pv(?:S_|Pv)"
ISA = ("avx512", "avx2", "avx", "sse42", "sse41", "sse2", "sse", "neon", "sve", "scalar", "generic")
TAG_ENDS, TAG_LEAVES = ("_serialization_tag", "_serializationtag", "_tag", "serializationtag", "_tag_id", "_tagid"), ("tag_id", "tagid", "serializationtag")
INTERNAL = ("internal", "helper", "_impl", "detail", "private", "__", "_priv", "_int_")
UNSPECIFIED = ("auto", "__lambda", "(unnamed", "(anonymous", "{lambda", "<lambda")


def _words(x, c: str) -> Column:
    return F.array_sort(F.coalesce(x(c), F.array().cast("array<string>")))


def _joined(a: Column) -> Column:
    return F.when(F.size(a) == 0, "(none)").otherwise(F.array_join(a, ", "))


def header_rules(o, n):
    """Identity, loader contract and hardening of two ELF headers; what one side did not record is no change."""
    full = lambda x: F.coalesce(x("machine"), F.lit("")) != ""
    captured = both(o, n) & full(o) & full(n)
    alike = captured & (o("machine") == n("machine"))
    linked = captured & (F.size(_words(o, "hash_styles")) > 0) & (F.size(_words(n, "hash_styles")) > 0)
    flags = lambda x: F.when(o("machine") == "EM_RISCV", F.array_remove(_words(x, "abi_flags"), "rvc")).otherwise(_words(x, "abi_flags"))
    word = flags(o) != flags(n)
    raw = ~word & ~o("machine").isin(*DECODED) & ~F.coalesce(o("e_flags"), F.lit(0)).eqNullSafe(F.coalesce(n("e_flags"), F.lit(0)))
    truth = lambda x, c: F.coalesce(x(c), F.lit(False))
    drops = lambda c: both(o, n) & truth(o, c) & ~truth(n, c)
    gains = lambda c: both(o, n) & ~truth(o, c) & truth(n, c)
    level = lambda x: F.array_max(F.transform(_words(x, "gnu_properties"), lambda p: F.array_position(F.array(*map(F.lit, X86_LEVELS)), p)))
    was = F.greatest(F.coalesce(level(o), F.lit(0)), F.lit(1))
    kernel = lambda x: F.when(x("min_kernel").rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(x("min_kernel"), r"\."), lambda v: v.try_cast("int")))
    out = [
        ("elf_machine_changed", captured & (o("machine") != n("machine")), o("machine"), n("machine")),
        ("elf_class_changed", alike & differs(o, n, "elf_class") & (o("elf_class") > 0) & (n("elf_class") > 0), o("elf_class"), n("elf_class")),
        ("elf_endianness_changed", alike & differs(o, n, "ei_data") & (o("ei_data") != "") & (n("ei_data") != ""), o("ei_data"), n("ei_data")),
        ("elf_abi_flags_changed", alike & word, _joined(flags(o)), _joined(flags(n))), ("elf_abi_flags_changed", alike & raw, F.hex(o("e_flags")), F.hex(n("e_flags"))),
        ("elf_osabi_changed", alike & differs(o, n, "osabi") & (o("osabi") != "") & (n("osabi") != "") & ~(o("osabi").isin(*BENIGN_OSABI) & n("osabi").isin(*BENIGN_OSABI)), o("osabi"), n("osabi")),
        ("dynamic_loading_flags_changed", both(o, n) & known(o, n, "dynamic_flags") & (_words(o, "dynamic_flags") != _words(n, "dynamic_flags")), _joined(_words(o, "dynamic_flags")), _joined(_words(n, "dynamic_flags"))),
        ("elf_init_fini_changed", both(o, n) & differs(o, n, "has_init"), F.lit("init"), n("has_init")), ("elf_init_fini_changed", both(o, n) & differs(o, n, "has_fini"), F.lit("fini"), n("has_fini")),
        ("dt_relr_introduced", linked & ~truth(o, "has_dt_relr") & truth(n, "has_dt_relr"), F.lit("rel/rela"), F.lit("relr")), ("dt_relr_removed", linked & truth(o, "has_dt_relr") & ~truth(n, "has_dt_relr"), F.lit("relr"), F.lit("rel/rela")),
        ("hash_style_removed", linked & (F.size(F.array_except(_words(o, "hash_styles"), _words(n, "hash_styles"))) > 0), F.array_join(_words(o, "hash_styles"), "+"), F.array_join(_words(n, "hash_styles"), "+")),
        ("symbolic_binding_mode_changed", captured & (truth(o, "is_symbolic") != truth(n, "is_symbolic")), o("is_symbolic"), n("is_symbolic")),
        ("os_deployment_floor_raised", both(o, n) & (kernel(n) > kernel(o)), o("min_kernel"), n("min_kernel")),
        ("stack_canary_removed", drops("has_stack_canary"), F.lit("canary"), F.lit("none")), ("fortify_source_weakened", drops("has_fortify_source"), F.lit("fortified"), F.lit("none")),
        ("writable_executable_segment", gains("has_writable_executable_segment"), F.lit("W^X"), F.lit("W+X")),
        ("x86_isa_baseline_raised", alike & (level(n) > was), F.element_at(F.array(*map(F.lit, X86_LEVELS)), was.cast("int")), F.element_at(F.array(*map(F.lit, X86_LEVELS)), F.greatest(level(n), F.lit(1)).cast("int"))),
    ]
    for names, prefix in ((CET, "cet"), (BRANCH, "branch")):
        some = lambda x, names=names: F.array_intersect(_words(x, "gnu_properties"), F.array(*map(F.lit, names)))
        lost = F.size(F.array_except(some(o), some(n))) > 0
        out += [(f"{prefix}_protection_weakened", alike & lost, _joined(some(o)), _joined(some(n))), (f"{prefix}_protection_improved", alike & ~lost & (some(o) != some(n)), _joined(some(o)), _joined(some(n)))]
    return out


def header_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings of two tables of headers by pair_id."""
    return compared(old, new, [], F.lit("ELF_HEADER"), header_rules)


@detector("elf_contract")
def elf_contract(p: Pair) -> DataFrame:
    head = lambda side: p.documents(side).filter("elf is not null").select("pair_id", "elf.*")
    return header_changes(head("old"), head("new"))


def _recorded(p: Pair) -> DataFrame:
    """Pairs whose sides both have a binary with a known machine."""
    have = lambda side: p.documents(side).filter("coalesce(elf.machine, '') <> ''").select("pair_id")
    return have("old").join(have("new"), "pair_id", "left_semi")


def symbol_rules(o, n):
    """Symbols that a dependency leaks, unique ones gained, unnamed types, data objects that lost alignment."""
    data = n("sym_type").isin("object", "common", "tls") & ~F.col("name").rlike("^_ZT[VIST]")
    return [
        ("symbol_leaked_from_dependency_changed", (gone(o, n) & o("origin_lib").isNotNull()) | (came(o, n) & n("origin_lib").isNotNull()), o("origin_lib"), n("origin_lib")),
        ("symbol_binding_became_unique", came(o, n) & (n("binding") == "unique"), None, n("binding")),
        ("unnamed_type_in_public_abi", came(o, n) & unnamed(F.col("name")) & T.abi_relevant(F.col("name")), None, F.when(F.contains(bare(F.col("name")), F.lit("Ul")), "lambda closure").otherwise("unnamed struct/enum")),
        ("exported_object_alignment_reduced", both(o, n) & data & (o("value_alignment") > 0) & (n("value_alignment") > 0) & (n("value_alignment") < o("value_alignment")) & ~F.coalesce(n("_declared") >= o("_declared"), F.lit(False)), o("value_alignment"), n("value_alignment")),
    ]


#: A name of n characters in a mangled symbol: its length, then n characters that start with no digit.
_SOURCE_NAME = "(?:" + "|".join(f"{n}(?!\\d)[A-Za-z_$]\\w{{{n - 1}}}" for n in range(99, 0, -1)) + ")"


def bare(mangled: Column) -> Column:
    """A mangled symbol without the names of users, substitutions, template parameters and array bounds."""
    return F.regexp_replace(F.regexp_replace(mangled, _SOURCE_NAME, "."), r"S[abdiost]|S[0-9A-Z]*_|T\d*_|A\d*_", ".")


def unnamed(mangled: Column) -> Column:
    """A mangled symbol names a closure or an unnamed struct or enum."""
    return F.startswith(mangled, F.lit("_Z")) & bare(mangled).rlike(r"Ul|Ut\d*_")


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings of two tables of exported symbols by pair_id and name."""
    return compared(old, new, ["name"], "name", symbol_rules)


@detector("elf_exports")
def elf_exports(p: Pair) -> DataFrame:
    """Exports where both sides have a recorded binary; what variables declare decides over what addresses suggest."""
    have = p.documents("old").filter("elf is not null").select("pair_id").join(p.documents("new").filter("elf is not null").select("pair_id"), "pair_id", "left_semi")

    def side(tag: str) -> DataFrame:
        declared = p.unique(tag, "variables", "mangled").select("pair_id", F.col("mangled").alias("name"), F.col("alignment_bits").alias("_declared"))
        return p.unique(tag, "elf_symbols", "name").join(have, "pair_id", "left_semi").join(shuffled(declared), ["pair_id", "name"], "left")

    return _union([symbol_changes(side("old"), side("new")), _allocators(p), _version_script(p), _leaks(p)])


def allocator_changes(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """Global operator new or delete exported on one side only, once a pair; tables: pair_id, name."""
    some = lambda df: df.filter(F.col("name").rlike(ALLOCATORS) & ~F.col("name").rlike(PLACEMENT)).groupBy("pair_id").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    return compared(some(old).join(pairs, "pair_id", "left_semi"), some(new).join(pairs, "pair_id", "left_semi"), [], F.coalesce("_n.name", "_o.name"), lambda o, n: [("allocator_replacement_added", came(o, n), None, n("n")), ("allocator_replacement_removed", gone(o, n), o("n"), None)])


def _allocators(p: Pair) -> DataFrame:
    return allocator_changes(p.rows("old", "elf_symbols").select("pair_id", "name"), p.rows("new", "elf_symbols").select("pair_id", "name"), _recorded(p))


def _version_script(p: Pair) -> DataFrame:
    """The new side exports symbols without any version although the old side had versions, or exported nothing."""

    def side(tag: str) -> DataFrame:
        head = p.documents(tag).filter("elf is not null").select("pair_id", F.size(F.filter(F.coalesce("elf.versions_defined", F.array().cast("array<string>")), lambda v: ~T.private_node(v) if tag == "old" else F.lit(True))).alias("nodes"))
        used = p.rows(tag, "elf_symbols").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("version", F.lit("")) != "").alias("tagged"))
        return head.join(used, "pair_id", "left").na.fill(0, ["n", "tagged"])

    return compared(side("old"), side("new"), [], F.lit("<version-script>"), lambda o, n: [("version_script_missing", both(o, n) & (n("n") > 0) & (n("nodes") == 0) & (n("tagged") == 0) & ((o("nodes") > 0) | (o("tagged") > 0) | (o("n") == 0)), None, n("n"))])


def _leaks(p: Pair) -> DataFrame:
    """Internal-looking symbols that the old side exported for want of headers, one row a pair."""
    f = p.unique("old", "functions", "mangled").filter("_elf_only and visibility = 'elf_only'").filter(T.abi_relevant(F.col("name")) & F.lower("name").rlike("|".join(INTERNAL)))
    return f.groupBy("pair_id").agg(F.count(F.lit(1)).cast("string").alias("old_value")).select("pair_id", F.lit("visibility_leak").alias("kind"), F.lit("<visibility>").alias("symbol"), "old_value", F.lit(None).cast("string").alias("new_value"))


# ---------------------------------------------------------------- declarations


@detector("hidden_friends")
def hidden_friends(p: Pair) -> DataFrame:
    """Functions that became, or are no longer, friends declared in a class; null is not recorded."""
    f = lambda side: p.unique(side, "functions", "mangled").select("pair_id", "mangled", "is_hidden_friend")
    return compared(f("old"), f("new"), ["mangled"], "mangled", lambda o, n: [("hidden_friend_added", on(o, n, "is_hidden_friend"), F.lit("non-friend"), F.lit("hidden friend")), ("hidden_friend_removed", off(o, n, "is_hidden_friend"), F.lit("hidden friend"), F.lit("non-friend"))])


def width_bucket(spelled: Column, bits32: Column) -> Column:
    """32 or 64: the width of an integer spelling, long being 32 bits wide on a 32-bit target."""
    core = F.trim(F.regexp_replace(F.regexp_replace(spelled, r"\b(unsigned|signed|int)\b", " "), r"\s+", " "))
    bits = T.integer_width(spelled)["bits"]
    return F.when(core == "long long", 64).when(core == "long", F.when(bits32, 32).otherwise(64)).when(bits.isin(32, 64), bits)


def resized_typedefs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Typedefs of the time64 and large-file families whose width changed: pair_id, name, old_value, new_value, bits.

    Tables: pair_id, name, target and bits32.
    """
    side = lambda df, c: df.filter(F.col("name").isin(*TIME64)).select("pair_id", "name", F.col("target").alias(f"{c}_value"), width_bucket(F.col("target"), F.col("bits32")).alias(f"_{c}")).filter(f"_{c} is not null")
    return side(old, "old").join(shuffled(side(new, "new")), ["pair_id", "name"]).filter("_old <> _new").select("pair_id", "name", "old_value", "new_value", F.col("_new").alias("bits"))


@detector("time64_abi")
def time64_abi(p: Pair) -> DataFrame:
    """Resized system typedefs that the public surface names, one finding a pair; a story of ELF platforms only."""
    small = F.coalesce((F.col("elf.elf_class") == 32) | (F.col("elf.pointer_size") == 4), F.lit(False))

    def side(tag: str) -> DataFrame:
        docs = p.documents(tag).filter("coalesce(platform, 'elf') not in ('pe', 'macho')")
        return docs.select("pair_id", small.alias("bits32"), F.explode("typedefs").alias("name", "target"))

    flips = resized_typedefs(side("old"), side("new"))
    named = _union([_surface_names(p, tag) for tag in ("old", "new")]).distinct()
    used = flips.join(shuffled(named), ["pair_id", "name"], "left_semi")
    got = used.groupBy("pair_id").agg(F.count_if(F.col("bits") == 64).alias("up"), F.count_if(F.col("bits") == 32).alias("down"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))  # at most the eight of the family
    return got.select("pair_id", F.lit("time64_abi_changed").alias("kind"), F.lit("__time64_abi").alias("symbol"), F.when(F.col("up") >= F.col("down"), "32-bit → 64-bit").otherwise("64-bit → 32-bit").alias("old_value"), F.col("names").alias("new_value"))


def _surface_names(p: Pair, side: str) -> DataFrame:
    """Names in types of visible functions, variables and fields."""
    seen = F.col("visibility").isin("public", "elf_only")
    f = p.unique(side, "functions", "mangled").filter(seen).select("pair_id", F.concat_ws(" , ", "return_type", F.transform(F.coalesce("params", F.array()), lambda x: x["type"])).alias("t"))
    v = p.unique(side, "variables", "mangled").filter(seen).select("pair_id", F.col("type").alias("t"))
    r = p.unique(side, "records", "type_key").select("pair_id", F.concat_ws(" , ", F.transform(F.coalesce("fields", F.array()), lambda x: x["type"]), "bases").alias("t"))
    return _union([f, v, r]).select("pair_id", F.explode(T.type_names(F.col("t"))).alias("name"))


def is_tag(name: Column) -> Column:
    leaf = F.lower(F.substring_index(name, "::", -1))
    return leaf.isin(*TAG_LEAVES) | leaf.rlike("(" + "|".join(TAG_ENDS) + ")$")


def tag_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Serialization tags whose values changed; tables: pair_id, name, value."""
    side = lambda df: df.filter(is_tag(F.col("name")) & F.col("value").isNotNull()).groupBy("pair_id", "name").agg(F.min("value").alias("value"))
    return compared(side(old), side(new), ["name"], "name", lambda o, n: [("serialization_tag_changed", both(o, n) & differs(o, n, "value"), o("value"), n("value"))])


@detector("serialization_tags")
def serialization_tags(p: Pair) -> DataFrame:
    """Tags among constants, variables with values, and members of enums."""

    def side(tag: str) -> DataFrame:
        c = p.map(tag, "constants").select("pair_id", F.col("key").alias("name"), "value")
        v = p.unique(tag, "variables", "mangled").select("pair_id", "name", "value")
        e = p.unique(tag, "enums", "type_key").select("pair_id", F.col("name").alias("_type"), F.explode("members").alias("m"))
        e = e.filter(is_tag(F.col("_type")) | is_tag(F.col("m.name")))
        return _union([c, v, e.select("pair_id", F.concat_ws("::", "_type", F.when(is_tag(F.col("m.name")), F.col("m.name")).otherwise(F.concat("m.name", F.lit("_tag")))).alias("name"), F.col("m.value").cast("string").alias("value"))])

    return tag_changes(side("old"), side("new"))


def kind_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names that were functions only and are variables only, or the reverse; tables: pair_id, name, is_function."""
    side = lambda df: df.groupBy("pair_id", "name").agg(F.max("is_function").alias("f"), F.max(~F.col("is_function")).alias("v"))
    flip = lambda o, n: (both(o, n) & o("f") & ~o("v") & n("v") & ~n("f")) | (both(o, n) & o("v") & ~o("f") & n("f") & ~n("v"))
    word = lambda x: F.when(x("f"), "function").otherwise("variable")
    return compared(side(old), side(new), ["name"], "name", lambda o, n: [("cpo_kind_changed", flip(o, n), word(o), word(n))])


@detector("cpo_kind")
def cpo_kind(p: Pair) -> DataFrame:
    """Public names that flipped between function and function object."""

    def side(tag: str) -> DataFrame:
        f = p.unique(tag, "functions", "mangled").filter("visibility = 'public'").select("pair_id", T.template_stem(F.regexp_replace("name", r"\(.*$", "")).alias("name"), F.lit(True).alias("is_function"))
        return f.unionByName(p.unique(tag, "variables", "mangled").filter("visibility = 'public'").select("pair_id", "name", F.lit(False).alias("is_function")))

    return kind_flips(side("old"), side("new"))


def unspecified(type_name: Column) -> Column:
    out = F.lit(False)
    for word in UNSPECIFIED:
        out = out | F.contains(type_name, F.lit(word))
    return F.coalesce(out, F.lit(False))


@detector("unspecified_returns")
def unspecified_returns(p: Pair) -> DataFrame:
    """Return types that flipped between deduced and written out, of functions of one name and parameters."""
    key = lambda side: p.unique(side, "functions", "mangled").filter("visibility = 'public'").groupBy("pair_id", "name", F.to_json(F.transform(F.coalesce("params", F.array()), lambda x: x["type"])).alias("_sig")).agg(F.max_by("return_type", "ordinal").alias("type"))
    return compared(key("old"), key("new"), ["name", "_sig"], "name", lambda o, n: [("unspecified_return_now_named", both(o, n) & (unspecified(o("type")) != unspecified(n("type"))), o("type"), n("type"))])


def isa_token(name: Column) -> Column:
    """The instruction set that a name ends its words with, or null."""
    return F.nullif(F.regexp_extract(F.lower(name), r"(?:^|[^a-z0-9])(" + "|".join(ISA) + r")(?:[^a-z0-9]|$)", 1), F.lit(""))


def isa_drops(removed: DataFrame, surviving: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Instruction sets of which at least `least` specialisations went while some of their stems survive.

    removed: by, isa, stem; surviving: by, stem and isa.  Gives by, isa, removed and surviving (stems that live on under another set).
    """
    alive = surviving.groupBy(*by, "stem").agg(F.min("isa").alias("_lo"), F.max("isa").alias("_hi"))
    rows = removed.select(*by, "isa", "stem").distinct().join(shuffled(alive), [*by, "stem"], "left")
    other = F.coalesce((F.col("_lo") != F.col("isa")) | (F.col("_hi") != F.col("isa")), F.lit(False))
    return rows.groupBy(*by, "isa").agg(F.count(F.lit(1)).alias("removed"), F.count_if(other).alias("surviving")).filter(F.col("removed") >= least).filter("surviving > 0")


@detector("cpu_dispatch")
def cpu_dispatch(p: Pair) -> DataFrame:
    """An instruction set's specialisations dropped together."""
    gone_, _ = _removed_added(p)
    split = lambda df: df.withColumn("isa", isa_token(F.col("name"))).filter("isa is not null").withColumn("stem", F.replace(F.lower("name"), F.col("isa"), F.lit("*"))).select("pair_id", "isa", "stem")
    live = split(p.unique("new", "functions", "mangled").filter("visibility = 'public'"))
    return isa_drops(split(gone_), live, ["pair_id"]).select("pair_id", F.lit("cpu_dispatch_isa_dropped").alias("kind"), F.concat(F.lit("<isa:"), "isa", F.lit(">")).alias("symbol"), F.col("removed").cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"))


def family_removals(functions: DataFrame, by: list[str], family: str, removed: str, least: int = 2) -> DataFrame:
    """Families of at least `least` overloads: n, and whether all of them were removed."""
    return functions.groupBy(*by, family).agg(F.count(F.lit(1)).alias("n"), F.bool_and(removed).alias("all_removed")).filter(F.col("n") >= least)


@detector("overload_families")
def overload_families(p: Pair) -> DataFrame:
    """All overloads of a name that take a SYCL queue first went, two at least, while others of the name live on."""
    queue = lambda df: df.withColumn("_q", F.coalesce(F.element_at(F.transform("params", lambda x: x["type"]), 1).rlike(r"\b(sycl|_V1)::queue\b"), F.lit(False)) if "params" in df.columns else F.lit(False))
    stem = T.template_stem(F.regexp_replace("name", r"\(.*$", ""))
    f = lambda side: queue(p.unique(side, "functions", "mangled").filter("visibility in ('public', 'elf_only') and size(params) > 0")).select("pair_id", "mangled", "_q", stem.alias("stem"))
    old, new = f("old"), f("new")
    marked = old.filter("_q").join(shuffled(new.select("pair_id", "mangled", F.lit(True).alias("_here"))), ["pair_id", "mangled"], "left").withColumn("_gone", F.col("_here").isNull())
    every = family_removals(marked, ["pair_id"], "stem", "_gone").filter("all_removed")
    plain = p.unique("new", "functions", "mangled").filter("visibility in ('public', 'elf_only')").select("pair_id", stem.alias("stem"))
    return every.join(shuffled(plain), ["pair_id", "stem"], "left_semi").select("pair_id", F.lit("sycl_overload_set_removed").alias("kind"), F.col("stem").alias("symbol"), F.col("n").cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"))


# ---------------------------------------------------------------- declared floors


def wheel_paths(binaries: DataFrame) -> DataFrame:
    """Search paths of a packaged binary that are not relative to it; binaries: pair_id, rpath, runpath."""
    entries = binaries.select("pair_id", F.explode(F.split(F.concat_ws(":", F.nullif("rpath", F.lit("")), F.nullif("runpath", F.lit(""))), ":")).alias("symbol")).filter((F.col("symbol") != "") & ~F.startswith("symbol", F.lit("$ORIGIN")) & ~F.startswith("symbol", F.lit("${ORIGIN}")))
    return entries.distinct().select("pair_id", F.lit("wheel_rpath_not_portable").alias("kind"), "symbol", F.lit(None).cast("string").alias("old_value"), F.col("symbol").alias("new_value"))


def floor_breaches(required: DataFrame, floors: DataFrame) -> DataFrame:
    """Requirements above a declared platform floor; required: pair_id, tag; floors: prefix, floor (version), a small table."""
    need = required.withColumns({"prefix": F.upper(F.regexp_extract("tag", r"^(.*)_[^_]*$", 1)), "v": T.tag_version(F.col("tag"))})
    top = need.filter("v is not null").groupBy("pair_id", "prefix").agg(F.max("v").alias("v"), F.max_by("tag", "v").alias("tag"))
    limit = floors.select(F.upper("prefix").alias("prefix"), "floor", T.tag_version(F.concat("prefix", F.lit("_"), "floor")).alias("_f"))
    over = top.join(limit, "prefix").filter(~T.version_le(F.col("v"), F.col("_f")))
    return over.select("pair_id", F.lit("platform_baseline_floor_raised").alias("kind"), F.col("tag").alias("symbol"), F.col("floor").alias("old_value"), F.col("tag").alias("new_value"))


def musl_breaches(required: DataFrame) -> DataFrame:
    """Binaries tagged for musl that require glibc; required: pair_id, platform_tag, tag."""
    hit = required.filter(F.contains("platform_tag", F.lit("musllinux")) & F.startswith("tag", F.lit("GLIBC_"))).groupBy("pair_id").agg(F.min("tag").alias("symbol"))
    return hit.select("pair_id", F.lit("musllinux_glibc_dependency_detected").alias("kind"), "symbol", F.lit(None).cast("string").alias("old_value"), F.col("symbol").alias("new_value"))
