"""Detectors: typed differences of two snapshots, for any number of pairs at once.

A detector takes a Pair and returns findings (pair_id, kind, symbol, old_value, new_value).  Most compare one
relation: `compared` joins its two sides once, by pair and key, and evaluates all rules of the relation on
the joined row, so forty kinds of change of a function cost one shuffle.  Every comparison is null-safe, and
where null means "not recorded" the rule asks for both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import match, rollup
from quillon.storage import shuffled

Rule = tuple
DETECTORS: dict[str, Callable[[Pair], DataFrame]] = {}


def detector(name: str):
    """Register a detector; the order of registration is the order of precedence among findings."""

    def add(f):
        if name in DETECTORS:
            raise ValueError(f"detector {name} is registered twice")
        DETECTORS[name] = f
        return f

    return add


class Pair:
    """Snapshots, and the pairs (pair_id, old_id, new_id) to compare.  store: writes a relation that many detectors read."""

    def __init__(self, snapshots: DataFrame, pairs: DataFrame, store: Callable[[DataFrame, str], DataFrame] | None = None):
        self.snapshots, self.pairs, self.store = snapshots, pairs, store
        self._kept: dict[tuple, DataFrame] = {}

    def documents(self, side: str) -> DataFrame:
        return self.pairs.select("pair_id", F.col(f"{side}_id").alias("snapshot_id")).join(self.snapshots, "snapshot_id")

    def rows(self, side: str, name: str) -> DataFrame:
        return self.documents(side).select("pair_id", F.col("elf_only_mode").alias("_elf_only"), F.posexplode(name).alias("ordinal", "_e")).select("pair_id", "_elf_only", "ordinal", "_e.*")

    def unique(self, side: str, name: str, key: str) -> DataFrame:
        """Rows by key, the first of a repeated key."""
        if (side, name, key) not in self._kept:
            rows = self.rows(side, name)
            rest = [c for c in rows.columns if c not in ("pair_id", key)]
            made = rows.groupBy("pair_id", key).agg(F.min_by(F.struct(*rest), "ordinal").alias("_r")).select("pair_id", key, "_r.*")
            self._kept[side, name, key] = self.store(made, name) if self.store else made
        return self._kept[side, name, key]

    def nested(self, side: str, name: str, key: str, member: str) -> DataFrame:
        """Members of the nested list `member`, with its owner's key and whether the owner is on both sides."""
        mine, other = self.unique(side, name, key), self.unique("new" if side == "old" else "old", name, key)
        flags = [c for c in ("is_union", "is_opaque") if c in mine.columns]
        return mine.join(shuffled(other.select("pair_id", key)), ["pair_id", key], "left_semi").select("pair_id", key, *flags, F.posexplode(member).alias("pos", "_e")).select("pair_id", key, *flags, "pos", "_e.*")

    def map(self, side: str, name: str) -> DataFrame:
        return self.documents(side).select("pair_id", F.explode(name).alias("key", "value"))


def compared(old: DataFrame, new: DataFrame, keys: Sequence[str], symbol: Column | str, rules: Callable) -> DataFrame:
    """One full outer join by pair and keys; rules(o, n) lists (kind, condition, old value, new value)."""
    keys = ["pair_id", *keys]
    a, b = (df.select(*keys, F.struct(*[c for c in df.columns if c not in keys], F.lit(True).alias("_here")).alias(side)) for df, side in ((old, "_o"), (new, "_n")))
    o, n = (lambda c: F.col(f"_o.{c}")), (lambda c: F.col(f"_n.{c}"))
    sym = F.col(symbol) if isinstance(symbol, str) else symbol
    void = F.lit(None).cast("string")
    found = [
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), sym.cast("string").alias("symbol"), (void if x is None else x.cast("string")).alias("old_value"), (void if y is None else y.cast("string")).alias("new_value")))
        for kind, cond, x, y in rules(o, n)
    ]
    return a.join(b, keys, "full_outer").select("pair_id", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull() & x["kind"].isNotNull())))


def gone(o, n):
    return o("_here").isNotNull() & n("_here").isNull()


def came(o, n):
    return o("_here").isNull() & n("_here").isNotNull()


def both(o, n):
    return o("_here").isNotNull() & n("_here").isNotNull()


def known(o, n, c):
    return o(c).isNotNull() & n(c).isNotNull()


def differs(o, n, c):
    """The attribute is recorded on both sides and differs."""
    return known(o, n, c) & (o(c) != n(c))


def on(o, n, c):
    return known(o, n, c) & ~o(c) & n(c)


def off(o, n, c):
    return known(o, n, c) & o(c) & ~n(c)


def _access(c: Column) -> Column:
    return F.when(c == "public", 2).when(c == "protected", 1).when(c == "private", 0)


def _union(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL as a balanced tree: each step analyses its inputs again, so a chain would cost their square."""
    while len(parts) > 1:
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    return parts[0]


def paired(lost: DataFrame, found: DataFrame, on: Sequence[str], left: str, right: str) -> DataFrame:
    """One to one: the k-th lost of a key (by name) with its k-th found, so that no row is used twice."""
    nth = lambda df, c: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*on).orderBy(c)))
    return nth(lost, left).join(shuffled(nth(found, right)), [*on, "_nth"]).drop("_nth")


# ---------------------------------------------------------------- functions


@detector("functions")
def functions(p: Pair) -> DataFrame:
    """Public functions by mangled name."""
    types = F.transform(F.coalesce("params", F.array()), lambda x: T.canonical_type(x["type"]))
    shape = lambda side: p.unique(side, "functions", "mangled").withColumns({"_ret": T.canonical_type(F.col("return_type")), "_types": F.array_join(types, ", "), "_base": F.regexp_replace("name", r"\(.*$", "")})
    old, new = shape("old"), shape("new")
    names = old.filter("visibility = 'public'").select("pair_id", F.col("_base")).distinct().withColumn("_known", F.lit(True))
    new = new.join(shuffled(names), ["pair_id", "_base"], "left")
    pub = lambda x: x("visibility") == "public"

    def rules(o, n):
        dead, born = gone(o, n) & pub(o), came(o, n) & pub(n)
        same = both(o, n) & pub(o)
        flag = [("is_noexcept", "func_noexcept_added", "func_noexcept_removed"), ("is_virtual", "func_virtual_added", "func_virtual_removed"), ("is_inline", "func_became_inline", "func_lost_inline"), ("is_explicit", "ctor_explicit_added", "ctor_explicit_removed"), ("is_variadic", "func_variadic_added", "func_variadic_removed")]
        out = [
            (F.when(o("_elf_only"), "func_removed_elf_only").otherwise("func_removed"), dead, o("name"), None),
            (F.when(n("is_virtual"), "virtual_method_added").when(n("_known"), "overload_added").otherwise("func_added"), born, None, n("name")),
            ("func_visibility_changed", same & ~pub(n), o("visibility"), n("visibility")),
            ("func_return_changed", same & differs(o, n, "_ret"), o("return_type"), n("return_type")),
            ("func_params_changed", same & differs(o, n, "_types"), o("_types"), n("_types")),
            ("func_virtual_became_pure", same & o("is_virtual") & on(o, n, "is_pure_virtual"), F.lit("virtual"), F.lit("pure virtual")),
            ("func_pure_virtual_added", same & ~o("is_virtual") & on(o, n, "is_pure_virtual"), None, F.lit("pure virtual")),
            ("func_static_changed", same & differs(o, n, "is_static"), o("is_static"), n("is_static")),
            ("func_cv_changed", same & (differs(o, n, "is_const") | differs(o, n, "is_volatile")), F.concat_ws(" ", F.when(o("is_const"), "const"), F.when(o("is_volatile"), "volatile")), F.concat_ws(" ", F.when(n("is_const"), "const"), F.when(n("is_volatile"), "volatile"))),
            ("func_deleted", same & on(o, n, "is_deleted"), None, F.lit("= delete")),
            ("func_ref_qual_changed", same & differs(o, n, "ref_qualifier"), o("ref_qualifier"), n("ref_qualifier")),
            ("func_language_linkage_changed", same & differs(o, n, "is_extern_c"), o("is_extern_c"), n("is_extern_c")),
            ("func_exception_spec_changed", same & differs(o, n, "exception_spec"), o("exception_spec"), n("exception_spec")),
            ("func_deprecated_added", same & o("deprecated").isNull() & n("deprecated").isNotNull(), None, n("deprecated")),
            ("func_deprecated_removed", same & o("deprecated").isNotNull() & n("deprecated").isNull(), o("deprecated"), None),
            ("method_access_changed", same & (_access(n("access")) < _access(o("access"))), o("access"), n("access")),
            ("protected_visibility_changed", same & differs(o, n, "elf_visibility") & ((o("elf_visibility") == "protected") | (n("elf_visibility") == "protected")), o("elf_visibility"), n("elf_visibility")),
        ]
        return out + [(k, same & f(o, n, c), o(c), n(c)) for c, added, removed in flag for k, f in ((added, on), (removed, off))]

    return compared(old, new, ["mangled"], "mangled", rules)


@detector("params")
def params(p: Pair) -> DataFrame:
    """Parameters of functions on both sides, by position."""

    def rules(o, n):
        same = both(o, n)
        named = (F.coalesce(o("name"), F.lit("")) != "") & (F.coalesce(n("name"), F.lit("")) != "")
        return [
            ("param_renamed", same & named & (o("name") != n("name")) & (T.canonical_type(o("type")) == T.canonical_type(n("type"))), o("name"), n("name")),
            ("param_default_value_removed", same & o("default").isNotNull() & n("default").isNull(), o("default"), None),
            ("param_default_value_changed", same & differs(o, n, "default"), o("default"), n("default")),
            ("param_pointer_level_changed", same & differs(o, n, "pointer_depth"), o("pointer_depth"), n("pointer_depth")),
            ("param_restrict_changed", same & differs(o, n, "is_restrict"), o("is_restrict"), n("is_restrict")),
            ("param_became_va_list", same & on(o, n, "is_va_list"), None, n("name")),
            ("param_lost_va_list", same & off(o, n, "is_va_list"), o("name"), None),
        ]

    return compared(p.nested("old", "functions", "mangled", "params"), p.nested("new", "functions", "mangled", "params"), ["mangled", "pos"], "mangled", rules)


@detector("variables")
def variables(p: Pair) -> DataFrame:
    pub = lambda x: x("visibility") == "public"

    def rules(o, n):
        same = both(o, n) & pub(o)
        return [
            ("var_removed", gone(o, n) & pub(o), o("name"), None), ("var_added", came(o, n) & pub(n), None, n("name")),
            ("var_type_changed", same & (T.canonical_type(o("type")) != T.canonical_type(n("type"))), o("type"), n("type")),
            ("var_became_const", same & on(o, n, "is_const"), None, F.lit("const")), ("var_lost_const", same & off(o, n, "is_const"), F.lit("const"), None),
            ("var_value_changed", same & differs(o, n, "value"), o("value"), n("value")), ("var_alignment_changed", same & differs(o, n, "alignment_bits"), o("alignment_bits"), n("alignment_bits")),
            ("var_access_changed", same & (_access(n("access")) < _access(o("access"))), o("access"), n("access")), ("var_access_widened", same & (_access(n("access")) > _access(o("access"))), o("access"), n("access")),
        ]

    return compared(p.unique("old", "variables", "mangled"), p.unique("new", "variables", "mangled"), ["mangled"], "mangled", rules)


# ---------------------------------------------------------------- types


@detector("types")
def types(p: Pair) -> DataFrame:
    """Records by qualified key."""
    arr = lambda x, c: F.coalesce(x(c), F.array().cast("array<string>"))
    joined = lambda x, c: F.array_join(arr(x, c), ", ")

    def rules(o, n):
        same = both(o, n)
        clear = same & ~F.coalesce(o("is_opaque"), F.lit(False)) & ~F.coalesce(n("is_opaque"), F.lit(False))
        bases, virtual = (arr(o, "bases") != arr(n, "bases")), (arr(o, "virtual_bases") != arr(n, "virtual_bases"))
        as_set = lambda x, c: F.array_sort(arr(x, c))
        moved = clear & (as_set(o, "bases") == as_set(n, "bases")) & bases
        both_kinds = lambda x: F.array_sort(F.concat(arr(x, "bases"), arr(x, "virtual_bases")))
        became_virtual = clear & (both_kinds(o) == both_kinds(n)) & (as_set(o, "virtual_bases") != as_set(n, "virtual_bases"))
        offsets = F.exists(F.map_keys(o("base_offsets")), lambda k: F.try_element_at(n("base_offsets"), k).isNotNull() & (F.try_element_at(o("base_offsets"), k) != F.try_element_at(n("base_offsets"), k)))
        return [
            ("type_removed", gone(o, n), o("name"), None), ("type_added", came(o, n), None, n("name")),
            ("type_kind_changed", same & differs(o, n, "kind") & ~o("is_union").eqNullSafe(n("is_union")), o("kind"), n("kind")),
            ("source_level_kind_changed", same & differs(o, n, "kind") & o("is_union").eqNullSafe(n("is_union")), o("kind"), n("kind")),
            ("type_size_changed", clear & differs(o, n, "size_bits"), o("size_bits"), n("size_bits")), ("type_alignment_changed", clear & differs(o, n, "alignment_bits"), o("alignment_bits"), n("alignment_bits")),
            ("type_became_opaque", same & on(o, n, "is_opaque"), None, F.lit("opaque")), ("type_became_final", same & on(o, n, "is_final"), None, F.lit("final")), ("type_lost_final", same & off(o, n, "is_final"), F.lit("final"), None),
            ("type_became_abstract", same & on(o, n, "is_abstract"), None, F.lit("abstract")), ("type_lost_abstract", same & off(o, n, "is_abstract"), F.lit("abstract"), None),
            ("standard_layout_lost", clear & off(o, n, "is_standard_layout"), None, None), ("trivially_copyable_lost", clear & off(o, n, "is_trivially_copyable"), None, None),
            ("base_class_position_changed", moved, joined(o, "bases"), joined(n, "bases")), ("base_class_virtual_changed", became_virtual, joined(o, "virtual_bases"), joined(n, "virtual_bases")),
            ("type_base_changed", clear & (bases | virtual) & ~moved & ~became_virtual & ~((as_set(o, "virtual_bases") == as_set(n, "virtual_bases")) & ~bases), joined(o, "bases"), joined(n, "bases")),
            ("virtual_base_offset_changed", clear & (F.size(arr(o, "virtual_bases")) > 1) & virtual & (as_set(o, "virtual_bases") == as_set(n, "virtual_bases")), joined(o, "virtual_bases"), joined(n, "virtual_bases")),
            ("base_class_offset_changed", clear & F.coalesce(offsets, F.lit(False)), F.to_json(o("base_offsets")), F.to_json(n("base_offsets"))),
            ("type_vtable_changed", clear & (F.size(arr(o, "vtable")) > 0) & (arr(o, "vtable") != arr(n, "vtable")), joined(o, "vtable"), joined(n, "vtable")),
            ("vptr_introduced", clear & (F.size(arr(o, "vtable")) == 0) & o("vptr_offset_bits").isNull() & (F.size(arr(n, "vtable")) > 0) & n("vptr_offset_bits").isNotNull(), None, n("vptr_offset_bits")),
            ("tail_padding_reuse_changed", clear & differs(o, n, "data_size_bits") & known(o, n, "size_bits") & (o("size_bits") == n("size_bits")), o("data_size_bits"), n("data_size_bits")),
            ("layout_unverifiable", clear & (o("size_bits").isNull() != n("size_bits").isNull()), o("size_bits"), n("size_bits")),
        ]

    return compared(p.unique("old", "records", "type_key"), p.unique("new", "records", "type_key"), ["type_key"], "type_key", rules)


def _fields(p: Pair) -> tuple[DataFrame, DataFrame]:
    return tuple(p.nested(side, "records", "type_key", "fields").filter("not coalesce(is_opaque, false)") for side in ("old", "new"))


@detector("fields")
def fields(p: Pair) -> DataFrame:
    """Fields of records on both sides, by name; a removed and an added field at one offset and of one type are a rename."""
    old, new = _fields(p)
    here = lambda df: df.select("pair_id", "type_key", "name")
    lost, found = old.join(shuffled(here(new)), ["pair_id", "type_key", "name"], "left_anti"), new.join(shuffled(here(old)), ["pair_id", "type_key", "name"], "left_anti")
    on_ = ["pair_id", "type_key", "offset_bits", "type"]
    pairs = paired(lost.select(*on_, F.col("name").alias("old_value")), found.select(*on_, F.col("name").alias("new_value")), on_, "old_value", "new_value").filter("offset_bits is not null")
    renamed = pairs.select("pair_id", F.lit("field_renamed").alias("kind"), F.concat_ws("::", "type_key", "old_value").alias("symbol"), "old_value", "new_value")
    old = old.join(pairs.select("pair_id", "type_key", F.col("old_value").alias("name"), F.lit(True).alias("_renamed")), ["pair_id", "type_key", "name"], "left")
    new = new.join(pairs.select("pair_id", "type_key", F.col("new_value").alias("name"), F.lit(True).alias("_renamed")), ["pair_id", "type_key", "name"], "left")

    def rules(o, n):
        same = both(o, n)
        union = F.coalesce(o("is_union"), n("is_union"), F.lit(False))
        pick = lambda a, b: F.when(union, a).otherwise(b)
        out = [
            (pick("union_field_removed", "type_field_removed"), gone(o, n) & o("_renamed").isNull(), o("type"), None), (pick("union_field_added", "type_field_added"), came(o, n) & n("_renamed").isNull(), None, n("type")),
            (pick("union_field_type_changed", "type_field_type_changed"), same & (T.canonical_type(o("type")) != T.canonical_type(n("type"))), o("type"), n("type")),
            ("type_field_offset_changed", same & ~union & differs(o, n, "offset_bits"), o("offset_bits"), n("offset_bits")), ("field_bitfield_changed", same & (differs(o, n, "is_bitfield") | differs(o, n, "bitfield_bits")), o("bitfield_bits"), n("bitfield_bits")),
            ("field_access_changed", same & (_access(n("access")) < _access(o("access"))), o("access"), n("access")),
            ("field_default_initializer_removed", same & o("default").isNotNull() & n("default").isNull(), o("default"), None), ("field_default_initializer_changed", same & differs(o, n, "default"), o("default"), n("default")),
            ("field_deprecated_added", same & o("deprecated").isNull() & n("deprecated").isNotNull(), None, n("deprecated")), ("field_deprecated_removed", same & o("deprecated").isNotNull() & n("deprecated").isNull(), o("deprecated"), None),
        ]
        for word in ("const", "volatile", "mutable"):
            out += [(f"field_became_{word}", same & on(o, n, f"is_{word}"), None, F.lit(word)), (f"field_lost_{word}", same & off(o, n, f"is_{word}"), F.lit(word), None)]
        return out

    return compared(old, new, ["type_key", "name"], F.concat_ws("::", "type_key", "name"), rules).unionByName(renamed)


@detector("enums")
def enums(p: Pair) -> DataFrame:
    def rules(o, n):
        same = both(o, n)
        return [
            ("type_removed", gone(o, n), o("name"), None), ("type_added", came(o, n), None, n("name")), ("enum_underlying_size_changed", same & differs(o, n, "underlying_type"), o("underlying_type"), n("underlying_type")),
            ("enum_became_scoped", same & on(o, n, "is_scoped"), None, None), ("enum_lost_scoped", same & off(o, n, "is_scoped"), None, None),
        ]

    own = compared(p.unique("old", "enums", "type_key"), p.unique("new", "enums", "type_key"), ["type_key"], "type_key", rules)
    old, new = (p.nested(side, "enums", "type_key", "members") for side in ("old", "new"))
    top = lambda df: df.groupBy("pair_id", "type_key").agg(F.max("value").alias("_top"))
    old, new = old.join(shuffled(top(old)), ["pair_id", "type_key"]), new.join(shuffled(top(new)), ["pair_id", "type_key"])
    key = ["pair_id", "type_key", "name"]
    lost, found = old.join(shuffled(new.select(*key)), key, "left_anti"), new.join(shuffled(old.select(*key)), key, "left_anti")
    at = ["pair_id", "type_key", "value"]
    pairs = paired(lost.select(*at, F.col("name").alias("old_value")), found.select(*at, F.col("name").alias("new_value")), at, "old_value", "new_value")
    renamed = pairs.select("pair_id", F.lit("enum_member_renamed").alias("kind"), F.concat_ws("::", "type_key", "old_value").alias("symbol"), "old_value", "new_value")
    mark = lambda df, c: df.join(pairs.select("pair_id", "type_key", F.col(c).alias("name"), F.lit(True).alias("_renamed")), key, "left")

    def member(o, n):
        last = (o("value") == o("_top")) & (n("value") == n("_top")) & o("name_is_last")
        return [
            ("enum_member_removed", gone(o, n) & o("_renamed").isNull(), o("value"), None), ("enum_member_added", came(o, n) & n("_renamed").isNull(), None, n("value")),
            ("enum_last_member_value_changed", both(o, n) & differs(o, n, "value") & F.coalesce(last, F.lit(False)), o("value"), n("value")),
            ("enum_member_value_changed", both(o, n) & differs(o, n, "value") & ~F.coalesce(last, F.lit(False)), o("value"), n("value")),
        ]

    sentinel = F.lower("name").rlike(r"(^|_)(last|max|count|end|num|sentinel)$")
    old, new = (mark(df, c).withColumn("name_is_last", sentinel) for df, c in ((old, "old_value"), (new, "new_value")))
    return _union([own, renamed, compared(old, new, ["type_key", "name"], F.concat_ws("::", "type_key", "name"), member)])


@detector("typedefs")
def typedefs(p: Pair) -> DataFrame:
    return compared(p.map("old", "typedefs"), p.map("new", "typedefs"), ["key"], "key", lambda o, n: [("typedef_removed", gone(o, n), o("value"), None), ("typedef_base_changed", both(o, n) & (T.canonical_type(o("value")) != T.canonical_type(n("value"))), o("value"), n("value"))])


@detector("constants")
def constants(p: Pair) -> DataFrame:
    return compared(p.map("old", "constants"), p.map("new", "constants"), ["key"], "key", lambda o, n: [("constant_removed", gone(o, n), o("value"), None), ("constant_added", came(o, n), None, n("value")), ("constant_changed", both(o, n) & ~o("value").eqNullSafe(n("value")), o("value"), n("value"))])


# ---------------------------------------------------------------- binaries


@detector("elf_header")
def elf_header(p: Pair) -> DataFrame:
    head = lambda side: p.documents(side).filter("elf is not null").select("pair_id", "elf.*")

    def rules(o, n):
        same = both(o, n)
        clean = lambda x: F.transform(F.coalesce(x("needed"), F.array().cast("array<string>")), T.strip_vendor_hash)
        relro = lambda c: F.when(c == "full", 2).when(c == "partial", 1).when(c == "none", 0)
        put = lambda x, c: F.coalesce(x(c), F.lit(""))
        swap = ((put(o, "rpath") != "") & (put(o, "runpath") == "") & (put(n, "rpath") == "") & (put(n, "runpath") != "")) | ((put(o, "runpath") != "") & (put(o, "rpath") == "") & (put(n, "runpath") == "") & (put(n, "rpath") != ""))
        return [
            ("soname_changed", same & known(o, n, "soname") & (T.strip_vendor_hash(o("soname")) != T.strip_vendor_hash(n("soname"))), o("soname"), n("soname")), ("soname_missing", same & o("soname").isNotNull() & n("soname").isNull(), o("soname"), None),
            ("needed_order_changed", same & (clean(o) != clean(n)) & (F.array_sort(F.array_distinct(clean(o))) == F.array_sort(F.array_distinct(clean(n)))), F.array_join(o("needed"), ", "), F.array_join(n("needed"), ", ")),
            ("rpath_type_changed", same & swap, F.concat_ws("", "_o.rpath", "_o.runpath"), F.concat_ws("", "_n.rpath", "_n.runpath")), ("rpath_changed", same & ~swap & (put(o, "rpath") != put(n, "rpath")), o("rpath"), n("rpath")), ("runpath_changed", same & ~swap & (put(o, "runpath") != put(n, "runpath")), o("runpath"), n("runpath")),
            ("interpreter_changed", same & differs(o, n, "interpreter"), o("interpreter"), n("interpreter")), ("relro_weakened", same & (relro(n("relro")) < relro(o("relro"))), o("relro"), n("relro")),
            ("bind_now_disabled", same & off(o, n, "bind_now"), None, None), ("pie_disabled", same & off(o, n, "is_pie"), None, None),
            ("static_tls_introduced", same & on(o, n, "has_static_tls"), None, None), ("static_tls_removed", same & off(o, n, "has_static_tls"), None, None), ("text_relocation_introduced", same & on(o, n, "has_textrel"), None, None), ("text_relocation_removed", same & off(o, n, "has_textrel"), None, None),
            ("executable_stack", same & on(o, n, "executable_stack"), None, None), ("executable_stack_removed", same & off(o, n, "executable_stack"), None, None),
        ]

    own = compared(head("old"), head("new"), [], F.lit("DT_SONAME"), rules)
    libs = lambda side: p.documents(side).filter("elf is not null").select("pair_id", F.explode("elf.needed").alias("raw")).withColumn("key", T.strip_vendor_hash(F.col("raw"))).dropDuplicates(["pair_id", "key"])
    needed = compared(libs("old"), libs("new"), ["key"], "key", lambda o, n: [("needed_removed", gone(o, n), o("raw"), None), ("needed_added", came(o, n), None, n("raw"))])
    nodes = lambda side: p.documents(side).filter("elf is not null").select("pair_id", F.explode("elf.versions_defined").alias("key")).distinct().withColumn("_v", F.lit(1))
    defined = compared(nodes("old"), nodes("new"), ["key"], "key", lambda o, n: [("symbol_version_defined_removed", gone(o, n) & ~T.private_node(F.col("key")), F.col("key"), None), ("symbol_version_defined_added", came(o, n), None, F.col("key"))])
    return _union([own, needed, defined, _requirements(p), _floors(p)])


def _required(p: Pair, side: str) -> DataFrame:
    rows = p.documents(side).filter("elf is not null").select("pair_id", F.explode("elf.versions_required").alias("lib", "tags")).select("pair_id", "lib", F.explode("tags").alias("tag")).distinct()
    return rows.withColumns({"prefix": F.regexp_extract("tag", r"^(.*)_[^_]*$", 1), "v": T.tag_version(F.col("tag"))})


def _requirements(p: Pair) -> DataFrame:
    """New version requirements: compatible if the library is new or the tag is not above what was required; tuples compare raw."""
    old, new = _required(p, "old"), _required(p, "new")
    most = old.groupBy("pair_id", "lib", "prefix").agg(F.max("v").alias("_most"))
    libs = old.select("pair_id", "lib").union(p.documents("old").filter("elf is not null").select("pair_id", F.explode("elf.needed"))).distinct().withColumn("_old", F.lit(True))
    new = new.join(shuffled(libs), ["pair_id", "lib"], "left").join(shuffled(most), ["pair_id", "lib", "prefix"], "left")
    fine = lambda n: n("_old").isNull() | F.coalesce(n("v") <= n("_most"), F.lit(False))
    return compared(old, new, ["lib", "tag"], "tag", lambda o, n: [(F.when(fine(n), "symbol_version_required_added_compat").otherwise("symbol_version_required_added"), came(o, n), None, F.col("lib")), ("symbol_version_required_removed", gone(o, n), F.col("lib"), None)])


def floor_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Highest parseable tag of each library and prefix rose; rows: pair_id, lib, prefix, tag and v (tag_version)."""
    top = lambda df: df.filter("v is not null").groupBy("pair_id", "lib", "prefix").agg(F.max("v").alias("v"), F.max_by("tag", "v").alias("tag"))
    return compared(top(old), top(new), ["lib", "prefix"], "lib", lambda o, n: [("runtime_floor_raised", both(o, n) & (n("v") > o("v")), o("tag"), n("tag"))])


def _floors(p: Pair) -> DataFrame:
    return floor_changes(_required(p, "old"), _required(p, "new"))


@detector("elf_symbols")
def elf_symbols(p: Pair) -> DataFrame:
    sym = lambda side: p.unique(side, "elf_symbols", "name").filter(T.abi_relevant(F.col("name")))

    def rules(o, n):
        same = both(o, n)
        data = n("sym_type").isin("object", "common", "tls") & ~F.col("name").rlike("^_ZT[VIST]")
        sized = known(o, n, "size") & (o("size") > 0) & (n("size") > 0) & (o("size") != n("size"))
        pair = differs(o, n, "binding")
        return [
            ("symbol_binding_became_unique", same & pair & (n("binding") == "unique"), o("binding"), n("binding")), ("symbol_binding_lost_unique", same & pair & (o("binding") == "unique"), o("binding"), n("binding")),
            ("symbol_binding_changed", same & pair & (o("binding") == "global") & (n("binding") == "weak"), o("binding"), n("binding")),
            ("symbol_binding_strengthened", same & pair & ~n("binding").isin("unique") & ~o("binding").isin("unique") & ~((o("binding") == "global") & (n("binding") == "weak")), o("binding"), n("binding")),
            ("symbol_size_changed", same & sized & data, o("size"), n("size")),
            ("vtable_slot_count_changed", same & sized & F.startswith("name", F.lit("_ZTV")), (o("size") / 8 - 2).cast("int"), (n("size") / 8 - 2).cast("int")), ("rtti_inheritance_changed", same & sized & F.startswith("name", F.lit("_ZTI")), o("size"), n("size")), ("vtt_slot_count_changed", same & sized & F.startswith("name", F.lit("_ZTT")), o("size"), n("size")),
            ("ifunc_introduced", same & (o("sym_type") == "func") & (n("sym_type") == "ifunc"), o("sym_type"), n("sym_type")), ("ifunc_removed", same & (o("sym_type") == "ifunc") & (n("sym_type") == "func"), o("sym_type"), n("sym_type")),
            ("symbol_type_changed", same & differs(o, n, "sym_type") & ~(o("sym_type").isin("func", "ifunc") & n("sym_type").isin("func", "ifunc")), o("sym_type"), n("sym_type")),
            ("symbol_elf_visibility_changed", same & differs(o, n, "visibility"), o("visibility"), n("visibility")), ("symbol_moved_version_node", same & (F.coalesce(o("version"), F.lit("")) != "") & (F.coalesce(n("version"), F.lit("")) != "") & (o("version") != n("version")), o("version"), n("version")),
        ]

    own = compared(sym("old"), sym("new"), ["name"], "name", rules)
    nodes = lambda side: p.rows(side, "elf_symbols").filter("coalesce(version, '') <> ''").groupBy("pair_id", F.col("version").alias("key")).agg(rollup.sampled("name").alias("some"))
    return own.unionByName(compared(nodes("old"), nodes("new"), ["key"], "key", lambda o, n: [("symbol_version_node_removed", gone(o, n), o("some"), None)]))


def import_rules(o, n):
    return [("imported_symbol_added", came(o, n) & (n("binding") != "weak"), None, n("version")), ("imported_symbol_removed", gone(o, n), o("version"), None), ("imported_symbol_added", both(o, n) & (o("binding") == "weak") & (n("binding") != "weak"), F.lit("weak"), F.lit("(weak→strong)"))]


@detector("elf_imports")
def elf_imports(p: Pair) -> DataFrame:
    """Imports, where both sides have a recorded binary."""
    have = p.documents("old").filter("elf is not null").select("pair_id").join(p.documents("new").filter("elf is not null").select("pair_id"), "pair_id", "left_semi")
    imp = lambda side: p.unique(side, "elf_imports", "name").join(have, "pair_id", "left_semi")
    return compared(imp("old"), imp("new"), ["name"], "name", import_rules)


def kabi_rules(o, n):
    gpl = lambda c: F.contains(c, F.lit("GPL"))
    return [
        ("kabi_symbol_removed", gone(o, n), o("module"), None), ("kabi_symbol_added", came(o, n), None, n("module")), ("kabi_crc_changed", both(o, n) & (o("crc") != n("crc")), o("crc"), n("crc")),
        ("kabi_export_type_changed", both(o, n) & gpl(n("export_type")) & ~gpl(o("export_type")), o("export_type"), n("export_type")),
        ("kabi_symbol_namespace_changed", both(o, n) & (F.coalesce(o("namespace"), F.lit("")) != F.coalesce(n("namespace"), F.lit(""))) & (F.coalesce(n("namespace"), F.lit("")) != ""), F.coalesce(F.nullif(o("namespace"), F.lit("")), F.lit("(none)")), n("namespace")),
    ]


@detector("kabi")
def kabi(p: Pair) -> DataFrame:
    return compared(p.unique("old", "kabi", "symbol"), p.unique("new", "kabi", "symbol"), ["symbol"], "symbol", kabi_rules)


def kabi_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same for two symvers tables: one pair."""
    one = lambda df: df.withColumn("pair_id", F.lit("0"))
    return compared(one(old), one(new), ["symbol"], "symbol", kabi_rules).drop("pair_id")


# ---------------------------------------------------------------- spellings and families


def _slots(p: Pair, side: str) -> DataFrame:
    """Every type spelling of functions, variables and fields: pair_id, slot, type."""
    f = p.unique(side, "functions", "mangled").filter("visibility = 'public'")
    ret = f.select("pair_id", F.concat(F.col("mangled"), F.lit("()")).alias("slot"), F.col("return_type").alias("type"))
    par = f.select("pair_id", "mangled", F.posexplode("params").alias("i", "e")).select("pair_id", F.concat_ws("#", "mangled", F.col("i").cast("string")).alias("slot"), F.col("e.type").alias("type"))
    fld = p.unique(side, "records", "type_key").select("pair_id", "type_key", F.explode("fields").alias("e")).select("pair_id", F.concat_ws("::", "type_key", "e.name").alias("slot"), F.col("e.type").alias("type"))
    return _union([ret, par, fld]).dropDuplicates(["pair_id", "slot"])


@detector("type_spellings")
def type_spellings(p: Pair) -> DataFrame:
    """_Atomic, _BitInt widths and char8_t in types of the same slot."""
    word = lambda x, w: F.coalesce(x("type"), F.lit("")).rlike(w)
    width = lambda x: F.regexp_extract(x("type"), r"_BitInt\s*\(\s*(\d+)\s*\)", 1)

    def rules(o, n):
        same = both(o, n)
        return [
            ("atomic_qualifier_changed", same & (word(o, r"\b_Atomic\b|std::atomic<") != word(n, r"\b_Atomic\b|std::atomic<")), o("type"), n("type")),
            ("bit_int_width_changed", same & (width(o) != "") & (width(n) != "") & (width(o) != width(n)), o("type"), n("type")),
            ("char8t_migration", same & (word(o, r"\bchar8_t\b") != word(n, r"\bchar8_t\b")) & (F.regexp_replace(o("type"), r"char8_t", "char") == F.regexp_replace(n("type"), r"char8_t", "char")), o("type"), n("type")),
        ]

    return compared(_slots(p, "old"), _slots(p, "new"), ["slot"], "slot", rules)


@detector("integer_model")
def integer_model(p: Pair) -> DataFrame:
    """Integer widths flipped across the surface: at least 4 slots and half of those compared, or an integer typedef.

    The model is LLP64 (long has 32 bits) if a side is a PE image, else LP64.
    """
    pe = p.documents("old").select("pair_id", (F.col("platform") == "pe").alias("_pe")).unionByName(p.documents("new").select("pair_id", (F.col("platform") == "pe").alias("_pe"))).groupBy("pair_id").agg(F.coalesce(F.max("_pe"), F.lit(False)).alias("_pe"))
    bits = lambda c, pe: T.integer_width(F.col(c), "LLP64" if pe else "LP64")["bits"]
    sized = lambda df, c, tag: df.withColumnRenamed(c, tag).filter(bits(tag, False).isin(32, 64) | bits(tag, True).isin(32, 64))

    def joined(f, key, c, alias):
        # widths by both models, then sums by pair: a row a pair meets its model, not its whole surface
        models = F.array(*(F.struct(F.lit(pe).alias("_pe"), bits("_a", pe).alias("a"), bits("_b", pe).alias("b")) for pe in (False, True)))
        rows = sized(f("old"), c, "_a").join(shuffled(sized(f("new"), c, "_b")), ["pair_id", key]).select("pair_id", F.inline(models))
        return rows.filter(F.col("a").isin(32, 64) & F.col("b").isin(32, 64)).withColumn("_alias", F.lit(alias))

    functions = lambda side: _slots(p, side).filter(F.contains("slot", F.lit("()")) | F.contains("slot", F.lit("#")))
    named = lambda side: p.map(side, "typedefs").filter(F.col("key").rlike("_INT|_int|INT_T"))
    rows = joined(functions, "slot", "type", False).unionByName(joined(named, "key", "value", True))
    flip, alias = F.col("a") != F.col("b"), F.col("_alias")
    got = rows.groupBy("pair_id", "_pe").agg(F.count_if(~alias).alias("n"), F.count_if(flip & ~alias).alias("flips"), F.count_if(flip & alias).alias("aliases"), F.count_if(F.col("b") > F.col("a")).alias("ups"), F.count_if(F.col("b") < F.col("a")).alias("downs"))
    hit = got.join(pe, ["pair_id", "_pe"]).filter("(flips >= 4 and flips * 2 >= n) or aliases > 0")
    return hit.select("pair_id", F.lit("integer_model_changed").alias("kind"), F.lit("__integer_model").alias("symbol"), F.concat(F.col("downs").cast("string"), F.lit(" narrowing / "), F.col("ups").cast("string"), F.lit(" widening transitions")).alias("old_value"), F.when(F.col("ups") >= F.col("downs"), "wider").otherwise("narrower").alias("new_value"))


def _removed_added(p: Pair) -> tuple[DataFrame, DataFrame]:
    f = lambda side: p.unique(side, "functions", "mangled").filter("visibility = 'public'").select("pair_id", "mangled", "name")
    old, new = f("old"), f("new")
    key = ["pair_id", "mangled"]
    return old.join(shuffled(new.select(*key)), key, "left_anti"), new.join(shuffled(old.select(*key)), key, "left_anti")


def _keyed_renames(p: Pair, key: Column, kind: str, only: Column) -> DataFrame:
    """Removed and added symbols with one normalised key; each key once, least names."""
    gone_, came_ = _removed_added(p)
    pick = lambda df, c: df.filter(only).groupBy("pair_id", key.alias("_k")).agg(F.min("mangled").alias(c))
    return pick(gone_, "old_value").join(shuffled(pick(came_, "new_value")), ["pair_id", "_k"]).select("pair_id", F.lit(kind).alias("kind"), F.col("old_value").alias("symbol"), "old_value", "new_value")


#: An ABI tag in a mangled name: B, the length of the tag, and as many characters.
ABI_TAG = "B(?:" + "|".join(f"{n}[A-Za-z_]\\w{{{n - 1}}}" for n in range(1, 61)) + ")"
CXX11 = "__cxx11|B5cxx11"


def _dual_abi(gone_: DataFrame, came_: DataFrame) -> DataFrame:
    """pair_id and marked names of pairs that went from one std::string to the other: 5 removed and 5 added at least, 30 % of them marked."""
    marked = F.count_if(F.col("mangled").rlike(CXX11)).alias("_m")
    n = lambda df, c: df.groupBy("pair_id").agg(F.count(F.lit(1)).alias(c), marked.alias(f"{c}_m"))
    both_ = n(gone_, "r").join(n(came_, "a"), "pair_id")
    return both_.filter("r >= 5 and a >= 5 and r_m + a_m > 0 and (r_m + a_m) >= 0.3 * (r + a)").select("pair_id", F.col("r_m").cast("string").alias("old_value"), F.col("a_m").cast("string").alias("new_value"))


@detector("glibcxx_dual_abi")
def glibcxx_dual_abi(p: Pair) -> DataFrame:
    """The surface went from one libstdc++ string ABI to the other."""
    return _dual_abi(*_removed_added(p)).select("pair_id", F.lit("glibcxx_dual_abi_flip_detected").alias("kind"), F.lit("__glibcxx_dual_abi").alias("symbol"), "old_value", "new_value")


@detector("abi_tags")
def abi_tags(p: Pair) -> DataFrame:
    """ABI tags of a mangled name came, went or changed; each added symbol is used once; silent under a dual-ABI flip."""
    gone_, came_ = _removed_added(p)
    base = lambda df, c: df.filter(F.startswith("mangled", F.lit("_Z"))).select("pair_id", F.regexp_replace("mangled", ABI_TAG, "").alias("_base"), F.col("mangled").alias(c))
    tags = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({ABI_TAG})"), F.lit(1))))
    pairs = paired(base(gone_, "old_value"), base(came_, "new_value"), ["pair_id", "_base"], "old_value", "new_value").filter(tags("old_value") != tags("new_value"))
    quiet = pairs.join(_dual_abi(gone_, came_).select("pair_id"), "pair_id", "left_anti")
    return quiet.select("pair_id", F.lit("abi_tag_changed").alias("kind"), F.col("old_value").alias("symbol"), "old_value", "new_value")


@detector("long_double")
def long_double(p: Pair) -> DataFrame:
    """long double mangled as e against __float128 mangled as g, at the ends of names."""
    return _keyed_renames(p, F.regexp_replace("mangled", "[eg]$", "%"), "long_double_abi_changed", F.col("mangled").rlike("^_Z.*[eg]$"))


@detector("namespaces")
def namespaces(p: Pair) -> DataFrame:
    """Experimental declarations graduated or removed; inline namespace versions bumped."""
    exp = r"(^|::)experimental::"
    names = lambda side: p.unique(side, "functions", "mangled").filter("visibility = 'public'").select("pair_id", F.regexp_replace("name", r"\(.*$", "").alias("name")).distinct()

    def stems(side: str) -> DataFrame:
        stem = F.regexp_replace(F.regexp_replace("name", exp, "$1"), r"(^|::)v\d+::", "$1")
        return names(side).groupBy("pair_id", stem.alias("stem")).agg(F.max(F.col("name").rlike(exp)).alias("exp"), F.max(~F.col("name").rlike(exp)).alias("stable"), F.max(F.regexp_extract("name", r"(?:^|::)v(\d{1,6})::", 1).try_cast("int")).alias("version"))

    return compared(stems("old"), stems("new"), ["stem"], "stem", namespace_rules)


def namespace_rules(o, n):
    """Of a stem: is it experimental, stable, and its highest inline version."""
    return [
        ("experimental_graduated", both(o, n) & o("exp") & ~o("stable") & n("exp") & n("stable"), None, F.col("stem")), ("experimental_removed_without_replacement", gone(o, n) & o("exp") & ~o("stable"), F.col("stem"), None),
        ("inline_namespace_version_bumped", both(o, n) & known(o, n, "version") & (n("version") > o("version")), o("version"), n("version")),
    ]


@detector("versioned_scheme")
def versioned_scheme(p: Pair) -> DataFrame:
    """Removed and added names that pair once a trailing version token is stripped: at least 3, and half of the removed."""
    gone_, came_ = _removed_added(p)
    stem = F.regexp_replace("name", r"[_v]?\d+(_\d+)*$", "")
    key = ["pair_id", "_k"]
    a = gone_.select("pair_id", "name", stem.alias("_k")).filter("_k <> name")
    b = came_.select("pair_id", "name", stem.alias("_k")).filter("_k <> name")
    pairs = match.unique_pairs(a.withColumnRenamed("name", "old_name").withColumn("_p", F.col("pair_id")), b.withColumnRenamed("name", "new_name"), key, "_p", "new_name").groupBy(F.col("_p").alias("pair_id")).agg(F.count(F.lit(1)).alias("n"))
    all_ = gone_.groupBy("pair_id").agg(F.count(F.lit(1)).alias("all"))
    return pairs.join(all_, "pair_id").filter("n >= 3 and n * 2 >= all").select("pair_id", F.lit("versioned_symbol_scheme_detected").alias("kind"), F.lit("(scheme)").alias("symbol"), F.col("all").cast("string").alias("old_value"), F.col("n").cast("string").alias("new_value"))


@detector("surface_metrics")
def surface_metrics(p: Pair) -> DataFrame:
    """Public functions and the share of those that no header documents."""
    m = lambda side: p.documents(side).select("pair_id", F.explode("functions").alias("e")).filter("e.visibility = 'public'").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e.origin") == "EXPORT_ONLY").alias("u"))
    ratio = lambda x: x("u") / F.greatest(x("n"), F.lit(1))
    return compared(m("old"), m("new"), [], F.lit("(surface)"), lambda o, n: [("public_surface_grew", both(o, n) & (n("n") > o("n")), o("n"), n("n")), ("public_surface_shrank", both(o, n) & (n("n") < o("n")), o("n"), n("n")), ("undocumented_export_ratio_increased", both(o, n) & (ratio(n) - ratio(o) > 0.01), F.round(ratio(o), 4), F.round(ratio(n), 4))])
