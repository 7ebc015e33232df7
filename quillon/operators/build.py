"""Differences of build and source facts.

Relations: options(key, value, abi_relevant), toolchains(language, compiler, version), macros(tu, macro, value),
facts(tu_id, kind, qualified_name, header, signature_hash, body_hash, type_hash, value),
includes(public_header, included, class), states(tu_id, family, state).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import rollup

#: States of fact families, from worst to best.
STATES = ("failed", "missing", "partial", "not_applicable", "complete")
#: Compiler defaults of runtime-model options that are often omitted.
OPTION_DEFAULTS = {"exceptions": "on", "rtti": "on", "threadsafe_statics": "on"}
MODE_KINDS = {"exceptions": "exceptions_mode_changed", "rtti": "rtti_mode_changed", "threadsafe_statics": "threadsafe_statics_mode_changed", "lto": "lto_mode_changed", "struct_packing": "struct_packing_mode_changed", "char_signedness": "char_signedness_changed", "enum_size": "enum_size_flag_changed", "sanitizer": "sanitizer_mode_changed"}
_MACRO = r"^(_GLIBCXX_|_LIBCPP_|_FILE_OFFSET_BITS|_TIME_BITS|_ITERATOR_DEBUG|NDEBUG$|.*_ABI(_|$)|.*_API_VERSION)"


def option_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind, key, old_values, new_values of options whose value sets differ; an omitted option has its compiler's default."""
    sets = lambda df, c: df.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias(c), F.max("abi_relevant").alias(f"_{c}"))
    both = sets(old, "old_values").join(sets(new, "new_values"), "key", "full_outer")
    default = F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for name, value in OPTION_DEFAULTS.items():
        default = F.when(F.substring_index("key", ":", 1) == name, value).otherwise(default)
    for name, k in MODE_KINDS.items():
        kind = F.when(F.substring_index("key", ":", 1) == name, k).otherwise(kind)
    filled = both.withColumns({c: F.coalesce(c, F.when(default.isNotNull(), F.array(default)), F.array().cast("array<string>")) for c in ("old_values", "new_values")})
    relevant = F.coalesce("_old_values", F.lit(False)) | F.coalesce("_new_values", F.lit(False))
    return filled.filter("old_values <> new_values").select(F.coalesce(kind, F.when(relevant, "abi_relevant_build_flag_changed").otherwise("build_context_changed")).alias("kind"), "key", "old_values", "new_values")


def toolchain_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = (df.select("language", F.concat_ws(" ", "compiler", "version").alias(c)) for df, c in ((old, "old_value"), (new, "new_value")))
    return a.join(b, "language").filter("old_value <> new_value").select(F.lit("toolchain_version_changed").alias("kind"), "language", "old_value", "new_value")


def standard_floor(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row if the least language standard rose; tables of (configuration, cxx_std)."""
    low = lambda df, c: df.filter("cxx_std is not null").agg(F.min("cxx_std").alias(c))
    return low(old, "old_value").crossJoin(low(new, "new_value")).filter("new_value > old_value").select(F.lit("cxx_standard_floor_raised").alias("kind"), "old_value", "new_value")  # one row each


def config_dependent(decls: DataFrame) -> DataFrame:
    """Declarations of some configurations only; decls: name, configuration."""
    return rollup.presence(decls, "name", "configuration").withColumn("kind", F.lit("api_depends_on_consumer_env"))


def macro_divergence(macros: DataFrame) -> DataFrame:
    """ABI macros with more than one value: macro, and the units of each value.  Absence is no conflict."""
    of = macros.filter(F.col("macro").rlike(_MACRO)).groupBy("macro", "value").agg(F.array_sort(F.collect_set("tu")).alias("units"))
    return of.groupBy("macro").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "units")))).alias("values")).filter(F.size("values") > 1)


def header_leaks(includes: DataFrame) -> DataFrame:
    """Distinct private or generated headers that public ones include."""
    return includes.filter(F.col("class").isin("private", "generated") & (F.col("included") != F.col("public_header"))).select("public_header", "included", "class").distinct()


def _header_base(c: str):
    return F.substring_index(F.coalesce(c, F.lit("")), "/", -1)


def odr_conflicts(facts: DataFrame) -> DataFrame:
    """Types with several definitions: qualified_name, header (its last part), hashes."""
    t = facts.filter("kind = 'type' and type_hash is not null").select("qualified_name", _header_base("header").alias("header"), "type_hash")
    return rollup.divergent(t, ["qualified_name", "header"], "type_hash").withColumnRenamed("values", "hashes")


def new_odr_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    return odr_conflicts(new).join(odr_conflicts(old).select("qualified_name", "header"), ["qualified_name", "header"], "left_anti").withColumn("kind", F.lit("odr_source_conflict"))


def source_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Macros, typedefs, inline functions, templates and constants of source facts, by (kind, name).

    A side without any facts was not extracted, which is not an empty surface: then nothing is reported gone.
    """
    pick = lambda df, s: df.groupBy(F.col("kind").alias("what"), "qualified_name").agg(F.min(F.coalesce("value", F.lit(""))).alias(f"{s}_value"), F.min("signature_hash").alias(f"{s}_sig"), F.min("body_hash").alias(f"{s}_body"), F.lit(True).alias(f"_{s}"))
    both = pick(old, "old").join(pick(new, "new"), ["what", "qualified_name"], "full_outer")
    there = new.agg((F.count(F.lit(1)) > 0).alias("_any"))
    both = both.crossJoin(there)  # one row
    lost = F.col("_new").isNull() & F.col("_any")
    same = F.col("_old") & F.col("_new")
    w = F.col("what")
    value, body = F.col("old_value") != F.col("new_value"), F.col("old_body") != F.col("new_body")
    sig = F.col("old_sig").eqNullSafe(F.col("new_sig"))
    kind = (
        F.when((w == "macro") & lost, "public_macro_removed").when((w == "macro") & same & value, "public_macro_value_changed").when((w == "typedef") & lost, "public_typedef_removed").when((w == "typedef") & same & value, "public_typedef_target_changed")
        .when((w == "inline") & lost, "inline_function_removed").when((w == "inline") & same & sig & body, "inline_body_changed").when((w == "template") & lost, "uninstantiated_template_removed").when((w == "template") & same & sig & body, "template_body_changed")
        .when((w == "constexpr") & same & value, "constexpr_value_changed").when((w == "default_argument") & same & value, "default_argument_changed").when((w == "concept") & same & ~sig, "concept_tightened")
    )
    return both.select(kind.alias("kind"), "qualified_name", "old_value", "new_value").filter("kind is not null")


def coverage_rollup(states: DataFrame) -> DataFrame:
    """Worst state of each family over units; an unknown state counts as failed."""
    return rollup.worst_state(states, ["family"], "state", STATES, "failed")


def provenance_mismatch(decls: DataFrame, exports: DataFrame) -> DataFrame:
    """One row if at least 5 declarations are expected and 80 % of them are not exported; decls: identity; exports: identity."""
    d = decls.select("identity").distinct()
    seen = d.join(exports.select("identity").distinct().withColumn("_x", F.lit(1)), "identity", "left")
    m = seen.agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("_x").isNull()).alias("missing"))
    return m.filter("expected >= 5 and missing >= 0.8 * expected").withColumn("kind", F.lit("source_binary_provenance_mismatch"))


def merged_defines(defines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, macro, value of its first unit, and conflicts: its spellings if they differ; defines: ordinal, macro, value (null: no value)."""
    shown = F.coalesce("value", F.lit("(defined)"))
    each = defines.groupBy(*by, "macro", "value").agg(F.min("ordinal").alias("_at"))  # one row a spelling before they are gathered
    out = each.groupBy(*by, "macro").agg(F.min_by(F.struct("value"), F.struct("_at", shown)).alias("_v"), F.array_sort(F.collect_set(shown)).alias("_all"))
    return out.select(*by, "macro", F.col("_v.value").alias("value"), F.when(F.size("_all") > 1, F.col("_all")).alias("conflicts"))


def merged_paths(paths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, path, ordinal of its first place: a search list without repeats."""
    return paths.groupBy(*by, "path").agg(F.min("ordinal").alias("ordinal"))
