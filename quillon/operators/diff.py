"""Keyed differences of two relations: what went, what came, what changed.

All comparisons are null-safe.  A tri-state flag that is null was not recorded, which is not false; guards
for that are explicit.  Each operator is one full outer join on the keys, so both sides are read once and
shuffled once, and a bucketed or pre-partitioned input is not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T


def text(col: Column) -> Column:
    """A value as findings carry it."""
    return col.cast("string")


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str] = ()) -> DataFrame:
    """change (removed, added, changed), the keys, attr, old_value, new_value.

    One row for each key on one side only (attr null), and one for each differing attribute of a common key.
    Rows whose key is null never meet, as in any equi-join.
    """
    a = old.select(*keys, F.struct(F.lit(1).alias("_"), *compare).alias("_old"))
    b = new.select(*keys, F.struct(F.lit(1).alias("_"), *compare).alias("_new"))
    both = a.join(b, list(keys), "full_outer")
    none = F.lit(None).cast("string")
    gone = F.struct(F.lit("removed").alias("change"), none.alias("attr"), none.alias("old_value"), none.alias("new_value"))
    came = F.struct(F.lit("added").alias("change"), none.alias("attr"), none.alias("old_value"), none.alias("new_value"))
    changed = [F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.struct(F.lit("changed").alias("change"), F.lit(c).alias("attr"), text(F.col(f"_old.{c}")).alias("old_value"), text(F.col(f"_new.{c}")).alias("new_value"))) for c in compare]
    found = F.when(F.col("_new").isNull(), F.array(gone)).when(F.col("_old").isNull(), F.array(came))
    found = found.otherwise(F.filter(F.array(*changed), lambda x: x.isNotNull())) if changed else found
    return both.select(*keys, F.inline(found)).select("change", *keys, "attr", "old_value", "new_value")


def nested_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], array: str, member: str | None, compare: Sequence[str]) -> DataFrame:
    """keyed_diff of the elements of an array of structs, for keys on both sides.

    Elements are told apart by their field `member`, or by their position if it is None.
    """
    tag = member or "pos"

    def flat(df: DataFrame, other: DataFrame) -> DataFrame:
        mine = df.join(other.select(*keys), list(keys), "left_semi")
        if member:
            return mine.select(*keys, F.explode(array).alias("_e")).select(*keys, F.col(f"_e.{member}").alias(tag), *(F.col(f"_e.{c}").alias(c) for c in compare))
        return mine.select(*keys, F.posexplode(array).alias("pos", "_e")).select(*keys, "pos", *(F.col(f"_e.{c}").alias(c) for c in compare))

    return keyed_diff(flat(old, new), flat(new, old), [*keys, tag], compare)


def transition(old: Column, new: Column, added: str, removed: str, skip_none: bool = False) -> Column:
    """`added` where a flag came on, `removed` where it went off, else null.

    With skip_none a null on either side gives null; without, null counts as false.
    """
    a, b = F.coalesce(old, F.lit(False)), F.coalesce(new, F.lit(False))
    found = F.when(~a & b, F.lit(added)).when(a & ~b, F.lit(removed))
    return F.when(old.isNotNull() & new.isNotNull(), found) if skip_none else found


def order_changed(old: Column, new: Column) -> Column:
    """Two arrays hold the same values in another order."""
    return (old != new) & (F.array_sort(old) == F.array_sort(new))


def except_both(old: DataFrame, new: DataFrame, on: Column | str, keep: Sequence[str]) -> DataFrame:
    """Rows of either side whose normalised key is not on the other: side (removed, added) and the raw columns."""
    key = F.col(on) if isinstance(on, str) else on
    a, b = old.select(*keep, key.alias("_key")), new.select(*keep, key.alias("_key"))
    gone = a.join(b.select("_key"), "_key", "left_anti").select(F.lit("removed").alias("side"), *keep)
    came = b.join(a.select("_key"), "_key", "left_anti").select(F.lit("added").alias("side"), *keep)
    return gone.unionByName(came)


def first_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Of the rows of a key, the one of least ordinal; a partial aggregate, so a hot key does not gather."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("_row")).select(*keys, "_row.*")


def exported_names(symbols: DataFrame, types: Sequence[str], relevant_only: bool = False, runtime_is_foreign: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """by and name: distinct exports of the given symbol types (name, sym_type); with relevant_only, the library's own."""
    keep = F.col("sym_type").isin(*types) & (F.col("name") != "")
    if relevant_only:
        keep = keep & T.abi_relevant(F.col("name"), runtime_is_foreign)
    return symbols.filter(keep).select(*by, "name").distinct()


def export_delta(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """kind, by, symbol: functions that the symbol table alone shows to be gone."""
    side = lambda df: exported_names(df, T.FUNCTION_TYPES, relevant_only=True, by=by)
    return side(old).join(side(new), [*by, "name"], "left_anti").select(F.lit("func_removed_elf_only").alias("kind"), *by, F.col("name").alias("symbol"))


def node_of(symbols: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, name and the defined node that holds it; of several the node that the table (name, version, ordinal) shows first."""
    held = symbols.filter("version <> ''").join(nodes.select(*by, "version").distinct(), [*by, "version"], "left_semi")
    first = held.groupBy(*by, "version").agg(F.min("ordinal").alias("_at"))
    return held.select(*by, "version", "name").join(first, [*by, "version"]).groupBy(*by, "name").agg(F.min_by("version", F.struct("_at", "version")).alias("version"))


def moved_nodes(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """kind, by, symbol, old_value, new_value of names on both sides that are held by another node; tables as node_of gives them."""
    both = old.withColumnRenamed("version", "old_value").join(new.withColumnRenamed("version", "new_value"), [*by, "name"]).filter("old_value <> new_value")
    return both.select(F.lit("symbol_moved_version_node").alias("kind"), *by, F.col("name").alias("symbol"), "old_value", "new_value")


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """c_symbol, change of two manifests (c_symbol, return_dtype, params, ufunc: signature and loop_symbol, or null).

    A ufunc that an export gains is an addition; one that it loses or alters is a change of signature or loop symbol.
    """
    side = lambda df, c: df.select("c_symbol", F.struct("return_dtype", "params", "ufunc").alias(c))
    both = side(old, "_o").join(side(new, "_n"), "c_symbol", "full_outer")
    here = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    had, has = F.col("_o.ufunc").isNotNull(), F.col("_n.ufunc").isNotNull()
    other = lambda c: F.coalesce(F.col(f"_o.ufunc.{c}"), F.lit("")) != F.coalesce(F.col(f"_n.ufunc.{c}"), F.lit(""))
    same = F.col("_o.return_dtype").eqNullSafe(F.col("_n.return_dtype")) & F.col("_o.params").eqNullSafe(F.col("_n.params"))
    tests = [
        (F.col("_n").isNull(), "removed"), (F.col("_o").isNull(), "added"), (here & ~same, "signature"), (here & ~had & has, "ufunc_added"),
        (here & had & other("signature"), "ufunc_signature"), (here & had & other("loop_symbol"), "ufunc_loop_symbol"),
    ]
    return both.select("c_symbol", F.explode(F.filter(F.array(*(F.when(c, name) for c, name in tests)), lambda x: x.isNotNull())).alias("change"))
