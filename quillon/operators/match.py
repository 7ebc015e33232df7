"""Pairing of removed and added rows, and first matches in ordered candidates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.storage import materialize, shuffled


def unique_pairs(removed: DataFrame, added: DataFrame, on: Sequence[str], left: str, right: str) -> DataFrame:
    """left, right of rows that agree on `on` and are the only ones of it on their sides.

    Counts are partial aggregates and the join is one to one, so a key that is frequent on both sides costs
    a count, not a product.
    """
    a = removed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(left).alias(left)).filter("_n = 1").drop("_n")
    b = added.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(right).alias(right)).filter("_n = 1").drop("_n")
    return a.join(shuffled(b), list(on)).select(left, right)


def band_join(a: DataFrame, b: DataFrame, x: str, y: str, tolerance: float, low: float = 1.0) -> DataFrame:
    """Pairs with |x - y| <= tolerance * max(x, y), as an equi-join on logarithmic bands.

    Values in one band of ratio 1 / (1 - tolerance), or in two next to each other, are the only candidates:
    each row of a goes to its band and both neighbours, so there is no cross product.  x, y >= low > 0.
    """
    import math

    step = -math.log(1 - tolerance)
    band = lambda c: F.floor(F.log(F.greatest(F.col(c).cast("double"), F.lit(low))) / step)
    left = a.withColumn("_band", F.explode(F.array(band(x) - 1, band(x), band(x) + 1)))
    return left.join(b.withColumn("_band", band(y)), "_band").filter(F.abs(F.col(x) - F.col(y)) <= F.lit(tolerance) * F.greatest(F.col(x), F.col(y))).drop("_band")


def band_counts(a: DataFrame, b: DataFrame, key: str, x: str, y: str, tolerance: float) -> DataFrame:
    """key, n: pairs of band_join by key, counted without listing them; keys without one are left out.  tolerance <= 0.5.

    A value x > 0 meets the values of an interval around it (zero meets zero, a negative value none).  Both ends are
    exact: of the doubles near x (1 - tolerance) and x / (1 - tolerance), the last that satisfy the condition.  Ends and
    values of y, each value once with its count, are dealt by range; counts up to an end are a running sum in its range
    and the total of the ranges before, one row a range.  NaN is above all numbers and equal to itself, as in SQL.
    """
    if not 0 <= tolerance <= 0.5:
        raise ValueError("tolerance must be from 0 to 0.5")
    t, big = F.lit(float(tolerance)), F.lit(float("inf"))
    ys = b.select(F.col(y).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    rest = ys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"), F.coalesce(F.sum(F.when(F.isnan("v"), F.col("n"))), F.lit(0)).alias("_nan"), F.coalesce(F.sum(F.when(F.col("v") == big, F.col("n"))), F.lit(0)).alias("_inf"))
    rows = a.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_x")).filter("_x is not null").groupBy("_key", "_x").agg(F.count(F.lit(1)).alias("_rows"))
    xs = rows.select("_x").distinct()
    # steps of half an ulp to one: no double is left out
    near = lambda c: F.transform(F.sequence(F.lit(-16), F.lit(16)), lambda i: c + i * (c * F.lit(2.0**-53)))
    c = F.col("_x")
    low = F.array_min(F.filter(near(c - t * c), lambda v: F.abs(c - v) <= t * F.greatest(c, v)))
    high = F.array_max(F.filter(near(c / (F.lit(1.0) - t)), lambda v: F.abs(c - v) <= t * F.greatest(c, v)))
    ends = xs.filter((c >= 0) & (c < big)).select("_x", F.inline(F.array(F.struct(low.alias("v"), F.lit(0).alias("_at")), F.struct(high.alias("v"), F.lit(2).alias("_at")))))
    events = ys.filter((F.col("v") < big) & (F.col("v") > -big)).select("v", F.lit(1).alias("_at"), "n", F.lit(None).cast("double").alias("_x")).unionByName(ends.withColumn("n", F.lit(0).cast("long")))
    dealt = materialize(events.repartitionByRange("v").withColumn("_range", F.spark_partition_id()), "events")
    upto = F.sum("n").over(Window.partitionBy("_range").orderBy("v", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = dealt.groupBy("_range").agg(F.sum("n").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")  # a row a partition
    ranked = dealt.withColumn("_upto", upto).filter("_x is not null").join(F.broadcast(before), "_range").withColumn("_upto", F.col("_upto") + F.col("_before"))
    within = ranked.groupBy("_x").agg(F.sum(F.when(F.col("_at") == 2, F.col("_upto")).otherwise(-F.col("_upto"))).alias("_n"))
    # infinite differences: NaN meets all, infinity all but itself, every number both of them
    n = F.when(F.isnan("_x"), F.col("_all")).when(c == big, F.col("_all") - F.col("_inf")).otherwise(F.coalesce("_n", F.lit(0)) + F.col("_nan") + F.col("_inf"))
    counted = xs.join(shuffled(within), "_x", "left").crossJoin(F.broadcast(rest)).select("_x", n.alias("_n"))  # one row
    return rows.join(shuffled(counted), "_x").groupBy(F.col("_key").alias(key)).agg(F.sum(F.col("_n") * F.col("_rows")).alias("n")).filter("n > 0")


#: Most pairs of old and new names for which sizes that differ a little are tried.
PASS_THREE_PAIRS = 2_000_000


def _take_only(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of candidate pairs: old names in order take their one unused candidate, if exactly one is unused."""
    used, out = set(), []
    for old_name, mine in pairs.sort_values(["old_name", "new_name"]).groupby("old_name", sort=True):
        free = [n for n in mine.new_name.unique() if n not in used]
        if len(free) == 1:
            used.add(free[0])
            out.append((old_name, free[0]))
    return pd.DataFrame(out, columns=["old_name", "new_name"])


def _same_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pass 2 without a name filter, by counts: what the walk over sorted old names comes to.

    After pass 1 no old name has exactly one new name of its own hash.  So a hashed old name can only take the one new
    name without a hash of its size, and one without a hash only the last new name that is left of its size.
    """
    same = b.filter("hash <> ''").select("hash", "size").distinct()
    news = b.groupBy("size").agg(F.count_if(F.col("hash") == "").alias("_p"), F.count_if(F.col("hash") != "").alias("_h"), F.min(F.when(F.col("hash") == "", F.col("name"))).alias("_plain"), F.min(F.when(F.col("hash") != "", F.col("name"))).alias("_hashed"))
    free = a.filter("hash <> ''").join(shuffled(same), ["hash", "size"], "left_anti").groupBy("size").agg(F.min("name").alias("_t"))
    blank = a.filter("hash = ''").select("size", F.col("name").alias("_m"))
    state = news.join(shuffled(free), "size", "left").join(shuffled(blank.groupBy("size").agg(F.min("_m").alias("_first"))), "size", "left")
    winner = F.when((F.col("_p") == 1) & (F.col("_h") == 0), F.least("_t", "_first")).when((F.col("_p") == 1) & (F.col("_h") > 0), F.col("_t")).when((F.col("_p") == 0) & (F.col("_h") == 1), F.col("_first"))
    one = state.select(winner.alias("old_name"), F.when(F.col("_p") == 1, F.col("_plain")).otherwise(F.col("_hashed")).alias("new_name")).filter("old_name is not null")
    late = state.filter("_p = 1 and _h = 1 and _t is not null").join(shuffled(blank), "size").filter("_m > _t").groupBy("size", F.col("_hashed").alias("new_name")).agg(F.min("_m").alias("old_name"))
    return one.unionByName(late.select("old_name", "new_name"))


def rename_match(old: DataFrame, new: DataFrame, least_size: int = 8, tolerance: float = 0.05, similar: Column | None = None) -> DataFrame:
    """old_name, new_name, confidence for functions (name, size, hash) on one side only.

    Pass 1: same non-empty hash and size, 1.0.  Pass 2: same size, hashes not both present and different, and
    `similar` (a condition on old_name and new_name, if given), 0.8.  Pass 3, if the candidates make at most
    PASS_THREE_PAIRS pairs: sizes that differ by `tolerance` of the larger at most, 0.5.  In each pass old names, in
    sorted order, take their candidate if exactly one is unused.

    Passes 1 and 2 are aggregates and one-to-one joins.  With `similar`, pass 2 walks the pairs that it lets through
    size by size; pass 3 walks its pairs in one task, which PASS_THREE_PAIRS bounds.
    """
    fine = lambda df, other: df.join(shuffled(other.select("name")), "name", "left_anti").filter(F.col("size") >= least_size).select("name", "size", F.coalesce("hash", F.lit("")).alias("hash"))
    a, b = materialize(fine(old, new), "old_names"), materialize(fine(new, old), "new_names")
    few = a.count() * b.count() <= PASS_THREE_PAIRS
    schema = "old_name string, new_name string"

    def left(one: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(df.join(shuffled(one.select(F.col(c).alias("name"))), "name", "left_anti") for df, c in ((a, "old_name"), (b, "new_name")))

    # pass 1: of one hash and size the first old name takes the new one, if there is only one
    first = a.filter("hash <> ''").groupBy("hash", "size").agg(F.min("name").alias("old_name"))
    only = b.filter("hash <> ''").groupBy("hash", "size").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("new_name")).filter("_n = 1")
    one = materialize(first.join(shuffled(only), ["hash", "size"]).select("old_name", "new_name", F.lit(1.0).alias("confidence")), "renames")
    a, b = left(one)
    if similar is None:
        two = _same_size(a, b)
    else:
        x, y = a.select("size", F.col("name").alias("old_name"), F.col("hash").alias("_ha")), b.select("size", F.col("name").alias("new_name"), F.col("hash").alias("_hb"))
        near = x.join(y, "size").filter(similar & ((F.col("_ha") == "") | (F.col("_hb") == "") | (F.col("_ha") == F.col("_hb"))))
        two = near.select("size", "old_name", "new_name").groupBy("size").applyInPandas(_take_only, schema)
    two = materialize(two.withColumn("confidence", F.lit(0.8)), "renames")
    out = one.unionByName(two)
    if few:
        a, b = left(two)
        x, y = a.select(F.col("name").alias("old_name"), F.col("size").alias("_x")), b.select(F.col("name").alias("new_name"), F.col("size").alias("_y"))
        three = band_join(x, y, "_x", "_y", tolerance, float(least_size))
        three = three if similar is None else three.filter(similar)
        out = out.unionByName(three.select("old_name", "new_name", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(lambda t: _take_only(t), schema).withColumn("confidence", F.lit(0.5)))
    return out


def scheme_pairs(removed: DataFrame, added: DataFrame, name: str, key: Column, least_pairs: int = 3, least_share: float = 0.5) -> DataFrame:
    """Pairs of removed and added names that agree once a version token is stripped; none if too few agree."""
    a, b = removed.select(F.col(name).alias("old_name"), key.alias("_k")), added.select(F.col(name).alias("new_name"), key.alias("_k"))
    pairs = unique_pairs(a, b, ["_k"], "old_name", "new_name")
    size = pairs.agg(F.count(F.lit(1)).alias("_n")).crossJoin(removed.agg(F.count(F.lit(1)).alias("_all")))  # two rows of one number each
    return pairs.crossJoin(size.filter((F.col("_n") >= least_pairs) & (F.col("_n") >= least_share * F.col("_all")))).select("old_name", "new_name")


def alias_join(old: DataFrame, new: DataFrame, key: str, alias: str) -> DataFrame:
    """old key, new key: equal keys, else equal aliases where the alias is unambiguous on both sides."""
    same = old.select(F.col(key).alias("old_key")).join(new.select(F.col(key).alias("new_key")), F.col("old_key") == F.col("new_key"))
    a = old.join(new.select(key), key, "left_anti").select(F.col(key).alias("old_key"), alias)
    b = new.join(old.select(key), key, "left_anti").select(F.col(key).alias("new_key"), alias)
    clear = lambda df: df.groupBy(alias).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(alias)
    return same.unionByName(unique_pairs(a.join(clear(old), alias, "left_semi"), b.join(clear(new), alias, "left_semi"), [alias], "old_key", "new_key"))


def first_match(requests: DataFrame, candidates: DataFrame, on: Sequence[str], order: Sequence[Column | str], take: Sequence[str]) -> DataFrame:
    """Each request with the first of its candidates: a partial min_by per key before the join."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    best = candidates.groupBy(*on).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_first"))
    return requests.join(best, list(on), "left").select(*requests.columns, "_first.*")


def bind_symbols(imports: DataFrame, exports: DataFrame, order: DataFrame) -> DataFrame:
    """Binding of each import (consumer, symbol, version, weak) to the first provider that exports it.

    exports: provider, symbol, version, is_default, hidden.  order: provider, rank (load order).  A provider
    other than the consumer is a candidate; hidden ones are noted and passed over.  A versioned import needs
    the exact version; an unversioned one an empty or default version.  Statuses: ok, interposed,
    version_mismatch, visibility_blocked, weak_unresolved, missing.
    """
    found = imports.join(exports.select("provider", "symbol", F.col("version").alias("_v"), "is_default", "hidden"), "symbol", "left").join(order, "provider", "left")
    # a row that only the consumer itself provides stays, as one without a provider
    own = F.coalesce(F.col("provider") == F.col("consumer"), F.lit(False))
    found = found.withColumns({c: F.when(~own, F.col(c)) for c in ("_v", "is_default", "hidden", "rank")}).withColumn("provider", F.when(~own, F.col("provider")))
    seen = F.col("provider").isNotNull() & ~F.col("hidden")
    fits = seen & F.when(F.coalesce("version", F.lit("")) != "", F.col("_v") == F.col("version")).otherwise((F.coalesce("_v", F.lit("")) == "") | F.col("is_default"))
    at = F.struct("rank", "provider")
    best = found.groupBy("consumer", "symbol", "version", "weak").agg(
        F.min(F.when(fits, at)).alias("_fit"), F.min(F.when(seen, at)).alias("_seen"), F.max(F.coalesce("hidden", F.lit(False))).alias("_hidden"),
    )
    status = (
        F.when(F.col("_fit").isNotNull() & (F.col("_fit") != F.col("_seen")) & (F.coalesce("version", F.lit("")) != ""), "interposed").when(F.col("_fit").isNotNull(), "ok")
        .when(F.col("_seen").isNotNull(), "version_mismatch").when(F.coalesce("_hidden", F.lit(False)), "visibility_blocked").when(F.col("weak"), "weak_unresolved").otherwise("missing")
    )
    return best.select("consumer", "symbol", "version", F.coalesce("_fit.provider", "_seen.provider").alias("provider"), status.alias("status"))


def binding_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bindings of both environments that changed: provider_changed or weak_resolution_changed."""
    keys = ["consumer", "symbol", "version"]
    both = old.select(*keys, F.col("provider").alias("old_provider"), F.col("status").alias("old_status")).join(new.select(*keys, F.col("provider").alias("new_provider"), F.col("status").alias("new_status")), keys)
    resolved = lambda c: F.col(c).isin("ok", "interposed")
    kind = F.when(resolved("old_status") & resolved("new_status") & (F.col("old_provider") != F.col("new_provider")), "provider_changed").when((F.col("old_status") == "weak_unresolved") & resolved("new_status") | resolved("old_status") & (F.col("new_status") == "weak_unresolved"), "weak_resolution_changed")
    return both.withColumn("kind", kind).filter("kind is not null")


def latest_before(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row with the value of the row before it of its key (a saved baseline against every later build)."""
    return events.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(at)))


