"""Aggregations: matrices, merges and common values, all with map-side partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import rules


def divergent(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one distinct value: n_values and the sorted values.  A null value is no value."""
    return df.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.collect_set(value).alias("_v")).filter(F.size("_v") > 1).select(*key, F.size("_v").alias("n_values"), F.array_sort("_v").alias("values"))


def presence(df: DataFrame, name: str, config: str) -> DataFrame:
    """Names present in some but not all of at least two configurations: present, absent (sorted)."""
    all_ = df.agg(F.array_sort(F.collect_set(config)).alias("_all"))  # one row: the configurations
    got = df.groupBy(name).agg(F.collect_set(config).alias("_p"))
    return got.crossJoin(F.broadcast(all_)).filter((F.size("_all") >= 2) & (F.size("_p") < F.size("_all"))).select(name, F.array_sort("_p").alias("present"), F.array_sort(F.array_except("_all", "_p")).alias("absent"))


def worst_state(df: DataFrame, key: Sequence[str], state: str, order: Sequence[str], unknown: str) -> DataFrame:
    """The worst state of each key; `order` is from worst to best, others count as `unknown`."""
    places = F.array(*map(F.lit, order))
    at = F.array_position(places, F.col(state))
    at = F.when(at > 0, at).otherwise(F.array_position(places, F.lit(unknown)))
    return df.groupBy(*key).agg(F.element_at(places, F.min(at).cast("int")).alias(state))


def unanimous(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The value on which all rows of a key agree, else null; one null is disagreement."""
    same = (F.count(F.lit(1)) == F.count(value)) & (F.min(value) == F.max(value))
    return df.groupBy(*key).agg(F.when(same, F.min(value)).alias(value))


def merge_facts(facts: DataFrame, entity: Sequence[str], confidence: str, producer: str, value: str) -> DataFrame:
    """Per entity the value of highest confidence, then least producer, then least value; and how many others differ."""
    order = F.struct(-F.col(confidence), F.col(producer), F.col(value))
    out = facts.groupBy(*entity).agg(F.min_by(F.struct(F.col(value).alias("value"), F.col(producer).alias("producer")), order).alias("_b"), F.collect_set(value).alias("_all"))
    return out.select(*entity, "_b.value", "_b.producer", (F.size("_all") - 1).alias("n_conflicts"))


def fact_conflicts(facts: DataFrame, entity: Sequence[str], confidence: str, producer: str, value: str) -> DataFrame:
    """Rows whose value lost."""
    best = merge_facts(facts, entity, confidence, producer, value).select(*entity, F.col("value").alias("_won"))
    return facts.join(best, list(entity)).filter(F.col(value) != F.col("_won")).drop("_won")


def first_tier(df: DataFrame, key: Sequence[str], tier: str, value: str) -> DataFrame:
    """Value of the highest populated tier (least number); conflict if any tier of the key disagrees in itself."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*key, tier).agg(F.min(value).alias("_v"), F.countDistinct(value).alias("_n"))
    return per.groupBy(*key).agg(F.min_by("_v", tier).alias("value"), (F.max("_n") > 1).alias("conflict"))


def finding_matrix(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """Per target and identity: affected, unaffected and undetermined profiles, and the scope.

    findings: target, profile, identity.  checks: target, profile, complete (one row a check).  A profile
    with an incomplete check is undetermined unless affected: what was not searched never clears a finding.
    """
    profiles = checks.groupBy("target", "profile").agg(F.min(F.coalesce("complete", F.lit(False))).alias("_complete"))
    hit = findings.select("target", "identity", "profile").distinct()
    grid = hit.select("target", "identity").distinct().join(profiles, "target")
    state = grid.join(hit.withColumn("_hit", F.lit(True)), ["target", "identity", "profile"], "left").withColumn("_s", F.when(F.col("_hit"), "affected").when(~F.col("_complete"), "undetermined").otherwise("unaffected"))
    sides = [F.array_sort(F.collect_set(F.when(F.col("_s") == s, F.col("profile")))).alias(s) for s in ("affected", "unaffected", "undetermined")]
    out = state.groupBy("target", "identity").agg(*sides)
    scope = F.when(F.size("undetermined") > 0, "undetermined").when(F.size("unaffected") == 0, "all_profiles").when(F.size("affected") == 1, "profile_specific").otherwise("partial")
    return out.withColumn("scope", scope)


def sampled(col: Column | str, k: int = 5) -> Column:
    """First k sorted distinct values and '(+n more)'; an aggregate."""
    all_ = F.array_sort(F.collect_set(col))
    more = F.size(all_) - k
    return F.concat(F.array_join(F.slice(all_, 1, k), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def coverage(expected: DataFrame, observed: DataFrame, key: Sequence[str], state: str = "state", good: str = "ok") -> DataFrame:
    """Expected keys that were not observed in a good state: missing or the state."""
    return expected.join(observed.select(*key, state), list(key), "left").filter(~F.col(state).eqNullSafe(F.lit(good))).select(*key, F.coalesce(F.col(state), F.lit("missing")).alias("failure"))


def breakdown(df: DataFrame, by: Sequence[str], **counts: Column) -> DataFrame:
    """by, n (rows) and for each name the rows of which its condition holds."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def sessions(events: DataFrame, key: str, time: str, tie: str, gap: str) -> DataFrame:
    """key, sessions and n: a session ends where the next event is more than `gap` (an interval) later."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time, tie))
    starts = events.select(key, F.when(before.isNull() | (F.col(time) - before > F.expr(f"INTERVAL {gap}")), 1).otherwise(0).alias("_b"))
    return starts.groupBy(key).agg(F.sum("_b").alias("sessions"), F.count(F.lit(1)).alias("n"))


# What a relevance is called that could not be decided.
UNDECIDED = ("UNKNOWN_UNRESOLVED", "UNKNOWN_UNPROVEN")


def evicted(entries: DataFrame, keep: int, name: str = "name", at: str = "mtime") -> DataFrame:
    """Entries beyond the `keep` newest; the cache's size bounds what is held in one place."""
    newest = entries.orderBy(F.col(at).desc(), F.col(name).desc()).limit(keep).select(name)
    return entries.join(newest, name, "left_anti")


def unresolved_rate(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by and rate: the share of decisions (relevance) that were not decided; 0 without any."""
    open_ = F.coalesce(F.col("relevance").isin(*UNDECIDED), F.lit(False))
    return decisions.groupBy(*by).agg(F.coalesce(F.avg(open_.cast("double")), F.lit(0.0)).alias("rate"))


def surface_breakdown(findings: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """by, total, rtti, internal and public: findings by the origin of their symbol."""
    origin = T.symbol_origin(F.coalesce("symbol", F.lit("")))
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(origin == o).alias(o) for o in ("rtti", "internal", "public")))


def report_summary(findings: DataFrame, sizes: DataFrame, verdict: str = "effective_verdict") -> DataFrame:
    """A row for each pair of sizes (pair_id, old_symbols): counts by verdict and the two percentages."""
    of = lambda v: F.count_if(F.col(verdict) == v)
    n = findings.groupBy("pair_id").agg(of("BREAKING").alias("breaking"), of("API_BREAK").alias("source_breaks"), of("COMPATIBLE_WITH_RISK").alias("risk_count"), of("COMPATIBLE").alias("compatible_additions"), F.count(F.lit(1)).alias("total_changes"))
    out = sizes.join(n, "pair_id", "left").na.fill(0, ["breaking", "source_breaks", "risk_count", "compatible_additions", "total_changes"])
    old, bad = F.col("old_symbols"), F.col("breaking")
    affected = F.when(old > 0, F.least(F.lit(100.0), bad / old * 100)).otherwise(0.0)
    return out.withColumns({"binary_compatibility_pct": rules.compatibility_percent(old, bad, F.col("total_changes")), "affected_pct": affected})
