"""Rules over findings: suppression, policy verdicts, severities and exit codes.

Rule tables are user files; they are broadcast only after their rows have been counted (RULES_TO_SEND), and
joined by Spark's own choice beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.storage import shuffled

RULES_TO_SEND = 10_000
#: Verdicts from best to worst.
VERDICTS = ("NO_CHANGE", "COMPATIBLE", "COMPATIBLE_WITH_RISK", "API_BREAK", "BREAKING")
#: Exit code of an error-level category.
EXIT_CODES = {"abi_breaking": 4, "potential_breaking": 2, "quality": 1, "addition": 1}


def rank(verdict: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, VERDICTS)), verdict) - 1, F.lit(0)).cast("int")


def verdict_of(rank_col: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VERDICTS)), F.coalesce(rank_col, F.lit(0)) + 1)


def worst_verdict(findings: DataFrame, by: Sequence[str] = (), verdict: str = "verdict") -> DataFrame:
    """The worst verdict of each group; a table without findings is NO_CHANGE."""
    return findings.groupBy(*by).agg(F.max(rank(F.col(verdict))).alias("_r")).select(*by, verdict_of(F.col("_r")).alias("verdict"))


def resolved_verdict(effective: Column, override: Column, base: Column, frozen: Column) -> Column:
    """effective, else override, else base; in a frozen namespace never better than base."""
    found = F.coalesce(effective, override, base)
    return F.when(F.coalesce(frozen, F.lit(False)) & (rank(found) < rank(base)), base).otherwise(found)


def small(rules: DataFrame) -> DataFrame:
    """rules, marked for broadcast if there are few."""
    return F.broadcast(rules) if rules.count() <= RULES_TO_SEND else rules


#: Selectors of a rule, and what a table of rules that lacks one is taken to hold.
SELECTORS = {"symbol": "string", "symbol_pattern": "string", "type_pattern": "string", "member_name": "string", "change_kind": "string", "source_glob": "string", "namespace": "string", "reachability": "string", "allow_public_break": "boolean"}
#: Beginnings of kinds that concern types: what type_pattern may match.
TYPE_KINDS = ("type_", "field_", "union_", "enum_", "typedef_", "base_class_", "virtual_base_", "vptr_", "tail_padding", "standard_layout", "trivially_copyable", "layout_", "source_level", "struct_")


def is_type_kind(kind: Column) -> Column:
    out = F.lit(False)
    for p in TYPE_KINDS:
        out = out | F.startswith(kind, F.lit(p))
    return out


def completed(rules: DataFrame) -> DataFrame:
    """rules with every selector, null where the table has none."""
    return rules.withColumns({c: F.lit(None).cast(t) for c, t in SELECTORS.items() if c not in rules.columns})


def is_broad(prefix: str = "") -> Column:
    """A rule that names no symbol, type or member."""
    return F.coalesce(*(F.col(prefix + c) for c in ("symbol", "symbol_pattern", "type_pattern", "member_name"))).isNull()


def matches(findings: DataFrame, rules: DataFrame, today: str) -> DataFrame:
    """All (finding, rule) pairs that match.

    rules: rule_idx, expires and any of SELECTORS; a null selector matches all, an expired rule nothing.  Patterns
    match whole symbols (type_pattern: symbols of findings about types; member_name: what follows the last ::).
    Rules that name a symbol, or else a kind, or else a namespace are equi-joined on it; only patterns and globs
    without any of these are tried on every finding.
    """
    rules = completed(rules).filter(F.col("expires").isNull() | (F.col("expires") >= F.lit(today).cast("date")))
    f = findings if "source" in findings.columns else findings.withColumn("source", F.lit(None).cast("string"))
    glob = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("r.source_glob"), r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    whole = lambda text, pattern: F.col(pattern).isNull() | F.coalesce(F.regexp_like(text, F.concat(F.lit("^(?:"), F.col(pattern), F.lit(")$"))), F.lit(False))
    rest = (
        (F.col("r.symbol").isNull() | (F.col("r.symbol") == F.col("f.symbol")))
        & (F.col("r.change_kind").isNull() | (F.col("r.change_kind") == F.col("f.kind")))
        & whole(F.col("f.symbol"), "r.symbol_pattern")
        & (F.col("r.type_pattern").isNull() | (is_type_kind(F.col("f.kind")) & whole(F.col("f.symbol"), "r.type_pattern")))
        & whole(F.substring_index("f.symbol", "::", -1), "r.member_name")
        & (F.col("r.source_glob").isNull() | F.coalesce(F.regexp_like(F.col("f.source"), glob), F.lit(False)))
        & (F.col("r.namespace").isNull() | F.coalesce((F.col("f.symbol") == F.col("r.namespace")) | F.startswith(F.col("f.symbol"), F.concat("r.namespace", F.lit("::"))), F.lit(False)))
    )
    take = [*(f"f.{c}" for c in findings.columns), "r.rule_idx", "r.expires", "r.allow_public_break", "r.reachability", "_is_broad"]
    dealt = rules.withColumns({"_is_broad": is_broad(), "_by": F.when(F.col("symbol").isNotNull(), 0).when(F.col("change_kind").isNotNull(), 1).when(F.col("namespace").isNotNull(), 2).otherwise(3)})
    left, right = f.alias("f"), [small(dealt.filter(F.col("_by") == k)).alias("r") for k in range(4)]
    parts = F.split("symbol", "::")
    up = f.withColumn("_ns", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))))
    out = left.join(right[0], (F.col("f.symbol") == F.col("r.symbol")) & rest).select(*take)
    out = out.unionByName(left.join(right[1], (F.col("f.kind") == F.col("r.change_kind")) & rest).select(*take))
    out = out.unionByName(up.alias("f").join(right[2], (F.col("f._ns") == F.col("r.namespace")) & rest).select(*take))
    return out.unionByName(left.join(right[3], rest).select(*take))


def suppressed(findings: DataFrame, rules: DataFrame, key: Sequence[str], today: str, public_break: Column | None = None) -> DataFrame:
    """findings with rule_idx of the first rule that matches (null: none), and `withheld_by` of one that a gate held back.

    Where public_break holds, a broad rule (is_broad) does not hide the finding unless it has allow_public_break.  A
    rule's reachability is any, public-only or unreachable-only (null: any), judged by public_reachable.
    """
    broken = F.lit(False) if public_break is None else F.coalesce(public_break, F.lit(False))
    allowed = F.coalesce("allow_public_break", F.lit(False))
    public = F.coalesce("public_reachable", F.lit(True)) if "public_reachable" in findings.columns else F.lit(True)
    held = F.col("_is_broad") & broken & ~allowed
    held = held | ((F.col("reachability") == "unreachable-only") & public & ~(broken & allowed)) | ((F.col("reachability") == "public-only") & ~public)
    hit = matches(findings, rules, today).withColumn("_held", F.coalesce(held, F.lit(False)))
    best = hit.groupBy(*key).agg(F.min(F.when(~F.col("_held"), F.col("rule_idx"))).alias("rule_idx"), F.min(F.when(F.col("_held"), F.col("rule_idx"))).alias("withheld_by"))
    return findings.join(shuffled(best), list(key), "left").withColumn("disposition", F.when(F.col("rule_idx").isNotNull(), "suppressed").otherwise("active"))


def audit(findings: DataFrame, rules: DataFrame, today: str, breaking: Sequence[str] = (), near_days: int = 30) -> DataFrame:
    """Per rule: match_count, stale, expired, near_expiry and high_risk."""
    count = matches(findings, rules, today).groupBy("rule_idx").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("kind").isin(*breaking) if breaking else F.lit(False)).alias("_risk"))
    day = F.lit(today).cast("date")
    expired = F.coalesce(F.col("expires") < day, F.lit(False))
    return rules.join(count, "rule_idx", "left").select(
        "rule_idx", F.coalesce("_n", F.lit(0)).alias("match_count"), (F.col("_n").isNull() & ~expired).alias("stale"), expired.alias("expired"),
        (F.coalesce(F.col("expires") <= F.date_add(day, near_days), F.lit(False)) & ~expired).alias("near_expiry"), F.coalesce("_risk", F.lit(False)).alias("high_risk"),
    )


def category(verdict: Column, is_addition: Column) -> Column:
    """Severity category of a finding."""
    return F.when(verdict == "BREAKING", "abi_breaking").when(verdict.isin("API_BREAK", "COMPATIBLE_WITH_RISK"), "potential_breaking").when(is_addition, "addition").otherwise("quality")


def exit_code(category_col: Column, levels: dict[str, str]) -> Column:
    """Greatest code among categories whose level is error; an aggregate."""
    code = F.lit(0)
    for name, value in EXIT_CODES.items():
        if levels.get(name) == "error":
            code = F.when(category_col == name, value).otherwise(code)
    return F.coalesce(F.max(code), F.lit(0))


def compatibility_percent(old: Column, breaking: Column, changes: Column) -> Column:
    """100 if nothing breaks; else the share of old symbols (or of changes) that do not break, at least 0."""
    return F.when(breaking == 0, 100.0).when(old > 0, F.greatest(F.lit(0.0), (old - breaking) / old * 100)).when(changes > 0, F.greatest(F.lit(0.0), (changes - breaking) / changes * 100)).otherwise(0.0)


def with_floor(kind: Column, tag: Column, floor: Column) -> Column:
    """COMPATIBLE where a required version tag is at or under its floor, BREAKING over it, else null."""
    from quillon.functions.text import tag_version, version_le

    ok = tag_version(tag).isNotNull() & tag_version(floor).isNotNull()
    return F.when(ok & kind.isNotNull(), F.when(version_le(tag_version(tag), tag_version(floor)), "COMPATIBLE").otherwise("BREAKING"))


# Beginnings of names of the CPython interface and of its private part.
CPYTHON, PRIVATE_API = ("Py", "_Py"), ("_Py", "PyUnstable")


def stable_abi(imports: DataFrame, known: DataFrame, floor: tuple[int, int] | None = None) -> DataFrame:
    """imports (name, ...) with status and added: not_cpython, private, unknown, above_floor or stable.

    known: name, major, minor of the release in which a name became stable; the earliest counts.
    """
    since = known.groupBy("name").agg(F.min(F.struct(F.col("major").cast("int").alias("major"), F.col("minor").cast("int").alias("minor"))).alias("added"))
    both = imports.join(small(since), "name", "left")
    mine, hidden = T._starts(F.col("name"), CPYTHON), T._starts(F.col("name"), PRIVATE_API)
    late = F.lit(False) if floor is None else F.col("added") > F.struct(F.lit(floor[0]).alias("major"), F.lit(floor[1]).alias("minor"))
    status = F.when(~mine, "not_cpython").when(F.col("added").isNull(), F.when(hidden, "private").otherwise("unknown")).when(late, "above_floor").otherwise("stable")
    return both.withColumns({"status": status, "added": F.when(mine, F.col("added"))})


def stable_abi_violations(imports: DataFrame, known: DataFrame, floor: tuple[int, int] | None = None) -> DataFrame:
    """Imports that an extension for a stable interface may not have."""
    return stable_abi(imports, known, floor).filter(F.col("status").isin("private", "above_floor"))


def merged_rules(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rules of two lists, those of the second after those of the first."""
    last = first.agg(F.max("rule_idx").alias("_last"))
    moved = second.crossJoin(F.broadcast(last)).withColumn("rule_idx", F.col("rule_idx") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")  # one row
    return first.unionByName(moved, allowMissingColumns=True)
