"""Policies: JSON documents with verdict overrides, frozen namespaces and severity levels.

    {"overrides": {"kind": "break|api_break|risk|ignore"}, "frozen_namespaces": [], "severity": {"addition": "info"},
     "runtime_floors": {"GLIBC": "2.17"}}
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import rules
from quillon.plans import kinds

RULE_SCHEMA = ", ".join(["rule_idx int", *(f"{c} {t}" for c, t in rules.SELECTORS.items()), "expires string", "reason string"])
#: Levels of the severity categories unless a policy says otherwise.
LEVELS = {"abi_breaking": "error", "potential_breaking": "warning", "quality": "info", "addition": "info"}


@dataclass
class Policy:
    overrides: dict[str, str] = field(default_factory=dict)
    frozen: list[str] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=lambda: dict(LEVELS))
    floors: dict[str, str] = field(default_factory=dict)


def load_policy(spark: SparkSession, path: str) -> Policy:
    """Read a policy from any file system that Spark reads; unknown kinds are an error."""
    raw = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    unknown = sorted(set(raw.get("overrides", {})) - set(kinds.VERDICT))
    if unknown:
        raise ValueError(f"the policy overrides kinds that do not exist: {', '.join(unknown)}")
    return Policy(raw.get("overrides", {}), raw.get("frozen_namespaces", []), LEVELS | raw.get("severity", {}), raw.get("runtime_floors", {}))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Suppression rules, one JSON object a line; rules count in the order of rule_idx."""
    return spark.read.schema(RULE_SCHEMA).json(path).withColumn("expires", F.col("expires").cast("date"))


def floors_applied(found: DataFrame, floors: dict[str, str]) -> DataFrame:
    """Raised requirements at or under a declared floor are compatible, over it breaking; others stay."""
    out = F.col("effective_verdict")
    tag = F.when(F.col("kind") == "runtime_floor_raised", F.col("new_value")).otherwise(F.col("symbol"))
    for prefix, floor in floors.items():
        here = F.col("kind").isin("symbol_version_required_added", "runtime_floor_raised") & (F.upper(F.regexp_extract(tag, r"^(.*)_[^_]*$", 1)) == prefix.upper())
        out = F.when(here, F.coalesce(rules.with_floor(F.col("kind"), tag, F.lit(f"{prefix}_{floor}")), out)).otherwise(out)
    return found.withColumn("effective_verdict", out)


def gate(found: DataFrame, policy: Policy) -> DataFrame:
    """pair_id, exit_code and the categories that block, over active findings."""
    live = found.filter("disposition = 'active'").withColumn("category", rules.category(F.col("effective_verdict"), F.col("kind").endswith("_added")))
    blocking = F.array_sort(F.collect_set(F.when(F.col("category").isin(*[c for c, v in policy.severity.items() if v == "error"] or [""]), F.col("category"))))
    return live.groupBy("pair_id").agg(rules.exit_code(F.col("category"), policy.severity).alias("exit_code"), blocking.alias("blocking"))
