"""Command line: python -m quillon compare|release|symvers|symbols|aggregate ...

Exit code of comparisons: the greatest code of the categories at error level (0: none).
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import detectors, rollup, workflows
from quillon.plans import compare as P
from quillon.plans import policy as policies
from quillon.session import session
from quillon.sinks import report
from quillon.sources import readers

FORMATS = {"markdown": report.markdown, "json": report.json_report, "sarif": report.sarif, "junit": report.junit, "html": report.html}


def _finish(spark: SparkSession, out: P.Result, policy: policies.Policy, args: argparse.Namespace) -> int:
    found = policies.floors_applied(out.findings, policy.floors)
    for row in FORMATS[args.format](found).toLocalIterator():
        print(row.document)
    for row in out.releases.toLocalIterator():
        print(f"{row.pair_id}: {row.verdict}, next release: {row.release}")
    worst = policies.gate(found, policy).agg(F.max("exit_code").alias("c")).first()["c"]
    return worst or 0


def _options(spark: SparkSession, args: argparse.Namespace) -> tuple[policies.Policy, dict]:
    policy = policies.load_policy(spark, args.policy) if args.policy else policies.Policy()
    rules = policies.load_rules(spark, args.suppress) if args.suppress else None
    return policy, {"overrides": policy.overrides, "frozen": policy.frozen, "suppressions": rules, "today": args.today}


def _show(df: DataFrame) -> int:
    n = 0
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))
        n += 1
    return n


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, positional in (("compare", ("old", "new")), ("release", ("snapshots", "old", "new")), ("symvers", ("old", "new")), ("symbols", ("old", "new")), ("aggregate", ("reports",))):
        s = sub.add_parser(name)
        for x in positional:
            s.add_argument(x)
        if name in ("compare", "release"):
            s.add_argument("--format", choices=sorted(FORMATS), default="markdown")
            s.add_argument("--policy")
            s.add_argument("--suppress")
            s.add_argument("--today", default=datetime.date.today().isoformat())
    args = p.parse_args(argv)
    spark = spark or session()
    if args.command == "compare":
        old, new = (readers.read_snapshots(spark, x) for x in (args.old, args.new))
        ids = [[r.snapshot_id for r in df.select("snapshot_id").limit(2).collect()] for df in (old, new)]
        if [len(x) for x in ids] != [1, 1]:
            p.error("compare takes one snapshot a side; use release for several")
        policy, options = _options(spark, args)
        return _finish(spark, P.compare(old.unionByName(new), P.pairs_of(spark, [("comparison", ids[0][0], ids[1][0])]), **options), policy, args)
    if args.command == "release":
        policy, options = _options(spark, args)
        out, only = P.compare_release(readers.read_snapshots(spark, args.snapshots), args.old, args.new, **options)
        _show(only)
        return _finish(spark, out, policy, args)
    if args.command == "symvers":
        return 4 if _show(detectors.kabi_diff(readers.read_symvers(spark, args.old), readers.read_symvers(spark, args.new))) else 0
    if args.command == "symbols":
        return 4 if _show(workflows.diff_symbols(readers.read_debian_symbols(spark, args.old), readers.read_debian_symbols(spark, args.new)).filter("change <> 'added'")) else 0
    rows = readers.read_reports(spark, args.reports)
    matrix = rollup.finding_matrix(rows.filter("identity is not null").select("target", "profile", "identity"), rows.groupBy("target", "profile", "check_id").agg(F.min("complete").alias("complete")))
    _show(matrix.orderBy("target", "identity"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
