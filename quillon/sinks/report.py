"""Reports of findings.

Documents are put together in the executors, one per pair, with ordered collect_list over that pair's active
findings.  Reports read by machines (and HTML) are whole unless `limit` is given; Markdown, read by people, is
bounded by LIMIT and says so.  Tables are written as Parquet or JSON.
"""

from __future__ import annotations

from html import escape
from xml.sax.saxutils import escape as xml_escape
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import rules

#: Levels of the SARIF format by verdict.
SARIF_LEVEL = {"BREAKING": "error", "API_BREAK": "error", "COMPATIBLE_WITH_RISK": "warning", "COMPATIBLE": "note"}
LIMIT = 10_000


def _ordered(found: DataFrame, limit: int | None) -> DataFrame:
    """Active findings of each pair, worst first, at most limit (all if None); and how many there are."""
    live = found.filter("disposition = 'active'").withColumn("_rank", -rules.rank(F.col("effective_verdict")))
    w = Window.partitionBy("pair_id").orderBy("_rank", "kind", "symbol")
    out = live.withColumns({"_n": F.row_number().over(w), "_all": F.count(F.lit(1)).over(Window.partitionBy("pair_id"))})
    return out if limit is None else out.filter(F.col("_n") <= limit)


def _documents(found: DataFrame, render, limit: int | None) -> DataFrame:
    rows = _ordered(found, limit).select("pair_id", "_n", "_all", "kind", "symbol", F.coalesce("old_value", F.lit("")).alias("old_value"), F.coalesce("new_value", F.lit("")).alias("new_value"), "effective_verdict")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n")
        return pd.DataFrame({"pair_id": [frame.pair_id.iloc[0]], "document": [render(frame)]})

    return rows.groupBy("pair_id").applyInPandas(one, "pair_id string, document string")


def _markdown(f: pd.DataFrame) -> str:
    counts = f.effective_verdict.value_counts()
    lines = [f"# {f.pair_id.iloc[0]}: {f.effective_verdict.iloc[0]}", "", "| verdict | findings |", "|---|---|", *(f"| {k} | {counts[k]} |" for k in reversed(rules.VERDICTS) if k in counts), ""]
    lines += [f"- **{r.kind}** `{r.symbol}`" + (f": {r.old_value} → {r.new_value}" if r.old_value or r.new_value else "") for r in f.itertuples()]
    if f._all.iloc[0] > len(f):
        lines.append(f"\n{f._all.iloc[0] - len(f)} more findings are not shown.")
    return "\n".join(lines) + "\n"


def _junit(f: pd.DataFrame) -> str:
    bad = f.effective_verdict.isin(["BREAKING", "API_BREAK"])
    cases = []
    for r, b in zip(f.itertuples(), bad, strict=True):
        body = f"<failure message={quoteattr(r.kind)}>{xml_escape(f'{r.old_value} -> {r.new_value}')}</failure>" if b else ""
        cases.append(f"<testcase classname={quoteattr(r.kind)} name={quoteattr(str(r.symbol))}>{body}</testcase>")
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name={quoteattr(f.pair_id.iloc[0])} tests="{len(f)}" failures="{int(bad.sum())}">' + "".join(cases) + "</testsuite>\n"


def _html(f: pd.DataFrame) -> str:
    rows = "".join(f"<tr><td>{escape(r.effective_verdict)}</td><td>{escape(r.kind)}</td><td>{escape(str(r.symbol))}</td><td>{escape(r.old_value)}</td><td>{escape(r.new_value)}</td></tr>" for r in f.itertuples())
    name = escape(f.pair_id.iloc[0])
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{name}</title></head><body><h1>{name}: {escape(f.effective_verdict.iloc[0])}</h1><table><tr><th>verdict</th><th>kind</th><th>symbol</th><th>old</th><th>new</th></tr>{rows}</table></body></html>\n"


def markdown(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    return _documents(found, _markdown, limit)


def junit(found: DataFrame, limit: int | None = None) -> DataFrame:
    return _documents(found, _junit, limit)


def junit_release(found: DataFrame) -> DataFrame:
    """One JUnit document (tests, failures, document) of all pairs, a suite each, in order of pair_id."""
    body = F.trim(F.regexp_replace("document", r"^<\?xml[^>]*>\s*", ""))
    number = lambda k: F.regexp_extract("document", rf'<testsuite name=[^>]*? {k}="(\d+)"', 1).cast("long")
    suites = junit(found).select("pair_id", body.alias("body"), number("tests").alias("tests"), number("failures").alias("failures"))
    whole = suites.agg(F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"), F.array_sort(F.collect_list(F.struct("pair_id", "body"))).alias("_s"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<testsuites tests="'), F.col("tests").cast("string"), F.lit('" failures="'), F.col("failures").cast("string"), F.lit('">\n'))
    return whole.select("tests", "failures", F.concat(head, F.array_join(F.transform("_s", lambda x: x["body"]), "\n"), F.lit("\n</testsuites>\n")).alias("document"))


def html(found: DataFrame, limit: int | None = None) -> DataFrame:
    return _documents(found, _html, limit)


def sarif(found: DataFrame, limit: int | None = None) -> DataFrame:
    """SARIF 2.1.0 documents, built by the JSON functions."""
    level = F.lit("none")
    for verdict, name in SARIF_LEVEL.items():
        level = F.when(F.col("effective_verdict") == verdict, name).otherwise(level)
    message = F.concat_ws("", "kind", F.lit(": "), "symbol", F.when(F.col("old_value").isNotNull() | F.col("new_value").isNotNull(), F.concat(F.lit(" ("), F.coalesce("old_value", F.lit("")), F.lit(" -> "), F.coalesce("new_value", F.lit("")), F.lit(")"))))
    item = F.struct(F.col("kind").alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(F.struct(F.array(F.struct(F.col("symbol").alias("fullyQualifiedName"))).alias("logicalLocations"))).alias("locations"))
    runs = _ordered(found, limit).groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("r")))), lambda x: x["r"]).alias("results"), F.array_sort(F.collect_set(F.struct(F.col("kind").alias("id")))).alias("rules"))
    tool = F.struct(F.struct(F.lit("quillon").alias("name"), F.col("rules").alias("rules")).alias("driver"))
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(tool.alias("tool"), F.col("results").alias("results"))).alias("runs"))
    return runs.select("pair_id", F.to_json(doc).alias("document"))


def json_report(found: DataFrame, limit: int | None = None) -> DataFrame:
    item = F.struct("kind", "symbol", "old_value", "new_value", F.col("effective_verdict").alias("verdict"), "detector")
    out = _ordered(found, limit).groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("r")))), lambda x: x["r"]).alias("changes"), F.max("_all").alias("n_changes"))
    return out.select("pair_id", F.to_json(F.struct("pair_id", "n_changes", (F.size("changes") < F.col("n_changes")).alias("truncated"), "changes")).alias("document"))


def annotations(found: DataFrame, limit: int = 50) -> DataFrame:
    """The worst findings of all pairs as CI annotation lines; the cap is the feature."""
    level = F.when(F.col("effective_verdict").isin("BREAKING", "API_BREAK"), "error").when(F.col("effective_verdict") == "COMPATIBLE_WITH_RISK", "warning").otherwise("notice")
    top = found.filter("disposition = 'active'").orderBy(-rules.rank(F.col("effective_verdict")), "kind", "symbol", "pair_id").limit(limit)
    return top.select(F.concat(F.lit("::"), level, F.lit(" title="), "kind", F.lit("::"), "symbol").alias("line"))


def debian_symbols(exports: DataFrame, package: str, version: str = "#MINVER#") -> DataFrame:
    """Symbols files from exports (library, name, version): one document a library."""
    line = F.concat(F.lit(" "), "name", F.lit("@"), F.coalesce(F.nullif("version", F.lit("")), F.lit("Base")), F.lit(f" {version}"))
    return exports.select("library", line.alias("_l")).distinct().groupBy("library").agg(F.array_sort(F.collect_list("_l")).alias("_ls")).select("library", F.concat("library", F.lit(f" {package} {version}\n"), F.array_join("_ls", "\n"), F.lit("\n")).alias("document"))


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Snapshots as JSON lines, one document a line."""
    snapshots.write.mode("overwrite").json(path)


def suggest_suppressions(found: DataFrame, today: str, days: int = 180) -> DataFrame:
    """Candidate rules, one for each active breaking finding, with an expiry date."""
    live = found.filter("disposition = 'active' and effective_verdict in ('BREAKING', 'API_BREAK')")
    return live.select("symbol", F.col("kind").alias("change_kind"), F.date_add(F.lit(today).cast("date"), days).alias("expires")).distinct()
