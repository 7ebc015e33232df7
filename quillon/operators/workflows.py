"""Workflows over several artifacts: stacks of libraries, baselines, plans, manifests, symbols files and idioms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import graph, match, rules

#: Strength of a claim about contract relevance; a kind that is not listed has no rank.
STRENGTH = {"OUT_OF_CONTRACT": 0, "UNKNOWN": 1, "LIKELY_IN_CONTRACT": 2, "IN_CONTRACT": 3}


# ---------------------------------------------------------------- stacks


def dependency_edges(libraries: DataFrame, folders: DataFrame) -> DataFrame:
    """src, dst, ordinal of needed libraries: the first folder of the search order that holds the name.

    libraries: path, soname, needed, search (folders in order); folders: folder, name, path.
    """
    want = libraries.select(F.col("path").alias("src"), F.posexplode("needed").alias("ordinal", "name"), "search").select("src", "ordinal", "name", F.posexplode("search").alias("at", "folder"))
    hit = want.join(folders, ["folder", "name"]).groupBy("src", "ordinal").agg(F.min_by("path", "at").alias("dst"))
    asked = want.select("src", "ordinal", "name").distinct()
    return asked.join(hit, ["src", "ordinal"], "left").select("src", "dst", "ordinal", "name")


def loadable(edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row: FAIL if a library or a strong symbol is missing, WARN if a version does not fit, else PASS."""
    lost = edges.agg(F.count_if(F.col("dst").isNull()).alias("lost"))
    state = bindings.agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status").isin("version_mismatch", "visibility_blocked")).alias("doubtful"))
    verdict = F.when((F.col("lost") > 0) | (F.col("missing") > 0), "FAIL").when(F.col("doubtful") > 0, "WARN").otherwise("PASS")
    return lost.crossJoin(state).select(verdict.alias("loadability"))  # one row each


def stack_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Libraries by soname (soname, digest): added, removed or content_changed; an unreadable one counts as changed."""
    both = old.select("soname", F.struct("digest").alias("_o")).join(new.select("soname", F.struct("digest").alias("_n")), "soname", "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o.digest").isNull() | F.col("_n.digest").isNull() | (F.col("_o.digest") != F.col("_n.digest")), "content_changed")
    return both.select("soname", change.alias("change")).filter("change is not null")


def risk_score(loadability: Column, abi: Column) -> Column:
    return F.when((loadability == "FAIL") | (abi == "FAIL"), "high").when(abi == "WARN", "medium").otherwise("low")


def bundle_findings(imports: DataFrame, old_exports: DataFrame, new_exports: DataFrame) -> DataFrame:
    """Symbols that a library of a bundle takes from another (library, symbol): lost, or from another provider."""
    first = lambda df, c: df.groupBy("symbol").agg(F.min("library").alias(c))
    used = imports.select("library", "symbol").distinct().join(first(old_exports, "old_provider"), "symbol").filter("old_provider <> library").join(first(new_exports, "new_provider"), "symbol", "left")
    kind = F.when(F.col("new_provider").isNull(), "bundle_intra_dep_removed").when(F.col("new_provider") != F.col("old_provider"), "bundle_provider_changed")
    return used.withColumn("kind", kind).filter("kind is not null").select("library", "symbol", "kind", "old_provider", "new_provider")


def soname_skew(libraries: DataFrame) -> DataFrame:
    """Cohorts (cohort, library, old_soname, new_soname) where some majors moved and some did not."""
    moved = T.soname_major(F.col("new_soname")) != T.soname_major(F.col("old_soname"))
    return libraries.filter(moved.isNotNull()).groupBy("cohort").agg(F.count_if(moved).alias("bumped"), F.count_if(~moved).alias("kept")).filter("bumped > 0 and kept > 0").withColumn("kind", F.lit("bundle_soname_skew"))


# ---------------------------------------------------------------- baselines and plans


def resolve_baselines(asked: DataFrame, artifacts: DataFrame) -> DataFrame:
    """channel, target, profile with exactly one artifact, or the outcome: RESOLVED, MISSING or AMBIGUOUS."""
    key = ["channel", "target", "profile"]
    have = artifacts.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path"))
    outcome = F.when(F.col("_n").isNull(), "MISSING").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return asked.join(have, key, "left").select(*key, outcome.alias("outcome"), F.when(F.col("_n") == 1, F.col("path")).alias("path"))


def run_plan(targets: DataFrame, profiles: DataFrame, checks: DataFrame) -> DataFrame:
    """Every target under every profile it lists, with every check of the profile: check_id and the parts.

    targets: target, profiles (array); profiles: profile, channel, depth; checks: profile, check.
    """
    grid = targets.select("target", F.explode("profiles").alias("profile")).join(profiles, "profile").join(checks, "profile")
    return grid.select(T.check_id(F.col("target"), F.col("profile"), F.col("channel"), F.col("depth")).alias("check_id"), "target", "profile", "check")


def probe_matrix(configurations: DataFrame, probes: DataFrame) -> DataFrame:
    """Configurations times the probes that name their language; two small tables joined on it."""
    return configurations.join(probes, "language").select("configuration", "probe", "language")


def compare_decisions(original: DataFrame, replayed: DataFrame) -> DataFrame:
    """key and how its relevance moved: agreed, weakened, strengthened, disagreed, only_in_original, only_in_replay."""
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in STRENGTH.items()])
    both = original.select("key", F.col("relevance").alias("_was")).join(replayed.select("key", F.col("relevance").alias("_now")), "key", "full_outer")
    a, b = rank("_was"), rank("_now")
    out = (
        F.when(F.col("_now").isNull(), "only_in_original").when(F.col("_was").isNull(), "only_in_replay").when(F.col("_was") == F.col("_now"), "agreed").when(a.isNull() | b.isNull(), "disagreed").when(b >= a, "strengthened").otherwise("weakened")
    )
    return both.select("key", out.alias("outcome"))


def gated(findings: DataFrame) -> DataFrame:
    """Findings that policy may score: those in the contract, or to which contracts do not apply."""
    return findings.filter(F.col("relevance").isNull() | F.col("relevance").isin("IN_CONTRACT", "NOT_APPLICABLE"))


# ---------------------------------------------------------------- manifests and symbols files


def manifest_missing(promised: DataFrame, exports: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Promised symbols that are not exported."""
    return promised.join(exports.select(symbol).distinct(), symbol, "left_anti")


def validate_symbols(entries: DataFrame, exports: DataFrame) -> DataFrame:
    """side (missing, new), symbol, version_node: a symbols file against exports; optional entries may be absent."""
    key = ["symbol", "version_node"]
    missing = entries.filter(~F.array_contains("tags", "optional")).select(*key).join(exports.select(*key), key, "left_anti").withColumn("side", F.lit("missing"))
    new = exports.select(*key).distinct().join(entries.select(*key), key, "left_anti").withColumn("side", F.lit("new"))
    return missing.unionByName(new).select("side", *key)


def diff_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """change, symbol, version_node of two symbols files; tags are part of an entry's identity."""
    key = ["symbol", "version_node", "tag"]
    side = lambda df, c: df.select("symbol", "version_node", F.array_join("tags", "|").alias("tag"), F.col("min_version").alias(c))
    both = side(old, "_o").join(side(new, "_n"), key, "full_outer")
    change = F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "added").when(F.col("_o") != F.col("_n"), "version_changed")
    return both.select(change.alias("change"), "symbol", "version_node").filter("change is not null")


# ---------------------------------------------------------------- Python surfaces


def python_api_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind, symbol, detail of two stub surfaces (qualname, kind, params), as read_stubs gives them."""
    a, b = (df.select("qualname", F.struct("kind", "params").alias(c)) for df, c in ((old, "_o"), (new, "_n")))
    both = a.join(b, "qualname", "full_outer")
    what = F.coalesce("_o.kind", "_n.kind")
    void = F.lit(None).cast("string")
    whole = both.select(
        F.when(F.col("_n").isNull(), F.concat(F.lit("python_api_"), what, F.lit("_removed"))).when(F.col("_o").isNull(), F.concat(F.lit("python_api_"), what, F.lit("_added"))).when(F.col("_o.kind") != F.col("_n.kind"), "python_api_callable_kind_changed").alias("kind"),
        F.col("qualname").alias("symbol"), void.alias("detail"),
    ).filter("kind is not null")
    flat = lambda s: both.filter("_o is not null and _n is not null").select("qualname", F.posexplode(f"{s}.params").alias("pos", "_p")).select("qualname", F.col("_p.name").alias("name"), F.struct("pos", "_p.kind", "_p.has_default").alias(s))
    p = flat("_o").join(flat("_n"), ["qualname", "name"], "full_outer")
    optional = F.col("_n.has_default") | F.col("_n.kind").startswith("var_")
    kind = (
        F.when(F.col("_n").isNull(), "python_api_parameter_removed").when(F.col("_o").isNull() & ~optional, "python_api_parameter_added").when(F.col("_o.kind") != F.col("_n.kind"), "python_api_parameter_kind_changed")
        .when(F.col("_o.has_default") & ~F.col("_n.has_default"), "python_api_default_removed")
    )
    return whole.unionByName(p.select(kind.alias("kind"), F.col("qualname").alias("symbol"), F.col("name").alias("detail")).filter("kind is not null"))


# ---------------------------------------------------------------- idioms


def idioms(functions: DataFrame, records: DataFrame) -> DataFrame:
    """name, idiom of one snapshot: opaque_pointer, pimpl, factory, create_destroy, callback.

    functions: mangled, name, return_type, params; records: type_key, is_opaque, fields.
    """
    base = lambda c: F.trim(F.regexp_replace(T.without_cv(c), r"[*&\s]+$", ""))
    points = lambda c: T.without_cv(c).rlike(r"\*$")
    used = functions.select(F.explode(F.concat(F.array("return_type"), F.transform(F.coalesce("params", F.array()), lambda x: x["type"]))).alias("t")).select(base(F.col("t")).alias("type_key"), points(F.col("t")).alias("ptr"))
    opaque = records.filter("is_opaque").join(used.groupBy("type_key").agg(F.min("ptr").alias("_all")), "type_key").filter("_all").select(F.col("type_key").alias("name"), F.lit("opaque_pointer").alias("idiom"))
    field = records.filter(F.size("fields") == 1).select("type_key", base(F.col("fields")[0]["type"]).alias("inner"), F.col("fields")[0]["type"].alias("t"))
    pimpl = field.filter(F.col("t").rlike(r"\*|unique_ptr<|shared_ptr<")).join(records.filter("is_opaque").select(F.col("type_key").alias("inner")), "inner", "left").filter(F.col("inner").rlike(r"(?i)(impl|private|_d)\b|(Impl|Private)$")).select(F.col("type_key").alias("name"), F.lit("pimpl").alias("idiom"))
    factory = functions.filter(points(F.col("return_type")) & F.lower("name").rlike(r"(^|[_:])(create|make|new|open|alloc)")).select("name", F.lit("factory").alias("idiom"))
    stem = lambda words: F.regexp_replace(F.lower("name"), words, "%")
    makers = functions.filter(F.lower("name").rlike(r"create|new|open|alloc|init")).select("name", stem("create|new|open|alloc|init").alias("_k"))
    enders = functions.filter(F.lower("name").rlike(r"destroy|delete|close|free|fini")).select(stem("destroy|delete|close|free|fini").alias("_k")).distinct()
    pairs = makers.join(enders, "_k").select("name", F.lit("create_destroy").alias("idiom"))
    callback = functions.filter(F.exists(F.coalesce("params", F.array()), lambda x: x["type"].rlike(r"\(\s*\*|std::function<"))).select("name", F.lit("callback").alias("idiom"))
    return opaque.unionByName(pimpl).unionByName(factory).unionByName(pairs).unionByName(callback).distinct()


def antipatterns(functions: DataFrame, records: DataFrame) -> DataFrame:
    """kind, symbol: public std:: types by value; polymorphic bases without a virtual destructor."""
    types = F.concat(F.array("return_type"), F.transform(F.coalesce("params", F.array()), lambda x: x["type"]))
    by_value = F.exists(types, lambda t: t.rlike(r"\bstd::") & ~t.rlike(r"[*&]\s*$"))
    stl = functions.filter("visibility = 'public'").filter(by_value).select(F.lit("public_api_exposes_stl_by_value").alias("kind"), F.col("mangled").alias("symbol"))
    bases = records.select(F.explode(F.concat(F.coalesce("bases", F.array()), F.coalesce("virtual_bases", F.array()))).alias("type_key")).distinct()
    bare = records.filter((F.size("vtable") > 0) & ~F.exists("vtable", lambda x: F.contains(x, F.lit("~")) | x.rlike(r"D[012]Ev"))).join(bases, "type_key", "left_semi").select(F.lit("polymorphic_type_non_virtual_dtor").alias("kind"), F.col("type_key").alias("symbol"))
    return stl.unionByName(bare)


def modulated(findings: DataFrame, old_idioms: DataFrame, new_idioms: DataFrame) -> DataFrame:
    """Size and field changes of types that are opaque pointers in both versions are demoted; an idiom that broke is reported as such."""
    o, n = (df.filter("idiom = 'opaque_pointer'").select(F.col("name").alias("symbol"), F.lit(True).alias(c)) for df, c in ((old_idioms, "_o"), (new_idioms, "_n")))
    both = findings.join(o, "symbol", "left").join(n, "symbol", "left")
    demote = F.col("_o") & F.col("_n") & F.startswith("kind", F.lit("type_"))
    return both.withColumn("effective_verdict", F.when(demote, "COMPATIBLE").otherwise(F.col("effective_verdict"))).drop("_o", "_n")


def changed_path_impact(includes: DataFrame, uses: DataFrame, changed: DataFrame) -> DataFrame:
    """entry, file: public entries that a changed file reaches.  includes: file, included; uses: entry, file; changed: file."""
    back = includes.select(F.col("included").alias("src"), F.col("file").alias("dst"))
    hit = graph.reach(back, changed.select(F.col("file").alias("root"), F.col("file").alias("node")))
    return uses.join(hit.select(F.col("node").alias("file"), "root"), "file").select("entry", F.col("root").alias("file")).distinct()


def source_targets(sources: DataFrame, objects: DataFrame, links: DataFrame) -> DataFrame:
    """file and its link targets: sources(file, object), objects(object, archive), links(input, target)."""
    direct = sources.select("file", F.col("object").alias("input"))
    through = sources.join(objects, "object").select("file", F.col("archive").alias("input"))
    return direct.unionByName(through).join(links, "input").groupBy("file").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def release_verdict(*parts: DataFrame) -> DataFrame:
    """The worst of several verdict tables."""
    out = parts[0].select("verdict")
    for p in parts[1:]:
        out = out.unionByName(p.select("verdict"))
    return rules.worst_verdict(out)


def overloads_rerouted(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Base names with both removed and added overloads: base, removed, added."""
    base = T.base_name(F.col("name"))
    side = lambda df, c: df.groupBy(base.alias("base")).agg(F.array_sort(F.collect_set("name")).alias(c))
    return side(removed, "removed").join(side(added, "added"), "base")


def template_leaks(old: DataFrame, new: DataFrame, internal: str = r"(^|::)(detail|internal|impl)::") -> DataFrame:
    """Internal function templates whose instantiations differ, one row a stem; tables of name."""
    side = lambda df, c: df.filter(F.col("name").rlike(internal) & F.contains("name", F.lit("<"))).groupBy(T.template_stem(F.col("name")).alias("stem")).agg(F.array_sort(F.collect_set("name")).alias(c))
    return side(old, "old_set").join(side(new, "new_set"), "stem", "full_outer").filter(~F.col("old_set").eqNullSafe(F.col("new_set"))).withColumn("kind", F.lit("internal_template_leaks_via_public_api"))


def mandatory_template_parameter(old: DataFrame, new: DataFrame) -> DataFrame:
    """Templates whose least number of arguments grew; tables of name."""
    side = lambda df, c: df.filter(F.contains("name", F.lit("<"))).groupBy(T.template_stem(F.col("name")).alias("stem")).agg(F.min(T.template_arity(F.col("name"))).alias(c))
    return side(old, "old_arity").join(side(new, "new_arity"), "stem").filter("new_arity > old_arity").withColumn("kind", F.lit("mandatory_template_param_added"))


def fingerprint_renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """Renames of functions known by size and hash only, as findings."""
    return match.rename_match(old, new).select(F.lit("func_likely_renamed").alias("kind"), F.col("old_name").alias("symbol"), F.col("old_name").alias("old_value"), F.col("new_name").alias("new_value"), "confidence")


# ---------------------------------------------------------------- risk, matching of releases


def path_risk(paths: DataFrame, by: Sequence[str], path: Column, weights: Sequence[tuple[Column, int]], other: int) -> DataFrame:
    """by, score and n_paths: each path has the weight of the first condition that holds, a group its greatest."""
    weight = F.lit(other)
    for cond, w in reversed(weights):
        weight = F.when(cond, w).otherwise(weight)
    return paths.groupBy(*by).agg(F.max(weight).alias("score"), F.count(path).alias("n_paths"))


def match_releases(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and state (matched, removed, added) of the libraries of two releases."""
    side = lambda df, c: df.select(key).distinct().withColumn(c, F.lit(True))
    both = side(old, "_o").join(side(new, "_n"), key, "full_outer")
    return both.select(key, F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "added").otherwise("matched").alias("state"))
