"""Queries with oracle SQL on exported surfaces, manifests, flags, rule lists and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import build, diff, rollup, rules
from quillon.plans.catalog import query, table
from quillon.sinks import report


def _part(spark, d, keep="true"):
    return table(spark, d, "part").filter(keep).withColumns({"k": F.col("p_partkey"), "s": F.col("p_partkey").cast("string")})


def _pick(col, *some):
    return F.element_at(F.array(*map(F.lit, some)), (col % len(some) + 1).cast("int"))


API_SQL = """WITH i AS (SELECT p_partkey k, ['Py', '_Py', 'PyUnstable', 'lib'][CAST(p_partkey % 4 + 1 AS INTEGER)] || 'F' || p_size nm FROM part), w AS (SELECT ['Py', '_Py', 'PyUnstable', 'lib'][CAST(p_partkey % 4 + 1 AS INTEGER)] || 'F' || p_size nm, min(2 + p_partkey % 12) m FROM part WHERE p_size % 3 <> 0 AND p_partkey % 5 < 2 GROUP BY 1),
r AS (SELECT k, CASE WHEN NOT starts_with(nm, 'Py') AND NOT starts_with(nm, '_Py') THEN 'not_cpython' WHEN m IS NULL THEN CASE WHEN starts_with(nm, '_Py') OR starts_with(nm, 'PyUnstable') THEN 'private' ELSE 'unknown' END WHEN m > 4 THEN 'above_floor' ELSE 'stable' END status FROM i LEFT JOIN w USING (nm)) """


def _api(spark, d):
    p = _part(spark, d).withColumn("name", F.concat(_pick(F.col("k"), "Py", "_Py", "PyUnstable", "lib"), F.lit("F"), F.col("p_size").cast("string")))
    return p.select("k", "name"), p.filter("p_size % 3 <> 0 and k % 5 < 2").select("name", F.lit(3).alias("major"), (F.col("k") % 12 + 2).alias("minor"))


@query(API_SQL + "SELECT * FROM r")
def stable_abi_status(spark, d):
    return rules.stable_abi(*_api(spark, d), floor=(3, 4)).select("k", "status")


@query(API_SQL + "SELECT * FROM r WHERE status IN ('private', 'above_floor')")
def stable_abi_audit(spark, d):
    return rules.stable_abi_violations(*_api(spark, d), floor=(3, 4)).select("k", "status")


@query("""WITH x AS (SELECT p_partkey k, ['3', '3.' || p_size, '4', '3.9.1', ' 3.12 ', '39'][CAST(p_partkey % 6 + 1 AS INTEGER)] v FROM part), m AS (SELECT k, CASE WHEN trim(v) = '3' THEN 0 WHEN regexp_full_match(trim(v), '3\\.[0-9]+') THEN CAST(split_part(trim(v), '.', 2) AS INTEGER) END m FROM x)
SELECT k, CASE WHEN m <= 25 THEN greatest(m, 2) ELSE -1 END "minor" FROM m""")
def abi3_floors(spark, d):
    z = F.col("p_size").cast("string")
    v = F.element_at(F.array(F.lit("3"), F.concat(F.lit("3."), z), F.lit("4"), F.lit("3.9.1"), F.lit(" 3.12 "), F.lit("39")), (F.col("k") % 6 + 1).cast("int"))
    return _part(spark, d).select("k", F.coalesce(T.abi3_version(v)["minor"], F.lit(-1)).alias("minor"))


SYMBOLS_SQL = """WITH x AS (SELECT p_brand b, ['f', '_init', '_ZTh', '__bss_start', 'std::'][CAST(p_partkey % 5 + 1 AS INTEGER)] || CASE WHEN p_partkey % 5 IN (1, 3) THEN '' ELSE CAST(p_size AS VARCHAR) END nm, ['func', 'object', 'notype'][CAST(p_partkey % 3 + 1 AS INTEGER)] t, p_partkey % 2 s FROM part), e AS (SELECT DISTINCT b, nm, s FROM x WHERE t IN ('func', 'notype') AND starts_with(nm, 'f')) """


def _symbols(spark, d, keep="true"):
    k = F.col("k")
    tail = F.when((k % 5).isin(1, 3), "").otherwise(F.col("p_size").cast("string"))
    return _part(spark, d, keep).select(F.col("p_brand").alias("library"), F.concat(_pick(k, "f", "_init", "_ZTh", "__bss_start", "std::"), tail).alias("name"), _pick(k, "func", "object", "notype").alias("sym_type"))


@query(SYMBOLS_SQL + "SELECT DISTINCT b library, nm AS name FROM e")
def exported_function_names(spark, d):
    return diff.exported_names(_symbols(spark, d), T.FUNCTION_TYPES, relevant_only=True, by=["library"])


@query(SYMBOLS_SQL + "SELECT 'func_removed_elf_only' kind, b library, nm symbol FROM e WHERE s = 0 AND (b, nm) NOT IN (SELECT (b, nm) FROM e WHERE s = 1)")
def export_table_delta(spark, d):
    return diff.export_delta(_symbols(spark, d, "p_partkey % 2 = 0"), _symbols(spark, d, "p_partkey % 2 = 1"), by=["library"])


@query("""WITH x AS (SELECT 's' || l_partkey nm, 'V' || (l_suppkey + l_orderkey % 2) % 7 v, l_orderkey * 10 + l_linenumber o, l_orderkey % 2 side FROM lineitem), y AS (SELECT * FROM x WHERE v <> 'V6'), f AS (SELECT side, v, min(o) at_ FROM y GROUP BY 1, 2),
g AS (SELECT side, nm, arg_min(v, at_ * 10 + CAST(v[2:] AS BIGINT)) v FROM (SELECT DISTINCT side, nm, v FROM y) JOIN f USING (side, v) GROUP BY 1, 2) SELECT 'symbol_moved_version_node' kind, a.nm symbol, a.v old_value, b.v new_value FROM g a JOIN g b ON a.side = 0 AND b.side = 1 AND a.nm = b.nm AND a.v <> b.v""")
def moved_version_nodes(spark, d):
    v = F.concat(F.lit("V"), ((F.col("l_suppkey") + F.col("l_orderkey") % 2) % 7).cast("string"))
    x = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("name"), v.alias("version"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), (F.col("l_orderkey") % 2).alias("side"))
    nodes = spark.createDataFrame([(f"V{i}",) for i in range(6)], "version string")
    return diff.moved_nodes(diff.node_of(x.filter("side = 0"), nodes), diff.node_of(x.filter("side = 1"), nodes))


@query("""WITH o AS (SELECT p_partkey k, 'd' || p_size % 4 r, CASE WHEN p_partkey % 3 <> 0 THEN 'g' || p_size % 3 END g, 'l' || p_size % 2 l FROM part WHERE p_partkey % 11 <> 0), n AS (SELECT p_partkey k, 'd' || (p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 4 r, CASE WHEN p_partkey % 5 <> 0 THEN 'g' || (p_size + p_partkey % 2) % 3 END g, 'l' || (p_size + p_partkey % 3) % 2 l FROM part WHERE p_partkey % 13 <> 0),
b AS (SELECT k, o.r r1, n.r r2, o.g g1, n.g g2, o.l l1, n.l l2 FROM o JOIN n USING (k)) SELECT 'c' || k c_symbol, 'removed' change FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT 'c' || k, 'added' FROM n WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 'c' || k, 'signature' FROM b WHERE r1 <> r2
UNION ALL SELECT 'c' || k, 'ufunc_added' FROM b WHERE g1 IS NULL AND g2 IS NOT NULL UNION ALL SELECT 'c' || k, 'ufunc_signature' FROM b WHERE g1 IS NOT NULL AND g1 <> coalesce(g2, '') UNION ALL SELECT 'c' || k, 'ufunc_loop_symbol' FROM b WHERE g1 IS NOT NULL AND l1 <> CASE WHEN g2 IS NULL THEN '' ELSE l2 END""")
def manifest_diff(spark, d):
    k, z = F.col("k"), F.col("p_size")
    word = lambda w, n: F.concat(F.lit(w), n.cast("string"))

    def side(keep, has, ret, sig, loop):
        return _part(spark, d, keep).select(word("c", k).alias("c_symbol"), word("d", ret % 4).alias("return_dtype"), F.array(F.lit("f8")).alias("params"), F.when(has, F.struct(word("g", sig % 3).alias("signature"), word("l", loop % 2).alias("loop_symbol"))).alias("ufunc"))

    return diff.manifest_changes(side("p_partkey % 11 <> 0", k % 3 != 0, z, z, z), side("p_partkey % 13 <> 0", k % 5 != 0, z + F.when(k % 7 == 0, 1).otherwise(0), z + k % 2, z + k % 3))


@query("""WITH x AS (SELECT p_brand b, 'M' || p_size m, p_partkey o, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 3 AS VARCHAR) END v FROM part) SELECT b target, m macro, coalesce(arg_min(coalesce(v, '(defined)'), o), '') "value", CASE WHEN count(DISTINCT coalesce(v, '(defined)')) > 1 THEN array_to_string(list_sort(list(DISTINCT coalesce(v, '(defined)'))), ',') END conflicts FROM x GROUP BY 1, 2""")
def merged_build_defines(spark, d):
    k = F.col("k")
    x = _part(spark, d).select(F.col("p_brand").alias("target"), F.concat(F.lit("M"), F.col("p_size").cast("string")).alias("macro"), k.alias("ordinal"), F.when(k % 4 != 0, (k % 3).cast("string")).alias("value"))
    out = build.merged_defines(x, by=["target"])
    return out.select("target", "macro", F.coalesce("value", F.lit("(defined)")).alias("value"), F.array_join("conflicts", ",").alias("conflicts"))


@query("""SELECT l_orderkey target, '/i' || l_suppkey AS "path", min(l_linenumber) AS ordinal FROM lineitem GROUP BY 1, 2""")
def merged_search_paths(spark, d):
    return build.merged_paths(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.concat(F.lit("/i"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_linenumber").alias("ordinal")), by=["target"])


@query("""SELECT n_nationkey rule_idx, n_name symbol FROM nation UNION ALL SELECT (SELECT max(n_nationkey) + 1 FROM nation) + r_regionkey, r_name FROM region""")
def merged_rule_lists(spark, d):
    return rules.merged_rules(table(spark, d, "nation").select(F.col("n_nationkey").alias("rule_idx"), F.col("n_name").alias("symbol")), table(spark, d, "region").select(F.col("r_regionkey").alias("rule_idx"), F.col("r_name").alias("symbol")))


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n > 500""")
def evicted_entries(spark, d):
    return rollup.evicted(table(spark, d, "events").select("event_id", "ts"), 500, "event_id", "ts").select("event_id")


@query("""SELECT o_custkey, avg(CASE WHEN o_orderkey % 5 IN (1, 3) THEN 1.0 ELSE 0.0 END) rate FROM orders GROUP BY 1""")
def unresolved_decisions(spark, d):
    names = ("IN_CONTRACT", "UNKNOWN_UNRESOLVED", "NOT_APPLICABLE", "UNKNOWN_UNPROVEN", "PROVEN_OUT_OF_CONTRACT")
    return rollup.unresolved_rate(table(spark, d, "orders").select("o_custkey", _pick(F.col("o_orderkey"), *names).alias("relevance")), by=["o_custkey"])


FOUND_SQL = """WITH f AS (SELECT p_brand b, p_partkey k, ['BREAKING', 'API_BREAK', 'COMPATIBLE_WITH_RISK', 'COMPATIBLE'][CAST(p_partkey % 4 + 1 AS INTEGER)] v, p_partkey % 3 o FROM part WHERE p_size > 10) """


def _found(spark, d):
    k = F.col("k")
    name = F.concat(_pick(k, "_ZTI", "ns::detail::f", "f"), F.col("s"))
    return _part(spark, d, "p_size > 10").select(F.col("p_brand").alias("pair_id"), F.lit("func_removed").alias("kind"), name.alias("symbol"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"), rules.verdict_of((4 - k % 4).cast("int")).alias("effective_verdict"), F.lit("active").alias("disposition"))


@query(FOUND_SQL + "SELECT b pair_id, count(*) total, CAST(count(*) FILTER (o = 0) AS BIGINT) rtti, CAST(count(*) FILTER (o = 1) AS BIGINT) internal, CAST(count(*) FILTER (o = 2) AS BIGINT) public FROM f GROUP BY 1")
def origin_breakdown(spark, d):
    return rollup.surface_breakdown(_found(spark, d))


@query(FOUND_SQL + """, s AS (SELECT p_brand b, count(*) FILTER (p_partkey % 2 = 0) n FROM part GROUP BY 1), c AS (SELECT b, count(*) FILTER (v = 'BREAKING') br, count(*) FILTER (v = 'API_BREAK') sb, count(*) FILTER (v = 'COMPATIBLE_WITH_RISK') rk, count(*) FILTER (v = 'COMPATIBLE') ok, count(*) t FROM f GROUP BY 1)
SELECT s.b pair_id, coalesce(br, 0) breaking, coalesce(sb, 0) source_breaks, coalesce(rk, 0) risk_count, coalesce(ok, 0) compatible_additions, coalesce(t, 0) total_changes, CASE WHEN coalesce(br, 0) = 0 THEN 100.0 WHEN n > 0 THEN greatest(0.0, (n - br) / n * 100) ELSE greatest(0.0, (t - br) / t * 100) END binary_compatibility_pct, CASE WHEN n > 0 THEN least(100.0, coalesce(br, 0) / n * 100) ELSE 0.0 END affected_pct FROM s LEFT JOIN c ON s.b = c.b""")
def report_summaries(spark, d):
    sizes = _part(spark, d).groupBy(F.col("p_brand").alias("pair_id")).agg(F.count_if(F.col("k") % 2 == 0).alias("old_symbols"))
    return rollup.report_summary(_found(spark, d), sizes).drop("old_symbols")


@query(FOUND_SQL + "SELECT CAST(count(*) AS BIGINT) tests, CAST(count(*) FILTER (v IN ('BREAKING', 'API_BREAK')) AS BIGINT) failures, CAST(count(DISTINCT b) AS BIGINT) suites FROM f")
def junit_of_release(spark, d):
    return report.junit_release(_found(spark, d)).select("tests", "failures", (F.size(F.split("document", "<testsuite ")) - 1).cast("long").alias("suites"))


@query("""SELECT p_partkey k, CASE p_partkey % 5 WHEN 0 THEN 'hfa' || (p_size % 4 + 1) WHEN 1 THEN 'hva' || (p_size % 4 + 1) ELSE CASE WHEN p_size > 16 THEN 'indirect' ELSE 'register' END END class FROM part""")
def aggregate_passing(spark, d):
    k, z = F.col("k"), F.col("p_size")
    many = lambda t: F.array_repeat(F.lit(t), (z % 4 + 1).cast("int"))
    members = F.when(k % 5 == 0, many("double")).when(k % 5 == 1, many("float32x4_t")).when(k % 5 == 2, F.array(F.lit("float"), F.lit("double"))).when(k % 5 == 3, F.array_repeat(F.lit("float"), 5)).otherwise(many("int"))
    return _part(spark, d).select("k", T.aggregate_class(z, members).alias("class"))


@query("""SELECT p_partkey k, p_partkey % 6 IN (0, 2, 4) OR (p_partkey % 6 = 1 AND p_size % 2 = 0) foreign_type, p_size % 2 = 1 runtime FROM part""")
def foreign_types(spark, d):
    name = _pick(F.col("k"), "__int128", "std::vector<int>", "ns::(anonymous)::T", "ns::T", "typedef __int128 __int128_t", "typedef int __int128_t")
    runtime = T.cxx_runtime(F.when(F.col("p_size") % 2 == 1, "/usr/lib/libstdc++.so.6").otherwise("libfoo.so.1"))
    return _part(spark, d).select("k", T.non_abi_type(name, ~runtime).alias("foreign_type"), runtime.alias("runtime"))


@query("""SELECT p_partkey k, CASE p_partkey % 3 WHEN 0 THEN 'r' || p_size WHEN 1 THEN 'clang|' || p_size || '||17' ELSE '|' || p_size || '||17' END recipe, 'a' || p_size || '>b:calls:' || CASE WHEN p_partkey % 2 = 0 THEN 'param' ELSE '' END relation, p_partkey % 4 = 0 cv_only FROM part""")
def identity_keys(spark, d):
    k, z = F.col("k"), F.col("p_size").cast("string")
    r = T.relation_key(F.concat(F.lit("a"), z), F.lit("b"), F.lit("calls"), F.when(k % 2 == 0, "param"))
    recipe = T.hash_recipe(F.when(k % 3 == 0, F.concat(F.lit("r"), z)).otherwise(""), F.when(k % 3 == 1, "clang"), z, F.lit(None).cast("string"), F.lit("17"))
    cv = T.signature_cv_only(F.lit("int"), _pick(k, "volatile int", "int", "long", "int *"))
    return _part(spark, d).select("k", recipe.alias("recipe"), F.concat(r["src"], F.lit(">"), r["dst"], F.lit(":"), r["kind"], F.lit(":"), r["role"]).alias("relation"), cv.alias("cv_only"))
