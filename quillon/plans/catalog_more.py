"""More queries with oracle SQL: binaries, builds, stacks, names and whole comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import build, detectors, detectors_more, graph, workflows
from quillon.plans import compare
from quillon.plans.catalog import query, table
from quillon.sources import schemas

KABI_SQL = """WITH o AS (SELECT 'k' || p_partkey s, CAST(p_size AS VARCHAR) crc, CASE WHEN p_partkey % 5 = 0 THEN 'EXPORT_SYMBOL_GPL' ELSE 'EXPORT_SYMBOL' END e, CASE WHEN p_partkey % 6 = 0 THEN 'NS' ELSE '' END ns FROM part WHERE p_partkey % 7 <> 0),
n AS (SELECT 'k' || p_partkey s, CAST(p_size + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR) crc, CASE WHEN p_partkey % 4 = 0 THEN 'EXPORT_SYMBOL_GPL' ELSE 'EXPORT_SYMBOL' END e, CASE WHEN p_partkey % 8 = 0 THEN 'NS2' ELSE '' END ns FROM part WHERE p_partkey % 11 <> 0)
"""


@query(KABI_SQL + """SELECT 'kabi_symbol_removed' kind, s symbol FROM o WHERE s NOT IN (SELECT s FROM n) UNION ALL SELECT 'kabi_symbol_added', s FROM n WHERE s NOT IN (SELECT s FROM o)
UNION ALL SELECT 'kabi_crc_changed', s FROM o JOIN n USING (s) WHERE o.crc <> n.crc UNION ALL SELECT 'kabi_export_type_changed', s FROM o JOIN n USING (s) WHERE n.e = 'EXPORT_SYMBOL_GPL' AND o.e = 'EXPORT_SYMBOL'
UNION ALL SELECT 'kabi_symbol_namespace_changed', s FROM o JOIN n USING (s) WHERE o.ns <> n.ns AND n.ns <> ''""")
def kabi_diff(spark, d):
    k = F.col("p_partkey")
    side = lambda keep, crc, gpl, ns, name: table(spark, d, "part").filter(keep).select(F.concat(F.lit("k"), k.cast("string")).alias("symbol"), crc.cast("string").alias("crc"), F.lit("vmlinux").alias("module"), F.when(k % gpl == 0, "EXPORT_SYMBOL_GPL").otherwise("EXPORT_SYMBOL").alias("export_type"), F.when(k % ns == 0, name).otherwise("").alias("namespace"))
    old = side("p_partkey % 7 <> 0", F.col("p_size"), 5, 6, "NS")
    new = side("p_partkey % 11 <> 0", F.col("p_size") + F.when(k % 9 == 0, 1).otherwise(0), 4, 8, "NS2")
    return detectors.kabi_diff(old, new).select("kind", "symbol")


@query("""WITH m AS (SELECT p_brand macro, p_type v, 'u' || p_partkey % 3 tu FROM part), x AS (SELECT macro, v, string_agg(DISTINCT tu, '+' ORDER BY tu) units FROM m GROUP BY 1, 2) SELECT macro || '_ABI' macro, string_agg(v || '=' || units, ',' ORDER BY v) AS "values" FROM x GROUP BY 1 HAVING count(*) > 1""")
def macro_divergence(spark, d):
    m = table(spark, d, "part").select(F.concat("p_brand", F.lit("_ABI")).alias("macro"), F.col("p_type").alias("value"), F.concat(F.lit("u"), (F.col("p_partkey") % 3).cast("string")).alias("tu"))
    pairs = F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+")))
    return build.macro_divergence(m).select("macro", F.array_join(pairs, ",").alias("values"))


@query("""WITH t AS (SELECT 'T' || p_partkey % 300 nm, CAST(p_size % 6 AS VARCHAR) h, p_partkey % 5 = 0 old FROM part), c AS (SELECT nm, count(DISTINCT h) n FROM t WHERE NOT old GROUP BY 1 HAVING count(DISTINCT h) > 1) SELECT nm qualified_name, n FROM c WHERE nm NOT IN (SELECT nm FROM t WHERE old GROUP BY 1 HAVING count(DISTINCT h) > 1)""")
def odr_new_conflicts(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.lit("type").alias("kind"), F.concat(F.lit("T"), (F.col("p_partkey") % 300).cast("string")).alias("qualified_name"), F.lit("/src/h.h").alias("header"), (F.col("p_size") % 6).cast("string").alias("type_hash"))
    return build.new_odr_conflicts(t.filter("p_partkey % 5 = 0"), t.filter("p_partkey % 5 <> 0")).select("qualified_name", F.col("n_values").cast("long").alias("n"))


@query("""WITH o AS (SELECT 'opt' || p_size k, list_sort(list(DISTINCT p_brand)) v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), n AS (SELECT 'opt' || p_size k, list_sort(list(DISTINCT p_brand)) v FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT coalesce(o.k, n.k) AS "key", coalesce(array_to_string(o.v, ','), '') old_values, coalesce(array_to_string(n.v, ','), '') new_values FROM o FULL JOIN n ON o.k = n.k WHERE o.v IS DISTINCT FROM n.v""")
def build_option_changes(spark, d):
    side = lambda r: table(spark, d, "part").filter(f"p_partkey % 2 = {r}").select(F.concat(F.lit("opt"), F.col("p_size").cast("string")).alias("key"), F.col("p_brand").alias("value"), F.lit(True).alias("abi_relevant"))
    return build.option_changes(side(0), side(1)).select("key", F.array_join("old_values", ",").alias("old_values"), F.array_join("new_values", ",").alias("new_values"))


@query("""WITH a AS (SELECT s_nationkey t, count(*) n, min(s_name) p FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1) SELECT n_name target, CASE WHEN a.n IS NULL THEN 'MISSING' WHEN a.n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END outcome, CASE WHEN a.n = 1 THEN p END "path" FROM nation LEFT JOIN a ON n_nationkey = t""")
def baseline_resolution(spark, d):
    n = table(spark, d, "nation").select(F.lit("main").alias("channel"), F.col("n_name").alias("target"), F.lit("p").alias("profile"), "n_nationkey")
    s = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("path"))
    return workflows.resolve_baselines(n.drop("n_nationkey"), n.join(s, "n_nationkey").drop("n_nationkey")).select("target", "outcome", "path")


@query("""WITH o AS (SELECT o_orderkey k, o_orderkey % 5 r FROM orders WHERE o_orderkey % 13 <> 0), n AS (SELECT o_orderkey k, o_orderkey % 7 % 5 r FROM orders WHERE o_orderkey % 17 <> 0)
SELECT coalesce(o.k, n.k) AS "key", CASE WHEN n.k IS NULL THEN 'only_in_original' WHEN o.k IS NULL THEN 'only_in_replay' WHEN o.r = n.r THEN 'agreed' WHEN o.r = 4 OR n.r = 4 THEN 'disagreed' WHEN n.r >= o.r THEN 'strengthened' ELSE 'weakened' END outcome FROM o FULL JOIN n ON o.k = n.k""")
def decision_comparison(spark, d):
    names = F.array(*map(F.lit, ["OUT_OF_CONTRACT", "UNKNOWN", "LIKELY_IN_CONTRACT", "IN_CONTRACT", "NOT_APPLICABLE"]))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    side = lambda keep, r: o.filter(keep).select("key", F.element_at(names, (r + 1).cast("int")).alias("relevance"))
    return workflows.compare_decisions(side("key % 13 <> 0", F.col("key") % 5), side("key % 17 <> 0", F.col("key") % 7 % 5))


@query("""WITH o AS (SELECT s_name nm, s_nationkey g FROM supplier WHERE s_suppkey % 6 <> 0), n AS (SELECT s_name nm, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_nationkey END g FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT coalesce(o.nm, n.nm) soname, CASE WHEN o.nm IS NULL THEN 'added' WHEN n.nm IS NULL THEN 'removed' ELSE 'content_changed' END change FROM o FULL JOIN n ON o.nm = n.nm WHERE o.nm IS NULL OR n.nm IS NULL OR n.g IS NULL OR o.g <> n.g""")
def stack_changes(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    old = s.filter(k % 6 != 0).select(F.col("s_name").alias("soname"), F.col("s_nationkey").alias("digest"))
    new = s.filter(k % 7 != 0).select(F.col("s_name").alias("soname"), F.when(k % 5 == 0, F.col("s_nationkey") + 1).when(k % 11 != 0, F.col("s_nationkey")).alias("digest"))
    return workflows.stack_changes(old, new)


@query("""WITH l AS (SELECT p_brand cohort, p_partkey % 4 = 0 moved FROM part) SELECT cohort, CAST(count(*) FILTER (moved) AS BIGINT) bumped, CAST(count(*) FILTER (NOT moved) AS BIGINT) kept FROM l GROUP BY 1 HAVING count(*) FILTER (moved) > 0 AND count(*) FILTER (NOT moved) > 0""")
def soname_skew(spark, d):
    name = lambda major: F.concat(F.lit("lib"), F.col("p_partkey").cast("string"), F.lit(".so."), major.cast("string"))
    libs = table(spark, d, "part").select(F.col("p_brand").alias("cohort"), F.col("p_name").alias("library"), name(F.lit(1)).alias("old_soname"), name(F.when(F.col("p_partkey") % 4 == 0, 2).otherwise(1)).alias("new_soname"))
    return workflows.soname_skew(libs).select("cohort", "bumped", "kept")


@query("""WITH u AS (SELECT DISTINCT 'c' || l_orderkey % 20 lib, 's' || (l_partkey * 10 + l_linenumber) s FROM lineitem), o AS (SELECT 's' || (l_partkey * 10 + l_linenumber) s, min('p' || l_suppkey % 9) p FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT 's' || (l_partkey * 10 + l_linenumber) s, min('p' || l_suppkey % 9) p FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1)
SELECT lib library, u.s symbol, CASE WHEN n.p IS NULL THEN 'bundle_intra_dep_removed' ELSE 'bundle_provider_changed' END kind FROM u JOIN o ON u.s = o.s LEFT JOIN n ON n.s = u.s WHERE n.p IS NULL OR n.p <> o.p""")
def bundle_findings(spark, d):
    l = table(spark, d, "lineitem")
    s = F.concat(F.lit("s"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("string")).alias("symbol")
    exp = lambda keep: l.filter(keep).select(F.concat(F.lit("p"), (F.col("l_suppkey") % 9).cast("string")).alias("library"), s)
    used = l.select(F.concat(F.lit("c"), (F.col("l_orderkey") % 20).cast("string")).alias("library"), s)
    return workflows.bundle_findings(used, exp("l_orderkey % 2 = 0"), exp("l_orderkey % 2 = 1")).select("library", "symbol", "kind")


@query("""SELECT n_name || '@' || r_name || '#main@l' || n_nationkey % 3 check_id, n_name target FROM nation JOIN region ON n_regionkey = r_regionkey""")
def run_plan(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    targets = n.select(F.col("n_name").alias("target"), F.array(F.concat("r_name", F.lit("/"), "n_name")).alias("profiles"))
    profiles = n.select(F.concat("r_name", F.lit("/"), "n_name").alias("profile"), F.lit("main").alias("channel"), F.concat(F.lit("l"), (F.col("n_nationkey") % 3).cast("string")).alias("depth"))
    plan = workflows.run_plan(targets, profiles, profiles.select("profile", F.lit("abi").alias("check")))
    return plan.select(F.regexp_replace("check_id", r"/[^#]*#", "#").alias("check_id"), "target")


@query("""WITH o AS (SELECT 'f' || p_partkey s, 'V' || p_size % 4 v, CAST(p_size % 9 AS VARCHAR) m FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT 'f' || p_partkey s, 'V' || (p_size + CASE WHEN p_partkey % 12 = 0 THEN 1 ELSE 0 END) % 4 v, CAST(p_size % 8 AS VARCHAR) m FROM part WHERE p_partkey % 6 <> 0)
SELECT CASE WHEN n.s IS NULL THEN 'removed' WHEN o.s IS NULL THEN 'added' ELSE 'version_changed' END change, coalesce(o.s, n.s) symbol, coalesce(o.v, n.v) version_node FROM o FULL JOIN n ON o.s = n.s AND o.v = n.v WHERE o.s IS NULL OR n.s IS NULL OR o.m <> n.m""")
def symbols_file_diff(spark, d):
    k = F.col("p_partkey")
    side = lambda keep, size, m: table(spark, d, "part").filter(keep).select(F.concat(F.lit("f"), k.cast("string")).alias("symbol"), F.concat(F.lit("V"), (size % 4).cast("string")).alias("version_node"), F.array().cast("array<string>").alias("tags"), (F.col("p_size") % m).cast("string").alias("min_version"))
    return workflows.diff_symbols(side("p_partkey % 5 <> 0", F.col("p_size"), 9), side("p_partkey % 6 <> 0", F.col("p_size") + F.when(k % 12 == 0, 1).otherwise(0), 8))


@query("""SELECT p_partkey k, 'ns::T::f' || p_partkey stem, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END arity, 'f' || p_partkey base, 3 AS segments, 'T' || p_size || ' const *' canon FROM part""")
def name_functions(spark, d):
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    name = F.concat(F.lit("ns::T<A<"), z, F.lit(", B::C> "), F.when(F.col("p_size") % 2 == 0, ", (1, 2)").otherwise(""), F.lit(">::f"), k)
    spelled = F.concat(F.lit("const  struct T"), z, F.lit("*"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.template_stem(name).alias("stem"), T.template_arity(name).alias("arity"), T.base_name(name).alias("base"), F.size(T.namespace_segments(name)).alias("segments"), T.canonical_type(spelled).alias("canon"))


@query("""SELECT p_partkey k, CASE WHEN p_partkey % 3 = 0 THEN 'lib' || p_partkey || '.so' ELSE 'lib' || p_partkey || '-' || lpad(CAST(p_size AS VARCHAR), 6, '0') || '.so' END lib, p_size % 9 AS major FROM part""")
def library_keys(spark, d):
    k, z = F.col("p_partkey").cast("string"), F.lpad(F.col("p_size").cast("string"), 6, "0")
    tail = F.concat(F.lit(".so."), (F.col("p_size") % 9).cast("string"))
    name = F.concat(F.lit("LIB"), k, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-ab"), z)).otherwise(F.concat(F.lit("-"), z)), tail)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.library_key(name).alias("lib"), T.soname_major(F.lower(name)).alias("major"))


@query(r"""SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(text, '(/home/|/Users/)[^/\s]+', '\1<user>', 'g'), '(?i)\b((?:api[_-]?key|token|secret|password)\s*[=:]\s*)\S+', '\1<redacted>', 'g')) digest FROM conversations""")
def redacted_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(T.redact(F.col("text")), 256).alias("digest"))


@query("""WITH e AS (SELECT DISTINCT o_custkey % 50 src, o_orderkey % 40 dst FROM orders) SELECT src node, count(DISTINCT dst) n FROM e GROUP BY 1""")
def fan_out(spark, d):
    return graph.fan_out(table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("src"), (F.col("o_orderkey") % 40).alias("dst")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey % 13 f, (n_nationkey * 5 + 2) % 13 i FROM nation), r(root, node) AS (SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 3 UNION SELECT root, f FROM r JOIN e ON node = i) SELECT DISTINCT 'api' || node entry, root file FROM r""")
def changed_path_impact(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    inc = n.select((F.col("k") % 13).alias("file"), ((F.col("k") * 5 + 2) % 13).alias("included"))
    return workflows.changed_path_impact(inc, n.select(F.concat(F.lit("api"), F.col("k").cast("string")).alias("entry"), F.col("k").alias("file")), n.filter("k < 3").select(F.col("k").alias("file")))


def _catalogue(spark, d):
    """Snapshots made of parts: a library per brand, a function per part; two versions."""
    k = F.col("p_partkey")
    flag = lambda c: F.lit(False).alias(c)

    def fn(ret, noexcept):
        return F.struct(
            F.concat(F.lit("_Z1f"), k.cast("string")).alias("mangled"), F.concat(F.lit("f"), k.cast("string")).alias("name"), ret.alias("return_type"), F.array(F.struct(F.lit("a").alias("name"), F.lit("int").alias("type"))).alias("params"), F.lit("public").alias("visibility"), F.lit("public").alias("access"),
            noexcept.alias("is_noexcept"), *map(flag, ("is_virtual", "is_extern_c", "is_static", "is_const", "is_volatile", "is_pure_virtual", "is_deleted", "is_inline")),
            *(F.lit(None).cast("boolean").alias(c) for c in ("is_explicit", "is_variadic")), *(F.lit(None).cast("string").alias(c) for c in ("ref_qualifier", "elf_visibility", "exception_spec", "deprecated", "origin")),
        )

    def side(tag, keep, ret, noexcept):
        rows = table(spark, d, "part").filter(keep).groupBy(F.col("p_brand").alias("library")).agg(F.collect_list(fn(ret, noexcept)).alias("functions"))
        return rows.select(F.concat(F.lit(tag), "library").alias("snapshot_id"), "library", F.lit(False).alias("elf_only_mode"), "functions")

    old = side("old-", "p_partkey % 13 <> 0", F.lit("int"), F.lit(False))
    new = side("new-", "p_partkey % 17 <> 0", F.when(k % 11 == 0, "const int*").otherwise("int"), k % 7 == 0)
    docs = old.unionByName(new)
    return docs, old.select(F.col("library").alias("pair_id"), F.col("snapshot_id").alias("old_id"), F.concat(F.lit("new-"), "library").alias("new_id"))


@query("""WITH p AS (SELECT p_brand b, p_partkey k, p_partkey % 13 <> 0 o, p_partkey % 17 <> 0 n FROM part) SELECT b pair_id, kind, count(*) n FROM (SELECT b, 'func_removed' kind FROM p WHERE o AND NOT n UNION ALL SELECT b, 'func_added' FROM p WHERE n AND NOT o
UNION ALL SELECT b, 'func_return_changed' FROM p WHERE o AND n AND k % 11 = 0 UNION ALL SELECT b, 'func_noexcept_added' FROM p WHERE o AND n AND k % 7 = 0) GROUP BY 1, 2""")
def snapshot_compare(spark, d):
    docs, pairs = _catalogue(spark, d)
    return detectors.functions(detectors.Pair(docs, pairs)).groupBy("pair_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _numbers(spark, d):
    """A pair a customer: two headers whose attributes follow from its key."""
    k = F.col("c_custkey")
    word = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    names = lambda *some: F.filter(F.array(*(F.when(c, w) for c, w in some)), lambda x: x.isNotNull())

    def head(s):
        m = lambda n, off=0: (k + s * off) % n == 0
        return table(spark, d, "customer").select(
            k.cast("string").alias("pair_id"), word(m(31, 1), "EM_ARM", "EM_X86_64").alias("machine"), word(m(29, 1), 32, 64).alias("elf_class"), word(m(37, 1), "ELFDATA2MSB", "ELFDATA2LSB").alias("ei_data"), word(m(7, 1), "ELFOSABI_FREEBSD", word(m(5, 1), "ELFOSABI_GNU", "ELFOSABI_SYSV")).alias("osabi"),
            F.array().cast("array<string>").alias("abi_flags"), word(m(41, 1), 2, 1).cast("long").alias("e_flags"), names((m(3, s), "IBT"), (m(4, 1), "SHSTK"), (m(6, 1), "x86-64-v3"), (m(10, 1), "x86-64-v2")).alias("gnu_properties"),
            names((m(8, 1), "NODELETE"), (m(9, 1), "NOW")).alias("dynamic_flags"), m(11, 1).alias("has_init"), F.lit(None).cast("boolean").alias("has_fini"), names((F.lit(True), "gnu"), (m(12, 1), "sysv")).alias("hash_styles"), m(13, 1).alias("has_dt_relr"), m(14, 1).alias("has_stack_canary"), m(15, 1).alias("has_fortify_source"),
            m(16, 1).alias("has_writable_executable_segment"), m(17, 1).alias("is_symbolic"), F.concat(F.lit("2.6."), ((k + s * 3) % 40).cast("string")).alias("min_kernel"),
        )

    return head(0), head(1)


@query("""WITH h AS (SELECT c_custkey k, s, (c_custkey + s) % 31 = 0 arm, (c_custkey + s) % 29 = 0 c32, (c_custkey + s) % 37 = 0 big, (c_custkey + s) % 7 = 0 bsd, (c_custkey + s) % 41 = 0 ef, (c_custkey + s * s) % 3 = 0 ibt, (c_custkey + s) % 4 = 0 shstk, CASE WHEN (c_custkey + s) % 6 = 0 THEN 3 WHEN (c_custkey + s) % 10 = 0 THEN 2 ELSE 1 END isa,
(c_custkey + s) % 8 = 0 nodelete, (c_custkey + s) % 9 = 0 nw, (c_custkey + s) % 11 = 0 init, (c_custkey + s) % 12 = 0 sysv, (c_custkey + s) % 13 = 0 relr, (c_custkey + s) % 14 = 0 canary, (c_custkey + s) % 15 = 0 fort, (c_custkey + s) % 16 = 0 wx, (c_custkey + s) % 17 = 0 sym, (c_custkey + s * 3) % 40 kern FROM customer, (SELECT unnest([0, 1]) s)),
p AS (SELECT a.k, a.arm = b.arm same, struct_pack(a := a, b := b) x FROM h a JOIN h b ON a.k = b.k AND a.s = 0 AND b.s = 1), q AS (SELECT k, same, x.a a, x.b b FROM p)
SELECT CAST(k AS VARCHAR) pair_id, unnest(list_filter([CASE WHEN NOT same THEN 'elf_machine_changed' END, CASE WHEN same AND a.c32 <> b.c32 THEN 'elf_class_changed' END, CASE WHEN same AND a.big <> b.big THEN 'elf_endianness_changed' END, CASE WHEN same AND a.ef <> b.ef AND NOT a.arm THEN 'elf_abi_flags_changed' END,
CASE WHEN same AND a.bsd <> b.bsd THEN 'elf_osabi_changed' END, CASE WHEN a.nodelete <> b.nodelete OR a.nw <> b.nw THEN 'dynamic_loading_flags_changed' END, CASE WHEN a.init <> b.init THEN 'elf_init_fini_changed' END, CASE WHEN b.relr AND NOT a.relr THEN 'dt_relr_introduced' WHEN a.relr AND NOT b.relr THEN 'dt_relr_removed' END,
CASE WHEN a.sysv AND NOT b.sysv THEN 'hash_style_removed' END, CASE WHEN a.sym <> b.sym THEN 'symbolic_binding_mode_changed' END, CASE WHEN b.kern > a.kern THEN 'os_deployment_floor_raised' END, CASE WHEN a.canary AND NOT b.canary THEN 'stack_canary_removed' END, CASE WHEN a.fort AND NOT b.fort THEN 'fortify_source_weakened' END,
CASE WHEN b.wx AND NOT a.wx THEN 'writable_executable_segment' END, CASE WHEN same AND b.isa > a.isa THEN 'x86_isa_baseline_raised' END,
CASE WHEN same AND ((a.ibt AND NOT b.ibt) OR (a.shstk AND NOT b.shstk)) THEN 'cet_protection_weakened' WHEN same AND (a.ibt <> b.ibt OR a.shstk <> b.shstk) THEN 'cet_protection_improved' END], lambda v: v IS NOT NULL)) kind FROM q""")
def elf_header_contract(spark, d):
    return detectors_more.header_changes(*_numbers(spark, d)).select("pair_id", "kind")


@query("""WITH x AS (SELECT c_custkey k, s, CASE WHEN c_custkey % 6 = 0 THEN 'libc' END origin, CASE WHEN (c_custkey + s) % 5 = 0 THEN 'unique' ELSE 'global' END b, CASE WHEN c_custkey % 4 = 0 THEN 'object' ELSE 'func' END t, (c_custkey * (1 + s)) % 7 * 8 al, CASE WHEN c_custkey % 9 = 0 THEN (c_custkey * (1 + s)) % 3 END de FROM customer, (SELECT unnest([0, 1]) s) WHERE c_custkey % (11 + s * 2) <> 0),
o AS (SELECT * FROM x WHERE s = 0), n AS (SELECT * FROM x WHERE s = 1)
SELECT '_ZN3Foo1b' || o.k || 'Ev' symbol, 'symbol_leaked_from_dependency_changed' kind FROM o LEFT JOIN n USING (k) WHERE n.k IS NULL AND o.origin IS NOT NULL UNION ALL SELECT '_ZN3Foo1b' || n.k || 'Ev', 'symbol_leaked_from_dependency_changed' FROM n LEFT JOIN o USING (k) WHERE o.k IS NULL AND n.origin IS NOT NULL
UNION ALL SELECT '_ZN3Foo1b' || n.k || 'Ev', 'symbol_binding_became_unique' FROM n LEFT JOIN o USING (k) WHERE o.k IS NULL AND n.b = 'unique'
UNION ALL SELECT '_ZN3Foo1b' || o.k || 'Ev', 'exported_object_alignment_reduced' FROM o JOIN n USING (k) WHERE n.t = 'object' AND o.al > 0 AND n.al > 0 AND n.al < o.al AND NOT coalesce(n.de >= o.de, false)""")
def elf_symbol_contract(spark, d):
    k = F.col("c_custkey")

    def side(s):
        return table(spark, d, "customer").filter(k % (11 + s * 2) != 0).select(
            F.lit("0").alias("pair_id"), F.concat(F.lit("_ZN3Foo1b"), k.cast("string"), F.lit("Ev")).alias("name"), F.when(k % 6 == 0, "libc").alias("origin_lib"), F.when((k + s) % 5 == 0, "unique").otherwise("global").alias("binding"),
            F.when(k % 4 == 0, "object").otherwise("func").alias("sym_type"), ((k * (1 + s)) % 7 * 8).cast("int").alias("value_alignment"), F.when(k % 9 == 0, ((k * (1 + s)) % 3).cast("int")).alias("_declared"),
        )

    return detectors_more.symbol_changes(side(0), side(1)).select("symbol", "kind")


@query("""WITH t AS (SELECT p_brand b, ['time_t', 'off_t', 'ino_t', 'size_t'][CAST(p_partkey % 4 + 1 AS INTEGER)] nm, p_partkey k FROM part), o AS (SELECT b, nm, max(CASE WHEN k % 3 = 0 THEN 'long' ELSE 'int' END) v FROM t WHERE k % 2 = 0 OR k % 3 = 0 GROUP BY 1, 2), n AS (SELECT b, nm, max(CASE WHEN k % 5 = 0 THEN 'unsigned long long' ELSE 'long int' END) v FROM t WHERE k % 7 <> 0 GROUP BY 1, 2)
SELECT b pair_id, nm AS name, o.v old_value, n.v new_value FROM o JOIN n USING (b, nm) WHERE nm <> 'size_t' AND (CASE o.v WHEN 'long' THEN 32 ELSE 32 END) <> (CASE n.v WHEN 'long int' THEN 32 ELSE 64 END)""")
def time64_typedefs(spark, d):
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(F.col("p_brand").alias("pair_id"), F.element_at(F.array(*map(F.lit, ["time_t", "off_t", "ino_t", "size_t"])), (k % 4 + 1).cast("int")).alias("name"), k.alias("k"), F.lit(True).alias("bits32"))
    side = lambda keep, v: t.filter(keep).groupBy("pair_id", "name", "bits32").agg(F.max(v).alias("target"))
    return detectors_more.resized_typedefs(side("k % 2 = 0 or k % 3 = 0", F.when(F.col("k") % 3 == 0, "long").otherwise("int")), side("k % 7 <> 0", F.when(F.col("k") % 5 == 0, "unsigned long long").otherwise("long int"))).drop("bits")


@query("""WITH x AS (SELECT p_brand b, CASE WHEN p_partkey % 3 = 0 THEN 'n::' || p_size || '_tag' WHEN p_partkey % 3 = 1 THEN 'n::TagId' ELSE 'n::v' || p_size END nm, p_partkey k FROM part), o AS (SELECT b, nm, min(CAST(k AS VARCHAR)) v FROM x WHERE k % 2 = 0 GROUP BY 1, 2), n AS (SELECT b, nm, min(CAST(k AS VARCHAR)) v FROM x GROUP BY 1, 2)
SELECT b pair_id, nm symbol, o.v old_value, n.v new_value FROM o JOIN n USING (b, nm) WHERE (ends_with(nm, '_tag') OR nm = 'n::TagId') AND o.v <> n.v""")
def serialization_tag_changes(spark, d):
    k = F.col("p_partkey")
    z = F.col("p_size").cast("string")
    x = table(spark, d, "part").select(F.col("p_brand").alias("pair_id"), F.when(k % 3 == 0, F.concat(F.lit("n::"), z, F.lit("_tag"))).when(k % 3 == 1, "n::TagId").otherwise(F.concat(F.lit("n::v"), z)).alias("name"), k.alias("k"), k.cast("string").alias("value"))
    return detectors_more.tag_changes(x.filter("k % 2 = 0"), x).select("pair_id", "symbol", "old_value", "new_value")


@query("""WITH x AS (SELECT p_brand b, 'n::f' || p_size nm, p_partkey % 2 = 0 fn, p_partkey % 5 s FROM part), o AS (SELECT b, nm, bool_or(fn) f, bool_or(NOT fn) v FROM x WHERE s < 2 GROUP BY 1, 2), n AS (SELECT b, nm, bool_or(fn) f, bool_or(NOT fn) v FROM x WHERE s >= 2 GROUP BY 1, 2)
SELECT b pair_id, nm symbol, CASE WHEN o.f THEN 'function' ELSE 'variable' END old_value FROM o JOIN n USING (b, nm) WHERE (o.f AND NOT o.v AND n.v AND NOT n.f) OR (o.v AND NOT o.f AND n.f AND NOT n.v)""")
def cpo_kind_flips(spark, d):
    x = table(spark, d, "part").select(F.col("p_brand").alias("pair_id"), F.concat(F.lit("n::f"), F.col("p_size").cast("string")).alias("name"), (F.col("p_partkey") % 2 == 0).alias("is_function"), (F.col("p_partkey") % 5).alias("s"))
    return detectors_more.kind_flips(x.filter("s < 2"), x.filter("s >= 2")).select("pair_id", "symbol", "old_value")


@query("""WITH r AS (SELECT o_custkey b, 'GLIBC_2.' || (o_orderkey % 40) tag, o_orderkey % 40 m FROM orders), f AS (SELECT b, max(m) m FROM r GROUP BY 1) SELECT CAST(b AS VARCHAR) pair_id, 'GLIBC_2.' || m symbol FROM f WHERE m > 17""")
def platform_floor(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("pair_id"), F.concat(F.lit("GLIBC_2."), (F.col("o_orderkey") % 40).cast("string")).alias("tag"))
    return detectors_more.floor_breaches(r, spark.createDataFrame([("GLIBC", "2.17")], "prefix string, floor string")).select("pair_id", "symbol")


@query("""WITH r AS (SELECT s_suppkey k, ['$ORIGIN/../lib', '/opt/lib', '', '$ORIGIN:/usr/lib'][CAST(s_suppkey % 4 + 1 AS INTEGER)] rp, ['', '/x', '$ORIGIN'][CAST(s_suppkey % 3 + 1 AS INTEGER)] ru FROM supplier), e AS (SELECT DISTINCT k, unnest(string_split(rp || ':' || ru, ':')) v FROM r) SELECT CAST(k AS VARCHAR) pair_id, v symbol FROM e WHERE v <> '' AND NOT starts_with(v, '$ORIGIN')""")
def wheel_search_paths(spark, d):
    k = F.col("s_suppkey")
    pick = lambda n, *some: F.element_at(F.array(*map(F.lit, some)), (k % n + 1).cast("int"))
    s = table(spark, d, "supplier").select(k.cast("string").alias("pair_id"), pick(4, "$ORIGIN/../lib", "/opt/lib", "", "$ORIGIN:/usr/lib").alias("rpath"), pick(3, "", "/x", "$ORIGIN").alias("runpath"))
    return detectors_more.wheel_paths(s).select("pair_id", "symbol")


@query("""WITH x AS (SELECT p_partkey k, '_ZN3FooB5cxx113bar' || p_partkey || 'Ev' a, '_ZN3Foo3bar' || p_partkey || 'Ev' b, p_partkey % 3 c FROM part) SELECT k, CASE WHEN c = 0 THEN a ELSE b END mangled, b base FROM x""")
def abi_tag_bases(spark, d):
    k = F.col("p_partkey").cast("string")
    m = F.concat(F.when(F.col("p_partkey") % 3 == 0, "_ZN3FooB5cxx113bar").otherwise("_ZN3Foo3bar"), k, F.lit("Ev"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), m.alias("mangled"), F.regexp_replace(m, detectors.ABI_TAG, "").alias("base"))


@query("""WITH p AS (SELECT p_brand b, p_partkey k, p_partkey % 13 <> 0 o, p_partkey % 17 <> 0 n FROM part), m AS (SELECT b, count(*) FILTER (o) x, count(*) FILTER (n) y FROM p GROUP BY 1),
f AS (SELECT b, k, 'func_removed' kind FROM p WHERE o AND NOT n UNION ALL SELECT b, k, 'func_added' FROM p WHERE n AND NOT o UNION ALL SELECT b, k, 'func_return_changed' FROM p WHERE o AND n AND k % 11 = 0 UNION ALL SELECT b, k, 'func_noexcept_added' FROM p WHERE o AND n AND k % 7 = 0
UNION ALL SELECT b, -1, 'public_surface_grew' FROM m WHERE y > x UNION ALL SELECT b, -1, 'public_surface_shrank' FROM m WHERE y < x)
SELECT b pair_id, kind, CASE WHEN kind = 'func_removed' AND k % 5 = 0 THEN 'suppressed' WHEN kind = 'func_noexcept_added' THEN 'suppressed' ELSE 'active' END disposition, CASE WHEN kind IN ('func_removed', 'func_return_changed') THEN 'BREAKING' ELSE 'COMPATIBLE' END effective_verdict, count(*) n FROM f GROUP BY ALL""")
def compare_whole(spark, d):
    """All detectors and steps, with a narrow rule, a broad one that may not hide a public break, and one by kind."""
    docs, pairs = _catalogue(spark, d)
    whole = docs.select(F.from_json(F.to_json(F.struct(*docs.columns)), schemas.SNAPSHOT).alias("s")).select("s.*")
    rules = spark.createDataFrame([(0, r"_Z1f\d*[05]", "func_removed"), (1, None, "func_return_changed"), (2, None, "func_noexcept_added")], "rule_idx int, symbol_pattern string, change_kind string").withColumn("expires", F.lit(None).cast("date"))
    out = compare.compare(whole, pairs, suppressions=rules)
    return out.findings.groupBy("pair_id", "kind", "disposition", "effective_verdict").agg(F.count(F.lit(1)).alias("n"))
