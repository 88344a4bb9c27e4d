"""Queries for snapshots, resolution, comparison and merging."""

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import compare, delta, quality, resolve
from factloom.plans.registry import query

# Two snapshots of the documents: Spanish texts arrive, one source goes, French texts change.
SNAPSHOT_CTE = """prev AS (SELECT doc_id, text, source, lang FROM documents WHERE lang <> 'es'),
cur AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' x' ELSE text END AS text, source, lang FROM documents WHERE source <> 'src3'),
dl AS (SELECT doc_id AS path, CASE WHEN p.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'removed'
  WHEN p.text = c.text THEN 'unchanged' ELSE 'changed' END AS status FROM prev p FULL JOIN cur c USING (doc_id))"""


def snapshots(t):
    docs = t.documents.select("doc_id", "text", "lang", "source")
    edited = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    previous = docs.where("lang <> 'es'").select(F.col("doc_id").alias("path"), T.fingerprint(F.col("text")).alias("fingerprint"))
    current = docs.where("source <> 'src3'").select(F.col("doc_id").alias("path"), T.fingerprint(edited).alias("fingerprint"))
    return previous, current


@query("j01_snapshot_delta", f"WITH {SNAPSHOT_CTE} SELECT path, status FROM dl")
def _(t):
    return delta.snapshot_delta(*snapshots(t)).select("path", "status")


@query("j02_boundary_violations", f"""
WITH {SNAPSHOT_CTE} SELECT path, CASE status WHEN 'changed' THEN 'modified' WHEN 'new' THEN 'created' ELSE 'removed' END AS violation
FROM dl WHERE status <> 'unchanged' AND path NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    return delta.boundary_violations(delta.snapshot_delta(*snapshots(t)), t.labels.select(F.col("doc_id").alias("path")))


@query("s11_registry_upsert", """
WITH b AS (SELECT source AS context, doc_id AS path, text, 1 AS version FROM documents
  UNION ALL SELECT source, doc_id, text || ' x', 2 FROM documents WHERE lang = 'fr'),
r AS (SELECT *, row_number() OVER (PARTITION BY context, path ORDER BY version DESC) AS rn FROM b)
SELECT context, path, sha256(text) AS fingerprint, version FROM r WHERE rn = 1""")
def _(t):
    def entries(version, text):
        return F.col("source").alias("context"), F.col("doc_id").alias("path"), F.sha2(text, 256).alias("fingerprint"), F.lit(version).alias("version")

    first = t.documents.select(*entries(1, F.col("text")))
    second = t.documents.where("lang = 'fr'").select(*entries(2, F.concat("text", F.lit(" x"))))
    return delta.upsert(first, second, ["context", "path"], "version")


@query("s12_registry_reads", """
SELECT source AS context, count(*) AS entries, min(doc_id) AS first_path, max(doc_id) AS last_path FROM documents GROUP BY source""")
def _(t):
    from factloom.sources import registry

    entries = t.documents.select(F.col("source").alias("context"), F.col("doc_id").alias("path"))
    return registry.contexts(entries)


@query("s12_all_entries", "SELECT source AS context, doc_id AS path, lang AS language FROM documents")
def _(t):
    from factloom.sources import registry

    return registry.all_entries(t.documents.select(F.col("source").alias("context"), F.col("doc_id").alias("path"), F.col("lang").alias("language")))


@query("s12_context_names", "SELECT DISTINCT source AS context FROM documents")
def _(t):
    from factloom.sources import registry

    return registry.context_names(t.documents.select(F.col("source").alias("context")))


@query("s12_entries_for_context", "SELECT doc_id AS path, lang AS language FROM documents WHERE source = 'src7'")
def _(t):
    from factloom.sources import registry

    entries = t.documents.select(F.col("source").alias("context"), F.col("doc_id").alias("path"), F.col("lang").alias("language"))
    return registry.entries_for_context(entries, "src7").select("path", "language")


@query("g07_incremental_recompute", f"""
WITH {SNAPSHOT_CTE}, e AS (SELECT doc_id, sha256(text) AS fp, length(text) AS n FROM prev)
SELECT c.doc_id AS key, length(c.text) AS n_chars, coalesce(e.fp = sha256(c.text), false) AS reused FROM cur c LEFT JOIN e USING (doc_id)""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("key"), "text", "lang", "source")

    def fingerprinted(df):
        return df.select("key", T.fingerprint(F.col("text")).alias("fingerprint"), "text")

    def measure(df):
        return df.select("key", "fingerprint", F.length("text").cast("long").alias("n_chars"))

    edited = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    cached = measure(fingerprinted(docs.where("lang <> 'es'")))
    current = fingerprinted(docs.where("source <> 'src3'").withColumn("text", edited))
    return delta.incremental(cached, current, measure).select("key", "n_chars", "reused")


# One nation and the indebted customers of a segment have changed, and pending orders are new.
CHANGED_SQL = """changed AS (SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal < 0) OR c_nationkey = 7)"""


@query("g07_recomputed_dependents", f"""
WITH {CHANGED_SQL}
SELECT 'n' || n_nationkey AS key, length('r' || n_regionkey) AS n_chars, n_nationkey <> 7 AS reused FROM nation
UNION ALL SELECT 'c' || c_custkey, length('n' || c_nationkey || c_mktsegment), c_custkey NOT IN (FROM changed) FROM customer
UNION ALL SELECT 'o' || o_orderkey, length('c' || o_custkey || o_orderstatus), o_orderstatus <> 'P' AND o_custkey NOT IN (FROM changed) FROM orders""")
def _(t):
    def named(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    nations = t.nation.select(named("n", "n_nationkey").alias("key"), named("r", "n_regionkey").alias("fingerprint"), (F.col("n_nationkey") == 7).alias("edited"))
    customers = t.customer.select(
        named("c", "c_custkey").alias("key"), F.concat(named("n", "c_nationkey"), F.col("c_mktsegment")).alias("fingerprint"),
        ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0)).alias("edited"),
    )
    orders = t.orders.select(
        named("o", "o_orderkey").alias("key"), F.concat(named("c", "o_custkey"), F.col("o_orderstatus")).alias("fingerprint"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("edited"),
    )
    entries = nations.unionByName(customers).unionByName(orders)
    needs = t.customer.select(named("c", "c_custkey").alias("node"), named("n", "c_nationkey").alias("requires")).unionByName(
        t.orders.select(named("o", "o_orderkey").alias("node"), named("c", "o_custkey").alias("requires"))
    )

    def measure(df):
        return df.select("key", "fingerprint", F.length("fingerprint").alias("n_chars"))

    before = entries.where("edited IS NOT NULL").withColumn("fingerprint", F.when(F.col("edited"), F.concat("fingerprint", F.lit("!"))).otherwise(F.col("fingerprint")))
    return delta.incremental(measure(before), entries.select("key", "fingerprint"), measure, needs).select("key", "n_chars", "reused")


NAMES_CTE = """used AS (SELECT DISTINCT l_orderkey AS path, l_partkey AS name FROM lineitem WHERE l_returnflag = 'N'),
defined AS (SELECT DISTINCT l_orderkey AS path, l_partkey AS name FROM lineitem WHERE l_returnflag = 'R'),
imported AS (SELECT DISTINCT l_orderkey AS path, l_partkey AS name FROM lineitem WHERE l_returnflag = 'A'),
builtins AS (SELECT p_partkey AS name FROM part WHERE p_size <= 5),
missing AS (SELECT path, name FROM used u WHERE NOT EXISTS (FROM defined d WHERE d.path = u.path AND d.name = u.name)
  AND NOT EXISTS (FROM imported i WHERE i.path = u.path AND i.name = u.name) AND name NOT IN (FROM builtins))"""


def _missing(t):
    names = t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("name"), "l_returnflag")
    builtins = t.part.where("p_size <= 5").select(F.col("p_partkey").alias("name"))
    role = {flag: names.where(F.col("l_returnflag") == flag) for flag in "NRA"}
    return resolve.unresolved_names(role["N"], role["R"], role["A"], builtins)


@query("j03_unresolved_names", f"WITH {NAMES_CTE} SELECT path, name FROM missing")
def _(t):
    return _missing(t)


@query("j04_resolved_names", f"""
WITH {NAMES_CTE}, idx AS (SELECT name, min(path) AS target FROM defined GROUP BY name)
SELECT path, name, target FROM missing JOIN idx USING (name) WHERE path <> target""")
def _(t):
    defined = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("name"))
    return resolve.resolve_missing(_missing(t), resolve.symbol_index(defined))


@query("j05_dead_imports", """
SELECT c_nationkey AS path, c_custkey AS name FROM customer
WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def _(t):
    imports = t.customer.select(
        F.col("c_nationkey").alias("path"), F.col("c_custkey").alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("structural")
    )
    placed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("name")).distinct()
    uses = placed.join(imports.select("path", "name"), "name")
    dynamic = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("path"))
    return resolve.dead_imports(imports, uses, dynamic)


@query("j06_external_roots", r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, host FROM h WHERE split_part(host, '.', 1) NOT IN ('m', 'blog', 'www')""")
def _(t):
    hosts = t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))
    return hosts.where(resolve.is_external(F.col("host"), ["m", "blog", "www"]))


MODULES_CTE = """f AS (SELECT DISTINCT lower(p_type) || '/' || replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '.py' ELSE '/__init__.py' END AS path
  FROM part WHERE p_brand <> 'Brand#1'),
i AS (SELECT DISTINCT lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '.py' AS path,
  CASE WHEN p_size > 10 THEN '.' || replace(p_name, ' ', '_') ELSE lower(p_type) || '.' || replace(p_name, ' ', '_') END AS module,
  lower(p_type) || '/' || replace(p_name, ' ', '_') AS stem FROM part),
r AS (SELECT i.path, i.module, coalesce(a.path, b.path) AS resolved FROM i LEFT JOIN f a ON a.path = stem || '.py' LEFT JOIN f b ON b.path = stem || '/__init__.py')"""


def _resolved(t):
    stem = F.concat_ws("/", F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("_")))
    suffix = F.when(F.col("p_size") > 25, F.lit(".py")).otherwise(F.lit("/__init__.py"))
    files = t.part.where("p_brand <> 'Brand#1'").select(F.concat(stem, suffix).alias("path"))
    leaf = F.replace("p_name", F.lit(" "), F.lit("_"))
    imports = t.part.select(
        F.concat(F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".py")).alias("path"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("."), leaf)).otherwise(F.concat(F.lower("p_type"), F.lit("."), leaf)).alias("module"),
    )
    return resolve.resolve_imports(imports, files)


@query("j07_resolved_imports", f"WITH {MODULES_CTE} SELECT path, module, resolved FROM r")
def _(t):
    return _resolved(t)


@query("g06_import_adjacency", f"""
WITH {MODULES_CTE} SELECT path, array_to_string(list_sort(list_distinct(list(resolved))), ' ') AS requires FROM r WHERE resolved IS NOT NULL GROUP BY path""")
def _(t):
    return resolve.adjacency(_resolved(t)).select("path", F.array_join("requires", " ").alias("requires"))


@query("j08_reference_edges", """
WITH v AS (SELECT event_type AS domain, 'u' || user_id AS symbol FROM events GROUP BY 1, 2 HAVING max(value) > 50),
m AS (SELECT DISTINCT event_id AS id, event_type AS domain, unnest(['u' || user_id, 'k' || json_extract_string(props, '$.k')]) AS symbol FROM events)
SELECT id, domain || '::' || symbol AS target, symbol FROM m JOIN v USING (domain, symbol)""")
def _(t):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    variables = (
        t.events.groupBy(F.col("event_type").alias("domain"), user.alias("symbol")).agg(F.max("value").alias("highest")).where("highest > 50")
        .withColumn("id", F.concat_ws("::", "domain", "symbol"))
    )
    items = t.events.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("domain"),
        F.array(user, F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("variables"),
    )
    return resolve.reference_edges(items, variables).withColumn("id", F.col("id").cast("long"))


@query("j09_shared_symbols", r"""
WITH w AS (SELECT DISTINCT lang AS domain, unnest(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS symbol FROM documents)
SELECT a.symbol, a.domain AS src_domain, b.domain AS dst_domain FROM w a JOIN w b ON a.symbol = b.symbol AND a.domain <> b.domain""")
def _(t):
    words = t.documents.select(F.col("lang").alias("domain"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("symbol"))
    return resolve.shared_symbol_edges(words)


@query("j10_declared_links", """
SELECT o_orderkey AS src, o_custkey AS dst, EXISTS (FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)
  AND EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey) AS accepted FROM orders""")
def _(t):
    links = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    rich = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("node"))
    filled = t.lineitem.select(F.col("l_orderkey").alias("node")).distinct()
    return resolve.declared_links(links, filled, rich)


@query("j11_contained_phrases", """
SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def _(t):
    phrases = t.benchmark.select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    found = resolve.contained_phrases(t.documents.select("doc_id", "text"), phrases)
    return found.withColumnRenamed("phrase_id", "item_id")


@query("j11_cross_language_edges", """
SELECT e.event_id AS src, p.p_partkey AS dst, CASE WHEN p_type = 'ECONOMY' THEN 'pyo3_ffi_bridge' ELSE 'c_abi_bridge' END AS edge_type, 'f' || p.p_partkey AS ffi_function
FROM events e JOIN part p ON contains(event_type || '(f' || json_extract_string(props, '$.k') || ')', 'f' || p.p_partkey)
  OR contains(event_type || '(f' || json_extract_string(props, '$.k') || ')', p_name)""")
def _(t):
    calls = t.events.select(
        F.col("event_id").alias("node"),
        F.concat("event_type", F.lit("(f"), F.get_json_object("props", "$.k"), F.lit(")")).alias("text"),
    )
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    bindings = t.part.select(
        name.alias("name"), F.col("p_partkey").alias("target"),
        F.when(F.col("p_type") == "ECONOMY", "pyo3_function").otherwise("c_abi").alias("type"),
        F.array(name, F.col("p_name")).alias("names"),
    )
    return resolve.cross_language_edges(calls, bindings)


@query("j12_kernel_edges", """
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS src, 'k' || s_suppkey AS dst, 'supplier' || s_suppkey AS kernel
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey OR l_partkey = s_suppkey""")
def _(t):
    calls = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"),
        F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("supplier"), F.col("l_partkey").cast("string"), F.lit(" <<<1, 2>>>(x)")).alias("text"),
    )
    kernels = t.supplier.select(
        F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("node"),
    )
    return resolve.kernel_edges(calls, kernels)


@query("j13_def_use_edges", """
WITH d AS (SELECT user_id, arg_max(event_id, ts) AS src FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id AS name, src, event_id AS dst FROM events JOIN d USING (user_id) WHERE event_type <> 'signup'""")
def _(t):
    nodes = t.events.select(F.col("user_id").alias("name"), F.col("event_id").alias("node"), "ts", "event_type")
    return resolve.def_use_edges(nodes.where("event_type = 'signup'"), nodes.where("event_type <> 'signup'"), "ts").select("name", "src", "dst")


DIFF_CTE = """o AS (SELECT o_orderkey AS label, round(o_totalprice, 0) AS v, o_orderstatus <> 'P' AS ok FROM orders),
n AS (SELECT l_orderkey AS label, round(sum(l_quantity), 0) AS v, count(*) > 1 AS ok FROM lineitem GROUP BY 1),
x AS (SELECT coalesce(o.label, n.label) AS label, coalesce(o.ok, false) AS ook, coalesce(n.ok, false) AS nok,
  o.v > 100000 AS oh, n.v > 100 AS nh, CASE WHEN NOT o.ok THEN 'pending' END AS oe, CASE WHEN NOT n.ok THEN 'pending' END AS ne FROM o FULL JOIN n ON o.label = n.label),
y AS (SELECT *, CASE WHEN NOT ook AND NOT nok THEN oe IS NOT DISTINCT FROM ne WHEN ook AND nok THEN oh IS NOT DISTINCT FROM nh ELSE false END AS match FROM x)"""


def _differential(t):
    def run(label, ok, value):
        error = F.when(~ok, F.lit("pending"))
        return F.col(label).alias("label"), ok.alias("succeeded"), F.sha2(value.cast("string"), 256).alias("result_hash"), error.alias("error")

    legacy = t.orders.select(*run("o_orderkey", F.col("o_orderstatus") != "P", F.round("o_totalprice", 0) > 100000))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    candidate = lines.select(*run("l_orderkey", F.col("n") > 1, F.round("q", 0) > 100))
    return compare.differential(legacy, candidate)


@query("j15_differential", f"""
WITH {DIFF_CTE} SELECT label, match, CASE WHEN match THEN NULL WHEN NOT ook AND NOT nok THEN 'different errors' WHEN ook AND nok THEN 'hash mismatch'
  WHEN ook THEN 'candidate failed' ELSE 'legacy failed' END AS detail FROM y""")
def _(t):
    return _differential(t)


@query("j15_differential_report", f"""
WITH {DIFF_CTE} SELECT count(*) AS total, count(*) FILTER (match) AS passed, count(*) FILTER (NOT match) AS failed, bool_and(match) AS accepted FROM y""")
def _(t):
    return compare.differential_report(_differential(t))


@query("j16_positional_error", """
WITH a AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT r.vec_id, round(max(abs(p.x - r.x) / CASE WHEN abs(r.x) > 1e-30 THEN abs(r.x) ELSE 1.0 END), 4) AS max_error
FROM a r JOIN a p ON p.vec_id = r.vec_id + 1 AND p.i = r.i GROUP BY r.vec_id""")
def _(t):
    vectors = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("reference"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("reference").alias("produced"))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round(compare.max_relative_error(F.col("reference"), F.col("produced")), 4).alias("max_error")
    )


@query("j17_three_way_merge", """
WITH b AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_brand <> 'Brand#4'),
l AS (SELECT p_partkey AS k, CASE WHEN p_type = 'ECONOMY' THEN p_retailprice + 1 ELSE p_retailprice END AS v FROM part WHERE p_brand <> 'Brand#2'),
r AS (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN p_retailprice + 2 WHEN p_size > 30 AND p_type = 'ECONOMY' THEN p_retailprice + 1 ELSE p_retailprice END AS v FROM part WHERE p_brand <> 'Brand#3'),
j AS (SELECT coalesce(b.k, l.k, r.k) AS part, b.k IS NOT NULL AS hb, l.k IS NOT NULL AS hl, r.k IS NOT NULL AS hr, b.v AS b, l.v AS l, r.v AS r
  FROM b FULL JOIN l ON b.k = l.k FULL JOIN r ON coalesce(b.k, l.k) = r.k),
d AS (SELECT *, CASE WHEN hb AND hl AND hr AND l = b AND r = b THEN 'unchanged' WHEN hb AND hl AND hr AND r = b THEN 'left' WHEN hb AND hl AND hr AND l = b THEN 'right'
  WHEN hb AND hl AND hr AND l = r THEN 'same_edit' WHEN hb AND hl AND hr THEN 'concurrent_edit' WHEN hb AND hl THEN CASE WHEN l = b THEN 'deleted' ELSE 'modify_delete' END
  WHEN hb AND hr THEN CASE WHEN r = b THEN 'deleted' ELSE 'delete_modify' END WHEN hl AND hr THEN CASE WHEN l = r THEN 'same_add' ELSE 'add_add' END
  WHEN hl THEN 'left_add' WHEN hr THEN 'right_add' ELSE 'deleted' END AS decision FROM j)
SELECT part, decision, CASE WHEN decision IN ('left', 'modify_delete', 'same_edit', 'same_add', 'left_add', 'unchanged') THEN l WHEN decision <> 'deleted' THEN r END AS kept,
  decision IN ('concurrent_edit', 'modify_delete', 'delete_modify', 'add_add') AS conflict FROM d""")
def _(t):
    part = t.part.withColumnRenamed("p_partkey", "part")
    price = F.col("p_retailprice")
    left = F.when(F.col("p_type") == "ECONOMY", price + 1).otherwise(price)
    right = F.when(F.col("p_size") > 40, price + 2).when((F.col("p_size") > 30) & (F.col("p_type") == "ECONOMY"), price + 1).otherwise(price)

    def version(dropped, value):
        return part.where(F.col("p_brand") != dropped).select("part", value.alias("value"))

    return compare.three_way_merge(version("Brand#4", price), version("Brand#2", left), version("Brand#3", right), ["part"], "value")


TRIPLES_CTE = """ln AS (SELECT l_orderkey AS parent, l_partkey, l_linenumber, l_returnflag || l_linestatus AS fs, l_returnflag AS rf, l_linestatus AS ls FROM lineitem),
s AS (SELECT 'b' AS side, parent, l_linenumber AS o, l_partkey AS o2, rf AS v FROM ln UNION ALL SELECT 'l', parent, l_linenumber, l_partkey, rf FROM ln WHERE ls = 'F'
  UNION ALL SELECT 'r', parent, l_linenumber, l_partkey, CASE WHEN l_partkey > 1000 THEN lower(rf) ELSE rf END FROM ln),
q AS (SELECT side, parent, coalesce(lag(v) OVER w, '⊢') AS prev, v AS next, lead(v) OVER w IS NULL AS last FROM s WINDOW w AS (PARTITION BY side, parent ORDER BY o, o2, v)),
tr AS (SELECT DISTINCT side, parent, prev, next FROM q UNION SELECT side, parent, next, '⊣' FROM q WHERE last),
nl AS (SELECT parent, prev, next FROM tr WHERE side = 'l' EXCEPT SELECT parent, prev, next FROM tr WHERE side = 'b'),
nr AS (SELECT parent, prev, next FROM tr WHERE side = 'r' EXCEPT SELECT parent, prev, next FROM tr WHERE side = 'b')"""


def _triples(t):
    line = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus",
        F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("pos"),
    )
    lowered = F.when(F.col("l_partkey") > 1000, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))

    def triples(df, value):
        return compare.successor_triples(df.withColumn("v", value), "l_orderkey", "pos", "v")

    flag = F.col("l_returnflag")
    return triples(line, flag), triples(line.where("l_linestatus = 'F'"), flag), triples(line, lowered)


@query("j18_successor_conflicts", f"""
WITH {TRIPLES_CTE} SELECT DISTINCT nr.parent, nr.prev, nr.next FROM nr JOIN nl ON nr.parent = nl.parent AND nr.prev = nl.prev AND nr.next <> nl.next""")
def _(t):
    return compare.successor_conflicts(*_triples(t))


@query("o04_one_sided_triples", f"WITH {TRIPLES_CTE} SELECT parent, prev, next FROM nl")
def _(t):
    base, left, _right = _triples(t)
    return left.subtract(base)


DRIFT_CTE = """c AS (SELECT event_type AS p, avg(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1 HAVING event_type <> 'view'),
b AS (SELECT event_type AS p, avg(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1 HAVING event_type <> 'error'),
d AS (SELECT coalesce(c.p, b.p) AS parameter, coalesce(c.v, 0.0) AS cur, coalesce(b.v, 0.0) AS base FROM c FULL JOIN b ON c.p = b.p),
r AS (SELECT *, abs(cur - base) / CASE WHEN abs(base) > 1e-9 THEN abs(base) ELSE 1.0 END AS drift FROM d)"""


def _drift(t):
    half = F.lit("2024-01-16").cast("timestamp")
    events = t.events.select(F.col("event_type").alias("parameter"), "ts", "value")
    current = events.where((F.col("ts") >= half) & (F.col("parameter") != "view"))
    past = events.where((F.col("ts") < half) & (F.col("parameter") != "error"))
    mean = F.avg("value").alias("value")
    return compare.parameter_drift(current.groupBy("parameter").agg(mean), past.groupBy("parameter").agg(mean))


@query("j19_parameter_drift", f"""
WITH {DRIFT_CTE} SELECT parameter, round(cur, 6) AS current, round(base, 6) AS baseline, round(drift, 6) AS drift FROM r""")
def _(t):
    return _drift(t).select("parameter", *[F.round(c, 6).alias(c) for c in ("current", "baseline", "drift")])


@query("j19_drift_report", f"""
WITH {DRIFT_CTE} SELECT count(*) FILTER (drift > 0.3) AS drifted_count, round(avg(drift), 6) AS average_drift, count(*) FILTER (drift > 0.3) > 0 AS drift_exceeded FROM r""")
def _(t):
    return compare.drift_report(_drift(t))


@query("j20_duplicate_names", """
SELECT p_name, count(*) AS uses, min(p_partkey) AS first_use FROM part GROUP BY p_name HAVING count(*) > 1""")
def _(t):
    return quality.duplicate_names(t.part, "p_name", "p_partkey")


@query("j20_shared_ownership", """
SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, min(l_suppkey) AS first_owner FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""")
def _(t):
    return quality.shared_ownership(t.lineitem, "l_partkey", "l_suppkey")


@query("j20_unknown_references", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def _(t):
    rich = t.customer.where("c_acctbal >= 0")
    return quality.unknown_references(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", rich, "c_custkey")


@query("j21_binding_boundaries", """
WITH g AS (SELECT DISTINCT p_type || '/' || p_brand AS project, p_name AS name,
  CASE WHEN p_name LIKE 'red%' THEN 'cpp' WHEN p_name LIKE 'blue%' THEN 'rust' WHEN p_name LIKE 'small%' THEN 'c' ELSE 'python' END AS language FROM part)
SELECT b.project, b.name AS consumer, b.language AS consumer_language, c.name AS provider, c.language AS provider_language,
  CASE WHEN b.language <> 'python' THEN 'cffi' WHEN c.language = 'cpp' THEN 'pybind11' WHEN c.language = 'c' THEN 'ctypes' WHEN c.language = 'rust' THEN 'pyo3' ELSE 'cffi' END AS mechanism
FROM g b JOIN g c USING (project) WHERE b.name LIKE '%g%' AND c.name NOT LIKE '%g%'""")
def _(t):
    name = F.col("name")
    language = F.when(name.startswith("red"), "cpp").when(name.startswith("blue"), "rust").when(name.startswith("small"), "c").otherwise("python")
    targets = (
        t.part.select(F.concat_ws("/", "p_type", "p_brand").alias("project"), F.col("p_name").alias("name"))
        .distinct()
        .withColumns({"language": language, "role": F.when(name.contains("g"), "binding").otherwise("core")})
    )
    return quality.binding_boundaries(targets)


@query("j22_dependency_attribution", """
SELECT l_orderkey * 10 + l_linenumber AS id, 'p' || l_partkey AS target,
  CASE WHEN l_returnflag = 'N' THEN 'Integer' ELSE 'supp_' || l_suppkey || '::T' END AS receiver,
  'supp' || CASE WHEN l_returnflag = 'N' THEN '-' || p_size ELSE CASE WHEN l_suppkey = p_size THEN '-' ELSE '_' END || l_suppkey END AS crate,
  CASE WHEN l_returnflag = 'N' OR l_suppkey = p_size THEN p_retailprice::VARCHAR END AS declared_version,
  CASE WHEN s_suppkey IS NOT NULL THEN '1.' || s_nationkey END AS resolved_version
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = CASE WHEN l_returnflag = 'N' THEN p_size ELSE l_suppkey END""")
def _(t):
    s = lambda c: F.col(c).cast("string")
    errors = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("p"), s("l_partkey")).alias("target"),
        F.when(F.col("l_returnflag") == "N", "&mut Integer<'a>").otherwise(F.concat(F.lit("&supp_"), s("l_suppkey"), F.lit("::T"))).alias("receiver"),
    )
    deps = t.part.select(
        F.concat(F.lit("p"), s("p_partkey")).alias("target"), F.concat(F.lit("supp-"), s("p_size")).alias("crate"), s("p_retailprice").alias("version")
    )
    locked = t.supplier.select(F.concat(F.lit("supp-"), s("s_suppkey")).alias("crate"), F.concat(F.lit("1."), s("s_nationkey")).alias("version"))
    return resolve.attribute_to_dependency(errors, deps, locked)


@query("j23_external_calls", """
SELECT l_orderkey AS path, 'f' || l_linenumber AS function, 'a' || l_suppkey || '.run' AS call, 's' || s_nationkey AS module
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0""")
def _(t):
    lines = t.lineitem  # suppliers in debt are modules of the house
    alias = F.concat(F.lit("a"), F.col("l_suppkey").cast("string"))
    calls = lines.select(
        F.col("l_orderkey").alias("path"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("function"),
        alias.alias("root"), F.concat(alias, F.lit(".run")).alias("call"),
    )
    known = t.supplier.select(
        F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("module"), "s_acctbal"
    )
    aliases = lines.join(known, "l_suppkey").select(F.col("l_orderkey").alias("path"), alias.alias("alias"), "module", "s_acctbal").distinct()
    return resolve.external_calls(calls, aliases.where("s_acctbal > 0"), aliases.where("s_acctbal > 0"))


@query("j24_partition_names", """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'held' ELSE 'passed' END AS decision FROM documents""")
def _(t):
    return resolve.partition_names(t.documents.select("doc_id"), t.labels.where("toxic = 1"), "doc_id")


@query("j25_parameter_recycling", r"""
WITH p AS (SELECT conv_id, turn, array_to_string(list_sort(regexp_extract_all(text, '"[^"]*"|\b\d+\b')), '|') AS fp FROM conversations)
SELECT a.conv_id, a.turn, a.fp = b.fp AS recycled FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def _(t):
    turns = t.conversations.select("conv_id", "turn", T.parameter_fingerprint(F.col("text")).alias("fingerprint"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("fingerprint").alias("previous"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("fingerprint") == F.col("previous")).alias("recycled"))
