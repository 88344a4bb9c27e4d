"""Queries for graphs, roll-ups, set operations, streams' batch forms and user extractors."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.functions import text as T
from factloom.operators import graph, rollups, stages
from factloom.plans.registry import query
from factloom.session import cut_lineage
from factloom.streaming import cycles


def _s(column):
    return F.col(column).cast("string")


DEPS_SQL = """deps AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS requires FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'c' || c_custkey, 'missing' FROM customer WHERE c_acctbal <= 0
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT DISTINCT 'l' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey FROM lineitem)"""


def _deps(t):
    def edge(df, a, ka, b, kb):
        return df.select(F.concat(F.lit(a), _s(ka)).alias("node"), F.concat(F.lit(b), _s(kb)).alias("requires"))

    poor = t.customer.where("c_acctbal <= 0").select(F.concat(F.lit("c"), _s("c_custkey")).alias("node"), F.lit("missing").alias("requires"))
    lines = t.lineitem.select(F.concat(F.lit("l"), _s("l_orderkey"), F.lit("."), _s("l_linenumber")).alias("node"), F.concat(F.lit("o"), _s("l_orderkey")).alias("requires"))
    deps = edge(t.nation, "n", "n_nationkey", "r", "n_regionkey")
    for more in (edge(t.customer.where("c_acctbal > 0"), "c", "c_custkey", "n", "c_nationkey"), poor, edge(t.orders, "o", "o_orderkey", "c", "o_custkey"), lines.distinct()):
        deps = deps.unionByName(more)
    return deps


def _nodes(t, deps):
    regions = t.region.select(F.concat(F.lit("r"), _s("r_regionkey")).alias("node"))
    return deps.select("node").unionByName(regions).distinct()


LEVEL_SQL = f"""WITH RECURSIVE {DEPS_SQL}, lv AS (SELECT 'r' || r_regionkey AS node, 0 AS level FROM region
  UNION ALL SELECT deps.node, level + 1 FROM lv JOIN deps ON deps.requires = lv.node),
ns AS (SELECT node FROM deps UNION SELECT 'r' || r_regionkey FROM region)"""


@query("g01_levels", f"{LEVEL_SQL} SELECT coalesce(level, -1) AS level, count(*) AS nodes FROM ns LEFT JOIN lv USING (node) GROUP BY 1")
def _(t):
    deps = _deps(t)
    levelled = graph.levels(_nodes(t, deps), deps)
    return levelled.groupBy(F.coalesce("level", F.lit(-1)).alias("level")).agg(F.count(F.lit(1)).alias("nodes"))


@query("g02_topological_order", f"{LEVEL_SQL} SELECT node, coalesce(level, -1) AS level, level IS NULL AS cyclic FROM ns LEFT JOIN lv USING (node)")
def _(t):
    deps = _deps(t)
    return graph.topological_order(graph.levels(_nodes(t, deps), deps)).withColumn("level", F.coalesce("level", F.lit(-1)))


EDGE_SQL = """e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM (SELECT DISTINCT c_nationkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey)
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _nation_edges(t):
    big = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.join(big, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@query("g03_cycles", f"""
WITH RECURSIVE {EDGE_SQL}, p AS (SELECT src AS start, [src, dst] AS path, dst AS last FROM e WHERE src <= dst
  UNION ALL SELECT start, list_append(path, dst), dst FROM p JOIN e ON e.src = p.last WHERE start < last AND len(path) <= 3 AND (dst = start OR (dst > start AND NOT list_contains(path, dst))))
SELECT array_to_string(path, '>') AS cycle FROM p WHERE start = last""")
def _(t):
    found = graph.cycles_up_to(_nation_edges(t), 3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"))


# Every pair of nodes with a path, and the nodes on a cycle.
REACH_SQL = """reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, e.dst FROM reach JOIN e ON e.src = reach.b),
cyclic AS (SELECT a AS node FROM reach WHERE a = b)"""


@query("g03_cycle_core", f"""
WITH RECURSIVE {EDGE_SQL}, {REACH_SQL},
behind AS (SELECT node FROM cyclic UNION SELECT b FROM reach JOIN cyclic ON a = node),
before AS (SELECT node FROM cyclic UNION SELECT a FROM reach JOIN cyclic ON b = node)
SELECT src, dst FROM e WHERE src IN (SELECT node FROM behind) AND dst IN (SELECT node FROM before)""")
def _(t):
    return graph.cycle_core(_nation_edges(t))


COMPONENT_SQL = """component AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@query("g03_components", f"WITH RECURSIVE {EDGE_SQL}, {REACH_SQL}, {COMPONENT_SQL} SELECT node, component FROM component")
def _(t):
    return graph.strong_components(_nation_edges(t))


# Each part leads to the parts that follow it in the three orders where it sold dearest.
FOLLOWER_SQL = """e AS (SELECT DISTINCT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY l_extendedprice DESC, l_orderkey, dst) AS place FROM (
  SELECT l_orderkey, l_extendedprice, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS dst FROM lineitem)
  WHERE dst IS NOT NULL) WHERE place <= 3)"""


def _followers(t):
    # an order has few lines, so its window is small; a part keeps three rows per task before the shuffle
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    lines = t.lineitem.select("l_orderkey", "l_extendedprice", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(within).alias("dst"))
    dearest = Window.partitionBy("src").orderBy(F.desc("l_extendedprice"), "l_orderkey", "dst")
    ranked = lines.where("dst IS NOT NULL").withColumn("place", F.row_number().over(dearest))
    return ranked.where("place <= 3").select("src", "dst").distinct()


@query("g03_follower_components", f"WITH RECURSIVE {FOLLOWER_SQL}, {REACH_SQL}, {COMPONENT_SQL} SELECT node, component FROM component")
def _(t):
    return graph.strong_components(_followers(t))


@query("g03_witness_cycles", f"""
WITH RECURSIVE {FOLLOWER_SQL}, {REACH_SQL}, {COMPONENT_SQL}, inner_edges AS (SELECT a.component, src, dst FROM e JOIN component a ON a.node = src JOIN component b ON b.node = dst AND a.component = b.component),
walk AS (SELECT DISTINCT component, component AS node, 0 AS depth, 0 AS back FROM component
  UNION SELECT w.component, dst, depth + 1, (dst = w.component)::INT FROM walk w JOIN inner_edges i ON i.component = w.component AND i.src = w.node WHERE back = 0 AND depth < 40)
SELECT component, min(depth)::BIGINT AS nodes, true AS closed FROM walk WHERE back = 1 GROUP BY component""")
def _(t):
    edges = cut_lineage(_followers(t))
    cycles = cut_lineage(graph.witness_cycles(edges, graph.strong_components(edges)))
    onward = cycles.select("component", (F.col("position") - 1).alias("position"), F.col("node").alias("next"))
    steps = cycles.join(onward, ["component", "position"], "left").select("component", F.col("node").alias("src"), F.coalesce("next", "component").alias("dst"))
    known = steps.join(edges.withColumn("known", F.lit(True)), ["src", "dst"], "left")
    return known.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.bool_and(F.coalesce("known", F.lit(False))).alias("closed"))


@query("g04_direct_dependents", f"WITH {DEPS_SQL} SELECT DISTINCT node FROM deps WHERE requires = 'n7'")
def _(t):
    return graph.direct_dependents(_deps(t), "n7")


@query("g05_transitive_dependents", f"""
WITH RECURSIVE {DEPS_SQL}, r AS (SELECT node FROM deps WHERE requires = 'r1' UNION SELECT deps.node FROM r JOIN deps ON deps.requires = r.node) SELECT node FROM r""")
def _(t):
    seeds = t.region.where("r_regionkey = 1").select(F.concat(F.lit("r"), _s("r_regionkey")).alias("node"))
    return graph.transitive_dependents(_deps(t), seeds)


@query("a10_graph_statistics", """
WITH n AS (SELECT 'c' || c_custkey AS id, 'customer' AS node_type, c_mktsegment AS domain FROM customer UNION ALL SELECT 'n' || n_nationkey, 'nation', CASE WHEN n_regionkey > 2 THEN 'BUILDING' ELSE 'MACHINERY' END FROM nation),
e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, CASE WHEN c_acctbal > 0 THEN 'rich' ELSE 'poor' END AS edge_type FROM customer)
SELECT 'nodes_by_type' AS measure, node_type AS key, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'nodes_by_domain', domain, count(*) FROM n GROUP BY 2
UNION ALL SELECT 'edges_by_type', edge_type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'cross_domain_edges', 'all', count(*) FROM e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id WHERE a.domain <> b.domain""")
def _(t):
    customers = t.customer.select(F.concat(F.lit("c"), _s("c_custkey")).alias("id"), F.lit("customer").alias("node_type"), F.col("c_mktsegment").alias("domain"))
    domain = F.when(F.col("n_regionkey") > 2, "BUILDING").otherwise("MACHINERY")
    nations = t.nation.select(F.concat(F.lit("n"), _s("n_nationkey")).alias("id"), F.lit("nation").alias("node_type"), domain.alias("domain"))
    edges = t.customer.select(
        F.concat(F.lit("c"), _s("c_custkey")).alias("src"), F.concat(F.lit("n"), _s("c_nationkey")).alias("dst"), F.when(F.col("c_acctbal") > 0, "rich").otherwise("poor").alias("edge_type")
    )
    return graph.graph_statistics(customers.unionByName(nations), edges)


@query("a11_validation_report", """
WITH r AS (SELECT o_orderkey AS run_id, o_orderstatus AS s, o_totalprice AS p FROM orders)
SELECT run_id, CASE s WHEN 'O' THEN 1 + (p > 250000)::INT WHEN 'F' THEN 1 + (p <= 100000)::INT ELSE 0 END AS num_passed, CASE s WHEN 'O' THEN 1 - (p > 250000)::INT WHEN 'F' THEN 1 - (p <= 100000)::INT ELSE 0 END AS num_failed,
  CASE s WHEN 'O' THEN p > 250000 WHEN 'F' THEN p <= 100000 ELSE p > 50000 END AS passed FROM r""")
def _(t):
    from factloom.sources import records

    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    error = F.when(price > 250000, "1e-10").otherwise("1e-5")
    as_json = F.concat(F.lit('{"cases": [{"name": "a", "error": '), error, F.lit('}, {"name": "b", "passed": true}]}'))
    as_lines = F.concat(F.lit("gravity: PASS\ncollision: "), F.when(price <= 100000, "OK").otherwise("FAIL"))
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.when(status == "O", as_json).when(status == "F", as_lines).otherwise("nothing here").alias("text"),
        F.when(price > 50000, 0).otherwise(1).alias("returncode"),
    )
    report = records.validation_report(runs, 1e-8)
    return report.select("run_id", F.col("num_passed").cast("int").alias("num_passed"), F.col("num_failed").cast("int").alias("num_failed"), "passed")


@query("a11_tolerance_report", """
SELECT l_suppkey, count(*) FILTER (abs(l_extendedprice / l_quantity - 2000) <= 1000) AS passed_cases, count(*) FILTER (abs(l_extendedprice / l_quantity - 2000) > 1000) AS failed_cases,
  count(*) FILTER (abs(l_extendedprice / l_quantity - 2000) > 1000) = 0 AS overall FROM lineitem GROUP BY l_suppkey""")
def _(t):
    from factloom.operators import quality

    cases = t.lineitem.select("l_suppkey", F.lit(None).cast("boolean").alias("passed"), (F.col("l_extendedprice") / F.col("l_quantity") - 2000).alias("error"))
    return quality.tolerance_report(cases, 1000.0, ["l_suppkey"])


@query("a12_invocation_summary", """
SELECT event_type AS module, count(*) AS invocation_count, count(*) FILTER (value > 20) AS successful_invocations, count(*) FILTER (value <= 20) AS failed_invocations,
  round(sum(value), 4) AS total_latency_us, round(avg(value), 4) AS average_latency_us, min(value) AS min_latency_us, max(value) AS max_latency_us FROM events GROUP BY 1""")
def _(t):
    rows = t.events.select(F.col("event_type").alias("module"), (F.col("value") > 20).alias("success"), F.col("value").alias("latency_us"))
    summary = rollups.invocation_summary(rows, ["module"])
    return summary.withColumns({c: F.round(c, 4) for c in ("total_latency_us", "average_latency_us")})


@query("a13_batch_verdicts", """
SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS passed, count(*) FILTER (o_orderstatus = 'P') AS failures FROM orders GROUP BY o_custkey""")
def _(t):
    return rollups.batch_verdict(t.orders.withColumn("success", F.col("o_orderstatus") != "P"), ["o_custkey"])


@query("a16_context_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def _(t):
    return rollups.counted(t.documents, ["source", "lang"])


@query("a18_objective_aggregates", """
SELECT p_brand, 'p_size' AS objective, round(avg(p_size), 6) AS mean, max(p_size)::DOUBLE AS max, min(p_size)::DOUBLE AS min FROM part GROUP BY 1
UNION ALL SELECT p_brand, 'p_retailprice', round(avg(p_retailprice), 6), max(p_retailprice), min(p_retailprice) FROM part GROUP BY 1""")
def _(t):
    return rollups.objective_aggregates(t.part, ["p_size", "p_retailprice"], ["p_brand"])


@query("a19_cache_stats", """
WITH l AS (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS hit FROM events)
SELECT event_type, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit) / count(*) AS hit_rate FROM l GROUP BY event_type""")
def _(t):
    lookups = rollups.first_lookup_misses(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return rollups.cache_stats(lookups, F.col("hit"), ["event_type"])


@query("o01_appended_facts", "SELECT 'nation' AS kind, n_name AS symbol FROM nation UNION ALL SELECT 'region', r_name FROM region")
def _(t):
    nations = t.nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("symbol"))
    return nations.unionByName(t.region.select(F.lit("region").alias("kind"), F.col("r_name").alias("symbol")))


@query("o02_domains_in_order", "SELECT event_type AS domain, min(event_id) AS first_seen FROM events GROUP BY 1")
def _(t):
    return rollups.distinct_in_order(t.events.withColumnRenamed("event_type", "domain"), "domain", "event_id")


@query("o03_merged_lists", r"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, list_concat(b.w, a.w) AS x FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)
SELECT conv_id, turn, sha256(array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' ')) AS merged FROM p""")
def _(t):
    words = t.conversations.select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    before = words.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("b"))
    merged = rollups.merged_lists(F.col("b"), F.col("w"))
    return words.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.sha2(F.array_join(merged, " "), 256).alias("merged"))


@query("x02_score_states", """
WITH RECURSIVE n AS (SELECT user_id AS key, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
m AS (SELECT DISTINCT key, 0::BIGINT AS step, 0.0::DOUBLE AS v, 0.0::DOUBLE AS before, 0.0::DOUBLE AS velocity, 0.0::DOUBLE AS acceleration, 0 AS stall_cycles,
    false AS anomaly, '' AS signal, 0 AS layer, [0, 0, 0, 0, 0] AS entries, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS totals FROM n
  UNION ALL SELECT key, step, v, before, velocity, acceleration, stall_cycles, anomaly, signal, layer,
    list_transform(entries, lambda x, i: x + (i = layer + 1)::INT), list_transform(totals, lambda x, i: x + CASE WHEN i = layer + 1 THEN v ELSE 0.0 END) FROM (
  SELECT *, CASE signal WHEN 'escalate' THEN least(old_layer + 1, 4) WHEN 'demote' THEN greatest(old_layer - 1, 0)
    WHEN 'restart' THEN CASE WHEN old_layer = 4 THEN 0 ELSE old_layer END WHEN 'boost_mutation_sigma' THEN 1 ELSE old_layer END AS layer FROM (
  SELECT *, CASE WHEN anomaly THEN 'boost_mutation_sigma' WHEN v < 0.3 THEN CASE WHEN old_layer >= 4 THEN 'restart' ELSE 'escalate' END
    WHEN v > 0.9 THEN 'hold' WHEN v < 0.1 THEN 'escalate' WHEN totals[old_layer + 1] / greatest(entries[old_layer + 1], 1) > v THEN 'demote' ELSE 'hold' END AS signal FROM (
  SELECT *, stall_cycles >= 2 AS anomaly FROM (
  SELECT *, CASE WHEN step >= 3 AND abs(velocity) < 0.2 AND abs(acceleration) < 0.2 THEN old_stall + 1 ELSE 0 END AS stall_cycles FROM (
  SELECT *, CASE WHEN step >= 3 THEN velocity - (before - older) ELSE 0.0 END AS acceleration FROM (
  SELECT n.key, n.step, n.v, m.v AS before, m.before AS older, CASE WHEN n.step >= 2 THEN n.v - m.v ELSE 0.0 END AS velocity,
    CASE WHEN m.anomaly THEN 0 ELSE m.stall_cycles END AS old_stall, m.layer AS old_layer, m.entries, m.totals
  FROM m JOIN n ON n.key = m.key AND n.step = m.step + 1)))))))
SELECT key, step, v AS score, velocity, acceleration, stall_cycles, anomaly, signal,
  ['conservative_scan', 'exploratory_probe', 'greedy_exploit', 'balanced_adaptive', 'fallback_cascade'][layer + 1] AS state FROM m WHERE step > 0""")
def _(t):
    scores = t.events.select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("value") / 100).alias("score"))
    return cycles.score_states_batch(scores, ["ts", "event_id"], patience=2, epsilon=0.2)


@query("x02_score_velocities", """
SELECT user_id AS key, row_number() OVER w AS step, round(value / 100, 6) AS score, round(coalesce(value / 100 - lag(value / 100) OVER w, 0.0), 6) AS velocity FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    scores = t.events.select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("value") / 100).alias("score"))
    states = cycles.score_states_batch(scores, ["ts", "event_id"])
    return states.select("key", "step", F.round("score", 6).alias("score"), F.round("velocity", 6).alias("velocity"))


@query("x04_drained_diagnostics", """
WITH d AS (SELECT user_id AS file, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS drained_at, event_id AS position, event_type FROM events WHERE event_type IN ('error', 'signup'))
SELECT file, drained_at::BIGINT AS drained_at, position, 'error ' || position AS message FROM d WHERE event_type = 'error' AND drained_at IS NOT NULL""")
def _(t):
    rows = t.events.where("event_type IN ('error', 'signup')").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("position"), F.concat(F.lit("error "), _s("event_id")).alias("message"),
        (F.col("event_type") == "signup").alias("drain"),
    )
    return cycles.feed_batch(rows)


@query("u01_extracted_facts", """
SELECT doc_id::VARCHAR AS path, lang AS domain, 'length' AS symbol, length(text)::DOUBLE AS lo FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id::VARCHAR, lang, 'first', NULL FROM documents WHERE lang <> 'en'""")
def _(t):
    from factloom.operators.extract import fact_row

    def lengths(docs):
        n = F.length("text").cast("double")
        bounds = F.struct(n.alias("lo"), n.alias("hi"))
        return docs.select(fact_row(kind=F.lit("state_variable"), path=F.col("path"), domain=F.col("domain"), symbol=F.lit("length"), bounds=bounds))

    def openings(docs):
        return docs.select(fact_row(kind=F.lit("state_variable"), path=F.col("path"), domain=F.col("domain"), symbol=F.lit("first")))

    fmt = F.when(F.col("lang") == "en", "text").otherwise("other")
    docs = t.documents.select(_s("doc_id").alias("path"), fmt.alias("format"), F.col("lang").alias("domain"), "text")
    facts = stages.extract_facts(docs, {"text": lengths, "other": openings})
    return facts.select("path", "domain", "symbol", F.col("bounds.lo").alias("lo"))


@query("u02_fallback_extraction", """
SELECT doc_id, regexp_matches(text, '[0-9]') AS used_fallback FROM documents""")
def _(t):
    def primary(body):
        if any("0" <= c <= "9" for c in body):
            raise ValueError("digits")
        return body.split()

    found = stages.with_fallback(t.documents.select("doc_id", "text"), primary, lambda body: [body])
    return found.select("doc_id", "used_fallback")


@query("u03_stage_chain", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents WHERE lang = 'en' GROUP BY source")
def _(t):
    def select(tables, params):
        return {"kept": tables["documents"].where(F.col("lang") == params["lang"])}

    def measure(tables, _params):
        return {"report": tables["kept"].groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))}

    tables, _status = stages.run_stages({"documents": t.documents}, [("select", select), ("measure", measure)], {"select": {"lang": "en"}})
    return tables["report"]


def _meaning_sql(text):
    bare = f"regexp_replace(regexp_replace({text}, '(?m)#.*$', '', 'g'), '(?m)//.*$', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g'))"


@query("x01_changed_documents", f"""
WITH e AS (SELECT doc_id, lang, {_meaning_sql('text')} AS old, {_meaning_sql("text || CASE WHEN lang = 'fr' THEN ' x' ELSE chr(10) || '# note' END")} AS new FROM documents)
SELECT doc_id AS key, lang = 'es' OR old <> new AS recomputed FROM e""")
def _(t):
    from factloom.operators import delta

    docs = t.documents.select(F.col("doc_id").alias("key"), "text", "lang")
    fingerprint = T.semantic_fingerprint(F.col("text")).alias("fingerprint")
    first = docs.where("lang <> 'es'").select("key", fingerprint)
    # In the second cycle French texts change and all others only gain a comment.
    edited = F.concat("text", F.when(F.col("lang") == "fr", F.lit(" x")).otherwise(F.lit("\n# note")))
    second = docs.withColumn("text", edited).select("key", fingerprint)
    result = delta.incremental(first, second, lambda rows: rows)
    return result.select("key", (~F.col("reused")).alias("recomputed"))


@query("x03_bounded_ledger", """
SELECT event_id AS id, value AS result FROM events ORDER BY value DESC, event_id LIMIT 200""")
def _(t):
    from factloom.operators import ledger

    rows = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("result"), "ts")
    half = F.lit("2024-01-16").cast("timestamp")
    first = ledger.record(rows.limit(0), rows.where(F.col("ts") < half), ["id"])
    return ledger.record(first, rows.where(F.col("ts") >= half), ["id"]).select("id", "result")
