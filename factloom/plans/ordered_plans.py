"""Queries for ordered analytics per key, top-k and the trajectory ledger."""

from pyspark.sql import functions as F

from factloom.operators import ledger, ordered
from factloom.plans.registry import query


@query("w01_collision_suffix", """
WITH r AS (SELECT p_partkey, p_brand || '::' || p_name AS id, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS rn FROM part)
SELECT p_partkey, CASE WHEN rn > 1 THEN id || '#' || rn ELSE id END AS id FROM r""")
def _(t):
    numbered = ordered.row_number(t.part.select("p_partkey", "p_brand", "p_name"), ["p_brand", "p_name"], ["p_partkey"])
    name = F.concat_ws("::", "p_brand", "p_name")
    suffixed = F.when(F.col("rn") > 1, F.concat(name, F.lit("#"), F.col("rn").cast("string"))).otherwise(name)
    return numbered.select("p_partkey", suffixed.alias("id"))


DAILY_CTE = """dy AS (SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, round(sum(value), 2) AS score FROM events GROUP BY 1, 2),
k1 AS (SELECT *, row_number() OVER w AS rn, coalesce(score - lag(score) OVER w, 0.0) AS velocity FROM dy WINDOW w AS (PARTITION BY user_id ORDER BY day)),
k2 AS (SELECT *, CASE WHEN rn >= 3 THEN velocity - lag(velocity) OVER (PARTITION BY user_id ORDER BY day) ELSE 0.0 END AS acceleration FROM k1),
k3 AS (SELECT *, max(CASE WHEN NOT (rn >= 3 AND abs(velocity) < 60 AND abs(acceleration) < 60) THEN rn END) OVER (PARTITION BY user_id ORDER BY day) AS br FROM k2)"""


def _kinetics(t):
    daily = t.events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("value"), 2).alias("score"))
    return ordered.kinetics(daily, ["user_id"], ["day"], "score", epsilon=60.0, patience=2)


@query("w03_score_kinetics", f"""
WITH {DAILY_CTE} SELECT user_id, day, round(velocity, 4) AS velocity, round(acceleration, 4) AS acceleration FROM k2""")
def _(t):
    return _kinetics(t).select("user_id", "day", F.round("velocity", 4).alias("velocity"), F.round("acceleration", 4).alias("acceleration"))


@query("w04_stall_runs", f"""
WITH {DAILY_CTE} SELECT user_id, day, rn - coalesce(br, 0) AS stall_run, rn - coalesce(br, 0) >= 2 AS stagnation FROM k3""")
def _(t):
    return _kinetics(t).select("user_id", "day", "stall_run", "stagnation")


@query("w06_moving_average", """
WITH RECURSIVE d AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE)::VARCHAR AS day, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY day) AS rn FROM d),
e AS (SELECT p, day, rn, 0.1 * x AS ema FROM n WHERE rn = 1 UNION ALL SELECT n.p, n.day, n.rn, 0.1 * n.x + 0.9 * e.ema FROM e JOIN n ON n.p = e.p AND n.rn = e.rn + 1)
SELECT p AS priority, day, round(ema, 3) AS ema FROM e""")
def _(t):
    daily = t.orders.groupBy(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").cast("string").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    return ordered.moving_average(daily, ["priority"], ["day"], "x").select("priority", "day", F.round("ema", 3).alias("ema"))


@query("w07_rolling_stats", """
SELECT event_id, round(avg(value) OVER w, 9) AS mean, max(value) OVER w AS largest, min(value) OVER w AS smallest FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def _(t):
    aggs = {"mean": F.avg("value"), "largest": F.max("value"), "smallest": F.min("value")}
    rolled = ordered.rolling(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], aggs)
    return rolled.select("event_id", F.round("mean", 9).alias("mean"), "largest", "smallest")


@query("w08_steps_since_improvement", """
WITH RECURSIVE n AS (SELECT o_orderkey, o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
f AS (SELECT o_custkey, rn, o_orderkey, CASE WHEN x > 30000 THEN x ELSE 0.0 END AS best, CASE WHEN x > 30000 THEN 0 ELSE 1 END AS steps FROM n WHERE rn = 1
UNION ALL SELECT n.o_custkey, n.rn, n.o_orderkey, CASE WHEN n.x > best + 30000 THEN n.x ELSE best END, CASE WHEN n.x > best + 30000 THEN 0 ELSE steps + 1 END FROM f JOIN n ON n.o_custkey = f.o_custkey AND n.rn = f.rn + 1)
SELECT o_orderkey, steps::BIGINT AS steps, steps >= 5 AS stagnant FROM f""")
def _(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return ordered.steps_since_improvement(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", min_delta=30000.0, patience=5
    ).select("o_orderkey", "steps", "stagnant")


NET_SQL = "p_retailprice * power(0.97, 3) - (p_size * 10 + 0.02 * 4)"


@query("w09_ranked_actions", f"""
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {NET_SQL} DESC, p_partkey) - 1 AS rank_order FROM part""")
def _(t):
    from factloom.functions import scores

    benefit = scores.net_benefit(F.col("p_retailprice"), F.col("p_size") * 10, F.lit(3), F.lit(4))
    ranked = ordered.row_number(t.part.select("p_brand", "p_partkey", (-benefit).alias("loss")), ["p_brand"], ["loss", "p_partkey"])
    return ranked.select("p_brand", "p_partkey", (F.col("rn") - 1).alias("rank_order"))


# Offsets of matches: what lies before a match is split pieces and earlier matches. A shout is a whole word.
SPAN_SQL = " UNION ALL ".join(
    f"""SELECT doc_id, '{category}' AS category, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::BIGINT
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM documents)) WHERE {kept}"""
    for category, pattern, kept in (
        ("email", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+", "true"), ("long_number", "[0-9]{6,}", "true"),
        ("shout", r"[\p{L}\p{N}_]+", "regexp_full_match(m[i], '[A-Z]{4,}')"),
    )
)


@query("w10_chosen_spans", f"""
WITH RECURSIVE hits AS ({SPAN_SQL}),
o AS (SELECT doc_id, s, s + n AS e, row_number() OVER (PARTITION BY doc_id ORDER BY category, s) AS k FROM hits),
c AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::STRUCT(s BIGINT, e BIGINT)[] AS taken FROM o
  UNION ALL SELECT c.doc_id, o.k, CASE WHEN len(list_filter(taken, lambda r: NOT (o.e < r.s OR o.s > r.e))) > 0 THEN taken ELSE list_append(taken, {{'s': o.s, 'e': o.e}}) END
  FROM c JOIN o ON o.doc_id = c.doc_id AND o.k = c.k + 1),
best AS (SELECT doc_id, max(k) AS n_hits, max(len(taken)) AS n_chosen FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_chosen, 0)::BIGINT AS n_chosen, coalesce(n_hits, 0)::BIGINT AS n_hits FROM documents LEFT JOIN best USING (doc_id)""")
def _(t):
    from factloom.operators import extract

    return extract.chosen_spans(extract.pattern_hits(t.documents.select("doc_id", "text"), extract.PROSE_RISKS)).select(
        "doc_id", F.size("chosen").cast("long").alias("n_chosen"), F.col("n_hits")
    )


def _trajectories(t):
    return t.events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("value").alias("result"), "user_id",
        F.map_filter(F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("double")), lambda _, v: v > 20).alias("matrix"),
    )


@query("k01_top_trajectories", "SELECT event_id AS id, value AS result FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 200")
def _(t):
    return ledger.top(_trajectories(t), 200, ["id"], action="purchase").select("id", "result")


SIMILARITY_SQL = """(CASE WHEN {b} IS NULL THEN 0 ELSE greatest(0, 1 - abs(c_acctbal - {b}) / greatest(abs(c_acctbal), abs({b}), 1)) END
  + CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END) / 2"""
QUERIES = {"rich": {"balance": 9000.0, "segment": "BUILDING"}, "poor": {"balance": -500.0, "segment": "MACHINERY"}}


@query("j26_state_similarity", f"""
SELECT c_custkey, round({SIMILARITY_SQL.format(b=9000.0, s='BUILDING')}, 6) AS similarity FROM customer""")
def _(t):
    similarity = ledger.state_similarity(QUERIES["rich"], {"balance": "c_acctbal"}, {"segment": "c_mktsegment"})
    return t.customer.select("c_custkey", F.round(similarity, 6).alias("similarity"))


@query("k02_best_matching", f"""
WITH s AS (SELECT c_custkey, c_nationkey, 'rich' AS query, {SIMILARITY_SQL.format(b=9000.0, s='BUILDING')} AS similarity FROM customer
  UNION ALL SELECT c_custkey, c_nationkey, 'poor', {SIMILARITY_SQL.format(b=-500.0, s='MACHINERY')} FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, c_nationkey DESC, c_custkey) AS place FROM s)
SELECT query, place, c_custkey, round(similarity, 6) AS similarity FROM r WHERE place <= 10""")
def _(t):
    best = ledger.best_matching(
        t.customer, QUERIES, {"balance": "c_acctbal"}, {"segment": "c_mktsegment"}, 10, ["c_custkey"], result="c_nationkey"
    )
    return best.select("query", F.col("place").cast("long").alias("place"), "c_custkey", F.round("similarity", 6).alias("similarity"))


@query("k03_best_matrices", """
WITH f AS (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 12)
SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM f WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 20 ORDER BY value DESC, event_id LIMIT 3""")
def _(t):
    return ledger.best_matrices(_trajectories(t), 3, ["id"], "matrix").select("id", F.col("matrix")["k"].alias("k"))


@query("k07_bounded_candidates", f"""
WITH r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY {NET_SQL} DESC, p_partkey) AS place FROM part)
SELECT p_type, p_partkey, place FROM r WHERE place <= 64""")
def _(t):
    from factloom.functions import scores

    benefit = scores.net_benefit(F.col("p_retailprice"), F.col("p_size") * 10, F.lit(3), F.lit(4))
    kept = ledger.top_per_group(t.part.withColumn("benefit", benefit), ["p_type"], [F.desc("benefit"), "p_partkey"], 64)
    return kept.select("p_type", "p_partkey", F.col("place").cast("long").alias("place"))


@query("a17_ledger_stats", """
SELECT user_id, count(*) AS size, round(max(value), 6) AS best_result, round(avg(value), 6) AS mean_result,
  count(*) FILTER (CAST(json_extract_string(props, '$.k') AS DOUBLE) > 20) AS with_parameter_matrix FROM events GROUP BY user_id""")
def _(t):
    return ledger.stats(_trajectories(t), ["user_id"], "matrix")
