"""Queries for classification, scores, fact extraction and checks."""

from pyspark.sql import functions as F

from factloom.functions import fixed, scores
from factloom.operators import classify, extract, ledger, quality
from factloom.plans.registry import query


def _s(column):
    return F.col(column).cast("string")


@query("p02_language_by_name", """
WITH n AS (SELECT p_partkey, lower(replace(p_name, ' ', '_') || '_' || p_type || CASE WHEN p_size > 40 THEN '_ui' WHEN p_size > 30 THEN '_rs' ELSE '' END) AS name FROM part)
SELECT p_partkey, CASE WHEN contains(name, 'cc') OR contains(name, 'cpp') THEN 'cpp' WHEN contains(name, 'rust') OR contains(name, '_rs') OR contains(name, 'rs_') THEN 'rust'
  WHEN contains(name, 'ui') OR contains(name, 'web') THEN 'python' WHEN contains(name, '_c_') THEN 'c' ELSE 'unknown' END AS language FROM n""")
def _(t):
    ending = F.when(F.col("p_size") > 40, "_UI").when(F.col("p_size") > 30, "_rs").otherwise("")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_type"), ending)
    return t.part.select("p_partkey", classify.language_by_name(name).alias("language"))


@query("p03_located_sources", """
WITH tg AS (SELECT DISTINCT p_brand || '/' || p_type AS project, p_name AS name FROM part WHERE p_size > 25),
tk AS (SELECT DISTINCT project, name, unnest(string_split(name, ' ')) AS tok FROM tg),
fl AS (SELECT DISTINCT p_brand || '/' || p_type AS project, 'src/' || replace(p_name, ' ', '/') || '.py' AS path FROM part WHERE p_size <= 25)
SELECT DISTINCT project, name, path FROM tk JOIN fl USING (project) WHERE contains(path, tok)""")
def _(t):
    project = F.concat_ws("/", "p_brand", "p_type").alias("project")
    targets = t.part.where("p_size > 25").select(project, F.col("p_name").alias("label"), F.concat(F.lit("py-"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name")).distinct()
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".py"))
    files = t.part.where("p_size <= 25").select(project, path.alias("path")).distinct()
    return classify.located_sources(targets, files, ["project"]).select("project", F.col("label").alias("name"), "path").distinct()


LEXICON = {"first": ["the", "and"], "second": ["und", "der"], "third": ["les", "une"], "fourth": ["de", "que"]}
DOMAIN_SQL = "CASE " + " ".join(
    f"WHEN {n} > 0 AND {n} >= greatest(" + ", ".join(LEXICON) + f") THEN '{n}'" for n in LEXICON
) + " ELSE 'general' END"
COUNTS_SQL = ", ".join(
    " + ".join(f"(length(x) - length(replace(x, '{w}', ''))) // {len(w)}" for w in words) + f" AS {n}" for n, words in LEXICON.items()
)


@query("p04_document_domains", f"""
WITH l AS (SELECT doc_id, source, lower(text) AS x FROM documents), c AS (SELECT doc_id, source, {COUNTS_SQL} FROM l)
SELECT doc_id, {DOMAIN_SQL} AS domain, {DOMAIN_SQL} || '::' || source AS id FROM c""")
def _(t):
    found = classify.with_domain(t.documents.select("doc_id", "source", "text"), lexicon=LEXICON)
    return found.select("doc_id", "domain", classify.make_id(F.col("domain"), F.col("source")).alias("id"))


@query("p04_builtin_domains", "WITH l AS (SELECT doc_id, lower(text) AS x FROM documents), c AS (SELECT doc_id, " + ", ".join(
    " + ".join(f"(length(x) - length(replace(x, '{w}', ''))) // {len(w)}" for w in words) + f" AS {n}" for n, words in fixed.DOMAIN_KEYWORDS.items()
) + " FROM l) SELECT CASE " + " ".join(
    f"WHEN {n} > 0 AND {n} >= greatest(" + ", ".join(fixed.DOMAIN_KEYWORDS) + f") THEN '{n}'" for n in fixed.DOMAIN_KEYWORDS
) + " ELSE 'general' END AS domain, count(*) AS n FROM c GROUP BY 1")
def _(t):
    return classify.with_domain(t.documents.select("doc_id", "text")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("p06_cold_names", r"""
SELECT page_id, regexp_matches(url, '(?i)(config|settings|\.env|constants|template|component|\.html|\.css)') AS cold FROM pages""")
def _(t):
    return t.pages.select("page_id", classify.is_cold_by_name(F.col("url")).alias("cold"))


@query("p15_sanitized_values", """
SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS result, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS matrix_size,
  length(repeat(event_type, 50)) > 256 AS long_label, least(256, length(repeat(event_type, 50))) AS label_chars FROM events""")
def _(t):
    kind = F.col("event_type")
    matrix = F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(_s("value"), F.lit("true"), F.when(kind.isin("click", "view"), "NaN").otherwise("3")))
    state = F.create_map(F.lit("label"), F.repeat(kind, F.lit(50)), F.lit("bad"), F.lit("Infinity"))
    result = F.when(F.col("value") > 100, "-Infinity").otherwise(_s("value"))
    clean = ledger.sanitize_state(state)
    return t.events.select(
        "event_id", ledger.coerce_result(result).alias("result"), F.size(ledger.sanitize_matrix(matrix)).alias("matrix_size"),
        (F.length(state["label"]) > 256).alias("long_label"), F.length(clean["label"]).cast("long").alias("label_chars"),
    )


@query("p16_objective_vectors", """
SELECT event_id, CASE WHEN value > 100 THEN 0.0 WHEN value < 1 THEN 1e9 ELSE round(1.0 / value, 9) END AS speed, 0.0::DOUBLE AS padding FROM events""")
def _(t):
    seconds = F.when(F.col("value") > 100, F.lit(float("inf"))).when(F.col("value") < 1, F.lit(0.0)).otherwise(F.col("value"))
    vector = scores.objective_vector(F.array(scores.inverse_seconds(seconds), F.lit(float("nan"))))
    rows = t.events.select("event_id", vector.alias("v"))
    return rows.select("event_id", F.round(F.col("v")[0], 9).alias("speed"), (F.col("v")[1] + F.col("v")[2]).alias("padding"))


@query("p17_net_benefit", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * power(0.97317, l_linenumber) - (l_tax * 1000 + 0.02 * l_quantity), 3) AS benefit FROM lineitem""")
def _(t):
    benefit = scores.net_benefit(F.col("l_extendedprice"), F.col("l_tax") * 1000, F.col("l_linenumber"), F.col("l_quantity"), gamma=0.97317)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(benefit, 3).alias("benefit"))


@query("p18_seeded_scores", r"""
WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (length(text) > 4000) AS odd, sum(len(regexp_extract_all(text, '[,;]'))) AS soft, sum(len(regexp_extract_all(text, '[a-z]+'))) AS hard FROM documents GROUP BY source)
SELECT source, round(greatest(0.0, 0.9 * (1.0 - least(1.0, odd / n) * 0.5)), 6) AS accuracy, round(greatest(0.0, least(1.0, 1.0 - soft / hard)), 6) AS compression FROM s""")
def _(t):
    per_source = t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 4000).alias("odd"),
        F.sum(F.regexp_count("text", F.lit("[,;]"))).alias("soft"), F.sum(F.regexp_count("text", F.lit("[a-z]+"))).alias("hard"),
    )
    return per_source.select(
        "source", F.round(scores.seeded_score(F.lit(0.9), F.col("odd"), F.col("n")), 6).alias("accuracy"),
        F.round(scores.comment_free_share(F.col("soft"), F.col("hard").cast("double")), 6).alias("compression"),
    )


@query("p19_decay_rates", """
WITH c AS (SELECT o_orderkey, o_custkey AS cycle FROM orders),
p(start, n) AS (VALUES (0, 100), (100, 200), (300, 400), (700, 800), (1500, 1600), (3100, 3200), (6300, 6400), (12700, 12800)),
w AS (SELECT o_orderkey, cycle, cycle - 50 AS e FROM c)
SELECT o_orderkey, round(CASE WHEN cycle < 50 THEN 1e-5 + (0.01 - 1e-5) * (cycle / 50) ELSE greatest(1e-5, 1e-5 + (0.01 - 1e-5) * 0.5 * (1 + cos(pi() * (e - start) / n))) END, 9) AS cosine,
  round(CASE WHEN cycle < 50 THEN 1e-5 + (0.01 - 1e-5) * (cycle / 50) ELSE greatest(1e-5, 0.01 * power(0.995, e)) END, 9) AS exponential,
  round(CASE WHEN cycle < 50 THEN 1e-5 + (0.01 - 1e-5) * (cycle / 50) ELSE greatest(1e-5, 0.01 * power(0.5, e // 100)) END, 9) AS step
FROM w JOIN p ON greatest(e, 0) >= start AND greatest(e, 0) < start + n""")
def _(t):
    cycle = F.col("o_custkey")
    return t.orders.select(
        "o_orderkey", F.round(scores.cosine_rate(cycle), 9).alias("cosine"), F.round(scores.exponential_rate(cycle), 9).alias("exponential"),
        F.round(scores.step_rate(cycle), 9).alias("step"),
    )


@query("p20_weighted_objectives", """
SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL ELSE round(p_size * 0.25 + p_retailprice * 2.0, 6) END AS total FROM part""")
def _(t):
    parts = t.part.withColumn("size", F.when(F.col("p_size") <= 45, F.col("p_size"))).withColumn("price", F.col("p_retailprice"))
    _weighted, total = scores.weighted_objectives({"size": 0.25, "price": 2.0})
    rows = parts.select("p_partkey", total.alias("t"))
    return rows.select("p_partkey", F.when(F.col("t") < float("inf"), F.round("t", 6)).alias("total"))


@query("p21_blended_fitness", """
WITH m AS (SELECT l_suppkey, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY 1 HAVING max(l_quantity) = 50)
SELECT s_suppkey, s_acctbal AS size, round(q * 0.5, 6) AS runtime FROM supplier LEFT JOIN m ON s_suppkey = l_suppkey""")
def _(t):
    candidates = t.supplier.select("s_suppkey", F.create_map(F.lit("size"), F.col("s_acctbal")).alias("fitness"))
    sold = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.avg("l_quantity"), 6).alias("wall_time"), F.max("l_quantity").alias("most"))
    measured = sold.where("most = 50").drop("most")
    rows = classify.blended(candidates, measured, "s_suppkey", ["wall_time"], 0.5)
    return rows.select("s_suppkey", F.col("fitness")["size"].alias("size"), F.round(F.try_element_at("fitness", F.lit("runtime_wall_time")), 6).alias("runtime"))


TRACE_SQL = """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (value > 20) AS ok, avg(value) AS lat FROM events GROUP BY 1, 2"""


def _traces(t):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    base = t.events.groupBy("event_type", day).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 20).alias("ok"), F.avg("value").alias("lat"))
    none = F.lit(None).cast("double")
    return base.select(
        "event_type", "day", scores.trace_accuracy(none, none, F.col("ok"), F.col("n")).alias("accuracy"), scores.trace_velocity(F.col("lat")).alias("velocity")
    )


@query("p22_trace_scores", f"""
WITH x AS ({TRACE_SQL}) SELECT event_type, day, round(ok / n, 6) AS accuracy, round(1e6 / lat, 6) AS velocity FROM x""")
def _(t):
    return _traces(t).select("event_type", "day", F.round("accuracy", 6).alias("accuracy"), F.round("velocity", 6).alias("velocity"))


@query("p25_accepted_variants", f"""
WITH x AS ({TRACE_SQL}), b AS (SELECT event_type, ok / n AS a, 1e6 / lat AS v FROM x WHERE day = '2024-01-01')
SELECT x.event_type, x.day, round(1e6 / lat, 6) AS fitness FROM x JOIN b USING (event_type) WHERE x.day > '2024-01-01' AND ok / n >= b.a AND 1e6 / lat > b.v""")
def _(t):
    traces = _traces(t)
    variants = traces.withColumn("compile_success", F.col("day") > "2024-01-01")
    kept = classify.accepted_variants(variants, traces.where("day = '2024-01-01'"), "event_type")
    return kept.select("event_type", "day", F.round("velocity", 6).alias("fitness"))


@query("p23_function_classes", """
WITH u AS (SELECT user_id, max(hour(ts)) AS depth, count(*) FILTER (event_type = 'click') AS ops, count(*) FILTER (event_type = 'error') > 10 AS rec, count(*) AS calls, count(DISTINCT event_type) AS span FROM events GROUP BY user_id)
SELECT user_id, round(depth * 3.0 + ops * 1.5 + CASE WHEN rec THEN 5.0 ELSE 0.0 END + calls * 0.2 + span * 0.05, 2) AS score, CASE WHEN user_id > 5 AND depth * 3.0 + ops * 1.5 + CASE WHEN rec THEN 5.0 ELSE 0.0 END + calls * 0.2 + span * 0.05 >= 90 THEN 'hot' ELSE 'cold' END AS class FROM u""")
def _(t):
    users = t.events.groupBy("user_id").agg(
        F.max(F.hour("ts")).alias("depth"), F.count_if(F.col("event_type") == "click").alias("ops"), (F.count_if(F.col("event_type") == "error") > 10).alias("rec"),
        F.count(F.lit(1)).alias("calls"), F.countDistinct("event_type").alias("span"),
    )
    scored = users.withColumn("score", scores.function_score(F.col("depth"), F.col("ops"), F.col("rec"), F.col("calls"), F.col("span")))
    return scored.select("user_id", "score", scores.hot_or_cold(F.col("score"), F.col("user_id") <= 5, 90.0).alias("class"))


@query("p26_fact_violations", """
SELECT o_orderkey AS pos, unnest(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'missing required field ''domain''' END, CASE WHEN o_totalprice > 300000 THEN 'missing required field ''expression''' END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'wrong kind, expected ''boundary''' END], lambda x: x IS NOT NULL)) AS violation FROM orders""")
def _(t):
    facts = t.orders.select(
        F.col("o_orderkey").alias("pos"), _s("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "equation").otherwise("boundary").alias("kind"),
        F.when(F.col("o_orderstatus") != "P", "d").alias("domain"), _s("o_custkey").alias("symbol"), F.when(F.col("o_totalprice") <= 300000, "x > 0").alias("expression"),
    )
    return quality.fact_violations(facts, "boundaries", "boundary").select("pos", "violation")


@query("p27_field_violations", """
SELECT o_orderkey AS block, 'status' AS key, 'value not allowed' AS violation FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'price', 'wrong type' FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'tags', 'empty list' FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT o_orderkey, 'extra', 'unknown key' FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT o_orderkey, 'tags', 'missing required key' FROM orders WHERE o_orderpriority = '2-HIGH'""")
def _(t):
    def field(key, kind, value, size=0):
        return F.struct(F.lit(key).alias("key"), kind.alias("value_type"), value.alias("value"), F.lit(size).alias("size"))

    low = F.col("o_orderpriority") == "5-LOW"
    fields = F.array(
        field("status", F.lit("string"), F.col("o_orderstatus")),
        field("price", F.when(F.col("o_totalprice") > 400000, "string").otherwise("number"), _s("o_totalprice")),
        F.when(F.col("o_orderpriority") == "2-HIGH", field("extra", F.lit("bool"), F.lit("true"))).when(low, field("tags", F.lit("list"), F.lit(""))).otherwise(field("tags", F.lit("list"), F.lit("x"), 1)),
    )
    rules = t.spark.createDataFrame(
        [("status", "string", ["O", "F"]), ("price", "number", []), ("tags", "list", [])], "key string, value_type string, allowed array<string>"
    )
    required = t.spark.createDataFrame([("status",), ("tags",)], "key string")
    return quality.field_violations(t.orders.select(F.col("o_orderkey").alias("block"), F.inline(fields)), rules, required)


def _prose(t):
    text = F.concat(
        F.lit("Line one.\nLet v"), _s("p_size"), F.lit(" be the "), F.col("p_name"), F.lit(" weight.\nHere, where w denotes "), F.col("p_type"), F.lit(" load; the\nlimit must remain between "),
        _s("p_size"), F.lit(" and "), (F.col("p_size") + 10).cast("string"), F.lit(" units. Dose must not exceed 5.5 mg. temp must remain below 90. flow must be at least "), _s("p_size"),
        F.lit(".\nE = 0.5 * m * v"), _s("p_size"), F.lit(" + E.\n"),
    )
    return t.part.select(_s("p_partkey").alias("path"), F.col("p_type").alias("domain"), text.alias("text"))


@query("e01_state_variables", """
SELECT p_partkey::VARCHAR AS path, 'v' || p_size AS symbol, 'the ' || p_name || ' weight' AS description, 2 AS line, 0.7 AS confidence FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'w', p_type || ' load', 3, 0.7 FROM part""")
def _(t):
    return extract.state_variables(_prose(t)).select("path", "symbol", "description", "line", "confidence")


@query("e02_boundaries", """
SELECT p_partkey::VARCHAR AS path, unnest(['limit', 'Dose', 'temp', 'flow']) AS symbol, unnest([p_size || ' <= limit <= ' || (p_size + 10), 'Dose <= 5.5', 'temp < 90', 'flow > ' || p_size]) AS expression, 4 AS line FROM part""")
def _(t):
    return extract.boundaries(_prose(t)).select("path", "symbol", "expression", "line")


@query("e03_equations", """
SELECT p_partkey::VARCHAR AS path, 'E' AS lhs, '0.5 * m * v' || p_size || ' + E' AS rhs, 'm v' || p_size AS variables, 5 AS line FROM part""")
def _(t):
    return extract.equations(_prose(t)).select("path", "lhs", "rhs", F.array_join("variables", " ").alias("variables"), "line")


def _c_sources(t):
    text = F.concat(
        F.lit("#define MAX_"), _s("p_size"), F.lit(" 1024\n#define NAME \""), F.col("p_brand"), F.lit("\"\nconst float G = 9.8f;\nconst int H = MAX + G;\nvoid f() { assert(H > "),
        _s("p_size"), F.lit("); }\n__global__ void kern"), _s("p_size"), F.lit("(int *x) {}\nvoid go() { kern"), _s("p_size"), F.lit("<<<1, 2>>>(x); }\n"),
    )
    return t.part.select(_s("p_partkey").alias("path"), F.lit("code:cpp").alias("domain"), text.alias("text"))


@query("e04_c_facts", """
SELECT p_partkey::VARCHAR AS path, 'state_variable' AS kind, 'MAX_' || p_size AS symbol, 'integer' AS type_hint, 1024.0::DOUBLE AS lo, NULL AS expression, 1 AS line FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'state_variable', 'NAME', 'string', NULL, NULL, 2 FROM part UNION ALL SELECT p_partkey::VARCHAR, 'state_variable', 'G', 'real', 9.8, NULL, 3 FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'equation', 'H', NULL, NULL, 'H = MAX + G', 4 FROM part UNION ALL SELECT p_partkey::VARCHAR, 'boundary', 'H', NULL, NULL, 'H > ' || p_size, 5 FROM part""")
def _(t):
    return extract.c_facts(_c_sources(t)).select("path", "kind", "symbol", "type_hint", F.col("bounds.lo").alias("lo"), "expression", "line")


@query("e08_kernel_sites", """
SELECT p_partkey::VARCHAR AS path, unnest(['definition', 'launch']) AS site, 'kern' || p_size AS name, unnest([5, 6]) AS line FROM part""")
def _(t):
    return extract.kernel_sites(_c_sources(t)).select("path", "site", "name", "line")


@query("e09_foreign_bindings", """
WITH r AS (SELECT 'fn_' || l_partkey AS name, max(l_orderkey * 10 + l_linenumber) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
c AS (SELECT 'fn_' || l_partkey AS name, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT name, 'pyo3_function' AS binding, last AS node FROM r UNION ALL SELECT name, 'c_extern', first FROM c WHERE name NOT IN (SELECT name FROM r)""")
def _(t):
    flag = F.col("l_returnflag")
    function = F.concat(F.lit("fn_"), _s("l_partkey"))
    node = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node")
    nodes = t.lineitem.select(
        node, node.alias("position"), F.when(flag == "R", "rust").when(flag == "A", "c").otherwise("python").alias("language"),
        F.when(flag == "R", "function_item").when(flag == "A", "declaration").otherwise("Name").alias("type"), function.alias("name"),
        F.when(flag == "R", F.concat(F.lit("#[pyfunction]\nfn "), function, F.lit("() {}"))).when(flag == "A", F.concat(F.lit("extern int "), function, F.lit("(int);"))).otherwise("x").alias("text"),
    )
    return extract.foreign_bindings(nodes).select("name", "binding", "node")


@query("e10_pattern_hits", r"""
WITH h AS (SELECT doc_id, 'email' AS category, unnest(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+')) AS hit FROM documents
UNION ALL SELECT doc_id, 'long_number', unnest(regexp_extract_all(text, '[0-9]{6,}')) FROM documents)
SELECT doc_id, category, count(*) AS n, min(left(hit, 50)) AS first_detail FROM h GROUP BY 1, 2""")
def _(t):
    risks = {k: extract.PROSE_RISKS[k] for k in ("email", "long_number")}
    hits = extract.pattern_hits(t.documents.select("doc_id", "text"), risks).select("doc_id", F.inline("hits"))
    return hits.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("detail").alias("first_detail"))


@query("a15_hot_cold_counts", r"""
SELECT source, count(*) FILTER (NOT regexp_matches(text, '[0-9]{6,}')) AS hot, count(*) FILTER (regexp_matches(text, '[0-9]{6,}')) AS cold FROM documents GROUP BY source""")
def _(t):
    hits = extract.pattern_hits(t.documents.select("source", "text"), {"long_number": extract.PROSE_RISKS["long_number"]})
    return extract.hot_cold_counts(hits, ["source"])
