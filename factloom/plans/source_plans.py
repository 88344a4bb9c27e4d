"""Queries for scans, semi-structured records, diagnostics and sinks.

The tables hold no compiler logs or JSON reports, so these queries let Spark write such texts
from every row of a table and read them back; the twins compute the same facts from the columns.
"""

import uuid

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import diagnostics, profiles
from factloom.plans.registry import query
from factloom.session import work_folder
from factloom.sources import corpus, records, sinks


def _s(column):
    return F.col(column).cast("string")


@query("s01_scanned_documents", """
SELECT 'corpus/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.json' WHEN 'de' THEN '.PY' END AS path,
  CASE lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'json' ELSE 'code:python' END AS format, length(text) AS n FROM documents WHERE lang <> 'es' AND source <> 'src5'""")
def _(t):
    ending = F.create_map(*[F.lit(x) for x in ("en", ".md", "fr", ".json", "de", ".PY", "es", ".bin")])[F.col("lang")]
    folder = F.when(F.col("source") == "src5", "node_modules").otherwise(F.col("source"))
    path = F.concat(F.lit("corpus/"), folder, F.lit("/"), _s("doc_id"), ending)
    files = t.documents.select(path.alias("path"), "text").withColumn("format", corpus.document_format(F.col("path")))
    kept = files.where(F.col("format").isNotNull() & ~corpus.in_ignored_dir(F.col("path")))
    return kept.select("path", "format", F.length("text").cast("long").alias("n"))


@query("s02_collected_sources", r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]+)', 1) AS path FROM pages)
SELECT page_id, s AS source FROM h, (VALUES ('english', '/en/'), ('french', '/fr/')) v(s, p) WHERE contains(path, p) AND NOT contains(path, 'spam-farm') AND NOT ends_with(path, '.html')""")
def _(t):
    path = F.regexp_extract("url", r"^https?://([^?#]+)", 1)
    files = t.pages.select(F.lit("web").alias("root"), F.concat_ws("|", path, _s("page_id")).alias("path"))
    sources = [
        {"name": name, "root": "web", "include": [f"*/{code}/**"], "exclude": ["*.html|*", "spam-farm*/**"]}
        for name, code in (("english", "en"), ("french", "fr"))
    ]
    found, _missing = corpus.collect_sources(files, sources)
    return found.select(F.split_part("path", F.lit("|"), F.lit(2)).cast("long").alias("page_id"), "source")


@query("s02_missing_sources", """
SELECT s AS source FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('pl'), ('it')) v(s) WHERE s NOT IN (SELECT regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) FROM pages)""")
def _(t):
    files = t.pages.select(F.lit("web").alias("root"), F.regexp_extract("url", r"^https?://([^?#]+)", 1).alias("path"))
    sources = [{"name": code, "root": "web", "include": [f"*/{code}/**"]} for code in ("en", "fr", "de", "es", "pl", "it")]
    return corpus.collect_sources(files, sources)[1].select("source")


@query("s03_query_parameters", r"""
WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS kv FROM pages)
SELECT page_id, split_part(kv, '=', 1) AS key, max(split_part(kv, '=', 2)) AS value FROM p WHERE regexp_matches(kv, '^[a-z_][a-z0-9_]*=.+$') GROUP BY 1, 2""")
def _(t):
    text = F.replace(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit("\n"))
    fields = records.key_values(text, r"^([a-z_][a-z0-9_]*)=(.+)$")
    return t.pages.select("page_id", F.explode(fields))


@query("s04_json_scalars", """
WITH j AS (SELECT o_orderkey, unnest(['status', 'price', 'key', 'big']) AS symbol, unnest(['string', 'real', 'integer', 'boolean']) AS type_hint,
  unnest([NULL, round(o_totalprice, 2) + 0.001, o_orderkey::DOUBLE, NULL]) AS lo FROM orders)
SELECT 'events' AS source, event_id::VARCHAR AS path, 'k' AS symbol, 'integer' AS type_hint, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS lo FROM events
UNION ALL SELECT 'orders', o_orderkey::VARCHAR, symbol, type_hint, round(lo, 3) FROM j""")
def _(t):
    events = t.events.select(_s("event_id").alias("path"), F.lit("events").alias("domain"), F.col("props").alias("text"))
    body = F.to_json(
        F.struct(
            F.col("o_orderstatus").alias("status"),
            (F.round(F.col("o_totalprice").cast("decimal(18,2)"), 2) + F.lit("0.001").cast("decimal(4,3)")).alias("price"),
            F.col("o_orderkey").alias("key"), (F.col("o_totalprice") > 1000).alias("big"), F.struct(F.lit(1).alias("x")).alias("nested"),
            F.array(F.lit(1)).alias("list"),
        )
    )
    orders = t.orders.select(_s("o_orderkey").alias("path"), F.lit("orders").alias("domain"), body.alias("text"))
    facts = records.json_scalars(events.unionByName(orders))
    return facts.select(F.col("domain").alias("source"), "path", "symbol", "type_hint", F.round("bounds.lo", 3).alias("lo"))


@query("s05_structured_facts", """
SELECT p_partkey::VARCHAR AS path, 'state_variable' AS kind, p_name AS symbol, p_size::DOUBLE AS lo, NULL AS expression, 0.95 AS confidence FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'boundary', p_type, NULL, p_type || ' > ' || p_size, 0.5 FROM part WHERE p_size > 10
UNION ALL SELECT p_partkey::VARCHAR, 'equation', p_brand, NULL, p_brand || ' = ' || p_name, 0.95 FROM part""")
def _(t):
    bounds = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"))
    doc = F.to_json(
        F.struct(
            F.array(F.struct(F.col("p_name").alias("name"), F.lit("real").alias("type"), bounds.alias("bounds"))).alias("variables"),
            F.array(
                F.struct(F.col("p_type").alias("symbol"), F.when(F.col("p_size") > 10, F.concat("p_type", F.lit(" > "), _s("p_size"))).alias("expression"),
                         F.lit(0.5).alias("confidence"))
            ).alias("constraints"),
            F.array(F.struct(F.col("p_brand").alias("lhs"), F.col("p_name").alias("rhs"))).alias("equations"),
        )
    )
    facts = records.structured_facts(t.part.select(_s("p_partkey").alias("path"), F.lit("json").alias("domain"), doc.alias("text")))
    return facts.select("path", "kind", "symbol", F.col("bounds.lo").alias("lo"), "expression", "confidence")


@query("s06_embedded_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    noisy = F.when(F.col("value") > 20, F.concat(F.lit("result: "), "props", F.lit(" done\n"))).otherwise(F.concat(F.lit("  "), "props"))
    return t.events.select("event_id", F.try_variant_get(records.embedded_json(noisy), "$.k", "bigint").alias("k"))


def _compiler_lines(t):
    span = F.struct(
        F.concat(F.lit("f"), _s("l_suppkey")).alias("file_name"), F.col("l_linenumber").alias("line_start"), F.col("l_partkey").cast("int").alias("byte_start"),
        (F.col("l_partkey") + 5).cast("int").alias("byte_end"), (F.col("l_linestatus") == "O").alias("is_primary"),
    )
    other = F.struct(
        F.lit("other").alias("file_name"), F.lit(1).alias("line_start"), F.lit(0).alias("byte_start"), F.lit(1).alias("byte_end"),
        (F.col("l_linestatus") == "F").alias("is_primary"),
    )
    spans = F.when(F.col("l_returnflag") == "R", F.array(span)).otherwise(F.array(span, other))
    line = F.to_json(
        F.struct(
            F.when(F.col("l_returnflag") == "A", "warning").otherwise("error").alias("level"), F.concat(F.lit("m"), _s("l_orderkey")).alias("message"),
            F.struct(F.lit("E0384").alias("code")).alias("code"), spans.alias("spans"),
        )
    )
    return t.lineitem.select(F.col("l_orderkey").alias("id"), line.alias("line"))


@query("s07_rustc_diagnostics", """
SELECT l_orderkey AS id, 'm' || l_orderkey AS message, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'other' ELSE 'f' || l_suppkey END AS file, 'E0384' AS code,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 0 ELSE l_partkey END AS start_byte FROM lineitem WHERE l_returnflag <> 'A'""")
def _(t):
    found = records.rustc_diagnostics(_compiler_lines(t), ["id"])
    return found.select("id", "message", "file", "code", F.col("start_byte").cast("long").alias("start_byte"))


@query("s08_gcc_diagnostics", """
SELECT o_orderkey AS id, '-W' || o_orderpriority AS code, 'c' || o_custkey AS file, o_custkey AS line, 1::BIGINT AS "column", o_custkey + 3 AS end_byte FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, NULL, '', 1, 1, -1 FROM orders""")
def _(t):
    def place(column):
        return F.struct(F.concat(F.lit("c"), _s("o_custkey")).alias("file"), column.alias("line"), column.alias("byte-column"))

    where = F.array(F.struct(place(F.col("o_custkey")).alias("caret"), place(F.col("o_custkey") + 3).alias("finish")))
    kind = F.when(F.col("o_orderstatus") == "P", "warning").otherwise("error")
    first = F.to_json(F.array(F.struct(kind.alias("kind"), F.lit("m").alias("message"), F.concat(F.lit("-W"), "o_orderpriority").alias("option"), where.alias("locations"))))
    second = F.lit('\n[{"kind": "error", "message": "n", "locations": []}]')
    rows = records.gcc_diagnostics(t.orders.select(F.col("o_orderkey").alias("id"), F.concat(first, second).alias("text")), ["id"])
    end = F.coalesce("end_byte", F.lit(-1)).cast("long").alias("end_byte")
    return rows.select("id", "code", "file", *[F.col(c).cast("long").alias(c) for c in ("line", "column")], end)


def _payloads(t):
    code = F.when(F.col("event_type") == "error", F.lit('{"value": "E0433"}')).when(F.col("event_type") == "view", F.lit('"reportMissingImports"')).otherwise(_s("user_id"))
    severity = F.when(F.col("value") > 100, F.lit("")).when(F.col("value") > 20, F.lit('"severity": 2, ')).otherwise(F.lit('"severity": 3, '))
    body = F.concat(
        F.lit('Content-Length: 9\r\n\r\n{"method": "textDocument/publishDiagnostics", "params": {"uri": "file:///w%20s/u'), _s("user_id"),
        F.lit('+.py", "diagnostics": [{'), severity, F.lit('"code": '), code, F.lit(', "message": "no \'n'), _s("event_id"), F.lit("' here\"}]}}"),
    )
    return t.events.select("event_id", body.alias("payload"))


@query("s09_language_server_actions", """
SELECT event_id, '/w s/u' || user_id || '+.py' AS file_path, CASE event_type WHEN 'error' THEN 'INJECT_RUST_USE_DECLARATION' ELSE 'AUTO_REFLUX_IMPORT' END AS action,
  CASE event_type WHEN 'error' THEN 'E0433' ELSE 'reportMissingImports' END AS code, 'n' || event_id AS symbol, CASE WHEN value > 100 THEN 1 ELSE 2 END AS severity
FROM events WHERE event_type IN ('error', 'view') AND value > 20""")
def _(t):
    found = records.language_server_actions(_payloads(t), ["event_id"])
    return found.select("event_id", "file_path", "action", "code", "symbol", "severity")


@query("s10_performance_vectors", """
SELECT event_id, CASE event_type WHEN 'error' THEN 0.0 WHEN 'view' THEN 0.5 ELSE 1.0 END AS accuracy,
  round(least(1e9, 1.0 / (value / CASE event_type WHEN 'click' THEN 1e3 WHEN 'view' THEN 1e6 ELSE 1 END)), 4) AS speed, CASE WHEN event_type = 'view' THEN 2.0 ELSE 0.0 END AS compression FROM events""")
def _(t):
    value = _s("value")
    kind = F.col("event_type")
    key = F.when(kind == "click", "latency_ms").when(kind == "view", "wall_us").otherwise("elapsed_seconds")
    base = F.map_from_arrays(F.array(key, F.lit("success")), F.array(value, F.when(kind == "error", "false").otherwise("true")))
    fields = F.when(kind == "view", F.map_concat(base, F.create_map(F.lit("score"), F.lit("0.5"), F.lit("compression"), F.lit("2")))).otherwise(base)
    rows = records.performance_vectors(t.events.select("event_id", fields.alias("fields")), "fields")
    vector = F.col("vector")
    return rows.select("event_id", vector[0].alias("accuracy"), F.round(vector[1], 4).alias("speed"), vector[2].alias("compression"))


@query("s13_graph_report", """
SELECT 'node' AS part, '{"id":"c' || c_custkey || '","node_type":"customer"}' AS json FROM customer
UNION ALL SELECT 'edge', '{"src":"c' || c_custkey || '","dst":"n' || c_nationkey || '"}' FROM customer""")
def _(t):
    node, nation = F.concat(F.lit("c"), _s("c_custkey")), F.concat(F.lit("n"), _s("c_nationkey"))
    target = f"{work_folder(t.spark)}/graph-{uuid.uuid4().hex}"
    sinks.write_graph(t.customer.select(node.alias("id"), F.lit("customer").alias("node_type")), t.customer.select(node.alias("src"), nation.alias("dst")), target)

    def lines(part, folder):
        return t.spark.read.text(f"{target}/{folder}").select(F.lit(part).alias("part"), F.col("value").alias("json"))

    return lines("node", "nodes").unionByName(lines("edge", "edges"))


@query("s16_workspace_snapshot", "SELECT lang, 1 AS files, true AS marked FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _(t):
    root = f"{work_folder(t.spark)}/workspace-{uuid.uuid4().hex}"
    # one file for each language, as a workspace of sources would hold them
    by_lang = t.documents.where("lang IS NOT NULL").select("lang", F.concat_ws(" ", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("value"))
    by_lang.repartition("lang").write.partitionBy("lang").text(root)
    found = corpus.snapshot(t.spark, root).where(F.col("path").endswith(".txt"))
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).agg(
        F.count(F.lit(1)).cast("int").alias("files"), F.bool_and(F.col("fingerprint").rlike("^[1-9][0-9]*:[0-9]+$")).alias("marked")
    )


@query("s14_nested_manifest", """
SELECT o_orderkey, o_orderstatus, string_agg('f' || l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS functions
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def _(t):
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).withColumns(
        {"pos": F.struct("l_linenumber", "l_partkey", "l_suppkey"), "name": F.concat(F.lit("f"), _s("l_linenumber"))}
    )
    nested = sinks.nested_manifest(lines, "o_orderkey", ["o_orderstatus"], ["name", "l_partkey"], "pos")
    target = f"{work_folder(t.spark)}/manifest-{uuid.uuid4().hex}"
    sinks.write_manifest(nested, target)
    manifest = t.spark.read.schema(nested.schema).json(target)
    joined = F.transform("functions", lambda f: F.concat_ws(":", f["name"], f["l_partkey"].cast("string")))
    return manifest.select("o_orderkey", "o_orderstatus", F.array_join(joined, " ").alias("functions"))


@query("s15_scan_status", """
SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 4000 THEN 'scanned' ELSE 'skipped_too_large' END AS status,
  CASE WHEN octet_length(encode(text)) <= 4000 THEN length(text) ELSE octet_length(encode(text)) END AS file_size,
  CASE WHEN octet_length(encode(text)) <= 4000 THEN len(string_split(text, chr(10))) ELSE -1 END AS line_count FROM documents""")
def _(t):
    return profiles.scan_status(t.documents.select("doc_id", "text"), max_bytes=4000).select("doc_id", "status", "file_size", F.coalesce("line_count", F.lit(-1)).alias("line_count"))


@query("a21_ingest_rollup", """
SELECT source, count(*) AS files_ingested, count(*) FILTER (regexp_matches(text, '[ \\t]+\\n')) AS files_repaired, count(*) FILTER (length(text) < 50) AS errors FROM documents GROUP BY source""")
def _(t):
    repairs = F.regexp_count("text", F.lit(r"[ \t]+\n"))
    return corpus.ingest_rollup(t.documents.select("source", repairs.alias("repairs"), F.when(F.length("text") < 50, "too short").alias("error")))


@query("p01_languages", """
SELECT CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'SMALL' THEN 'cpp' WHEN 'LARGE' THEN 'rust' END AS language, count(*) AS n FROM part GROUP BY 1""")
def _(t):
    kind = F.col("p_type")
    suffix = F.when(kind == "ECONOMY", ".py").when(kind == "SMALL", ".HPP").when(kind == "LARGE", ".rs").otherwise(".unknown")
    path = F.concat(F.lit("src.d/"), F.replace("p_name", F.lit(" "), F.lit("_")), suffix)
    return t.part.groupBy(corpus.detect_language(path).alias("language")).agg(F.count(F.lit(1)).alias("n"))


MESSAGES = {
    "click": "unresolved import `super::x`", "purchase": "cannot borrow `v` as mutable", "error": "\"foo.bar\" is not defined",
    "signup": "expected one of `.`, `;`, or an operator", "view": "all fine",
}


@query("p07_diagnostic_categories", """
SELECT event_id, CASE WHEN user_id < 10 THEN 'missing_crate' WHEN user_id < 20 THEN 'duplicate_definition' ELSE
  CASE event_type WHEN 'click' THEN 'unresolved_parent_import' WHEN 'purchase' THEN 'immutable_assignment' WHEN 'error' THEN 'missing_import' WHEN 'signup' THEN 'missing_semicolon' END END AS category FROM events""")
def _(t):
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[F.col("event_type")]
    code = F.when(F.col("user_id") < 10, "e0433").when(F.col("user_id") < 20, "E0428")
    return t.events.select("event_id", diagnostics.category(code, message).alias("category"))


@query("p08_code_actions", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'E0433' WHEN 'view' THEN 'reportMissingImports' ELSE user_id::VARCHAR END AS code,
  CASE event_type WHEN 'error' THEN 'INJECT_RUST_USE_DECLARATION' WHEN 'view' THEN 'AUTO_REFLUX_IMPORT' END AS action FROM events""")
def _(t):
    kind = F.col("event_type")
    raw = F.when(kind == "error", '{"value": "E0433"}').when(kind == "view", '"reportMissingImports"').otherwise(_s("user_id"))
    code = diagnostics.normalized_code(F.parse_json(raw))
    return t.events.select("event_id", code.alias("code")).withColumn("action", diagnostics.action_for(F.col("code")))


@query("p09_symbols", r"""
SELECT page_id, nullif(trim(regexp_extract(html, '["''`]([^"''`]+)["''`]', 1)), '') AS first_symbol,
  nullif(split_part(regexp_extract(html, '"([^"]+)"', 1), '.', -1), '') AS leaf_symbol FROM pages""")
def _(t):
    html = F.col("html")
    return t.pages.select("page_id", diagnostics.first_symbol(html).alias("first_symbol"), diagnostics.leaf_symbol(html).alias("leaf_symbol"))


@query("p10_uri_paths", r"""
SELECT page_id, '/' || replace(regexp_extract(url, '://[^/]+/([^?#]*)', 1), '-', '+') || ' x+y' AS path FROM pages""")
def _(t):
    rest = F.replace(F.regexp_extract("url", r"://[^/]+/([^?#]*)", 1), F.lit("-"), F.lit("+"))
    uri = F.concat(F.lit("file:///"), rest, F.lit("%20x+y"))
    return t.pages.select("page_id", diagnostics.uri_to_path(uri).alias("path"))


@query("p11_clean_logs", r"""
WITH l AS (SELECT doc_id, rtrim(text, ' ' || chr(10) || chr(9)) AS body FROM documents), s AS (SELECT doc_id, body, string_split(body, chr(10)) AS x FROM l)
SELECT doc_id, sha256(CASE WHEN body = '' THEN '(no output from compiler)' WHEN len(x) > 5 THEN array_to_string(x[:5], chr(10)) || chr(10) || '  ... (' || (len(x) - 5) || ' more lines omitted)' ELSE body END) AS log_hash FROM s""")
def _(t):
    colored = F.concat(F.lit("\x1b[31;1m"), "text", F.lit("\x1b[0m"))
    return t.documents.select("doc_id", F.sha2(T.clean_log(colored, 5), 256).alias("log_hash"))


@query("p12_version_problems", """
SELECT l_orderkey AS id, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'unresolved_import' WHEN l_returnflag = 'R' THEN 'method_not_found' END AS kind,
  CASE WHEN l_returnflag = 'R' THEN 'm' || l_partkey ELSE '' END AS method, CASE l_returnflag WHEN 'R' THEN 'rug::T' || l_suppkey WHEN 'N' THEN 'a::b' || l_suppkey ELSE '' END AS receiver FROM lineitem""")
def _(t):
    stderr = F.when(
        F.col("l_returnflag") == "R",
        F.concat(F.lit("error: no method named `m"), _s("l_partkey"), F.lit("` found for struct `&mut rug::T"), _s("l_suppkey"), F.lit("<'a>` in the current scope")),
    ).when(F.col("l_returnflag") == "N", F.concat(F.lit("unresolved import `a::b"), _s("l_suppkey"), F.lit("`"))).otherwise("warning: unused")
    return t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", *[c.alias(n) for n, c in diagnostics.version_problem(stderr).items()])


@query("p13_type_mismatches", """
SELECT o_orderkey, o_orderstatus <> 'P' AS mismatch, CASE WHEN o_orderstatus = 'O' THEN 'u' || o_custkey END AS expected, CASE WHEN o_orderstatus = 'O' THEN 'i32' END AS found FROM orders""")
def _(t):
    status = F.col("o_orderstatus")
    message = F.when(status == "O", F.concat(F.lit("expected `u"), _s("o_custkey"), F.lit("`, found `i32`"))).when(status == "F", "Mismatched types").otherwise("undefined symbol")
    expected, found = diagnostics.type_pair(message)
    return t.orders.select("o_orderkey", diagnostics.is_type_mismatch(message).alias("mismatch"), expected.alias("expected"), found.alias("found"))


@query("p14_run_metrics", """
SELECT event_id, value AS wall_time, CASE WHEN event_type = 'error' THEN NULL ELSE user_id::DOUBLE END AS energy, CASE WHEN event_type = 'click' THEN 0.25 END AS accuracy FROM events""")
def _(t):
    value, user = _s("value"), _s("user_id")
    as_json = F.concat(F.lit('log {"wall_time": '), value, F.lit(', "energy": '), user, F.lit(', "accuracy_error": 0.25}'))
    as_text = F.concat(F.lit("Wall_Time = "), value, F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("\nenergy: "), user)))
    text = F.when(F.col("event_type") == "click", as_json).otherwise(as_text)
    return records.with_run_metrics(t.events.select("event_id", text.alias("text"))).drop("text")
