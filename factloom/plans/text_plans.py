"""Queries over document texts: fingerprints, entropies, profiles, duplicates, anomalies."""

from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions import text as T
from factloom.operators import duplicates, profiles, similarity
from factloom.plans.registry import query

PROFILE = list(fixed.TOKEN_PATTERNS)
RULE_METRICS = [m for _, m, _ in fixed.ANOMALY_RULES]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count_sql(pattern: str) -> str:
    """The same category for an engine without look-ahead and with ASCII word classes."""
    word = {r"\breturn\b", r"\braise\b", r"\bexcept\b", r"\bwith\b", r"\byield\b", r"\blambda\b", r"\bassert\b",
            r"\bglobal\b", r"\bnonlocal\b", r"\bawait\b"}
    if pattern in word:
        inner = pattern[2:-2]
        return f"len(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x = '{inner}'))"
    plain = pattern.replace("=(?!=)", "=(?:[^=]|$)")
    return f"len(regexp_extract_all(text, {_quoted('(?m)' + plain)}))"


PROFILE_SQL = ", ".join(f"CAST({_count_sql(p)} AS BIGINT) AS {n}" for n, p in fixed.TOKEN_PATTERNS.items())
PROFILE_CTE = f"profile AS (SELECT doc_id, {PROFILE_SQL} FROM documents)"
_RULES_SQL = ", ".join(f"('{c}', '{m}', {str(i).lower()})" for c, m, i in fixed.ANOMALY_RULES)
ANOMALY_CTE = f"""{PROFILE_CTE},
measures AS (UNPIVOT (SELECT doc_id, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in RULE_METRICS)} FROM profile)
  ON {', '.join(RULE_METRICS)} INTO NAME metric VALUE value),
base AS (SELECT metric, avg(value) AS mean, CASE WHEN count(*) = 1 THEN 1.0 ELSE stddev_samp(value) END AS stdev
  FROM measures GROUP BY metric),
rules(category, metric, inverted) AS (VALUES {_RULES_SQL}),
scored AS (SELECT doc_id, category, metric, inverted, value, (value - mean) / stdev AS z
  FROM measures JOIN base USING (metric) JOIN rules USING (metric) WHERE stdev >= 1e-9),
found AS (SELECT *, CASE WHEN abs(z) > 5.0 THEN 'critical' ELSE 'warning' END AS severity
  FROM scored WHERE CASE WHEN inverted THEN z < -2.5 ELSE z > 2.5 END)"""
TOKENS_CTE = """tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS t FROM documents),
tc AS (SELECT doc_id, t, count(*) AS c FROM tok GROUP BY ALL),
te AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM tc GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS t FROM documents),
lc AS (SELECT doc_id, t, count(*) AS c FROM ln GROUP BY ALL),
le AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM lc GROUP BY doc_id)"""


@query("t01_fingerprint", """
SELECT doc_id, sha256(text) AS fingerprint, left(sha256(text), 16) AS short_fingerprint FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", T.fingerprint(F.col("text")).alias("fingerprint"), T.fingerprint(F.col("text"), 16).alias("short_fingerprint")
    )


@query("t02_semantic_fingerprint", r"""
SELECT doc_id, left(sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '(?m)#.*$', '', 'g'), '(?m)//.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g'))), 32) AS fingerprint
FROM documents""")
def _(t):
    return t.documents.select("doc_id", T.semantic_fingerprint(F.col("text")).alias("fingerprint"))


@query("t03_parameter_fingerprint", r"""
SELECT page_id, left(sha256(array_to_string(list_sort(regexp_extract_all(html, '"[^"]*"|\b\d+\b')), '|')), 16) AS fingerprint
FROM pages""")
def _(t):
    return t.pages.select("page_id", T.parameter_fingerprint(F.col("html")).alias("fingerprint"))


@query("t04_token_entropy", f"""
WITH {TOKENS_CTE} SELECT doc_id, round(coalesce(e, 0.0), 6) AS token_entropy FROM documents LEFT JOIN te USING (doc_id)""")
def _(t):
    return t.documents.select("doc_id", F.round(T.token_entropy(F.col("text")), 6).alias("token_entropy"))


@query("t05_line_entropy", f"""
WITH {TOKENS_CTE} SELECT doc_id, round(coalesce(e, 0.0), 6) AS line_entropy FROM documents LEFT JOIN le USING (doc_id)""")
def _(t):
    return t.documents.select("doc_id", F.round(T.line_entropy(F.col("text")), 6).alias("line_entropy"))


@query("t06_structural_diversity", rf"""
WITH bl AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(\n[A-ZÀ-Ý])', chr(1) || '\1', 'g'), chr(1))) AS b FROM documents),
bd AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS b FROM bl),
dv AS (SELECT doc_id, count(DISTINCT b)::DOUBLE / count(*) AS d FROM bd WHERE b <> '' GROUP BY doc_id)
SELECT doc_id, round(coalesce(d, 1.0), 6) AS diversity FROM documents LEFT JOIN dv USING (doc_id)""")
def _(t):
    return t.documents.select(
        "doc_id", F.round(T.structural_diversity(F.col("text"), r"\n[A-ZÀ-Ý]"), 6).alias("diversity")
    )


@query("t07_entropy_gate", f"""
WITH {TOKENS_CTE}, m AS (SELECT doc_id, round(coalesce(te.e, 0.0), 9) AS te, round(coalesce(le.e, 0.0), 9) AS le
  FROM documents LEFT JOIN te USING (doc_id) LEFT JOIN le USING (doc_id))
SELECT doc_id, (te >= 3.0 AND le >= 2.5) AS passed, round(te, 3) AS token_entropy, round(le, 3) AS line_entropy,
  1.0::DOUBLE AS structural_diversity,
  concat_ws('; ', CASE WHEN te < 3.0 THEN format('Token entropy {{:.2f}} below threshold 3.0', te) END,
    CASE WHEN le < 2.5 THEN format('Line entropy {{:.2f}} below threshold 2.5', le) END) AS reasons
FROM m""")
def _(t):
    gate = profiles.entropy_gate(t.documents.select("doc_id", "text"))
    return gate.select(
        "doc_id", "passed", "token_entropy", "line_entropy", "structural_diversity",
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query("t08_normalized_body", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[ \t]+\n', chr(10), 'g')) AS body_hash FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.sha2(T.normalized_body(F.col("text")), 256).alias("body_hash"))


@query("t09_token_profile", f"WITH {PROFILE_CTE} SELECT * FROM profile")
def _(t):
    return profiles.token_profile(t.documents.select("doc_id", "text"))


PROSE = {"word": "[a-zA-Z]+", "number": "[0-9]+", "stop": "[.!?]", "pause": "[,;:]"}


@query("t10_token_events", f"""
WITH cat(rank, category, pattern) AS (VALUES {', '.join(f"({i}, '{n}', '{p}')" for i, (n, p) in enumerate(PROSE.items()))}),
m AS (SELECT doc_id, rank, category, text, regexp_extract_all(text, pattern) AS hits, regexp_split_to_array(text, pattern) AS gaps FROM documents, cat),
x AS (SELECT doc_id, rank, category, unnest(generate_series(1, len(hits))) AS i, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap FROM m),
o AS (SELECT doc_id, rank, category, length(hit) AS n, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER p, 0) AS start_pos
  FROM x WINDOW w AS (PARTITION BY doc_id, rank ORDER BY i), p AS (PARTITION BY doc_id, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, category, count(*) AS n, CAST(min(start_pos) AS BIGINT) AS first_start, CAST(max(start_pos + n) AS BIGINT) AS last_end,
  CAST(sum(start_pos) AS BIGINT) AS start_sum FROM o GROUP BY doc_id, category""")
def _(t):
    events = profiles.token_events(t.documents.select("doc_id", "text"), patterns=PROSE)
    return (
        events.select("doc_id", F.inline("events"))
        .groupBy("doc_id", "category")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("start").cast("long").alias("first_start"),
            F.max("end").cast("long").alias("last_end"), F.sum("start").alias("start_sum"),
        )
    )


@query("t11_line_delta", """
WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
d AS (SELECT *, list_distinct(string_split(rtrim(prev, chr(10)), chr(10))) AS a, list_distinct(string_split(rtrim(text, chr(10)), chr(10))) AS b FROM c WHERE prev IS NOT NULL)
SELECT conv_id, turn, prev <> text AS changed, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS lines_added,
  len(list_filter(a, lambda x: NOT list_contains(b, x))) AS lines_removed, length(text) - length(prev) AS size_delta_chars FROM d""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = t.conversations.withColumn("prev", F.lag("text").over(w)).where("prev IS NOT NULL")
    return profiles.line_delta(turns, "prev", "text").select(
        "conv_id", "turn", "changed", "lines_added", "lines_removed", "size_delta_chars"
    )


@query("t12_line_lint", r"""
WITH l AS (SELECT page_id, unnest(string_split(html, '</p>')) AS line, generate_subscripts(string_split(html, '</p>'), 1) AS line_no FROM pages),
r(rule, pattern) AS (VALUES ('inline_script', '<script'), ('inline_style', '<style'), ('escaped_amp', '&amp;'), ('bold', '<b>'))
SELECT page_id, rule, count(*) AS n, CAST(min(line_no) AS INTEGER) AS first_line FROM l JOIN r ON regexp_matches(line, pattern) GROUP BY page_id, rule""")
def _(t):
    rules = [("inline_script", "<script"), ("inline_style", "<style"), ("escaped_amp", "&amp;"), ("bold", "<b>")]
    hits = profiles.line_lint(t.pages.select("page_id", "html"), rules, "html", "</p>")
    return hits.groupBy("page_id", "rule").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


@query("t13_canonical_hash", """
SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":"' || user_id || '"}') AS value_hash FROM events""")
def _(t):
    fields = F.create_map(
        F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type")
    )
    return t.events.select("event_id", T.canonical_hash(fields).alias("value_hash"))


@query("t14_number_tokens", r"""
WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?')) AS x FROM documents)
SELECT doc_id, count(*) AS n, max(try_cast(x AS DOUBLE)) AS largest FROM n GROUP BY doc_id""")
def _(t):
    return (
        t.documents.select("doc_id", T.number_tokens(F.col("text")).alias("numbers"))
        .where(F.size("numbers") > 0)
        .select("doc_id", F.size("numbers").cast("long").alias("n"), F.array_max("numbers").alias("largest"))
    )


@query("a01_duplicate_groups", """
WITH f AS (SELECT doc_id, sha256(text) AS fingerprint FROM documents),
g AS (SELECT fingerprint, count(*) AS copies FROM f GROUP BY fingerprint HAVING count(*) > 1)
SELECT fingerprint, copies, doc_id FROM f JOIN g USING (fingerprint)""")
def _(t):
    docs = t.documents.select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))
    return duplicates.duplicate_members(docs, ["fingerprint"])


@query("a02_shared_bodies", """
WITH b AS (SELECT source, lang, sha256(text) AS body_hash FROM documents)
SELECT lang AS name, body_hash, count(DISTINCT source) AS n_modules, min(source) AS canonical
FROM b GROUP BY lang, body_hash HAVING count(DISTINCT source) >= 2""")
def _(t):
    docs = t.documents.select(F.col("lang").alias("name"), F.col("source").alias("module"), F.sha2("text", 256).alias("body_hash"))
    return duplicates.shared_bodies(docs)


@query("a03_key_set_groups", """
WITH k AS (SELECT event_id, array_to_string(list_sort(list_concat(json_keys(props), [event_type])), '_') AS schema_key FROM events)
SELECT lower(schema_key) AS label, count(*) AS weight, min(event_id) AS first_record FROM k GROUP BY schema_key HAVING count(*) >= 2""")
def _(t):
    keyed = t.events.select(
        F.col("event_id").alias("record"), F.concat(F.json_object_keys("props"), F.array("event_type")).alias("keys")
    )
    return duplicates.key_set_groups(keyed, "keys", "record")


@query("a04_corpus_profile", f"WITH {PROFILE_CTE} SELECT {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in PROFILE)} FROM profile")
def _(t):
    return profiles.aggregate_profile(profiles.token_profile(t.documents.select("doc_id", "text")), PROFILE)


@query("a05_scan_summary", """
SELECT source, count(*) FILTER (octet_length(encode(text)) <= 4000) AS scanned, count(*) FILTER (octet_length(encode(text)) > 4000) AS failed,
  count(*) AS total, round(count(*) FILTER (octet_length(encode(text)) <= 4000) / count(*), 6) AS coverage,
  count(*) FILTER (octet_length(encode(text)) <= 4000) / count(*) >= 0.8 AS coverage_passed FROM documents GROUP BY source""")
def _(t):
    return profiles.scan_summary(profiles.scan_status(t.documents, max_bytes=4000), 0.8, ["source"])


@query("a06_profile_baseline", f"""
WITH {ANOMALY_CTE} SELECT metric, round(mean, 6) AS mean, round(stdev, 6) AS stdev FROM base""")
def _(t):
    measures = profiles.long_profile(profiles.token_profile(t.documents.select("doc_id", "text")), ["doc_id"], RULE_METRICS)
    return profiles.baseline(measures).select("metric", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


def _anomalies(t):
    rule_patterns = {m: fixed.TOKEN_PATTERNS[m] for m in RULE_METRICS}
    profile = profiles.token_profile(t.documents.select("doc_id", "text"), patterns=rule_patterns)
    return profiles.anomalies(profiles.long_profile(profile, ["doc_id"], RULE_METRICS))


@query("a07_profile_anomalies", f"""
WITH {ANOMALY_CTE} SELECT doc_id, category, metric, value, round(z, 4) AS zscore, severity FROM found""")
def _(t):
    return _anomalies(t).select("doc_id", "category", "metric", "value", F.round("zscore", 4).alias("zscore"), "severity")


@query("a07_severity_summary", f"WITH {ANOMALY_CTE} SELECT severity, count(*) AS n FROM found GROUP BY severity")
def _(t):
    return profiles.severity_summary(_anomalies(t))


@query("k04_capped_anomalies", f"""
WITH {ANOMALY_CTE} SELECT doc_id, metric, round(z, 4) AS zscore FROM found ORDER BY abs(z) DESC, doc_id, metric LIMIT 50""")
def _(t):
    return profiles.capped_anomalies(_anomalies(t), ["doc_id", "metric"]).select(
        "doc_id", "metric", F.round("zscore", 4).alias("zscore")
    )


NGRAM_CTE = r"""w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w,
  generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) AS i FROM conversations),
g AS (SELECT conv_id, turn, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s || ' ' || lead(w, 3) OVER s AS gram
  FROM w WINDOW s AS (PARTITION BY conv_id, turn ORDER BY i))"""


@query("w02_ngram_totals", f"""
WITH {NGRAM_CTE} SELECT conv_id, turn, count(gram) AS total_ngrams, count(DISTINCT gram) AS unique_ngrams FROM g GROUP BY conv_id, turn""")
def _(t):
    words = t.conversations.select("conv_id", "turn", T.tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    return profiles.ngram_totals(words, "words")


@query("k06_top_ngrams", f"""
WITH {NGRAM_CTE} SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram ORDER BY n DESC, gram LIMIT 20""")
def _(t):
    words = t.conversations.select(T.tokens(F.col("text")).alias("words"))
    return profiles.top_ngrams(profiles.ngram_counts(words, "words"))


PAIRS_SQL = f"""{PROFILE_CTE},
v AS (SELECT doc_id, [{', '.join(f'{m}::DOUBLE' for m in PROFILE)}] AS vec FROM profile),
d AS (SELECT vec, min(doc_id) AS rep, count(*) AS members FROM v WHERE list_sum(vec) > 0 GROUP BY vec),
p AS (SELECT a.rep AS profile_a, b.rep AS profile_b, a.members AS members_a, b.members AS members_b, list_cosine_similarity(a.vec, b.vec) AS s
  FROM d a JOIN d b ON a.rep < b.rep)"""


def _profile_pairs(t):
    profile = profiles.token_profile(t.documents.select("doc_id", "text"))
    vectors = profile.select("doc_id", F.array(*[F.col(m).cast("double") for m in PROFILE]).alias("vector"))
    return similarity.similar_profiles(vectors, "doc_id", "vector", fixed.SIMILARITY_CUTOFF)


@query("j14_similar_profiles", f"""
WITH {PAIRS_SQL} SELECT profile_a, profile_b, members_a, members_b, round(s, 6) AS similarity FROM p WHERE s >= 0.8 - 1e-12""")
def _(t):
    return _profile_pairs(t)


@query("k05_similar_embeddings", """
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_cosine_similarity(a.v, b.v) AS s FROM n a JOIN n b ON a.vec_id < b.vec_id)
SELECT id_a, id_b, round(s, 6) AS similarity FROM p WHERE s >= 0.4 ORDER BY s DESC, id_a, id_b LIMIT 50""")
def _(t):
    vectors = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    pairs = similarity.similar_pairs(vectors, "vec_id", "vector", 0.4, limit=fixed.SIMILAR_PAIR_LIMIT)
    return (
        pairs.orderBy(F.desc("similarity"), "id_a", "id_b")
        .limit(fixed.SIMILAR_PAIR_LIMIT)
        .withColumn("similarity", F.round("similarity", 6))
    )
