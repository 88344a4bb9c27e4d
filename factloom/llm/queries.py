"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe
from factloom.llm.best_position import TOP, ranked_search
from factloom.llm.common import LOWER, UPPER, held_out
from factloom.llm.containment import WINDOW_WORDS, contamination
from factloom.llm.factoring import duplicate_spans
from factloom.llm.jaccard import jaccard_groups
from factloom.llm.line_rules import DEPLETED_PERCENT, LINE_DOCS, LINE_PER_MILLE, MAX_REPEAT_PERCENT, MIN_WORDS, line_rules
from factloom.llm.mixing import mix
from factloom.llm.rule_ensemble import quality, train_rules
from factloom.llm.secret_scan import BASE_KINDS, find_secrets, listed
from factloom.llm.toxicity import toxicity, train_toxicity
from factloom.llm.url_model import GRID, ORDER, RULES, judge_urls
from factloom.llm.vectors import near_vectors
from factloom.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).drop("removed_lines")


OP1_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), repeats AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id
), raw_lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw_lines GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, text, line, len(string_split(line, ' ')) AS words FROM (
    SELECT doc_id, source, text, trim(unnest(string_split(
      regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]{{2,}}|[\x09\x0B-\x0D]', ' ', 'g'),
      chr(10))), ' ') AS line
    FROM docs) WHERE line <> ''
), hosts AS (
  SELECT source, count(DISTINCT text) AS host_docs FROM docs GROUP BY source
), bad AS (
  SELECT l.source, l.line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.line, h.host_docs
  HAVING count(DISTINCT l.text) > {LINE_DOCS} AND count(DISTINCT l.text) * 1000 > h.host_docs * {LINE_PER_MILLE}
), lost AS (
  SELECT l.doc_id, sum(l.words) AS n FROM lines l JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line
  GROUP BY l.doc_id
), counted AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS n_removed_words
  FROM docs d LEFT JOIN dups u USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost x USING (doc_id)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND 100 * n_removed_words <= {DEPLETED_PERCENT} * n_words AS kept FROM judged
"""

def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    return quality(documents, train_rules(documents, labels, ~out)).select(
        "doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    secrets = F.col("secrets")

    def count(kind: str):
        return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listed(secrets, BASE_KINDS), 256).alias("base_sha256"),
        listed(secrets).alias("spans"),
    )


_SQL_KEY = (
    "((?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    + "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?)"
)
#: kind, pattern, group that is measured, least length
_SQL_RULES = (
    ("assign", _SQL_KEY + "([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 27),
)
OP4_SQL = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ("
    + " UNION ALL ".join(
        f"""
  SELECT doc_id, '{kind}' AS kind, {k} AS k, length(m[i]) AS n,
         list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}', 0) AS m,
           regexp_extract_all(text, '{pattern}', {group}) AS g FROM docs))
  WHERE length(g[i]) >= {least}"""
        for k, (kind, pattern, group, least) in enumerate(_SQL_RULES)
    )
    + """), listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || start + n, ',' ORDER BY start, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || start || ':' || start + n, ',' ORDER BY start, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed l USING (doc_id)
"""
)

def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(documents, path, pattern, decoded="bytes")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op10_factoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = duplicate_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    scores = toxicity(documents, train_toxicity(documents, labels, ~out))
    return scores.select(
        "doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op7_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


_SQL_URL = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"


def _url_levels() -> str:
    """Counts, contexts and both models' probabilities for every order."""
    parts = []
    for k in range(1, ORDER + 1):
        lower = f"JOIN p{k - 1} p ON right(t.g, {k - 1}) = p.g" if k > 1 else "CROSS JOIN (SELECT 1 / 65536 AS pa, 1 / 65536 AS pr) p"
        parts.append(f"""t{k} AS (SELECT right(g, {k}) AS g, sum(a) AS a, sum(r) AS r FROM counted GROUP BY 1),
c{k} AS (SELECT left(g, {k - 1}) AS c, sum(a) AS an, sum(r) AS rn, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM t{k} GROUP BY 1),
p{k} AS (SELECT t.g, CASE WHEN an > 0 THEN (a + ta * pa) / greatest(an + ta, 1) ELSE pa END AS pa,
  CASE WHEN rn > 0 THEN (r + tr * pr) / greatest(rn + tr, 1) ELSE pr END AS pr
  FROM t{k} t JOIN c{k} c ON left(t.g, {k - 1}) = c.c {lower})""")
    return ",\n".join(parts)


OP7_SQL = f"""
WITH rules(rh, rp, rv) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
split AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {_SQL_URL}, 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), {_SQL_URL}, 2) AS path FROM pages),
longest AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
ruled AS (SELECT s.*, rule, verdict FROM split s LEFT JOIN longest USING (page_id)),
texts AS (SELECT host || path AS text, verdict, count(*) AS n FROM ruled GROUP BY 1, 2),
windows AS (SELECT text, verdict, n, substring(repeat(chr(2), {ORDER - 1}) || text || chr(3), i, {ORDER}) AS g
  FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM texts)),
counted AS (SELECT g, coalesce(sum(n) FILTER (verdict = 'allow'), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (verdict = 'block'), 0)::DOUBLE AS r
  FROM windows GROUP BY g),
{_url_levels()},
ratios AS (SELECT g, round(ln(pr / pa) * 1000000)::BIGINT AS ratio FROM p{ORDER}),
scored AS (SELECT text, verdict, n, greatest(-{GRID}, least({GRID}, floor(sum(ratio) / (count(*) * 10000)))) AS step
  FROM windows JOIN ratios USING (g) GROUP BY text, verdict, n),
steps AS (SELECT step, coalesce(sum(n) FILTER (verdict = 'allow'), 0) AS a, coalesce(sum(n) FILTER (verdict = 'block'), 0) AS r
  FROM scored WHERE verdict IS NOT NULL GROUP BY step),
above AS (SELECT step, row_number() OVER (ORDER BY step) AS place, sum(r) OVER (ORDER BY step DESC) * (SELECT sum(a) FROM steps)
  - sum(a) OVER (ORDER BY step DESC) * (SELECT sum(r) FROM steps) AS gain FROM steps),
bound AS (SELECT coalesce((SELECT step - 1 FROM above WHERE place > 1 AND gain > 0 AND (SELECT sum(a) FROM steps) > 0
  AND (SELECT sum(r) FROM steps) > 0 ORDER BY gain DESC, step DESC LIMIT 1), {GRID}) AS top)
SELECT page_id, host, path, rule, coalesce(r.verdict, CASE WHEN step > (SELECT top FROM bound) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN (SELECT text, step FROM scored WHERE verdict IS NULL) j ON r.verdict IS NULL AND host || path = j.text
"""

def op11_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH docs AS (SELECT doc_id, {_SQL_TERMS} AS w FROM documents),
items AS (SELECT item_id, {_SQL_TERMS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
  SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), {WINDOW_WORDS}) AS k FROM items WHERE len(w) > 0))),
places AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, g)),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

OP13_SQL = f"""
WITH words AS (SELECT doc_id, unnest({_SQL_TERMS}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) GROUP BY ALL),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term, docs),
scored AS (SELECT item_id, doc_id,
    sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= {TOP}
"""

QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_url_model": op7_url_model,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_multi_index": op9_multi_index,
    "op10_factoring": op10_factoring,
    "op11_containment": op11_containment,
    "op12_whitening": op12_whitening,
    "op13_best_position": op13_best_position,
}
SQL = {
    "op1_line_frequency": OP1_SQL,
    "op4_secret_scan": OP4_SQL,
    "op7_url_model": OP7_SQL,
    "op11_containment": OP11_SQL,
    "op13_best_position": OP13_SQL,
}
