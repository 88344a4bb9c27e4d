"""Readers of semi-structured text: key/value files, JSON facts, compiler and server logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scores
from factloom.functions import text as T
from factloom.operators import diagnostics, extract

# key/value syntax, alias keys of measurements, and confidences of JSON facts.
KEY_VALUE = r"^([A-Z_][A-Z0-9_]*)=(.+)$"
ACCURACY_KEYS = ["accuracy_score", "accuracy", "score", "success_rate", "precision"]
SECONDS_KEYS = ["wall_seconds", "execution_time", "execution_seconds", "elapsed_seconds", "duration_seconds", "runtime_seconds"]
MILLIS_KEYS = ["latency_ms", "wall_ms", "duration_ms"]
MICROS_KEYS = ["latency_us", "wall_us", "duration_us"]
COMPRESSION_KEYS = ["compression_ratio", "compression", "compaction_ratio", "minify_compression"]
STRUCTURED_KEYS = ["state_variables", "variables", "boundaries", "constraints", "equations"]
FLAT_CONFIDENCE, STRUCTURED_CONFIDENCE = 0.5, 0.95
METRIC_KEYS = ["wall_time", "energy", "accuracy"]


def key_values(text: Column, pattern: str = KEY_VALUE) -> Column:
    """Map of KEY=VALUE lines; the last duplicate of a key wins."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x.rlike(pattern))
    pairs = F.sort_array(
        F.transform(
            lines,
            lambda x, i: F.struct(
                F.regexp_extract(x, pattern, 1).alias("k"), i.alias("i"), F.regexp_extract(x, pattern, 2).alias("v")
            ),
        )
    )
    last = F.filter(pairs, lambda p, i: ~p["k"].eqNullSafe(F.get(pairs, i + 1)["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def embedded_json(text: Column) -> Column:
    """JSON of a text as VARIANT: the whole text, else from the first ``{`` to the last ``}``."""
    body = T.strip(text)
    start = F.instr(body, "{")
    end = F.length(body) - F.instr(F.reverse(body), "}") + 1
    span = F.when((start > 0) & F.contains(body, F.lit("}")) & (start < end), F.substring(body, start, end - start + 1))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(span))


def json_scalars(docs: DataFrame) -> DataFrame:
    """Top-level scalars of JSON objects in (path, domain, text) as state-variable facts.

    Documents with one of the structured keys are left to :func:`structured_facts`.
    """
    parsed = docs.select("path", "domain", "text", F.try_parse_json("text").alias("doc"))
    structured = ", ".join(f"'{k}'" for k in STRUCTURED_KEYS)
    fields = docs.sparkSession.sql(
        "SELECT path, domain, pos, key, value FROM {parsed}, LATERAL variant_explode(doc) "
        f"WHERE key IS NOT NULL AND NOT arrays_overlap(json_object_keys(text), array({structured}))",
        parsed=parsed,
    )
    kind = F.schema_of_variant("value")
    number = F.try_variant_get("value", "$", "double")
    hint = (
        F.when(kind == "BOOLEAN", "boolean")
        .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), "real")
        .when(kind == "STRING", "string")
    )
    numeric = F.col("hint").isin("integer", "real")
    return (
        fields.withColumns({"hint": hint, "number": number})
        .where("hint IS NOT NULL")
        .select(
            extract.fact_row(
                kind=F.lit("state_variable"), domain=F.col("domain"), symbol=F.col("key"),
                description=F.concat(F.lit("configuration value '"), F.col("key"), F.lit("'")),
                type_hint=F.col("hint"),
                bounds=F.when(numeric, F.struct(F.col("number").alias("lo"), F.col("number").alias("hi"))),
                path=F.col("path"), position=F.col("pos"), confidence=F.lit(FLAT_CONFIDENCE),
            )
        )
    )


_ITEM = (
    "array<struct<symbol:string,name:string,description:string,type_hint:string,type:string,unit:string,"
    "bounds:array<double>,confidence:double,expression:string,variables:array<string>,lhs:string,rhs:string>>"
)


def structured_facts(docs: DataFrame) -> DataFrame:
    """Facts of JSON documents that list variables, boundaries and equations; incomplete entries are skipped.

    A document is parsed once, and its three lists become one array of facts.
    """
    schema = "struct<" + ",".join(f"{k}:{_ITEM}" for k in STRUCTURED_KEYS) + ">"
    doc = docs.select("path", "domain", parsed_once(F.from_json("text", schema)).alias("d"))

    def facts(first: str, alias: str, complete: Callable[[Column], Column], columns: Callable[[Column], dict[str, Column]]) -> Column:
        def fact(e: Column, place: Column) -> Column:
            common = {
                "domain": F.col("domain"), "path": F.col("path"), "position": place,
                "confidence": F.coalesce(e["confidence"], F.lit(STRUCTURED_CONFIDENCE)),
            }
            return F.when(complete(e), F.struct(*extract.fact_row(**columns(e), **common)))

        listed = F.array_compact(F.transform(F.coalesce(f"d.{first}", f"d.{alias}"), fact))
        return F.coalesce(listed, F.filter(F.array(F.struct(*extract.fact_row())), lambda _: F.lit(False)))

    def variables(e: Column) -> Column:
        return F.coalesce(e["variables"], F.array().cast("array<string>"))

    def bounds(e: Column) -> Column:
        both = F.struct(F.get(e["bounds"], F.lit(0)).alias("lo"), F.get(e["bounds"], F.lit(1)).alias("hi"))
        return F.when(F.size(e["bounds"]) == 2, both)

    state = facts(
        "state_variables", "variables", lambda e: F.coalesce(e["symbol"], e["name"]).isNotNull(),
        lambda e: {
            "kind": F.lit("state_variable"), "symbol": F.coalesce(e["symbol"], e["name"]), "description": F.coalesce(e["description"], F.lit("")),
            "type_hint": F.coalesce(e["type_hint"], e["type"], F.lit("unknown")), "unit": e["unit"], "bounds": bounds(e),
        },
    )
    bound = facts(
        "boundaries", "constraints", lambda e: e["expression"].isNotNull(),
        lambda e: {
            "kind": F.lit("boundary"), "symbol": F.coalesce(e["symbol"], e["name"], F.lit("boundary")),
            "description": F.coalesce(e["description"], e["expression"]), "expression": e["expression"], "variables": variables(e),
        },
    )
    equation = facts(
        "equations", "equations", lambda e: e["lhs"].isNotNull() & e["rhs"].isNotNull(),
        lambda e: {
            "kind": F.lit("equation"), "symbol": F.coalesce(e["symbol"], e["lhs"]),
            "expression": F.coalesce(e["expression"], F.concat(e["lhs"], F.lit(" = "), e["rhs"])), "lhs": e["lhs"], "rhs": e["rhs"],
            "variables": variables(e),
        },
    )
    return doc.select(F.inline(F.concat(state, bound, equation)))


def parsed_once(value: Column) -> Column:
    """The value as the row of a generator: conditions on its fields can't be pushed below it and parse again."""
    return F.explode(F.array(value))


_RUSTC = (
    "struct<`$message_type`:string,message:string,level:string,code:struct<code:string>,"
    "spans:array<struct<file_name:string,line_start:int,column_start:int,byte_start:int,byte_end:int,is_primary:boolean>>>"
)


def rustc_diagnostics(lines: DataFrame, keys: Sequence[str] = (), errors_only: bool = True) -> DataFrame:
    """Diagnostics of JSON lines: the primary span, else the first; lines without a span are dropped."""
    parsed = lines.where(F.ltrim("line").startswith("{")).select(*keys, parsed_once(F.from_json("line", _RUSTC)).alias("d"))
    level = F.coalesce("d.level", F.lit("error"))
    span = F.coalesce(F.get(F.filter("d.spans", lambda s: s["is_primary"]), F.lit(0)), F.get("d.spans", F.lit(0)))
    kept = parsed.where(
        (F.coalesce(F.col("d.`$message_type`"), F.lit("diagnostic")) == "diagnostic") & F.col("d.message").isNotNull()
    ).withColumns({"s": span, "level": level})
    if errors_only:
        kept = kept.where("level = 'error'")
    return kept.where("s IS NOT NULL").select(
        *keys, F.col("d.message").alias("message"), F.coalesce("s.file_name", F.lit("")).alias("file"),
        F.col("d.code.code").alias("code"), F.col("level").alias("severity"),
        F.coalesce("s.line_start", F.lit(1)).alias("line"), F.coalesce("s.column_start", F.lit(1)).alias("column"),
        F.col("s.byte_start").alias("start_byte"), F.col("s.byte_end").alias("end_byte"), F.lit("rustc").alias("source"),
    )


_PLACE = "struct<file:string,line:int,column:int,`byte-column`:int>"
_GCC = f"array<struct<kind:string,message:string,option:string,locations:array<struct<caret:{_PLACE},finish:{_PLACE}>>>>"


#: From the last match on to a closed array that another one follows; brackets in strings are passed over. No quantifier
#: gives back, so long texts need no stack.
_NEXT_ARRAY = r'\G((?:[^"\]]++|"(?:[^"\\]|\\.)*+"|\](?!\s*\[))*+\])\s*(?=\[)'


def gcc_diagnostics(outputs: DataFrame, keys: Sequence[str] = (), errors_only: bool = True) -> DataFrame:
    """Diagnostics of JSON arrays, one per translation unit, possibly several in one text."""
    # The compiler starts each array on a line of its own; inside a message a line break is escaped.
    # Outputs joined without line breaks are split where an array meets the next one outside strings.
    arrays = F.split(T.strip(F.col("text")), r"(?<=\])[^\S\n]*\n\s*(?=\[)")
    arrays = F.flatten(F.transform(arrays, lambda a: F.split(F.regexp_replace(a, _NEXT_ARRAY, "$1\x1e"), "\x1e")))
    parsed = outputs.select(*keys, F.explode(arrays).alias("_array"))
    items = parsed.select(*keys, F.explode(F.from_json("_array", _GCC)).alias("d"))
    kind = F.coalesce("d.kind", F.lit("error"))
    place = F.get("d.locations", F.lit(0))
    rows = items.withColumns({"severity": kind, "p": place})
    if errors_only:
        rows = rows.where("severity = 'error'")
    return rows.select(
        *keys, F.coalesce("d.message", F.lit("")).alias("message"), F.coalesce("p.caret.file", F.lit("")).alias("file"),
        F.col("d.option").alias("code"), "severity", F.coalesce("p.caret.line", F.lit(1)).alias("line"),
        F.coalesce("p.caret.column", F.lit(1)).alias("column"), F.col("p.caret.`byte-column`").alias("start_byte"),
        F.col("p.finish.`byte-column`").alias("end_byte"), F.lit("gcc").alias("source"),
    )


def language_server_actions(payloads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Action rows of published diagnostics: severity 1 or 2 (missing counts as 1) and known codes."""
    raw = F.col("payload")
    body = F.when(F.contains(raw, F.lit("\r\n\r\n")), F.substring_index(raw, "\r\n\r\n", -1)).when(
        F.contains(raw, F.lit("\n\n")), F.substring_index(raw, "\n\n", -1)
    ).otherwise(raw)
    schema = (
        "struct<method:string,params:struct<uri:string,diagnostics:array<struct<severity:int,code:variant,message:string,source:string>>>>"
    )
    published = payloads.select(*keys, F.from_json(body, schema).alias("m")).where(
        F.col("m.method") == diagnostics.PUBLISH_METHOD
    )
    rows = published.select(*keys, F.col("m.params.uri").alias("uri"), F.posexplode("m.params.diagnostics").alias("position", "d"))
    rows = rows.withColumn("severity", F.coalesce("d.severity", F.lit(1))).where(F.col("severity").isin(1, 2))
    code = diagnostics.normalized_code(F.col("d.code"))
    return (
        rows.withColumn("code", code)
        .withColumn("action", diagnostics.action_for(F.col("code")))
        .where("action IS NOT NULL")
        .select(
            *keys, "position", diagnostics.uri_to_path(F.col("uri")).alias("file_path"), "action", "code",
            diagnostics.first_symbol(F.coalesce("d.message", F.lit(""))).alias("symbol"),
            F.coalesce("d.message", F.lit("")).alias("message"), "severity", F.col("d.source").alias("source"),
        )
    )


def performance_vectors(rows: DataFrame, fields: str, name: str = "vector") -> DataFrame:
    """Objective vector (accuracy, inverse seconds, compression) of a string map of measurements."""
    success = F.try_element_at(fields, F.lit("success"))
    truthy = F.when(success.isNotNull(), (~F.lower(success).isin("false", "0", "", "none", "null")).cast("double"))

    def first(keys: Sequence[str]) -> Column:
        return scores.first_numeric(F.col(fields), keys)

    # One column per measurement, so that none is computed more than once.
    measured = rows.withColumns(
        {
            "_accuracy": F.coalesce(first(ACCURACY_KEYS), truthy),
            "_seconds": F.coalesce(first(SECONDS_KEYS), first(MILLIS_KEYS) / 1e3, first(MICROS_KEYS) / 1e6),
            "_compression": first(COMPRESSION_KEYS),
        }
    )
    raw = F.array("_accuracy", scores.inverse_seconds(F.col("_seconds")), "_compression")
    return measured.withColumn("_raw", raw).withColumn(name, scores.objective_vector(F.col("_raw"))).drop(
        "_accuracy", "_seconds", "_compression", "_raw"
    )


def run_metrics(text: Column, doc: Column | None = None) -> dict[str, Column]:
    """Metrics of run output: JSON keys first, ``name = number`` as fallback; ``doc`` is the text's JSON if known."""
    doc = embedded_json(text) if doc is None else doc

    def from_json(key: str) -> Column:
        return F.try_variant_get(doc, f"$.{key}", "double")

    def from_text(key: str) -> Column:
        found = F.regexp_extract(text, rf"(?i){key}\s*[=:]\s*({T.NUMBER})", 1)
        return F.nullif(found, F.lit("")).try_cast("double")

    json_value = {k: from_json(k) for k in METRIC_KEYS}
    json_value["accuracy"] = F.coalesce(from_json("accuracy_error"), from_json("accuracy"))
    return {k: F.coalesce(json_value[k], from_text(k)) for k in METRIC_KEYS}


def with_run_metrics(runs: DataFrame, text: str = "text") -> DataFrame:
    """Add the metrics of run output; a text's JSON is found and parsed once, however many metrics are asked of it."""
    parsed = runs.select("*", parsed_once(F.struct(embedded_json(F.col(text)).alias("doc"))).alias("_json"))
    return parsed.withColumns(run_metrics(F.col(text), F.col("_json.doc"))).drop("_json")


_CASES = "struct<passed:boolean,cases:array<struct<name:string,passed:boolean,error:double>>>"


def _report(text: Column) -> Column:
    """Validation report of a text; a JSON object always runs from its first to its last brace."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & (end > start), F.from_json(F.substring(text, start, end - start + 1), _CASES))


def validation_cases(outputs: DataFrame, tolerance: float, key: str = "run_id") -> DataFrame:
    """Cases of validation runs in (key, text) from a JSON report, else from PASS/FAIL or error lines."""
    parsed = outputs.select("*", parsed_once(_report(F.col("text"))).alias("report")).withColumn(
        "is_json", F.col("report.cases").isNotNull()
    )
    listed = parsed.where("is_json").select(key, F.posexplode("report.cases").alias("position", "c")).select(
        key, "position", F.coalesce("c.name", F.lit("case")).alias("name"),
        F.coalesce("c.passed", F.abs("c.error") <= tolerance, F.lit(False)).alias("passed"), F.col("c.error").alias("error"),
    )
    lines = parsed.where("NOT is_json").select(key, F.posexplode(T.split_lines(F.col("text"))).alias("position", "line"))
    verdict_re = r"(?i)^\s*([\w./\-]+)\s*[:=]\s*(PASS|FAIL|OK|ERROR)\b"
    error_re = rf"(?i)^\s*([\w./\-]+)\s+.*?error\s*[=:]\s*({T.NUMBER})"
    verdict = F.upper(F.regexp_extract("line", verdict_re, 2))
    error = F.nullif(F.regexp_extract("line", error_re, 2), F.lit("")).try_cast("double")
    judged = lines.select(
        key, "position",
        F.when(verdict != "", F.regexp_extract("line", verdict_re, 1)).otherwise(F.regexp_extract("line", error_re, 1)).alias("name"),
        F.when(verdict != "", verdict.isin("PASS", "OK")).otherwise(F.abs(error) <= tolerance).alias("passed"),
        F.when(verdict == "", error).alias("error"),
    ).where("name <> ''")
    return listed.unionByName(judged)


def validation_report(outputs: DataFrame, tolerance: float, key: str = "run_id") -> DataFrame:
    """Passed, failed and overall per run in (key, text, returncode).

    A JSON report without cases fails; plain text without cases follows the exit code.
    """
    cases = validation_cases(outputs.select(key, "text"), tolerance, key).groupBy(key).agg(
        F.count_if("passed").alias("num_passed"), F.count_if(~F.col("passed")).alias("num_failed")
    )
    runs = outputs.select(key, "returncode", parsed_once(_report(F.col("text"))).alias("report"))
    has_cases = F.col("num_passed").isNotNull()
    overall = (
        F.when(F.col("report.cases").isNotNull(), has_cases & F.coalesce("report.passed", F.col("num_failed") == 0))
        .when(has_cases, F.col("num_failed") == 0)
        .otherwise(F.col("returncode") == 0)
    )
    return runs.join(cases, key, "left").select(
        key, F.coalesce("num_passed", F.lit(0)).alias("num_passed"), F.coalesce("num_failed", F.lit(0)).alias("num_failed"),
        overall.alias("passed"),
    )
