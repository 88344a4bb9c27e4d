"""Classification of compiler and language-server messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The method that publishes diagnostics, and the action per diagnostic code.
PUBLISH_METHOD = "textDocument/publishDiagnostics"
CODE_ACTIONS = {
    "reportUndefinedVariable": "RESOLVE_UNDEFINED_SYMBOL",
    "reportMissingImports": "AUTO_REFLUX_IMPORT",
    "E0433": "INJECT_RUST_USE_DECLARATION",
    "E0405": "INJECT_RUST_USE_DECLARATION",
}
# Message shapes of version problems and type mismatches.
NO_METHOD = r"no method named `([^`]+)` found for [\w ]+ `([^`]+)`"
UNRESOLVED_IMPORT = r"unresolved import `([^`]+)`"
EXPECTED_FOUND = r"(?i)expected `?([\w:<>* ]+)`?,? *(?:but )?found `?([\w:<>* ]+)`?"
TYPE_MISMATCH = [
    r"(?i)cannot convert .* to .*",
    r"(?i)no (?:known )?conversion from .* to .*",
    r"(?i)incompatible (?:integer-to-pointer |pointer )?type",
    r"(?i)mismatched types?",
    EXPECTED_FOUND,
    r"(?i)argument of type .* is incompatible with parameter of type",
    r"(?i)invalid conversion from .* to .*",
]


def category(code: Column, message: Column) -> Column:
    """Category by ordered rules on code and message, the most specific first."""
    c = F.upper(F.coalesce(code, F.lit("")))
    raw = F.coalesce(message, F.lit(""))
    m = F.lower(raw)

    def has(*words: str) -> Column:
        hit = F.lit(True)
        for word in words:
            hit = hit & F.contains(m, F.lit(word))
        return hit

    slices = raw.rlike(r"expected `&\[") & raw.rlike(r"found `&\[\[")
    missing = (
        (c == "E0432") | has("unresolved import") | has("could not be resolved") | has("is not defined")
        | F.contains(c, F.lit("REPORTMISSINGIMPORTS")) | F.contains(c, F.lit("REPORTUNDEFINEDVARIABLE"))
    )
    immutable = c.isin("E0384", "E0594", "E0596") | has("cannot assign", "immutable") | has("cannot borrow", "as mutable")
    semicolon = has("expected ';'") | has("expected semi") | (c == "EXPECTED_SEMICOLON") | has("expected", "`;`")
    return (
        F.when(has("pymodule", "glob"), "pyo3_glob_import")
        .when(c.isin("E0433", "E0405"), "missing_crate")
        .when((c == "E0428") | has("is defined multiple times"), "duplicate_definition")
        .when(((c == "E0432") | has("unresolved import")) & has("super::"), "unresolved_parent_import")
        .when((c == "E0308") & slices, "mismatched_slice_type")
        .when(missing, "missing_import")
        .when(immutable, "immutable_assignment")
        .when(semicolon, "missing_semicolon")
    )


def normalized_code(code: Column) -> Column:
    """Code of a VARIANT that may be an object with ``value``, a number or a string."""
    is_object = F.schema_of_variant(code).startswith("OBJECT")
    plain = F.try_variant_get(code, "$", "string")
    return F.coalesce(F.when(is_object, F.try_variant_get(code, "$.value", "string")).otherwise(plain), F.lit(""))


def action_for(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CODE_ACTIONS.items() for x in pair])
    return F.try_element_at(table, code)


def first_symbol(message: Column) -> Column:
    """First quoted or back-ticked token of a message."""
    return F.nullif(F.trim(F.regexp_extract(message, "[\"'`]([^\"'`]+)[\"'`]", 1)), F.lit(""))


def leaf_symbol(message: Column) -> Column:
    """First back-ticked, else double-quoted token, reduced to its last path part."""
    ticked = F.nullif(F.regexp_extract(message, "`([^`]+)`", 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract(message, '"([^"]+)"', 1), F.lit(""))
    token = F.coalesce(ticked, quoted)
    return F.nullif(F.element_at(F.split(F.element_at(F.split(token, "::"), -1), r"\."), -1), F.lit(""))


def uri_to_path(uri: Column) -> Column:
    """Path of a ``file://`` URI with percent decoding, where ``+`` stays ``+``; other URIs stay."""
    path = F.regexp_replace(uri, r"^file://[^/]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith("file://"), decoded).otherwise(F.coalesce(uri, F.lit("")))


def version_problem(stderr: Column) -> dict[str, Column]:
    """Kind, method and receiver (or import path) of a version mismatch."""
    method = F.nullif(F.regexp_extract(stderr, NO_METHOD, 1), F.lit(""))
    receiver = F.regexp_extract(stderr, NO_METHOD, 2)
    path = F.nullif(F.regexp_extract(stderr, UNRESOLVED_IMPORT, 1), F.lit(""))
    cleaned = F.regexp_replace(F.ltrim(F.trim(receiver), F.lit("&")), r"^\s*mut\s+", "")
    cleaned = F.trim(F.regexp_replace(cleaned, r"<.*$", ""))
    return {
        "kind": F.when(method.isNotNull(), "method_not_found").when(path.isNotNull(), "unresolved_import"),
        "method": F.coalesce(method, F.lit("")),
        "receiver": F.when(method.isNotNull(), cleaned).otherwise(F.coalesce(path, F.lit(""))),
    }


def is_type_mismatch(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in TYPE_MISMATCH:
        hit = hit | text.rlike(pattern)
    return hit


def type_pair(text: Column) -> tuple[Column, Column]:
    """(expected, found) of a mismatch message, null when not stated."""
    expected = F.nullif(F.trim(F.regexp_extract(text, EXPECTED_FOUND, 1)), F.lit(""))
    found = F.nullif(F.trim(F.regexp_extract(text, EXPECTED_FOUND, 2)), F.lit(""))
    return expected, found
