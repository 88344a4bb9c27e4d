"""Extraction of facts, imports, kernels, bindings and risky spans from texts.

Spark's regex functions return matches but no offsets, and line numbers need them. One small
Arrow helper finds all matches with their line; a cheap JVM filter keeps texts without a cue
away from it, and everything after the match is ordinary column work.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

# Cue phrases of prose facts.
IDENT = r"[A-Za-z][A-Za-z0-9_]*"
NUMBER = r"\d+(?:\.\d+)?"
LET_BE = rf"\blet\s+({IDENT})\s+be\s+([^.,;\n]+)"
WHERE_IS = rf"\bwhere\s+({IDENT})\s+(?:denotes|represents|is)\s+([^.,;\n]+)"
BETWEEN = rf"({IDENT})\s+must\s+(?:remain\s+|be\s+)?between\s+({NUMBER})\s+and\s+({NUMBER})"
BOUNDS = [
    (rf"({IDENT})\s+must\s+not\s+exceed\s+({NUMBER})", "<="),
    (rf"({IDENT})\s+must\s+(?:remain\s+|be\s+)?(?:below|under)\s+({NUMBER})", "<"),
    (rf"({IDENT})\s+must\s+(?:remain\s+|be\s+)?(?:above|over|at\s+least)\s+({NUMBER})", ">"),
]
EQUATION = rf"({IDENT})\s*=\s*((?:\d+\.\d+|[^.\n;])+)"
PROSE_CONFIDENCE = {"state_variable": 0.7, "boundary": 0.7, "equation": 0.6}

# Declarations of C and C++ sources.
C_IDENT = r"[A-Za-z_]\w*"
C_DEFINE = rf"^\s*#\s*define\s+({C_IDENT})\s+(\S.*)$"
C_CONST = rf"\bconst\s+[\w:<>]+\s+({C_IDENT})\s*=\s*([^;]+);"
C_ASSERT = r"\bassert\s*\(\s*([^;]+?)\s*\)\s*;"
C_NUMBER = r"^-?\d+(\.\d+)?[fFlL]?$"
C_CONFIDENCE = 0.85

# Import statements by language.
IMPORTS = {
    "python": r"^[ \t]*(?:import\s+([a-zA-Z_][a-zA-Z0-9_.]*)|from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import)",
    "rust": r"^[ \t]*use\s+([a-zA-Z_][a-zA-Z0-9_:*]*)",
}
# Kernel definitions and launches.
KERNEL = r"__global__\s+[\w:<>\*&\s]+?\b(\w+)\s*\("
LAUNCH = r"\b(\w+)\s*<<<"

# Text patterns that make a function risky to translate.
UNSAFE = (
    r"(?i)(__asm__|__attribute__|volatile|register\s|ctypes\.CDLL|ctypes\.windll|ctypes\.cdll|cffi\.FFI|ffi\.cdef"
    r"|ffi\.dlopen|mmap\.mmap|POINTER\(|byref\(|addressof\(|cast\(|\.cuda\(\)|\.to\(['\"]cuda|cuda\.synchronize"
    r"|numba\.jit|numba\.cuda|@jit|@cuda\.jit)"
)
# Lower-case words of which any match holds one.
RISK_CUES = {
    "unsafe_pattern": [
        "__asm__", "__attribute__", "volatile", "register", "ctypes.", "ffi.", "mmap.mmap", "pointer(", "byref(", "addressof(", "cast(",
        "cuda", "numba.", "@jit",
    ],
}
RUST_MEMORY = (
    r"(unsafe\s*\{|unsafe\s+fn|unsafe\s+impl|\*mut\s|\*const\s|ManuallyDrop|MaybeUninit|NonNull|std::alloc::|alloc::"
    r"|dealloc|Layout::from_size_align|std::mem::transmute|std::mem::forget|mem::transmute|mem::forget|std::ptr::"
    r"|ptr::null|ptr::write|ptr::read|Box::from_raw|Box::into_raw|Arc::from_raw|Rc::from_raw|Pin<|Unpin)"
)
RUST_THREADING = (
    r"(std::thread|thread::spawn|thread::JoinHandle|std::sync::|Mutex<|RwLock<|Arc<.*Mutex|Condvar|Barrier|tokio::"
    r"|async_std::|futures::|rayon::|crossbeam::|async\s+fn|async\s+move|\.await)"
)
RUST_LIFETIME = r"(<'[a-z]|&'[a-z]|where\s.*'[a-z]\s*:)"
RISKS = {
    "python": {"unsafe_pattern": UNSAFE},
    "rust": {"rust_memory": RUST_MEMORY, "rust_threading": RUST_THREADING, "rust_lifetime": RUST_LIFETIME},
}
# Risks of prose: the same operator with other patterns.
PROSE_RISKS = {"email": r"[\w.+-]+@[\w-]+\.[\w.]+", "long_number": r"[0-9]{6,}", "shout": r"\b[A-Z]{4,}\b"}
DETAIL_CHARS = 50

FACT_COLUMNS = {
    "kind": "string", "domain": "string", "symbol": "string", "description": "string", "type_hint": "string",
    "unit": "string", "bounds": "struct<lo:double,hi:double>", "expression": "string", "lhs": "string", "rhs": "string",
    "variables": "array<string>", "path": "string", "line": "int", "position": "int", "confidence": "double",
}


def fact_row(**columns: Column) -> list[Column]:
    """The fixed fact columns, null where not given."""
    return [columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in FACT_COLUMNS.items()]


class Rule(NamedTuple):
    """A pattern with a cue that any text with a match holds, and the fact columns a match gives."""

    name: str
    pattern: str
    cue: str
    flags: int
    columns: dict[str, Column]


def _found(text: Column, rules: Sequence[Rule]) -> Column:
    """All matches of all rules as structs of rule, start, end, 1-based line and groups (group 0 first)."""
    compiled = [(r.name, re.compile(r.pattern, r.flags), re.compile(r.cue)) for r in rules]

    @F.pandas_udf("array<struct<rule:string,start:int,end:int,line:int,groups:array<string>>>")
    def find(texts: pd.Series) -> pd.Series:
        def one(body: str | None) -> list[dict]:
            found = []
            for name, pattern, cue in compiled:
                if not body or not cue.search(body):
                    continue
                line, seen = 1, 0
                for m in pattern.finditer(body):
                    line += body.count("\n", seen, m.start())
                    seen = m.start()
                    found.append({"rule": name, "start": m.start(), "end": m.end(), "line": line, "groups": [m.group(0), *m.groups()]})
            return found

        return texts.map(one)

    return find(text)


def _matches(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per match of any rule; a text is read once, and only if it has one of the cues."""
    cued = functools.reduce(operator.or_, [F.col("text").rlike(cue) for cue in dict.fromkeys(r.cue for r in rules)])
    rows = docs.where(cued).withColumn("_m", F.explode(_found(F.col("text"), rules))).drop("text")
    return rows.withColumns({f: F.col(f"_m.{f}") for f in ("rule", "start", "end", "line", "groups")}).drop("_m")


def _facts(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Fact rows of all rules over (path, domain, text) documents, in one pass over the texts."""
    matches = _matches(docs, rules)
    columns = {"domain": F.col("domain"), "path": F.col("path"), "line": F.col("line"), "position": F.col("start")}
    for name, kind in FACT_COLUMNS.items():
        given = [F.when(F.col("rule") == r.name, r.columns[name].cast(kind)) for r in rules if name in r.columns]
        if given:
            columns[name] = F.coalesce(*given)
    return matches.select(fact_row(**columns))


def _group(i: int) -> Column:
    return T.strip(F.get(F.col("groups"), F.lit(i)))


def _distinct_variables(text: Column, ident: str, without: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(ident), F.lit(0))), lambda v: v != without)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _state_variable_rules() -> list[Rule]:
    columns = {
        "kind": F.lit("state_variable"), "symbol": _group(1), "description": _group(2), "type_hint": F.lit("unknown"),
        "confidence": F.lit(PROSE_CONFIDENCE["state_variable"]),
    }
    return [Rule(f"state_{i}", p, cue, re.IGNORECASE, columns) for i, (p, cue) in enumerate(((LET_BE, r"(?i)\blet\s"), (WHERE_IS, r"(?i)\bwhere\s")))]


def _boundary_rules() -> list[Rule]:
    def rule(name: str, pattern: str, expression: Column) -> Rule:
        columns = {
            "kind": F.lit("boundary"), "symbol": _group(1), "description": _group(0), "expression": expression,
            "variables": F.array(_group(1)), "confidence": F.lit(PROSE_CONFIDENCE["boundary"]),
        }
        return Rule(name, pattern, r"(?i)\smust\s", re.IGNORECASE, columns)

    between = rule("between", BETWEEN, F.concat(_group(2), F.lit(" <= "), _group(1), F.lit(" <= "), _group(3)))
    return [between, *[rule(f"bound_{i}", p, F.concat(_group(1), F.lit(f" {op} "), _group(2))) for i, (p, op) in enumerate(BOUNDS)]]


def _equation_rules() -> list[Rule]:
    columns = {
        "kind": F.when(_group(2) != "", "equation"), "symbol": _group(1), "expression": F.concat(_group(1), F.lit(" = "), _group(2)),
        "lhs": _group(1), "rhs": _group(2), "variables": _distinct_variables(_group(2), IDENT, _group(1)),
        "confidence": F.lit(PROSE_CONFIDENCE["equation"]),
    }
    return [Rule("equation", EQUATION, "=", 0, columns)]


def state_variables(docs: DataFrame) -> DataFrame:
    """``let x be ...`` and ``where x denotes ...`` of (path, domain, text) documents."""
    return _facts(docs, _state_variable_rules())


def boundaries(docs: DataFrame) -> DataFrame:
    """``x must ...`` limits as boundary expressions."""
    return _facts(docs, _boundary_rules())


def equations(docs: DataFrame) -> DataFrame:
    """``lhs = rhs``; a decimal point does not end the right side, and an empty one gives no fact."""
    return _facts(docs, _equation_rules()).where("kind IS NOT NULL")


def prose_facts(docs: DataFrame) -> DataFrame:
    """Facts of all three kinds, in one pass over the texts."""
    return _facts(docs, [*_state_variable_rules(), *_boundary_rules(), *_equation_rules()]).where("kind IS NOT NULL")


def c_facts(docs: DataFrame) -> DataFrame:
    """``#define``, ``const`` and ``assert`` of C-like sources, in one pass over the texts."""
    value, name = _group(2), _group(1)
    numeric, quoted = value.rlike(C_NUMBER), value.rlike('^".*"$')
    number = F.regexp_replace(value, "[fFlL]+$", "").try_cast("double")
    constant = numeric | quoted
    valued = {
        "kind": F.when(constant, "state_variable").otherwise("equation"), "symbol": name,
        "description": F.when(constant, F.concat(F.lit("constant '"), name, F.lit("'"))),
        "type_hint": F.when(quoted, "string").when(numeric & F.contains(value, F.lit(".")), "real").when(numeric, "integer"),
        "bounds": F.when(numeric & ~quoted, F.struct(number.alias("lo"), number.alias("hi"))),
        "expression": F.when(~constant, F.concat(name, F.lit(" = "), value)),
        "lhs": F.when(~constant, name), "rhs": F.when(~constant, value),
        "variables": F.when(~constant, _distinct_variables(value, C_IDENT, name)),
        "confidence": F.when(constant, C_CONFIDENCE).otherwise(C_CONFIDENCE - 0.15),
    }
    variables = F.regexp_extract_all(_group(1), F.lit(C_IDENT), F.lit(0))
    asserted = {
        "kind": F.lit("boundary"), "symbol": F.coalesce(F.get(variables, F.lit(0)), F.concat(F.lit("assert_"), F.col("line").cast("string"))),
        "description": F.concat(F.lit("assert("), _group(1), F.lit(")")), "expression": _group(1), "variables": variables,
        "confidence": F.lit(C_CONFIDENCE),
    }
    return _facts(
        docs,
        [
            Rule("define", C_DEFINE, r"#\s*define", re.MULTILINE, valued), Rule("const", C_CONST, r"\bconst\s", re.MULTILINE, valued),
            Rule("assert", C_ASSERT, r"\bassert\b", re.MULTILINE, asserted),
        ],
    )


def import_statements(files: DataFrame) -> DataFrame:
    """(path, line, module) of import lines in (path, language, text) files."""
    lines = files.select("path", "language", F.posexplode(T.split_lines(F.col("text"))).alias("pos", "body"))
    module = F.when(
        F.col("language") == "python",
        F.coalesce(
            F.nullif(F.regexp_extract("body", IMPORTS["python"], 1), F.lit("")),
            F.nullif(F.regexp_extract("body", IMPORTS["python"], 2), F.lit("")),
        ),
    ).when(F.col("language") == "rust", F.nullif(F.regexp_extract("body", IMPORTS["rust"], 1), F.lit("")))
    return lines.select("path", (F.col("pos") + 1).alias("line"), module.alias("module")).where("module IS NOT NULL")


def kernel_sites(files: DataFrame) -> DataFrame:
    """Kernel definitions and launch sites as (path, site, name, line); lines count from 0."""
    sites = [Rule("definition", KERNEL, "__global__", re.MULTILINE, {}), Rule("launch", LAUNCH, "<<<", re.MULTILINE, {})]
    return _matches(files.select("path", "text"), sites).select(
        "path", F.col("rule").alias("site"), _group(1).alias("name"), (F.col("line") - 1).alias("line"), "start"
    )


def foreign_bindings(nodes: DataFrame) -> DataFrame:
    """Bindings by pattern per language from (node, position, language, type, name, text) nodes.

    Native declarations overwrite by name (the last one wins) for rust and fortran; for C the
    first declaration of a name is kept.
    """
    text, kind = F.col("text"), F.col("type")
    fn_name = F.coalesce(F.nullif(F.regexp_extract("text", r"(?U)\bfn\s+(\w+)", 1), F.lit("")), F.col("name"))
    rust = nodes.where("language = 'rust'")
    columns = ["node", "position", F.col("key"), F.col("binding"), F.col("function_name"), F.col("bind_name")]
    none = F.lit(None).cast("string")

    def shaped(rows: DataFrame, key: Column, binding: str, function: Column, bind: Column = none) -> DataFrame:
        return rows.withColumns(
            {"key": key, "binding": F.lit(binding), "function_name": function, "bind_name": bind}
        ).where("key IS NOT NULL AND key <> ''").select(*columns)

    py = rust.where((kind == "function_item") & text.rlike(r"#\[pyfunction\]|#\[pyfn"))
    c_abi = rust.where(kind.isin("function_item", "function_signature_item") & F.contains(text, F.lit('extern "C"')))
    native = nodes.where(F.col("language").isin("c", "cpp"))
    linkage = native.where((kind == "linkage_specification") & F.contains(text, F.lit('"C"')))
    linked = linkage.withColumn("one", F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\b(\w+)\s*\("), F.lit(1))))
    declared = native.where((kind == "declaration") & F.ltrim(text, F.lit(T.WHITESPACE)).startswith("extern") & F.contains(text, F.lit("(")))
    fortran = nodes.where(
        (F.col("language") == "fortran")
        & kind.isin("function", "subroutine", "function_statement", "subroutine_statement")
        & text.rlike(r"(?i)bind\s*\(\s*c")
    )
    bind_name = F.coalesce(
        F.nullif(F.regexp_extract("text", r"(?i)bind\s*\(\s*c\s*,\s*name\s*=\s*[\"'](\w+)[\"']", 1), F.lit("")), F.col("name")
    )
    python = nodes.where((F.col("language") == "python") & (kind == "Call"))
    overwriting = [
        shaped(py, F.nullif(F.regexp_extract("text", r"(?U)\bfn\s+(\w+)", 1), F.lit("")), "pyo3_function", fn_name),
        shaped(c_abi, fn_name, "rust_extern_c", fn_name),
        shaped(fortran, bind_name, "fortran_c_abi", F.col("name"), bind_name),
    ]
    keeping = [
        shaped(linked, F.col("one"), "c_abi", F.col("one")),
        shaped(declared, F.nullif(F.regexp_extract("text", r"(?U)\b(\w+)\s*\(", 1), F.lit("")), "c_extern", F.regexp_extract("text", r"(?U)\b(\w+)\s*\(", 1)),
        shaped(python.where(text.rlike(r"\b(CDLL|WinDLL|cdll\.LoadLibrary|windll\.LoadLibrary)\b")), F.concat(F.lit("__ctypes_"), F.col("node").cast("string")), "python_ctypes", none),
        shaped(python.where(text.rlike(r"\bffi\.dlopen\b|\bcffi\.FFI\b|\bFFI\(\)")), F.concat(F.lit("__cffi_"), F.col("node").cast("string")), "python_cffi", none),
    ]
    rest = [F.struct(*[c for c in ("node", "binding", "function_name", "bind_name")])]
    last = _union(overwriting).groupBy("key").agg(F.max_by(rest[0], "position").alias("b"))
    first = _union(keeping).groupBy("key").agg(F.min_by(rest[0], "position").alias("b"))
    return last.unionByName(first.join(last, "key", "left_anti")).select(F.col("key").alias("name"), "b.*")


def pattern_hits(
    docs: DataFrame, patterns: Mapping[str, str], text: str = "text", cues: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Array column ``hits`` of (category, start, end, line, detail) per text.

    ``cues`` names lower-case words for a pattern of which any of its matches holds one, in either
    case; an ASCII text without any is not searched. Other texts have letters with several folds.
    """
    compiled = [(name, re.compile(p), (cues or {}).get(name)) for name, p in patterns.items()]

    @F.pandas_udf("array<struct<category:string,start:int,end:int,line:int,detail:string>>")
    def find(texts: pd.Series) -> pd.Series:
        def one(body: str | None) -> list[dict]:
            found = []
            lower = body.lower() if body and cues and body.isascii() else None
            for name, pattern, words in compiled:
                if words and lower is not None and not any([word in lower for word in words]):
                    continue
                line, seen = 1, 0
                for m in pattern.finditer(body or ""):
                    line += body.count("\n", seen, m.start())
                    seen = m.start()
                    found.append(
                        {"category": name, "start": m.start(), "end": m.end(), "line": line, "detail": m.group(0)[:DETAIL_CHARS]}
                    )
            return found

        return texts.map(one)

    return docs.withColumn("hits", find(F.col(text))).drop(text)


def chosen_spans(hits: DataFrame) -> DataFrame:
    """Greedy choice of spans that neither overlap nor touch, by (category, start)."""
    ordered = F.array_sort(F.transform("hits", lambda h: F.struct(h["category"].alias("category"), h["start"].alias("start"), h["end"].alias("end"))))
    none = F.array().cast("array<struct<category:string,start:int,end:int>>")
    chosen = F.aggregate(
        ordered,
        none,
        lambda taken, s: F.when(
            F.exists(taken, lambda r: ~((s["end"] < r["start"]) | (s["start"] > F.greatest(r["start"], r["end"])))), taken
        ).otherwise(F.array_append(taken, s)),
    )
    return hits.withColumns({"chosen": chosen, "n_hits": F.size("hits").cast("long")}).drop("hits")


def hot_cold_counts(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a risk are hot, the others cold."""
    return hits.groupBy(*keys).agg(F.count_if(F.size("hits") == 0).alias("hot"), F.count_if(F.size("hits") > 0).alias("cold"))
