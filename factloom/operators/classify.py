"""Row-local classification: domains, languages by name, cold names, decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions import text as T
from factloom.operators.resolve import contained_names
from factloom.session import cut_lineage

# Language hints in names, first hit wins; tokens that only name a language.
NAME_HINTS = [
    ("cpp", ["cpp", "cxx", "cplus", "cc"]),
    ("rust", ["rust", "_rs", "rs_", "cargo"]),
    ("python", ["python", "py_", "_py", "dashboard", "ui", "web", "flask", "django", "panel", "notebook"]),
    ("fortran", ["fortran", "f90"]),
    ("c", ["c_core", "clang", "_c_"]),
]
LANGUAGE_TOKENS = ["cpp", "rust", "python", "py", "c", "fortran"]
# Paths of configuration and user-interface files.
COLD_NAMES = (
    r"(?i)(config|settings|\.env|constants|setup\.py|setup\.cfg|package\.json|tsconfig|\.eslintrc|webpack"
    r"|Cargo\.toml|Cargo\.lock|build\.rs|template|component|\.html|\.css|\.scss|render\s*\()"
)
# Signs of code that wants a higher precision, in order.
TRANSCENDENTAL = [
    "exp", "log", "log10", "log2", "pow", "sqrt", "sin", "cos", "tan", "sinh", "cosh", "tanh", "expm1", "erf", "gamma",
]
ITERATIVE = [
    "solve", "solver", "iterate", "newton", "gmres", "bicg", "conjugate_gradient", "_cg", "jacobi", "gauss_seidel",
    "relax", "converge", "fixed_point", "krylov",
]
CONDITIONING = [
    "inverse", "inv(", "matmul", "matrix_mul", "determinant", "det(", "eig", "eigen", "lu_decomp", "cholesky", "svd",
    "condition_number", "linsolve",
]


def any_contains(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def domain_scores(text: Column, lexicon: Mapping[str, Sequence[str]] = fixed.DOMAIN_KEYWORDS) -> Column:
    """Array of keyword counts per domain, in lexicon order. ``text`` must be in lower case."""

    def total(words: Sequence[str]) -> Column:
        out = F.lit(0).cast("long")
        for word in words:
            out = out + T.occurrences(text, word)
        return out

    return F.array(*[total(words) for words in lexicon.values()])


def with_domain(
    docs: DataFrame, text: str = "text", fmt: str | None = None, lexicon: Mapping[str, Sequence[str]] = fixed.DOMAIN_KEYWORDS,
    default: str = fixed.DEFAULT_DOMAIN,
) -> DataFrame:
    """Add ``domain``: most keywords, an earlier domain wins a tie, code keeps its own format.

    The scores are one array column, so the keywords are counted once per text.
    """
    scored = docs.withColumn("_scores", domain_scores(F.lower(F.col(text)), lexicon))
    best = F.array_max("_scores")
    names = F.array(*[F.lit(n) for n in lexicon])
    prose = F.when(best > 0, F.element_at(names, F.array_position("_scores", best).cast("int"))).otherwise(F.lit(default))
    domain = prose if fmt is None else F.when(F.col(fmt).startswith("code:"), F.col(fmt)).otherwise(prose)
    return scored.withColumn("domain", domain).drop("_scores")


def make_id(domain: Column, symbol: Column) -> Column:
    return F.concat_ws("::", domain, symbol)


def language_by_name(name: Column, hints: Sequence[tuple[str, Sequence[str]]] = NAME_HINTS) -> Column:
    lowered = F.lower(name)
    chain = F.when(F.lit(False), F.lit(""))
    for language, words in hints:
        chain = chain.when(any_contains(lowered, words), F.lit(language))
    return chain.otherwise("unknown")


def name_tokens(name: Column) -> Column:
    """Tokens of a target name without pure language tokens, or all tokens when none is left."""
    tokens = F.filter(F.split(F.lower(F.replace(name, F.lit("-"), F.lit("_"))), "_"), lambda t: t != "")
    meaningful = F.filter(tokens, lambda t: ~t.isin(LANGUAGE_TOKENS))
    return F.when(F.size(meaningful) > 0, meaningful).otherwise(tokens)


def located_sources(targets: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files of a target's project whose path contains one of the target's name tokens.

    Names and paths are matched once per project, by equality of what a path holds with the tokens;
    only the pairs found meet the rows that have them.
    """
    keys = list(keys)
    named = targets.select(*keys, "name").distinct()
    tokens = named.select(*keys, F.col("name").alias("phrase_id"), F.explode(name_tokens(F.col("name"))).alias("phrase"))
    paths = files.select(*keys, F.col("path").alias("doc_id"), F.lower("path").alias("text")).distinct()
    found = contained_names(paths, tokens, keys).withColumnsRenamed({"doc_id": "path", "phrase_id": "name"})
    pairs = cut_lineage(found)
    columns = [*keys, *[c for df in (targets, files) for c in df.columns if c not in keys]]
    return targets.join(pairs, [*keys, "name"]).join(files, [*keys, "path"]).select(*columns)


def is_cold_by_name(path: Column) -> Column:
    return path.rlike(COLD_NAMES)


def precision_reason(name: Column, text: Column, is_call: Column) -> Column:
    """First matching reason why a node may need a higher precision."""
    n, t = F.lower(name), F.lower(text)
    return (
        F.when(is_call & n.isin(TRANSCENDENTAL), F.concat(F.lit("transcendental call '"), n, F.lit("' accumulates rounding error")))
        .when(any_contains(n, ITERATIVE) | any_contains(t, ITERATIVE), F.lit("iterative solver pattern is sensitive to precision"))
        .when(any_contains(n, CONDITIONING) | any_contains(t, CONDITIONING), F.lit("linear-algebra op may be ill-conditioned"))
    )


def first_reason(nodes: DataFrame, key: str, order: str, reason: Column) -> DataFrame:
    """First reason per file; the earliest node with one decides."""
    return (
        nodes.withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .groupBy(key)
        .agg(F.min_by("reason", order).alias("reason"))
    )


def split_plan(functions: DataFrame, max_complexity: int, max_lines: int) -> DataFrame:
    """Functions to move out of their file: over-complex ones, or all top-level ones of a large file.

    ``functions`` has (path, name, start, complexity, top_level, line_count); the first function
    of a name in a file wins.
    """
    reason = F.when(F.col("complexity") > max_complexity, "complexity").when(F.col("line_count") > max_lines, "file_size")
    return (
        functions.where(F.col("top_level") & (F.col("name") != "anonymous"))
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .groupBy("path", "name")
        .agg(F.min_by("reason", "start").alias("reason"), F.min("start").alias("start"))
    )


def accepted_variants(variants: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Variants that compile, keep the accuracy and beat the speed of their baseline row."""
    was = baseline.select(key, F.col("accuracy").alias("base_accuracy"), F.col("velocity").alias("base_velocity"))
    return (
        variants.where("compile_success")
        .join(was, key)
        .where((F.col("accuracy") >= F.col("base_accuracy")) & (F.col("velocity") > F.col("base_velocity")))
    )


def blended(candidates: DataFrame, measured: DataFrame, key: str, objectives: Sequence[str], weight: float) -> DataFrame:
    """Candidate fitness map extended with weighted runtime objectives, where measured."""
    values = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(f"runtime_{o}") for o in objectives]), F.array(*[F.col(o).cast("double") * weight for o in objectives])
        ),
        lambda _, v: v.isNotNull(),
    )
    extra = measured.select(key, values.alias("_extra"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    joined = candidates.join(extra, key, "left")
    kept = F.map_filter("fitness", lambda k, _: ~F.coalesce(F.map_contains_key("_extra", k), F.lit(False)))
    return joined.withColumn("fitness", F.map_concat(kept, F.coalesce("_extra", empty))).drop("_extra")
