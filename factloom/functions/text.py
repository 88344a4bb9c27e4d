"""Column functions over text: fingerprints, entropies, normal forms, number tokens.

All of them are row-local, so none needs a shuffle however large a corpus is.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes, and the separators str.splitlines() knows.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
# Number syntax of run output, length of a log excerpt, and its two notes.
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
MAX_LOG_LINES = 40
OMITTED_NOTE = ("  ... (", " more lines omitted)")
EMPTY_LOG_NOTE = "(no output from compiler)"

# Default limits of the entropy gate.
MIN_TOKEN_ENTROPY = 3.0
MIN_LINE_ENTROPY = 2.5
MIN_DIVERSITY = 0.4


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def tokens(text: Column) -> Column:
    """Whitespace tokens without the empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def stripped_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def split_lines(text: Column) -> Column:
    """Lines on every line separator; a trailing separator opens no further line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fingerprint(text: Column, hex_digits: int = 64) -> Column:
    return F.left(F.sha2(text, 256), F.lit(hex_digits))


def semantic_fingerprint(text: Column) -> Column:
    """SHA-256 prefix that comments and whitespace do not change."""
    bare = F.regexp_replace(text, r"(?md)#.*$", "")
    bare = F.regexp_replace(bare, r"(?md)//.*$", "")
    bare = F.regexp_replace(bare, r"(?s)/\*.*?\*/", "")
    return fingerprint(strip(F.regexp_replace(bare, r"(?U)\s+", " ")), 32)


def parameter_fingerprint(text: Column) -> Column:
    """Fingerprint of the quoted strings and integers of a text, in sorted order."""
    found = F.regexp_extract_all(text, F.lit(r'(?U)"[^"]*"|\b\d+\b'), F.lit(0))
    return fingerprint(F.array_join(F.sort_array(found), "|"), 16)


def array_entropy(items: Column) -> Column:
    """Base-2 Shannon entropy of an array's value distribution; an empty array gives 0.

    Sorting puts equal values side by side, so one pass over run lengths is enough and
    no token ever leaves its row.
    """

    def closed(run: Column) -> Column:
        return F.when(run > 1, run * F.log2(run)).otherwise(F.lit(0.0))

    start = F.struct(
        F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("acc")
    )

    def step(state: Column, item: Column) -> Column:
        same = state["last"].eqNullSafe(item)
        return F.struct(
            item.alias("last"),
            F.when(same, state["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, state["acc"]).otherwise(state["acc"] + closed(state["run"])).alias("acc"),
        )

    n = F.size(items).cast("double")
    weighted = F.aggregate(F.sort_array(items), start, step, lambda s: s["acc"] + closed(s["run"]))
    # Twelve digits drop the noise of the logarithms, so an entropy of exactly 3 meets a limit of 3.
    return F.when(F.size(items) > 0, F.round(F.log2(n) - weighted / n, 12)).otherwise(F.lit(0.0))


def token_entropy(text: Column) -> Column:
    return array_entropy(tokens(text))


def line_entropy(text: Column) -> Column:
    return array_entropy(stripped_lines(text))


def structural_diversity(text: Column, block_start: str = r"\[task:", ignored: tuple[str, ...] = ("[task:", "needs =")) -> Column:
    """Share of distinct block bodies; ``block_start`` opens a block, ``ignored`` prefixes are dropped."""

    def body(block: Column) -> Column:
        def kept(line: Column) -> Column:
            return ~functools.reduce(operator.or_, [line.startswith(p) for p in ignored], F.lit(False))

        return F.array_join(F.filter(stripped_lines(block), kept), "\n")

    bodies = F.filter(F.transform(F.split(text, f"(?={block_start})"), body), lambda b: b != "")
    return F.when(F.size(bodies) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_distinct(bodies)) / F.size(bodies)
    )


def normalized_body(text: Column) -> Column:
    """Outer whitespace removed and every line right-trimmed."""
    return F.array_join(F.transform(split_lines(strip(text)), lambda x: F.rtrim(x, F.lit(WHITESPACE))), "\n")


def number_tokens(text: Column) -> Column:
    """Every number of a text as a double."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: x.try_cast("double"))


def canonical_hash(fields: Column) -> Column:
    """Hash of a string map that does not depend on the order of its keys."""
    ordered = F.map_from_entries(F.sort_array(F.map_entries(fields)))
    return F.sha2(F.to_json(ordered), 256)


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def clean_log(text: Column, max_lines: int = MAX_LOG_LINES) -> Column:
    """Log text without colour codes and trailing blanks; lines past the limit become a count."""
    cleaned = F.rtrim(strip_ansi(text), F.lit(WHITESPACE))
    lines = split_lines(cleaned)
    extra = F.size(lines) - max_lines
    note = F.concat(F.lit(OMITTED_NOTE[0]), extra.cast("string"), F.lit(OMITTED_NOTE[1]))
    return (
        F.when(cleaned == "", F.lit(EMPTY_LOG_NOTE))
        .when(extra > 0, F.array_join(F.array_append(F.slice(lines, 1, max_lines), note), "\n"))
        .otherwise(cleaned)
    )
