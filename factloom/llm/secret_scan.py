"""Secret scans: one automaton for all rules, one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.automaton import Automaton, compile_rules, hits, reset_bytes
from factloom.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and longest; matches under ``least`` characters are dropped.

    ``head`` is the part before the measured one, matched in the same way; without it the whole
    match is measured. ``detect`` is the form the search looks for: a shorter beginning of a match, as
    counts of many bytes in several rules at once would multiply the states of their automaton.
    """

    kind: str
    pattern: str
    least: int
    fold: bool = False
    head: str = ""
    detect: str = ""


_KEY = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: Patterns of the base kinds and of published key formats: fixed values.
RULES = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]+", 12, fold=True, head=_KEY, detect=_KEY + "[A-Za-z0-9+/_.=-]"),
    Rule("access", "AKIA[A-Z0-9]+", 18, detect="AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]+", 16, detect="[0-9a-f]{16}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40, detect="gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20, detect="xox[abprs]-[A-Za-z0-9-]"),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39, detect="AIza[A-Za-z0-9_-]"),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 27),
)
BASE_KINDS = ("assign", "access", "hex")


@cache
def _compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, np.ndarray, list[Automaton], list[Automaton | None]]:
    search = compile_rules([(r.detect or r.pattern, r.fold) for r in rules], search=True)
    follow = [compile_rules([(r.pattern, r.fold)], search=False) for r in rules]
    heads = [compile_rules([(r.head, r.fold)], search=False) if r.head else None for r in rules]
    return search, reset_bytes(search), follow, heads


def _longest(automaton: Automaton, data: bytes, start: int, end: int) -> int:
    """End of the longest match from ``start``, or -1."""
    state, last = automaton.start, -1
    for i in range(start, end):
        state = automaton.step[state * 256 + data[i]]
        if state == automaton.dead:
            break
        if automaton.accepts[state]:
            last = i + 1
    return last


def _spans(rules: tuple[Rule, ...], data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, rule) of the matches in a stretch, leftmost and non-overlapping per rule."""
    _, _, follow, heads = _compiled(rules)
    for k, rule in enumerate(rules):
        first = follow[k].step[follow[k].start * 256 :][:256] != follow[k].dead
        at = start
        while at < end:
            stop = _longest(follow[k], data, at, end) if first[data[at]] else -1
            if stop < 0:
                at += 1
                continue
            measured = _longest(heads[k], data, at, stop) if heads[k] else at
            if stop - measured >= rule.least:
                yield at, stop, k
            at = stop


def find_spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Spans of every text in code points, by start, then by rule."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(encoded)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not joined:
        return found
    search, resets, _, _ = _compiled(rules)
    assert resets[10], "a rule spans lines"
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in encoded])
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    starts, ends = hits(search, data, resets)
    for start, end, doc in zip(starts, ends, np.searchsorted(bounds, starts, side="right") - 1, strict=True):
        base = int(bounds[doc])
        before = int(np.count_nonzero((data[base:start] & 0xC0) != 0x80))
        for a, b, k in _spans(rules, joined, int(start), int(end)):
            ahead = before + int(np.count_nonzero((data[start:a] & 0xC0) != 0x80))
            found[doc].append((ahead, ahead + b - a, k))  # a match is ASCII, so bytes are code points
    return [sorted(spans, key=lambda s: (s[0], s[2])) for spans in found]


#: Texts of a batch are scanned in runs of about so many characters, which bounds the memory of a task.
RUN_CHARS = 4_000_000


def _runs(texts: list[str]) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > RUN_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    yield run


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of (start, end, kind) of the secrets in a text, by start, then by rule order.

    Null and empty texts have none. Offsets are code points, ends exclusive.
    """

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def scan(batch: pd.Series) -> pd.Series:
        spans = [s for run in _runs(batch.tolist()) for s in find_spans(run, rules)]
        return pd.Series([[{"start": a, "end": b, "kind": rules[k].kind} for a, b, k in s] for s in spans], dtype=object)

    return scan(text_of(text))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, secrets) per input row; repeated rows are scanned alike, other columns are ignored."""
    return docs.select("doc_id", secret_spans(F.col("text"), rules).alias("secrets"))


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The same rows with each secret in ``text`` replaced by ``mark``; overlapping spans become one.

    ``n_chars`` follows where the table has it. A null text stays null.
    """

    @F.pandas_udf("string")
    def masked(batch: pd.Series) -> pd.Series:
        texts = batch.tolist()
        out, at = [], 0
        for run in _runs(["" if t is None else t for t in texts]):
            for text, spans in zip(texts[at : at + len(run)], find_spans(run, rules), strict=True):
                parts, done = [], 0
                for start, end, _ in spans:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                out.append(text if not spans else "".join(parts) + text[done:])
            at += len(run)
        return pd.Series(out, dtype=object)

    result = docs.withColumn("text", masked("text"))
    if "n_chars" in docs.columns:
        changed = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
        result = result.withColumn("n_chars", changed)
    return result.select(*docs.columns)


def listed(secrets: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, joined by commas."""
    chosen = secrets if kinds is None else F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
