"""Pluggable extractors and stage chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.operators import codefacts, extract
from factloom.operators.pages import text_pages
from factloom.sources import records

Extractor = Callable[[DataFrame], DataFrame]


def python_extractor(docs: DataFrame) -> DataFrame:
    code = codefacts.read_code(docs, ["domain"], parts=["nodes"], node_fields=codefacts.FACT_FIELDS)
    return codefacts.CodeFacts(code).facts(F.col("domain"))


def json_extractor(docs: DataFrame) -> DataFrame:
    return records.json_scalars(docs).unionByName(records.structured_facts(docs))


DEFAULT_EXTRACTORS: dict[str, Extractor] = {
    "code:python": python_extractor, "code:c": extract.c_facts, "code:cpp": extract.c_facts,
    "json": json_extractor, "text": extract.prose_facts,
}


def extract_facts(docs: DataFrame, extractors: Mapping[str, Extractor] = DEFAULT_EXTRACTORS) -> DataFrame:
    """Facts of (path, format, domain, text) documents, each format by its registered extractor."""
    out = None
    for fmt, extractor in extractors.items():
        facts = extractor(docs.where(F.col("format") == fmt).select("path", "domain", "text"))
        out = facts if out is None else out.unionByName(facts)
    if out is None:
        raise ValueError("no extractor is registered")
    return out


def with_fallback(
    docs: DataFrame, primary: Callable[[str], list[str]], fallback: Callable[[str], list[str]], text: str = "text"
) -> DataFrame:
    """Run a user function per text; on an error use the fallback and keep the error text."""
    kept = [c for c in docs.columns if c != text]
    added = StructType.fromDDL("items array<string>, used_fallback boolean, error string")
    schema = StructType([*docs.select(*kept).schema.fields, *added.fields])
    types = [f.type for f in to_arrow_schema(added)]

    def one(body: str) -> tuple[list[str], bool, str | None]:
        try:
            return primary(body), False, None
        except Exception as exc:  # the row carries the error, the job goes on
            return fallback(body), True, f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in text_pages(batches, text):
            results = zip(*[one(body.as_py()) for body in page.column(text)], strict=True)
            found = [pa.array(column, of) for column, of in zip(results, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[page.column(c) for c in kept], *found], names=[*kept, *added.names])

    return docs.select(*kept, text).mapInArrow(run, schema)


def run_stages(
    tables: Mapping[str, DataFrame],
    stages: Sequence[tuple[str, Callable[[dict[str, DataFrame], dict], Mapping[str, DataFrame]]]],
    params: Mapping[str, dict] | None = None,
) -> tuple[dict[str, DataFrame], list[dict]]:
    """Chain of stages, each from tables and parameters to more tables; plans stay lazy."""
    current, status = dict(tables), []
    for label, stage in stages:
        produced = stage(dict(current), dict((params or {}).get(label, {})))
        if not isinstance(produced, Mapping):
            raise TypeError(f"{label} returned {type(produced).__name__}, expected a mapping of tables")
        current.update(produced)
        status.append({"label": label, "status": "ok", "tables": sorted(produced)})
    return current, status
