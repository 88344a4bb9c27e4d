"""Reading code: no work for what a file cannot hold, and the same facts, risks and names."""

import ast

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import codefacts, extract

TEXT = '''import numpy as np
from cffi import FFI
LIMIT = 3
assert LIMIT < 5


def outer(xs: "Item", k=None) -> np.array:
    async def inner(u):
        await u
        with Lock() as lock:
            np.sum(ctypes.CDLL("x"))
        return u
    return inner


def area(x):
    return x * LIMIT
'''


def _parsed(text):
    return codefacts._Parsed(text, ast.parse(text))


def test_nodes_are_not_searched_for_lookups_that_no_word_names():
    file = _parsed(TEXT)
    file.kinds = file.flat = None
    assert codefacts._is_dynamic(file) is False


@pytest.mark.parametrize(
    "text", ["eval('1')", "sys.modules", "importlib.import_module('a')", "f'{vars()}'", "ｇｌｏｂａｌｓ()", "x = ['é', getattr]"]
)
def test_dynamic_lookups_are_found(text):
    assert codefacts._is_dynamic(_parsed(text))
    assert not codefacts._is_dynamic(_parsed("modules = 'eval'  # é"))


def test_source_is_made_again_for_expressions_only(monkeypatch):
    made, unparse = [], ast.unparse
    monkeypatch.setattr(ast, "unparse", lambda node: made.append(node) or unparse(node))
    code = codefacts._read_file(TEXT, {"nodes": ["code"]})["nodes"]["code"]
    assert sorted(filter(None, code)) == ["LIMIT < 5", "inner", "u", "x * LIMIT"]
    assert len(made) == 2


def test_names_by_role_and_calls_of_nested_functions():
    read = codefacts._read_file(TEXT, {"names": codefacts.FIELDS["names"], "calls": codefacts.FIELDS["calls"]})
    names = list(zip(read["names"]["role"], read["names"]["name"], strict=True))
    assert names == sorted(set(names))
    of = {role: [n for r, n in names if r == role] for role, _ in names}
    assert of["annotation"] == ["Item", "np"] and of["defined"] == ["LIMIT", "area", "outer"] and of["imported"] == ["FFI", "np"]
    assert of["in_string"] == ["Item", "x"] and of["local"] == ["LIMIT", "area", "inner", "k", "lock", "outer", "u", "x", "xs"]
    calls = sorted(zip(read["calls"]["owner"], read["calls"]["name"], read["calls"]["line"], strict=True))
    assert calls == [(o, *c) for o in ("inner", "outer") for c in [("Lock", 10), ("ctypes.CDLL", 11), ("np.sum", 11)]]


def test_fact_fields_give_the_facts_of_whole_nodes(spark):
    files = spark.createDataFrame([("a.py", TEXT), ("b.py", "def ("), ("c.py", "")], "path string, text string")
    whole, narrow = [codefacts.CodeFacts(codefacts.read_code(files, parts=["nodes"], node_fields=fields)).facts(F.lit("d")).collect()
                     for fields in (codefacts.FIELDS["nodes"], codefacts.FACT_FIELDS)]
    assert sorted(map(str, narrow)) == sorted(map(str, whole)) and len(whole) == 3


def test_risks_of_nested_functions(spark):
    fields = ["id", "parent", "last", "kind", "name", "line", "end_line", "role"]
    files = spark.createDataFrame([("a.py", TEXT), ("b.py", "def (")], "path string, text string").withColumn("source", F.col("text"))
    code = codefacts.CodeFacts(codefacts.read_code(files, ["source"], ["nodes", "imports", "calls"], fields))
    found = {r["function"]: sorted((k["category"], k["detail"], k["line"]) for k in r["risks"]) for r in code.risks().collect()}
    inner = [
        ("external_dep", "call np.sum", 11), ("threading", "await", 9), ("threading", "context Lock", 10), ("threading", "coroutine inner", 8),
        ("unsafe_pattern", "ctypes.CDLL", 11),
    ]
    assert found == {"inner": inner, "outer": inner, "area": []}


def test_cues_leave_the_matches_as_they_are(spark):
    pieces = [
        "__asm__", "__attribute__", "volatile", "register ", "ctypes.CDLL", "ctypes.windll", "ctypes.cdll", "cffi.FFI", "ffi.cdef", "ffi.dlopen",
        "mmap.mmap", "POINTER(", "byref(", "addressof(", "cast(", ".cuda()", ".to('cuda", '.to("cuda', "cuda.synchronize", "numba.jit", "numba.cuda",
        "@jit", "@cuda.jit",
    ]
    assert len(pieces) == extract.UNSAFE.count("|") + 2  # one alternative has two quotes
    texts = [None, "", "plain", "regiſter x", "ﬀi.cdef", *(f"é\n{p}\n" for p in pieces), *(f"x\n{case(p)} {p}" for p in pieces for case in (str.lower, str.upper))]
    rows = spark.createDataFrame(pd.DataFrame({"id": range(len(texts)), "text": texts}), "id long, text string")
    plain, cued = [{r["id"]: r["hits"] for r in extract.pattern_hits(rows, extract.RISKS["python"], cues=cues).collect()} for cues in (None, extract.RISK_CUES)]
    assert cued == plain and sum(map(bool, cued.values())) == 3 * len(pieces) + 1
