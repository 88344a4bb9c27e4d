"""Names of many files meet without a broadcast: their guessed size says nothing about their rows."""

import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import codefacts, resolve
from factloom.session import cut_lineage

TEXT = """import os
import numpy as np
LIMIT = 3


def area(x):
    np.sum(x)
    return missing(LIMIT, x, "os")
"""
# Paths of files: some come twice, one has none, and the last one looks names up.
PATHS = ["a.py", "b.py", "b.py", None, "d.py"]


@pytest.fixture(scope="module")
def facts(spark):
    """Facts of files that a scan of known size gives; a frame of Python rows would count as endless."""
    paths = F.array(*[F.lit(path) for path in PATHS])
    text = F.when(F.col("id") == len(PATHS) - 1, "import os\neval('1')\n").otherwise(TEXT)
    files = spark.range(len(PATHS)).select(F.get(paths, F.col("id").cast("int")).alias("path"), text.alias("text"))
    return codefacts.CodeFacts(cut_lineage(codefacts.read_code(files, parts=["names", "imports", "calls"])))


def _rows_without_broadcast(frame):
    rows = sorted(map(tuple, frame.collect()), key=str)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [path" in plan and not re.search(r"BroadcastHashJoin \[path", plan)
    return rows


def test_undefined_names(spark, facts):
    builtins = spark.createDataFrame([("print",)], "name string")
    found = resolve.unresolved_names(facts.names("used"), facts.names("defined"), facts.names("imported"), builtins)
    # without a path a file's names meet no definition
    want = [(name, path) for path in ("a.py", "b.py") for name in ("missing", "x")] + [(name, None) for name in ("LIMIT", "missing", "np", "x")]
    want.append(("eval", "d.py"))
    assert _rows_without_broadcast(found.select("name", "path")) == sorted(want, key=str)


def test_dead_imports(spark, facts):
    imports = facts.imports().where("top").select("path", F.col("bound").alias("name"), "structural")
    uses = facts.names("mentioned").unionByName(facts.names("in_string"))
    # the word os is in a string; without a path a file's imports meet no use
    found = resolve.dead_imports(imports, uses, facts.dynamic_files())
    assert _rows_without_broadcast(found) == [(None, "np"), (None, "os")]
    few = spark.range(1).select(F.get(F.array(F.lit("b.py")), F.col("id").cast("int")).alias("path"))  # its size is known, so it may go to the many imports of a path
    kept = resolve.dead_imports(imports, facts.names("mentioned"), few)
    assert sorted(map(tuple, kept.collect()), key=str) == [("a.py", "os"), ("d.py", "os"), (None, "np"), (None, "os")]
    assert "BroadcastHashJoin [path" in kept._jdf.queryExecution().executedPlan().toString()


def test_external_calls(facts):
    aliases = facts.aliases()
    external = aliases.where(resolve.is_external(F.col("module"))).select("path", "module")
    found = resolve.external_calls(facts.calls(), aliases, external)
    # a file that comes twice has its call and its alias twice
    call = ("area", "np.sum", "numpy")
    assert _rows_without_broadcast(found.select("path", "function", "call", "module")) == [("a.py", *call)] + 4 * [("b.py", *call)]
