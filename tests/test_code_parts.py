"""Reading code: dealt over tasks, narrow parts, and the same facts as from whole rows."""

import ast

import pytest
from pyspark.sql import functions as F

from factloom.operators import codefacts

TEXT = "import os\n\n\ndef f(xs):\n    def g(y):\n        return os.getcwd(y)\n    return [g(x) for x in xs]\n"


def _files(spark, n=200):
    rows = [(f"m{i}.py", TEXT + f"X{i} = {i}\n") for i in range(n)] + [("bad.py", "def ("), ("none.py", ""), (None, TEXT)]
    return spark.createDataFrame(rows, "path string, text string").coalesce(1)


def test_files_of_one_split_are_parsed_by_many_tasks(spark):
    code = codefacts.read_code(_files(spark))
    per_task = code.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per_task) == 203
    assert len(per_task) >= 4 and max(r["count"] for r in per_task) < 150


def test_parts_give_the_facts_of_whole_rows(spark):
    files = _files(spark, 5)
    whole = codefacts.CodeFacts(codefacts.read_code(files))
    for parts, facts in [
        (["names"], lambda c: c.names("used")), (["imports"], lambda c: c.aliases()), (["calls"], lambda c: c.calls()),
        (["nodes"], lambda c: c.complexity()), (["imports"], lambda c: c.dynamic_files()),
    ]:
        code = codefacts.read_code(files, parts=parts)
        assert set(codefacts.PARTS) & set(code.columns) == set(parts)
        assert sorted(map(str, facts(codefacts.CodeFacts(code)).collect())) == sorted(map(str, facts(whole).collect()))
    owners = {(r.function, r.call) for r in whole.calls().collect()}
    assert owners == {("f", "os.getcwd"), ("g", "os.getcwd"), ("f", "g")}


def test_only_wanted_node_fields_are_made(spark, monkeypatch):
    monkeypatch.setattr(ast, "unparse", lambda node: pytest.fail("no query asked for source"))
    read = codefacts._read_file(TEXT, {"nodes": ["kind", "depth"]})
    assert list(read["nodes"]) == ["kind", "depth"] and "calls" not in read
    assert len(read["nodes"]["kind"]) == len(read["nodes"]["depth"]) == sum(1 for _ in ast.walk(ast.parse(TEXT)))


def test_narrow_nodes_give_the_facts_of_whole_ones(spark):
    files = _files(spark, 5)
    whole = codefacts.CodeFacts(codefacts.read_code(files))
    functions = ["id", "last", "depth", "kind", "name", "line", "end_line"]
    for fields, facts in [
        (["kind", "depth"], lambda c: c.node_profile()), (["kind"], lambda c: c.structural_hash()), (functions, lambda c: c.complexity()),
        (["kind", "name"], lambda c: c.symbols()), (functions, lambda c: c.measures()),
    ]:
        code = codefacts.read_code(files, node_fields=fields)
        assert set(code.schema["nodes"].dataType.elementType.names) == set(fields)
        assert sorted(map(str, facts(codefacts.CodeFacts(code)).collect())) == sorted(map(str, facts(whole).collect()))
    unread = whole.code.where("error IS NOT NULL").select(*codefacts.PARTS, "line_count", "dynamic").collect()
    assert [set(r) for r in unread] == [{None}]
