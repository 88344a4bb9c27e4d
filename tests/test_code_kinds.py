"""Reading code: only nodes of wanted kinds and names of wanted roles are made, with the facts of whole files."""

import ast

import pytest
from pyspark.sql import functions as F

from factloom.operators import codefacts
from factloom.plans import code_plans

TEXT = '''import numpy as np
from cffi import FFI as Gate
LIMIT, kind = 3, "word other"
assert LIMIT < 5


class Item:
    def outer(self, xs: "Item", k=None) -> np.array:
        async def inner(u):
            await u
            async with Pool() as pool, Lock():
                np.sum([y for x in xs for y in x if y])
            with Lock() as lock, open(u if k else xs):
                while k:
                    k.pop()
            return u
        try:
            for x in xs:
                print({**x, "a": 1 if k else 2})
        except ValueError:
            return lambda z: z
        finally:
            match k:
                case {"a": 1, **rest} if rest:
                    def late(): return late()
        return inner


def area(x):
    return x * LIMIT
'''
KINDS = [code_plans.DECLARED, code_plans.LOOPING, code_plans.BRANCHING, code_plans.RISKY, ["Module", "Constant", *codefacts.STATEMENTS], []]


@pytest.mark.parametrize("node_kinds", KINDS, ids=["declared", "looping", "branching", "risky", "categories", "none"])
def test_nodes_of_some_kinds_are_those_of_the_whole_tree(node_kinds):
    fields = [f for f in codefacts.FIELDS["nodes"] if f != "code"]
    wanted = {"nodes": fields, "calls": codefacts.FIELDS["calls"], "imports": codefacts.FIELDS["imports"]}
    whole = codefacts._read_file(TEXT, wanted)
    some = codefacts._read_file(TEXT, wanted, codefacts._kinds_to_read(wanted, node_kinds, None))
    every, nodes = whole["nodes"], some["nodes"]
    kept = {*node_kinds, "FunctionDef", "AsyncFunctionDef", "Call", "Import", "ImportFrom"}
    at = [i for i in every["id"] if every["kind"][i] in kept]
    place = {old: new for new, old in enumerate(at)}

    def above(i):
        parent = every["parent"][i]
        return parent if parent is None or parent in place else above(parent)

    assert nodes["id"] == list(range(len(at))) and nodes["parent"] == [place.get(above(i)) for i in at]
    assert nodes["last"] == [max(place[j] for j in at if i <= j <= every["last"][i]) for i in at]
    for field in set(fields) - {"id", "parent", "last"}:
        assert nodes[field] == [every[field][i] for i in at]
    for field in ("function", "node"):
        whole["calls"][field] = [place[i] for i in whole["calls"][field]]
    assert some["calls"] == whole["calls"] and some["imports"] == whole["imports"]


@pytest.mark.parametrize("roles", [["defined", "imported", "annotation"], ["used", "defined", "imported"], ["mentioned", "in_string"], ["local"]])
def test_names_of_some_roles(roles):
    wanted = {"names": codefacts.FIELDS["names"]}
    whole = codefacts._read_file(TEXT, wanted)["names"]
    some = codefacts._read_file(TEXT, wanted, codefacts._kinds_to_read(wanted, None, roles), roles)["names"]
    pairs = [pair for pair in zip(whole["role"], whole["name"], strict=True) if pair[0] in roles]
    assert list(zip(some["role"], some["name"], strict=True)) == pairs and {role for role, _ in pairs} == set(roles)


def test_expressions_are_not_entered_for_statements():
    tree = ast.parse(TEXT)
    for node in ast.walk(tree):
        if isinstance(node, ast.expr):
            node.__class__ = type("Unread", (ast.expr,), {"__getattr__": lambda *_: pytest.fail("read an expression")})
    kinds = codefacts._kinds_to_read({"nodes": ["kind"]}, code_plans.DECLARED, None)
    assert [entry[0].name for entry in codefacts._flatten_some(tree, kinds)] == ["Item", "outer", "inner", "late", "area"]


def test_lookups_are_found_without_whole_trees():
    for text, found in [("eval('1')", True), ("x = 'eval'", False), ("sys.modules", True), ("import importlib as i\ni.import_module('a')", True)]:
        read = codefacts._read_file(text, {"names": codefacts.FIELDS["names"]}, codefacts._kinds_to_read({"names": []}, None, ["defined"]), ["defined"])
        assert read["dynamic"] is found


def test_facts_of_some_kinds_are_those_of_whole_nodes(spark):
    files = spark.createDataFrame([("a.py", TEXT), ("a.py", TEXT), ("b.py", "def ("), ("c.py", "")], "path string, text string")
    files = files.withColumn("source", F.col("text"))
    whole = codefacts.CodeFacts(codefacts.read_code(files, ["source"]))
    for parts, kinds, facts in [
        (["nodes"], code_plans.DECLARED, lambda c: c.symbols()), (["nodes"], code_plans.BRANCHING, lambda c: c.complexity().drop("start")),
        (["nodes", "calls"], code_plans.LOOPING, lambda c: c.measures()), (["nodes", "imports", "calls"], code_plans.RISKY, lambda c: c.risks()),
        (["calls", "imports"], [], lambda c: c.calls()),
    ]:
        code = codefacts.CodeFacts(codefacts.read_code(files, ["source"], parts, node_kinds=kinds))
        assert sorted(map(str, facts(code).collect())) == sorted(map(str, facts(whole).collect()))


def test_rows_are_dealt_before_they_become_files(spark):
    rows = spark.createDataFrame([(i, f"part {i}") for i in range(200)], "p_partkey long, p_name string").coalesce(1)
    per_task = codefacts.dealt(rows, "p_partkey", "p_name").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) >= 4 and sum(r["count"] for r in per_task) == 200 and max(r["count"] for r in per_task) < 150
    files = rows.select(F.col("p_name").alias("path"), F.lit("x = 1").alias("text"))
    plan = codefacts.read_code(files, deal=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
