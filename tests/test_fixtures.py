"""Inline inputs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from factloom.functions import scores
from factloom.functions import text as T
from factloom.operators import (
    classify, codefacts, compare, diagnostics, duplicates, extract, graph, ledger, profiles, ranking, resolve, stages,
)
from factloom.operators import ordered
from factloom.sources import corpus, records


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"), [("a b c d e f g h", 3.0), ("x x x x x x x x", 0.0), ("", 0.0), ("hello", 0.0), ("a a b b c c", math.log2(3))]
)
def test_token_entropy(spark, text, want):
    assert value(spark, T.token_entropy, text) == pytest.approx(want)


def test_text_measures(spark):
    assert value(spark, T.line_entropy, "same\nsame\nsame") == 0.0
    assert value(spark, T.parameter_fingerprint, 'call("a", 1)') == value(spark, T.parameter_fingerprint, 'other("a", 1)')
    blocks = "[task:a]\nneeds = x\nrun\n[task:b]\nneeds = y\nrun\n"
    assert value(spark, T.structural_diversity, blocks) == 0.5
    assert value(spark, T.structural_diversity, "") == 1.0
    assert value(spark, T.semantic_fingerprint, "x = 1  # one\n") == value(spark, T.semantic_fingerprint, "x   = 1")
    assert value(spark, T.number_tokens, "a 1.5 -2 .5e1") == [1.5, -2.0, 5.0]


def test_entropy_gate(spark):
    row = profiles.entropy_gate(spark.createDataFrame([("\n".join(["x"] * 100),)], "text string")).first()
    assert not row.passed and len(row.reasons) == 2


def test_profile(spark):
    docs = spark.createDataFrame([(1, "import os\ndef f(x):\n    return 1\nclass A:\n    pass\n"), (2, "")], "id int, text string")
    rows = {r.id: r for r in profiles.token_profile(docs).collect()}
    assert (rows[1].function_def, rows[1].class_def, rows[1].import_stmt) == (1, 1, 1)
    assert sum(v for k, v in rows[2].asDict().items() if k != "id") == 0


def test_token_events_are_ordered(spark):
    docs = spark.createDataFrame([("with x:\n  return 1",)], "text string")
    events = profiles.token_events(docs).first().events
    assert [e.category for e in events] == ["with_stmt", "return_stmt", "numeric_literal"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "w array<string>")
    assert len(df.select(profiles.ngrams(F.col("w"), 1)).first()[0]) == 3
    assert df.select(profiles.ngrams(F.col("w"), 4)).first()[0] == []


def test_key_values(spark):
    df = spark.createDataFrame([("FOO=bar\nBAZ_1=hello world\ninvalid line\nlowercase=val\nFOO=last",)], "text string")
    assert df.select(records.key_values(F.col("text"))).first()[0] == {"FOO": "last", "BAZ_1": "hello world"}


def test_key_set_groups(spark):
    rows = spark.createDataFrame([("a", ["KEY"]), ("b", ["KEY"]), ("c", ["OTHER"]), ("d", []), ("e", [])], "record string, keys array<string>")
    got = {r.label: r.weight for r in duplicates.key_set_groups(rows, "keys", "record").collect()}
    assert got == {"key": 2, "raw": 2}


DOCS = [
    ("genome.txt", "text", "DNA sequences encode genes and mutations.\nLet rate be the mutation rate observed in the genome."),
    ("game.txt", "text", "The render pipeline updates every frame in the game loop entity system.\nLet rate be the frame render rate for the game loop."),
    ("config.json", "json", '{"max_retries": 3, "timeout": 1.5, "on": true, "name": "x", "nested": {"a": 1}, "list": [1], "none": null}'),
    ("engine.cpp", "code:cpp", "#define MAX_ENTITIES 1024\nconst float GRAVITY = 9.8;\nvoid tick() { assert(MAX_ENTITIES > 0); }"),
    ("model.py", "code:python", "MAX_RETRIES = 3\ndef area(radius):\n    return 3.14159 * radius * radius\n"),
]


@pytest.fixture(scope="module")
def facts(spark):
    docs = classify.with_domain(spark.createDataFrame(DOCS, "path string, format string, text string"), fmt="format")
    return stages.extract_facts(docs).withColumn("id", classify.make_id(F.col("domain"), F.col("symbol"))).collect()


def test_mixed_corpus(facts):
    by = {(f.path, f.symbol): f for f in facts}
    assert by["genome.txt", "rate"].id == "genomics::rate" and by["game.txt", "rate"].id == "game_engine::rate"
    assert by["config.json", "timeout"].type_hint == "real" and by["config.json", "timeout"].bounds.lo == 1.5
    assert by["config.json", "max_retries"].type_hint == "integer" and by["config.json", "on"].bounds is None
    assert not {("config.json", k) for k in ("nested", "list", "none")} & set(by)
    assert by["engine.cpp", "GRAVITY"].bounds.lo == 9.8 and by["engine.cpp", "GRAVITY"].line == 2
    assert any(f.expression == "MAX_ENTITIES > 0" for f in facts)
    assert by["model.py", "MAX_RETRIES"].bounds.hi == 3.0 and by["model.py", "area"].variables == ["radius"]


def test_shared_symbols(spark, facts):
    rows = spark.createDataFrame([(f.symbol, f.domain) for f in facts if f.kind == "state_variable"], "symbol string, domain string")
    assert resolve.shared_symbol_edges(rows).count() == 2


@pytest.mark.parametrize(
    ("text", "expression"),
    [
        ("x must remain between 60 and 100 bpm.", "60 <= x <= 100"), ("Dosage must not exceed 500 mg per day.", "Dosage <= 500"),
        ("temp must remain below 90.", "temp < 90"), ("pressure must remain above 10.", "pressure > 10"),
    ],
)
def test_boundaries(spark, text, expression):
    docs = spark.createDataFrame([("p", "d", text)], "path string, domain string, text string")
    assert [r.expression for r in extract.boundaries(docs).collect()] == [expression]


def test_equations_and_lines(spark):
    docs = spark.createDataFrame(
        [("a", "d", "The kinetic energy is given by E = 0.5 * m * v^2."), ("b", "d", "line one\nline two\nLet y be the second-line variable.")],
        "path string, domain string, text string",
    )
    equation = extract.equations(docs).first()
    assert (equation.rhs, equation.variables) == ("0.5 * m * v^2", ["m", "v"])
    assert extract.state_variables(docs).first().line == 3


CODE = [
    ("pkg/util.py", "def helper():\n    return 1\n"),
    ("pkg/main.py", "import pkg.util\nimport os\ndef simple():\n    return 1\ndef branchy(x):\n    if x:\n        for i in x:\n            while i:\n                if i:\n                    pass\n"),
    ("a.py", "def f(x):\n    return x + 1\n"), ("b.py", "# note\n\ndef f(x):\n\n    return x + 1  # more\n"), ("bad.py", "def ("),
]


def test_code_facts(spark):
    facts = codefacts.CodeFacts(codefacts.read_code(spark.createDataFrame(CODE, "path string, text string")).cache())
    complexity = {r.name: r.complexity for r in facts.complexity().collect()}
    assert complexity["simple"] == 1 and complexity["branchy"] == 5
    hashes = {r.path: r.structural_hash for r in facts.structural_hash().collect()}
    assert hashes["a.py"] == hashes["b.py"] and "bad.py" not in hashes
    files = spark.createDataFrame([(p,) for p, _ in CODE], "path string")
    resolved = resolve.resolve_imports(facts.modules(), files)
    assert {r.module: r.resolved for r in resolved.collect()} == {"pkg.util": "pkg/util.py", "os": None}
    assert resolve.adjacency(resolved).first().requires == ["pkg/util.py"]
    assert facts.code.where("error IS NOT NULL").first().path == "bad.py"


def test_compiler_logs(spark):
    lines = spark.createDataFrame(
        [('{"message": "m", "level": "error", "code": {"code": "E0384"}, "spans": [{"file_name": "x.rs", "byte_start": 21, "byte_end": 22, "is_primary": true}]}',),
         ('{"message": "n", "spans": []}',), ("noise",)], "line string")
    rows = records.rustc_diagnostics(lines).collect()
    assert [(r.start_byte, r.source) for r in rows] == [(21, "rustc")]


@pytest.mark.parametrize(
    ("code", "message", "want"),
    [("E0432", "x", "missing_import"), ("E0384", "x", "immutable_assignment"), (None, '"foo" is not defined', "missing_import"),
     (None, "expected one of `.`, `;`", "missing_semicolon"), (None, "fine", None)],
)
def test_categories(spark, code, message, want):
    df = spark.createDataFrame([(code, message)], "code string, message string")
    assert df.select(diagnostics.category(F.col("code"), F.col("message"))).first()[0] == want


def test_dependency_attribution(spark):
    text = "no method named `neg_mut` found for struct `rug::Integer` in the current scope"
    problem = spark.createDataFrame([(1, "t", text)], "id int, target string, stderr string").select(
        "id", "target", *[c.alias(n) for n, c in diagnostics.version_problem(F.col("stderr")).items()])
    deps = spark.createDataFrame([("t", "rug", "0.22")], "target string, crate string, version string")
    row = resolve.attribute_to_dependency(problem.select("id", "target", "receiver"), deps, deps.select("crate", "version")).first()
    assert problem.first().method == "neg_mut" and (row.crate, row.declared_version) == ("rug", "0.22")


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(n,) for n in "base left right top a b orphan".split()], "node string")
    deps = spark.createDataFrame(
        [("left", "base"), ("right", "base"), ("top", "left"), ("top", "right"), ("a", "b"), ("b", "a"), ("orphan", "gone")], "node string, requires string")
    got = {r.node: r.level for r in graph.levels(nodes, deps).collect()}
    assert got == {"base": 0, "left": 1, "right": 1, "top": 2, "a": None, "b": None, "orphan": None}
    edges = deps.select(F.col("node").alias("src"), F.col("requires").alias("dst"))
    assert sorted(tuple(r) for r in graph.cycle_core(edges).collect()) == [("a", "b"), ("b", "a")]
    assert [r.path for r in graph.cycles_up_to(edges, 3).collect()] == [["a", "b", "a"]]


def test_dominance(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 3.0), ("e", 1.0, 1.0)], "id string, x double, y double")
    got = {r.id: r.dominated for r in ranking.dominated(df, ["x", "y"]).collect()}
    assert got == {"a": False, "b": True, "c": True, "e": False}
    pick = spark.createDataFrame([("a", 1.0, 5.0), ("b", 5.0, 1.0), ("c", 3.0, 3.0), ("d", 10.0, 10.0)], "id string, x double, y double")
    assert {r.id for r in ranking.select_best(pick, ["x", "y"], 2, "id").collect()} == {"a", "b"}


def test_layers_of_many_cells_equal_those_of_one(spark):
    df = spark.range(60).select("id", (F.col("id") * 7 % 13).cast("double").alias("x"), (F.col("id") * 5 % 11).cast("double").alias("y"))
    one = {r.id: r.front for r in ranking.front_layers(df, ["x", "y"]).collect()}
    split = {r.id: r.front for r in ranking.front_layers(df, ["x", "y"], cell_rows=5).collect()}
    assert one == split


def test_ledger(spark):
    df = spark.createDataFrame([("inf",), ("NaN",), ("text",), ("true",), ("2.5",)], "r string")
    assert [r[0] for r in df.select(ledger.coerce_result(F.col("r"))).collect()] == [None, None, None, 1.0, 2.5]
    rows = spark.range(10).select("id", F.col("id").cast("double").alias("result"))
    assert [r.result for r in ledger.record(rows.limit(0), rows, ["id"], 3).collect()] == [9.0, 8.0, 7.0]


def test_run_output(spark):
    df = spark.createDataFrame([(1, '{"wall_time": 2.5, "energy": 1.2, "accuracy_error": 0.001}'), (2, "wall_time = 3.7\nenergy: 0.5")], "id int, text string")
    rows = df.select("id", *[c.alias(n) for n, c in records.run_metrics(F.col("text")).items()]).orderBy("id").collect()
    assert tuple(rows[0])[1:] == (2.5, 1.2, 0.001) and tuple(rows[1])[1:] == (3.7, 0.5, None)
    arrays = spark.createDataFrame([([1.0, 2.0, 3.0], [1.1, 2.0, 3.0])], "a array<double>, b array<double>")
    assert arrays.select(compare.max_relative_error(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.1)


def test_validation(spark):
    runs = spark.createDataFrame(
        [(1, '{"cases": [{"name": "a", "error": 1e-5}, {"name": "b", "error": 1e-10}]}', 0), (2, "gravity: PASS\ncollision: FAIL\norbital: OK", 0),
         (3, '{"cases": []}', 0), (4, "nothing", 0), (5, "nothing", 3)], "run_id int, text string, returncode int")
    got = {r.run_id: (r.num_passed, r.num_failed, r.passed) for r in records.validation_report(runs, 1e-8).collect()}
    assert got == {1: (1, 1, False), 2: (2, 1, False), 3: (0, 0, False), 4: (0, 0, True), 5: (0, 0, False)}


def test_three_way(spark):
    def side(*rows):
        return spark.createDataFrame(list(rows), "name string, text string")

    merged = compare.three_way_merge(side(("f", "1"), ("d", "1"), ("k", "1")), side(("f", "2"), ("h", "1"), ("k", "2")), side(("f", "1"), ("g", "1"), ("d", "1"), ("k", "3")), ["name"], "text")
    got = {r.name: (r.decision, r.kept, r.conflict) for r in merged.collect()}
    assert got == {"f": ("left", "2", False), "h": ("left_add", "1", False), "g": ("right_add", "1", False), "d": ("deleted", None, False), "k": ("concurrent_edit", "3", True)}


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, body in (("a.py", b"x = 1"), ("b.MD", b"text"), ("c.bin", b"0"), ("node_modules/d.py", b"y"), ("e.txt", b"\xff\xfe")):
        (tmp_path / name).write_bytes(body)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in corpus.load_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.py", "b.MD", "e.txt"} and rows["a.py"].text == "x = 1" and rows["e.txt"].error
    assert corpus.snapshot(spark, str(tmp_path)).count() == 4


def test_scores(spark):
    df = spark.createDataFrame([(0.0,), (float("nan"),), (-1.0,), (4.0,), (float("inf"),)], "s double")
    assert [r[0] for r in df.select(scores.inverse_seconds(F.col("s"))).collect()] == [1e9, 0.0, 0.0, 0.25, 0.0]


def test_bucketed_windows_equal_plain_ones(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 37 % 1009).alias("o"))
    numbered = ordered.row_number(rows, ["k"], ["o", "id"])
    plain = numbered.selectExpr("rn", "row_number() OVER (PARTITION BY k ORDER BY o, id) AS want")
    assert plain.where("rn <> want").count() == 0
    near = ordered.neighbour(rows, ["k"], ["o", "id"], "o", "prev")
    assert near.selectExpr("prev", "lag(o) OVER (PARTITION BY k ORDER BY o, id) AS want").where("NOT prev <=> want").count() == 0
