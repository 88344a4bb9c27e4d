"""Compiler arrays that follow each other on one line."""

import json

from factloom.sources import records


def test_gcc_arrays_on_one_line_are_all_read(spark):
    def unit(*messages):
        return json.dumps([{"kind": "error", "message": m, "locations": [{"caret": {"file": "a.c", "line": 1, "column": 2}}]} for m in messages])

    odd = 'expected \'}] [{\' or "][" \\ before ]  ['
    long = "x] [" * 50_000
    texts = [
        unit("a") + unit("b", "c"), unit("a") + " \t " + unit("b") + "\n" + unit("c") + "[]" + unit("d"), unit(odd) + unit(odd, "b"),
        "[]" + unit("a"), unit(long) + unit("b"), unit(*["m"] * 3000) + " " + unit("z"),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = [(r.id, r.message) for r in records.gcc_diagnostics(rows, ["id"]).collect()]
    want = [["a", "b", "c"], ["a", "b", "c", "d"], [odd, odd, "b"], ["a"], [long, "b"], ["m"] * 3000 + ["z"]]
    assert sorted(found) == sorted((i, m) for i, own in enumerate(want) for m in own)
