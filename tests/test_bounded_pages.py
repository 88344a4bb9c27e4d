"""Python steps take texts in pages of bounded size, whatever a batch of rows holds."""

import pyarrow as pa

from factloom.operators import pages, profiles, stages


def test_pages_are_bounded_by_text_and_keep_every_row():
    texts = ["x" * 10, None, "", "y" * 5000, "z" * 400, "é" * 400, ""]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    found = list(pages.text_pages(iter([batch]), "text", 1000))
    assert [r["id"] for p in found for r in p.to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 1000 for p in found)
    assert len(found) == 4


class _Docs:
    """Stands in for a table: keeps the function a step gives to ``mapInArrow``."""

    def __init__(self, df):
        self.df, self.columns = df, df.columns

    def select(self, *columns):
        return _Docs(self.df.select(*columns))

    @property
    def schema(self):
        return self.df.schema

    def mapInArrow(self, run, schema):
        return run


def test_steps_answer_a_batch_in_pages(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["word 12. " * 20_000] * 50})
    for run in (profiles.token_events(_Docs(df)), stages.with_fallback(_Docs(df), str.split, list)):
        out = [p.num_rows for p in run(iter([batch]))]
        assert sum(out) == 50 and max(out) <= 6


def test_events_and_fallbacks_of_odd_texts(spark):
    rows = [(1, None, None), (2, "", 1.5), (3, "ab 1, é 22.", 2.5), (3, "ab", None)]
    df = spark.createDataFrame(rows, "id long, text string, other double")
    patterns = {"word": "[a-z]+", "number": "[0-9]+", "any": "[a-z0-9]"}
    events = profiles.token_events(df, patterns=patterns)
    assert events.columns == ["id", "other", "events"]
    got = {(r.id, r.other): [tuple(e) for e in r.events] for r in events.collect()}
    assert got[(1, None)] == [] and got[(2, 1.5)] == []
    assert got[(3, None)] == [(0, 2, "word"), (0, 1, "any"), (1, 2, "any")]
    assert got[(3, 2.5)][:2] == [(0, 2, "word"), (0, 1, "any")] and (8, 10, "number") in got[(3, 2.5)]

    def strict(body):
        if "1" in body:
            raise ValueError("digit")
        return body.split()

    found = stages.with_fallback(df, strict, lambda body: [body]).collect()
    by = {(r.id, r.other): (r["items"], r.used_fallback, r.error) for r in found}
    assert by[(1, None)][:2] == ([None], True) and by[(1, None)][2].startswith("TypeError")
    assert by[(2, 1.5)] == ([], False, None) and by[(3, 2.5)] == (["ab 1, é 22."], True, "ValueError: digit")
