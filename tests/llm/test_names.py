"""Columns whose names operators use inside stay as they are, and one doc_id with different texts loses nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import byte_bpe
from factloom.llm.common import held_out
from factloom.llm.jaccard import one_of_each_group
from factloom.llm.line_rules import line_rules, remove_lines
from factloom.llm.mixing import in_mix_order, mix
from factloom.llm.toxicity import train_toxicity, without_toxic
from tests.llm.test_documents import labelled

NAMES = (
    "_source _rest _hash _bucket _n _before _row _number _block _release _deadline _slot _kept _text _ids _toxicity _id _host _line doc id "
    "content several node key whole removed removed_lines texts component n row place bytes_"
).split()


@pytest.fixture(scope="module")
def crowded(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (2, base + " x"), (3, "other " * 7 + base[:90]), (4, None), (None, base), (5, ""), (1, base)]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    return table.withColumns({n: F.lit(7.0) for n in NAMES})


def untouched(frame, crowded):
    assert frame.columns[: len(crowded.columns)] == crowded.columns
    rows = frame.collect()
    assert all(r[n] == 7.0 for r in rows for n in NAMES)
    return rows


def test_names_stay(spark, crowded):
    n = crowded.count()
    assert len(untouched(mix(crowded, block_docs=2), crowded)) == n
    assert len(untouched(mix(crowded, {"s": 1.0}), crowded)) == n
    assert len(untouched(in_mix_order(mix(crowded), n), crowded)) == n
    kept = untouched(one_of_each_group(crowded), crowded)
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3, 4, 5]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(crowded, path, pattern, keep=False)
    assert len(untouched(encoded, crowded)) == n
    assert len(untouched(byte_bpe.decode(encoded, path, pattern), crowded)) == n
    verdicts = line_rules(crowded)
    stay = {r.doc_id for r in verdicts.where("kept").collect()}
    assert len(untouched(remove_lines(crowded, verdicts), crowded)) == sum(r.doc_id in stay for r in crowded.collect())


def test_names_stay_without_toxic(spark, crowded):
    docs, labels = labelled(spark)
    model = train_toxicity(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    assert len(untouched(without_toxic(crowded, model), crowded)) == crowded.count()


def test_one_doc_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (2, c), (2, c), (3, b), (4, a + " z")], "doc_id long, text string")
    kept = one_of_each_group(docs).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [(1, "a"), (1, "b"), (2, "c")]
