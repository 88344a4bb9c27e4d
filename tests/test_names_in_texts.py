"""Names in texts: names that begin alike share no anchor; results equal plain containment."""

import random

from pyspark.sql import functions as F

from factloom.operators import classify, resolve


def test_names_equal_plain_containment(spark):
    rng = random.Random(3)
    for longest in (6, 40, 300):
        names = ["".join(rng.choice("ab") for _ in range(rng.randint(1, longest))) for _ in range(60)] + ["é", "aé😀", "a b"]
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 20))) + rng.choice(names) + "b" for _ in range(80)] + [None, "xé", "aé😀", "b😀aé" * 200 + "a b"]
        docs = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)] + [(0, 0, "ab")], "doc_id int, team int, text string")
        phrases = spark.createDataFrame([(i, i % 3, n) for i, n in enumerate(names)], "phrase_id int, team int, phrase string")
        every = [(r.doc_id, r.team, r.text) for r in docs.collect()]
        got = sorted((r.doc_id, r.phrase_id) for r in resolve.contained_names(docs.drop("team"), phrases.drop("team")).collect())
        assert got == sorted({(i, j) for i, _, t in every for j, n in enumerate(names) if t is not None and n in t})
        got = sorted((r.doc_id, r.team, r.phrase_id) for r in resolve.contained_names(docs, phrases, ["team"]).collect())
        assert got == sorted({(i, m, j) for i, m, t in every for j, n in enumerate(names) if t is not None and n in t and j % 3 == m})


def test_names_that_begin_alike_are_no_candidates(spark):
    names = spark.range(20_000).select(F.col("id").alias("phrase_id"), F.concat(F.lit("f"), "id").alias("phrase"))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("click(f1"), F.col("id") % 10, F.lit(")")).alias("text"))
    candidates, whole = resolve._name_candidates(docs, names)
    assert whole and candidates.count() == 100  # f1 and f1x of every text


def test_located_sources_equal_pairs(spark):
    rng = random.Random(5)
    words = ["alpha", "be", "ta", "x", "core", "py"]
    targets = [(rng.choice(["a", "b", None]), i, "-".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(40)] + [("a", 0, None), ("a", 1, "alpha")] * 2
    files = [(rng.choice(["a", "b", None]), "src/" + "/".join(rng.choices(["Alpha", "beta", "core", "z"], k=2)) + ".py", i % 4) for i in range(60)] + [("a", None, 1)]
    t = spark.createDataFrame(targets, "project string, label int, name string")
    f = spark.createDataFrame(files, "project string, path string, size int")
    plain = t.withColumn("k", classify.name_tokens(F.col("name"))).join(f, "project").where(
        F.exists("k", lambda x: F.contains(F.lower("path"), x))
    ).drop("k")
    got = classify.located_sources(t, f, ["project"])
    assert got.columns == plain.columns == ["project", "label", "name", "path", "size"]
    rows = sorted(map(str, got.collect()))
    assert rows and rows == sorted(map(str, plain.collect()))
