"""URL rules, vectors and the pipeline."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm.components import components
from factloom.llm.url_model import END, ORDER, START, gram_ratios, judge_urls
from factloom.llm.vectors import near_vectors
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def plain_split(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2]


def plain_rule(host, path):
    fits = [r for r in RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q", "http://a.example.com/en/", "http://a.example.com/fr/", "x://net/es/1#f",
        "http://sub.net/fr/", "http://sub.net/de/", "http://com", "http://com/", "http://notcom/", "http://a.org?x=/b", "http://a://b/c",
    ]
    pages = spark.createDataFrame([(i, u, "x", "c") for i, u in enumerate(urls * 2)], "page_id long, url string, verdict string, text string")
    got = judge_urls(pages).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path = plain_split(urls[r.page_id % len(urls)])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == RULES[rule] if rule else r.verdict in ("allow", "block")
    assert judge_urls(pages.limit(0)).count() == 0


def plain_model(texts):
    """Witten-Bell probabilities of windows, straight from the definition."""
    seen = defaultdict(Counter)
    for t, n in texts.items():
        padded = START * (ORDER - 1) + t + END
        for i in range(len(t) + 1):
            for k in range(ORDER):
                window = padded[i : i + ORDER]
                seen[window[ORDER - 1 - k : ORDER - 1]][window[-1]] += n

    def probability(window):
        p = 1 / 65536
        for k in range(ORDER):
            counts = seen[window[ORDER - 1 - k : ORDER - 1]]
            n, t = sum(counts.values()), len(counts)
            p = (counts[window[-1]] + t * p) / (n + t) if n else p
        return p

    return probability


def test_url_models_against_the_definition(spark):
    accepted, rejected = Counter({"ab.com/x": 3, "abc.com/": 1}), Counter({"zz.net/es/": 2, "ab.net/": 1})
    rows = Counter()
    for kind, texts in (("a", accepted), ("r", rejected), ("o", Counter({"q.org/x": 1}))):
        for t, n in texts.items():
            padded = START * (ORDER - 1) + t + END
            for i in range(len(t) + 1):
                rows[padded[i : i + ORDER], kind] += n
    grams = {g for g, _ in rows}
    counted = spark.createDataFrame([(g, rows[g, "a"], rows[g, "r"]) for g in grams], "gram string, accepted long, rejected long")
    yes, no = plain_model(accepted), plain_model(rejected)
    for r in gram_ratios(counted).collect():
        assert abs(r.ratio - math.log(no(r.gram) / yes(r.gram)) * 1e6) <= 1


def vectors(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            centre = rng.normal(size=16)
            for _ in range(4):
                rows.append((i, [float(x) for x in centre + rng.normal(size=16) * 0.05], label))
                i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(3)]
    i += 3
    rows += [(i, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [float("nan")] * 16, 0), (i + 3, [], 0), (i + 4, [1.0, None], 0), (None, [1.0] * 16, 0)]
    rows += [(i + 5, [float("inf")] + [1.0] * 15, 1), (i + 6, [2.0, 1.0], 1), (i + 7, [4.0, 2.0], 1), (i + 8, [3.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_near_vectors(spark):
    table, rows = vectors(spark)
    units = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float32).astype(float)
            units[i] = (label, len(v), x / np.linalg.norm(x))
    links = [
        (a, b) for a in units for b in units
        if a < b and units[a][:2] == units[b][:2] and units[a][2] @ units[b][2] >= 0.98
    ]
    group = brute.components([i for i, *_ in rows if i is not None], links)
    count = Counter(x for pair in links for x in pair)
    got = near_vectors(table).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], group[r.vec_id], r.vec_id == group[r.vec_id])
    assert near_vectors(table.limit(0)).count() == 0


def test_components_of_long_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5), (2001, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.components({x for pair in links for x in pair}, links)
    assert got == {n: c for n, c in want.items() if any(n in pair and pair[0] != pair[1] for pair in links)}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), "test-stage")
        out.append(docs.toPandas())
    return out


def test_pipeline_stages(stages):
    start, clean, different, masked, mixed, tokens = stages
    assert all(list(x.columns) == list(start.columns) for x in (clean, different, masked, mixed))
    assert set(clean.doc_id) <= set(start.doc_id) and len(clean) > 0.8 * len(start)
    groups = brute.jaccard(list(zip(clean.doc_id, clean.text, strict=True)))
    assert sorted(different.doc_id) == sorted({c for _, c in groups.values()})
    assert sorted(masked.doc_id) == sorted(mixed.doc_id) == sorted(tokens.doc_id) == sorted(different.doc_id)
    assert not masked.text.str.contains(r"token = \"[0-9a-f]{40}").any()
    assert sorted(mixed.text) == sorted(masked.text) and list(mixed.doc_id) != sorted(mixed.doc_id)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, got.columns)) == sorted(stages[-1].columns)
    assert got.where(F.col("n_tokens") == F.size("ids")).count() == len(stages[-1])
