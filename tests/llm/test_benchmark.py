"""Decontamination and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import best_position, containment
from factloom.llm.best_position import Best, Block, Query, ranked_search, search
from factloom.llm.containment import contamination, membership
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, window string, token long, doc_id long, rank int, n int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def items_of(texts):
    """Items cut out of documents, short ones, copies, one without words, one without an id, one id with two texts."""
    random.seed(9)
    out = []
    for i in (9, 12, 25, 30, -1, -2):
        w = terms(texts[i])
        a = random.randrange(max(1, len(w) - 16))
        out.append("  ".join(w[a : a + 16]).upper() + "!")
    out += [out[0], "one", "b C", "cöde", " .,; ", None, "", " ".join(prose(40)), "zzz zzz zzz", "x" * 5000]
    rows = [(100 + i, t, "w", 1, 2, 3, 4) for i, t in enumerate(out)]
    return rows + [(100, " ".join(terms(texts[27])[:12]), "w", 1, 2, 3, 4), (None, " ".join(terms(texts[13])[3:14]), "w", 1, 2, 3, 4)]


def plain_contamination(text, items):
    w, hit, named = terms(text), set(), set()
    for item_id, item, *_ in items:
        v = terms(item)
        k = min(len(v), 10)
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                named.add(item_id)
    return len(w), len(hit), sorted(str(x) for x in named - {None})


@pytest.fixture(scope="module")
def items(spark, odd):
    rows = items_of([t for _, t in odd[1]])
    return spark.createDataFrame(rows, ITEMS).repartition(2), rows


def test_contamination(odd, items, empty):
    table, rows = odd
    got = contamination(table, items[0]).collect()
    assert len(got) == table.count()
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, list(r["items"])) == plain_contamination(texts[r.doc_id], items[1])
            assert len({x for s in r.spans for x in range(s.start, s.end)}) == r.n_hit
    assert sum(r.n_hit > 0 for r in got) > 10
    assert contamination(empty, items[0]).count() == 0
    without = contamination(table, items[0].limit(0)).collect()
    assert len(without) == len(got) and not any(r.n_hit or r["items"] for r in without)


def test_windows_of_other_sizes(spark):
    docs = spark.createDataFrame([(1, "a b a b a b c"), (2, "b a b"), (3, "a b"), (4, "c a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b a b"), (8, "a"), (9, "b c a")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in contamination(docs, items, window_words=3).collect()}
    assert got == {1: (6, ["7", "8"]), 2: (3, ["7", "8"]), 3: (1, ["8"]), 4: (1, ["8"])}


def test_a_full_filter_still_gives_the_same(spark, odd, items, monkeypatch):
    table, _ = odd
    want = sorted((r.doc_id or -1, r.n_hit) for r in contamination(table, items[0]).collect())
    monkeypatch.setattr(containment, "MOST_FILTER_BITS", 6)
    assert sorted((r.doc_id or -1, r.n_hit) for r in contamination(table, items[0]).collect()) == want
    tokens = spark.range(1000).select(F.xxhash64("id").alias("t"))
    own = np.array([r.t for r in tokens.collect()], np.int64).view(np.uint64)
    assert membership(tokens, "t")(own).all()


def plain_search(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text, *_ in items:
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text)
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i, score))
        out += [(item_id, k + 1, x[3], x[4]) for k, x in enumerate(sorted(scored)[:top])]
    return out


def test_ranked_search(spark, odd, items, empty, monkeypatch):
    table, rows = odd
    docs = [(r.doc_id, r.text) for r in table.collect()]  # with the repeated row and the one without an id
    want = sorted(map(str, plain_search(docs, items[1], 10)))
    assert sorted(str(tuple(r)) for r in ranked_search(table, items[0]).collect()) == want
    monkeypatch.setattr(best_position, "BLOCK_POSTINGS", 60)  # many blocks, lists read in small steps,
    monkeypatch.setattr(best_position, "FIRST_STEP", 1)
    monkeypatch.setattr(best_position, "RUN_TERMS", 40)  # and several runs
    assert sorted(str(tuple(r)) for r in ranked_search(table, items[0]).collect()) == want
    short = sorted(map(str, plain_search(docs, items[1], 2)))
    assert sorted(str(tuple(r)) for r in ranked_search(table, items[0], top=2).collect()) == short
    assert ranked_search(empty, items[0]).count() == 0 and ranked_search(table, items[0].limit(0)).count() == 0


def random_block(rng, n_docs, n_terms):
    owned = [np.sort(rng.choice(n_terms, rng.integers(1, n_terms // 2), replace=False)) for _ in range(n_docs)]
    term = np.concatenate(owned)
    impact = rng.integers(1, 50, len(term)) * rng.integers(1, 50, len(term))
    return Block.of(np.array(list(map(len, owned))), term, impact, n_terms)


@pytest.mark.parametrize("seed", range(6))
def test_search_stops_early_and_keeps_ties(seed):
    rng = np.random.default_rng(seed)
    n_terms, ids = 40, rng.permutation(3000)
    block, slots = random_block(rng, 3000, n_terms), np.full(n_terms, -1)
    query = Query(1, rng.choice(n_terms, 6, replace=False), rng.integers(1, 9, 6) ** 3)
    scores = np.zeros(3000, np.int64)
    for t, w in zip(query.terms, query.weights, strict=True):
        own = block.term == t
        np.add.at(scores, block.owner[own], w * block.impact[own])
    best = Best(10)
    looked = search(block, query, ids, slots, best)
    order = np.lexsort((ids, -scores))[:10]
    assert list(zip(best.scores, best.ids, strict=True)) == list(zip(scores[order], ids[order], strict=True))
    assert looked < 3000 and (slots == -1).all()
    assert search(block, query, ids + 3000, slots, best) <= looked  # what is known already stops it sooner


def test_equal_scores_behind_the_bound_are_read():
    n = 500  # all documents score alike: the smallest ids win, wherever they stand in the list
    block = Block.of(np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, 7), 1)
    best = Best(10)
    search(block, Query(1, np.array([0]), np.array([2])), np.arange(n)[::-1].copy(), np.full(1, -1), best)
    assert best.ids.tolist() == list(range(10)) and set(best.scores.tolist()) == {14}
