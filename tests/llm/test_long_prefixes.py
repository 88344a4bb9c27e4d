"""Documents with a common passage stay out of the blocks of the Jaccard join; near copies meet in them."""

import random

from factloom.llm.jaccard import PERCENT, candidate_blocks, gram_profiles, jaccard_groups


def _rows():
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages = [words(60) for _ in range(3)]
    rows = [(i, " ".join(words(70) + passages[i % 3] + words(70))) for i in range(60)]
    near = rows[7][1].split(" ")
    rows += [(100, " ".join(near[:-6])), (101, " ".join(words(3) + near)), (102, rows[8][1])]
    return rows


def test_passages_make_no_members_and_near_copies_do(spark):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string")
    members = {r.doc_id for r in candidate_blocks(gram_profiles(docs), PERCENT).select("doc_id").collect()}
    assert {7, 100, 101} <= members and len(members) < 10
    groups = {r.doc_id: r.component_id for r in jaccard_groups(docs).collect()}
    assert {d for d, c in groups.items() if d != c} == {100, 101, 102}
    assert groups[100] == groups[101] == 7 and groups[102] == 8
