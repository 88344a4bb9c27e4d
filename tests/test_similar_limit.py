"""Best similar pairs: the raised cutoff and the strips lose no pair."""

import numpy as np
import pandas as pd

from factloom.operators import similarity


def _best(rows, cutoff, limit):
    v = np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = np.minimum(v @ v.T, 1.0)
    pairs = [(-round(c[a, b], 9), rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(len(rows)) if rows[a][0] < rows[b][0] and c[a, b] >= cutoff]
    return [(a, b) for _, a, b in sorted(pairs)[:limit]]


def test_best_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 12))
    vectors[700:730] = vectors[:30]  # copies: equal similarities, ordered by ids
    for rows, limit in ((vectors, 20), (vectors, 60), (vectors[:40], 50)):
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
        table = spark.createDataFrame(rows, "id long, v array<double>")
        got = similarity.similar_pairs(table, "id", "v", 0.3, limit=limit).toPandas()
        got["place"] = -got["similarity"].round(9)
        got = got.sort_values(["place", "id_a", "id_b"])[["id_a", "id_b"]].head(limit)
        assert [tuple(map(int, r)) for r in got.to_numpy()] == _best(rows, 0.3, limit)
    assert similarity.similar_pairs(table.limit(0), "id", "v", 0.3, limit=5).count() == 0


def test_fewer_pairs_leave_with_a_limit(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 4)))]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "v"]), "id long, v array<double>")
    # the old cutoff of 0.4 leaves a handful of wide cells, whose blocks all send ``limit`` pairs
    assert similarity.similar_pairs(table, "id", "v", 0.4, limit=50).agg({"similarity": "min"}).first()[0] > 0.99
