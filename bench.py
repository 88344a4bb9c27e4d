"""Headline benchmark: prints one JSON line with seconds per query.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; ``BENCH_QUERIES=all`` times every
registered query and reports each on stderr as it finishes.
"""

from __future__ import annotations

import json
import os
import sys
import time

from factloom.plans import REGISTRY
from factloom.session import local_session

HEADLINE = [
    "t02_semantic_fingerprint", "t04_token_entropy", "t07_entropy_gate", "t09_token_profile", "a01_duplicate_groups",
    "a07_profile_anomalies", "j01_snapshot_delta", "g07_incremental_recompute", "j04_resolved_names", "j08_reference_edges",
    "j09_shared_symbols", "j11_contained_phrases", "j14_similar_profiles", "j17_three_way_merge", "j18_successor_conflicts",
    "m01_dominated_lines", "m02_front_layers", "m04_hypervolume_3d", "w03_score_kinetics", "w06_moving_average",
    "w07_rolling_stats", "w08_steps_since_improvement", "k02_best_matching", "k06_top_ngrams", "g01_levels",
    "g05_transitive_dependents", "s04_json_scalars", "s07_rustc_diagnostics", "p04_document_domains", "x02_score_states",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if chosen or os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
