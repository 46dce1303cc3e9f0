"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to the ``noop`` sink, so whole results are computed and none is
collected. One untimed pass over a small query starts the JVM.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

HEADLINE = (
    "join_gold", "average_precision", "brier_nll", "macro_average", "evaluation_report", "risk_coverage", "tie_aware_risk",
    "matched_fpr", "precision_at_coverage", "coverage_equal", "row_contract", "text_validate", "tokenize_words", "lexicon_lookup",
    "group_summary", "quantile_summary", "table_fingerprint", "balanced_rates", "group_equal_prior", "prior_replacement",
    "compact_features", "frame_topk", "mass_cover", "ranked_candidates", "counterfactual_scores", "segmentation_free_score",
    "edit_distance", "optimal_labels", "consensus_labels", "hierarchical_mean", "paired_bootstrap", "sign_flip_test",
    "threshold_search", "gate_search", "supported_penalty", "logistic_fit", "word_rollup", "stream_score",
)


def main() -> None:
    from strophe.plans import catalog
    from strophe.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "strophe-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    queries["brier_nll"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": pathlib.Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
