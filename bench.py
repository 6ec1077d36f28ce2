"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from affinity.plans.catalog import QUERIES
from affinity.session import build_session

HEADLINE = (
    "top_n_per_user item_pearson_zero_filled corated_pairs top_k_neighbors slope_one knn_basic_predict anti_testset "
    "baseline_als negative_sample per_user_auc assign_ids label_encode view_buy_dataset scale_standard roc_curve "
    "auc_trapezoid als_fit_predict als_recommend_top_n vocab_min_count clean_tokens text_cosine_distance doc_vectors "
    "knn_l2_exact vector_cosine_pairs mlp_classify downsample_negatives"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "affinity-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rating_histogram"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    took = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
