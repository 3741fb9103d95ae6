"""Times the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import workload  # noqa: E402
from boutwise.session import build_session  # noqa: E402

HEADLINE = [
    "feat_14_core_vector", "feat_08_path_features", "feat_12_resample", "nrm_1_train_zscore", "nrm_4_sample_stats", "qc_1_flags", "qc_2_accept",
    "qc_4_funnel", "src_4_bout_keys", "join_1_lookup", "mld_2_unit_split", "clu_3_nearest_centre", "clu_1_lloyd", "clu_4_margin", "clu_6_silhouette",
    "agr_0_contingency", "agr_1_adjusted_rand", "agr_3_adjusted_mi", "agr_6_cramers_v_orders", "agr_9_concentration", "agr_13_align_labels",
    "agr_16_seed_pairs", "agr_18_unit_occupancy", "eff_1_eta_squared", "eff_3_group_summary", "eff_11_kruskal_wallis", "eff_12_robust_summary",
    "emb_1_dimension_stats", "emb_3_covariance", "emb_7_contrastive_loss", "bst_1_unit_weights", "bst_4_bootstrap_ari", "prb_7_ridge_one_feature",
    "met_1_classification_scores", "seq_1_transitions", "seq_3_motif_frequency", "aug_4_view_metrics", "bld_1_blind_map", "val_4_feature_audit",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one pass warms the JVM and the Python workers, the second is timed
    workload.QUERIES["clu_3_nearest_centre"](spark, d).write.format("noop").mode("overwrite").save()
    workload.flagship(spark, d).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.time()
        workload.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
