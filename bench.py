"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from toposcan.plans import catalog  # noqa: E402
from toposcan.session import local_session  # noqa: E402

HEADLINE = [
    "pip1_candidates", "pip5_inspection", "jn1_attach_distance", "jn2_nearest_river", "jn3_river_polar", "jn4_toponyms_around",
    "jn5_match_known", "jn6_is_hit", "jn9_cosine_topk", "jn14_points_within", "jn16_sweep", "prj1_normalize_name", "prj2_infer_type",
    "prj6_tag_categories", "prj10_utm", "flt5_threshold_top", "agg8_feature_table", "agg12_recall_at_k", "agg20_polar_summary", "trl9_sweep_metrics",
    "win1_rank", "win10_assign_ids", "txt1_root_candidates", "txt3_shared_affixes", "smp1_ratio_split", "smp5_negative_samples",
    "set2_upsert_dictionary", "ml1_cluster_sites", "ml6_knn_score", "ml13_water_scores", "grd2_sample_points", "grd4_zonal_stats", "grd7_slope_aspect",
    "grd10_label_regions", "trl2_trial_stats", "rnk1_jaccard_diversity",
    "pip2_precompute_then_threshold", "pip3_site_neighbourhood", "pip4_similarity_ranking", "ml11_cluster_quality", "ml14_cluster_vectors", "txt4_compare_roots",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(app="toposcan-bench")
    catalog.QUERIES["agg1_value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
