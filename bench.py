"""Headline queries timed on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "revenue_by_nation", "flt1_number_filter", "jon1_star_join", "jon5_first_stay_only", "agg1_group_aggregate", "agg2_chart_median", "agg8_boxplot", "agg9_pareto",
    "win2_latest_per_key", "win5_avg_rank", "win6_rolling", "sta1_quality", "sta2_numeric_profile", "sta3_categorical_profile", "sta8_pearson_matrix",
    "sta9_spearman_nulls", "sta11_cramers_v", "sta16_kruskal", "imp1_mean_median", "imp5_linear", "scl1_standard", "enc1_label", "enc6_target", "out1_iqr",
    "pip1_steps", "tsr8_rolling_median", "tsr9_ewm", "spl2_stratified", "tsa2_acf", "tsa4_decompose", "ind3_plan_ratio", "ind8_type_coverage", "ind11_monthly_series",
    "ind16_organization_coverage", "ind27_applicability", "ind36_gap_summary"]


def main() -> None:
    from planlens.catalog import QUERIES
    from planlens.session import session
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus))
    QUERIES["revenue_by_nation"](spark, directory).collect()  # start the JVM workers before timing
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(directory)}))


if __name__ == "__main__":
    main()
