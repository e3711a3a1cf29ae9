"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from statloom.queries import QUERIES
from statloom.session import build_session

HEADLINE = """
q_describe q_group_stats q_mad q_trimmed_mean q_percentile_weibull q_missing_values q_correlation q_frequency_many q_crosstab_pct
q_box_stats_long q_histogram q_kde q_ridgeline q_hexbin q_impute_auto q_clean_steps q_raw_vs_cleaned q_stack_states
q_lag_features q_rolling_mean q_interpolate q_ffill_bfill q_hourly_resample q_sliding_features q_time_split
q_sample_exact q_stratified_split q_text_features q_word_freq q_tfidf_top q_bigrams q_html_extract
q_silhouette q_regression_metrics q_linreg q_ar_forecast
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", cores, **{"spark.ui.showConsoleProgress": "false"})
    QUERIES["q_describe"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
