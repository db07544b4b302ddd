"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose input and cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from massloom.plans import catalog

HEADLINE = (
    "total_peaks", "ms_level_stats", "precursor_mz_range", "rt_range_count", "high_intensity_count", "top_100_peaks", "mz_histogram", "precursor_charge_dist", "complex_filter_top50",
    "full_scan_sum", "tic", "bpc", "xic_binned", "isotope_pairs", "top_n_per_spectrum", "compute_statistics", "spectrum_by_id", "peak_offsets", "combined_filter",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        taken[name] = round(statistics.median(times), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
