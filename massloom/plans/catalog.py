"""Named queries over the fixture run, each with the SQL that it is compared with."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom import fixtures
from massloom.fixtures import Run
from massloom.functions import cv, decode
from massloom.operators import aggregates as A
from massloom.operators import contract as C
from massloom.operators import filters as P
from massloom.operators import joins as J
from massloom.operators import traces as T
from massloom.operators import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, make: Callable[[Run], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(fixtures.load(spark, sf_dir))
    ORACLES[name] = fixtures.WITH + sql


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# Whole-run aggregates
query("total_peaks", "select count(*) as total_peaks from pk", lambda r: _count(r.peaks, "total_peaks"))
query("dataset_summary", "select count(distinct spectrum_id) as num_spectra, count(*) as total_peaks, min(mz) as min_mz, max(mz) as max_mz, avg(intensity) as avg_intensity, min(retention_time) as start_rt, max(retention_time) as end_rt from pl",
      lambda r: A.dataset_summary(r.spectra, r.peaks))
query("file_summary", "select count(distinct spectrum_id) as num_spectra, count(distinct case when ms_level = 1 then spectrum_id end) as num_ms1, count(distinct case when ms_level = 2 then spectrum_id end) as num_ms2, count(*) as total_peaks, min(retention_time) as min_rt, max(retention_time) as max_rt, min(mz) as min_mz, max(mz) as max_mz from pl", lambda r: A.file_summary(r.spectra, r.peaks))
query("star_summary", "select s.*, p.* from (select count(*) as num_spectra, count(*) filter (ms_level = 1) as num_ms1, count(*) filter (ms_level = 2) as num_ms2, min(retention_time) as min_rt, max(retention_time) as max_rt from sp) s, (select count(*) as total_peaks, min(mz) as min_mz, max(mz) as max_mz from pk) p", lambda r: A.star_summary(r.spectra, r.peaks))
query("ms_level_distribution", "select ms_level, count(distinct spectrum_id) as num_spectra, count(*) as num_peaks from pl group by ms_level", lambda r: A.level_statistics(r.spectra, r.peaks).select("ms_level", "num_spectra", "num_peaks"))
query("ms_level_stats", "select ms_level, count(distinct spectrum_id) as num_spectra, count(*) as num_peaks, avg(intensity) as avg_intensity, max(intensity) as max_intensity from pl group by ms_level", lambda r: A.level_statistics(r.spectra, r.peaks))
query("count_spectra", "select count(distinct spectrum_id) as num_spectra from pk", lambda r: A.count_spectra(r.peaks))
query("count_ms2_spectra", "select count(distinct spectrum_id) as num_spectra from pl where ms_level = 2", lambda r: _count(A.with_peaks(P.by_ms_level(r.spectra, 2), r.peaks), "num_spectra"))
query("ms2_spectra_rows", "select count(*) as num_spectra from sp where ms_level = 2", lambda r: _count(P.by_ms_level(r.spectra, 2), "num_spectra"))
query("precursor_mz_range", "select count(distinct spectrum_id) as num_spectra from pl where ms_level = 2 and precursor_mz between 500 and 600", lambda r: _count(A.with_peaks(P.by_precursor(r.spectra, 500, 600), r.peaks), "num_spectra"))
query("precursor_range_rows", "select count(*) as n from pl where ms_level = 2 and precursor_mz between 500 and 600", lambda r: _count(P.by_precursor(r.long, 500, 600), "n"))
query("rt_range_count", "select count(distinct spectrum_id) as num_spectra from pl where retention_time between 1000 and 2000", lambda r: _count(A.with_peaks(P.by_retention_time(r.spectra, 1000, 2000), r.peaks), "num_spectra"))
query("late_ms2_count", "select count(*) as n from pl where retention_time > 3600 and ms_level = 2", lambda r: _count(P.by_ms_level(r.long, 2).where("retention_time > 3600"), "n"))
query("high_intensity_count", "select count(*) as n from pk where intensity > 100000", lambda r: _count(r.peaks.where("intensity > 100000"), "n"))
query("full_scan_sum", "select sum(intensity) as total_intensity from pk", lambda r: r.peaks.agg(F.sum("intensity").alias("total_intensity")))
query("ms2_peak_count", "select count(*) as n from pl where ms_level = 2", lambda r: _count(P.by_ms_level(r.long, 2), "n"))
query("peaks_per_spectrum", "select avg(n) as avg_peaks, max(n) as max_peaks, min(n) as min_peaks from (select count(*) as n from pk group by spectrum_id)", lambda r: r.peaks.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("avg_peaks"), F.max("n").alias("max_peaks"), F.min("n").alias("min_peaks")))
query("minutes_summary", "select min(retention_time) / 60e0 as start_min, max(retention_time) / 60e0 as end_min, count(*) as spectra from sp", lambda r: r.spectra.agg((F.min("retention_time") / F.lit(60.0)).alias("start_min"), (F.max("retention_time") / F.lit(60.0)).alias("end_min"), F.count(F.lit(1)).alias("spectra")))
query("lossless_checksum", "select count(*) as n, round(sum(mz), 3) as mz_sum, sum(intensity) as intensity_sum from pk", lambda r: r.peaks.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mz"), 3).alias("mz_sum"), F.sum("intensity").alias("intensity_sum")))

# Histograms and distributions
query("mz_histogram", "select cast(floor(mz / 100) * 100 as double) as mz_bin, count(*) as peak_count from pk group by 1", lambda r: A.histogram(r.peaks, "mz", 100, "mz_bin"))
query("precursor_charge_dist", "select precursor_charge, count(distinct spectrum_id) as num_spectra from pl where ms_level = 2 and precursor_charge is not null group by 1", lambda r: A.with_peaks(P.by_ms_level(r.spectra, 2).where("precursor_charge is not null"), r.peaks).groupBy("precursor_charge").agg(F.count(F.lit(1)).alias("num_spectra")))
query("im_coverage", "select count(*) as total_peaks, count(ion_mobility) as im_peaks, round(count(ion_mobility) * 100e0 / count(*), 2) as im_percentage from pk", lambda r: A.mobility_coverage(r.peaks))
query("im_bins", "select cast(floor(ion_mobility / 5) * 5 as double) as im_bin, count(*) as peak_count, avg(intensity) as avg_intensity from pk where ion_mobility is not null group by 1", lambda r: r.peaks.where("ion_mobility is not null").groupBy(P.binned(F.col("ion_mobility"), 5).alias("im_bin")).agg(F.count(F.lit(1)).alias("peak_count"), F.avg("intensity").alias("avg_intensity")))
query("mz_im_histogram", "select cast(floor(mz / 10) * 10 as double) as mz_bin, cast(floor(ion_mobility / 2) * 2 as double) as im_bin, count(*) as peak_count, avg(intensity) as avg_intensity from pk where ion_mobility is not null group by 1, 2", lambda r: A.mz_mobility_histogram(r.peaks).orderBy("mz_bin", "im_bin"))
query("mass_defect", "select cast(floor(mz) as bigint) as nominal_mass, round(mz - floor(mz), 3) as mass_defect, count(*) as frequency from pl where ms_level = 1 and mz between 100 and 1000 group by 1, 2 having count(*) > 1", lambda r: P.by_ms_level(r.long, 1).where(P.mz_window(100, 1000)).groupBy(F.floor("mz").alias("nominal_mass"), F.round(F.col("mz") - F.floor("mz"), 3).alias("mass_defect")).agg(F.count(F.lit(1)).alias("frequency")).where("frequency > 1"))
query("mz_precision", "select cast(floor(mz / 100) * 100 as double) as mz_range, count(*) as peak_count, round(stddev_samp(mz), 6) as mz_stddev, avg(intensity) as avg_intensity from pl where ms_level = 1 group by 1", lambda r: P.by_ms_level(r.long, 1).groupBy(P.binned(F.col("mz"), 100).alias("mz_range")).agg(F.count(F.lit(1)).alias("peak_count"), F.round(F.stddev_samp("mz"), 6).alias("mz_stddev"), F.avg("intensity").alias("avg_intensity")))
query("peaks_per_minute", "select cast(floor(retention_time / 60) as bigint) as time_bin_min, count(*) as peak_count, avg(intensity) as avg_intensity from pl group by 1", lambda r: r.long.groupBy(F.floor(F.col("retention_time") / 60).alias("time_bin_min")).agg(F.count(F.lit(1)).alias("peak_count"), F.avg("intensity").alias("avg_intensity")))
query("rt_bins_spectra", "select cast(floor(retention_time / 60) * 60 as double) as rt_bin, count(*) as spectrum_count from sp group by 1", lambda r: r.spectra.groupBy(P.binned(F.col("retention_time"), 60).alias("rt_bin")).agg(F.count(F.lit(1)).alias("spectrum_count")))
query("polarity_stats", "select polarity, count(*) as spectra, max(retention_time) as last_rt from sp group by polarity", lambda r: r.spectra.groupBy("polarity").agg(F.count(F.lit(1)).alias("spectra"), F.max("retention_time").alias("last_rt")))

# Chromatograms
query("tic", "select spectrum_id, retention_time, sum(intensity) as tic from pl where ms_level = 1 group by 1, 2", lambda r: A.total_ion_chromatogram(r.spectra, r.peaks).orderBy("retention_time", "spectrum_id"))
query("bpc", "select spectrum_id, ms_level, retention_time, max(intensity) as base_peak_intensity, arg_max(mz, intensity) as base_peak_mz from pl where ms_level = 1 group by 1, 2, 3", lambda r: A.base_peak_chromatogram(r.spectra, r.peaks).orderBy("retention_time", "spectrum_id"))
query("xic_raw", "select retention_time, mz, intensity, spectrum_id from pl where ms_level = 1 and mz between 150.05e0 * (1 - 4e-4) and 150.05e0 * (1 + 4e-4)", lambda r: A.extracted_ion(r.spectra, r.peaks, 150.05, 400).orderBy("retention_time", "mz"))
query("xic_binned", "select round(retention_time, 1) as rt_bin, round(avg(mz), 6) as avg_mz, sum(intensity) as total_intensity, count(*) as peak_count from pl where ms_level = 1 and mz between 150.05e0 * (1 - 4e-4) and 150.05e0 * (1 + 4e-4) group by 1", lambda r: A.extracted_ion_binned(r.spectra, r.peaks, 150.05, 400).orderBy("rt_bin"))
query("xic_join", "select retention_time, sum(intensity) as total_intensity from pl where mz between 456e0 and 457e0 group by 1", lambda r: r.peaks.where(P.mz_window(456, 457)).join(r.spectra.select("spectrum_id", "retention_time"), "spectrum_id").groupBy("retention_time").agg(F.sum("intensity").alias("total_intensity")))
query("ion_image", "select pixel_x, pixel_y, sum(intensity) as intensity from pl where mz between 400e0 and 600e0 group by 1, 2", lambda r: A.ion_image(r.spectra, r.peaks, 400, 600))

# Rows
query("ms2_by_precursor", "select spectrum_id, scan_number, retention_time, precursor_mz, precursor_charge, collision_energy, count(*) as num_fragment_peaks from pl where ms_level = 2 and precursor_mz between 500 and 600 group by 1, 2, 3, 4, 5, 6",
      lambda r: P.by_precursor(r.spectra, 500, 600).select("spectrum_id", "scan_number", "retention_time", "precursor_mz", "precursor_charge", "collision_energy").join(r.peaks.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("num_fragment_peaks")), "spectrum_id"))
query("ms2_fragments", "select spectrum_id, mz, intensity from pl where ms_level = 2 and precursor_mz between 500 and 510", lambda r: P.by_precursor(r.long, 500, 510).select("spectrum_id", "mz", "intensity"))
query("precursor_list", "select spectrum_id, precursor_mz, precursor_charge from sp where precursor_mz between 500 and 600", lambda r: r.spectra.where("precursor_mz between 500 and 600").select("spectrum_id", "precursor_mz", "precursor_charge"))
query("fragments_of_spectrum", "select mz, intensity from pk where spectrum_id = 100", lambda r: P.by_id(r.peaks, 100).select("mz", "intensity").orderBy("mz", "intensity"))
query("spectrum_by_id", "select * from sp where spectrum_id = 101", lambda r: P.by_id(r.spectra, 101))
query("spectra_by_ids", "select * from sp where spectrum_id in (1, 2, 3, 500, 999)", lambda r: P.by_ids(r.spectra, [3, 1, 2, 2, 500, 999]))
query("spectra_by_rt", "select spectrum_id, retention_time, ms_level from sp where retention_time between 100 and 200", lambda r: P.by_retention_time(r.spectra, 100, 200).select("spectrum_id", "retention_time", "ms_level"))
query("spectra_by_ms_level", "select spectrum_id, retention_time from sp where ms_level = 1", lambda r: P.by_ms_level(r.spectra, 1).select("spectrum_id", "retention_time"))
query("spectrum_ids", "select spectrum_id from sp", lambda r: r.spectra.select("spectrum_id"))
query("im_range", "select spectrum_id, retention_time, mz, intensity, ion_mobility from pl where ion_mobility between 20 and 30 and mz between 400 and 800", lambda r: A.mobility_rows(r.long, 20, 30, 400, 800))
query("csv_export_rows", "select spectrum_id, retention_time, mz, intensity from pl where ms_level = 1 and mz between 400 and 600", lambda r: P.by_ms_level(r.long, 1).where(P.mz_window(400, 600)).select("spectrum_id", "retention_time", "mz", "intensity"))
query("ms2_export_rows", "select * from pl where ms_level = 2 and precursor_mz between 500 and 600", lambda r: P.by_precursor(r.long, 500, 600))
query("v1_long_view", "select * from pl", lambda r: r.long)
query("empty_spectra", "select spectrum_id, ms_level from sp where spectrum_id not in (select spectrum_id from pk)", lambda r: J.without_peaks(r.spectra, r.peaks).select("spectrum_id", "ms_level"))
query("isotope_pairs", "select p1.spectrum_id, p1.mz as mz_monoisotopic, p1.intensity as intensity_mono, p2.mz as mz_isotope, p2.intensity as intensity_iso, round(p2.mz - p1.mz, 4) as mass_diff from pk p1 join pk p2 on p1.spectrum_id = p2.spectrum_id where p2.mz between p1.mz + 1e0 and p1.mz + 1.01e0 and p1.intensity > 1000 and p2.intensity > p1.intensity * 0.1e0", lambda r: J.isotope_pairs(r.peaks, least=1000))

# Top k
query("top_100_peaks", "select spectrum_id, mz, intensity from pk order by intensity desc, spectrum_id, mz limit 100", lambda r: r.peaks.select("spectrum_id", "mz", "intensity").orderBy(F.desc("intensity"), "spectrum_id", "mz").limit(100))
query("top_20_fragments", "select precursor_mz, mz as fragment_mz, intensity, retention_time from pl where ms_level = 2 and intensity > 1e5 order by intensity desc, spectrum_id, mz limit 20", lambda r: P.by_ms_level(r.long, 2).where("intensity > 1e5").orderBy(F.desc("intensity"), "spectrum_id", "mz").limit(20).select("precursor_mz", F.col("mz").alias("fragment_mz"), "intensity", "retention_time"))
query("complex_filter_top50", "select spectrum_id, precursor_mz, precursor_charge, count(*) as num_peaks, max(intensity) as max_intensity from pl where ms_level = 2 and precursor_mz between 400 and 800 and precursor_charge in (2, 3, 4) and intensity > 10000 group by 1, 2, 3 order by max_intensity desc, spectrum_id limit 50",
      lambda r: P.by_precursor(r.long, 400, 800).where("precursor_charge in (2, 3, 4) and intensity > 10000").groupBy("spectrum_id", "precursor_mz", "precursor_charge").agg(F.count(F.lit(1)).alias("num_peaks"), F.max("intensity").alias("max_intensity")).orderBy(F.desc("max_intensity"), "spectrum_id").limit(50))
query("projection_limit", "select retention_time, mz, intensity from pl where ms_level = 1 order by spectrum_id, mz, intensity limit 1000", lambda r: P.by_ms_level(r.long, 1).orderBy("spectrum_id", "mz", "intensity").limit(1000).select("retention_time", "mz", "intensity"))
query("top_n_per_spectrum", "select spectrum_id, mz, intensity, cast(rank as bigint) as rank from (select *, row_number() over (partition by spectrum_id order by intensity desc, mz, ion_mobility nulls first) as rank from pk) where rank <= 3", lambda r: W.top_peaks(r.peaks, 3).select("spectrum_id", "mz", "intensity", F.col("rank").cast("long").alias("rank")))

# Per spectrum
query("unusual_spectra", "select spectrum_id, ms_level, retention_time, count(*) as num_peaks, sum(intensity) as total_intensity from pl group by 1, 2, 3 having count(*) < 2 or count(*) > 9",
      lambda r: r.peaks.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("num_peaks"), F.sum("intensity").alias("total_intensity")).where("num_peaks < 2 or num_peaks > 9").join(r.spectra.select("spectrum_id", "ms_level", "retention_time"), "spectrum_id").orderBy(F.desc("num_peaks"), "spectrum_id"))
query("per_spectrum_stats", "select spectrum_id, count(*) as num_peaks, min(mz) as min_mz, max(mz) as max_mz, sum(intensity) as total_intensity, avg(intensity) as avg_intensity from pk group by 1", lambda r: A.spectrum_summary(r.peaks))
query("combined_filter", "select spectrum_id, count(*) as num_peaks from pl where ms_level = 2 and retention_time between 100 and 200 and intensity >= 5000 group by 1", lambda r: P.at_least(P.by_retention_time(P.by_ms_level(r.long, 2), 100, 200), 5000).groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("num_peaks")))
query("compute_statistics", "select spectrum_id, sum(cast(intensity as double)) as total_ion_current, arg_max(mz, intensity) as base_peak_mz, max(intensity) as base_peak_intensity from pk group by 1", lambda r: A.compute_statistics(r.peaks))
query("im_nullness", "select spectrum_id, case when count(ion_mobility) = 0 then 'none' when count(ion_mobility) = count(*) then 'all' else 'mixed' end as mobility from pk group by 1", lambda r: A.mobility_nullness(r.peaks))
query("modality", "select (select count(ion_mobility) > 0 from pk) as has_mobility, (select count(*) > 0 from sp where pixel_x is not null) as has_pixels, 'msi-ims' as modality", lambda r: A.modality(r.spectra, r.peaks))
query("collected_peaks", "select spectrum_id, count(*) as n, min(mz) as first_mz from pk group by 1", lambda r: T.collect_peaks(r.peaks).select("spectrum_id", F.size("peaks").cast("long").alias("n"), F.col("peaks")[0]["mz"].alias("first_mz")))

# Ordered
# Gaps and late times are planted: order keys have none.
_GAPS, _LATE = "spectrum_id % 97 <> 5", "cast(retention_time - case when spectrum_id % 50 = 7 then 100 else 0 end as float)"
_SPANS = f"ordered as (select spectrum_id, lag(spectrum_id) over (order by spectrum_id) as p, {_LATE} as retention_time, lag({_LATE}) over (order by spectrum_id) as prt from sp where {_GAPS})"
query("id_contiguity", f"select spectrum_id, p as prev_spectrum_id from (with {_SPANS} select * from ordered) where p + 1 <> spectrum_id", lambda r: W.contiguity_violations(r.spectra.where(_GAPS)))
query("ms1_contiguity", "select spectrum_id, p as prev_spectrum_id from (select spectrum_id, lag(spectrum_id) over (order by spectrum_id) as p from sp where ms_level = 1) where p + 1 <> spectrum_id", lambda r: W.contiguity_violations(P.by_ms_level(r.spectra, 1)))
query("rt_monotonic_check", f"select spectrum_id, retention_time, prt as prev_retention_time from (with {_SPANS} select * from ordered) where prt > retention_time", lambda r: W.order_violations(r.spectra.where(_GAPS).withColumn("retention_time", F.expr(_LATE))))
query("peak_offsets", "select spectrum_id, n as peak_count, cast(coalesce(sum(n) over (order by spectrum_id rows between unbounded preceding and 1 preceding), 0) as bigint) as peak_offset from (select sp.spectrum_id, count(pk.spectrum_id) as n from sp left join pk on sp.spectrum_id = pk.spectrum_id group by 1)",
      lambda r: W.prefix_sum(r.spectra.select("spectrum_id").join(r.peaks.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("n")), "spectrum_id", "left").select("spectrum_id", F.coalesce("n", F.lit(0)).alias("peak_count")), "peak_count", "peak_offset"))
query("run_segments", "select run, ms_level, count(*) as length from (select ms_level, cast(sum(new) over (order by spectrum_id) as bigint) as run from (select spectrum_id, ms_level, case when lag(ms_level) over (order by spectrum_id) = ms_level then 0 else 1 end as new from sp)) group by 1, 2", lambda r: W.runs(r.spectra, "ms_level", "spectrum_id"))
query("worker_partition", "select worker, count(*) as spectra, min(spectrum_id) as first_id from (select spectrum_id, cast(ntile(7) over (order by spectrum_id) - 1 as bigint) as worker from sp) group by 1", lambda r: W.workers(r.spectra, 7).groupBy(F.col("worker").cast("long").alias("worker")).agg(F.count(F.lit(1)).alias("spectra"), F.min("spectrum_id").alias("first_id")))
query("shard_union", "select count(*) as n, count(distinct spectrum_id) as spectra from (select * from pk where spectrum_id % 2 = 0 union all select * from pk where spectrum_id % 2 <> 0)", lambda r: r.peaks.where("spectrum_id % 2 = 0").unionByName(r.peaks.where("spectrum_id % 2 <> 0")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("spectrum_id").alias("spectra")))

# Traces
query("tic_trace_unnest", "select cast(floor(spectrum_id / 1000) as bigint) as chromatogram_id, cast(retention_time as double) as time, cast(sum(intensity) as float) as intensity from pl where ms_level = 1 group by spectrum_id, retention_time", lambda r: T.unnest(fixtures.traces(r)))
query("trace_extents", "select cast(floor(spectrum_id / 1000) as bigint) as chromatogram_id, cast(min(rt) as double) as first_rt, cast(max(rt) as double) as last_rt, cast(min(y) as float) as min_intensity, cast(max(y) as float) as max_intensity, cast(count(*) as bigint) as num_points from (select spectrum_id, max(retention_time) as rt, cast(sum(intensity) as float) as y from pl where ms_level = 1 group by spectrum_id) group by 1", lambda r: T.extents(fixtures.traces(r)).withColumn("num_points", F.col("num_points").cast("long")))
query("mobilogram_tim", "select 'TIM' as mobilogram_id, ion_mobility as time, cast(sum(intensity) as float) as intensity from pk where ion_mobility is not null group by 2", lambda r: T.unnest(T.mobilogram(r.peaks), "mobilogram_id", "mobility_array"))
query("mobilogram_xim", "select 'XIM' as mobilogram_id, ion_mobility as time, cast(sum(intensity) as float) as intensity from pk where ion_mobility is not null and mz between 300e0 and 500e0 group by 2", lambda r: T.unnest(T.mobilogram(r.peaks, "XIM", 300, 500), "mobilogram_id", "mobility_array"))

# Checks
query("v2_narrowing_check", "select count(*) filter (spectrum_id not between 0 and 4294967295) as spectrum_id, count(*) filter (scan_number not between -2147483648 and 2147483647) as scan_number, count(*) filter (ms_level not between 1 and 255) as ms_level, count(*) filter (precursor_charge not between -128 and 127) as precursor_charge, count(*) filter (pixel_x not between 0 and 65535) as pixel_x, count(*) filter (pixel_y not between 0 and 65535) as pixel_y from sp", lambda r: C.narrowing_counts(r.spectra))
query("mixed_mobility_check", "select spectrum_id from pk group by 1 having count(ion_mobility) > 0 and count(ion_mobility) < count(*)", lambda r: C.mixed_mobility(r.peaks))
query("validator_data_checks", "select (select count(*) from pk where not mz > 0) as bad_mz, (select count(*) from pk where not intensity >= 0) as bad_intensity, (select count(*) from sp where ms_level < 1) as bad_ms_level, (select count(*) from sp where polarity not in (-1, 0, 1)) as bad_polarity", lambda r: C.data_counts(r.spectra, r.peaks))

_BAD_PEAKS = "select spectrum_id, case when spectrum_id % 101 = 3 then -mz else mz end as mz, cast(case when spectrum_id % 103 = 4 then -intensity else intensity end as float) as intensity, ion_mobility from {pk}"
_BAD_SPECTRA = "select * except ({0}), cast(case when spectrum_id % 107 = 5 then 0 else ms_level end as smallint) as ms_level, cast(case when spectrum_id % 109 = 6 then 2 else polarity end as tinyint) as polarity, case when spectrum_id % 113 = 7 then spectrum_id + 5000000000 else scan_number end as scan_number from {{sp}}"
_HIDDEN = "ms_level, polarity, scan_number"


def _planted(r: Run) -> Run:
    """The run with values that break the data rules."""
    spark = r.peaks.sparkSession
    return Run(spark.sql(_BAD_SPECTRA.format(_HIDDEN), sp=r.spectra), spark.sql(_BAD_PEAKS, pk=r.peaks))


_BAD = f"bpk as ({_BAD_PEAKS.format(pk='pk')}), bsp as ({_BAD_SPECTRA.format(_HIDDEN).replace('except', 'exclude').format(sp='sp')})"
query("validator_planted", f"select * from (with {_BAD} select (select count(*) from bpk where not mz > 0) as bad_mz, (select count(*) from bpk where not intensity >= 0) as bad_intensity, (select count(*) from bsp where ms_level < 1) as bad_ms_level, (select count(*) from bsp where polarity not in (-1, 0, 1)) as bad_polarity)", lambda r: C.data_counts(_planted(r).spectra, _planted(r).peaks))
query("narrowing_planted", f"select * from (with {_BAD} select count(*) filter (scan_number not between -2147483648 and 2147483647) as scan_number, count(*) filter (ms_level not between 1 and 255) as ms_level from bsp)", lambda r: C.narrowing_counts(_planted(r).spectra).select("scan_number", "ms_level"))
query("contract_violations", f"select * from (with {_BAD} select violation, count(*) as n from (select unnest([case when ms_level < 1 then 'ms_level must be at least 1' end, case when polarity not in (-1, 0, 1) then 'polarity must be -1, 0 or 1' end]) as violation from bsp where spectrum_id in (select spectrum_id from bpk)) where violation is not null group by 1)",
      lambda r: C.with_violations(_planted(r).spectra.join(T.collect_peaks(_planted(r).peaks), "spectrum_id")).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n")))
query("ingest_statistics", "select spectrum_id, sum(cast(intensity as double)) as total_ion_current, max(intensity) as base_peak_intensity from pk group by 1",
      lambda r: C.ingest(r.spectra.withColumns({"total_ion_current": F.lit(None).cast("double"), "base_peak_mz": F.lit(None).cast("double"), "base_peak_intensity": F.lit(None).cast("float")}).join(T.collect_peaks(r.peaks), "spectrum_id")).select("spectrum_id", "total_ion_current", "base_peak_intensity"))
query("last_base_peak", "select spectrum_id, max(mz) as base_peak_mz, max(intensity) as base_peak_intensity from (select *, max(intensity) over (partition by spectrum_id) as top from pk) where intensity = top group by 1",
      lambda r: T.collect_peaks(r.peaks).select("spectrum_id", A.peak_statistics(F.col("peaks"), last_wins=True).alias("s")).select("spectrum_id", F.col("s.mz").alias("base_peak_mz"), F.col("s.intensity").alias("base_peak_intensity")))
query("modality_violations", "select spectrum_id from pk group by 1 having count(ion_mobility) < count(*)", lambda r: C.modality_violations(r.spectra.join(T.collect_peaks(r.peaks), "spectrum_id"), True, True).select("spectrum_id"))
query("offset_violations", "select spectrum_id, cast(o as bigint) as expected_offset from (select spectrum_id, coalesce(sum(1 + spectrum_id % 5) over (order by spectrum_id rows between unbounded preceding and 1 preceding), 0) as o from sp) where spectrum_id % 50 = 3",
      lambda r: J.offset_violations(W.prefix_sum(r.spectra.select("spectrum_id", (1 + F.col("spectrum_id") % 5).alias("peak_count")), "peak_count", "peak_offset").withColumn("peak_offset", F.col("peak_offset") + F.when(F.col("spectrum_id") % 50 == 3, 1).otherwise(0))).select("spectrum_id", "expected_offset"))
query("ordered_peak_counts", "select spectrum_id, count(*) as num_peaks from pk group by 1", lambda r: r.peaks.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("num_peaks")).orderBy(F.desc("num_peaks"), "spectrum_id"))

# Joins and vocabulary of the sources
query("first_precursor", "select sp.spectrum_id as frame_id, arg_min(mz, mz) as mz from sp left join pk on sp.spectrum_id = pk.spectrum_id and pk.intensity > 30000 group by 1",
      lambda r: J.first_precursor(r.spectra.select(F.col("spectrum_id").alias("frame_id")), r.peaks.where("intensity > 30000").select(F.col("spectrum_id").alias("frame_id"), "mz"), order="mz"))
query("calibrated_times", "select spectrum_id as frame_id, cast(case when spectrum_id % 5 = 0 then spectrum_id * 2 else retention_time end as float) as retention_time from sp",
      lambda r: J.calibrated(r.spectra.select(F.col("spectrum_id").alias("frame_id"), "retention_time"), r.spectra.where("spectrum_id % 5 = 0").select(F.col("spectrum_id").alias("frame_id"), (F.col("spectrum_id") * 2).cast("float").alias("retention_time"))))
query("scan_mobility", "select spectrum_id as frame_id, position, scan, mobility from sp, (values (0, 0, 0.5e0), (1, 0, 0.5e0), (2, 2, 0.9e0), (3, 2, 0.9e0), (4, 2, 0.9e0)) as v(position, scan, mobility) where spectrum_id < 500",
      lambda r: J.scan_mobility(r.spectra.where("spectrum_id < 500").select(F.col("spectrum_id").alias("frame_id"), F.expr("array(0, 2, 2, 5)").alias("scan_offsets"), F.expr("array(0.5e0, 0.7e0, 0.9e0)").alias("scan_mobility"))))
query("scan_numbers", "select spectrum_id, cast(case when spectrum_id % 3 = 2 then scan_number + 1 else spectrum_id end as bigint) as scan from sp",
      lambda r: r.spectra.select("spectrum_id", cv.scan_number(F.expr("case spectrum_id % 3 when 0 then concat('controllerType=0 controllerNumber=1 scan=', spectrum_id) when 1 then concat('S', spectrum_id) else concat('index=', spectrum_id) end"), F.col("scan_number")).alias("scan")))
#: 1, 2, 3 and 4 as 64-bit floats.
_FOUR = base64.b64encode(struct.pack("<4d", 1, 2, 3, 4)).decode()
_TERM = "array(named_struct('_accession', '{}', '_value', cast({} as string), '_unitAccession', '{}'))"
query("chromatogram_types", "select * from (values ('MS:1000235', 'TIC'), ('MS:1000628', 'BPC'), ('MS:1000627', 'XIC'), ('MS:1000908', 'SRM'), ('MS:1001473', 'SRM'), ('MS:1001472', 'SIM'), ('MS:1000812', 'Absorption'), ('MS:1000813', 'Emission'), ('MS:1000576', 'Unknown')) as v(accession, kind)",
      lambda r: r.peaks.sparkSession.sql("select accession, array(named_struct('_accession', accession)) as params from values ('MS:1000235'), ('MS:1000628'), ('MS:1000627'), ('MS:1000908'), ('MS:1001473'), ('MS:1001472'), ('MS:1000812'), ('MS:1000813'), ('MS:1000576') as v(accession)").select("accession", cv.chromatogram_type(F.col("params")).alias("kind")))
query("times_in_seconds", "select spectrum_id, spectrum_id * 60e0 as minutes, spectrum_id / 1000e0 as milliseconds, spectrum_id * 1e0 as plain from sp",
      lambda r: r.spectra.select("spectrum_id", *(cv.seconds(F.expr(_TERM.format(cv.SCAN_START_TIME, "spectrum_id", unit)), cv.SCAN_START_TIME).alias(name) for name, unit in (("minutes", cv.MINUTE), ("milliseconds", cv.MILLISECOND), ("plain", "UO:0000010")))))
query("polarity_terms", "select spectrum_id, case when spectrum_id % 3 = 0 then 1 when spectrum_id % 3 = 1 then -1 else 0 end as polarity from sp",
      lambda r: r.spectra.select("spectrum_id", F.when(F.col("spectrum_id") % 3 == 0, cv.polarity(F.expr(_TERM.format(cv.POSITIVE, 1, "")))).when(F.col("spectrum_id") % 3 == 1, cv.polarity(F.expr(_TERM.format(cv.NEGATIVE, 1, "")))).otherwise(cv.polarity(F.expr(_TERM.format(cv.MS_LEVEL, 1, "")))).cast("int").alias("polarity")))
query("corrected_intensity", "select spectrum_id, mz, cast(cast(intensity as double) * 0.25e0 as float) as intensity from pk", lambda r: r.peaks.select("spectrum_id", "mz", cv.corrected(F.col("intensity"), F.lit(0.25)).alias("intensity")))
query("isolation_windows", "select spectrum_id, precursor_mz - 1.5e0 as lower_mz, precursor_mz + 1.5e0 as upper_mz from sp", lambda r: r.spectra.select("spectrum_id", cv.window(F.col("precursor_mz"), F.lit(1.5), -1).alias("lower_mz"), cv.window(F.col("precursor_mz"), F.lit(1.5), 1).alias("upper_mz")))
query("decoded_arrays", "select spectrum_id, x from sp, (values (1e0), (2e0), (3e0), (4e0)) as v(x) where spectrum_id < 200", lambda r: r.spectra.where("spectrum_id < 200").select("spectrum_id", F.explode(decode.decode_array(F.lit(_FOUR), F.lit(True), F.lit(False), F.lit(False), F.lit(4).cast("long"))).alias("x")))
query("contract_round_trip", "select spectrum_id, ms_level, mz, intensity, ion_mobility from pl", lambda r: T.explode_peaks(r.spectra.select("spectrum_id", "ms_level").join(T.collect_peaks(r.peaks), "spectrum_id")))


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling parts of at most 20,000 peaks over write batches of 1,024 spectra ids: a fold over batch sizes, one value per batch."""
    run = fixtures.load(spark, sf_dir)
    batches = run.peaks.groupBy(F.floor(F.col("spectrum_id") / 1024).alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    listed = batches.agg(F.array_sort(F.collect_list(F.struct("batch", "n"))).alias("b"))
    return listed.select(F.explode(F.arrays_zip(F.col("b.batch").alias("batch"), F.col("b.n").alias("n"), W.shard_numbers(F.col("b.n"), 20_000).alias("part"))).alias("r")).select("r.*")


QUERIES["shard_assignment"] = _shards
ORACLES["shard_assignment"] = fixtures.WITH.replace("with sp", "with recursive sp", 1).rstrip().rstrip(",") + """, b as (select cast(floor(spectrum_id / 1024) as bigint) as batch, count(*) as n from pk group by 1), o as (select *, row_number() over (order by batch) as i from b),
f as (select i, batch, n, 0 as part, n as held from o where i = 1 union all
  select o.i, o.batch, o.n, case when f.held > 0 and f.held + o.n > 20000 then f.part + 1 else f.part end, case when f.held > 0 and f.held + o.n > 20000 then o.n else f.held + o.n end from f join o on o.i = f.i + 1)
select batch, n, part from f"""
