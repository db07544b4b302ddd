"""Summaries, histograms, chromatograms and per-spectrum statistics. Every one is a partial aggregate before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators.filters import binned, mobility_window, ppm_window


def per_spectrum(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Spectra that have peaks, with n, total, highest, min_mz and max_mz of them. Peaks are aggregated before the join, so it moves a row per spectrum."""
    sums = peaks.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("total"), F.max("intensity").alias("highest"), F.min("mz").alias("min_mz"), F.max("mz").alias("max_mz"))
    return spectra.join(sums, "spectrum_id")


def file_summary(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Spectra that have peaks by level, ranges and peaks."""
    level = lambda n: F.count_if(F.col("ms_level") == n)
    return per_spectrum(spectra, peaks).agg(
        F.count(F.lit(1)).alias("num_spectra"), level(1).alias("num_ms1"), level(2).alias("num_ms2"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_peaks"),
        F.min("retention_time").alias("min_rt"), F.max("retention_time").alias("max_rt"), F.min("min_mz").alias("min_mz"), F.max("max_mz").alias("max_mz"),
    )


def dataset_summary(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    return per_spectrum(spectra, peaks).agg(
        F.count(F.lit(1)).alias("num_spectra"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_peaks"), F.min("min_mz").alias("min_mz"), F.max("max_mz").alias("max_mz"),
        F.try_divide(F.sum("total"), F.sum("n")).alias("avg_intensity"), F.min("retention_time").alias("start_rt"), F.max("retention_time").alias("end_rt"),
    )


def star_summary(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """The same from the two tables without joining them: one row of each, put side by side."""
    level = lambda n: F.count_if(F.col("ms_level") == n)
    s = spectra.agg(F.count(F.lit(1)).alias("num_spectra"), level(1).alias("num_ms1"), level(2).alias("num_ms2"), F.min("retention_time").alias("min_rt"), F.max("retention_time").alias("max_rt"), F.lit(1).alias("one"))
    p = peaks.agg(F.count(F.lit(1)).alias("total_peaks"), F.min("mz").alias("min_mz"), F.max("mz").alias("max_mz"), F.lit(1).alias("one"))
    return s.join(p, "one").drop("one")


def level_statistics(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    by = per_spectrum(spectra.select("spectrum_id", "ms_level"), peaks).groupBy("ms_level")
    return by.agg(F.count(F.lit(1)).alias("num_spectra"), F.sum("n").alias("num_peaks"), (F.sum("total") / F.sum("n")).alias("avg_intensity"), F.max("highest").alias("max_intensity"))


def with_peaks(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Spectra that have peaks; ids of peaks are made distinct before the join."""
    return spectra.join(peaks.select("spectrum_id").distinct(), "spectrum_id")


def count_spectra(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("spectrum_id").alias("num_spectra"))


def histogram(rows: DataFrame, value: str, width: float, name: str) -> DataFrame:
    return rows.groupBy(binned(F.col(value), width).alias(name)).agg(F.count(F.lit(1)).alias("peak_count"))


def mobility_coverage(peaks: DataFrame) -> DataFrame:
    share = F.count("ion_mobility") * F.lit(100.0) / F.count(F.lit(1))
    return peaks.agg(F.count(F.lit(1)).alias("total_peaks"), F.count("ion_mobility").alias("im_peaks"), F.round(share, 2).cast("double").alias("im_percentage"))


def mz_mobility_histogram(peaks: DataFrame, mz_width: float = 10, mobility_width: float = 2) -> DataFrame:
    return (
        peaks.where("ion_mobility is not null")
        .groupBy(binned(F.col("mz"), mz_width).alias("mz_bin"), binned(F.col("ion_mobility"), mobility_width).alias("im_bin"))
        .agg(F.count(F.lit(1)).alias("peak_count"), F.avg("intensity").alias("avg_intensity"))
    )


def total_ion_chromatogram(spectra: DataFrame, peaks: DataFrame, level: int = 1) -> DataFrame:
    """Peaks are summed before the join, so the join moves a row per spectrum."""
    sums = peaks.groupBy("spectrum_id").agg(F.sum("intensity").alias("tic"))
    return spectra.where(F.col("ms_level") == level).select("spectrum_id", "retention_time").join(sums, "spectrum_id")


def base_peak(order: Column | None = None) -> Column:
    """(intensity, mz) of the strongest peak; the smallest `order` (m/z by default) wins ties; NaN never does."""
    order = F.col("mz") if order is None else order
    kept = F.when(~F.isnan("intensity") & (F.col("intensity") > 0), F.struct(F.col("intensity").alias("i"), (-order).alias("o"), F.col("mz").alias("m")))
    return F.max(kept)


def base_peak_chromatogram(spectra: DataFrame, peaks: DataFrame, level: int = 1) -> DataFrame:
    best = peaks.groupBy("spectrum_id").agg(base_peak().alias("b")).select("spectrum_id", F.col("b.i").alias("base_peak_intensity"), F.col("b.m").alias("base_peak_mz"))
    return spectra.where(F.col("ms_level") == level).select("spectrum_id", "ms_level", "retention_time").join(best, "spectrum_id")


def extracted_ion(spectra: DataFrame, peaks: DataFrame, centre: float, ppm: float, level: int = 1) -> DataFrame:
    """Peaks within ppm of an m/z; the filter reaches the scan of peaks before the join."""
    return peaks.where(ppm_window(centre, ppm)).join(spectra.where(F.col("ms_level") == level).select("spectrum_id", "retention_time"), "spectrum_id").select("retention_time", "mz", "intensity", "spectrum_id")


def extracted_ion_binned(spectra: DataFrame, peaks: DataFrame, centre: float, ppm: float, level: int = 1) -> DataFrame:
    x = extracted_ion(spectra, peaks, centre, ppm, level)
    return x.groupBy(F.round("retention_time", 1).alias("rt_bin")).agg(F.round(F.avg("mz"), 6).alias("avg_mz"), F.sum("intensity").alias("total_intensity"), F.count(F.lit(1)).alias("peak_count"))


def compute_statistics(peaks: DataFrame) -> DataFrame:
    """Total ion current and base peak of each spectrum that has peaks: the sum may be NaN, an all-zero spectrum has base peak (0, 0)."""
    stats = peaks.groupBy("spectrum_id").agg(F.sum(F.col("intensity").cast("double")).alias("total_ion_current"), base_peak().alias("b"))
    return stats.select("spectrum_id", "total_ion_current", F.coalesce("b.m", F.lit(0.0)).alias("base_peak_mz"), F.coalesce(F.col("b.i"), F.lit(0.0).cast("float")).alias("base_peak_intensity"))


def peak_statistics(peaks: Column, last_wins: bool = False) -> Column:
    """The same of an array of peaks, in its order: the first strict maximum from 0 wins, or the last (frames). Null when empty."""
    start = F.struct(F.lit(0.0).alias("tic"), F.lit(0.0).alias("mz"), F.lit(0.0).cast("float").alias("intensity"))

    def step(acc: Column, p: Column) -> Column:
        better = ~F.isnan(p["intensity"]) & ((p["intensity"] >= acc["intensity"]) if last_wins else (p["intensity"] > acc["intensity"]))
        return F.struct((acc["tic"] + p["intensity"]).alias("tic"), F.when(better, p["mz"]).otherwise(acc["mz"]).alias("mz"), F.when(better, p["intensity"]).otherwise(acc["intensity"]).alias("intensity"))

    return F.when(F.size(peaks) > 0, F.aggregate(peaks, start, step))


def spectrum_summary(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("num_peaks"), F.min("mz").alias("min_mz"), F.max("mz").alias("max_mz"), F.sum("intensity").alias("total_intensity"), F.avg("intensity").alias("avg_intensity"))


def ion_image(spectra: DataFrame, peaks: DataFrame, low: float, high: float) -> DataFrame:
    """Intensity of an m/z window per pixel."""
    sums = peaks.where(F.col("mz").between(low, high)).groupBy("spectrum_id").agg(F.sum("intensity").alias("y"))
    return sums.join(spectra.select("spectrum_id", "pixel_x", "pixel_y"), "spectrum_id").groupBy("pixel_x", "pixel_y").agg(F.sum("y").alias("intensity"))


def mobility_rows(long: DataFrame, low: float, high: float, mz_low: float, mz_high: float) -> DataFrame:
    return long.where(mobility_window(low, high) & F.col("mz").between(mz_low, mz_high)).select("spectrum_id", "retention_time", "mz", "intensity", "ion_mobility")


def modality(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """One row: whether there is ion mobility and whether there are pixels, and the name of that."""
    m = peaks.agg(F.coalesce(F.bool_or(F.col("ion_mobility").isNotNull()), F.lit(False)).alias("has_mobility"), F.lit(1).alias("one"))
    p = spectra.agg(F.coalesce(F.bool_or(F.col("pixel_x").isNotNull() & F.col("pixel_y").isNotNull()), F.lit(False)).alias("has_pixels"), F.lit(1).alias("one"))
    name = F.when(F.col("has_pixels"), F.when(F.col("has_mobility"), "msi-ims").otherwise("msi")).otherwise(F.when(F.col("has_mobility"), "lc-ims-ms").otherwise("lc-ms"))
    return m.join(p, "one").select("has_mobility", "has_pixels", name.alias("modality"))


def mobility_nullness(peaks: DataFrame) -> DataFrame:
    """For each spectrum whether mobility is on all, none or some of its peaks."""
    n, all_ = F.count("ion_mobility"), F.count(F.lit(1))
    return peaks.groupBy("spectrum_id").agg(F.when(n == 0, "none").when(n == all_, "all").otherwise("mixed").alias("mobility"))
