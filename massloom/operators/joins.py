"""Joins: isotope pairs over a range, first precursor of a frame, calibration, scan intervals, spectra without peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.operators.windows import prefix_sum


def isotope_pairs(peaks: DataFrame, low: float = 1.0, high: float = 1.01, least: float = 1e5, ratio: float = 0.1) -> DataFrame:
    """Pairs of a spectrum's peaks whose m/z differ by low to high. Peaks are binned by `high`, so a peak meets three or four bins, not its whole spectrum."""
    one = peaks.where(F.col("intensity") > least).select("spectrum_id", F.col("mz").alias("mz_monoisotopic"), F.col("intensity").alias("intensity_mono"))
    two = peaks.select("spectrum_id", F.col("mz").alias("mz_isotope"), F.col("intensity").alias("intensity_iso"), F.floor(F.col("mz") / high).alias("bin"))
    first = F.floor((F.col("mz_monoisotopic") + low) / high) - 1  # one more on each side: divisions are rounded
    one = one.withColumn("bin", F.explode(F.sequence(first, F.floor((F.col("mz_monoisotopic") + high) / high) + 1)))
    near = F.col("mz_isotope").between(F.col("mz_monoisotopic") + low, F.col("mz_monoisotopic") + high) & (F.col("intensity_iso") > F.col("intensity_mono") * ratio)
    return one.join(two, ["spectrum_id", "bin"]).where(near).select("spectrum_id", "mz_monoisotopic", "intensity_mono", "mz_isotope", "intensity_iso", F.round(F.col("mz_isotope") - F.col("mz_monoisotopic"), 4).alias("mass_diff"))


def first_precursor(frames: DataFrame, precursors: DataFrame, key: str = "frame_id", order: str = "precursor_id") -> DataFrame:
    """Frames with their first precursor; frames without one stay."""
    others = [c for c in precursors.columns if c != key]
    first = precursors.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("p"))
    return frames.join(first, key, "left").select("*", "p.*").drop("p")


def calibrated(frames: DataFrame, calibration: DataFrame, key: str = "frame_id") -> DataFrame:
    """Frames with the calibrated retention time where there is one."""
    c = calibration.select(key, F.col("retention_time").alias("_rt"))
    return frames.join(c, key, "left").withColumn("retention_time", F.coalesce("_rt", "retention_time")).drop("_rt")


def scan_mobility(frames: DataFrame) -> DataFrame:
    """(frame_id, position, scan, mobility): scan i covers positions scan_offsets[i] up to scan_offsets[i + 1]."""
    scans = frames.select("frame_id", "scan_offsets", F.posexplode("scan_mobility").alias("scan", "mobility"))
    begin, end = F.element_at("scan_offsets", F.col("scan") + 1), F.element_at("scan_offsets", F.col("scan") + 2)
    return scans.where(end > begin).select("frame_id", F.explode(F.sequence(begin, end - 1)).alias("position"), "scan", "mobility")


def without_peaks(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    return spectra.join(peaks.select("spectrum_id"), "spectrum_id", "left_anti")


def offset_violations(spectra: DataFrame) -> DataFrame:
    """Spectra whose peak_offset is not the number of peaks before them. Orders spectra in ranges of ids, never peaks."""
    return prefix_sum(spectra, "peak_count", "expected_offset").where("peak_offset <> expected_offset")
