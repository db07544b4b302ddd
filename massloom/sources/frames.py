"""Neutral tables of vendor frames and scans, after the vendor's decoder: one row per frame or scan becomes a contract row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom import schema
from massloom.functions import cv
from massloom.operators.aggregates import peak_statistics


def from_frames(frames: DataFrame, slope: float, intercept: float) -> DataFrame:
    """Ion-mobility frames: (frame_id, ms_level, retention_time, scan_offsets, scan_mobility, tof, intensities, correction, precursor_*, isolation_*, collision_energy).

    m/z is (intercept + slope * tof)^2; every peak gets the mobility of its scan; the last of equal maxima is the base peak.
    """
    bad = (F.size("tof") != F.size("intensities")) | (F.size("tof") == 0) | (F.element_at("scan_offsets", -1) > F.size("tof"))
    tof = F.when(bad, F.raise_error(F.concat(F.lit("frame "), F.col("frame_id").cast("string"), F.lit(" is empty or inconsistent"))).cast("array<int>")).otherwise(F.col("tof"))
    counts = F.transform("scan_mobility", lambda m, i: F.array_repeat(m, (F.element_at("scan_offsets", i + 2) - F.element_at("scan_offsets", i + 1)).cast("int")))
    mobility = F.flatten(counts)
    peaks = F.transform(F.arrays_zip(tof.alias("t"), F.col("intensities").alias("i"), mobility.alias("m")), lambda p: F.struct(F.pow(F.lit(intercept) + F.lit(slope) * p["t"], F.lit(2.0)).alias("mz"), cv.corrected(p["i"], F.col("correction")).alias("intensity"), p["m"].alias("ion_mobility")))
    rows = frames.withColumn("peaks", peaks).withColumn("_s", peak_statistics(F.col("peaks"), last_wins=True))
    half = F.col("isolation_width") / 2
    out = rows.withColumns({
        "spectrum_id": F.col("frame_id").cast("long"), "scan_number": F.col("frame_id").cast("long"), "ms_level": F.col("ms_level").cast("short"), "retention_time": F.col("retention_time").cast("float"), "polarity": F.lit(0).cast("byte"),
        "precursor_mz": F.coalesce("precursor_mz", "isolation_mz"), "precursor_charge": F.col("precursor_charge").cast("short"), "precursor_intensity": F.col("precursor_intensity").cast("float"),
        "isolation_window_lower": half.cast("float"), "isolation_window_upper": half.cast("float"), "collision_energy": F.col("collision_energy").cast("float"),
        "total_ion_current": F.col("_s.tic"), "base_peak_mz": F.col("_s.mz"), "base_peak_intensity": F.col("_s.intensity"), "injection_time": F.lit(None).cast("float"),
        **{c: F.lit(None).cast("int") for c in ("pixel_x", "pixel_y", "pixel_z")},
    })
    return out.select(*schema.CONTRACT.names)


def from_scans(scans: DataFrame) -> DataFrame:
    """Orbital-trap scans: times in minutes, values that are not positive mean absent. Columns as in the contract, with mz and intensity arrays."""
    kinds = {f.name: f.dataType for f in schema.CONTRACT.fields}
    peaks = F.transform(F.arrays_zip(F.col("mz").alias("a"), F.col("intensity").alias("b")), lambda p: F.struct(p["a"].cast("double").alias("mz"), p["b"].cast("float").alias("intensity"), F.lit(None).cast("double").alias("ion_mobility")))
    out = scans.withColumns({"retention_time": (F.col("retention_time") * 60).cast("float"), "peaks": peaks})
    for c in ("precursor_charge", "precursor_intensity", "isolation_window_lower", "isolation_window_upper", "collision_energy", "injection_time"):
        if c in out.columns:
            out = out.withColumn(c, cv.positive(F.col(c)))
    return out.select(*((F.col(c).cast(k) if c in out.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()))
