"""Wide traces (chromatograms, mobilograms): building, unnesting, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(traces: DataFrame, key: str = "chromatogram_id", x: str = "time_array", y: str = "intensity_array") -> DataFrame:
    """(key, time, intensity): one row per point."""
    return traces.select(key, F.explode(F.arrays_zip(F.col(x).alias("time"), F.col(y).alias("intensity"))).alias("p")).select(key, "p.time", "p.intensity")


def tic_and_bpc(contract: DataFrame) -> DataFrame:
    """TIC and BPC traces of the MS1 rows of contract data; declared values come before computed ones, a null time is 0."""
    tic = F.coalesce("total_ion_current", F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"]))
    bpc = F.coalesce(F.col("base_peak_intensity"), F.aggregate("peaks", F.lit(0.0).cast("float"), lambda a, p: F.greatest(a, p["intensity"])))
    points = contract.where("ms_level = 1").select(F.coalesce(F.col("retention_time").cast("double"), F.lit(0.0)).alias("t"), tic.cast("float").alias("TIC"), bpc.cast("float").alias("BPC"))
    rows = points.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), "t", F.col(k).alias("y")) for k in ("TIC", "BPC")))).alias("r")).select("r.*")
    made = rows.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("p"))
    return made.select(F.col("kind").alias("chromatogram_id"), F.col("kind").alias("chromatogram_type"), F.col("p.t").alias("time_array"), F.col("p.y").alias("intensity_array"))


def mobilogram(peaks: DataFrame, kind: str = "TIM", low: float | None = None, high: float | None = None) -> DataFrame:
    """Intensity by mobility (TIM), or of an m/z window (XIM), as one wide trace."""
    rows = peaks.where("ion_mobility is not null")
    if low is not None:
        rows = rows.where(F.col("mz").between(low, high))
    sums = rows.groupBy("ion_mobility").agg(F.sum("intensity").alias("y"))
    made = sums.agg(F.array_sort(F.collect_list(F.struct("ion_mobility", F.col("y").cast("float").alias("y")))).alias("p"))
    return made.select(F.lit(kind).alias("mobilogram_id"), F.lit(kind).alias("mobilogram_type"), F.col("p.ion_mobility").alias("mobility_array"), F.col("p.y").alias("intensity_array"))


def extents(traces: DataFrame, key: str = "chromatogram_id") -> DataFrame:
    """First and last time, least and largest intensity and number of points of each trace."""
    return traces.select(key, F.try_element_at("time_array", F.lit(1)).alias("first_rt"), F.try_element_at("time_array", F.lit(-1)).alias("last_rt"), F.array_min("intensity_array").alias("min_intensity"), F.array_max("intensity_array").alias("max_intensity"), F.size("time_array").alias("num_points"))


def checked(traces: DataFrame, x: str = "time_array", y: str = "intensity_array") -> DataFrame:
    """The traces; the job fails at one whose arrays differ in length."""
    same = F.size(x) == F.size(y)
    return traces.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("trace arrays differ in length: "), F.size(x).cast("string"), F.lit(" and "), F.size(y).cast("string"))).cast("boolean")))


def collect_peaks(peaks: DataFrame) -> DataFrame:
    """(spectrum_id, peaks): each spectrum's peaks as an array sorted by m/z."""
    return peaks.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity", "ion_mobility"))).alias("peaks"))


def explode_peaks(rows: DataFrame, scalars: list[str] | None = None) -> DataFrame:
    """One row per peak, with the spectrum's scalars."""
    keep = scalars or [c for c in rows.columns if c != "peaks"]
    return rows.select(*keep, F.inline("peaks"))


def points(array: Column) -> Column:
    return F.size(array)
