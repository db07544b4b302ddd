"""Selections of spectra and peaks. All ranges include both ends."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer id lists become a semi join.
IDS_IN_LIST = 1000


def by_ms_level(spectra: DataFrame, level: int) -> DataFrame:
    return spectra.where(F.col("ms_level") == level)


def by_retention_time(spectra: DataFrame, start: float, end: float) -> DataFrame:
    """Bounds are compared as 32-bit floats, as the column is."""
    return spectra.where(F.col("retention_time").between(F.lit(start).cast("float"), F.lit(end).cast("float")))


def by_id(rows: DataFrame, spectrum_id: int) -> DataFrame:
    return rows.where(F.col("spectrum_id") == spectrum_id)


def by_ids(rows: DataFrame, ids: Iterable[int]) -> DataFrame:
    """Rows of a set of ids; a long list is joined so that the plan stays small."""
    wanted = sorted(set(ids))
    if len(wanted) <= IDS_IN_LIST:
        return rows.where(F.col("spectrum_id").isin(wanted))
    table = rows.sparkSession.createDataFrame([(i,) for i in wanted], "spectrum_id long")
    low, high = wanted[0], wanted[-1]
    return rows.where(F.col("spectrum_id").between(low, high)).join(table, "spectrum_id", "left_semi")


def by_precursor(rows: DataFrame, low: float, high: float) -> DataFrame:
    """MS2 rows whose precursor lies in the range; a null precursor does not."""
    return rows.where((F.col("ms_level") == 2) & F.col("precursor_mz").between(low, high))


def at_least(peaks: DataFrame, intensity: float) -> DataFrame:
    return peaks.where(F.col("intensity") >= intensity)


def ppm_window(centre: float, ppm: float) -> Column:
    return F.col("mz").between(centre * (1 - ppm * 1e-6), centre * (1 + ppm * 1e-6))


def mz_window(low: float, high: float) -> Column:
    return F.col("mz").between(low, high)


def mobility_window(low: float, high: float) -> Column:
    return F.col("ion_mobility").isNotNull() & F.col("ion_mobility").between(low, high)


def binned(value: Column, width: float) -> Column:
    """Lower edge of the bin of a value, as double."""
    return (F.floor(value / F.lit(float(width))) * F.lit(float(width))).cast("double")


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))
