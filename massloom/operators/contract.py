"""The ingest contract and its checks, as counts and as rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.errors import ContractError
from massloom.operators.aggregates import peak_statistics
from massloom.operators.filters import finite
from massloom.operators.windows import contiguity_violations

#: Ranges of the narrow types of the two-table layout.
NARROW = {"spectrum_id": (0, 2**32 - 1), "scan_number": (-(2**31), 2**31 - 1), "ms_level": (1, 255), "precursor_charge": (-128, 127), "pixel_x": (0, 65535), "pixel_y": (0, 65535), "pixel_z": (0, 65535)}


def _violations() -> list[Column]:
    some = lambda name: F.size(F.filter("peaks", lambda p: p[name].isNull()))
    return [
        F.when(~(F.col("ms_level") >= 1), F.lit("ms_level must be at least 1")),
        F.when(~F.col("polarity").isin(-1, 0, 1), F.lit("polarity must be -1, 0 or 1")),
        F.when(~finite(F.col("retention_time")), F.lit("retention_time must be finite")),
        F.when(F.col("peaks").isNull() | (some("mz") > 0) | (some("intensity") > 0), F.lit("every peak needs m/z and intensity")),
    ]


def with_violations(contract: DataFrame) -> DataFrame:
    """The rows with an array of what they break."""
    return contract.withColumn("violations", F.filter(F.array(*_violations()), lambda v: v.isNotNull()))


def ingest(contract: DataFrame) -> DataFrame:
    """The rows with statistics filled in where the total ion current is missing. The job fails at a row that breaks the contract."""
    told = F.concat(F.lit("spectrum "), F.col("spectrum_id").cast("string"), F.lit(": "), F.array_join("violations", "; "))
    ok = with_violations(contract).where(F.when(F.size("violations") == 0, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).drop("violations")
    s = ok.withColumn("_s", peak_statistics(F.col("peaks")))
    missing = F.col("total_ion_current").isNull()
    return s.withColumns({
        "total_ion_current": F.when(missing, F.col("_s.tic")).otherwise(F.col("total_ion_current")),
        "base_peak_mz": F.when(missing, F.col("_s.mz")).otherwise(F.col("base_peak_mz")),
        "base_peak_intensity": F.when(missing, F.col("_s.intensity")).otherwise(F.col("base_peak_intensity")),
    }).drop("_s")


def require_contiguous(spectra: DataFrame) -> None:
    """Raises ContractError at the first id that does not follow the one before."""
    if bad := contiguity_violations(spectra).orderBy("spectrum_id").first():
        raise ContractError(f"spectrum {bad['spectrum_id']} follows {bad['prev_spectrum_id']}")


def modality_violations(contract: DataFrame, mobility: bool, pixels: bool) -> DataFrame:
    """Rows whose peaks or pixels do not fit the modality."""
    known = F.size(F.filter("peaks", lambda p: p["ion_mobility"].isNotNull()))
    wrong = (known < F.size("peaks")) if mobility else (known > 0)
    placed = F.col("pixel_x").isNotNull() & F.col("pixel_y").isNotNull()
    return contract.where(wrong | (~placed if pixels else placed))


def narrowing_counts(spectra: DataFrame) -> DataFrame:
    """For each narrow column the number of values that do not fit."""
    return spectra.agg(*(F.count_if(~F.col(c).between(a, b)).alias(c) for c, (a, b) in NARROW.items() if c in spectra.columns))


def narrowed(spectra: DataFrame) -> DataFrame:
    """The rows; the job fails at a value that a narrow column can't hold."""
    for c, (low, high) in NARROW.items():
        if c in spectra.columns:
            told = F.raise_error(F.concat(F.lit(f"{c} does not fit: "), F.col(c).cast("string"))).cast(spectra.schema[c].dataType)
            spectra = spectra.withColumn(c, F.when(F.col(c).isNull() | F.col(c).between(low, high), F.col(c)).otherwise(told))
    return spectra


def mixed_mobility(peaks: DataFrame) -> DataFrame:
    """Spectra with mobility on some of their peaks only."""
    return peaks.groupBy("spectrum_id").agg(F.count("ion_mobility").alias("m"), F.count(F.lit(1)).alias("n")).where("m > 0 and m < n").select("spectrum_id")


def data_counts(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """How many values break each data rule; both tables are read whole."""
    p = peaks.agg(F.count_if(~(F.col("mz") > 0)).alias("bad_mz"), F.count_if(~(F.col("intensity") >= 0)).alias("bad_intensity"), F.lit(1).alias("one"))
    s = spectra.agg(F.count_if(F.col("ms_level") < 1).alias("bad_ms_level"), F.count_if(~F.col("polarity").isin(-1, 0, 1)).alias("bad_polarity"), F.lit(1).alias("one"))
    return p.join(s, "one").drop("one")
