"""The data model: spectra (one row per spectrum), peaks (one row per peak), the wide view of both, and traces."""

from __future__ import annotations

from pyspark.sql import types as T

from massloom.errors import SchemaError


def _field(name: str, kind: T.DataType, null: bool, accession: str | None = None) -> T.StructField:
    return T.StructField(name, kind, null, {"cv_accession": accession} if accession else {})


L, S, I, B, D, F = T.LongType(), T.ShortType(), T.IntegerType(), T.ByteType(), T.DoubleType(), T.FloatType()  # noqa: E741

_SCALARS = [
    _field("ms_level", S, False, "MS:1000511"), _field("retention_time", F, False, "MS:1000016"), _field("polarity", B, False, "MS:1000465"),
]
_OPTIONAL = [
    _field("precursor_mz", D, True, "MS:1000744"), _field("precursor_charge", S, True, "MS:1000041"), _field("precursor_intensity", F, True, "MS:1000042"),
    _field("isolation_window_lower", F, True, "MS:1000828"), _field("isolation_window_upper", F, True, "MS:1000829"), _field("collision_energy", F, True, "MS:1000045"),
    _field("total_ion_current", D, True, "MS:1000285"), _field("base_peak_mz", D, True, "MS:1000504"), _field("base_peak_intensity", F, True, "MS:1000505"),
    _field("injection_time", F, True, "MS:1000927"), _field("pixel_x", I, True), _field("pixel_y", I, True), _field("pixel_z", I, True),
]

PEAKS_LONG = T.StructType([_field("spectrum_id", L, False), _field("scan_number", L, False), *_SCALARS, _field("mz", D, False, "MS:1000040"), _field("intensity", F, False, "MS:1000042"), _field("ion_mobility", D, True, "MS:1002476"), *_OPTIONAL])
SPECTRA = T.StructType([_field("spectrum_id", L, False), _field("scan_number", I, True), *_SCALARS, _field("peak_offset", L, False), _field("peak_count", L, False), *_OPTIONAL])
PEAKS = T.StructType([_field("spectrum_id", L, False), _field("mz", D, False, "MS:1000040"), _field("intensity", F, False, "MS:1000042"), _field("ion_mobility", D, True, "MS:1002476")])
PEAK = T.StructType([T.StructField("mz", D), T.StructField("intensity", F), T.StructField("ion_mobility", D)])
CHROMATOGRAMS = T.StructType([_field("chromatogram_id", T.StringType(), False), _field("chromatogram_type", T.StringType(), False), _field("time_array", T.ArrayType(D), False), _field("intensity_array", T.ArrayType(F), False)])
MOBILOGRAMS = T.StructType([_field("mobilogram_id", T.StringType(), False), _field("mobilogram_type", T.StringType(), False), _field("mobility_array", T.ArrayType(D), False), _field("intensity_array", T.ArrayType(F), False)])
#: What every source emits: the scalars and the peaks of a spectrum in one row.
CONTRACT = T.StructType([f for f in PEAKS_LONG.fields if f.name not in ("mz", "intensity", "ion_mobility")] + [T.StructField("peaks", T.ArrayType(PEAK), False)])
REQUIRED_LONG = ("spectrum_id", "scan_number", "ms_level", "retention_time", "polarity", "mz", "intensity")
MODALITIES = {(False, False): "lc-ms", (True, False): "lc-ims-ms", (False, True): "msi", (True, True): "msi-ims"}


def schema_problems(found: T.StructType, wanted: T.StructType, required: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(column, status, message): a missing required column fails, another type warns."""
    out = []
    for name in required:
        if name not in found.names:
            out.append((name, "failed", f"required column {name} is missing"))
        elif found[name].dataType != wanted[name].dataType:
            out.append((name, "warning", f"{name} is {found[name].dataType.simpleString()}, expected {wanted[name].dataType.simpleString()}"))
    return out


def require(found: T.StructType, wanted: T.StructType, required: tuple[str, ...] = REQUIRED_LONG) -> None:
    """Raises SchemaError unless all required columns are there with their types."""
    if wrong := schema_problems(found, wanted, required):
        raise SchemaError("; ".join(m for _, _, m in wrong))
