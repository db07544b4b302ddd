"""Controlled-vocabulary terms and rules of the XML formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accessions of the public PSI-MS and unit vocabularies.
MS_LEVEL = "MS:1000511"
POSITIVE, NEGATIVE = "MS:1000130", "MS:1000129"
SCAN_START_TIME, INJECTION_TIME = "MS:1000016", "MS:1000927"
TOTAL_ION_CURRENT, BASE_PEAK_MZ, BASE_PEAK_INTENSITY = "MS:1000285", "MS:1000504", "MS:1000505"
SELECTED_MZ, CHARGE, PEAK_INTENSITY = "MS:1000744", "MS:1000041", "MS:1000042"
WINDOW_TARGET, WINDOW_LOWER, WINDOW_UPPER = "MS:1000827", "MS:1000828", "MS:1000829"
COLLISION_ENERGY = "MS:1000045"
MZ_ARRAY, INTENSITY_ARRAY, TIME_ARRAY = "MS:1000514", "MS:1000515", "MS:1000595"
MOBILITY_ARRAYS = ("MS:1002476", "MS:1002477", "MS:1003006")
FLOAT64, FLOAT32 = "MS:1000523", "MS:1000521"
ZLIB, NO_COMPRESSION = "MS:1000574", "MS:1000576"
NUMPRESS = ("MS:1002312", "MS:1002313", "MS:1002314")
EXTERNAL_OFFSET, EXTERNAL_LENGTH = "IMS:1000102", "IMS:1000103"
POSITION_X, POSITION_Y, POSITION_Z = "IMS:1000050", "IMS:1000051", "IMS:1000052"
MINUTE, MILLISECOND = "UO:0000031", "UO:0000028"
CHROMATOGRAM_TYPES = {
    "MS:1000235": "TIC", "MS:1000628": "BPC", "MS:1001472": "SIM", "MS:1001473": "SRM", "MS:1000908": "SRM", "MS:1000627": "XIC", "MS:1000812": "Absorption", "MS:1000813": "Emission",
}


def has(params: Column, *accessions: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: p["_accession"].isin(*accessions)), F.lit(False))


def value(params: Column, accession: str) -> Column:
    """The value of the last parameter with that accession, or null."""
    found = F.filter(params, lambda p: p["_accession"] == accession)
    return F.try_element_at(found, F.lit(-1))["_value"]


def number(params: Column, accession: str, kind: str = "double") -> Column:
    return F.trim(value(params, accession)).try_cast(kind)


def seconds(params: Column, accession: str) -> Column:
    """A time in seconds: minutes times 60, milliseconds over 1000, anything else as it is."""
    found = F.try_element_at(F.filter(params, lambda p: p["_accession"] == accession), F.lit(-1))
    x = F.trim(found["_value"]).try_cast("double")
    return F.when(found["_unitAccession"] == MINUTE, x * 60).when(found["_unitAccession"] == MILLISECOND, x / 1000).otherwise(x)


def polarity(params: Column) -> Column:
    return F.when(has(params, POSITIVE), 1).when(has(params, NEGATIVE), -1).otherwise(0).cast("byte")


def scan_number(native_id: Column, index: Column) -> Column:
    """From `scan=<digits>`, else from `S<digits>`, else index + 1."""
    scan = F.regexp_extract(native_id, r"scan=(\d+)", 1)
    letter = F.regexp_extract(native_id, r"^S(\d+)$", 1)
    found = F.when(native_id.contains("scan="), F.when(scan != "", scan)).when(letter != "", letter)
    return F.coalesce(found.try_cast("long"), index.cast("long") + 1)


def chromatogram_type(params: Column) -> Column:
    """The first recognised type, or Unknown."""
    table = F.create_map(*(F.lit(x) for pair in CHROMATOGRAM_TYPES.items() for x in pair))
    known = F.filter(params, lambda p: p["_accession"].isin(*CHROMATOGRAM_TYPES))
    return F.coalesce(table[F.try_element_at(known, F.lit(1))["_accession"]], F.lit("Unknown"))


def positive(x: Column) -> Column:
    """The value, null unless above 0."""
    return F.when(x > 0, x)


def window(target: Column, offset: Column, sign: int) -> Column:
    return F.when(target.isNotNull() & offset.isNotNull(), target + sign * offset)


def precursor_mz(selected: Column, target: Column) -> Column:
    return F.coalesce(selected, target, F.lit(0.0))


def corrected(intensity: Column, factor: Column) -> Column:
    return (intensity.cast("double") * factor).cast("float")
