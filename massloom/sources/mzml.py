"""mzML and imzML through Spark's XML source; arrays are decoded in Arrow batches after the rows are split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom import schema
from massloom.functions import cv
from massloom.functions.decode import array_of

_CV = "array<struct<_accession:string,_name:string,_value:string,_unitAccession:string>>"
_ARRAYS = f"struct<binaryDataArray:array<struct<_encodedLength:string,cvParam:{_CV},binary:string>>>"
SPECTRUM = (
    f"_index long, _id string, _defaultArrayLength long, cvParam {_CV},"
    f"scanList struct<scan:array<struct<cvParam:{_CV}>>>,"
    f"precursorList struct<precursor:array<struct<isolationWindow:struct<cvParam:{_CV}>,selectedIonList:struct<selectedIon:array<struct<cvParam:{_CV}>>>,activation:struct<cvParam:{_CV}>>>>,"
    f"binaryDataArrayList {_ARRAYS}"
)
CHROMATOGRAM = f"_index long, _id string, _defaultArrayLength long, cvParam {_CV}, binaryDataArrayList {_ARRAYS}"


def read_spectra_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per spectrum element, arrays still in base64. A file is split by its elements, so one large file is many tasks."""
    return spark.read.format("xml").option("rowTag", "spectrum").option("attributePrefix", "_").schema(SPECTRUM).load(path)


def _scalars(xml: DataFrame) -> DataFrame:
    p, scan = F.col("cvParam"), F.try_element_at("scanList.scan", F.lit(1))["cvParam"]
    first = F.try_element_at("precursorList.precursor", F.lit(1))
    box, ion, act = first["isolationWindow"]["cvParam"], F.try_element_at(first["selectedIonList"]["selectedIon"], F.lit(-1))["cvParam"], first["activation"]["cvParam"]
    target = cv.number(box, cv.WINDOW_TARGET)
    xy = cv.number(scan, cv.POSITION_X, "int"), cv.number(scan, cv.POSITION_Y, "int")
    placed = lambda c: F.when(xy[0].isNotNull() & xy[1].isNotNull(), c)
    return xml.select(
        F.col("_index").alias("spectrum_id"), cv.scan_number(F.col("_id"), F.col("_index")).alias("scan_number"), F.coalesce(cv.number(p, cv.MS_LEVEL, "short"), F.lit(0).cast("short")).alias("ms_level"),
        F.coalesce(cv.seconds(scan, cv.SCAN_START_TIME), F.lit(0.0)).cast("float").alias("retention_time"), cv.polarity(p).alias("polarity"),
        F.when(first.isNotNull(), cv.precursor_mz(cv.number(ion, cv.SELECTED_MZ), target)).alias("precursor_mz"), cv.number(ion, cv.CHARGE, "short").alias("precursor_charge"),
        cv.number(ion, cv.PEAK_INTENSITY, "float").alias("precursor_intensity"), cv.number(box, cv.WINDOW_LOWER, "float").alias("_lower"), cv.number(box, cv.WINDOW_UPPER, "float").alias("_upper"),
        cv.number(act, cv.COLLISION_ENERGY, "float").alias("collision_energy"), F.lit(None).cast("double").alias("total_ion_current"), F.lit(None).cast("double").alias("base_peak_mz"), F.lit(None).cast("float").alias("base_peak_intensity"),
        cv.number(scan, cv.INJECTION_TIME, "float").alias("injection_time"), placed(xy[0]).alias("pixel_x"), placed(xy[1]).alias("pixel_y"), placed(cv.number(scan, cv.POSITION_Z, "int")).alias("pixel_z"),
        cv.number(p, cv.TOTAL_ION_CURRENT).alias("declared_tic"), cv.number(p, cv.BASE_PEAK_INTENSITY, "float").alias("declared_base_peak"),
        F.col("binaryDataArrayList.binaryDataArray").alias("_arrays"), F.col("_defaultArrayLength").alias("_n"),
    ).withColumns({
        "isolation_window_lower": F.when(F.col("_lower").isNotNull() & F.col("_upper").isNotNull(), F.col("_lower")),
        "isolation_window_upper": F.when(F.col("_lower").isNotNull() & F.col("_upper").isNotNull(), F.col("_upper")),
    }).drop("_lower", "_upper")


def _contract(rows: DataFrame) -> DataFrame:
    """Rows with mz, intensity and mobility arrays as contract rows."""
    mz, y = F.coalesce("_mz", F.array().cast("array<double>")), F.coalesce("_y", F.array().cast("array<double>"))
    same = F.when(F.size(mz) != F.size(y), F.raise_error(F.concat(F.lit("m/z and intensity differ in length in spectrum "), F.col("spectrum_id").cast("string"))).cast("array<double>")).otherwise(mz)
    im = F.when(F.size("_im") == F.size(mz), F.col("_im")).otherwise(F.transform(mz, lambda _: F.lit(None).cast("double")))
    peaks = F.transform(F.arrays_zip(same.alias("a"), y.alias("b"), im.alias("c")), lambda p: F.struct(p["a"].alias("mz"), p["b"].cast("float").alias("intensity"), p["c"].alias("ion_mobility")))
    return rows.withColumn("peaks", peaks).select(*schema.CONTRACT.names, *(c for c in ("declared_tic", "declared_base_peak") if c in rows.columns))


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """Contract rows of mzML files, with the declared total ion current and base peak beside them."""
    rows = _scalars(read_spectra_xml(spark, path))
    return _contract(rows.withColumns({"_mz": array_of(F.col("_arrays"), F.col("_n"), cv.MZ_ARRAY), "_y": array_of(F.col("_arrays"), F.col("_n"), cv.INTENSITY_ARRAY), "_im": array_of(F.col("_arrays"), F.lit(None), *cv.MOBILITY_ARRAYS)}))


def read_imzml(spark: SparkSession, xml_path: str, data_path: str) -> DataFrame:
    """Contract rows of an imzML file and its data file, of which each task reads the ranges of its own rows."""
    one = lambda *a: F.try_element_at(F.filter("_arrays", lambda x: cv.has(x["cvParam"], *a)), F.lit(1))["cvParam"]
    place = lambda p: F.struct(cv.number(p, cv.EXTERNAL_OFFSET, "long").alias("at"), cv.number(p, cv.EXTERNAL_LENGTH, "long").alias("n"), cv.has(p, cv.FLOAT64).alias("wide"))
    rows = _scalars(read_spectra_xml(spark, xml_path)).withColumns({"_a": place(one(cv.MZ_ARRAY)), "_b": place(one(cv.INTENSITY_ARRAY))})

    @F.pandas_udf("array<double>")
    def fetch(places: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        with open(data_path, "rb") as file:
            for part in places:
                out = []
                for at, n, wide in part[["at", "n", "wide"]].itertuples(index=False):
                    file.seek(int(at))
                    out.append(np.frombuffer(file.read(int(n) * (8 if wide else 4)), "<f8" if wide else "<f4").astype("f8"))
                yield pd.Series(out)

    return _contract(rows.withColumns({"_mz": fetch("_a"), "_y": fetch("_b"), "_im": F.lit(None).cast("array<double>")}))


def read_chromatograms(spark: SparkSession, path: str) -> DataFrame:
    """Wide traces of mzML files."""
    xml = spark.read.format("xml").option("rowTag", "chromatogram").option("attributePrefix", "_").schema(CHROMATOGRAM).load(path)
    arrays, n = F.col("binaryDataArrayList.binaryDataArray"), F.col("_defaultArrayLength")
    y = F.transform(array_of(arrays, n, cv.INTENSITY_ARRAY), lambda v: v.cast("float"))
    return xml.select(F.col("_id").alias("chromatogram_id"), cv.chromatogram_type(F.col("cvParam")).alias("chromatogram_type"), array_of(arrays, n, cv.TIME_ARRAY).alias("time_array"), y.alias("intensity_array"))
