"""Small cases of the operators, the contract, decoding and sources."""

import base64
import struct
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from massloom import schema, sinks
from massloom.errors import ContractError, DecodeError, ReaderError, SchemaError, WriterError
from massloom.functions import cv
from massloom.functions.decode import decode
from massloom.operators import aggregates as A
from massloom.operators import contract as C
from massloom.operators import filters as P
from massloom.operators import joins as J
from massloom.operators import traces as T
from massloom.operators import windows as W
from massloom.sources import demo, frames, mzml, sdrf
from massloom.sources.dataset import open_dataset
from massloom.validate import validate


def contract_rows(spark, rows):
    """Contract rows from dicts; peaks as (mz, intensity, mobility)."""
    empty = dict.fromkeys(schema.CONTRACT.names)
    base = {"scan_number": 1, "ms_level": 1, "retention_time": 0.0, "polarity": 1, "peaks": []}
    return spark.createDataFrame([tuple((empty | base | r)[c] for c in schema.CONTRACT.names) for r in rows], schema.CONTRACT)


@pytest.mark.parametrize(
    ("mz", "intensity", "last", "expected"),
    [([1.0, 2.0, 3.0], [5.0, 9.0, 9.0], False, (23.0, 2.0, 9.0)), ([1.0, 2.0, 3.0], [5.0, 9.0, 9.0], True, (23.0, 3.0, 9.0)), ([1.0, 2.0], [0.0, 0.0], False, (0.0, 0.0, 0.0)), ([], [], False, None)],
)
def test_peak_statistics(spark, mz, intensity, last, expected):
    df = spark.createDataFrame([([(a, b, None) for a, b in zip(mz, intensity)],)], "peaks array<struct<mz:double,intensity:float,ion_mobility:double>>")
    found = df.select(A.peak_statistics(F.col("peaks"), last).alias("s")).first()["s"]
    assert (found and tuple(found)) == expected


def test_nan_is_never_the_base_peak(spark):
    peaks = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, float("nan"))], "spectrum_id long, mz double, intensity float")
    row = A.compute_statistics(peaks).first()
    assert row["base_peak_intensity"] == 1.0 and row["total_ion_current"] != row["total_ion_current"]


def test_runs_and_contiguity(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 1)], "position long, spectrum_id long")
    assert [tuple(r) for r in W.runs(rows).orderBy("run").collect()] == [(1, 1, 2), (2, 2, 1), (3, 1, 1)]
    ids = spark.createDataFrame([(5,), (6,), (8,)], "spectrum_id long")
    assert [tuple(r) for r in W.contiguity_violations(ids).collect()] == [(8, 6)]
    with pytest.raises(ContractError):
        C.require_contiguous(ids)


def test_previous_crosses_ranges(spark):
    ids = spark.range(0, 50, 3).select(F.col("id").alias("spectrum_id"), F.lit(1).alias("n"))
    found = {r["spectrum_id"]: r["prev_spectrum_id"] for r in W.with_previous(ids, "spectrum_id", width=7).collect()}
    assert found == {i: (i - 3 if i else None) for i in range(0, 50, 3)}
    assert {r["spectrum_id"]: r["at"] for r in W.prefix_sum(ids, "n", "at", width=7).collect()} == {i: i // 3 for i in range(0, 50, 3)}


def test_shards_and_workers(spark):
    df = spark.createDataFrame([([30, 30, 50, 120, 10, 60],)], "n array<long>")
    assert df.select(W.shard_numbers(F.col("n"), 100)).first()[0] == [0, 0, 1, 2, 3, 3]
    sizes = W.workers(spark.range(8).withColumnRenamed("id", "spectrum_id"), 3).groupBy("worker").count().orderBy("worker")
    assert [r["count"] for r in sizes.collect()] == [3, 3, 2]


def test_cv_rules(spark):
    ids = spark.createDataFrame([("controllerType=0 scan=12345", 4), ("S77", 4), ("other", 4), ("scan=", 4)], "id string, i long")
    assert [r[0] for r in ids.select(cv.scan_number(F.col("id"), F.col("i"))).collect()] == [12345, 77, 5, 5]
    kind = "p array<struct<_accession:string,_name:string,_value:string,_unitAccession:string>>"
    times = spark.createDataFrame([([(cv.SCAN_START_TIME, "", v, u)],) for v, u in (("1.5", cv.MINUTE), ("1500", cv.MILLISECOND), ("1.5", None))], kind)
    assert [r[0] for r in times.select(cv.seconds(F.col("p"), cv.SCAN_START_TIME)).collect()] == [90.0, 1.5, 1.5]


def test_decode():
    text = "AAAAAAAA8D8AAAAAAAAAQAAAAAAAAAhAAAAAAAAAEEA="
    assert decode(text, expected=4).tolist() == [1, 2, 3, 4]
    assert decode(base64.b64encode(zlib.compress(struct.pack("<2f", 1, 2))).decode(), wide=False, packed=True).tolist() == [1, 2]
    assert decode("").tolist() == [] and decode(text[:10] + "\n " + text[10:]).tolist() == [1, 2, 3, 4]
    for wrong in (dict(expected=3), dict(numpress=True), dict(packed=True)):
        with pytest.raises(DecodeError):
            decode(text, **wrong)


@given(st.lists(st.floats(allow_nan=False), max_size=40), st.booleans())
@settings(max_examples=50, deadline=None)
def test_decode_round_trip(values, packed):
    raw = struct.pack(f"<{len(values)}d", *values)
    assert decode(base64.b64encode(zlib.compress(raw) if packed else raw).decode(), packed=packed, expected=len(values)).tolist() == values


def test_contract(spark):
    good = contract_rows(spark, [{"spectrum_id": 0, "peaks": [(2.0, 5.0, None), (3.0, 9.0, None)]}, {"spectrum_id": 1, "total_ion_current": 7.0, "peaks": [(1.0, 1.0, None)]}])
    rows = {r["spectrum_id"]: r for r in C.ingest(good).collect()}
    assert (rows[0]["total_ion_current"], rows[0]["base_peak_mz"]) == (14.0, 3.0)
    assert (rows[1]["total_ion_current"], rows[1]["base_peak_mz"]) == (7.0, None)
    for bad in ({"ms_level": 0}, {"polarity": 2}, {"retention_time": float("nan")}):
        df = contract_rows(spark, [{"spectrum_id": 0} | bad])
        assert C.with_violations(df).first()["violations"]
        with pytest.raises(Exception, match="spectrum 0"):
            C.ingest(df).collect()
    for bad in ({"precursor_charge": 200}, {"pixel_x": -1}, {"ms_level": 0}):
        with pytest.raises(Exception, match="does not fit"):
            C.narrowed(contract_rows(spark, [{"spectrum_id": 0} | bad])).collect()
    mixed = spark.createDataFrame([(1, 1.0), (1, None), (2, 1.0)], "spectrum_id long, ion_mobility double")
    assert [r[0] for r in C.mixed_mobility(mixed).collect()] == [1]
    with pytest.raises(SchemaError):
        schema.require(spark.range(1).schema, schema.PEAKS_LONG)


def test_traces(spark):
    rows = contract_rows(spark, [{"spectrum_id": 0, "retention_time": 10.0, "total_ion_current": 1e5, "base_peak_intensity": 5.0}, {"spectrum_id": 1, "ms_level": 2}, {"spectrum_id": 2, "retention_time": 20.0, "total_ion_current": 2e5, "base_peak_intensity": 6.0}])
    tic = T.tic_and_bpc(rows).where("chromatogram_id = 'TIC'").first()
    assert (tic["time_array"], tic["intensity_array"]) == ([10.0, 20.0], [1e5, 2e5])
    wrong = spark.createDataFrame([("a", "TIC", [1.0, 2.0, 3.0], [1.0, 2.0])], schema.CHROMATOGRAMS)
    with pytest.raises(Exception, match="differ in length"):
        T.checked(wrong).collect()


@given(st.lists(st.lists(st.tuples(st.floats(100, 3000), st.floats(0, 1e6, width=32)), min_size=1, max_size=12), min_size=1, max_size=5))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_explode_and_collect(spark, spectra):
    rows = [(i, a, b, None) for i, s in enumerate(spectra) for a, b in s]
    peaks = spark.createDataFrame(rows, schema.PEAKS)
    assert sorted(map(tuple, T.explode_peaks(T.collect_peaks(peaks)).collect()), key=repr) == sorted(map(tuple, peaks.collect()), key=repr)


def test_joins(spark):
    frames_ = spark.createDataFrame([(1, 1.0), (2, 2.0)], "frame_id long, retention_time double")
    precursors = spark.createDataFrame([(1, 9, 500.0), (1, 8, 400.0)], "frame_id long, precursor_id long, mz double")
    assert {r["frame_id"]: r["mz"] for r in J.first_precursor(frames_, precursors).collect()} == {1: 400.0, 2: None}
    calibration = spark.createDataFrame([(2, 20.0)], "frame_id long, retention_time double")
    assert {r["frame_id"]: r["retention_time"] for r in J.calibrated(frames_, calibration).collect()} == {1: 1.0, 2: 20.0}
    scans = spark.createDataFrame([(1, [0, 2, 2, 3], [0.9, 0.8, 0.7])], "frame_id long, scan_offsets array<int>, scan_mobility array<double>")
    assert [(r["position"], r["mobility"]) for r in J.scan_mobility(scans).orderBy("position").collect()] == [(0, 0.9), (1, 0.9), (2, 0.7)]
    assert P.by_ids(spark.range(5000).withColumnRenamed("id", "spectrum_id"), range(0, 4000, 2)).count() == 2000


def test_frames_and_scans(spark):
    kind = "frame_id long, ms_level int, retention_time double, scan_offsets array<int>, scan_mobility array<double>, tof array<int>, intensities array<int>, correction double, precursor_mz double, precursor_charge int, precursor_intensity double, isolation_mz double, isolation_width double, collision_energy double"
    raw = spark.createDataFrame([(0, 1, 1.0, [0, 2], [0.9], [0, 1], [100, 200], 2.0, None, None, None, None, None, None)], kind)
    row = frames.from_frames(raw, 1.0, 10.0).first()
    assert [(p["mz"], p["intensity"], p["ion_mobility"]) for p in row["peaks"]] == [(100.0, 200.0, 0.9), (121.0, 400.0, 0.9)] and row["base_peak_mz"] == 121.0
    scans = spark.createDataFrame([(0, 1, 1, 1.5, 1, [1.0], [2.0], 0)], "spectrum_id long, scan_number long, ms_level int, retention_time double, polarity int, mz array<double>, intensity array<double>, precursor_charge int")
    row = frames.from_scans(scans).first()
    assert (row["retention_time"], row["precursor_charge"]) == (90.0, None)


MZML = """<?xml version="1.0"?><mzML><run><spectrumList count="2">{spectra}</spectrumList><chromatogramList><chromatogram index="0" id="TIC" defaultArrayLength="2"><cvParam accession="MS:1000235" name="tic" value=""/><binaryDataArrayList>{t}{y}</binaryDataArrayList></chromatogram></chromatogramList></run></mzML>"""


def _array(values, role, external=None):
    text = base64.b64encode(struct.pack(f"<{len(values)}d", *values)).decode() if external is None else ""
    more = "" if external is None else f'<cvParam accession="{cv.EXTERNAL_OFFSET}" value="{external}"/><cvParam accession="{cv.EXTERNAL_LENGTH}" value="{len(values)}"/>'
    return f'<binaryDataArray encodedLength="0"><cvParam accession="{cv.FLOAT64}" value=""/><cvParam accession="{role}" value=""/>{more}<binary>{text}</binary></binaryDataArray>'


def _spectrum(i, level, mz, y, at=None):
    arrays = _array(mz, cv.MZ_ARRAY, at and at[0]) + _array(y, cv.INTENSITY_ARRAY, at and at[1])
    precursor = '<precursorList><precursor><isolationWindow><cvParam accession="MS:1000827" value="500"/><cvParam accession="MS:1000828" value="0.7"/><cvParam accession="MS:1000829" value="0.7"/></isolationWindow><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="500.25"/><cvParam accession="MS:1000041" value="2"/></selectedIon></selectedIonList><activation><cvParam accession="MS:1000045" value="30"/></activation></precursor></precursorList>' if level == 2 else ""
    return f'<spectrum index="{i}" id="scan={i + 10}" defaultArrayLength="{len(mz)}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000130" value=""/><scanList><scan><cvParam accession="MS:1000016" value="1.5" unitAccession="UO:0000031"/></scan></scanList>{precursor}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'


def test_mzml_to_dataset_and_back(spark, tmp_path):
    text = MZML.format(spectra=_spectrum(0, 1, [100.0, 200.0], [5.0, 9.0]) + _spectrum(1, 2, [150.0], [3.0]), t=_array([1.0, 2.0], cv.TIME_ARRAY), y=_array([7.0, 8.0], cv.INTENSITY_ARRAY))
    (tmp_path / "a.mzML").write_text(text)
    rows = mzml.read_mzml(spark, str(tmp_path / "a.mzML"))
    two = {r["spectrum_id"]: r for r in rows.collect()}
    assert (two[0]["scan_number"], two[0]["retention_time"], two[0]["polarity"]) == (10, 90.0, 1)
    assert (two[1]["precursor_mz"], two[1]["precursor_charge"], two[1]["collision_energy"]) == (500.25, 2, 30.0)
    assert [(p["mz"], p["intensity"]) for p in two[0]["peaks"]] == [(100.0, 5.0), (200.0, 9.0)]
    trace = mzml.read_chromatograms(spark, str(tmp_path / "a.mzML")).first()
    assert tuple(trace) == ("TIC", "TIC", [1.0, 2.0], [7.0, 8.0])

    target = str(tmp_path / "run")
    manifest = sinks.write_dataset(rows.drop("declared_tic", "declared_base_peak"), target)
    assert (manifest["spectrum_count"], manifest["peak_count"], manifest["modality"], manifest["has_precursor_info"]) == (2, 3, "lc-ms", True)
    with pytest.raises(WriterError):
        sinks.write_dataset(rows.drop("declared_tic", "declared_base_peak"), target)
    data = open_dataset(spark, target)
    assert (data.peaks.count(), data.total_peaks(), data.long.count(), data.chromatograms.count(), data.mobilograms.count()) == (3, 3, 3, 2, 0)
    assert [r["peak_offset"] for r in data.spectra.orderBy("spectrum_id").collect()] == [0, 2]
    assert validate(spark, target).passed

    sinks.pack_container(target, str(tmp_path / "run.zip"))
    packed = open_dataset(spark, str(tmp_path / "run.zip"))
    assert sorted(map(tuple, packed.peaks.collect())) == sorted(map(tuple, data.peaks.collect()))
    assert packed.total_peaks() == 3 and validate(spark, str(tmp_path / "run.zip")).passed
    with pytest.raises(ReaderError):
        open_dataset(spark, str(tmp_path / "none"))
    sinks.write_long(rows.drop("declared_tic", "declared_base_peak"), str(tmp_path / "wide"))
    wide = open_dataset(spark, str(tmp_path / "wide"))
    assert wide.long.count() == 3 and wide.spectra.count() == 2
    assert len(sinks.write_shards(data.peaks, str(tmp_path / "shards"), limit=2, batch=1)) == 2
    sinks.export_csv(data.peaks, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3


def test_imzml(spark, tmp_path):
    (tmp_path / "a.ibd").write_bytes(struct.pack("<2d2d", 100, 200, 5, 9))
    (tmp_path / "a.imzML").write_text(MZML.format(spectra=_spectrum(0, 1, [0, 0], [0, 0], (0, 16)), t="", y=""))
    row = mzml.read_imzml(spark, str(tmp_path / "a.imzML"), str(tmp_path / "a.ibd")).first()
    assert [(p["mz"], p["intensity"]) for p in row["peaks"]] == [(100.0, 5.0), (200.0, 9.0)]


def test_validator_finds_faults(spark, tmp_path):
    bad = spark.createDataFrame([(0, -1.0, -1.0, None)], schema.PEAKS)
    spectra = spark.createDataFrame([(0, 0, 5.0, 1), (1, 1, 4.0, 1)], "spectrum_id long, ms_level short, retention_time float, polarity byte")
    bad.write.parquet(str(tmp_path / "peaks" / "peaks.parquet"))
    spectra.write.parquet(str(tmp_path / "spectra" / "spectra.parquet"))
    found = {(s, n): status for s, n, status, _ in validate(spark, str(tmp_path)).checks}
    assert [found["data", x] for x in ("mz", "intensity", "ms_level", "retention_time order")] == ["failed", "failed", "failed", "warning"]
    assert not validate(spark, str(tmp_path / "none")).passed


def test_sdrf(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("source name\tcharacteristics[organism]\tcharacteristics[organism part]\tcomment[instrument]\tfactor value[dose]\tcomment[modification parameters]\n a \tman\tliver\tX\t5\tOx\n\tman\t\t\t\t\n")
    rows = sdrf.read_sdrf(spark, str(tmp_path / "s.tsv")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["source_name"], r["organism"], r["organism_part"], r["instrument"], r["factors"], r["modifications"]) == ("a", "man", "liver", "X", {"dose": "5"}, ["Ox"])


def test_demo(spark):
    rows = demo.demo_run(spark, cycles=2)
    assert rows.count() == 42 and C.with_violations(rows).where("size(violations) > 0").count() == 0
    assert A.modality(rows, T.explode_peaks(rows)).first()["modality"] == "lc-ms"


def test_streaming(spark, tmp_path):
    from massloom.streaming import ingest

    rows = spark.createDataFrame([("a", 5), ("a", 6), ("a", 8), ("b", 1)], "source string, spectrum_id long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.contiguity(ingest.read_stream(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.sql("select * from gaps").collect()] == [("a", 8, 7)]
