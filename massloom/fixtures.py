"""Spectra and peaks made from the order tables, for queries and tests. The same SQL runs in Spark and in the oracle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPECTRA_SQL = """
select o_orderkey as spectrum_id, o_orderkey + 1 as scan_number,
  cast(case when o_orderkey % 3 = 0 then 1 else 2 end as smallint) as ms_level,
  cast(o_orderkey * 0.5e0 as float) as retention_time,
  cast(case when o_custkey % 2 = 0 then 1 else -1 end as tinyint) as polarity,
  case when o_orderkey % 3 <> 0 then 400e0 + o_totalprice / 1000e0 end as precursor_mz,
  cast(case when o_orderkey % 3 <> 0 then 1 + o_custkey % 4 end as smallint) as precursor_charge,
  cast(case when o_orderkey % 3 <> 0 then o_totalprice end as float) as precursor_intensity,
  cast(case when o_orderkey % 3 <> 0 then 20 + o_custkey % 16 end as float) as collision_energy,
  cast(o_orderkey % 64 as int) as pixel_x,
  cast((o_orderkey % 4096 - o_orderkey % 64) / 64 as int) as pixel_y
from orders"""
PEAKS_SQL = """
select l_orderkey as spectrum_id, 100e0 + (l_partkey % 2000) * 0.5e0 + l_discount as mz,
  cast(l_extendedprice as float) as intensity, case when l_returnflag <> 'R' then l_quantity end as ion_mobility
from lineitem"""
WITH = f"with sp as ({SPECTRA_SQL}), pk as ({PEAKS_SQL}), pl as (select * from pk join sp using (spectrum_id)) "


@dataclass(frozen=True)
class Run:
    """A run as its two tables; the wide view is a join that broadcasts spectra only when Spark finds them small enough."""

    spectra: DataFrame
    peaks: DataFrame

    @property
    def long(self) -> DataFrame:
        return self.peaks.join(self.spectra, "spectrum_id")


def load(spark: SparkSession, sf_dir: str) -> Run:
    orders, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    spectra = spark.sql(SPECTRA_SQL.replace("from orders", "from {orders}"), orders=orders)
    peaks = spark.sql(PEAKS_SQL.replace("from lineitem", "from {lineitem}"), lineitem=lineitem)
    return Run(spectra, peaks)


def traces(run: Run, per_trace: int = 1000) -> DataFrame:
    """Wide traces (chromatogram_id, time_array, intensity_array) of MS1 spectra, `per_trace` spectra each, for unnesting."""
    points = run.peaks.groupBy("spectrum_id").agg(F.sum("intensity").alias("y")).join(run.spectra.where("ms_level = 1").select("spectrum_id", "retention_time"), "spectrum_id")
    at = F.floor(F.col("spectrum_id") / per_trace).cast("long")
    pairs = points.groupBy(at.alias("chromatogram_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("retention_time").cast("double").alias("t"), F.col("y").cast("float").alias("y")))).alias("p"))
    return pairs.select("chromatogram_id", F.col("p.t").alias("time_array"), F.col("p.y").alias("intensity_array"))
