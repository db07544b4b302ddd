"""A synthetic LC-MS run of any size, made in parallel from hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom import schema


def demo_run(spark: SparkSession, cycles: int = 100, ms2_per_cycle: int = 20, seconds: float = 3.0, seed: int = 1) -> DataFrame:
    """Contract rows: each cycle one MS1 spectrum of 200 to 500 peaks and MS2 spectra of 50 to 150, intensities on a slow wave."""
    per = ms2_per_cycle + 1
    noise = lambda *c: (F.xxhash64(F.lit(seed), *c).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52)))
    base = spark.range(cycles * per).select(F.col("id").alias("spectrum_id"), F.floor(F.col("id") / per).alias("cycle"), (F.col("id") % per).alias("at"))
    first = F.col("at") == 0
    n = F.when(first, 200 + noise("spectrum_id") * 300).otherwise(50 + noise("spectrum_id") * 100).cast("int")
    low, high = F.when(first, 350.0).otherwise(100.0), F.when(first, 1650.0).otherwise(1500.0)
    wave = 1 + F.sin(F.col("cycle") / 50.0) / 2
    peak = lambda i: F.struct((low + (high - low) * (i + noise("spectrum_id", i)) / n).alias("mz"), (wave * (100 + noise("spectrum_id", i, F.lit("y")) * 1e6)).cast("float").alias("intensity"), F.lit(None).cast("double").alias("ion_mobility"))
    kinds = {f.name: f.dataType for f in schema.CONTRACT.fields}
    chosen = {
        "spectrum_id": F.col("spectrum_id"), "scan_number": F.col("spectrum_id") + 1, "ms_level": F.when(first, 1).otherwise(2), "retention_time": F.col("cycle") * seconds + F.col("at") * (seconds / per), "polarity": F.lit(1),
        "precursor_mz": F.when(~first, 400 + noise("cycle", "at") * 1200), "precursor_charge": F.when(~first, 2 + F.col("at") % 2), "collision_energy": F.when(~first, F.lit(28.0)), "peaks": F.transform(F.sequence(F.lit(0), n - 1), peak),
    }
    return base.select(*(chosen.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
