"""Ordered operators. Those over a whole run sort spectra, of which there are far fewer than peaks, by id ranges:
a row is compared with the one before it inside its range, and each range's first row with the last of the range before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ids in a range. A range is a window's partition, so no task sorts the whole run.
RANGE = 1 << 16


def top_peaks(peaks: DataFrame, n: int) -> DataFrame:
    """The n most intense peaks of each spectrum; ties go to the smaller m/z, then mobility."""
    rank = F.row_number().over(W.partitionBy("spectrum_id").orderBy(F.col("intensity").desc(), "mz", "ion_mobility"))
    return peaks.withColumn("rank", rank).where(F.col("rank") <= n)


def with_previous(spectra: DataFrame, *columns: str, width: int = RANGE, position: str = "spectrum_id") -> DataFrame:
    """Each row with `prev_<column>` of the row before it in the order of `position` (integers), over the whole run, and `_head`: whether it is the first."""
    part = F.floor(F.col(position) / width)
    rows = spectra.withColumn("_part", part)
    inside = W.partitionBy("_part").orderBy(position)
    for c in columns:
        rows = rows.withColumn(f"prev_{c}", F.lag(c).over(inside))
    rows = rows.withColumn("_first", F.row_number().over(inside) == 1)
    last = rows.groupBy("_part").agg(F.max_by(F.struct(*columns), position).alias("_last"))
    # One row per range: few enough to sort together.
    last = last.select(F.lead("_part").over(W.orderBy("_part")).alias("_part"), "_last").where("_part is not null").withColumn("_first", F.lit(True))
    rows = rows.join(last, ["_part", "_first"], "left").withColumn("_head", F.col("_first") & F.col("_last").isNull())
    for c in columns:
        rows = rows.withColumn(f"prev_{c}", F.when(F.col("_first"), F.col(f"_last.{c}")).otherwise(F.col(f"prev_{c}")))
    return rows.drop("_part", "_first", "_last")


def order_violations(spectra: DataFrame) -> DataFrame:
    """Spectra whose retention time lies before that of the spectrum before them."""
    return with_previous(spectra.select("spectrum_id", "retention_time"), "retention_time").where("prev_retention_time > retention_time").drop("_head")


def contiguity_violations(spectra: DataFrame) -> DataFrame:
    """Spectra whose id is not one more than the id before."""
    return with_previous(spectra.select("spectrum_id"), "spectrum_id").where("prev_spectrum_id + 1 <> spectrum_id").drop("_head")


def prefix_sum(rows: DataFrame, value: str, name: str, width: int = RANGE, position: str = "spectrum_id") -> DataFrame:
    """The sum of `value` over all rows before, in the order of `position` (integers)."""
    rows = rows.withColumn("_part", F.floor(F.col(position) / width))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(position).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn(name, inside).join(before, "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def runs(rows: DataFrame, key: str = "spectrum_id", position: str = "position") -> DataFrame:
    """Contiguous runs of equal keys in the order of `position` (integers): (run, key, length). A key that comes back begins another run."""
    seen = with_previous(rows.select(key, position), key, position=position)
    new = seen.withColumn("_new", (~F.col(key).eqNullSafe(F.col(f"prev_{key}")) | F.col("_head")).cast("int"))
    numbered = prefix_sum(new, "_new", "_earlier", position=position)
    return numbered.withColumn("run", F.col("_earlier") + F.col("_new")).groupBy("run", key).agg(F.count(F.lit(1)).alias("length"))


def workers(spectra: DataFrame, n: int) -> DataFrame:
    """Ids dealt to n workers in contiguous parts, the remainder to the first ones."""
    row = prefix_sum(spectra.withColumn("_one", F.lit(1)), "_one", "_row")
    total = spectra.agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
    base, more = F.floor(F.col("_n") / n), F.col("_n") % n
    large = more * (base + 1)
    at = F.when(F.col("_row") < large, F.floor(F.col("_row") / (base + 1))).otherwise(more + F.floor((F.col("_row") - large) / F.greatest(base, F.lit(1))))
    return row.join(total, "_one").withColumn("worker", at.cast("int")).drop("_one", "_row", "_n")


def shard_numbers(sizes: Column, limit: int) -> Column:
    """For an array of batch sizes the part of each: a batch that does not fit begins a part, unless the part is empty."""
    start = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("parts"))

    def step(acc: Column, n: Column) -> Column:
        turn = (acc["held"] > 0) & (acc["held"] + n > limit)
        part = acc["part"] + turn.cast("int")
        return F.struct(part.alias("part"), (F.when(turn, F.lit(0)).otherwise(acc["held"]) + n).cast("long").alias("held"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    return F.aggregate(sizes, start, step, lambda acc: acc["parts"])
