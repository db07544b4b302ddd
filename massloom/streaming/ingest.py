"""Live ingest with Structured Streaming: contract checks per row, id contiguity per source with state, windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, kind: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they come, a bounded number at a time."""
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def contiguity(stream: DataFrame, source: str = "source", spectrum_id: str = "spectrum_id") -> DataFrame:
    """(source, spectrum_id, expected): ids of a source that do not follow the id before, batches included. State is one number per source."""

    def check(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        ids = sorted(int(i) for part in parts for i in part[spectrum_id])
        bad = []
        for i in ids:
            if last is not None and i != last + 1:
                bad.append((key[0], i, last + 1))
            last = i
        state.update((last,))
        yield pd.DataFrame(bad, columns=["source", "spectrum_id", "expected"])

    return stream.groupBy(source).applyInPandasWithState(check, "source string, spectrum_id long, expected long", "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and kind; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
