"""Parquet tables inside a ZIP container, read in place: a Python data source with one partition per row group."""

from __future__ import annotations

import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

_SIGNED = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.int64()}


def _signed(kind: pa.Schema) -> pa.Schema:
    """Unsigned columns as the signed type that holds them; Spark has none."""
    return pa.schema([f.with_type(_SIGNED.get(f.type, f.type)) for f in kind])


class RowGroup(InputPartition):
    def __init__(self, number: int):
        self.number = number


class ZippedParquet(DataSource):
    """Options: path (the container), entry (the table), columns (comma-separated, all if absent)."""

    @classmethod
    def name(cls) -> str:
        return "zipped_parquet"

    def schema(self):
        with zipfile.ZipFile(self.options["path"]) as z, z.open(self.options["entry"]) as f:
            found = _signed(pq.ParquetFile(f).schema_arrow)
        names = [c for c in self.options.get("columns", "").split(",") if c] or found.names
        return from_arrow_schema(pa.schema([found.field(n) for n in names]))

    def reader(self, schema) -> DataSourceReader:
        return ZippedReader(self.options, schema.names)


class ZippedReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.entry, self.names = options["path"], options["entry"], names

    def partitions(self) -> list[RowGroup]:
        with zipfile.ZipFile(self.path) as z, z.open(self.entry) as f:
            return [RowGroup(i) for i in range(pq.ParquetFile(f).num_row_groups)] or [RowGroup(-1)]

    def read(self, partition: RowGroup):
        if partition.number < 0:
            return
        with zipfile.ZipFile(self.path) as z, z.open(self.entry) as f:
            for batch in pq.ParquetFile(f).iter_batches(row_groups=[partition.number], columns=self.names):
                yield batch.select(self.names).cast(_signed(batch.select(self.names).schema))


def read_zipped(spark: SparkSession, path: str, entry: str, columns: list[str] | None = None) -> DataFrame | None:
    """The table of that entry, or None if the container has none."""
    with zipfile.ZipFile(path) as z:
        if entry not in z.namelist():
            return None
    spark.dataSource.register(ZippedParquet)
    return spark.read.format("zipped_parquet").options(path=path, entry=entry, columns=",".join(columns or [])).load()
