"""Command line: info, validate, demo, convert. Settings: command line before TOML file before preset."""

from __future__ import annotations

import argparse
import sys
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

from massloom import sinks
from massloom.operators import aggregates
from massloom.sources import demo, mzml
from massloom.sources.dataset import open_dataset
from massloom.validate import validate


def settings(given: dict, file: str | None, preset: str = "default") -> dict:
    """Values given win over those of the file, and these over the preset's."""
    told = tomllib.loads(Path(file).read_text()) if file else {}
    return {"preset": preset, "peaks_per_file": sinks.PEAKS_PER_FILE} | told | {k: v for k, v in given.items() if v is not None}


def convert(spark: SparkSession, source: str, target: str, data: str | None = None, **how) -> dict:
    """An mzML or imzML file as a dataset."""
    rows = mzml.read_imzml(spark, source, data) if data else mzml.read_mzml(spark, source)
    return sinks.write_dataset(rows.drop("declared_tic", "declared_base_peak"), target, **how)


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="massloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("info", "validate"):
        commands.add_parser(name).add_argument("path")
    made = commands.add_parser("demo")
    made.add_argument("path")
    made.add_argument("--cycles", type=int, default=100)
    converted = commands.add_parser("convert")
    converted.add_argument("source")
    converted.add_argument("path")
    converted.add_argument("--data", help="binary file of an imzML file")
    for p in (made, converted):
        p.add_argument("--config")
        p.add_argument("--preset", choices=sinks.PRESETS)
        p.add_argument("--peaks-per-file", type=int)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("massloom").getOrCreate()
    if a.command == "validate":
        report = validate(spark, a.path)
        print(report.text())
        return int(not report.passed)
    if a.command == "info":
        data = open_dataset(spark, a.path)
        found = data.metadata()
        print(f"{a.path}: {found['rows']} peaks in {found['row_groups']} row groups")
        for k, v in found["pairs"].items():
            print(f"  {k}: {v[:100]}")
        for column, packed, plain in data.column_sizes():
            print(f"  {column}: {packed} of {plain} bytes")
        print(aggregates.file_summary(data.spectra, data.peaks).first().asDict())
        return 0
    how = settings({"preset": a.preset, "peaks_per_file": a.peaks_per_file}, a.config)
    if a.command == "demo":
        print(sinks.write_dataset(demo.demo_run(spark, a.cycles), a.path, **how))
    else:
        print(convert(spark, a.source, a.path, a.data, **how))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
