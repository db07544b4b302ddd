"""Sample tables (SDRF, tab-separated): headers are matched by ordered rules, the first that fits wins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.errors import SchemaError

# Field of a header by what it contains, in this order; a header holding the third text is skipped.
RULES = (
    ("source_name", ("source name",), None), ("organism", ("organism",), "part"), ("organism_part", ("organism part", "tissue"), None), ("cell_type", ("cell type",), None),
    ("disease", ("disease",), None), ("instrument", ("instrument",), None), ("cleavage_agent", ("cleavage agent", "enzyme"), None), ("modification", ("modification",), None),
    ("label", ("label",), None), ("fraction", ("fraction",), None), ("technical_replicate", ("technical replicate",), None), ("biological_replicate", ("biological replicate",), None),
)
#: Fields that are numbers.
NUMBERS = ("technical_replicate", "biological_replicate")


def field_of(header: str) -> str | None:
    """A field name, `factor:x`, `comment:x`, data_file, or `other:x`; None for a factor or comment without brackets, which is left out."""
    plain = header.strip().lower()
    for field, texts, lacks in RULES:
        if any(x in plain for x in texts) and not (lacks and lacks in plain):
            return field
    for kind, begin in (("factor", "factor value"), ("comment", "comment")):
        if plain.startswith(begin):
            inner = re.search(r"\[(.*?)\]", plain)
            return f"{kind}:{inner[1]}" if inner else None
    return "data_file" if "file" in plain else f"other:{plain}"


def read_sdrf(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample with a source name; modifications as a list, factors, comments and other columns as maps. Values are trimmed,
    empty ones null; of columns with the same field the last that has a value counts. Raises SchemaError without a source name column."""
    heads = [h or "" for h in spark.read.csv(path, sep="\t", header=False).limit(1).collect()[0]]
    fields = [field_of(h) for h in heads]
    if "source_name" not in fields:
        raise SchemaError("required column source name is missing")
    body = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"c{i} string" for i in range(len(heads))))
    clean = [F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in body.columns]
    pick = lambda name: F.coalesce(*(c for c, f in reversed(list(zip(clean, fields, strict=True))) if f == name), F.lit(None).cast("string"))
    names = [name for name, _, _ in RULES if name != "modification"] + ["data_file"]
    out = [(pick(name).try_cast("int") if name in NUMBERS else pick(name)).alias(name) for name in names]
    listed = [c for c, f in zip(clean, fields, strict=True) if f == "modification"]
    out.append((F.filter(F.array(*listed), lambda x: x.isNotNull()) if listed else F.array().cast("array<string>")).alias("modifications"))
    for kind in ("factor", "comment", "other"):
        keys = dict.fromkeys(f for f in fields if f and f.startswith(kind + ":"))
        pairs = [F.struct(F.lit(k.partition(":")[2]).alias("k"), pick(k).alias("v")) for k in keys]
        out.append((F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")).alias(f"{kind}s"))
    return body.select(*out).where("source_name is not null")
