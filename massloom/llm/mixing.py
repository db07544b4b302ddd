"""Mixing sources to target weights by pivotal dependent rounding. Native: DataFrame and SQL functions only.

Every document of a source asks for the same number of copies, target / source size. Its whole part is given; the
fractional part is rounded so that the words taken stay what they were: two documents with fractional copies trade words
until one of them has none or all of its copy, in a random direction whose odds keep each one's expectation. Groups of
about GROUP documents run this one after another and each passes on one residual; groups of GROUP residuals meet in the
next level of the tree, until a source has one document left, which is rounded to the nearer end. A source
misses its target by at most half of that document, and no task holds more than a group, however large the source.

Defined cases: a null or empty text has size 0 and takes nothing; null sources are one source, the last; a null doc_id is
a value like any other; repeated rows are counted and rounded one by one; a table without words has targets of 0;
an empty table gives no rows; other columns are ignored by `mix` and kept by `mixed_documents`. Choices are hashes of
doc_id and the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from massloom.llm.common import Scratch

GROUP = 48
WORD = r"[^\x20\x09-\x0D]+"
_UNIT = "struct<h:bigint,doc_id:bigint,idx:int,size:bigint,q:double>"
_PICK = "struct<doc_id:bigint,idx:int,size:bigint,pick:int>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text that equals only for equal sources, null included, and sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, source_size, n, target) of the sources of (key, size, n): the share of all words by weight, at most `most` times
    the source; what is over goes to the others by weight. One task sorts the sources; there is a row for each, not for each document.

    Sorted by cap / weight, the capped sources come first, so one running sum finds the level that the rest get per weight.
    """
    total = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    ranked = total.withColumn("r", F.row_number().over(W.orderBy("key")))
    cap = F.col("source_size") * F.lit(float(most))
    weighed = ranked.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("r") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", cap)
    order = W.orderBy(F.col("cap") / F.col("w"), "key")
    run = weighed.withColumns({
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)),
        "all": F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "at": F.row_number().over(order),
    })
    level = run.withColumn("level", (F.col("all") * F.lit(float(share)) - F.col("before")) / F.col("left"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))
    found = level.withColumn("first", F.min(fits).over(W.orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return found.select("key", "source_size", "n", F.least("cap", F.coalesce(F.col("first.level") * F.col("w"), F.col("cap"))).alias("target"))


_PAIR = """
CASE WHEN acc.carry IS NULL THEN named_struct('carry', u, 'out', acc.out) ELSE
  transform(array(
    CASE WHEN (xxhash64({seed}, acc.carry.h, acc.carry.idx, u.h, u.idx) & 9007199254740991) / 9007199254740992e0
           * (least(acc.carry.size - acc.carry.q, u.q) + least(acc.carry.q, u.size - u.q)) < least(acc.carry.q, u.size - u.q)
      THEN CASE WHEN acc.carry.size - acc.carry.q <= u.q THEN 1 ELSE 2 END
      ELSE CASE WHEN acc.carry.q <= u.size - u.q THEN 3 ELSE 4 END END),
    c -> named_struct(
      'carry', CASE WHEN c IN (1, 3)
        THEN named_struct('h', u.h, 'doc_id', u.doc_id, 'idx', u.idx, 'size', u.size, 'q', CASE WHEN c = 1 THEN u.q - (acc.carry.size - acc.carry.q) ELSE u.q + acc.carry.q END)
        ELSE named_struct('h', acc.carry.h, 'doc_id', acc.carry.doc_id, 'idx', acc.carry.idx, 'size', acc.carry.size, 'q', CASE WHEN c = 2 THEN acc.carry.q + u.q ELSE acc.carry.q - (u.size - u.q) END) END,
      'out', concat(acc.out, array(CASE WHEN c IN (1, 3)
        THEN named_struct('doc_id', acc.carry.doc_id, 'idx', acc.carry.idx, 'size', acc.carry.size, 'pick', CASE WHEN c = 1 THEN 1 ELSE 0 END)
        ELSE named_struct('doc_id', u.doc_id, 'idx', u.idx, 'size', u.size, 'pick', CASE WHEN c = 4 THEN 1 ELSE 0 END) END))))[0] END
"""


def _level(units: DataFrame, seed: int) -> DataFrame:
    """(key, target, source_size, base, bucket, carry, out): each group's units, paired one after another."""
    start = f"named_struct('carry', cast(null as {_UNIT}), 'out', cast(array() as array<{_PICK}>))"
    fold = F.expr(f"aggregate(units, {start}, (acc, u) -> {_PAIR.format(seed=seed)})")
    keys = ["key", "target", "source_size", "base", "bucket"]
    grouped = units.groupBy(*keys).agg(F.array_sort(F.collect_list("unit")).alias("units"))
    return grouped.select(*keys, fold.alias("r")).select(*keys, "r.carry", "r.out")


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, key, idx, size, source_size, target, copies): one row per document; idx numbers rows with equal doc_id, source and size."""
    sizes = scratch.save(docs.select("doc_id", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size")).groupBy("doc_id", "key", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = scratch.save(source_targets(sizes, weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    asked = (
        sizes.join(targets.withColumnRenamed("n", "source_n"), "key")
        .withColumn("idx", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .withColumn("base", F.floor(ratio).cast("int"))
        .withColumn("p", ratio - F.col("base"))
    )
    whole = (F.col("p") <= 0) | (F.col("size") == 0)
    h = F.xxhash64(F.lit(seed), "doc_id", "idx")
    groups = F.ceil(F.col("source_n") / GROUP)
    unit = F.struct(h.alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("idx").cast("int").alias("idx"), "size", (F.col("p") * F.col("size")).alias("q"))
    units = asked.where(~whole).select("key", "target", "source_size", "base", F.pmod(h, groups).alias("bucket"), unit.alias("unit"))
    rows = lambda df, c: df.select(F.col(f"{c}.doc_id").alias("doc_id"), "key", F.col(f"{c}.idx").alias("idx"), F.col(f"{c}.size").alias("size"), "source_size", "target", (F.col("base") + F.col(f"{c}.pick")).alias("copies"))
    found = asked.where(whole).select("doc_id", "key", "idx", "size", "source_size", "target", F.col("base").alias("copies"))
    left, level = -(-(targets.agg(F.max("n")).first()[0] or 0) // GROUP), 0
    while True:
        done = scratch.save(_level(units, seed + level), f"level{level}")
        found = found.unionByName(rows(done.withColumn("o", F.explode("out")), "o"))
        if left <= 1:
            break
        units = done.select("key", "target", "source_size", "base", F.floor(F.col("bucket") / GROUP).alias("bucket"), F.col("carry").alias("unit"))
        left, level = -(-left // GROUP), level + 1
    nearest = (F.col("carry.q") * 2 >= F.col("carry.size")).cast("int")
    last = done.where("carry is not null").withColumn("o", F.struct("carry.doc_id", "carry.idx", "carry.size", nearest.alias("pick")))
    return found.unionByName(rows(last, "o"))


def mixed_documents(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs, whatever their names."""
    names = [str(i) for i in range(len(docs.columns))]
    copies = mix(docs, scratch, **how).groupBy("doc_id", "key", "size").agg(F.array_sort(F.collect_list(F.struct("idx", "copies"))).alias("c"))
    keyed = docs.select("*", F.col("doc_id"), source_key(F.col("source")), word_count(F.col("text"))).toDF(*names, "d", "k", "s")
    numbered = keyed.withColumn("row", F.row_number().over(W.partitionBy("d", "k", "s").orderBy("s")))
    to = copies.toDF("d2", "k2", "s2", "c")
    at = numbered.join(to, F.col("d").eqNullSafe(F.col("d2")) & (F.col("k") == F.col("k2")) & (F.col("s") == F.col("s2")))
    taken = at.withColumn("n", F.element_at("c", F.col("row"))["copies"]).where("n > 0")
    return taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*names).toDF(*docs.columns)
