"""Shared parts: scratch tables, word hashes and connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task may hold when it finishes the components by union-find.
EDGES_PER_TASK = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a new local one, but only in local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="massloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many "_" behind as it takes to differ from the columns that are there (case aside)."""
    while name.lower() in (x.lower() for x in taken):
        name += "_"
    return name


class Scratch:
    """Written tables in the shared folder. They cut lineage, survive the loss of executors, and go when the driver ends or drop() is called."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/massloom/{purpose}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Writes df and returns it as read back."""
        df.write.mode("errorifexists").option("compression", "zstd").partitionBy(*partition_by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of tables that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM may have gone first
            pass


class WordHashes:
    """64-bit hash of each word (bytes). Hashing anew is faster than looking up what a dict remembers."""

    @staticmethod
    def of(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D, as UTF-8. bytes.split() parts at exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WindowHashes:
    """Hashes of every run of k numbers, from prefix sums of a polynomial modulo 2**64 with an odd base."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.powers, self.inverse = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            m = len(self.powers)
            for name, b in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, old * np.uint64(pow(b, m, 1 << 64))]))

    def of(self, h: np.ndarray, k: int) -> np.ndarray:
        if len(h) < k:
            return np.zeros(0, np.uint64)
        self._grow(len(h) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers[: len(h)], dtype=np.uint64)])
            return mix((sums[k:] - sums[:-k]) * self.inverse[: len(h) - k + 1])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def find_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the edges, and the smallest vertex of its component among them."""
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))
    for x, y in zip(both[: len(a)].tolist(), both[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        else:
            parent[x] = y
    for i in range(len(parent)):  # a parent is never larger than its child
        parent[i] = parent[parent[i]]
    return names, names[np.array(parent, np.int64)] if len(names) else names


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that keep the components of a task's edges; folded whenever enough have come, so memory follows the task's vertices."""
    a, b, held, limit = [], [], 0, 4 * EDGES_PER_TASK

    def fold() -> tuple[np.ndarray, np.ndarray]:
        names, roots = find_roots(np.concatenate(a), np.concatenate(b))
        return names[names != roots], roots[names != roots]

    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held > limit:
            x, y = fold()
            a, b, held = [x], [y], len(x)
            limit = max(limit, 2 * held)
    if a:
        x, y = fold()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component): for each id of the edges (a, b; longs), the smallest id of its connected component.

    Tasks first reduce their edges to forests. While more than EDGES_PER_TASK are left, each vertex hooks onto its
    neighbour of the least random rank and edges are relabelled, which removes a constant share of the vertices in
    expectation; a hub's rows meet in partial minimums only. What then fits one task's bound is finished by union-find there.
    Lineage is cut by a written table in each round. Null ends are ignored.
    """
    spark = scratch.spark
    left = scratch.save(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long"), f"{name}-forest")
    hooks, round_no = [], 0
    while left.count() > EDGES_PER_TASK:
        rank = lambda c: F.xxhash64(F.lit(round_no), c)  # noqa: E731, B023
        ends = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        hook = scratch.save(ends.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("v"))).alias("m")).select("a", F.when(F.col("m.r") < rank(F.col("a")), F.col("m.v")).otherwise(F.col("a")).alias("p")), f"{name}-hook{round_no}")
        hooks.append(hook)
        to_b = hook.select(F.col("a").alias("b"), F.col("p").alias("q"))
        moved = left.join(hook, "a").select("b", "p").join(to_b, "b").select(F.col("p").alias("a"), F.col("q").alias("b")).where("a <> b").distinct()
        left = scratch.save(moved.mapInArrow(_forest, "a long, b long"), f"{name}-left{round_no}")
        round_no += 1
    last = left.coalesce(1).mapInArrow(_roots, "v long, label long")
    if not hooks:
        return scratch.save(last.select(F.col("v").alias("id"), F.col("label").alias("component")), name)
    last = scratch.save(last, f"{name}-last")
    found = hooks[0].select(F.col("a").alias("id"), F.col("p").alias("at"))
    for hook in hooks[1:]:
        found = found.join(hook.select(F.col("a").alias("at"), F.col("p").alias("next")), "at", "left").select("id", F.coalesce("next", "at").alias("at"))
    found = found.join(last.select(F.col("v").alias("at"), "label"), "at", "left").select("id", F.coalesce("label", "at").alias("label"))
    found = scratch.save(found, f"{name}-labels")
    least = found.groupBy("label").agg(F.min("id").alias("component"))
    return scratch.save(found.join(least, "label").select("id", "component"), name)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if table:
        names, roots = find_roots(np.concatenate([x for x, _ in table]), np.concatenate([y for _, y in table]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(roots, pa.int64())], ["v", "label"])


def grouped_links(pairs: DataFrame, link: Callable[[DataFrame, str], DataFrame], scratch: Scratch, most: int) -> DataFrame:
    """Links (a, b) of all groups of `pairs` (leader, id; a written table). `link` gives the links inside each group g of rows (g, id, size,
    side). size: about the ids of g or, where side is 1 or 2, of each side of g; then links between the sides are all that is needed.

    Groups of more than `most` are dealt into sub-blocks. Each joins itself; one id for each component and sub-block goes on to
    a smaller group, until one holds them all; then pairs of sub-blocks that still hold two components are joined whole.
    """
    sizes = scratch.save(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "groups")
    members = pairs.join(sizes, "leader")
    edges = link(members.where(F.col("size") <= most).select(F.xxhash64("leader").alias("g"), "id", "size", F.lit(0).alias("side")), "links")
    if sizes.where(F.col("size") > most).limit(1).count():
        edges = _large(members.where(F.col("size") > most).select("leader", "id", "size"), edges, link, scratch, most)
    return edges


def _large(members: DataFrame, edges: DataFrame, link: Callable[[DataFrame, str], DataFrame], scratch: Scratch, most: int) -> DataFrame:
    """edges, and the links of groups of more than `most` documents."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / most)).cast("int")
    dealt = scratch.save(members.withColumn("part", part), "dealt")
    now, level = dealt, 0
    while True:
        edges = scratch.save(edges.unionByName(link(now.select(F.xxhash64("leader", "part", F.lit(level)).alias("g"), "id", F.least("size", F.lit(most)).alias("size"), F.lit(0).alias("side")), f"large{level}")), f"edges{level}")
        comps = components(edges, scratch, f"components{level}")
        named = now.join(comps.select("id", "component"), "id", "left").select("leader", "part", "id", F.coalesce("component", "id").alias("component"))
        heads = scratch.save(named.groupBy("leader", "part", "component").agg(F.min("id").alias("id")), f"heads{level}")
        sizes = heads.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.max("part").alias("last"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        more = heads.select("leader", "id").join(sizes.where("last > 0 and c0 <> c1"), "leader").withColumn("part", part)
        level += 1
        before = now.count()
        now = scratch.save(more.select("leader", "id", "size", "part"), f"now{level}")
        left = now.count()
        if not left or left >= before:
            break
    # Whole sub-blocks that still hold two components between them.
    named = scratch.save(dealt.join(comps.select("id", "component"), "id", "left").select("leader", "part", "id", F.coalesce("component", "id").alias("component")), "named")
    blocks = named.groupBy("leader", "part").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    other = blocks.select("leader", F.col("part").alias("j"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    cells = blocks.withColumnRenamed("part", "i").join(other, "leader").where("i < j and least(c0, d0) <> greatest(c1, d1)").select("leader", "i", "j")
    both = cells.select("leader", F.col("i").alias("part"), "i", "j", F.lit(1).alias("side")).unionByName(cells.select("leader", F.col("j").alias("part"), "i", "j", F.lit(2).alias("side")))
    rest = link(named.select("leader", "part", "id").join(both, ["leader", "part"]).select(F.xxhash64("leader", "i", "j", F.lit("cell")).alias("g"), "id", F.lit(most).cast("long").alias("size"), "side"), "cells")
    return scratch.save(edges.unionByName(rest), "edges-all")
