"""Embedding near-dedup by sorted projection passes.

Equal vectors are one class with a count. In each of PASSES passes the classes are ordered lexicographically by 64 signs of
random projections (a cut through the sorted table is a task), and each is compared with its WINDOW successors; verified
pairs of all passes are united. Passes only have to connect: inside a component all links are then counted exactly. A large
component is not compared with itself whole: members within half the threshold's angle of its centre are linked to one
another by the triangle inequality, so only pairs with a member outside are computed, in blocks of BLOCK.
Passes look at bounded windows, so a link is missed where no pass brings two components together: see the README for recall.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept;
vectors of different lengths are not compared; rows of one vec_id are one vertex; a null vec_id has component null and is
kept; ties need no rule, the smallest vec_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.common import Scratch, components

THRESHOLD, PASSES, WINDOW, BLOCK, SEED = 0.95, 24, 24, 512, 5


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as bytes of doubles with its digest; null where it takes no part."""
    for batch in batches:
        kept: list[tuple] = []
        for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = None
            if x.is_valid and len(x.values) and not x.values.null_count:
                a = x.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(a).all() and a.any():
                    v = (a + 0.0).tobytes()  # -0.0 is 0.0
            kept.append((doc, v, xxhash.xxh3_128_digest(v) if v else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), [pa.int64(), pa.binary(), pa.binary()], strict=True)] if kept else [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary())], ["vec_id", "v", "class"])


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = np.stack([np.frombuffer(v, "<f8") for v in column.to_pylist()])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _projected(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(v) // 8 for v in batch.column(1).to_pylist()])
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).normal(size=(d, 64 * passes))
                bits = _units(part.column(1)) @ planes[d] > 0
                keys = np.packbits(bits, axis=1).view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, passes), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(keys), d), pa.int32()), listed], ["rep", "v", "d", "keys"])

    return run


def _swept(threshold: float, window: int):
    """Links between neighbours of a sorted task: (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, reps, vectors = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            key = batch.column("pass").to_numpy().astype(np.int64) << 32 | batch.column("d").to_numpy()
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            for g in np.unique(key):
                now = key == g
                x = _units(batch.column("v").filter(pa.array(now)))
                if len(groups) and groups[0] != g:
                    groups, reps, vectors = groups[:0], reps[:0], vectors[:0]
                reps = np.concatenate([reps, rep[now]])
                vectors = np.concatenate([vectors, x]) if len(groups) else x
                fresh, groups = len(groups), np.full(len(reps), g)
                a, b = [], []
                for step in range(1, min(window, len(reps) - 1) + 1):
                    first = max(0, fresh - step)
                    found = first + np.flatnonzero(np.einsum("ij,ij->i", vectors[first:-step], vectors[first + step :]) >= threshold)
                    a.append(reps[found])
                    b.append(reps[found + step])
                if a and sum(map(len, a)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                groups, reps, vectors = groups[-window:], reps[-window:], vectors[-window:]

    return run


def _link_counts(threshold: float):
    """(rep, links) of the pairs of a cell: all pairs of a small component, or two blocks of a large one."""

    def run(t: pa.Table) -> pa.Table:
        comp, rep, n = (t.column(c).to_numpy().astype(np.int64) for c in ("component", "rep", "n"))
        side = t.column("side").to_numpy()
        order = np.lexsort((side, comp))
        comp, rep, n, side = comp[order], rep[order], n[order], side[order]
        x = t.column("v").take(pa.array(order)).to_pylist()
        begins = np.flatnonzero(np.diff(comp, prepend=comp[0] - 1))
        links = np.zeros(len(rep), np.int64)
        for lo, hi in zip(begins, np.append(begins[1:], len(comp)), strict=True):
            sizes = np.array([len(v) for v in x[lo:hi]])
            for size in np.unique(sizes):
                own = lo + np.flatnonzero(sizes == size)
                u = _units(pa.array([x[i] for i in own]))
                near = u @ u.T >= threshold
                near[np.arange(len(own)), np.arange(len(own))] = False
                if side[own].min() >= 0:  # two different blocks: only pairs across
                    near &= side[own][:, None] != side[own][None]
                links[own] += near @ n[own]
        return pa.table({"rep": rep, "links": links})

    return run


def near_dedup(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    rows = scratch.save(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_classes, "vec_id long, v binary, class binary"), "rows")
    fine = rows.where("class is not null and vec_id is not null")
    classes = fine.groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    reps = scratch.save(classes, "classes")
    keyed = reps.select("rep", "v").mapInArrow(_projected(passes), "rep long, v binary, d int, keys array<long>").select("rep", "v", "d", F.posexplode("keys").alias("pass", "key"))
    order = ["pass", "d", "key", "rep"]
    links = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "d", "rep", "v").mapInArrow(_swept(threshold, window), "a long, b long")
    comps = components(links, scratch)
    members = scratch.save(reps.join(comps.withColumnRenamed("id", "rep"), "rep"), "members")
    counted = _counted(members, scratch, threshold, block)
    per_class = reps.select("class", "rep", "n").join(comps.withColumnRenamed("id", "rep"), "rep", "left").join(counted, "rep", "left").select(
        "class", F.coalesce("component", "rep").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    named = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("class")).alias("class")).join(per_class, "class", "left")
    component = F.coalesce("component", "vec_id")
    return named.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _counted(members: DataFrame, scratch: Scratch, threshold: float, block: int) -> DataFrame:
    """(rep, links): for each class, the vectors of other classes of its component that it is linked to."""
    sized = scratch.save(members.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    at = members.join(sized, "component")
    cell = "component long, rep long, n long, side int, v binary"
    small = at.where(F.col("size") <= block)
    tasks = max(1, -(-small.count() // (4 * block)))
    near = small.select("component", "rep", "n", F.lit(-1).alias("side"), "v", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("t")).groupBy("t").applyInArrow(_link_counts(threshold), "rep long, links long")
    large = at.where(F.col("size") > block)
    if not sized.where(F.col("size") > block).limit(1).count():
        return near
    half = float(np.arccos(threshold) / 2 - 1e-7)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, "<f8")
                total[c, len(x)] = total.get((c, len(x)), 0) + x / np.sqrt(((x / np.abs(x).max()) ** 2).sum()) / np.abs(x).max()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in total], pa.int64()), pa.array([d for _, d in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["component", "d", "v"])

    def total(t: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(v, "<f8") for v in t.column("v").to_pylist())
        return pa.table({"component": t.column("component")[:1], "d": t.column("d")[:1], "centre": pa.array([x.tobytes()], pa.binary())})

    centres = large.select("component", "v").mapInArrow(sums, "component long, d int, v binary").groupBy("component", "d").applyInArrow(total, "component long, d int, centre binary")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                core = []
                for v, c in zip(batch.column("v").to_pylist(), batch.column("centre").to_pylist(), strict=True):
                    x, y = np.frombuffer(v, "<f8"), np.frombuffer(c, "<f8")
                    x = x / np.abs(x).max()
                    size = np.linalg.norm(x) * np.linalg.norm(y)
                    core.append(bool(size > 0 and np.arccos(np.clip(x @ y / size, -1, 1)) <= half))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "d", "rep", "n", "v")), pa.array(core)], ["component", "d", "rep", "n", "v", "core"])

    sorted_ = scratch.save(
        large.withColumn("d", (F.length("v") / 8).cast("int")).join(centres, ["component", "d"]).select("component", "d", "rep", "n", "v", "centre").mapInArrow(angles, "component long, d int, rep long, n long, v binary, core boolean"), "large"
    )
    parts = sorted_.groupBy("component", "d").agg(F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("others"), F.coalesce(F.sum(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("core_n"))
    here = sorted_.join(parts, ["component", "d"])
    inside = here.where("core").select("rep", (F.col("core_n") - F.col("n")).alias("links"))
    nc, no = F.ceil(F.col("cores") / block).cast("int"), F.ceil(F.col("others") / block).cast("int")
    own = F.when(F.col("core"), F.pmod(F.xxhash64("rep"), F.greatest(nc, F.lit(1)))).otherwise(nc + F.pmod(F.xxhash64("rep"), F.greatest(no, F.lit(1)))).cast("int")
    # A core block meets every block of others; a block of others meets every block, itself included.
    partner = F.when(F.col("core"), F.when(no > 0, F.sequence(nc, nc + no - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.sequence(F.lit(0), nc + no - 1))
    cells = here.withColumn("own", own).withColumn("other", F.explode(partner)).select(
        "component", "d", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "n", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "v"
    )
    far = cells.groupBy("component", "d", "i", "j").applyInArrow(_link_counts(threshold), "rep long, links long")
    return near.unionByName(inside).unionByName(far).groupBy("rep").agg(F.sum("links").alias("links"))
