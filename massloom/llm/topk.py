"""Exact top-k search by inner product through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; rows sorted by that key are cut into annuli of at most
ROWS vectors. A query that lies at distance D of an annulus' pivot cannot be nearer to its vectors than the gap between D
and the annulus, so with |q - x|^2 = |q|^2 + |x|^2 - 2 q.x no score there exceeds (|q|^2 + largest |x|^2 - gap^2) / 2. Queries
are sorted into the same order and first meet the annulus in which they fall, which gives each a lower bound of its k-th
score. Then blocks of queries meet groups of annuli, take them by falling bound and stop below the k-th score.

Pivots are chosen, farthest first, from a bounded sample (SAMPLE rows of the smallest hashes); every row is indexed and the
result is exact whatever the pivots. Sorting goes by id within equal keys, so copies that fill a third of the table are
dealt over tasks.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as queries nor as
candidates; shorter vectors count as padded with zeros, so an empty vector scores 0 with all; components saturate at 2**62;
rows that repeat an id are candidates one by one, never for a query of that id, and make one query (the least vector);
ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from massloom.llm.common import Scratch

PIVOTS, SAMPLE, ROWS = 32, 2048, 512
#: Queries of a block, blocks of a group and annuli of a group: what a task holds.
BLOCK, BLOCKS, ANNULI = 256, 4, 16


def integer_components(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long, in double precision; null where the vector is null or not finite throughout."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    most = float(2**62)
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(most)), F.lit(-most))).cast("long")))


def _matrix(vectors: pa.Array, d: int, kind: str) -> np.ndarray:
    """Rows of a list array, padded with zeros to d components."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(lengths) and (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lengths), d), kind)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else []] = flat
    return out


class Best:
    """The k best (score, id) of each of m queries; -inf where there are fewer."""

    def __init__(self, m: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, floor.dtype), np.zeros(0, np.int64)
        self.kth = floor.copy()

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
        full = rank == self.k - 1
        self.kth[row[full]] = np.maximum(self.kth[row[full]], score[full])
        keep = rank < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]


def search(items: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best items of another id. Both tables are (id long, v array<long>)."""
    spark = scratch.spark
    both = scratch.save(
        items.where("v is not null").select("id", "v", F.lit(False).alias("asks")).unionByName(queries.where("v is not null").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.lit(True).alias("asks"))), "vectors"
    )
    top = both.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    d, most = max(1, top[0] or 0), max(1, top[1] or 0)
    kind = next(t for t, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 2**bits)
    exact = "f8" if d * most * most < 2**53 else "O"  # what the products are computed in
    sample = [r["v"] for r in both.where("not asks").orderBy(F.xxhash64("id"), "v").limit(SAMPLE).collect()]
    pivots = _pivots(np.array([list(v) + [0] * (d - len(v)) for v in sample], "f8").reshape(-1, d))
    keyed = both.mapInArrow(_keys(pivots, d), "pivot int, dist double, id long, v array<bigint>, asks boolean")
    order = ["pivot", "dist", "asks", "id", "v"]
    packed = scratch.save(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_annuli(pivots, d, kind, exact, k), "asks boolean, part long, pivot int, lo double, hi double, top double, ids binary, v binary, low binary"), "annuli")
    n = {r["asks"]: r["n"] for r in packed.groupBy("asks").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks, groups = -(-n.get(True, 0) // BLOCKS), -(-n.get(False, 0) // ANNULI)
    if not blocks or not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spread = lambda n: F.pmod(F.xxhash64("part"), F.lit(n)).cast("int")
    rings = packed.where("not asks").withColumns({"g": spread(groups), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = packed.where("asks").withColumns({"b": spread(blocks), "g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    cells = rings.groupBy("g", "b").cogroup(asked.groupBy("g", "b")).applyInArrow(_cell(pivots, d, kind, exact, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Up to PIVOTS rows, each the farthest from those before it."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [sample[0]]
    far = np.linalg.norm(sample - chosen[0], axis=1)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(sample[int(far.argmax())])
        far = np.minimum(far, np.linalg.norm(sample - chosen[-1], axis=1))
    return np.array(chosen)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _keys(pivots: np.ndarray, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_matrix(batch.column(1), d, "f8"), pivots)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near]), *batch.columns], ["pivot", "dist", *batch.schema.names])

    return run


def _annuli(pivots: np.ndarray, d: int, kind: str, exact: str, k: int):
    """Cuts sorted rows into annuli and blocks of queries; a query's `low` is its k-th score in the annulus it falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def row(asks: bool, pivot: int, lo: float, hi: float, top: float, ids: np.ndarray, v: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
            nonlocal part
            part += 1
            cells = [asks, part, pivot, lo, hi, top, ids.astype("<i8").tobytes(), v.astype(kind).tobytes(), low.astype("f8").tobytes()]
            kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], ["asks", "part", "pivot", "lo", "hi", "top", "ids", "v", "low"])

        def ask(force: bool) -> Iterator[pa.RecordBatch]:
            while held and (force or sum(len(h[0]) for h in held) >= BLOCK):
                ids, v, low = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                if len(ids) > BLOCK:
                    held.append((ids[BLOCK:], v[BLOCK:], low[BLOCK:]))
                yield row(True, -1, 0.0, 0.0, 0.0, ids[:BLOCK], v[:BLOCK], low[:BLOCK])

        for batch in batches:
            table = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "dist", "id", "asks")}
            v = _matrix(batch.column("v"), d, "<i8")
            edges = np.flatnonzero(np.diff(table["pivot"], append=-1)) + 1
            for begin, end in zip(np.append(0, edges[:-1]), edges, strict=True):
                for at in range(begin, end, ROWS):
                    now = slice(at, min(end, at + ROWS))
                    asks, ids, x, dist = table["asks"][now].astype(bool), table["id"][now], v[now], table["dist"][now]
                    mine, own = ids[~asks], x[~asks]
                    if asks.any():
                        low = np.full(asks.sum(), -np.inf)
                        if len(mine) >= k:
                            s = (x[asks].astype(exact) @ own.astype(exact).T).astype("f8")
                            s[ids[asks][:, None] == mine[None]] = -np.inf
                            low = np.sort(s, axis=1)[:, -k]
                            low = low - np.abs(low) * 1e-9  # as doubles: never above the true score
                        held.append((ids[asks], x[asks], low))
                        yield from ask(False)
                    if len(mine):
                        square = (own.astype("f8") ** 2).sum(1).max()
                        yield row(False, int(table["pivot"][at]), float(dist[~asks].min()), float(dist[~asks].max()), float(square), mine, own, np.zeros(0))
        yield from ask(True)

    return run


def _cell(pivots: np.ndarray, d: int, kind: str, exact: str, k: int):
    """The queries of a group of blocks against a group of annuli."""

    def run(rings: pa.Table, asked: pa.Table) -> pa.Table:
        many = lambda t, c, of: np.concatenate([np.frombuffer(x.as_py(), of) for x in t.column(c)]) if t.num_rows else np.zeros(0, of)
        ids, low = many(asked, "ids", "<i8"), many(asked, "low", "f8")
        q = many(asked, "v", kind).reshape(-1, d)
        if not len(ids) or not rings.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        wide = q.astype("f8")
        pivot, lo, hi, top = (rings.column(c).to_numpy() for c in ("pivot", "lo", "hi", "top"))
        to = _distances(wide, pivots)[:, pivot]
        gap = np.maximum(0, np.maximum(to - hi, lo - to))
        gap = np.maximum(0, gap - 1e-7 * (1 + to))  # distances are rounded
        bound = ((wide * wide).sum(1)[:, None] + top[None] - gap * gap) / 2
        bound = bound + 0.5 + np.abs(bound) * 1e-9
        best = Best(len(ids), k, low.astype(object) if exact == "O" else low.copy())
        q = q.astype(exact)
        for at in np.argsort(-bound.max(0)):
            open_ = np.flatnonzero(bound[:, at] >= best.kth)
            if not len(open_):
                if bound[:, at].max() < best.kth.min():
                    break
                continue
            own = np.frombuffer(rings.column("ids")[int(at)].as_py(), "<i8")
            s = q[open_] @ np.frombuffer(rings.column("v")[int(at)].as_py(), kind).reshape(-1, d).astype(exact).T
            r, c = np.nonzero((s >= best.kth[open_][:, None]) & (ids[open_][:, None] != own[None]))
            if len(r):
                best.add(open_[r], s[r, c], own[c])
        score = [max(-(2**63), min(2**63 - 1, int(x))) for x in best.score] if exact == "O" else best.score.astype(np.int64)
        return pa.table({"query_id": pa.array(ids[best.row]), "vec_id": pa.array(best.id), "score": pa.array(score, pa.int64())})

    return run
