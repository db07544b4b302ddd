"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Each whole text becomes STATISTICS. Cosines of random projections of the standardised statistics approximate a Gaussian
kernel. Every task sums the normal equations of its labelled rows; the sums (of a size that only FOURIER sets) meet in a
tree, and the driver solves one small system. All labelled rows of the learning share are used; three quarters of them fit
the ridge, the other quarter calibrates: a histogram of BINS raw scores is made monotone by pooling adjacent violators.

Defined cases: null and empty texts have all statistics 0 and are scored like others; a null doc_id is scored and never
learned from; repeated rows are scored one by one; of several labels of one doc_id the largest counts, null labels do not;
without labels every score is 0.5; an empty table gives no rows; other columns are ignored by `score`, kept by `keep_good`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.common import Scratch

STATISTICS = (
    "log_words", "log_lines", "word_length", "word_length_spread", "long_words", "upper", "digits", "marks", "odd_marks", "marked_words",
    "richness", "top_word", "top_five", "repeated_next", "repeated_pair", "repeated_triple", "repeated_line", "short_lines", "entropy", "upper_words",
)
FOURIER, WIDTH, RIDGE, BINS, SEED = 256, 3.5, 1e-3, 2048, 11
GOOD = 0.7

_CLASS = np.zeros(256, np.int64)
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[*b"0123456789"]] = 2
_CLASS[[*b".,;:?'\"-()"]] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?'\"-()"]] = 4
_MARKS = b"!#$%&*+/<=>@[\\]^_`{|}~"


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=5)
    accents = np.flatnonzero(data[:-1] == 0xC3)
    upper = kinds[1] + np.count_nonzero(data[accents + 1] < 0x9F)
    letters = max(1, np.count_nonzero(data >= 65))
    seen = Counter(words)
    common = seen.most_common(5)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs, triples = set(zip(words, words[1:], strict=False)), set(zip(words, words[1:], words[2:], strict=False))
    share = counts[counts > 0] / len(data)
    return [
        math.log1p(n), math.log1p(len(lines)), float(lengths.mean()), float(lengths.std()), float((lengths > 20).mean()), upper / letters, kinds[2] / len(data),
        kinds[3] / n, kinds[4] / n, sum(c for w, c in seen.items() if w[-1] in _MARKS) / n,
        math.log(len(seen) + 1) / math.log(n + 1), common[0][1] / n, sum(c for _, c in common) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0, 1 - len(triples) / max(1, n - 2) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), float(-(share * np.log2(share)).sum()), sum(c for w, c in seen.items() if len(w) > 1 and w.isupper()) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, stats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>").select("doc_id", held_out().alias("held_out"), "stats")


def held_out() -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


#: Partial sums that one task merges.
FAN_IN = 32


def _sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int], scratch: Scratch, name: str) -> np.ndarray:
    """The sum of `of(statistics, labels)` over (stats, label) rows: per task, then in a tree of FAN_IN sums a node; the last FAN_IN on the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                total += of(flat.reshape(batch.num_rows, -1), batch.column(1).to_numpy(zero_copy_only=False))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "m"])

    def merge(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("at").to_numpy())
        total = sum(np.frombuffer(t.column("m")[int(i)].as_py()).reshape(shape) for i in order)
        return pa.table({"at": pa.array([int(t.column("at")[0].as_py()) // FAN_IN], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    sums = scratch.save(rows.select("stats", F.col("label").cast("double")).mapInArrow(part, "at long, m binary"), f"{name}-0")
    level = 1
    while sums.count() > FAN_IN:
        sums = scratch.save(sums.groupBy(F.floor(F.col("at") / FAN_IN).alias("g")).applyInArrow(merge, "at long, m binary"), f"{name}-{level}")
        level += 1
    found = sorted((r["at"], bytes(r["m"])) for r in sums.collect())
    return sum((np.frombuffer(m).reshape(shape) for _, m in found), np.zeros(shape))


class Model:
    """What a task needs to score: bounded by FOURIER and BINS."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.directions = rng.normal(0, 1 / WIDTH, (len(mean), FOURIER))
        self.phases = rng.uniform(0, 2 * np.pi, FOURIER)
        self.weights = np.zeros(FOURIER + 1)
        self.at, self.level = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.directions + self.phases) * math.sqrt(2 / FOURIER), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth is the raw score, so that equal levels keep their order."""
        raw = self.raw(stats)
        return np.clip(0.999 * np.interp(raw, self.at, self.level) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """The model of (doc_id, held_out, stats) and (doc_id, quality)."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label"))
    fold = F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % 4
    known = scratch.save(stats.where(~F.col("held_out")).join(one, "doc_id").select("stats", "label", (fold == 3).alias("calibrates")), "known")
    d = len(STATISTICS)
    moments = _sums(known, lambda x, y: np.vstack([x.sum(0), (x * x).sum(0), np.full(d, len(x))]), (3, d), scratch, "moments")
    n = max(1.0, moments[2, 0])
    mean = moments[0] / n
    model = Model(mean, np.sqrt(np.maximum(moments[1] / n - mean**2, 1e-12)) + 1e-6)
    if not moments[2, 0]:
        return model

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = np.hstack([model.features(x), y[:, None]])
        return f.T @ f

    m = _sums(known.where("not calibrates"), normal, (FOURIER + 2, FOURIER + 2), scratch, "normal")
    k = FOURIER + 1
    model.weights = np.linalg.solve(m[:k, :k] + RIDGE * max(1.0, m[k - 1, k - 1]) / k * np.eye(k), m[:k, k])

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(np.floor((model.raw(x) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
        return np.vstack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    seen = _sums(known.where("calibrates"), histogram, (2, BINS), scratch, "histogram")
    full = seen[0] > 0
    if full.any():
        level = pool(seen[1][full] / seen[0][full], seen[0][full])
        model.at, model.level = ((np.arange(BINS) + 0.5) * 2 / BINS - 0.5)[full], level
    else:
        model.at, model.level = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    stats = scratch.save(with_statistics(docs), "statistics")
    model = fit(stats, labels, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that are predicted good, with their columns, whatever their names. Rows with equal doc_id are judged one by one, on
    their texts. Statistics are made once and written beside the rows."""
    names = [str(i) for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])
    kind = T.StructType([*plain.fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], [*names, "stats"])

    rows = scratch.save(docs.toDF(*names).mapInArrow(measured, kind), "measured")
    doc = F.col(names[docs.columns.index("doc_id")]).cast("long").alias("doc_id")
    model = fit(rows.select(doc, "stats").select("doc_id", held_out().alias("held_out"), "stats"), labels, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stats = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(model.score(stats) >= GOOD))

    return rows.mapInArrow(run, plain).toDF(*docs.columns)
