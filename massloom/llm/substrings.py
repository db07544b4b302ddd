"""Substring dedup through a log-structured fingerprint index.

A window is SPAN consecutive words. Each window is named by its minimizer, the least hash among its runs of GRAM words, so
equal windows have equal minimizers at equal places, and neighbouring windows mostly share one; an occurrence is a minimizer
with the windows that it names. The index holds sorted immutable runs of (minimizer, count): every batch of documents is
aggregated into a run, runs are compacted by merging equal minimizers, and a merge join of a batch with the index finds the
occurrences whose minimizer stands anywhere else. These are verified: occurrences with equal words around them, hashed by a
second function, are one class, and all windows of a class of two or more repeat; where a minimizer has several classes, the
windows of one occurrence of each are compared one by one. Words that a repeated window covers are removed from all documents.

Counts per minimizer and per class come from partial aggregates, and joins by them may be split, so a passage that a third
of all documents hold does not meet in one task.

Defined cases: a null or empty text has no words and keeps an empty text; texts shorter than SPAN words keep all words;
rows that repeat a doc_id and a text are occurrences of one another, so their windows go from all; a null doc_id is a value
like any other; an empty table gives no rows; other columns are ignored by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.common import Scratch, WindowHashes, WordHashes, mix, signed, words_of

SPAN, GRAM, BATCHES, RUNS = 35, 12, 2, 4
_KEY = ["doc", "h"]


def row_key() -> list[Column]:
    """doc, h: equal for rows with equal doc_id and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("h")]


class Minimizers:
    """Occurrences of a text: minimizer, hash of the words around it, first window and number of windows."""

    def __init__(self, span: int, gram: int):
        self.span, self.gram = span, min(gram, span)
        self.words, self.grams, self.whole = WordHashes(), WindowHashes(0xD1342543DE82EF95), WindowHashes()

    def hashes(self, text: str | None) -> np.ndarray:
        return self.words.of(words_of(text))

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(h) - self.span + 1
        if n < 1:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none
        g = self.grams.of(h, self.gram)
        wide = self.span - self.gram + 1
        at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, wide).argmin(1)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        count = np.diff(np.append(first, n))
        end = first + count - 1 + self.span
        whole = self.whole
        whole._grow(len(h) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * whole.powers[: len(h)], dtype=np.uint64)])
            place = mix(((at[first] - first) * 4096 + count).astype(np.uint64))
            around = mix((sums[end] - sums[first]) * whole.inverse[first] + place)
        return g[at[first]], around, first, count


def occurrences(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(mh, around, doc, h, first, n) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Minimizers(span, gram)
        for batch in batches:
            parts, sizes = [], []
            for text in batch.column(2):
                found = of.of(of.hashes(text.as_py()))
                parts.append(found)
                sizes.append(len(found[0]))
            if sum(sizes):
                mh, around, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                keys = [pa.array(np.repeat(batch.column(i).to_numpy(), sizes)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(mh)), pa.array(signed(around)), *keys, pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["mh", "around", "doc", "h", "first", "n"])

    return docs.select(*row_key(), "text").mapInArrow(run, "mh long, around long, doc long, h long, first int, n int")


class FingerprintIndex:
    """Sorted immutable runs of (mh, n). A run is written once; compaction writes the merged run and then drops its parts."""

    def __init__(self, scratch: Scratch, name: str = "index", most: int = RUNS):
        self.scratch, self.name, self.most, self.made = scratch, name, most, 0
        self.runs: dict[str, DataFrame] = {}

    def _write(self, rows: DataFrame) -> None:
        run = f"{self.name}-run{self.made}"
        self.made += 1
        merged = rows.groupBy("mh").agg(F.sum("n").alias("n")).sortWithinPartitions("mh")
        self.runs[run] = self.scratch.save(merged, run)

    def add(self, batch: DataFrame) -> None:
        """Takes in the minimizers of a batch of occurrences; compacts when there are more than `most` runs."""
        self._write(batch.select("mh", F.lit(1).cast("long").alias("n")))
        if len(self.runs) > self.most:
            self.compact()

    def _all(self) -> DataFrame:
        rows = None
        for run in self.runs.values():
            rows = run if rows is None else rows.unionByName(run)
        return rows

    def compact(self) -> None:
        if len(self.runs) > 1:
            old = list(self.runs)
            self._write(self._all())
            for run in old:
                del self.runs[run]
            self.scratch.drop(*old)

    def seen(self, batch: DataFrame, least: int = 1) -> DataFrame:
        """The rows of a batch whose minimizer the index holds at least `least` times: a merge join with the sorted runs."""
        if not self.runs:
            return batch.limit(0)
        runs = self._all()
        if len(self.runs) > 1:
            runs = runs.groupBy("mh").agg(F.sum("n").alias("n"))
        return batch.join(runs.where(F.col("n") >= least).select("mh").hint("merge"), "mh", "left_semi").select(*batch.columns)


def repeated(docs: DataFrame, scratch: Scratch, span: int = SPAN, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc, h, spans): for each row with repeated windows, the [start, end) of words that they cover; spans may overlap."""
    index = FingerprintIndex(scratch)
    found = scratch.save(occurrences(docs, span, gram).withColumn("batch", F.pmod(F.xxhash64("doc", "h"), F.lit(batches)).cast("int")), "occurrences")
    for batch in range(batches):
        index.add(found.where(F.col("batch") == batch))
    index.compact()
    likely = scratch.save(index.seen(found, 2).drop("batch"), "likely")
    scratch.drop("occurrences", *index.runs)
    # Classes: occurrences with the same words around them.
    one = F.min(F.struct("doc", "h", "first", "n")).alias("one")
    classes = scratch.save(likely.groupBy("mh", "around").agg(F.count(F.lit(1)).alias("times"), one), "classes")
    whole = likely.join(classes.where("times > 1").select("mh", "around"), ["mh", "around"], "left_semi").select("doc", "h", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + span).alias("end"))
    # Minimizers with several classes: their windows one by one.
    mixed = classes.groupBy("mh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mh")
    parts = classes.join(mixed, "mh", "left_semi").select("one.doc", "one.h", "one.first", "one.n", "mh", (F.col("times") == 1).alias("single"))
    asked = parts.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "n", "mh", "single")).alias("parts"))
    texts = docs.select(*row_key(), "text").join(asked, _KEY).dropDuplicates(_KEY)

    def windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Minimizers(span, gram)
        for batch in rows:
            for doc, h, text, parts in zip(*(batch.column(c) for c in ("doc", "h", "text", "parts")), strict=True):
                w = of.whole.of(of.hashes(text.as_py()), span)
                p = {c: parts.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n", "mh", "single")}
                at = np.repeat(p["first"], p["n"]) + np.arange(p["n"].sum()) - np.repeat(np.cumsum(p["n"]) - p["n"], p["n"])
                yield pa.RecordBatch.from_arrays([pa.array(signed(w[at])), pa.array(np.repeat(p["mh"], p["n"])), pa.array([doc.as_py()] * len(at), pa.int64()), pa.array([h.as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(np.repeat(p["single"], p["n"]).astype(bool))], ["w", "mh", "doc", "h", "at", "single"])

    compared = scratch.save(texts.mapInArrow(windows, "w long, mh long, doc long, h long, at int, single boolean"), "windows")
    twice = compared.groupBy("w", "mh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w", "mh")
    single = compared.where("single").join(twice, ["w", "mh"], "left_semi").select("doc", "h", F.col("at").alias("start"), (F.col("at") + span).alias("end"))
    return scratch.save(whole.unionByName(single).distinct().groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def deduplicated(docs: DataFrame, scratch: Scratch, span: int = SPAN, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row: the kept words, joined by one space."""
    spans = repeated(docs, scratch, span, gram, batches)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple] = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words, gone = words_of(text.as_py()), 0
                n = len(words)
                if spans.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, spans.values.field("start").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("end").to_numpy(), -1)
                    keep = np.flatnonzero(np.cumsum(edge[:n]) == 0)
                    gone, words = n - len(keep), [words[i] for i in keep]
                out.append((doc, n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["doc_id", "n_words", "n_removed", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text").join(spans, _KEY, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
