"""Best-fit packing of documents into token sequences.

`token_pieces` encodes whole texts and cuts only those longer than a sequence. `pack` places pieces by bulk-synchronous
best fit, longest first. Pieces are range-sorted by length, so equal lengths form runs, and so do gaps of equal size.
A round takes a run of pieces and sweeps to its successor among the gaps, the smallest that holds a piece; where many
pieces want that run of gaps, rank decides: the k-th piece goes to the k-th place. Then the gaps are updated and the next
round begins. What a round has to know is a count for each length (at most `capacity`, whatever the number of pieces), so
the rounds run over counts, and each task then finds the places of its own sorted pieces by the same ranks. Pieces never
leave the executors, and a length that a third of all pieces share is dealt over tasks like any other.

Defined cases: a null or empty text is one piece that holds only the end token; repeated rows are packed one by one;
a null doc_id is kept; lengths that are null, below 1 or above the capacity get a null sequence_id and offset from `pack`;
an empty table gives no rows; other columns of docs are ignored by `token_pieces`, kept by `pack`.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.common import Scratch, free_name

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END = 1
#: Words and pieces of words whose ids a Python worker remembers.
WORDS_REMEMBERED, PIECES_REMEMBERED = 300_000, 150_000
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class Encoder(dict):
    """Ids of a text, as little-endian 32-bit numbers; a dict from words (bytes) to the ids that are remembered.

    The tokenizer's rules never join across white space, so a text's ids are its words' ids in order. Plain words go to
    the model directly, after the same normalisation; all others, and texts that name a special token, go through the
    tokenizer itself.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in normal.get("normalizers", [])] + [x["type"] for x in split.get("pretokenizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and split["pretokenizers"][0]["invert"] and split["pretokenizers"][0]["behavior"] == "Removed"
        if self.by_word:
            self.find = regex.compile(split["pretokenizers"][0]["pattern"]["Regex"]).findall
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in shown]
            self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
            self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if max(text) < "Ԁ" and text.isprintable() and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            found = self.find(text.replace("Σ", "σ").lower())
            ids = self._piece(found[0]) if len(found) == 1 else b"".join(map(self._piece, found))
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < WORDS_REMEMBERED:
            self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.whole.model.tokenize(plain)], "<u4").tobytes()
            if len(self.pieces) < PIECES_REMEMBERED:
                self.pieces[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.by_word and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, text.encode().split()))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The tokenizer of that file, kept while the worker lives."""
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(public_tokenizers.path(name))
    return _encoders[name]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end token, cut only where longer than capacity."""
    last, step = np.array([end], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = of(text.as_py() or "") + last
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").tolist()] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names)  # noqa: B905

    schema = _PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The rounds over runs: (length, first rank, end rank, first sequence, pieces per gap, offset).

    Within a row the piece of rank r goes to sequence first + (r - first rank) // per gap, in its gap's place
    (r - first rank) % per gap.
    """
    rounds: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            per = gap // length
            used = min(n, -(-left // per))
            taken = min(left, used * per)
            rounds.append((length, rank, rank + taken, first, per, capacity - gap))
            full, over = divmod(taken, per)
            put(gap, first + used, n - used)
            put(gap - per * length, first, full)
            if over:
                put(gap - over * length, first + full, 1)
            rank, left = rank + taken, left - taken
    return rounds


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset (with "_" behind where pieces has such columns). `pieces` (a written table: it is read more
    than once) has an integer length; `by` settles ties."""
    own = pieces.columns
    names = [f"c{i}" for i in range(len(own))]
    at = own.index("length")
    placed = _pack(pieces.toDF(*names).withColumnRenamed(names[at], "length"), scratch, capacity, tuple("length" if c == "length" else names[own.index(c)] for c in by))
    return placed.toDF(*own, free_name("sequence_id", own), free_name("offset", own))


def _pack(pieces: DataFrame, scratch: Scratch, capacity: int, by: tuple[str, ...]) -> DataFrame:
    spark = scratch.spark
    fits = F.col("length").between(1, capacity)
    ok = pieces.where(fits)
    ranked_kind = T.StructType([*ok.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_rank", T.LongType())])
    length_at = ok.columns.index("length")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rank within the task's run of each length; a task's pieces come sorted."""
        task, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if batch.num_rows:
                lengths = batch.column(length_at).to_numpy(zero_copy_only=False).astype(np.int64)
                begins = np.flatnonzero(np.diff(lengths, prepend=lengths[0] - 1))
                ranks = np.arange(len(lengths)) - np.repeat(begins, np.diff(np.append(begins, len(lengths))))
                if lengths[0] == last:
                    ranks[: begins[1] if len(begins) > 1 else None] += seen
                last, seen = lengths[-1], int(ranks[-1]) + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ranks), task), pa.int32()), pa.array(ranks, pa.int64())], [*batch.schema.names, "_task", "_rank"])

    order = [F.col("length").desc(), *(F.col(c) for c in by)]
    ranked = scratch.save(ok.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(rank, ranked_kind), "ranked")
    # Sorted pieces: a task meets another's length only at its ends, so there are at most capacity + tasks rows.
    runs = sorted((r["length"], r["_task"], r["n"]) for r in ranked.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("n")).collect())
    counts: dict[int, int] = {}
    tasks: dict[int, list[tuple[int, int, int]]] = {}
    for length, task, n in runs:
        tasks.setdefault(length, []).append((task, counts.get(length, 0), n))
        counts[length] = counts.get(length, 0) + n
    plan, at = [], dict.fromkeys(tasks, 0)
    for length, lo, hi, first, per, offset in best_fit_rounds(counts, capacity):
        while True:  # a row goes to every task that it reaches, with its first rank as that task counts (negative: in a task before)
            task, begin, n = tasks[length][at[length]]
            plan.append((task, length, lo - begin, first, per, offset))
            if hi < begin + n or at[length] == len(tasks[length]) - 1:
                break
            at[length] += 1
            if hi == begin + n:
                break
    kind = "_task int, length int, lo long, first long, per int, offset int"
    places = scratch.save(spark.createDataFrame(pd.DataFrame(plan, columns=[x.split(" ")[0] for x in kind.split(", ")]), kind), "plan") if plan else spark.createDataFrame([], kind)
    out_kind = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def place(mine: pa.Table, plan: pa.Table) -> pa.Table:
        """Finds each piece's row of the plan: the last that begins at or before its (length, rank)."""
        length, ranks = (mine.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
        p = {c: plan.column(c).to_numpy().astype(np.int64) for c in plan.column_names}
        base = -min(0, p["lo"].min(initial=0))
        wide = 1 + base + max(ranks.max(initial=0), p["lo"].max(initial=0))
        keys = p["length"] * wide + p["lo"] + base
        order = np.argsort(keys)
        row = order[np.searchsorted(keys[order], length * wide + ranks + base, side="right") - 1]
        step, slot = np.divmod(ranks - p["lo"][row], p["per"][row])
        found = [pa.array(p["first"][row] + step, pa.int64()), pa.array(p["offset"][row] + slot * length, pa.int64())]
        return pa.table([*(mine.column(c) for c in names), *found], names=[*names, "sequence_id", "offset"])

    placed = ranked.groupBy("_task").cogroup(places.groupBy("_task")).applyInArrow(place, out_kind)
    rest = pieces.where(~F.coalesce(fits, F.lit(False))).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    return placed.unionByName(rest)


def pack_documents(docs: DataFrame, scratch: Scratch, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """token_pieces of docs, packed."""
    return pack(scratch.save(token_pieces(docs, tokenizer, capacity, end), "pieces"), scratch, capacity)
