"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct five-word shingles; equal sets are one class. Two sets with a Jaccard index
of t share one of their first |A| - ceil(t |A|) + 1 members in any common order (rare before frequent), so documents that
share none of those cannot link. Every set is sent to the leader (fewest shingles, then least name) of each prefix
member that it shares, once per leader; whichever two sets share a member meet there, unless one between them in size is
missing so that no chain of sizes joins them. In such a group a signature tree
stands over the documents sorted by size: a node holds the OR of its documents' token bitmaps and their range of sizes. A dual
traversal drops pairs of nodes whose sizes or largest possible overlap cannot reach the threshold, or that are connected
already; pairs of documents that are left are verified on the sets. A first traversal, on sizes and bitmaps alone, finds
which documents have any possible partner in their group; only their texts are sent.

Groups of more than `most` documents are dealt into sub-blocks: each joins itself, then one document per component and
sub-block goes on to a smaller group, and last every pair of sub-blocks that still holds two components is joined whole.
So copies and near copies that fill a third of the table collapse where they lie, and no pair is left out.

Frequent shingles are counted over all documents; the list (at most FREQUENT) only orders prefixes and is broadcast.

Defined cases: a null or empty text, or one of white space, has an empty set and links with nothing; fewer words than five are
one shingle; a null doc_id has component null; rows that repeat a doc_id are one document, which holds
the links of all its texts; ties need no rule;
an empty table gives no rows; other columns are ignored by `jaccard_components`, kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.common import Scratch, WindowHashes, WordHashes, components, find_roots, grouped_links, mix, signed

SHINGLE, PERCENT = 5, 75
FREQUENT, FREQUENT_SHARE, CHUNK = 1 << 16, 0.001, 2_000_000
LEAST_BITS, LEAF, FAN, MOST, TASK_ROWS = 256, 32, 8, 4096, 1000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Shingles:
    """Sets of whole texts, as sorted distinct 64-bit hashes."""

    def __init__(self, k: int = SHINGLE):
        self.k, self.words, self.windows = k, WordHashes(), WindowHashes()

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        h = self.words.of(words)
        if len(h) < self.k:
            return mix(self.windows.of(h, len(h)) + np.uint64(len(h)))
        return np.unique(self.windows.of(h, self.k))


def _frequent(k: int):
    """(token, n): shingles that many documents of a chunk hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size, docs = Shingles(k), [], 0, 0

        def close() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= max(3, docs * FREQUENT_SHARE)
            return pa.RecordBatch.from_arrays([pa.array(signed(token[many])), pa.array(n[many].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                s = shingles.of(text.as_py())
                held.append(s)
                size, docs = size + len(s), docs + 1
                if size >= CHUNK:
                    yield close()
                    held, size, docs = [], 0, 0
        if size:
            yield close()

    return run


def _prefixes(k: int, percent: int, frequent: np.ndarray):
    """(doc_id, h, n, set, light, heavy, bits): the name of each set, its prefix, frequent members last and apart, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in batches:
            rows: list[tuple] = []
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingles.of(text.as_py())
                n = len(s)
                often = np.isin(s, frequent, assume_unique=True) if len(frequent) else np.zeros(n, bool)
                length = n + (-percent * n // 100) + 1 if n else 0
                light = s[~often][:length]
                name = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if n else None
                rows.append((doc, h, n, name, signed(light), signed(s[often][: length - len(light)]), np.packbits(signature(s)).tobytes() if n else None))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "h", "n", "set", "light", "heavy", "bits"])

    return run


def _led(percent: int):
    """(leader, id) of rows (token, n, set) sorted by these: a token's first set leads the others, up to where the next is too large
    for the one before it; no set behind such a gap can link with one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = size = leader = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, n, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            n = n.astype(np.int64)
            new = np.append(True, (t[1:] != t[:-1]) | (100 * n[:-1] < percent * n[1:]))
            new[0] = token is None or t[0] != token or 100 * size < percent * n[0]
            at = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
            lead = np.where(at >= 0, d[np.maximum(at, 0)], leader if leader is not None else 0)
            follows = ~new & (lead != d)
            pairs = np.unique(np.stack([lead[follows], d[follows]], 1), axis=0)
            leads = np.unique(lead[follows])
            token, size, leader = t[-1], int(n[-1]), int(lead[-1])
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], leads])), pa.array(np.concatenate([pairs[:, 1], leads]))], ["leader", "id"])

    return run


def signature(s: np.ndarray) -> np.ndarray:
    """The bitmap of a set, with two to four bits per member."""
    bits = np.zeros(max(LEAST_BITS, 1 << int(2 * len(s) - 1).bit_length()), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return bits


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of a smaller width, which the low bits of the same hashes would give."""
    return bits if bits.shape[-1] == width else bits.reshape(*bits.shape[:-1], -1, width).any(-2)


class Tree:
    """Documents by size; leaves of at most LEAF documents with bitmaps of one width, nodes of FAN children."""

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray], sets: list[np.ndarray] | None = None):
        self.sets, self.sizes = sets, sizes
        self.marked = np.zeros(len(sizes), bool)
        self.parent = list(range(len(sizes)))
        self.links: list[tuple[int, int]] = []
        widths = np.array([len(b) for b in bits])
        level, lo = [], 0
        while lo < len(bits):
            hi = lo + 1
            while hi < len(bits) and hi < lo + LEAF and widths[hi] == widths[lo]:
                hi += 1
            each = np.stack(bits[lo:hi])
            level.append({"lo": lo, "hi": hi, "children": (), "each": each, "bits": each.any(0), "least": sizes[lo], "largest": sizes[hi - 1], "over": (sizes[lo:hi] - each.sum(1)).max()})
            lo = hi
        while len(level) > 1:
            level = [self._node(tuple(level[i : i + FAN])) for i in range(0, len(level), FAN)]
        self.root = level[0]

    def _leaves_of(self, node: dict) -> list[dict]:
        return [x for c in node["children"] for x in self._leaves_of(c)] or [node]

    def _node(self, children: tuple) -> dict:
        lo, hi = children[0]["lo"], children[-1]["hi"]
        width = min(len(c["bits"]) for c in children)
        over = max((self.sizes[x["lo"] : x["hi"]] - _folded(x["each"], width).sum(1)).max() for c in children for x in self._leaves_of(c))
        return {"lo": lo, "hi": hi, "children": children, "bits": np.logical_or.reduce([_folded(c["bits"], width) for c in children]), "least": self.sizes[lo], "largest": self.sizes[hi - 1], "over": over}

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def one(self, node: dict) -> int:
        """The component of all the node's documents, or -1. Once found it stays one."""
        if node.get("one") is None:
            roots = {self.find(i) for i in range(node["lo"], node["hi"])} if not node["children"] else {self.one(c) for c in node["children"]}
            if len(roots) != 1 or -1 in roots:
                return -1
            node["one"] = node["lo"]
        return self.find(node["one"])

    def join(self, percent: int) -> list[tuple[int, int]]:
        """Links that connect what is connected. Without sets, marks the documents that may have a partner."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()  # a does not come after b
            if 100 * a["largest"] < percent * b["least"]:
                continue
            # |A & B| >= percent (|A| + |B|) / (100 + percent)
            if a is not b and len(a["bits"]) == len(b["bits"]) and (100 + percent) * (np.count_nonzero(a["bits"] & b["bits"]) + a["over"]) < percent * (a["least"] + b["least"]):
                continue
            if self.sets is None:
                if self.marked[a["lo"] : a["hi"]].all() and self.marked[b["lo"] : b["hi"]].all():
                    continue
            elif (one := self.one(a)) >= 0 and (a is b or one == self.one(b)):
                continue
            if not a["children"]:
                self._leaves(a, b, percent)
            elif a is b:  # the nodes themselves first: they are popped last in, first out
                kids = a["children"]
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(len(kids) - 1, i, -1)]
                stack += [(x, x) for x in kids]
            else:
                stack += [(x, y) for x in a["children"] for y in (b["children"] or (b,))]
        return self.links

    def _leaves(self, a: dict, b: dict, percent: int) -> None:
        if b["children"]:
            for y in b["children"]:
                self._leaves(a, y, percent)
            return
        x, y = slice(a["lo"], a["hi"]), slice(b["lo"], b["hi"])
        width = min(len(a["bits"]), len(b["bits"]))
        p, q = _folded(a["each"], width).astype(np.float32), _folded(b["each"], width).astype(np.float32)
        most = p @ q.T + np.minimum((self.sizes[x] - p.sum(1))[:, None], (self.sizes[y] - q.sum(1))[None])
        fits = (100 + percent) * most >= percent * (self.sizes[x][:, None] + self.sizes[y][None])
        fits &= 100 * np.minimum(self.sizes[x][:, None], self.sizes[y][None]) >= percent * np.maximum(self.sizes[x][:, None], self.sizes[y][None])
        if a is b:
            fits = np.triu(fits, 1)
        if self.sets is None:
            self.marked[x] |= fits.any(1)
            self.marked[y] |= fits.any(0)
            return
        for i, j in zip(*np.nonzero(fits), strict=True):
            i, j = int(i) + a["lo"], int(j) + b["lo"]
            p, q = self.find(i), self.find(j)
            if p != q:
                s, t = self.sets[i], self.sets[j]
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    self.parent[max(p, q)] = min(p, q)
                    self.links.append((i, j))


def _plausible(percent: int):
    """(leader, id): the members of each group that may have a partner in it, by sizes and bitmaps alone."""

    def run(t: pa.Table) -> pa.Table:
        leader, doc, n = (t.column(c).to_numpy().astype(np.int64) for c in ("leader", "id", "n"))
        order = np.lexsort((doc, n, leader))
        leader, doc, n, bits = leader[order], doc[order], n[order], t.column("bits").take(pa.array(order)).to_pylist()
        begins = np.flatnonzero(np.diff(leader, prepend=leader[0] - 1))
        keep = np.zeros(len(doc), bool)
        for lo, hi in zip(begins, np.append(begins[1:], len(doc)), strict=True):
            if hi - lo > 1:
                own = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in bits[lo:hi]]
                tree = Tree(n[lo:hi], own)
                tree.join(percent)
                keep[lo:hi] = tree.marked
        return pa.table({"leader": leader[keep], "id": doc[keep]})

    return run


def _linked(k: int, percent: int):
    """Links inside each group g of a task's rows (g, id, text)."""

    def run(t: pa.Table) -> pa.Table:
        shingles, remembered = Shingles(k), {}
        g, doc, text = t.column("g").to_numpy(), t.column("id").to_numpy(), t.column("text").combine_chunks()
        order = np.argsort(g, kind="stable")
        begins = np.flatnonzero(np.diff(g[order], prepend=g[order[0]] - 1))
        a, b = [], []
        for lo, hi in zip(begins, np.append(begins[1:], len(order)), strict=True):
            own = []
            for i in order[lo:hi]:
                if int(doc[i]) not in remembered:
                    remembered[int(doc[i])] = shingles.of(text[int(i)].as_py())
                own.append((len(remembered[int(doc[i])]), int(doc[i])))
            own = sorted(x for x in set(own) if x[0])
            if len(own) > 1:
                sets = [remembered[d] for _, d in own]
                for i, j in Tree(np.array([n for n, _ in own]), [signature(x) for x in sets], sets).join(percent):
                    a.append(own[i][1])
                    b.append(own[j][1])
        if a:
            names, roots = find_roots(np.array(a, np.int64), np.array(b, np.int64))
            a, b = names[names != roots], roots[names != roots]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    often = texts.select("text").mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    least = max(3, int(texts.count() * FREQUENT_SHARE))
    frequent = np.sort(np.array([r["token"] for r in often.where(F.col("n") >= least).orderBy(F.col("n").desc(), "token").limit(FREQUENT).collect()], np.int64).view(np.uint64))
    sets = scratch.save(texts.mapInArrow(_prefixes(k, percent, frequent), "doc_id long, h long, n int, set long, light array<long>, heavy array<long>, bits binary"), "sets")
    known = sets.where("doc_id is not null and n > 0")
    ids = scratch.save(sets.select("doc_id", "h", "n", "set"), "ids")
    signs = scratch.save(known.groupBy(F.col("set").alias("id")).agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct("doc_id", "h")).alias("at")), "signs")

    tokens = known.select(F.explode("light").alias("token"), "n", "set").repartition("token").sortWithinPartitions("token", "n", "set")
    light = tokens.mapInArrow(_led(percent), "leader long, id long")
    heavy = known.select(F.explode("heavy").alias("token"), "n", F.col("set").alias("id")).distinct()
    heads = heavy.groupBy("token").agg(F.min(F.struct("n", "id"))["id"].alias("leader"))
    pairs = light.unionByName(heavy.join(F.broadcast(heads), "token").select("leader", "id"))  # heads: at most FREQUENT rows of two longs, 1 MB
    pairs = scratch.save(pairs.distinct(), "pairs")
    scratch.drop("sets")
    scratch.tidy()
    # Groups first meet as bitmaps; texts go only where a partner is possible. Groups beyond `most` go on whole.
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = pairs.join(sizes, "leader")
    met = sized.where(F.col("size") <= most).join(signs.select("id", "n", "bits"), "id").select("leader", "id", "n", "bits")
    tasks = max(1, -(-pairs.count() // TASK_ROWS))
    kept = met.withColumn("t", F.pmod(F.xxhash64("leader"), F.lit(tasks))).groupBy("t").applyInArrow(_plausible(percent), "leader long, id long")
    pairs = scratch.save(kept.unionByName(sized.where(F.col("size") > most).select("leader", "id")), "plausible")
    scratch.drop("pairs")
    scratch.tidy()
    wanted = pairs.select("id").distinct().join(signs.select("id", "at.doc_id", "at.h"), "id")
    likely = scratch.save(texts.join(wanted.hint("merge"), ["doc_id", "h"]).dropDuplicates(["id"]).select("id", "text"), "likely")
    scratch.tidy()

    def link(rows: DataFrame, name: str) -> DataFrame:
        """Links of rows (g, id); the texts go to the groups."""
        rows = scratch.save(rows.select("g", "id"), f"{name}-rows")
        tasks = max(1, -(-rows.count() // TASK_ROWS))
        held = likely.join(rows, "id").withColumn("t", F.pmod(F.xxhash64("g"), F.lit(tasks))).select("g", "id", "text", "t")
        return scratch.save(held.groupBy("t").applyInArrow(_linked(k, percent), "a long, b long"), name)

    edges = grouped_links(pairs, link, scratch, most)
    # A doc_id whose rows have several texts holds their sets together.
    several = ids.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("set").alias("b"), F.max("set").alias("a")).where("a <> b").select("doc_id", "b")
    held = ids.where("n > 0").join(several, "doc_id").select(F.col("set").alias("a"), "b")
    comps = components(edges.unionByName(held), scratch)
    scratch.drop("likely", "plausible", "links-rows")
    named = ids.join(comps.withColumnRenamed("id", "set"), "set", "left").withColumn("group", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "set")))
    named = scratch.save(named.select("doc_id", "n", "group"), "documents")
    # Which group a doc_id is in, and its least doc_id; rows without a set follow their doc_id's other rows.
    groups = named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("group", "least")
    of_doc = scratch.save(named.select("doc_id", "group").distinct().join(groups, "group").select("doc_id", F.col("least").alias("component_id")).distinct(), "of-doc")
    found = named.join(of_doc, "doc_id", "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without those that link, over however many steps, to a smaller doc_id."""
    comps = jaccard_components(docs, scratch, k, percent)
    gone = comps.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
