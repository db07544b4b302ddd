"""The pipeline operators against brute force, round trips and their edge cases."""

import hashlib
import io
import json
import random
import tracemalloc
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from massloom.llm import chat, common, embeddings, jaccard, lines, mixing, packing, quality, queries, substrings, topk, warc
from massloom.llm.common import Scratch

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "s", "ta", "vo", "")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randrange(30)) for _ in range(n)]


def documents(spark, texts, sources=None):
    sources = sources or [None] * len(texts)
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(zip(texts, sources))]
    return spark.createDataFrame(rows, DOCS)


def scratch(spark):
    return Scratch(spark, "test")


ODD = [None, "", "   ", "one", "a b c", "\n\n", "x " * 3000, "Ünïcode ΣΑΣ 日本 \u00a0 e\u0301"]


# --- common ---


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("limit", [10**6, 3])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "EDGES_PER_TASK", limit)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(25)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {x["id"]: x["component"] for x in common.components(df.repartition(3), scratch(spark)).collect()}
    assert found == {k: v for k, v in roots(e for e in edges if e[0] != e[1]).items()}
    assert common.components(df.limit(0), scratch(spark)).count() == 0


# --- 1 ---


def test_encoder_equals_the_tokenizer():
    of = packing.encoder(packing.TOKENIZER)
    for text in ["Hello, world's 12!", "don't <|endoftext|> x", "ΣΑΣ Ünï e\u0301 日本語 \u00a0x\u200by", "A\x1cB \t\n C", "İstanbul ﬁ 😀!!", *(t for t in ODD if t)]:
        assert np.frombuffer(of.ids(text), "<u4").tolist() == of.whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("capacity", [7, 16, 4096])
def test_packing(spark, capacity):
    texts = [" ".join(words(i, i % 37)) for i in range(60)] + ["kan1 kan2"] * 20 + ODD
    rows = packing.pack_documents(documents(spark, texts).repartition(5), scratch(spark), capacity=capacity).collect()
    of, at = packing.encoder(packing.TOKENIZER), {}
    for i, t in enumerate(texts):
        ids = np.append(np.frombuffer(of.ids(t or ""), "<u4"), np.uint32(1)).astype("<u4")
        for piece, begin in enumerate(range(0, len(ids), capacity)):
            part = ids[begin : begin + capacity]
            at[i, piece] = (begin, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == at
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    # Best fit, longest first, one by one.
    gaps = []
    for n in sorted((x[1] for x in at.values()), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        gaps.append((capacity if fit is None else gaps.pop(gaps.index(fit))) - n)
    assert len(held) == len(gaps)


def test_packing_odd_lengths(spark):
    df = spark.createDataFrame([(1, 0, 5, "x"), (2, 0, 0, "y"), (3, 0, None, "z"), (4, 0, 99, None)], "doc_id long, piece int, length int, sequence string")
    s = scratch(spark)
    found = {r["doc_id"]: r["sequence_id"] for r in packing.pack(s.save(df, "p"), s, 10).collect()}
    assert found == {1: 0, 2: None, 3: None, 4: None}
    assert packing.pack_documents(documents(spark, []), scratch(spark)).count() == 0


# --- 2 ---


def test_topk(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)).astype("f4")
    x[50:150] = x[50]  # a third are copies: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, []), (904, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, e array<float>").select("id", topk.integer_components(F.col("e")).alias("v")).repartition(3)
    found = {}
    for r in topk.search(df, df.where("id % 20 = 0"), scratch(spark), k=7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: np.floor(64 * np.array(v, "f8")).astype(int).tolist() for i, v in rows if v is not None and None not in v and all(np.isfinite(v))}
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:7]
        assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk.search(df.limit(0), df, scratch(spark)).count() == 0 and topk.search(df, df.limit(0), scratch(spark)).count() == 0


def test_topk_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 0.0])], "id long, e array<double>").select("id", topk.integer_components(F.col("e"), 1).alias("v"))
    rows = {r["vec_id"]: r["score"] for r in topk.search(df, df.where("id = 0"), scratch(spark), k=2).collect()}
    assert rows == {1: 2**63 - 1, 2: -(2**63)}


# --- 3 ---


def test_quality(spark):
    texts, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        texts.append(" ".join(words(i, 60)) if good else " ".join(w.upper() + "!!" for w in words(i, 60)) if i % 2 else (words(i, 1)[0] + " ") * 80)
        labels.append((i, int(good), 0))
    docs = documents(spark, texts + ODD).repartition(4)
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.score(docs, known, scratch(spark)).collect()}
    assert len(rows) == len(texts) + len(ODD)
    held = [r for i, r in rows.items() if i < 400 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and len(held) == sum(r["held_out"] for i, r in rows.items() if i < 400)
    assert np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    kept = quality.keep_good(docs, known, scratch(spark))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["predicted"]}
    none = quality.score(docs, known.limit(0), scratch(spark)).collect()
    assert len(none) == len(rows) and all(abs(r["score"] - 0.5) < 0.01 for r in none)
    assert quality.score(docs.limit(0), known, scratch(spark)).count() == 0


def test_quality_against_a_direct_solution(spark, monkeypatch):
    """The weights that summed normal equations give, in a tree of many levels, are those of plain ridge regression on all rows at once; calibration is isotonic."""
    monkeypatch.setattr(quality, "FAN_IN", 2)
    r = random.Random(6)
    texts = [" ".join(words(i, r.randrange(5, 60))) + ("!!!" * r.randrange(9) if i % 3 else "") for i in range(240)]
    docs = documents(spark, texts).repartition(7)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(quality.with_statistics(docs), labels, scratch(spark))
    learned = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 != 2]
    x = np.array([quality.statistics(texts[i]) for i in learned])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, x.std(0) + 1e-6, atol=2e-6)
    fits = np.array([zlib.crc32(str(i).encode()) // 4 % 4 != 3 for i in learned])
    f, y = model.features(x[fits]), np.array([float(i % 3 == 0) for i in learned])
    lam = quality.RIDGE * max(1.0, fits.sum()) / f.shape[1]
    direct = np.linalg.lstsq(np.vstack([f, np.sqrt(lam) * np.eye(f.shape[1])]), np.concatenate([y[fits], np.zeros(f.shape[1])]), rcond=None)[0]
    assert np.allclose(f @ model.weights, f @ direct, atol=1e-4)
    assert (np.diff(model.level) >= 0).all()
    raw, own = model.raw(x[~fits]), y[~fits]
    assert abs(np.interp(raw, model.at, model.level).mean() - own.mean()) < 0.05


def test_pool():
    assert quality.pool(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == [0.1, 0.4, 0.4, 0.9]


# --- 4 ---


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ü x", "same"), (2, "u", "same"), (3, None, None), (5, "u", ""), (4, "u", "ünï\r\n\r\nx"), (6, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    s = scratch(spark)
    archives = warc.write_archives(df, s)
    found = {r["page_id"]: r for r in warc.read_records(warc.list_records(archives)).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in found.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 3: ("revisit", 5), 5: ("response", None), 4: ("response", None), 6: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (found[i]["payload_bytes"], found[i]["payload_digest"]) == (len(raw), warc.payload_digest(raw))
        assert found[i]["payload"] is None if found[i]["record_type"] == "revisit" else bytes(found[i]["payload"]) == raw
    assert {r["record_type"] for r in warc.round_trip(df, scratch(spark), least=10**6).collect()} == {"response"}
    assert warc.round_trip(df.limit(0), scratch(spark)).count() == 0


def test_zip_directories():
    data = warc.zip_stored([("a", b"hello"), ("b", b"")])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("a") == b"hello"
    members = warc.zip_members(pa.BufferReader(data))
    assert members["a"][1] == 5 and data[members["a"][0] :][:5] == b"hello"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("packed", b"x" * 999, zipfile.ZIP_DEFLATED)
        with z.open("stored", "w", force_zip64=True) as f:
            f.write(b"content")
        z.comment = b"PK\5\6 in a comment"
    raw = out.getvalue()
    members = warc.zip_members(pa.BufferReader(raw))
    assert list(members) == ["stored"] and raw[members["stored"][0] :][:7] == b"content"
    with pytest.raises(ValueError):
        warc.zip_members(pa.BufferReader(b"nothing"))


# --- 5 ---


def test_chat(spark):
    nasty = ["", "\\### Assistant: </turn> ok", "\\b\\l#<", ":\n", "a:\n\\c\nb", "</turn>\n### user:\nx", "日本 \\", None]
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate([("user", nasty[c]), ("assistant", nasty[c + 2]), ("assistant", nasty[c + 4]), ("we:\nird", nasty[-1])])]
    df = spark.createDataFrame(rows + [(3, None, None, "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chat(chat.gather_turns(df.repartition(3)))).collect()}
    for c in (1, 2):
        said = "".join(f"{r}\n{x or ''}\n" for i, _, r, x in rows if i == c)
        loss = "".join(x or "" for i, _, r, x in rows if i == c and r == "assistant")
        assert (found[c]["n_turns"], found[c]["turns_sha256"]) == (4, hashlib.sha256(said.encode()).hexdigest())
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (found[3]["n_turns"], found[3]["loss_chars"]) == (3, 2)
    one = chat.format_chat(chat.gather_turns(df)).select(chat.formatted_text().alias("t"), chat.loss_spans().alias("s"), "parts").first()
    assert [one["t"][s["start"] : s["end"]] for s in one["s"]] == [p["text"] for p in one["parts"] if p["loss"]]
    assert chat.chat_digest(chat.format_chat(chat.gather_turns(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    records = [{"prompt": "a", "completion": "b"}, {"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]}, {"instruction": "i", "input": "", "output": "o"}, {"conversations": [{"from": "human", "value": "q"}]}, {"other": 1}]
    df = spark.createDataFrame([*((i, json.dumps(r)) for i, r in enumerate(records)), (5, "not json"), (6, None)], "conv_id long, record string")
    found = {r["conv_id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.chat_turns(df).collect()}
    assert found == {0: ("prompt", [("user", "a"), ("assistant", "b")]), 1: ("messages", [("user", "x"), ("assistant", "y")]), 2: ("instruction", [("user", "i"), ("assistant", "o")]), 3: ("shared", [("user", "q")]), 4: (None, None), 5: (None, None), 6: (None, None)}
    table = spark.createDataFrame([(1, "q", None)], "conv_id long, question string, answer string")
    assert [tuple(t) for t in chat.turns_of_layout(table).first()["turns"]] == [("user", "q"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat.turns_of_layout(spark.range(1))


def test_chat_records_with_optional_and_further_fields(spark):
    wanted = [
        ({"system": None, "prompt": "a", "response": "b"}, "prompt_response", [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "response": "b", "id": 7}, "prompt_response", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": None, "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"messages": []}, "messages", []),
        ({"messages": [{"role": "user", "content": "x", "name": "n"}, {"content": "y"}], "the key": 1, "layout": "z"}, "messages", [("user", "x"), ("user", "y")]),
        ({"prompt": "a", "completion": None}, "prompt", [("user", "a"), ("assistant", "")]),
        ({"prompt": "a"}, None, None),
        ([1, 2], None, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(wanted)], "prompt long, record string")
    found = {r["prompt"]: (r["layout"], r["turns"] if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in chat.chat_turns(df, "prompt").collect()}
    assert found == {i: (layout, turns) for i, (_, layout, turns) in enumerate(wanted)}


def test_chat_rows_go_by_fingerprint(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    assert chat.gather_turns(df).first()["layout"] == "rows"
    monkeypatch.setattr(chat, "REGISTRY", {})
    with pytest.raises(ValueError):
        chat.gather_turns(df)


# --- 6 ---


def test_mixing(spark):
    sources = [["b", "a", None, "c", "d"][min(4, i % 7)] for i in range(500)]
    texts = [" ".join(words(i, 1 + i % 40)) for i in range(500)]
    docs = documents(spark, texts + ODD, sources + ["a"] * len(ODD)).repartition(4)
    rows = mixing.mix(docs, scratch(spark)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(2), scratch(spark)).collect())
    size = {r["doc_id"]: r["size"] for r in rows}
    assert size == {i: len((t or "").encode().split()) for i, t in enumerate(texts + ODD)}
    by = {}
    for i, s in enumerate(sources + ["a"] * len(ODD)):
        by.setdefault(s, []).append(i)
    names = sorted(s for s in by if s) + [None]
    total = {s: sum(size[i] for i in by[s]) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(total.values()), {}, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    copies = {r["doc_id"]: r["copies"] for r in rows}
    for s in names:
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in rows if r["doc_id"] in by[s])
        assert abs(sum(copies[i] * size[i] for i in by[s]) - target[s]) <= max(size[i] for i in by[s]) / 2 + 1e-6
    assert set(copies.values()) <= {0, 1, 2}
    mixed = mixing.mixed_documents(docs, scratch(spark))
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert mixing.mix(docs.limit(0), scratch(spark)).count() == 0 and mixing.mix(documents(spark, [None, ""]), scratch(spark)).count() == 2


def test_mixing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 30 + [(None, "a b", "s")] * 10, "doc_id long, text string, source string")
    assert mixing.mix(df, scratch(spark)).count() == 40
    assert 55 <= mixing.mixed_documents(df, scratch(spark)).count() <= 65


# --- 7 ---


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(2)
    for _ in range(500):
        a, b = ("".join(r.choice("abé") for _ in range(r.randrange(14))) for _ in range(2))
        assert lines.edit_distance(a, b) == slow(a, b)


def test_bounded_distances(monkeypatch):
    """Distances up to a bound, in windows and many at once, are those without a bound; beyond it they exceed it."""
    monkeypatch.setattr(lines, "WINDOWED", 10)
    monkeypatch.setattr(lines, "STEP", 7)
    r = random.Random(6)
    for size in (5, 64, 65, 200, 700):
        texts, most = [], []
        for _ in range(25):
            a = [r.randrange(5) for _ in range(r.randint(1 + size // 2, size + size // 3))]
            b = [x if r.random() > 0.2 else r.randrange(5) for x in a if r.random() > 0.1]
            b = b[r.randrange(1 + size // 9) :] + [r.randrange(5)]
            a, b = sorted((a, b), key=len)
            if len(b) - len(a) <= len(b) // 4:
                texts.append((a, b))
                most.append(len(b) // 4)
        codes = [np.array(x, np.uint8) for pair in texts for x in pair]
        at = np.arange(0, len(codes), 2)
        many = lines._distances(codes, at, at + 1, np.array(most), 5)
        for (a, b), bound, found in zip(texts, most, many.tolist()):
            a, b = ("".join("abcde"[x] for x in t) for t in (a, b))
            true, one = lines.edit_distance(a, b), lines.edit_distance(a, b, bound)
            assert (found == one == true) if true <= bound else (found > bound and one > bound)


def kept_by_brute_force(rows, least=0.75):
    """The (doc_id, text) rows' lines that stay: every pair of distinct normalised lines is compared by edit similarity alone."""
    first, where = {}, {}
    for doc, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        for no, line in enumerate((text or "").lower().split("\n")):
            if line := " ".join(line.split()):
                where[doc, text, no] = line
                first.setdefault(line, (doc, text, no))
    known = list(first)
    edges = [(i, i) for i in range(len(known))]
    for i, a in enumerate(known):
        for j in range(i):
            longest = max(len(a), len(known[j]))
            if min(len(a), len(known[j])) >= least * longest and longest - lines.edit_distance(a, known[j], (1 - least) * longest + 1) >= least * longest:
                edges.append((j, i))
    stay = {}
    for i, g in roots(edges).items():
        stay.setdefault(g, known[i])  # known is in order of first occurrence, and i counts on
    stay = {first[x] for x in stay.values()}
    return {(doc, text): None if text is None else "\n".join(x for no, x in enumerate(text.split("\n")) if (doc, text, no) not in where or (doc, text, no) in stay) for doc, text in rows}


@pytest.mark.parametrize("most", [4096, 5])
def test_line_dedup(spark, most):
    r = random.Random(4)
    base = [" ".join(words(i, r.randrange(3, 60))) for i in range(40)]
    texts = []
    for i in range(120):
        own = []
        for _ in range(4):
            line = r.choice(base).split()
            for _ in range(r.randrange(1 + len(line) // 6)):
                line[r.randrange(len(line))] = r.choice(WORDS)
            own.append(" ".join(line))
        texts.append("\n".join([*own, "", "Common  LINE here 7"]))
    texts += [None, "", " \n ", "single"]
    docs = documents(spark, texts).repartition(3)
    rows = {r["doc_id"]: r for r in lines.deduplicated(docs, scratch(spark), most=most).collect()}
    want = kept_by_brute_force(list(enumerate(texts)))
    for i, t in enumerate(texts):
        assert rows[i]["text"] == want[i, t], i
        assert rows[i]["n_chars"] == (None if t is None else len(want[i, t]))
    kept = lines.deduplicated_documents(docs, scratch(spark), most=most)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.where("doc_id >= 120").collect()} == {120, 121, 122, 123}
    assert lines.deduplicated(docs.limit(0), scratch(spark)).count() == 0


def test_line_dedup_odd_rows(spark):
    """Clashing column names, null and repeated ids, repeated rows, a very long text, digits that differ."""
    long_ = "\n".join(" ".join(words(i, 12)) for i in range(3000))
    rows = [(3, "one line here", 1), (3, "one line here", 1), (3, "another one of 3", 2), (None, "one line here\nnull has it", 3), (None, None, 4), (1, long_, 5), (2, "2019 1876 44\n3581 9203 17", 6)]
    kind = "doc_id long, text string, n_removed int, N_LINES int, nos int, h int, doc int, lines int, `0` int, kind int"
    docs = spark.createDataFrame([(d, t, *[x] * 8) for d, t, x in rows], kind)
    found = lines.deduplicated(docs, scratch(spark))
    assert found.columns == [*docs.columns, "n_lines_", "n_removed_"]
    got = {(x["n_removed"], x["text"]) for x in found.collect()}
    assert got == {(1, "one line here"), (2, "another one of 3"), (3, "null has it"), (4, None), (5, long_), (6, "2019 1876 44\n3581 9203 17")}
    assert found.count() == 7 and lines.deduplicated_documents(docs, scratch(spark)).count() == 7


def test_line_recall():
    """Copies with up to a quarter of their words changed share a key and pass the bound on bits, nearly always."""
    r = random.Random(12)
    for n in (6, 10, 16, 30, 60, 150):
        found = total = 0
        for i in range(300):
            a = words((n, i).__hash__(), n)
            b = list(a)
            for at in r.sample(range(n), r.randrange(1, n // 4 + 1)):
                b[at] = r.choice(WORDS) + str(r.randrange(30))
            a, b = " ".join(a), " ".join(b)
            if a != b and lines.similar(a, b, 0.75):
                p = lines._Parsed([a.encode(), b.encode()], 0.75)
                keys = [set(p.keys[p.owner == x].tolist()) for x in (0, 1)]
                total += 1
                found += bool(keys[0] & keys[1]) and bool(lines._Lines([a, b], 0.75).likely(np.array([0]), np.array([1]))[0])
        assert total > 100 and found >= 0.9 * total, (n, found, total)


def test_sets_of_words_spare_simhashes():
    """Pairs of which at most 0.6 of the words stand in one line only stay possible; most that share two words go, before any SimHash is made."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 9)))
    for n in (8, 12, 30, 100):
        texts = []
        for _ in range(100):
            a = [word() for _ in range(n)]
            near, far = list(a), [word() for _ in range(n)]
            for k in r.sample(range(n), int(0.6 * n)):
                near[k] = near[k][:-1] + "0"
            far[:2] = a[:2]
            texts += [" ".join(x) for x in (a, near, far)]
        held = lines._Lines(texts, 0.0)
        at = np.arange(0, 300, 3)
        assert held.possible(at, at + 1).all()
        assert n == 100 or held.possible(at, at + 2).mean() < 0.4
        assert not held.summed.any()
        held.bits(at[:1], at[:1] + 1)
        assert held.summed.sum() == 2
    whole = lines._Lines(texts, 0.0)
    assert (whole.bits(at, at + 1)[::-1] == held.bits(at[::-1], at[::-1] + 1)).all()


def test_memory_of_verification(monkeypatch):
    """Words, sets, SimHashes and codes of lines are made in portions, with the same results: less than ten bytes a letter at the peak."""
    r = random.Random(20)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randrange(2, 9))) for _ in range(5000)]
    texts = [" ".join(r.choices(words, k=r.choice((1, 7, 8, 60, 200)))) for _ in range(8000)] + [" ".join(r.choices(words, k=60_000))]
    at = np.arange(len(texts) - 1)
    tracemalloc.start()
    held = lines._Lines(texts, 0.75)
    bits = held.bits(at, at + 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * sum(map(len, texts)), peak / sum(map(len, texts))
    monkeypatch.setattr(lines, "PARSED", 1 << 30)
    monkeypatch.setattr(lines, "WORDS", 1 << 30)
    whole = lines._Lines(texts, 0.75)
    assert (bits == whole.bits(at, at + 1)).all() and (held.sets == whole.sets).all() and (held.words == whole.words).all() and (held.hashes == whole.hashes).all()
    assert held.letters == whole.letters and all((x == y).all() for x, y in zip(held.codes, whole.codes, strict=True))


def test_sizes_of_wanted_lines():
    """Tasks of verification follow the bytes of lines too."""
    kind = pa.list_(pa.struct([("no", pa.int32()), ("name", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["É  b\nc"]), pa.array([[{"no": 0, "name": 5}, {"no": 1, "name": 6}]], kind)], ["text", "wanted"])
    assert pa.Table.from_batches(lines._wanted(iter([batch]))).to_pylist() == [{"name": 5, "line": "é b", "size": 4}, {"name": 6, "line": "c", "size": 1}]


def test_verification_gives_memory_back(monkeypatch):
    """Chunks of a task's lines are read one by one; what is freed goes back before pairs are compared and at the end."""
    given = []
    monkeypatch.setattr(lines, "_trim", given.append)
    texts = ["one two three four", "one two three for", "something else here", "something else hero", "one two three fou"]
    rows = [pa.table({"g": [g], "name": [i], "line": [texts[i]], "side": pa.array([0], pa.int32())}) for g, i in [(1, 4), (2, 3), (1, 0), (2, 2), (1, 1), (3, 4), (3, 2)]]
    found = lines._linked(0.75)(pa.concat_tables(rows))
    assert roots(zip(found["a"].to_pylist(), found["b"].to_pylist())) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 0}
    assert len(given) == 2


def test_leaders_of_keys(monkeypatch):
    """Each key's names meet at the least, the first fold's where a part is folded often; most keys are of one name."""
    r = random.Random(18)
    rows = [(r.randrange(3000) if r.random() < 0.9 else 7, r.randrange(-500, 500)) for _ in range(3000)]
    blobs = []
    for k in range(0, 3000, 100):
        some = np.zeros(100, lines._KEY)
        keys = np.array([x for x, _ in rows[k : k + 100]], "<u8")
        some["key"], some["name"] = keys.view(np.uint8).reshape(-1, 8)[:, :5], [x for _, x in rows[k : k + 100]]
        blobs.append(some.tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 30, pa.int32()), pa.array([1] * 30, pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "data"])
    names = sorted({x for _, x in rows})
    want = roots([(names.index(x), names.index(x)) for _, x in rows] + [(names.index(x), names.index(y)) for k, x in rows for y in [min(n for q, n in rows if q == k)]])
    for limit in (1 << 21, 250):
        monkeypatch.setattr(lines, "LIMIT", limit)
        met = [x for b in lines._met(iter([batch])) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        assert roots([(i, i) for i in range(len(names))] + [(names.index(a), names.index(b)) for a, b in met]) == want
        if limit > 3000:
            assert set(met) == {(m, x) for k in {k for k, _ in rows} for own in [{n for q, n in rows if q == k}] if len(own) > 1 for m in [min(own)] for x in own}


def test_memory_of_hot_key():
    """A part that holds a key 4 million times is folded in pieces, and the lines of documents leave in small batches."""
    blob = np.zeros(100_000, lines._KEY)
    blob["name"] = np.arange(100_000) % 5000
    n = 40
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([blob.tobytes()] * n, pa.binary())], ["part", "kind", "data"])
    tracemalloc.start()
    try:
        found = {x for b in lines._met(iter([batch])) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == {(0, x) for x in range(5000)}
    assert peak < 150e6, peak
    kind = pa.list_(pa.struct([("no", pa.int32()), ("name", pa.int64())]))
    texts = [f"A  {i}\nb\n C {i}" for i in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([[{"no": 2, "name": 2 * i}, {"no": 0, "name": 2 * i + 1}][: i % 3] for i in range(2500)], kind)], ["text", "wanted"])
    got = list(lines._wanted(iter([batch.slice(1)])))
    assert [x for b in got for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())] == [x for i in range(1, 2500) for x in [(2 * i, f"c {i}"), (2 * i + 1, f"a {i}")][: i % 3]]
    assert len(got) == 3


def test_distances_of_many_lines():
    r = random.Random(3)
    texts = []
    for _ in range(150):
        t = [r.choice("abcdeé ") for _ in range(r.choice([1, 2, 5, 30, 63, 64, 65, 128, 200]))]
        texts.append("".join(t))
        for _ in range(r.randrange(len(t))):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randrange(2)] = r.choice(["", "a", "b"])
        texts.append("".join(t) or "x")
    held = lines._Lines(texts, 0.75)
    pairs = sorted({tuple(sorted((r.randrange(300), r.choice((0, 1)) * 150 + r.randrange(150)), key=lambda x: (len(texts[x]), x))) for _ in range(2000)} | {tuple(sorted((2 * i, 2 * i + 1), key=lambda x: len(texts[x]))) for i in range(150)})
    a, b = np.array(pairs).T
    most = np.floor(0.25 * held.size[b]).astype(np.int64)
    for (i, j), d, m in zip(pairs, lines._distances(held.codes, a, b, most, held.letters), most):
        true = lines.edit_distance(texts[i], texts[j])
        assert d == true if true <= m else d > m


@pytest.mark.parametrize("most", [4096, 5])
def test_line_dedup_query_finds_similar_lines(spark, tmp_path, monkeypatch, most):
    """Against plain edit similarity, without keys or bits: one changed word or letter, in lines of 1 to 40 words."""
    monkeypatch.setattr(lines.removed_lines, "__defaults__", (*lines.removed_lines.__defaults__[:-1], most))
    r = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyzé"
    word = lambda: "".join(r.choice(alphabet) for _ in range(r.randrange(2, 9)))
    texts = []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 20, 40):
        for _ in range(8):
            line = [word() for _ in range(n)]
            other, typo = list(line), list(line)
            other[r.randrange(n)] = word()
            at = r.randrange(n)
            typo[at] = typo[at][:1] + r.choice(alphabet) + typo[at][2:]
            texts += [" ".join(line), " ".join(other), " ".join(typo)]
    texts = list(dict.fromkeys(texts))
    documents(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    group = roots([(i, i) for i in range(len(texts))] + [(i, j) for i in range(len(texts)) for j in range(i) if lines.similar(texts[i], texts[j], 0.75)])
    rows = queries.QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in rows if x["n_removed"] == 0} == set(group.values())
    assert len(set(group.values())) < 0.6 * len(texts)


def test_work_on_lines_that_share_a_passage(monkeypatch):
    """Bands shrink with the distance so far, and pairs that can't reach the bound leave early: far less than all words of all columns."""
    r = random.Random(11)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = letters(300)
    texts = [letters(200 + i) + passage + letters(150) for i in range(60)]
    held = lines._Lines(texts, 0.75)
    a, b = np.array([(j, i) for i in range(60) for j in range(i)]).T
    most = np.floor(0.25 * held.size[b]).astype(np.int64)
    done = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def invert(self, x, out):
            done.append(x.size)
            return np.invert(x, out=out)

    monkeypatch.setattr(lines, "np", Counting())
    found = lines._distances(held.codes, a, b, most, held.letters)
    monkeypatch.undo()
    for i, j, d, m in zip(a[::9].tolist(), b[::9].tolist(), found[::9], most[::9]):
        true = lines.edit_distance(texts[i], texts[j])
        assert d == true if true <= m else d > m
    assert sum(done) / 2 < 0.22 * (-(-held.size[a] // 64) * held.size[b]).sum()


def test_line_groups_in_cells(spark, monkeypatch):
    """Parts of a large group meet in pairs, which together hold each pair of its lines once."""
    monkeypatch.setattr(lines, "CELL", 3)
    whole = [(1, i, 20, 0) for i in range(20)] + [(2, i, 3, 0) for i in range(3)]
    sides = [(3, i, 8, 1 + i % 2) for i in range(16)]
    rows = [tuple(x) for x in lines._cells(spark.createDataFrame(whole + sides, "g long, id long, size long, side int")).collect()]
    pairs = Counter((x, y) for g, x, a in rows for h, y, b in rows if g == h and x < y and (a == 0 or a != b))
    want = Counter((x[1], y[1]) for x in whole for y in whole if x[0] == y[0] and x[1] < y[1])
    want.update((x[1], y[1]) for x in sides for y in sides if x[1] < y[1] and x[3] != y[3])
    assert pairs == want and max(Counter(g for g, _, _ in rows).values()) < 20


@pytest.mark.parametrize("most", [4096, 7])
def test_line_dedup_in_cells(spark, monkeypatch, most):
    r = random.Random(12)
    base = words(5, 30)
    texts = list(dict.fromkeys(" ".join(r.choice(WORDS) if r.random() < share else w for w in base) for share in (0.02, 0.1, 0.2, 0.3) for _ in range(12)))
    found = []
    for cell in (1024, 3):
        monkeypatch.setattr(lines, "CELL", cell)
        found.append({x["doc_id"]: x["n_removed"] for x in lines.deduplicated(documents(spark, texts), scratch(spark), most=most).collect()})
    assert found[0] == found[1] and 0 < sum(found[0].values()) < len(texts) - 1


def test_segments_of_short_lines():
    r = random.Random(9)
    for _ in range(3000):
        a = "".join(r.choice("abc ") for _ in range(r.randrange(1, 24)))
        b = list(a)
        for _ in range(r.randrange(7)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "a", "b", "c"])
        b = "".join(b)[: lines.SHORT]
        if b and lines.similar(a, b, 0.75):
            assert set(lines._segments(a, 0.75)) & set(lines._segments(b, 0.75)), (a, b)


# --- 8 ---


def brute_substrings(texts, span):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + span]) for w in split for i in range(len(w) - span + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - span + 1) if seen[tuple(w[i : i + span])] > 1 for j in range(i, i + span)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize(("span", "gram", "batches"), [(35, 12, 2), (8, 3, 3), (5, 5, 1)])
def test_substring_dedup(spark, span, gram, batches):
    passage = words("p", 60)
    texts = [" ".join(words(i, 50) + (passage[i % 5 :] if i % 3 == 0 else []) + words(-i, 20)) for i in range(40)]
    texts += [texts[1], texts[1], "the " * 100, "a b " * 60, " ".join(passage + ["x"] + passage), *ODD]
    rows = substrings.deduplicated(documents(spark, texts).repartition(4), scratch(spark), span, gram, batches)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in rows.collect()} == dict(enumerate(brute_substrings(texts, span)))


def test_substring_repeated_rows(spark):
    text = " ".join(words(1, 40))
    df = spark.createDataFrame([(1, text), (1, text), (None, None), (None, "x")], "doc_id long, text string")
    assert sorted((r["n_words"], r["n_removed"]) for r in substrings.deduplicated(df, scratch(spark)).collect()) == [(0, 0), (1, 0), (40, 40), (40, 40)]
    assert substrings.deduplicated(df.limit(0), scratch(spark)).count() == 0


def test_index_runs(spark):
    s = scratch(spark)
    index = substrings.FingerprintIndex(s, most=2)
    batch = lambda *x: spark.createDataFrame([(i,) for i in x], "mh long")
    for part in ((1, 2, 2), (2, 3), (1, 4), (4, 5)):
        index.add(batch(*part))
    assert len(index.runs) <= 3
    assert sorted(r["mh"] for r in index.seen(batch(1, 3, 4, 9), 2).collect()) == [1, 4]
    assert sorted(r["mh"] for r in index.seen(batch(1, 3, 9)).collect()) == [1, 3]


# --- 9 ---


@pytest.mark.parametrize("block", [512, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 16))
    for i in range(40, 100):
        x[i] = x[i % 3] * 2 + rng.normal(size=16) * 0.25
    x[100:110] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [1.0, None]), (203, [float("inf")] * 16), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (None, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {r["vec_id"]: r for r in embeddings.near_dedup(df, scratch(spark), passes=32, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    group = roots([(i, i) for i in range(120)] + list(zip(*(k.tolist() for k in np.nonzero(near)))))
    for i in range(120):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (near[i].sum(), group[i], group[i] == i)
    assert (found[206]["n_links"], found[206]["component_id"]) == (1, 205)
    for i in (200, 201, 202, 203, 204, None):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert embeddings.near_dedup(df.limit(0), scratch(spark)).count() == 0


# --- 10 ---


def brute_jaccard(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(jaccard._LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    edges = [(i, i) for i in range(len(sets))]
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                edges.append((i, j))
    group = roots(edges)
    return {i: (len(s), group[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("most", [4096, 5])
def test_jaccard(spark, most):
    r = random.Random(7)
    texts = []
    for i in range(150):
        w = words(i % 12, 40 + 20 * (i % 12))
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    texts += [texts[0].upper(), texts[3], "a b", "A  b", "b a", " ".join(words("long", 4000)), " ".join(words("long", 4000)[:3500]), *ODD]
    docs = documents(spark, texts).repartition(4)
    rows = jaccard.jaccard_components(docs, scratch(spark), most=most)
    want = brute_jaccard(texts)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows.collect()} == want
    kept = jaccard.keep_one(docs, scratch(spark))
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [i for i, (_, c) in want.items() if i == c]
    assert jaccard.jaccard_components(docs.limit(0), scratch(spark)).count() == 0


def test_jaccard_odd_rows(spark):
    text = " ".join(words(1, 30))
    df = spark.createDataFrame([(5, text), (5, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    assert sorted((x["doc_id"] or -1, x["n_shingles"], x["component_id"] or -1) for x in jaccard.jaccard_components(df, scratch(spark)).collect()) == [(-1, 0, -1), (-1, 26, -1), (2, 26, 2), (5, 26, 2), (5, 26, 2)]


# --- the whole ---


def test_jaccard_repeated_ids(spark):
    """A doc_id with several texts holds the links of all of them, in whatever order the rows come."""
    a, other, alone = " ".join(words(1, 60)), " ".join(words(2, 60)), " ".join(words(3, 60))
    rows = [(1, a), (2, a + " more"), (2, other), (3, other + " x"), (4, alone), (4, None), (5, alone), (None, a), (6, a), (6, a)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(d, t, 1, 2) for d, t in order], "doc_id long, text string, component_id int, n int").repartition(2)
        found = jaccard.jaccard_components(docs, scratch(spark)).collect()
        assert len(found) == 10 and {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 1), (None, None)}
        assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(docs, scratch(spark)).collect()) == ["1", "4", "4", "None"]


def test_clashing_names(spark):
    """Columns that operators might use for themselves keep their names and values; null and repeated rows stay whole."""
    more = ["_n", "_row", "_d", "_k", "_s", "_c", "_key", "_size", "_again", "key", "size", "copies", "row", "h"]
    rows = [(i, " ".join(words(i, 20 + i)), "en", "ab"[i % 2], *[100 + i] * len(more)) for i in range(30)]
    rows += [(None, None, None, None, *[7] * len(more)), (3, rows[3][1], "en", "b", *[103] * len(more))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in more))
    mixed = mixing.mixed_documents(docs, scratch(spark))
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert tuple(r) in rows
    pieces = scratch(spark).save(spark.createDataFrame([(1, 5, 9, 8, 7, 6), (2, 3, 9, 8, 7, 6), (None, None, 9, 8, 7, 6), (3, 99, 9, 8, 7, 6)], "doc_id long, length int, _task int, _rank int, sequence_id int, offset int"), "clash")
    packed = packing.pack(pieces, scratch(spark), 8, ("doc_id",))
    assert packed.columns == [*pieces.columns, "sequence_id_", "offset_"]
    assert {(r["doc_id"], r["_task"], r["sequence_id"], r["sequence_id_"], r["offset_"]) for r in packed.collect()} == {(1, 9, 7, 0, 0), (2, 9, 7, 0, 5), (None, 9, 7, None, None), (3, 9, 7, None, None)}


def test_pipeline_and_queries(spark):
    import __spark_entry__
    import corpus_pipeline

    names = list(__spark_entry__.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        docs = scratch(spark).save(out, name)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
