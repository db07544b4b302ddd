"""Chat formatting: records of many layouts become canonical turns and one escaped text with a loss mask. Native.

Schema fingerprinting: the nested field paths of a record are hashed, and the hash selects a declarative mapping.
Only DataFrame and SQL functions are used.

Defined cases: a null text is an empty text, a null role the role "user"; turns go by (turn, role, text), null turns
first, so ties and repeated rows are kept in a fixed order; an empty table gives no rows; other columns are ignored.
Optional fields may be missing or null and further fields do not matter. A layout without a mapping gives null turns
(`chat_turns`) or raises (`turns_of_layout`).
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks. An escaped text holds neither "#" nor "<", so no text can contain one.
OPEN, NAMED, CLOSE = "### ", ":\n", "</turn>\n"
#: Escapes, in the order in which escape() applies them; unescape() goes backwards.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":\n", "\\c\n"))
TURN = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


# --- layouts ---------------------------------------------------------------------------------------------------------


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with the types of their leaves, sorted; an array adds []."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [f"{at}:{kind.simpleString()}"]


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _mapped(field: str, role: str, text: str) -> Column:
    return F.transform(F.col(field), lambda m: F.struct(F.coalesce(m[role], F.lit("user")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _said(*pairs: tuple[str, Column]) -> Column:
    """Turns of the given texts, without the null ones."""
    return F.filter(F.array(*(F.when(text.isNotNull(), _turn(role, text)) for role, text in pairs)), lambda t: t.isNotNull())


def _instruction() -> Column:
    asked = F.when(F.length(F.coalesce(F.col("input"), F.lit(""))) > 0, F.concat(F.coalesce(F.col("instruction"), F.lit("")), F.lit("\n\n"), F.col("input"))).otherwise(F.col("instruction"))
    return F.array(_turn("user", asked), _turn("assistant", F.col("output")))


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def _renamed(turns: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair))
    return F.transform(turns, lambda t: F.struct(F.coalesce(names[t["role"]], t["role"]).alias("role"), t["text"].alias("text")))


#: Layouts: name, field paths, those of them that may be missing, and the expression that gives the turns.
LAYOUTS = {
    "messages": (["messages[].role:string", "messages[].content:string"], ["messages[].role:string", "messages[].content:string"], lambda: _mapped("messages", "role", "content")),
    "shared": (["conversations[].from:string", "conversations[].value:string"], ["conversations[].from:string", "conversations[].value:string"], lambda: _renamed(_mapped("conversations", "from", "value"))),
    "prompt": (["prompt:string", "completion:string"], [], lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("completion")))),
    "prompt_response": (["system:string", "prompt:string", "response:string"], ["system:string"], lambda: _said(("system", F.col("system")), ("user", F.coalesce(F.col("prompt"), F.lit(""))), ("assistant", F.coalesce(F.col("response"), F.lit(""))))),
    "instruction": (["instruction:string", "input:string", "output:string"], ["input:string"], _instruction),
    "question": (["question:string", "answer:string"], [], lambda: F.array(_turn("user", F.col("question")), _turn("assistant", F.col("answer")))),
    "rows": (["said[].turn:bigint", "said[].role:string", "said[].text:string"], [], lambda: _mapped("said", "role", "text")),
}


def _forms(name: str) -> list[list[str]]:
    """The sets of field paths that a layout's records may have: with and without each optional one. A list itself is never optional."""
    paths, optional, _ = LAYOUTS[name]
    needed = [p for p in paths if p not in optional] + sorted({f"{p.split('[]')[0]}[]" for p in paths if "[]" in p})
    return [sorted([*needed, *some]) for n in range(len(optional) + 1) for some in combinations(optional, n)]


#: The registry is keyed by fingerprint.
REGISTRY = {fingerprint(form): name for name in LAYOUTS for form in _forms(name)}
#: Field paths that some layout has. Others do not enter a fingerprint, so records may have any further fields.
KNOWN = sorted({p for name in LAYOUTS for form in _forms(name) for p in form})


def turns_of_layout(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, layout, turns): one row per record of a table whose columns, but for `key`, have one of the LAYOUTS."""
    paths = [p for f in df.schema.fields if f.name != key for p in field_paths(f.dataType, f.name)]
    found = fingerprint([p for p in {*paths, *(f"{p.split('[]')[0]}[]" for p in paths if "[]" in p)} if p in KNOWN])
    if found not in REGISTRY:
        raise ValueError(f"no layout has the fingerprint {found}: {df.schema.simpleString()}")
    name = REGISTRY[found]
    paths, _, turns = LAYOUTS[name]
    for f in _schema_of(paths).fields:  # optional ones that are missing
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(key, F.lit(name).alias("layout"), F.coalesce(turns(), F.array().cast(TURN)).cast(TURN).alias("turns"))


def _has(record: Column, path: str) -> Column:
    """Whether a variant holds the field, with a value or null; a field of list items, whether any item holds it."""
    head, listed, rest = path.split(":")[0].partition("[]")
    if not listed:
        return F.try_variant_get(record, f"$.{head}", "variant").isNotNull()
    items = F.try_variant_get(record, f"$.{head}", "array<variant>")
    return F.coalesce(F.exists(items, lambda x: F.try_variant_get(x, f"$.{rest[1:]}", "variant").isNotNull()), F.lit(False)) if rest else items.isNotNull()


def chat_turns(df: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """(key, fingerprint, layout, turns): records are JSON texts, each of its own layout.

    A record's fingerprint hashes those of its field paths that layouts know; fields that are null count as there, and further
    fields do not matter. Invalid JSON and unknown layouts give null turns.
    """
    held = df.select(F.col(key).alias("the key"), F.col(record).alias("record"), F.try_parse_json(F.col(record)).alias("v"))
    there = F.filter(F.array(*(F.when(_has(F.col("v"), p), F.lit(p)) for p in KNOWN)), lambda p: p.isNotNull())
    code = F.sha2(F.concat_ws("\n", there), 256).substr(1, 16)
    table = F.create_map(*(F.lit(x) for pair in REGISTRY.items() for x in pair))
    every = {f.name: f for paths, _, _ in LAYOUTS.values() for f in _schema_of(paths).fields}  # no two layouts disagree about a field
    named = held.select("the key", "record", code.alias("fingerprint")).withColumn("layout", table[F.col("fingerprint")])
    read = named.select("the key", "fingerprint", "layout", F.from_json("record", T.StructType(list(every.values()))).alias("r")).select("the key", "fingerprint", "layout", "r.*")
    turns = F.lit(None).cast(TURN)
    for name, (_, _, of) in LAYOUTS.items():
        turns = F.when(F.col("layout") == name, of().cast(TURN)).otherwise(turns)
    return read.select(F.col("the key").alias(key), "fingerprint", "layout", turns.alias("turns"))


def _schema_of(paths: list[str]) -> T.StructType:
    fields: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition("[].")
        if rest:
            fields.setdefault(head, []).append(rest.split(":")[0])
        else:
            fields[path.split(":")[0]] = []
    return T.StructType([T.StructField(n, T.ArrayType(T.StructType([T.StructField(x, T.LongType() if f"{n}[].{x}:bigint" in paths else T.StringType()) for x in inner])) if inner else T.StringType()) for n, inner in fields.items()])


def gather_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, layout, turns) of a table with one row per turn. A conversation is one training sample and becomes one record, whose fingerprint selects the layout."""
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns_of_layout(rows.groupBy(F.col(key).alias(key)).agg(F.array_sort(F.collect_list(one)).alias("said")), key)


# --- format and read back --------------------------------------------------------------------------------------------


def format_chat(chats: DataFrame, key: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """(key, parts): the formatted text in parts, each with its loss flag; the text is their concatenation.

    A turn is `### role:\\n`, the escaped text and `</turn>\\n`. Only the escaped text of a `trained` role carries loss.
    """
    def of(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(NAMED))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(t["text"]), t["role"] == trained), part(F.lit(CLOSE), F.lit(False)))

    return chats.select(key, F.flatten(F.transform("turns", of)).alias("parts"))


def formatted_text() -> Column:
    return F.concat_ws("", F.transform("parts", lambda p: p["text"]))


def loss_spans() -> Column:
    """[start, end) of each part under the loss mask, in code points of the formatted text."""
    kind = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["text"])
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans")).cast(kind)

    return F.aggregate("parts", start, step, lambda acc: acc["spans"])


def read_chat(text: Column) -> Column:
    """The turns of a formatted text."""
    blocks = F.filter(F.split(text, CLOSE, -1), lambda b: F.length(b) > 0)

    def back(b: Column) -> Column:
        role = F.substring_index(b, NAMED, 1)
        return F.struct(unescape(role.substr(F.lit(len(OPEN) + 1), F.length(role))).alias("role"), unescape(b.substr(F.length(role) + len(NAMED) + 1, F.length(b))).alias("text"))

    return F.transform(blocks, back)


def chat_digest(parts: DataFrame, key: str = "conv_id") -> DataFrame:
    """What is read back from the formatted output, as lengths and digests."""
    whole = parts.select(key, formatted_text().alias("formatted"), F.concat_ws("", F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: unescape(p["text"]))).alias("loss"))
    read = whole.select(key, "loss", F.length("formatted").cast("long").alias("formatted_chars"), read_chat(F.col("formatted")).alias("back"))
    said = F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(key, F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
