"""Chat texts from records of different layouts, by schema fingerprint.

A record is a JSON text. The paths of its nested fields (names only, arrays as []) are hashed to a
fingerprint; the fingerprint selects a declared mapping, which says where the turns are. Turns are then written in one template:

    <|im_start|>role<|im_sep|>text<|im_end|>

No role or text can make a mark: in both, each `<` and `[` is followed by a backslash, which
reading back takes out again; so marks of other templates, such as </s> or [INST], are broken as well. The mask is a list of spans (start, length
in characters) of the assistant texts inside the formatted text.

Everything runs in built-in functions, row by row, without a shuffle.

Cases: a null role or text is empty; a record without turns gives an empty text; a record that is
no JSON or whose layout is not declared (a field more or less than a layout has) has a null `turns` and a null text, and keeps its
row; texts of any length are whole (a formatted text, and a record, must fit in one string); equal rows are formatted alike; an empty table
gives an empty table; other columns pass, those named like an output (fingerprint, turns, formatted, loss_spans) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template and the sign that breaks them inside texts.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BREAKERS = ("<", "[")
SIGN = "\\"

#: JSON texts are parsed whole: strings are as long as a column can hold.
WHOLE = {"maxStringLen": str(2**31 - 1)}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """`paths`: the field paths of such records; `turns`: (role, path) pairs, or `each`: the
    array, and the names of role and text in its elements."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None


#: The declared mappings.
LAYOUTS = (
    Layout(("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout(("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
    Layout(("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout(
        ("instruction", "input", "output"),
        turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout(
        ("system", "prompt", "response"),
        turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Layout(("messages", "messages[].content", "messages[].role"), each=("messages", "role", "content")),
    Layout(("conversations", "conversations[].from", "conversations[].value"), each=("conversations", "from", "value")),
    Layout(("messages",), each=("messages", "role", "content")),
    Layout(("conversations",), each=("conversations", "from", "value")),
)

# Other names of the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(record: Column) -> Column:
    """A hash of the nested field paths of a JSON object, whatever the values and however large they are.

    Paths are the names at the top; for names that a layout has, `name[]` for an array with `name[].field` for the
    fields of its elements, and `name.field` for those of an object. What is nested deeper counts as a value.
    """
    names = sorted({path.partition("[]")[0] for layout in LAYOUTS for path in layout.paths})

    def parsed(kind: str) -> Column:
        return F.from_json(record, ", ".join(f"`{name}` {kind}" for name in names), WHOLE)

    objects, lists, elements = parsed("map<string,string>"), parsed("array<string>"), parsed("array<map<string,string>>")
    none = F.array().cast("array<string>")

    def below(prefix: str, fields: Column) -> Column:
        return F.coalesce(F.transform(fields, lambda field: F.concat(F.lit(prefix), field)), none)

    paths = [F.coalesce(F.json_object_keys(record), none)]
    for name in names:
        paths += [
            below(f"{name}.", F.map_keys(objects[name])),
            F.when(lists[name].isNotNull(), F.array(F.lit(f"{name}[]"))).otherwise(none),
            below(f"{name}[].", F.flatten(F.transform(elements[name], F.map_keys))),
        ]
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.concat(*paths))), "\n"))


def _expected(layout: Layout) -> str:
    """The paths of a layout's records, as they are hashed."""
    own = {f"{layout.each[0]}[]"} if layout.each else set()
    return "\n".join(sorted({*layout.paths, *own}))


def _role(name: Column, field: str) -> Column:
    """Only the layout with `from` has names of its own."""
    known = [F.when(name == k, F.lit(v)) for k, v in ROLE_NAMES.items()] if field == "from" else []
    return F.coalesce(*known, name, F.lit(""))


def _mapped(layout: Layout, record: Column) -> Column:
    if layout.each:
        array, role, text = layout.each
        kind = f"struct<{array}:array<struct<`{role}`:string,`{text}`:string>>>"
        return F.transform(
            F.from_json(record, kind, WHOLE)[array],
            lambda t: F.struct(_role(t[role], role).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")),
        )
    kind = ",".join(f"`{path}` string" for path in dict.fromkeys(p for _, p in layout.turns))
    values = F.from_json(record, kind, WHOLE)
    return F.array(
        *(
            F.struct(F.lit(role).alias("role"), F.coalesce(values[path], F.lit("")).alias("text"))
            for role, path in layout.turns
        )
    )


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds fingerprint and turns; `turns` is null where no layout is declared."""
    found = records.withColumn("fingerprint", fingerprint(F.col(record)))
    chosen = F.coalesce(
        *(
            F.when(F.col("fingerprint") == F.xxhash64(F.lit(_expected(layout))), _mapped(layout, F.col(record)).cast(TURNS))
            for layout in LAYOUTS
        )
    )
    return found.withColumn("turns", chosen)


def escape(text: Column) -> Column:
    for mark in BREAKERS:
        text = F.replace(text, F.lit(mark), F.lit(mark + SIGN))
    return text


def unescape(text: Column) -> Column:
    for mark in BREAKERS:
        text = F.replace(text, F.lit(mark + SIGN), F.lit(mark))
    return text


def format_turns(chats: DataFrame) -> DataFrame:
    """Adds formatted and loss_spans from turns."""
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))
    pieces = F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END)))
    lengths = F.transform(
        "turns",
        lambda t: F.struct(
            t["role"].alias("role"),
            F.length(head(t)).cast("long").alias("head"),
            F.length(escape(t["text"])).cast("long").alias("body"),
        ),
    )
    kind = "struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    step = lambda acc, t: F.struct(
        (acc["at"] + t["head"] + t["body"] + len(END)).alias("at"),
        F.when(
            t["role"] == "assistant",
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length")))),
        )
        .otherwise(acc["spans"])
        .alias("spans"),
    )
    spans = F.aggregate(lengths, zero.cast(kind), step)["spans"]
    return chats.withColumns({"formatted": F.array_join(pieces, ""), "loss_spans": spans})


def read_turns(formatted: Column) -> Column:
    """The turns back from a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.split_part(body(p), F.lit(SEP), F.lit(1))).alias("role"),
            unescape(F.split_part(body(p), F.lit(SEP), F.lit(2))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )


def records_of_turns(rows: DataFrame) -> DataFrame:
    """conv_id and a JSON record from rows (conv_id, turn, role, text).

    A question with its answer is written as prompt and response, all else as messages. A conversation is
    one record, so its rows meet in one task, but never those of two conversations need to.
    """
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("turn"),
                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"),
            )
        )
    )
    chats = rows.groupBy("conv_id").agg(ordered.alias("t"))
    pair = (F.size("t") == 2) & (F.col("t")[0]["role"] == "user") & (F.col("t")[1]["role"] == "assistant")
    as_pair = F.to_json(F.struct(F.col("t")[0]["content"].alias("prompt"), F.col("t")[1]["content"].alias("response")))
    as_messages = F.to_json(
        F.struct(F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    )
    return chats.select("conv_id", F.when(pair, as_pair).otherwise(as_messages).alias("record"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted chats."""
    back = chats.withColumn("back", read_turns(F.col("formatted"))).withColumn(
        "loss", read_loss(F.col("formatted"), F.col("loss_spans"))
    )
    line = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
