import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passages.llm import chat
from passages.llm.queries import QUERIES

RECORDS = [
    ({"prompt": "a", "response": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "output": None}, [("user", "a"), ("assistant", "")]),
    ({"output": "c", "instruction": "a", "input": "b"}, [("user", "a"), ("user", "b"), ("assistant", "c")]),
    ({"messages": [{"role": "user", "content": "[x"}, {"role": "human", "content": "<y"}]}, [("user", "[x"), ("human", "<y")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, []),
    ({"prompt": "[{\"role\": 1}]", "completion": "{}"}, [("user", "[{\"role\": 1}]"), ("assistant", "{}")]),
    ({"other": 1}, None),
    (None, None),
]


def test_layouts(spark):
    rows = [(k, json.dumps(r) if r is not None else None, "mine") for k, (r, _) in enumerate(RECORDS)]
    rows.append((99, "no json", "mine"))
    records = spark.createDataFrame(rows, "id int, record string, back string")
    out = chat.format_turns(chat.canonical_turns(records))
    got = {r.id: r for r in out.collect()}
    for k, (_, turns) in enumerate(RECORDS):
        assert (got[k].turns if turns is None else [tuple(t) for t in got[k].turns]) == turns
    assert got[99].turns is None and got[99].formatted is None and got[99].back == "mine"
    assert got[0].fingerprint != got[1].fingerprint and got[7].fingerprint not in {got[k].fingerprint for k in range(7)}
    same = spark.createDataFrame([('{"response": 1, "prompt": null}',), ('{"prompt": "x", "response": "y"}',)], "record string")
    assert chat.canonical_turns(same).select("fingerprint").distinct().count() == 1
    assert chat.canonical_turns(records.limit(0)).count() == 0


def test_texts_beyond_the_limit_of_json_parsers(spark):
    """20,000,001 characters, in every kind of layout."""
    long = F.repeat(F.lit("x"), 20_000_001)
    heads = ['{"prompt":"q","response":"', '{"messages":[{"role":"assistant","content":"', '{"conversations":[{"from":"gpt","value":"']
    ends = ['"}', '"}]}', '"}]}']
    rows = spark.createDataFrame([(k, h, e) for k, (h, e) in enumerate(zip(heads, ends))], "conv_id int, a string, b string")
    records = rows.select("conv_id", F.concat("a", long, "b").alias("record"))
    got = chat.chat_digests(chat.format_turns(chat.canonical_turns(records))).collect()
    assert [(r.n_turns, r.loss_chars) for r in sorted(got)] == [(2, 20_000_001), (1, 20_000_001), (1, 20_000_001)]
    turns = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "assistant")], "conv_id int, turn int, role string")
    records = chat.records_of_turns(turns.withColumn("text", long))
    got = chat.chat_digests(chat.format_turns(chat.canonical_turns(records))).collect()
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in got} == {1: (2, 20_000_001), 2: (1, 20_000_001)}
    small = spark.createDataFrame([(h + "x" + e,) for h, e in zip(heads, ends)], "record string")
    kinds = [chat.canonical_turns(t).select("fingerprint").distinct() for t in (small, rows.select(F.concat("a", long, "b").alias("record")))]
    assert kinds[0].exceptAll(kinds[1]).isEmpty() and kinds[0].count() == 3


def test_layouts_differ_by_what_is_nested(spark):
    rows = ['{"prompt": "x", "response": "y"}', '{"prompt": {"a": 1}, "response": "y"}', '{"prompt": ["x"], "response": "y"}']
    rows += ['{"messages": [{"role": "user", "content": "x", "name": "n"}]}', '{"messages": "text"}', '{"messages": ["text"]}', "[1]"]
    out = chat.canonical_turns(spark.createDataFrame([(r,) for r in rows], "record string"))
    assert [r.turns is None for r in out.collect()] == [False] + [True] * 6
    assert out.select("fingerprint").distinct().count() == 7


def test_columns_named_like_helpers_stay(spark):
    records = spark.createDataFrame([('{"messages": []}', "mine", "old")], "record string, written string, formatted string")
    row = chat.format_turns(chat.canonical_turns(records)).first()
    assert (row.written, row.formatted, row.turns, row.loss_spans) == ("mine", "", [], [])


PIECES = list("<[|]>\\/sINT é\n") + ["<|im_end|>", "<|im_sep|>", "</s>", "<\\"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


def test_reading_back(spark):
    examples = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a<|im_sep|>"]), TEXTS), max_size=5))
    def gather(turns):
        examples.append(turns)

    gather()
    chats = spark.createDataFrame([(k, t) for k, t in enumerate(examples)], f"conv_id int, turns {chat.TURNS}")
    out = chat.format_turns(chats)
    read = out.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("back"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    for r in read.collect():
        turns = examples[r.conv_id]
        assert [tuple(t) for t in r.back] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(turns) and "</s>" not in r.formatted


def test_conversations_by_turn(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 3, "assistant", "[")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    records = chat.records_of_turns(table)
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_turns(chat.canonical_turns(records))).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (2, digest("user\nq\nassistant\n\n"), 0)
    assert (got[2].n_turns, got[2].turns_sha256) == (2, digest("\nx\n\nx\n"))
    assert (got[None].loss_chars, got[None].loss_sha256) == (1, digest("["))


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op6_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
