"""Chat formatting: layouts nested to any depth, tables of mixed layouts, very long texts, many turns."""

import json

import pytest
from pyspark.sql import functions as F

from caretrail.llm import chat

#: A record of each layout and its canonical turns.
RECORDS = {
    "messages": ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, [("user", "hi"), ("assistant", "")]),
    "message-parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("user", "ab")]),
    "turns": ({"turns": [{"role": "assistant", "text": "x"}]}, [("assistant", "x")]),
    "conversations": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    "data-messages": ({"data": {"messages": [{"role": "user", "content": "x"}]}}, [("user", "x")]),
    "prompt": ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    "prompt-response": ({"prompt": '{"text":1}', "response": "[r]"}, [("user", '{"text":1}'), ("assistant", "[r]")]),
    "prompt-object": ({"prompt": {"text": "p"}, "response": {"text": "r"}}, [("user", "p"), ("assistant", "r")]),
    "data-prompt": ({"data": {"prompt": "p", "completion": "c"}}, [("user", "p"), ("assistant", "c")]),
    "question": ({"question": "q \n é \" '", "answer": 42}, [("user", "q \n é \" '"), ("assistant", "42")]),
    "instruction": ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    "instruction-input": ({"output": "o", "input": "x", "instruction": "i"}, [("user", "i\n\nx"), ("assistant", "o")]),
    "system-prompt": ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
}


def read(rows):
    return {r.layout: [tuple(t) for t in r.turns] for r in rows.select("layout", "turns").collect()}


def test_every_layout_as_json(spark):
    assert set(RECORDS) == {x["name"] for x in chat.LAYOUTS}
    plain = [(json.dumps(r),) for r, _ in RECORDS.values()]
    more = [(json.dumps({**r, "id": 7, "meta": {"a": [1]}}, ensure_ascii=False),) for r, _ in RECORDS.values()]
    want = {name: turns for name, (_, turns) in RECORDS.items()}
    assert read(chat.canonical_turns(spark.createDataFrame(plain, "record string"))) == want
    assert read(chat.canonical_turns(spark.createDataFrame(more, "record string"))) == want
    odd = [("[1]",), ('"x"',), ("{",), ('{"prompt":"p"}',), ('{"prompt":"p","completion":"c","stray":1}',), ('{"prompt":["p"],"completion":"c"}',), (None,), ("",)]
    assert read(chat.canonical_turns(spark.createDataFrame(odd, "record string"))) == {None: []}


@pytest.mark.parametrize("names", [["messages", "turns", "conversations", "prompt", "question", "instruction", "instruction-input", "prompt-response", "system-prompt"], ["message-parts", "prompt-object"], ["data-prompt"], ["data-messages"]])
def test_every_layout_in_one_table(spark, tmp_path, names):
    """A table with the fields of many layouts side by side, read as a reader of such files gives it."""
    (tmp_path / "mixed.json").write_text("\n".join(json.dumps(RECORDS[n][0]) for n in names))
    rows = spark.read.json(str(tmp_path / "mixed.json")).select(F.struct("*").alias("record"))
    assert read(chat.canonical_turns(rows)) == {n: RECORDS[n][1] for n in names}


def test_further_fields_and_mixed_contents(spark):
    """Turns with more fields, contents of texts, parts and numbers, parts that are no text; what is unknown is counted."""
    turn = lambda role, content, **more: {"role": role, "content": content, **more}
    calls = [{"id": 1, "function": {"name": "f", "args": {"text": [1], "role": {"a": {}}}}}]
    read_as = [
        ({"messages": [turn("user", "a", name="n", text="t"), turn("assistant", "b", tool_calls=calls)]}, "messages", ["a", "b"]),
        ({"messages": [turn("user", '["x"]'), turn("assistant", [{"type": "text", "text": "b"}, {"type": "image", "image": {"url": "u"}}, {"text": "c"}])]}, "messages", ['["x"]', "bc"]),
        ({"messages": [turn("user", ["x", {"text": "y"}]), turn("assistant", [])]}, "messages", ["xy", ""]),
        ({"messages": [turn("user", "x"), turn("assistant", 42), turn("user", None)]}, "messages", ["x", "42", ""]),
        ({"messages": [turn("user", [{"text": "y", "image": {"url": "u"}}], weight=1)]}, "message-parts", ["y"]),
        ({"data": {"messages": [turn("user", "x"), turn("user", ["y"])], "n": {"m": 1}}}, "data-messages", ["x", "y"]),
        ({"prompt": {"text": "p", "tokens": [1]}, "response": {"text": "r"}}, "prompt-object", ["p", "r"]),
        ({"conversations": [{"from": "human", "value": "q", "markdown": None}]}, "conversations", ["q"]),
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(read_as)], "i int, record string")
    got = {r.i: (r.layout, [t.text for t in r.turns]) for r in chat.canonical_turns(rows).select("row.i", "layout", "turns").collect()}
    assert got == {i: (layout, texts) for i, (_, layout, texts) in enumerate(read_as)}
    odd = ['{"stray":1}', '{"stray":2}', '{"prompt":"p","prompt":"q","completion":"c"}', "[1]", None, '{"prompt":"p","completion":"c"}']
    left = chat.unmatched(chat.canonical_turns(spark.createDataFrame([(x,) for x in odd], "record string")))
    assert {r.paths: r.n_records for r in left.collect()} == {"stray STRING": 2, None: 3}


def test_further_fields_in_a_table(spark):
    kind = "record struct<messages:array<struct<role:string,content:string,name:string>>,source:string>"
    rows = spark.createDataFrame([(([("user", "a", "n"), ("assistant", None, None)], "s"),), ((None, "s"),), (None,)], kind)
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(rows).collect()] == [("messages", [("user", "a"), ("assistant", "")]), (None, []), (None, [])]


def test_very_long_texts(spark):
    """Over 20 million characters in a table's text and in a JSON string."""
    n = 21_000_000
    rows = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.expr(f"concat('<a>', repeat('x', {n}))").alias("text"))
    done = chat.format_chat(chat.canonical_turns(chat.from_turns(rows)))
    got = done.select("layout", F.length(chat.loss_text(F.col("formatted"), F.col("loss_spans"))).alias("loss"), F.transform(chat.read_back(F.col("formatted")), lambda t: F.length(t["text"])).alias("back")).collect()
    assert [tuple(r) for r in got] == [("turns", n + 3, [n + 3, n + 3])]
    record = spark.range(1).select(F.expr(f"concat('{{\"question\":\"', repeat('y', {n}), '\",\"answer\":\"z\"}}')").alias("record"))
    long = chat.canonical_turns(record).select("layout", F.transform("turns", lambda t: F.length(t["text"])).alias("n")).collect()
    assert [tuple(r) for r in long] == [("question", [n, 1])]


def test_many_turns(spark):
    """Offsets and texts under the mask of a conversation of thousands of turns."""
    n = 5000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("[é] < turn "), F.col("id").cast("string")).alias("text"))
    r = chat.format_chat(chat.canonical_turns(chat.from_turns(rows))).select("formatted", "loss_spans", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    texts = [f"[é] < turn {i}" for i in range(n)]
    assert r.loss == "".join(texts[1::2])
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [t.replace("<", "\\1").replace("[", "\\2") for t in texts[1::2]]
    assert [s.turn for s in r.loss_spans] == list(range(1, n, 2))


def test_running_sums(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(100)),)], "a array<int>")
    assert [r.s for r in df.select(chat.running_sums(F.col("a")).alias("s")).collect()] == [[], [5], [sum(range(k + 1)) for k in range(100)]]
