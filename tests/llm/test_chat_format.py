"""Linking, ordering, validation and canonical lines of conversations with tool calls."""

import json

import pytest
from pyspark.sql import functions as F

from heronry.llm.chat_format import argument_fault, canonical, format_chats

SCHEMA = "conv_id long, turn long, role string, text string"
SCHEMAS = {"add": {"a": ("number", True), "b": ("integer", False)}, "say": {"text": ("string", True)}}


def calls(*made, content=None):
    return json.dumps({"content": content, "tool_calls": list(made)})


def call(id, name="say", arguments='{"text": "x"}', **more):
    return {"id": id, "name": name, "arguments": arguments, **more}


def result(id, content="done"):
    return json.dumps({"tool_call_id": id, "content": content})


def formatted(spark, rows, schemas=SCHEMAS):
    got = format_chats(spark.createDataFrame(rows, SCHEMA), schemas).collect()
    return sorted(got, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position))


def test_plain_turns(spark):
    rows = [(1, 0, "user", 'He said "é\n"'), (1, 1, "assistant", "{not json"), (1, 2, "user", None), (1, 3, None, "")]
    got = formatted(spark, rows)
    assert [r.position for r in got] == [0, 1, 2, 3]
    assert [r.status for r in got] == ["ok", "ok", "empty", "empty"]
    for r, (_, _, role, text) in zip(got, rows, strict=True):
        assert r.line == json.dumps({"content": text, "role": role}, ensure_ascii=False, separators=(",", ":"))


def test_json_nested_beyond_the_parser(spark):
    """Such arguments are a fault of the call, such turns are messages; both are serialised whole."""
    deep = "[" * 3000 + "]" * 3000
    arguments, turn = f'{{"text":{deep}}}', f'{{"content":{deep},"tool_calls":[]}}'
    got = formatted(spark, [(1, 0, "assistant", calls(call("a", arguments=arguments))), (1, 1, "assistant", turn)])
    assert [(r.kind, r.status) for r in got] == [("message", "ok"), ("call", "json"), ("message", "ok")]
    assert json.loads(got[1].line)["arguments"] == arguments
    assert json.loads(got[2].line)["content"] == turn


def test_results_follow_their_calls_and_calls_their_needs(spark):
    rows = [
        (1, 0, "user", "go"),
        (1, 1, "assistant", calls(call("c", after=["b"]), call("b", after=["a"]), call("a"), content="I will")),
        (1, 2, "tool", result("a")),
        (1, 3, "tool", result("c")),
        (1, 4, "tool", result("b")),
        (1, 5, "assistant", "all done"),
    ]
    got = formatted(spark, rows)
    assert [(r.kind, r.call_id) for r in got] == [("message", None), ("message", None), ("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("call", "c"), ("result", "c"), ("message", None)]
    assert {r.status for r in got} == {"ok"}
    assert json.loads(got[1].line) == {"content": "I will", "role": "assistant"}


def test_statuses(spark):
    rows = [
        (1, 0, "assistant", calls(call("a"), call("a"), call(None), call("x", after=["y"]), call("y", after=["x"]), call("z", after=["gone"]))),
        (1, 1, "tool", result("a")),
        (1, 2, "tool", result("a", "again")),
        (1, 3, "tool", result("nobody")),
        (2, 0, "tool", result("a")),
    ]
    got = formatted(spark, rows)
    of = {(r.conv_id, r.kind, r.call_id, r.line): r.status for r in got}
    first = sorted(s for (c, k, i, _), s in of.items() if (c, k, i) == (1, "call", "a"))
    assert sorted(r.status for r in got if (r.conv_id, r.kind, r.call_id) == (1, "call", "a")) == ["ok", "repeated"] and first
    assert [r.status for r in got if r.kind == "call" and r.call_id is None] == ["unnamed"]
    assert {r.status for r in got if r.kind == "call" and r.call_id in ("x", "y")} == {"cycle"}
    assert [r.status for r in got if r.call_id == "z"] == ["unanswered"]
    assert [r.status for r in got if r.conv_id == 1 and r.kind == "result"] == ["ok", "repeated", "orphan"]
    assert [r.status for r in got if r.conv_id == 2] == ["orphan"]


@pytest.mark.parametrize(
    ("name", "arguments", "fault"),
    [
        ("add", '{"a": 1}', None), ("add", '{"a": 1.5, "b": 2}', None), ("add", '{"b": 2}', "missing:a"), ("add", '{"a": null}', "missing:a"), ("add", '{"a": "1"}', "type:a"), ("add", '{"a": 1, "b": 1.5}', "type:b"),
        ("add", '{"a": 1, "c": 2}', "unknown:c"), ("add", "[1]", "object"), ("add", "{", "json"), ("nothing", "{}", "tool"), (None, "{}", "tool"), ("say", '{"text": "t"}', None), ("say", '{"text": ["t"]}', "type:text"),
    ],
)
def test_arguments_against_schemas(spark, name, arguments, fault):
    df = spark.createDataFrame([(name, arguments)], "name string, arguments string")
    assert df.select(argument_fault(F.col("name"), F.col("arguments"), SCHEMAS)).first()[0] == fault


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": [1, {"z": null, "a": "é\\n"}], "a": 1.50}',), ("{",)], "j string")
    one, two = (r[0] for r in df.select(canonical(F.col("j"))).collect())
    assert one == '{"a":1.5,"b":[1,{"a":"é\\n","z":null}]}' and two is None


def test_lines_are_canonical(spark):
    got = formatted(spark, [(1, 0, "assistant", calls(call("i", "add", '{"b": 2,  "a": 1}'), call("j", "add", "not json"))), (1, 1, "tool", result("i", None))])
    for r in got:
        value = json.loads(r.line)
        assert r.line == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    lines = {(r.kind, r.call_id): json.loads(r.line) for r in got}
    assert lines["call", "i"]["arguments"] == {"a": 1, "b": 2}
    assert lines["call", "j"]["arguments"] == "not json"
    assert lines["result", "i"]["content"] is None


def test_long_chains_and_texts(spark):
    chain = [call(f"c{i}", after=[f"c{i - 1}"] if i else []) for i in reversed(range(6))]
    got = formatted(spark, [(1, 0, "assistant", calls(*chain)), (1, 1, "user", "é" * 300_000)])
    assert [r.call_id for r in got if r.kind == "call"] == [f"c{i}" for i in range(6)]
    assert len(got[-1].line) > 300_000


def test_crowded_conversations_are_numbered_alike(spark):
    """Two long conversations, one of them null, are dealt over tasks; the rows are the same."""
    rows = [(c, t, "user", f"{c} {t}") for c, n in ((1, 400), (2, 3), (None, 300), (3, 9)) for t in range(n)]
    rows += [(1, t, "assistant", calls(call(f"c{t}"), call(f"d{t}", after=[f"c{t}"]))) for t in range(0, 400, 9)] + [(1, 5, "user", "same")] * 20
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    a, b = (sorted(map(tuple, format_chats(df, SCHEMAS, crowd=n).collect()), key=repr) for n in (10_000, 50))
    assert a == b
    assert sorted(r[2] for r in b if r[0] is None) == list(range(300))


def test_nulls_repeats_clashes_and_nothing(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "assistant", "a"), (None, 2, "assistant", calls(call("k"))), (None, 3, "tool", result("k"))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit(1)).withColumn("n", F.lit("n")).withColumn("position", F.lit("p"))
    got = format_chats(df)
    assert got.columns == ["conv_id", "turn", "position", "role", "kind", "call_id", "status", "line"]
    found = got.collect()
    assert sorted(r.position for r in found if r.conv_id == 1) == [0, 1, 2]
    assert sorted(r.position for r in found if r.conv_id is None) == [0, 1, 2, 3, 4]
    assert {(r.kind, r.status) for r in found if r.call_id == "k"} == {("call", "ok"), ("result", "ok")}
    assert format_chats(df.where("false")).collect() == []


def test_calls_without_a_conversation_are_ordered(spark):
    """A call waits for the one it names, and cycles are marked, in the null conversation as in others."""

    def turn(*calls):
        return json.dumps({"content": "", "tool_calls": [{"id": i, "name": "f", "arguments": "{}", "after": after} for i, after in calls]})

    text = turn(("a", ["b"]), ("b", []), ("c", ["d"]), ("d", ["c"]))
    turns = spark.createDataFrame([(None, 0, "assistant", text), (7, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = format_chats(turns).where("kind = 'call'").orderBy("position").collect()
    for conv in (None, 7):
        got = {r.call_id: (i, r.status) for i, r in enumerate(x for x in rows if x.conv_id == conv)}
        assert got["b"][0] < got["a"][0]
        assert {i: s for i, (_, s) in got.items()} == {"a": "unanswered", "b": "unanswered", "c": "cycle", "d": "cycle"}
