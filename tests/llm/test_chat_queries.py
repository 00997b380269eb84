"""The registered chat queries against their SQL, over tables with calls, results, waits, cycles and null conversations."""

import os

import duckdb
import pytest
from test_chat_format import SCHEMA, SCHEMAS, call, calls, result

from heronry.llm import chat_queries, queries
from heronry.llm.chat_format import format_chats

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def both(spark, query, sql, folder):
    """Sorted rows of the query and of its SQL."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{'/*.parquet' if os.path.isdir(f'{folder}/conversations.parquet') else ''}'")
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(map(tuple, query(spark, folder).select(names).collect()), key=repr), sorted(cursor.fetchall(), key=repr)


def search(id, arguments='{"query": "q"}', **more):
    return call(id, "search", arguments, **more)


ROWS = [
    (conv, turn, role, text)
    for conv in (None, 1)
    for turn, role, text in [
        (None, "user", "no turn"), (0, "user", "find it"), (0, "user", "find it"), (1, None, None), (1, "assistant", ""),
        (2, "assistant", calls(search("c", after=["b"]), search("b", after=["a"]), search("a"), content="one after the other")),
        (3, "tool", result("b")), (3, "tool", result("a", None)), (4, "tool", result("a", "again")), (4, "tool", result("nobody")),
        (5, "assistant", calls(search("x", after=["y"]), search("y", after=["z", "a"]), search("z", after=["x"]), search("w", after=["z"]), search("late", after=["a", "a", "gone"]))),
        (6, "assistant", calls(search("a"), search(None), call("t", "teleport"), search("bad", "not json"), search("list", "[1, 2]"), search("typed", '{"query": 1}'), search("more", '{"query": "q", "than": 1, "asked": 2}'))),
        (7, "assistant", calls(call("k", "calculate", '{"precise": true, "expression": "1+1"}'), call("r", "run_code", '{"seconds": 1.5, "inputs": [1], "code": "x\\n"}'), call("f", "fetch", '{"url": "u", "headers": []}'), call("n", "search", None))),
        (8, "tool", result("k", "2")), (9, "user", '{"tool_calls": []}'), (9, "assistant", "{broken"), (9, "tool", '{"content": "no id"}'),
    ]
]


def test_the_query_equals_its_sql_over_calls(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    found, expected = both(spark, queries.QUERIES["op4_chat_format"], queries.ORACLE_SQL["op4_chat_format"], str(tmp_path))
    assert found == expected
    statuses = {r[6] for r in found}
    assert statuses >= {"ok", "empty", "unanswered", "repeated", "unnamed", "cycle", "json", "object", "tool", "type:query", "type:headers", "unknown:asked", "missing:query", "orphan"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rewritten_conversations_equal_their_sql(spark):
    found, expected = both(spark, queries.RELATED["chat_tool_calls"], queries.RELATED_SQL["chat_tool_calls"], SF)
    assert found == expected and any(r[6] == "cycle" for r in found)


def test_rounds_order_like_rows(spark):
    """Chains, a diamond and a cycle, ordered inside rows and by joins."""
    chain = [search(f"c{i}", after=[f"c{i - 1}", f"c{i - 2}"] if i else []) for i in reversed(range(9))]
    ring = [search(f"r{i}", after=[f"r{(i + 1) % 4}"]) for i in range(4)] + [search("off", after=["r2"])]
    rows = [(c, t, "assistant", calls(*made)) for c in (None, 1, 2) for t, made in enumerate((chain[:4], ring, chain[4:]))]
    df = spark.createDataFrame(rows, SCHEMA)
    some, none = (sorted(map(tuple, format_chats(df, SCHEMAS, in_row=n).collect()), key=repr) for n in (1000, 0))
    assert some == none
    assert [r[5] for r in sorted((r for r in none if r[0] == 1 and r[5] and r[5].startswith("c")), key=lambda r: r[2])] == [f"c{i}" for i in range(9)]


def test_a_conversation_of_many_calls_and_one_identifier(spark):
    """One identifier with most of the calls and results, and a long text."""
    rows = [(None, t, "assistant", calls(search("hot"))) for t in range(300)] + [(None, t, "tool", result("hot", str(t))) for t in range(300)] + [(None, 400, "user", "é" * 200_000)]
    got = format_chats(spark.createDataFrame(rows, SCHEMA), chat_queries.TOOLS, crowd=50).collect()
    assert len(got) == 901 and sorted(r.position for r in got) == list(range(901))  # an assistant turn is a message and a call
    assert sum(r.status == "repeated" for r in got) == 598
