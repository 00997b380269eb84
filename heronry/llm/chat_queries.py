"""Queries over conversations: as they are, and rewritten to hold tool calls; and SQL with the same rows.

The test tables' conversations hold no tool calls (none of 137,001 turns of
the largest one). ``chat_tool_calls`` therefore rewrites every turn of the
table: assistants' turns call tools, and what they said becomes results. Ids
recur, some calls wait for later ones or for each other, some arguments break
their schemas, some calls are never answered, some results answer nothing,
and some conversations lose their id.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from heronry.llm import chat_format

#: The tools that calls may name, with the types of their arguments and whether they must be given.
TOOLS: chat_format.Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
    "calculate": {"expression": ("string", True), "precise": ("boolean", False)},
    "run_code": {"code": ("string", True), "inputs": ("array", False), "seconds": ("number", False)},
}

#: JSON type: the names that SQL has for it.
_SQL_TYPES = {"string": "'VARCHAR'", "integer": "'UBIGINT', 'BIGINT'", "number": "'UBIGINT', 'BIGINT', 'DOUBLE'", "boolean": "'BOOLEAN'", "array": "'ARRAY'", "object": "'OBJECT'"}


def _sql_fault(schemas: chat_format.Schemas) -> str:
    """What is wrong with the JSON object ``obj`` as arguments of the tool ``name``."""
    tools = []
    for tool, fields in schemas.items():
        checks = []
        for arg, (want, needed) in fields.items():
            kind = f"coalesce(json_type(obj, '$.{arg}'), 'NULL')"
            if needed:
                checks.append(f"WHEN {kind} = 'NULL' THEN 'missing:{arg}'")
            checks.append(f"WHEN {kind} NOT IN ('NULL', {_SQL_TYPES[want]}) THEN 'type:{arg}'")
        known = ", ".join(f"'{a}'" for a in fields)
        others = f"list_sort([k for k in json_keys(obj) if k NOT IN ({known})])"
        checks.append(f"WHEN len({others}) > 0 THEN 'unknown:' || {others}[1]")
        tools.append(f"WHEN name = '{tool}' THEN CASE {' '.join(checks)} END")
    listed = ", ".join(f"'{t}'" for t in schemas)
    return f"CASE WHEN name IS NULL OR name NOT IN ({listed}) THEN 'tool' {' '.join(tools)} END"


def chat_sql(turns: str, schemas: chat_format.Schemas = TOOLS) -> str:
    """``format_chats`` over the relation ``turns`` in SQL. Keys are sorted at the top of arguments only."""
    text = lambda key, value: f"""'"{key}":' || coalesce(CAST(to_json(CAST({value} AS VARCHAR)) AS VARCHAR), 'null')"""
    return f"""
WITH RECURSIVE read AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, CASE WHEN json_valid(text) AND regexp_matches(text, '^\\s*\\{{') THEN text ELSE '{{}}' END AS j FROM ({turns})
),
rows AS (
  SELECT *, coalesce(role = 'assistant' AND json_type(j, '$.tool_calls') = 'ARRAY', false) AS has_calls,
         coalesce(role = 'tool' AND (j ->> '$.tool_call_id') IS NOT NULL, false) AS is_result
  FROM read
),
listed AS (SELECT conv_id, turn, role, text, k, json_extract(j, '$.tool_calls[' || k || ']') AS x
           FROM (SELECT *, unnest(range(0, CAST(json_array_length(j, '$.tool_calls') AS BIGINT))) AS k FROM rows WHERE has_calls)),
calls AS (
  SELECT conv_id, turn, role, x ->> '$.id' AS call_id, x ->> '$.name' AS name, x ->> '$.arguments' AS arguments,
         coalesce(CAST(json_extract_string(x, '$.after[*]') AS VARCHAR[]), []) AS after, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, text, k) AS n
  FROM listed
),
results AS (
  SELECT conv_id, turn, role, j ->> '$.tool_call_id' AS call_id, j ->> '$.content' AS said, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, j ->> '$.content' NULLS FIRST) AS m
  FROM rows WHERE is_result
),
first AS (SELECT conv_id, call_id, min(n) AS first, min(turn) AS turn FROM calls WHERE call_id IS NOT NULL GROUP BY ALL),
answer AS (SELECT conv_id, call_id, min(m) AS answer FROM results GROUP BY ALL),
waits AS (
  SELECT DISTINCT a.conv_id, a.call_id, a.needs
  FROM (SELECT conv_id, call_id, unnest(after) AS needs FROM calls WHERE call_id IS NOT NULL) a
  JOIN first b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.needs = b.call_id
),
sizes AS (SELECT conv_id, count(*) AS size FROM first GROUP BY ALL),
chains AS (
  SELECT conv_id, call_id, turn AS place, 0 AS level FROM first
  UNION
  SELECT w.conv_id, w.call_id, greatest(f.turn, c.place), c.level + 1
  FROM chains c JOIN waits w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.call_id = w.needs
  JOIN first f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.call_id = w.call_id
  JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE c.level < s.size
),
ordered AS (
  SELECT c.conv_id, c.call_id, max(level) >= any_value(size) AS cyclic, CASE WHEN cyclic THEN NULL ELSE max(place) END AS place, CASE WHEN cyclic THEN 0 ELSE max(level) END AS level
  FROM chains c JOIN sizes s ON c.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY c.conv_id, c.call_id
),
marked AS (
  SELECT c.conv_id, c.turn, c.role, c.call_id, c.name, c.arguments, c.n, f.first, a.answer, coalesce(o.cyclic, false) AS cyclic, greatest(c.turn, coalesce(o.place, c.turn)) AS place, coalesce(o.level, 0) AS level,
         coalesce(c.arguments, '{{}}') AS given, CASE WHEN json_valid(given) AND json_type(given) = 'OBJECT' THEN given ELSE '{{}}' END AS obj
  FROM calls c
  LEFT JOIN first f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.call_id = f.call_id
  LEFT JOIN answer a ON c.conv_id IS NOT DISTINCT FROM a.conv_id AND c.call_id = a.call_id
  LEFT JOIN ordered o ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.call_id = o.call_id
),
canonical AS (
  SELECT *, CASE WHEN NOT json_valid(given) THEN CAST(to_json(arguments) AS VARCHAR) WHEN json_type(given) <> 'OBJECT' THEN CAST(json_extract(given, '$') AS VARCHAR)
    ELSE '{{' || coalesce(list_aggregate([CAST(to_json(k) AS VARCHAR) || ':' || CAST(json_extract(obj, '$."' || k || '"') AS VARCHAR) for k in list_sort(json_keys(obj))], 'string_agg', ','), '') || '}}' END AS canon
  FROM marked
),
entries AS (
  SELECT conv_id, turn, role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id,
         CASE WHEN coalesce(text, '') = '' THEN 'empty' ELSE 'ok' END AS status,
         '{{' || {text("content", "CASE WHEN has_calls THEN j ->> '$.content' ELSE text END")} || ',' || {text("role", "role")} || '}}' AS line,
         turn AS place, 0 AS stage, 0 AS level, 0 AS n, 0 AS m
  FROM rows WHERE NOT is_result
  UNION ALL
  SELECT conv_id, turn, role, 'call', call_id,
         CASE WHEN call_id IS NULL THEN 'unnamed' WHEN n <> first THEN 'repeated' WHEN cyclic THEN 'cycle' WHEN NOT json_valid(given) THEN 'json' WHEN json_type(given) <> 'OBJECT' THEN 'object'
              ELSE coalesce({_sql_fault(schemas)}, CASE WHEN answer IS NULL THEN 'unanswered' ELSE 'ok' END) END,
         '{{"arguments":' || canon || ',' || {text("id", "call_id")} || ',' || {text("name", "name")} || ',' || {text("role", "role")} || '}}',
         place, 1, level, n, -1
  FROM canonical
  UNION ALL
  SELECT r.conv_id, r.turn, r.role, 'result', r.call_id,
         CASE WHEN o.n IS NULL THEN 'orphan' WHEN r.m <> a.answer THEN 'repeated' ELSE 'ok' END,
         '{{' || {text("content", "r.said")} || ',' || {text("role", "r.role")} || ',' || {text("tool_call_id", "r.call_id")} || '}}',
         coalesce(o.place, r.turn), CASE WHEN o.n IS NULL THEN 0 ELSE 1 END, coalesce(o.level, 0), coalesce(o.n, 0), CASE WHEN o.n IS NULL THEN 0 ELSE r.m END
  FROM results r
  LEFT JOIN (SELECT * FROM marked WHERE n = first) o ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.call_id = o.call_id
  LEFT JOIN answer a ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.call_id = a.call_id
)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place NULLS FIRST, stage, level, n, m, role NULLS FIRST, line) - 1 AS BIGINT) AS position, role, kind, call_id, status, line
FROM entries
"""


# how a turn is rewritten, in words that Spark and SQL both read
_CONV = "CASE WHEN conv_id % 11 = 10 THEN NULL ELSE conv_id END"
_ID = "substring(md5(concat(conv_id, ':', turn)), 1, 8)"
#: Arguments of a call by the first digit of its turn's hash: fitting ones, and one of each fault.
_ARGUMENTS = f"""CASE substring({_ID}, 1, 1)
  WHEN '0' THEN '{{"limit": 3, "query": "q"}}' WHEN '1' THEN '{{"query": 7}}' WHEN '2' THEN '{{"limit": 3}}' WHEN '3' THEN '{{"query": "q", "limit": 2.5}}' WHEN '4' THEN '{{"query": "q", "then": 1}}'
  WHEN '5' THEN 'no json' WHEN '6' THEN '[1,  2]' WHEN '7' THEN '{{"query": null}}' ELSE concat('{{"query":  "', {_ID}, '"}}') END"""


def _quoted(sql: bool) -> str:
    """The arguments as the inside of a JSON string; a backslash is written twice in Spark's literals."""
    one = "\\" if sql else "\\\\"
    return f"""replace({_ARGUMENTS}, '"', '{one}"')"""


def _rewritten(sql: bool) -> list[tuple[list[str], str]]:
    """Columns ``conv_id, turn, role, text`` and a condition, for each of the three selects that make the rows."""
    tool = f"CASE WHEN substring({_ID}, 2, 1) = '0' THEN 'teleport' ELSE 'search' END"
    # the second call waits for the first; the first for one of the turn before last, or in every seventh conversation for the second
    before = "CASE WHEN conv_id % 7 = 3 THEN concat('b', turn) ELSE concat('b', turn - 2) END"
    call_a = f"""concat('{{"id":"a', turn, '","name":"', {tool}, '","arguments":"', {_quoted(sql)}, '","after":["', {before}, '"]}}')"""
    call_b = f"""concat('{{"id":"b', CASE WHEN conv_id % 5 = 4 THEN 1 ELSE turn END, '","name":"search","arguments":"', {_quoted(sql)}, '","after":["a', turn, '","gone"]}}')"""
    unnamed = f"""concat('{{"name":"search","arguments":"', {_quoted(sql)}, '"}}')"""
    # in some turns the second call comes first
    both = f"CASE WHEN substring({_ID}, 3, 1) < '8' THEN concat({call_b}, ',', {call_a}) ELSE concat({call_a}, ',', {call_b}, ',', {unnamed}) END"
    said = f"""CASE WHEN role = 'assistant' THEN concat('{{"content":"', {_ID}, '","tool_calls":[', {both}, ']}}') ELSE text END"""
    answer_a = f"""concat('{{"tool_call_id":"', CASE WHEN substring({_ID}, 4, 1) < '3' THEN 'z' ELSE 'a' END, turn, '","content":"', {_ID}, '"}}')"""
    answer_b = f"""concat('{{"tool_call_id":"b', turn, '","content":"', {_ID}, '"}}')"""
    return [
        ([f"{_CONV} AS conv_id", "turn", "role", f"{said} AS text"], "true"),
        ([f"{_CONV} AS conv_id", "turn + 1 AS turn", "'tool' AS role", f"{answer_a} AS text"], "role = 'assistant'"),
        ([f"{_CONV} AS conv_id", "turn + 3 AS turn", "'tool' AS role", f"{answer_b} AS text"], f"role = 'assistant' AND substring({_ID}, 5, 1) < 'c'"),
    ]


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the table, rewritten to hold calls and results, and formatted with the tools' schemas."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parts = [turns.where(where).selectExpr(*columns) for columns, where in _rewritten(False)]
    return chat_format.format_chats(functools.reduce(DataFrame.unionByName, parts), TOOLS)


OP4_SQL = chat_sql("SELECT conv_id, turn, role, text FROM conversations")
TOOL_CALLS_SQL = chat_sql(" UNION ALL ".join(f"SELECT {', '.join(columns)} FROM conversations WHERE {where}" for columns, where in _rewritten(True)))
