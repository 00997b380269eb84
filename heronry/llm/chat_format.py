"""Chat formatting with tool calls, in DataFrame and SQL functions only.

A conversation is a table of turns. An assistant's turn may be a JSON object
``{"content": ..., "tool_calls": [{"id", "name", "arguments", "after"}]}`` and
a tool's turn one of ``{"tool_call_id": ..., "content": ...}``; every other
text is plain content. Calls and results are hash-joined by conversation and
identifier, calls are ordered so that each follows the calls it names in
``after``, results follow their calls, arguments are checked against the
schemas of the tools, and every entry becomes a line of canonical JSON: no
white space, keys sorted at all depths.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.scratch import cut, small_or_not

#: Entries of a conversation above which it is dealt over several tasks.
CROWD = 10_000
#: Waits between the calls of a conversation up to which they are ordered inside one row.
IN_ROW = 48

#: Tool: argument: (JSON type, whether it must be there). Types: string, number, integer, boolean, array, object.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
_CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
_RESULT = "struct<tool_call_id:string,content:string>"


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and without white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def _is_type(kind: Column, want: str) -> Column:
    whole = kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    return {
        "string": kind == "STRING",
        "number": whole | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
        "integer": whole,
        "boolean": kind == "BOOLEAN",
        "array": kind.startswith("ARRAY"),
        "object": kind.startswith("OBJECT"),
    }[want]


def argument_fault(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, or null: ``json``, ``object``, ``missing:x``, ``type:x``, ``unknown:x``, ``tool``."""
    parsed = F.try_parse_json(arguments)
    out = F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.lit("tool")) if schemas else F.lit(None).cast("string")
    for tool, fields in schemas.items():
        faults = []
        for arg, (want, needed) in fields.items():
            kind = F.schema_of_variant(F.try_variant_get(parsed, "$['" + arg.replace("'", "\\'") + "']", "variant"))
            if needed:
                faults.append(F.when(kind.isNull() | (kind == "VOID"), F.lit(f"missing:{arg}")))
            faults.append(F.when(kind.isNotNull() & (kind != "VOID") & ~_is_type(kind, want), F.lit(f"type:{arg}")))
        others = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields)).cast("array<string>")))
        faults.append(F.when(F.size(others) > 0, F.concat(F.lit("unknown:"), F.get(others, 0))))
        out = F.when(name == tool, F.coalesce(*faults)).otherwise(out)
    kind = F.schema_of_variant(parsed)
    return F.when(parsed.isNull(), "json").when(~kind.startswith("OBJECT"), "object").otherwise(out)


def _in_rows(nodes: DataFrame, waits: DataFrame) -> DataFrame:
    """``at`` and ``level`` of ``nodes(conv, call_id, turn)``, each conversation in one row; ``level`` is null on cycles.

    A round places every call whose needs are placed; there are as many rounds
    as the conversation has calls, which ``IN_ROW`` bounds.
    """
    needs = waits.groupBy("conv", "call_id").agg(F.collect_list("needs").alias("needs"))
    held = nodes.join(needs, ["conv", "call_id"], "left").groupBy("conv").agg(F.collect_list(F.struct("call_id", "turn", F.coalesce("needs", F.array()).alias("needs"))).alias("v"))
    ids = F.transform("v", lambda x: x["call_id"])
    held = held.withColumn("w", F.transform("v", lambda x: F.struct(x["turn"].alias("turn"), F.transform(x["needs"], lambda y: F.array_position(ids, y)).alias("p"))))
    none = F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("level"))

    def place(acc: Column, _: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            node = F.get(F.col("w"), i)
            of = F.transform(node["p"], lambda j: F.element_at(acc, j.cast("int")))
            ready = F.forall(of, lambda x: x["level"].isNotNull())
            at = F.greatest(node["turn"], F.array_max(F.transform(of, lambda x: x["at"])))
            level = F.coalesce(F.array_max(F.transform(of, lambda x: x["level"])) + 1, F.lit(0))
            return F.when(s["level"].isNotNull(), s).when(ready, F.struct(at.alias("at"), level.alias("level"))).otherwise(s)

        return F.transform(acc, one)

    placed = F.aggregate(F.sequence(F.lit(1), F.size("v")), F.transform("v", lambda x: none), place)
    rows = held.select("conv", F.posexplode(placed).alias("i", "s"), "v")
    return rows.select("conv", F.get("v", F.col("i"))["call_id"].alias("call_id"), F.col("s.at").alias("at"), F.col("s.level").alias("level"))


def _in_rounds(nodes: DataFrame, waits: DataFrame) -> DataFrame:
    """As ``_in_rows`` for conversations of any size: a round is a join, and rounds are as many as the longest chain."""
    free = nodes.join(waits.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(True).alias("free"))
    state = nodes.join(free, ["conv", "call_id"], "left").select("conv", "call_id", "turn", F.when(F.col("free"), F.col("turn")).alias("at"), F.when(F.col("free"), 0).alias("level"))
    state = cut(state, "order")
    done = state.where("level is not null").count()
    while True:
        seen = waits.join(state.select("conv", F.col("call_id").alias("needs"), "at", "level"), ["conv", "needs"])
        ready = seen.groupBy("conv", "call_id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max("at").alias("a"), F.max("level").alias("l")).where("open = 0").drop("open")
        grown = state.join(ready, ["conv", "call_id"], "left")
        at, level = F.coalesce("at", F.when(F.col("l").isNotNull(), F.greatest("turn", "a"))), F.coalesce("level", F.col("l") + 1)
        state = cut(grown.select("conv", "call_id", "turn", at.alias("at"), level.alias("level")), "order")
        now = state.where("level is not null").count()
        if now == done:
            return state.drop("turn")
        done = now


def _ordered(calls: DataFrame, in_row: int) -> DataFrame:
    """Rows ``(conv, call_id, at, level)`` of the calls that wait or are waited for; ``conv`` is a struct, in which null equals null.

    A call is placed once all calls that it waits for are, at the latest turn
    among theirs and its own; ``level`` is null for what can never be placed.
    Names in ``after`` that no call of the conversation has are passed over.
    Conversations of at most ``in_row`` waits are ordered inside a row, others
    by rounds of joins.
    """
    named = calls.where("call_id is not null").select(F.struct("conv_id").alias("conv"), "call_id", "turn", "after")
    keyed = named.groupBy("conv", "call_id").agg(F.min("turn").alias("turn"))
    asked = named.select("conv", "call_id", F.explode(F.array_distinct("after")).alias("needs")).distinct()
    waits = cut(asked.join(keyed.select("conv", F.col("call_id").alias("needs")).hint("shuffle_hash"), ["conv", "needs"], "left_semi"), "waits")
    ends = waits.select("conv", "call_id").union(waits.select("conv", F.col("needs").alias("call_id"))).distinct()
    nodes = cut(ends.join(keyed, ["conv", "call_id"]), "nodes")
    large = cut(waits.groupBy("conv").count().where(F.col("count") > in_row).select("conv"), "large-conversations")
    if large.isEmpty():
        return _in_rows(nodes, waits)
    few = small_or_not(large)
    inside, rounds = (lambda t, how: t.join(few, "conv", how)), ("left_anti", "left_semi")
    return _in_rows(*(inside(t, rounds[0]) for t in (nodes, waits))).unionByName(_in_rounds(*(cut(inside(t, rounds[1]), "crowded-order") for t in (nodes, waits))))


def _positions(entries: DataFrame, order: list[str], crowd: int) -> DataFrame:
    """``entries`` with ``position``, which counts those of a conversation from 0 in ``order``.

    Conversations of more than ``crowd`` entries, of which there are few, are
    range-partitioned by that order; a task numbers its part, and the totals of
    the parts before it are added.
    """

    def numbered(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("position", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))

    crowded = cut(entries.groupBy("conv_id").count().where(F.col("count") > crowd).select(F.col("conv_id").alias("crowded")), "crowded")
    if crowded.isEmpty():
        return numbered(entries, "conv_id")
    few = small_or_not(crowded)
    same = F.col("conv_id").eqNullSafe(F.col("crowded"))
    parts = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(entries.join(few, same, "left_semi").repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n_part"))  # a row a part, and one more for each conversation
    totals = totals.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("before"))
    placed = numbered(dealt, "conv_id", "part").join(small_or_not(cut(totals, "totals")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    placed = placed.withColumn("position", F.col("position") + F.col("before")).drop("part", "c", "p", "before")
    return numbered(entries.join(few, same, "left_anti"), "conv_id").unionByName(placed)


def _name(key: str, value: Column) -> Column:
    """``"key":"value"`` with JSON escapes, or ``"key":null``."""
    quoted = F.to_json(F.struct(value.alias(key)))
    return F.when(value.isNull(), f'"{key}":null').otherwise(quoted.substr(F.lit(2), F.length(quoted) - 2))


def _line(*parts: Column) -> Column:
    between = [x for p in parts for x in (F.lit(","), p)][1:]
    return F.concat(F.lit("{"), *between, F.lit("}"))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, which rises with ``order`` over all rows; fixed by being written."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(dealt.withColumn(name, F.monotonically_increasing_id()), name)


def format_chats(turns: DataFrame, schemas: Schemas | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", crowd: int = CROWD, in_row: int = IN_ROW) -> DataFrame:
    """One row per entry: every turn, and every call in a turn.

    Columns: ``conv_id, turn, position, role, kind, call_id, status, line``.
    ``position`` counts the entries of a conversation from 0. ``kind`` is
    message, call or result. The status of a message is ``ok`` (``empty`` for a
    null or empty text); of a call ``ok``, ``unanswered``, ``repeated`` (an
    earlier call has its id), ``unnamed`` (no id), ``cycle``, or what is wrong
    with its arguments; of a result ``ok``, ``orphan`` (no call has its id) or
    ``repeated`` (an earlier result answers it). Results come right after the
    first call of their id, orphans at their own turn. A call stands at its own
    turn, or later if a call that it waits for does; what a cycle keeps from
    being ordered stays at its own turn. A null text is serialised as null
    content. Without ``schemas`` any tool and any JSON object passes.
    Arguments with a key twice are no valid JSON (``json``, serialised as the
    string they are), and integers beyond 38 digits become floating numbers.
    Arguments that Spark can't read, as they are nested beyond its parser's
    depth, are ``json`` as well; a turn that it can't read is a message.

    Null conversations are one conversation, of null turns the order is first;
    rows of equal turn are ordered by what they are and by text; repeated rows
    give entries of their own. Texts of any length are serialised whole. An
    empty table gives no rows; other columns are not read, whatever their names.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    object_like = F.col("text").rlike(r"^\s*\{")
    as_calls = F.when((F.col("role") == "assistant") & object_like & F.get_json_object("text", "$.tool_calls").startswith("["), F.from_json("text", _CALLS))
    as_result = F.when((F.col("role") == "tool") & object_like & F.get_json_object("text", "$.tool_call_id").isNotNull(), F.from_json("text", _RESULT))
    rows = rows.withColumn("c", as_calls).withColumn("r", as_result)

    said = F.when(F.col("c").isNotNull(), F.col("c.content")).otherwise(F.col("text"))
    plain = rows.where("r is null").select(
        "conv_id", "turn", "role",
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.when((F.coalesce(said, F.lit("")) == "") & F.col("c").isNull(), "empty").otherwise("ok").alias("status"),
        _line(_name("content", said), _name("role", F.col("role"))).alias("line"),
        F.col("turn").alias("at"), F.lit(0).alias("stage"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"),
    )

    exploded = rows.where("c is not null").select("conv_id", "turn", "role", "text", F.posexplode("c.tool_calls").alias("k", "x"))
    calls = exploded.select("conv_id", "turn", "text", "k", "role", F.col("x.id").alias("call_id"), F.col("x.name").alias("name"), F.col("x.arguments").alias("arguments"), F.coalesce("x.after", F.array()).alias("after"))
    calls = _numbered(calls, ["conv_id", "turn", "text", "k"], "n").drop("text", "k")
    results = rows.where("r is not null").select("conv_id", "turn", "role", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("said"))
    results = _numbered(results, ["conv_id", "turn", "said"], "m")

    # the first call and the first result of each identifier, hash-joined to all calls and results
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("n").alias("first"))
    answer = results.groupBy("conv_id", "call_id").agg(F.min("m").alias("answer"))
    placed = _ordered(calls, in_row).select(F.col("conv.conv_id").alias("conv_id"), "call_id", "at", "level", F.lit(True).alias("waits"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.call_id") == F.col("b.call_id"))

    def linked(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
        return left.alias("a").join(right.hint("shuffle_hash").alias("b"), same, "left").select("a.*", *(f"b.{c}" for c in columns))

    marked = linked(linked(linked(calls, first, "first"), answer, "answer"), placed, "at", "level", "waits")
    marked = marked.withColumn("cyclic", F.coalesce(F.col("waits") & F.col("level").isNull(), F.lit(False)))
    marked = marked.withColumn("at", F.greatest("turn", F.coalesce("at", "turn"))).withColumn("level", F.coalesce("level", F.lit(0)))
    marked = cut(marked, "marked")
    given = F.coalesce("arguments", F.lit("{}"))
    status = F.when(F.col("call_id").isNull(), "unnamed").when(F.col("n") != F.col("first"), "repeated").when(F.col("cyclic"), "cycle")
    raw = F.to_json(F.array("arguments"))
    call_rows = marked.select(
        "conv_id", "turn", "role",
        F.lit("call").alias("kind"), "call_id",
        F.coalesce(status, argument_fault(F.col("name"), given, schemas or {}), F.when(F.col("answer").isNull(), "unanswered"), F.lit("ok")).alias("status"),
        _line(
            F.concat(F.lit('"arguments":'), F.coalesce(canonical(given), raw.substr(F.lit(2), F.length(raw) - 2))),
            _name("id", F.col("call_id")), _name("name", F.col("name")), _name("role", F.col("role")),
        ).alias("line"),
        "at", F.lit(1).alias("stage"), "level", "n", F.lit(-1).cast("long").alias("m"),
    )

    own = marked.where("n = first").select("conv_id", "call_id", F.col("at").alias("call_at"), F.col("level").alias("call_level"), F.col("n").alias("call_n"))
    answers = linked(linked(results, own, "call_at", "call_level", "call_n"), answer, "answer")
    orphan = F.col("call_n").isNull()
    result_rows = answers.select(
        "conv_id", "turn", "role",
        F.lit("result").alias("kind"), "call_id",
        F.when(orphan, "orphan").when(F.col("m") != F.col("answer"), "repeated").otherwise("ok").alias("status"),
        _line(_name("content", F.col("said")), _name("role", F.col("role")), _name("tool_call_id", F.col("call_id"))).alias("line"),
        F.when(orphan, F.col("turn")).otherwise(F.col("call_at")).alias("at"),
        F.when(orphan, 0).otherwise(1).alias("stage"),
        F.coalesce("call_level", F.lit(0)).alias("level"), F.coalesce("call_n", F.lit(0)).cast("long").alias("n"),
        F.when(orphan, F.lit(0)).otherwise(F.col("m")).cast("long").alias("m"),
    )
    entries = plain.unionByName(call_rows).unionByName(result_rows)
    placed = _positions(entries, ["at", "stage", "level", "n", "m", "role", "line"], crowd)
    return placed.select("conv_id", "turn", "position", "role", "kind", "call_id", "status", "line")
