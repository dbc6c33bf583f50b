"""Chat formatting with linked tool calls.

Messages carry at most one identifier of their own and one identifier that they
follow: a result names the call it answers, a call may name the result it needs.
Calls and results are linked by a hash join on (conversation, identifier), never
by gathering a conversation.  As a message follows one message at most, the
links are chains; pointer doubling finds each message's depth and the greatest
turn before it in as many rounds as the logarithm of the longest chain, and
(greatest turn so far, depth, turn) is a topological order that keeps the given
turns wherever they allow it.  Messages on a cycle never reach a root: they are
marked and stand where their turns put them.

Arguments are validated against the tool's schema (types, required names, nested
objects and lists, allowed values, lengths and bounds; the schemas themselves
are checked before any job) and each message is serialised as canonical JSON:
sorted keys, no spaces.

Defined cases: null identifiers link nothing; of several messages with one
identifier the smallest (turn, content hash) is meant, and the others are marked;
a result without its call is an orphan; arguments that are no JSON object, or
hold numbers beyond all doubles, fail and are written as they stand, those of
unknown tools are not checked further;
null text is an empty one; repeated rows stay; a null conv_id keeps its rows,
unlinked.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_sorted, table
from .scratch import settle, unsettle

#: Types that a schema may name.
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: What a schema may say besides its type, and what that must be.
KEYWORDS = {"required": list, "properties": dict, "additional": bool, "items": (str, dict), "enum": list, "minLength": int, "maxLength": int, "minimum": (int, float), "maximum": (int, float)}


def checked_schema(schema, at: str = "arguments") -> dict:
    """The schema with every part spelled out; an error for what is none, so that no task meets it.

    A part is the name of a type, a list of names, or a mapping of ``type`` and
    ``KEYWORDS``; that of a tool is an object.
    """
    if isinstance(schema, str | list):
        schema = {"type": schema}
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: {schema!r} is no schema")
    kinds = schema.get("type", "object" if at == "arguments" else list(TYPES))
    kinds = [kinds] if isinstance(kinds, str) else kinds
    for kind in kinds if isinstance(kinds, list) else [kinds]:
        if kind not in TYPES:
            raise ValueError(f"{at}: no such type: {kind!r}")
    out: dict = {"type": kinds}
    for word, value in schema.items():
        if word == "type":
            continue
        if word not in KEYWORDS or not isinstance(value, KEYWORDS[word]) or isinstance(value, bool) and word != "additional":
            raise ValueError(f"{at}: {word}: {value!r} is not understood")
        if word == "properties":
            value = {name: checked_schema(part, f"{at}.{name}") for name, part in value.items()}
        elif word == "items":
            value = checked_schema(value, f"{at}[]")
        out[word] = value
    return out


def _same(a, b) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def _wrong(value, schema: dict, at: str) -> str:
    """What is wrong with a value, the first of it in order of names and places; nothing is the empty string."""
    kinds = schema["type"]
    if not any(isinstance(value, TYPES[k]) and (not isinstance(value, bool) or k == "boolean") for k in kinds):
        return f"{at or 'value'} is no {' or '.join(kinds)}"
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        return f"{at or 'value'} is none of those allowed"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at} is too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at} is too long"
    elif isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{at} is too small"
        if value > schema.get("maximum", value):
            return f"{at} is too large"
    elif isinstance(value, list) and "items" in schema:
        return next((w for k, v in enumerate(value) if (w := _wrong(v, schema["items"], f"{at}[{k}]"))), "")
    elif isinstance(value, dict):
        name_of = lambda name: f"{at}.{name}" if at else name
        for name in schema.get("required", ()):
            if name not in value:
                return f"missing {name_of(name)}"
        parts = schema.get("properties", {})
        for name in sorted(value):
            if name not in parts:
                if not schema.get("additional", not parts and bool(at)):
                    return f"unknown {name_of(name)}"
            elif wrong := _wrong(value[name], parts[name], name_of(name)):
                return wrong
    return ""


def check_arguments(raw: str | None, schema: dict | None) -> str:
    """"" if the arguments meet the schema (as ``checked_schema`` gives it), else what is wrong."""
    if schema is None:
        return "unknown tool"
    try:
        found = _loaded(raw or "")
    except (ValueError, RecursionError):
        return "no JSON"
    return _wrong(found, schema, "") if isinstance(found, dict) else "no object"


def _refused(constant: str):
    raise ValueError(constant)  # NaN and the infinities are no JSON


def _finite(number: str) -> float:
    value = float(number)
    if value in (float("inf"), float("-inf")):
        _refused(number)  # would be written as an infinity
    return value


def _loaded(raw: str):
    return json.loads(raw, parse_constant=_refused, parse_float=_finite)


def parsed(raw: str | None):
    """Arguments as JSON where they are a JSON object, else as they stand."""
    try:
        found = _loaded(raw or "null")
    except (ValueError, RecursionError):
        return raw
    return found if isinstance(found, dict) or found is None else raw


_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; lone surrogates, which no text can hold, stay escaped."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _ordered(rows: DataFrame) -> DataFrame:
    """Add depth, top (greatest turn on the way from the root) and cyclic to rows (conv_id, key, parent, turn)."""
    # state: top and depth over the messages from `to` (exclusive) down to the message itself
    state = settle(rows.select("conv_id", "key", F.col("parent").alias("to"), F.lit(0).alias("depth"), F.col("turn").alias("top")))
    total = state.count()
    rounds = 0
    while True:
        open_ = state.filter("to is not null")
        if open_.isEmpty() or 2**rounds > max(total, 1):
            break
        ahead = state.select("conv_id", F.col("key").alias("to"), F.col("to").alias("next"), F.col("depth").alias("d"), F.col("top").alias("t"))
        moved = open_.join(ahead, ["conv_id", "to"]).select("conv_id", "key", F.col("next").alias("to"), (F.col("depth") + F.col("d") + 1).alias("depth"), F.greatest("top", "t").alias("top"))
        before, state = state, settle(state.filter("to is null").unionByName(moved))
        unsettle(before)
        rounds += 1
    return state.select("conv_id", "key", "depth", "top", F.col("to").isNotNull().alias("cyclic"))


def format_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``messages``: conv_id, turn, role, text, own_id, follows_id, tool, arguments.

    Returns a row for each message: conv_id, position (gapless from 0 in the
    conversation), turn, role, status, parent_turn, arguments_error, json.
    """
    frozen = json.dumps({name: checked_schema(schema) for name, schema in schemas.items()})
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.col(c).cast("string").alias(c) for c in ("role", "text", "own_id", "follows_id", "tool", "arguments")]
    )
    content = F.xxhash64("role", "text", "own_id", "follows_id", "tool", "arguments")
    m = settle(m.withColumn("c", content))
    # equal rows get numbers of their own, so that every row has a key
    m = settle(number_sorted(m, ["conv_id", "turn", "c"], [], "copy")).withColumn("key", F.concat_ws(":", "turn", "c", "copy"))
    meant = settle(m.filter("own_id is not null and conv_id is not null").groupBy("conv_id", F.col("own_id").alias("id")).agg(F.min(F.struct("turn", "c", "copy", "key")).alias("who")).select("conv_id", "id", F.col("who.key").alias("parent"), F.col("who.turn").alias("parent_turn")))
    linked = m.join(meant.withColumnRenamed("id", "follows_id"), ["conv_id", "follows_id"], "left")
    owner = meant.select("conv_id", F.col("id").alias("own_id"), F.col("parent").alias("owner"))
    linked = settle(linked.join(owner, ["conv_id", "own_id"], "left"))
    placed = _ordered(linked.select("conv_id", "key", F.when(F.col("parent") != F.col("key"), F.col("parent")).alias("parent"), "turn").filter("conv_id is not null"))
    whole = linked.join(placed, ["conv_id", "key"], "left").withColumn("top", F.when(F.col("cyclic") | F.col("top").isNull(), F.col("turn")).otherwise(F.col("top"))).withColumn("depth", F.when(F.col("cyclic") | F.col("depth").isNull(), 0).otherwise(F.col("depth")))

    @F.pandas_udf("arguments_error string, json string")
    def written(role: pd.Series, text: pd.Series, own: pd.Series, follows: pd.Series, tool: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        known, errors, out = json.loads(frozen), [], []
        for r, t, o, f, name, args in zip(*(s.where(s.notna(), None) for s in (role, text, own, follows, tool, arguments)), strict=True):
            wrong = None if name is None else check_arguments(args, known.get(name))
            row = {"role": r, "content": t or ""}
            if name is not None:
                row["tool_call"] = {"id": o, "name": name, "arguments": parsed(args)}
            elif o is not None:
                row["id"] = o
            if f is not None:
                row["follows"] = f
            errors.append(wrong or None)
            out.append(canonical(row))
        return pd.DataFrame({"arguments_error": errors, "json": out})

    status = (
        F.when(F.col("cyclic"), "cycle")
        .when(F.col("owner").isNotNull() & (F.col("owner") != F.col("key")), "repeated id")
        .when(F.col("follows_id").isNotNull() & F.col("parent").isNull(), "orphan")
        .when(F.col("parent").isNotNull(), "linked")
        .otherwise("root")
    )
    whole = settle(whole.withColumn("w", written("role", "text", "own_id", "follows_id", "tool", "arguments")).select("conv_id", "top", "depth", "turn", "c", "copy", "role", status.alias("status"), "parent_turn", "w.arguments_error", "w.json"))
    return number_sorted(whole, ["conv_id"], ["top", "depth", "turn", "c", "copy"], "position").select("conv_id", "position", "turn", "role", "status", "parent_turn", "arguments_error", "json")


#: The tool that op7 sees in plain conversations.
REPLY = {"reply": {"required": ["prompt", "turn"], "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}}}}


def op7_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations hold no tool calls of their own, so each user turn is read as a call of the tool
    ``reply`` and each assistant turn as the result that answers the call of the turn before; a call
    follows the result of the turn before it."""
    t = table(spark, sf_dir, "conversations")
    call = F.col("role") == "user"
    own = F.concat(F.when(call, "call-").otherwise("result-"), F.col("turn").cast("string"))
    follows = F.concat(F.when(call, "result-").otherwise("call-"), (F.col("turn") - 1).cast("string"))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn"))
    talk = F.col("role").isin("user", "assistant")
    return format_chats(
        t.select("conv_id", "turn", "role", "text", F.when(talk, own).alias("own_id"), F.when(talk & (F.col("turn") > 0), follows).alias("follows_id"), F.when(call, "reply").alias("tool"), F.when(call, arguments).alias("arguments")),
        REPLY,
    )


OP7_SQL = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, role IN ('user', 'assistant') AS talk, role = 'user' AS call FROM conversations),
named AS (
  SELECT *, CASE WHEN talk THEN CASE WHEN call THEN 'call-' ELSE 'result-' END || turn END AS own,
    CASE WHEN talk AND turn > 0 THEN CASE WHEN call THEN 'result-' ELSE 'call-' END || (turn - 1) END AS follows FROM m
), linked AS (SELECT n.*, p.turn AS parent_turn FROM named n LEFT JOIN named p ON p.conv_id = n.conv_id AND p.own = n.follows)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, turn, role,
  CASE WHEN follows IS NULL THEN 'root' WHEN parent_turn IS NULL THEN 'orphan' ELSE 'linked' END AS status, parent_turn, CASE WHEN call AND t = '' THEN 'prompt is too short' WHEN call AND length(t) > 300 THEN 'prompt is too long' WHEN call AND turn < 0 THEN 'turn is too small' END AS arguments_error,
  CAST(CASE WHEN call AND follows IS NULL THEN json_object('content', t, 'role', role, 'tool_call', json_object('arguments', json_object('prompt', t, 'turn', turn), 'id', own, 'name', 'reply'))
    WHEN call THEN json_object('content', t, 'follows', follows, 'role', role, 'tool_call', json_object('arguments', json_object('prompt', t, 'turn', turn), 'id', own, 'name', 'reply'))
    WHEN own IS NULL THEN json_object('content', t, 'role', role)
    WHEN follows IS NULL THEN json_object('content', t, 'id', own, 'role', role)
    ELSE json_object('content', t, 'follows', follows, 'id', own, 'role', role) END AS VARCHAR) AS json
FROM linked
"""
