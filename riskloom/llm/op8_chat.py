"""Chat formatting with linked tool calls.

A message's text may hold blocks ``<tool_call>{...}</tool_call>`` with a JSON
object of id, name, arguments and, if the call waits for others, after (their
ids; a string argument "$id" or "$id.path" counts as well), and blocks
``<tool_result>{...}</tool_result>`` with tool_call_id and content.  A system message
declares tools in blocks ``<tool_schema>{...}</tool_schema>`` with name and
parameters, a JSON schema.  Calls and
results are hash-joined on (conversation, identifier).  Calls are ordered
topologically: rounds of joins raise a call one level above what it waits for,
until nothing changes; what is left after that waits in a circle.  Arguments are
checked against the JSON schema that is joined by (conversation, tool name), else
against the one that the caller gives for the tool.  Each message becomes one line of
canonical JSON (sorted keys, no blanks, no escapes of printable characters) with
its calls in that order, each with its result.

One row per message, never per conversation: a conversation may hold a third of
all rows.  Identifiers belong to a conversation; of calls, or results, with one
identifier the first by turn counts and others are marked as repeated.

Defined results: null text is empty content; a null role or turn is null in the
JSON; a block that is no JSON object stays in the content, and NaN, infinities and
numbers beyond all doubles are no JSON; a lone surrogate becomes a question mark;
integers of any length are compared as integers; a result without its
call, and a call without result, are marked as such; ``after`` an unknown call is
no wait; schema blocks stay in the content, those of other roles, without a name or
without an object of parameters declare nothing, and of several for one tool the first
by turn counts, for the whole conversation; a schema that is none, such as a bound that
is no number, gives the problem ``bad schema``; a null conv_id is a conversation of its own; repeated rows are messages
of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm import common as C

_BLOCK = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
_SCHEMA = re.compile(r"<tool_schema>(.*?)</tool_schema>", re.S)
_REFERENCE = re.compile(r"^\$([^.$\s]+)")

EVENTS = ("_m long, _c string, turn long, seq int, kind string, id string, name string, arguments string, "
          "waits array<string>, content string")


def clean(text: str) -> str:
    """A lone surrogate, which no encoding has, becomes a question mark."""
    return text.encode("utf-8", "replace").decode("utf-8")


def canonical(value) -> str:
    return clean(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _finite(number: str) -> float:
    x = float(number)
    if x in (float("inf"), float("-inf")):
        raise ValueError("beyond all doubles")
    return x


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str):
    """A JSON value; NaN, infinities and numbers beyond all doubles are none."""
    return json.loads(text, parse_constant=_no_number, parse_float=_finite)


def _references(value) -> set[str]:
    """Ids that strings anywhere in the arguments refer to."""
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            found.update(_REFERENCE.findall(v))
        elif isinstance(v, dict):
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)
    return found


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def schema_problem(value, schema, at: str = "$") -> str | None:
    """The first way in which a value breaks a schema (type, enum, properties,
    required, additionalProperties, items, minimum, maximum), or None."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []

    def is_kind(k: str) -> bool:
        if k in ("number", "integer"):
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                return False
            return k == "number" or isinstance(value, int) or value.is_integer()
        return isinstance(value, _TYPES.get(k, object))

    if kinds and not any(map(is_kind, kinds)):
        return f"{at}: not {'/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
            return f"{at}: out of range"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in sorted(schema.get("required", ())):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if k in known:
                bad = schema_problem(value[k], known[k], f"{at}.{k}")
                if bad:
                    return bad
            elif schema.get("additionalProperties") is False:
                return f"{at}.{k}: unknown"
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            bad = schema_problem(v, schema["items"], f"{at}[{i}]")
            if bad:
                return bad
    return None


def parse_blocks(text: str | None) -> tuple[str, list[tuple[str, dict]]]:
    """Content without its tool blocks, and the blocks (kind, object)."""
    if not text or "<tool_" not in text:
        return text or "", []
    blocks = []

    def take(m: re.Match) -> str:
        try:
            obj = parse(m[2])
        except (ValueError, RecursionError):
            obj = None
        if not isinstance(obj, dict):
            return m[0]
        blocks.append((m[1], obj))
        return ""

    return _BLOCK.sub(take, text), blocks


def parse_schemas(text: str | None) -> list[tuple[str, dict]]:
    """The tools (name, schema of the arguments) that a system message declares."""
    found = []
    for block in _SCHEMA.findall(text or ""):
        try:
            obj = parse(block)
        except (ValueError, RecursionError):
            continue
        if isinstance(obj, dict) and isinstance(obj.get("parameters"), dict) and obj.get("name") is not None:
            found.append((_text(obj["name"]), obj["parameters"]))
    return found


def argument_problem(arguments: str, schema) -> str | None:
    """What is wrong with a call's arguments; a schema may be anything that JSON can say."""
    try:
        bad = schema_problem(json.loads(arguments), schema)
    except (AttributeError, TypeError, ValueError, RecursionError):
        return "bad schema"
    return None if bad is None else clean(bad)


def _text(v) -> str | None:
    return None if v is None else clean(v) if isinstance(v, str) else canonical(v)


def _events(batches):
    for pdf in batches:
        rows = []
        for m, c, turn, role, text in zip(pdf["_m"], pdf["_c"], pdf["turn"], pdf["role"], pdf["text"], strict=True):
            turn = None if pd.isna(turn) else int(turn)
            for seq, (kind, obj) in enumerate(parse_blocks(text)[1]):
                if kind == "call":
                    args, name = obj.get("arguments"), _text(obj.get("name"))
                    args = {} if args is None else args
                    after = obj.get("after")
                    waits = {_text(x) for x in after if x is not None} if isinstance(after, list) else set()
                    rows.append((m, c, turn, seq, kind, _text(obj.get("id")), name, canonical(args),
                                 sorted(waits | {clean(x) for x in _references(args)}), None))
                else:
                    rows.append((m, c, turn, seq, kind, _text(obj.get("tool_call_id")), None, None, [],
                                 canonical(obj.get("content"))))
            for seq, (name, schema) in enumerate(parse_schemas(text) if role == "system" else ()):
                rows.append((m, c, turn, seq, "schema", name, name, None, [], canonical(schema)))
        names = [x.split()[0] for x in EVENTS.split(", ")]
        out = pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(names)})
        yield out.astype({"_m": "int64", "seq": "int32"})


def _levels(calls: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(_c, id, level): how many calls must come before, one after the other;
    null in a circle and behind one."""
    waits = calls.select("_c", "id", F.explode("waits").alias("dep")).distinct()
    known = calls.select("_c", F.col("id").alias("dep"))
    waits = scratch.cut(waits.join(known, ["_c", "dep"]), "waits")
    level = scratch.cut(calls.join(waits, ["_c", "id"], "left_anti").select("_c", "id", F.lit(0).alias("level")), "level0")
    open_ = waits.select("_c", "id").distinct()
    k = 0
    while open_.limit(1).count():
        k += 1
        # Calls all of whose waits have a level.
        state = (waits.join(open_, ["_c", "id"], "left_semi")
                 .join(level.select("_c", F.col("id").alias("dep"), "level"), ["_c", "dep"], "left")
                 .groupBy("_c", "id").agg(F.max("level").alias("top"), F.count_if(F.col("level").isNull()).alias("missing")))
        state = scratch.cut(state, f"state{k}")
        done = state.where("missing = 0").select("_c", "id", (F.col("top") + 1).cast("int").alias("level"))
        if not done.limit(1).count():
            break
        level = scratch.cut(level.unionByName(done), f"level{k}")
        open_ = state.where("missing > 0").select("_c", "id")
    return level


def _checked(calls: DataFrame, declared: DataFrame, given: Mapping[str, dict]) -> DataFrame:
    """Calls with ``problem``: their arguments against the schema that their conversation
    declares for the tool, else against the given one; null if they fit."""
    @F.pandas_udf("string")
    def problem(names: pd.Series, arguments: pd.Series, schemas: pd.Series) -> pd.Series:
        read: dict = {}
        out = []
        for name, args, own in zip(names, arguments, schemas, strict=True):
            if own is not None and own not in read:
                read[own] = json.loads(own)
            schema = given.get(name) if own is None else read[own]
            out.append("no schema" if schema is None else argument_problem(args, schema))
        return pd.Series(out, dtype=object)

    return (calls.join(declared, ["_c", "name"], "left")
            .withColumn("problem", problem("name", "arguments", "schema")).drop("schema"))


def _lines(batches):
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            content, _ = parse_blocks(r.text)
            events = [] if r.events is None else [dict(e) if not isinstance(e, dict) else e for e in r.events]
            calls = [e for e in events if e["kind"] == "call"]
            calls.sort(key=lambda e: (e["level"] is None or pd.isna(e["level"]), 0 if e["level"] is None or pd.isna(e["level"]) else e["level"],
                                      e["id"] is None, e["id"] or "", e["seq"]))
            results = sorted((e for e in events if e["kind"] == "result"), key=lambda e: e["seq"])
            line = {
                "conv_id": None if pd.isna(r.conv_id) else int(r.conv_id), "turn": None if pd.isna(r.turn) else int(r.turn),
                "role": r.role, "content": content,
                "tool_calls": [{"id": e["id"], "name": e["name"], "arguments": json.loads(e["arguments"]), "problem": e["problem"],
                                "status": e["status"], "result": json.loads(e["found"]) if e["found"] is not None else None} for e in calls],
                "tool_results": [{"tool_call_id": e["id"], "status": e["status"]} for e in results],
            }
            out.append((line["conv_id"], line["turn"], r.role, len(calls), sum(e["status"] == "linked" for e in calls),
                        sum(e["problem"] is None for e in calls), sum(e["status"] == "orphan" for e in results), canonical(line)))
        names = ["conv_id", "turn", "role", "n_calls", "n_linked", "n_valid", "n_orphans", "json"]
        yield pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(names)})


def format_chats(messages: DataFrame, schemas: Mapping[str, dict] | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, n_calls, n_linked (calls with a
    result), n_valid (calls whose arguments fit a known schema), n_orphans
    (results without a call), json."""
    scratch, schemas = C.Scratch(messages.sparkSession, "chat"), dict(schemas or {})
    keyed = scratch.cut(messages.select(F.monotonically_increasing_id().alias("_m"), C.group_key("conv_id").alias("_c"),
                                        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                        "role", "text"), "keyed")
    marked = keyed.where(F.contains("text", F.lit("<tool_"))).select("_m", "_c", C.as_text("turn"), "role", "text")
    events = scratch.cut(marked.mapInPandas(_events, EVENTS), "events")
    # The first of an identifier counts; identifiers are few in a conversation's key.
    w = Window.partitionBy("_c", "kind", "id").orderBy(F.asc_nulls_last("turn"), "_m", "seq")
    events = scratch.cut(events.withColumn("nth", F.row_number().over(w)), "numbered")
    calls = events.where("kind = 'call' AND id IS NOT NULL AND nth = 1")
    results = events.where("kind = 'result' AND id IS NOT NULL AND nth = 1").select("_c", "id", F.col("content").alias("found"))
    level = _levels(calls.select("_c", "id", "waits"), scratch)
    declared = events.where("kind = 'schema' AND nth = 1").select("_c", "name", F.col("content").alias("schema"))
    checked = _checked(events.where("kind = 'call'"), declared, schemas)
    linked = (checked.join(results.hint("shuffle_hash"), ["_c", "id"], "left").join(level, ["_c", "id"], "left")
              .withColumn("status", F.when(F.col("id").isNull(), "no id").when(F.col("nth") > 1, "repeated")
                          .when(F.col("level").isNull(), "circular").when(F.col("found").isNull(), "no result").otherwise("linked"))
              .withColumn("found", F.when(F.col("nth") == 1, F.col("found"))))
    called = calls.select("_c", "id", F.lit(True).alias("called"))
    back = (events.where("kind = 'result'").join(called.hint("shuffle_hash"), ["_c", "id"], "left")
            .withColumn("problem", F.lit(None).cast("string"))
            .withColumn("status", F.when(F.col("called").isNull(), "orphan").when(F.col("nth") > 1, "repeated").otherwise("linked"))
            .withColumn("found", F.lit(None).cast("string")).withColumn("level", F.lit(None).cast("int")))
    cols = ["kind", "seq", "id", "name", "arguments", "problem", "status", "found", "level"]
    # A message's own blocks: bounded by its text.
    per = linked.select("_m", *cols).unionByName(back.select("_m", *cols)).groupBy("_m").agg(F.collect_list(F.struct(*cols)).alias("events"))
    return keyed.join(per, "_m", "left").select(C.as_text("conv_id"), C.as_text("turn"), "role", "text", "events").mapInPandas(
        _lines, "conv_id long, turn long, role string, n_calls long, n_linked long, n_valid long, n_orphans long, json string")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    return format_chats(C.table(spark, sf_dir, "conversations"))
