"""op8_chat checks arguments against the schemas that the conversations declare."""

import json

from riskloom.llm import op8_chat

NUMBER = {"type": "object", "properties": {"x": {"type": "integer", "minimum": 1}}, "required": ["x"]}
TEXT = {"type": "object", "properties": {"x": {"type": "string"}}}


def tool(name, parameters):
    return f"<tool_schema>{json.dumps({'name': name, 'parameters': parameters})}</tool_schema>"


def call(i, name, **arguments):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': arguments})}</tool_call>"


def test_query_checks_arguments_against_declared_schemas(spark, tmp_path):
    first = "You have tools. " + tool("get", NUMBER)
    rows = [
        (1, 0, "system", first), (1, 1, "system", tool("get", TEXT) + tool("odd", {"type": "object", "properties": {"x": {"minimum": "low"}}})),
        (1, 2, "assistant", call("a", "get", x=3) + call("b", "get", x="3") + call("c", "get", x=0) + call("d", "put", x=1) + call("e", "odd", x=1)),
        (2, 0, "user", tool("put", NUMBER)), (2, 1, "system", tool("get", TEXT)), (2, 2, "assistant", call("a", "get", x="3") + call("b", "put", x=1)),
        (None, 0, "system", tool("get", NUMBER) + "<tool_schema>no JSON</tool_schema>" + tool("put", None)), (None, 1, "assistant", call("a", "get") + call("b", "put")),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {(r["conv_id"], r["turn"]): r for r in op8_chat.op8_chat(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)

    def problems(*key):
        return {c["id"]: c["problem"] for c in json.loads(out[key]["json"])["tool_calls"]}

    assert problems(1, 2) == {"a": None, "b": "$.x: not integer", "c": "$.x: out of range", "d": "no schema", "e": "bad schema"}
    assert problems(2, 2) == {"a": None, "b": "no schema"}
    assert problems(None, 1) == {"a": "$.x: missing", "b": "no schema"}
    assert {k: r["n_valid"] for k, r in out.items() if r["n_calls"]} == {(1, 2): 1, (2, 2): 1, (None, 1): 0}
    assert json.loads(out[1, 0]["json"])["content"] == first  # the declaration is part of the prompt


def test_declared_schema_comes_before_a_given_one(spark):
    rows = [(1, 0, "system", tool("get", NUMBER)), (1, 1, "assistant", call("a", "get", x="3")), (2, 0, "assistant", call("a", "get", x="3"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r["n_valid"] for r in op8_chat.format_chats(df, {"get": TEXT}).collect()}
    assert out == {(1, 0): 0, (1, 1): 0, (2, 0): 1}
