"""Large ids beside a missing one come back unchanged from every operator; tool calls
against a brute-force linker and on malformed blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import common as C
from riskloom.llm import (op1_line_dedup, op2_sharding, op3_quality, op4_embedding_dedup, op5_minhash_dedup, op6_pii, op7_decontamination,
                          op8_chat, op9_mixing, op10_toxicity, op12_packing, op13_importance)

A, B = 2**62 + 1, 2**62 + 3
IDS = {None, A, B}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder whose ids are missing or beyond 2**53."""
    d = str(tmp_path_factory.mktemp("ids"))
    texts = ["some words of the first text that are long enough to count here", "other words of a second text that nobody else holds at all",
             "a third text of its own with words that are not in the others"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip([None, A, B], texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(A, 1, 0), (B, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is in a document, is it? No")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(None, None, "user", "x"), (A, B, "user", "y"), (B, A, "user", "z")], "conv_id long, turn long, role string, text string"
                          ).coalesce(1).write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(None, [1.0, 0.0], 0), (A, [0.0, 1.0], 0), (B, [1.0, 1.0], 0)], "vec_id long, embedding array<float>, label int"
                          ).coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("query", [op1_line_dedup.op1_line_dedup, op2_sharding.op2_sharding, op3_quality.op3_quality, op5_minhash_dedup.op5_minhash_dedup,
                                   op6_pii.op6_pii, op9_mixing.op9_mixing, op10_toxicity.op10_toxicity, op12_packing.op12_packing,
                                   op13_importance.op13_importance], ids=lambda f: f.__name__)
def test_document_ids(spark, folder, query):
    assert {r["doc_id"] for r in query(spark, folder).collect()} == IDS


def test_other_ids(spark, folder):
    assert {r["vec_id"] for r in op4_embedding_dedup.op4_embedding_dedup(spark, folder).collect()} == IDS
    chats = op8_chat.op8_chat(spark, folder).collect()
    assert {(r["conv_id"], r["turn"]) for r in chats} == {(None, None), (A, B), (B, A)}
    assert {json.loads(r["json"])["conv_id"] for r in chats} == IDS
    assert {r["component_id"] for r in op5_minhash_dedup.op5_minhash_dedup(spark, folder).collect()} == IDS


def test_ids_through_the_pipeline(spark, folder):
    docs = C.table(spark, folder, "documents")
    assert {r["doc_id"] for r in op9_mixing.mix_documents(docs).collect()} == IDS
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == IDS


# ---- tool calls

SCHEMAS = {"f": {"type": "object", "properties": {"x": {"type": "integer", "maximum": 10**400}}, "required": ["x"]}}


def block(kind, **obj):
    return f"<tool_{kind}>{json.dumps(obj)}</tool_{kind}>"


def test_malformed_and_extreme_blocks(spark):
    huge = "9" * 400
    texts = ['<tool_call>{"id": "a", "name": "f", "arguments": {"x": "\\ud800"}}</tool_call>', f'<tool_call>{{"id": "b", "name": "f", "arguments": {{"x": {huge}}}}}</tool_call>',
             '<tool_call>{"id": "c", "arguments": NaN}</tool_call>', '<tool_call>{"id": "d", "arguments": 1e400}</tool_call>', "<tool_call>{]</tool_call>",
             '<tool_call>{"id": "e", "name": "f", "arguments": {"x": 2.0}}</tool_call>', "long " * 100_000 + block("call", id="g", name="f", arguments={"x": 10**400 + 1})]
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = {r["turn"]: json.loads(r["json"], parse_constant=lambda c: pytest.fail(c)) for r in op8_chat.format_chats(df, SCHEMAS).collect()}
    problems = {t: [c["problem"] for c in x["tool_calls"]] for t, x in out.items()}
    assert problems == {0: ["$.x: not integer"], 1: [None], 2: [], 3: [], 4: [], 5: [None], 6: ["$.x: out of range"]}
    assert all(out[t]["content"] == texts[t] for t in (2, 3, 4)) and out[1]["tool_calls"][0]["arguments"]["x"] == int(huge)
    assert out[0]["tool_calls"][0]["arguments"]["x"] == "?"


def brute_links(rows):
    """Status of every call and result, and level of every linked call, of one conversation."""
    calls, results, out = {}, {}, []
    for turn, blocks in rows:
        for kind, obj in blocks:
            name = obj["id"] if kind == "call" else obj["tool_call_id"]
            known = calls if kind == "call" else results
            out.append((turn, kind, name, name in known))
            known.setdefault(name, obj)
    level = {}
    for _ in calls:
        for i, c in calls.items():
            waits = [w for w in c["after"] if w in calls]
            if i not in level and all(w in level for w in waits):
                level[i] = 1 + max((level[w] for w in waits), default=-1)
    def status(kind, name, again):
        if kind == "result":
            return "orphan" if name not in calls else "repeated" if again else "linked"
        return "repeated" if again else "circular" if name not in level else "linked" if name in results else "no result"
    return {(t, k, n, a): status(k, n, a) for t, k, n, a in out}, level


def test_links_match_brute_force(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for conv in range(12):
        turns = []
        for turn in range(14):
            blocks = []
            for _ in range(rng.randrange(3)):
                if rng.random() < 0.6:
                    blocks.append(("call", {"id": f"c{rng.randrange(12)}", "name": "f", "arguments": {}, "after": [f"c{rng.randrange(14)}" for _ in range(rng.randrange(2))]}))
                else:
                    blocks.append(("result", {"tool_call_id": f"c{rng.randrange(14)}", "content": turn}))
            turns.append((turn, blocks))
            rows.append((conv, turn, "assistant", "text" + "".join(block(k, **o) for k, o in blocks)))
        want[conv] = brute_links(turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    seen = set()
    for r in op8_chat.format_chats(df, SCHEMAS).collect():
        line, (status, level) = json.loads(r["json"]), want[r["conv_id"]]
        for kind, key, events in (("call", "id", line["tool_calls"]), ("result", "tool_call_id", line["tool_results"])):
            for e in events:
                found = [s for (t, k, n, a), s in status.items() if (t, k, n) == (r["turn"], kind, e[key])]
                assert e["status"] in found
                seen.add(e["status"])
        order = [level.get(c["id"], 99) for c in line["tool_calls"]]
        assert order == sorted(order)
    assert seen == {"linked", "no result", "repeated", "circular", "orphan"}
