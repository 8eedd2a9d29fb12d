"""Every operator on awkward tables: nulls, empty and very long texts, ties,
repeated rows, other columns with names the operators use themselves, no rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import common as C
from riskloom.llm import (op1_line_dedup, op2_sharding, op3_quality, op4_embedding_dedup, op5_minhash_dedup, op6_pii,
                          op7_decontamination, op8_chat, op9_mixing, op10_toxicity)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _m string, _doc string, drop string, "
          "size string, shard string, slot string, `a.b` string, cid string")
LONG = " ".join(f"w{i % 977} and line\n" if i % 9 == 0 else f"w{i % 977}" for i in range(60_000))
TEXTS = [None, "", " \t\n ", "one", "one", LONG, "The same long line here\nother words are here", "The same long line here",
         "\n\n\n", "é ü 日本 😀   x", "a b c d"]


def frame(spark, texts):
    extra = ["x"] * 8
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", len(t or ""), *extra) for i, t in enumerate(texts)]
    if rows:
        rows += [rows[-1], (None, "lost words without id", None, None, None, *extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def labels(spark):
    return spark.createDataFrame([(1, 1, None), (2, None, 0), (3, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "The same long line here\nother words are here"), (2, None), (3, ""), (4, "a b c d"), (None, "one")],
                                 "item_id long, text string")


def test_line_dedup(spark, docs, none):
    out = {r["doc_id"]: r for r in op1_line_dedup.dedup_lines(docs).collect()}
    assert out[6]["text"] == TEXTS[6] and out[7]["text"] == "" and out[5]["a.b"] == "x" and out[0]["text"] is None
    assert out[None]["text"] == "lost words without id" and out[6].asDict().keys() == set(docs.columns)
    assert op1_line_dedup.dedup_lines(docs).count() == docs.count()
    assert op1_line_dedup.dedup_lines(none).count() == 0


def test_sharding(spark, docs, none):
    out = op2_sharding.shard_documents(docs, 5)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = out.collect()
    sizes = sorted(sum(r["shard"] == s for r in rows) for s in range(5))
    assert len(rows) == docs.count() and sizes[-1] - sizes[0] <= 1
    for s in range(5):
        got = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert got == list(range(len(got)))
    assert op2_sharding.shard_documents(none, 5).count() == 0
    ix = op2_sharding.shard_index(docs, 24).collect()
    assert len(ix) == docs.count() and {r["size"] for r in ix if r["doc_id"] in (0, 1)} == {8}


def test_classifiers(spark, docs, none):
    measured = op3_quality.measure(docs)
    model = op3_quality.fit(measured, labels(spark))
    assert {r["score"] for r in op3_quality.score_measured(measured, model).collect()} == {0.5}  # too few labels
    lex = op10_toxicity.fit(docs, labels(spark))
    scores = op10_toxicity.score_documents(docs, lex).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert op10_toxicity.fit(none, labels(spark)).entries == {}
    assert op10_toxicity.score_documents(none, lex).count() == op3_quality.measure(none).count() == 0
    assert op10_toxicity.reject_toxic(docs, lex).columns == docs.columns


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [1e30, 1e30]), (12, [1e-30, 1e-30]), (12, [1e-30, 1e-30])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit("x"))
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in op4_embedding_dedup.links_and_components(
        vectors, C.Scratch(spark, "t")).collect()), key=str)
    assert out == sorted([(1, 2, 1), (2, 2, 1), (10, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9),
                          (None, 0, None), (11, 2, 11), (12, 2, 11), (12, 2, 11)], key=str)
    assert op4_embedding_dedup.links_and_components(vectors.limit(0), C.Scratch(spark, "t")).count() == 0


def test_minhash(spark, docs, none):
    out = op5_minhash_dedup.near_duplicates(docs.withColumnRenamed("doc_id", "id"), C.Scratch(spark, "t")).collect()
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[3] == (1, 3) and got[4] == (1, 3) and got[None][1] is None and got[10] == (1, 10)
    kept = op5_minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]
    assert op5_minhash_dedup.drop_near_duplicates(none).count() == 0


def test_pii(spark, docs, none):
    out = op6_pii.find_spans(docs, C.Scratch(spark, "t")).collect()
    assert len(out) == docs.count() and {r["spans"] for r in out} == {""}
    assert {r["base_sha256"] for r in out} == {hashlib.sha256(b"").hexdigest()}
    assert op6_pii.find_spans(none, C.Scratch(spark, "t")).count() == 0


def test_decontamination(spark, docs, none):
    got = {(r["doc_id"], r["item_id"]) for r in op7_decontamination.matches(docs, items(spark), "doc_id").collect()}
    assert got == {(6, 1), (10, 4), (3, None), (4, None)}
    clean = op7_decontamination.decontaminate(docs, items(spark))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {None, 0, 1, 2, 5, 7, 8, 9}
    assert op7_decontamination.decontaminate(none, items(spark)).count() == 0
    assert op7_decontamination.decontaminate(docs, items(spark).limit(0)).count() == docs.count()


def test_chat(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, _m string")
    assert op8_chat.format_chats(none).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, "x"), (1, 1, "user", "", "x"), (1, 1, "user", "", "x")], none.schema)
    assert sorted(r["json"] for r in op8_chat.format_chats(odd).collect())[2].startswith('{"content":"","conv_id":null')


def test_mixing(spark, docs, none):
    out = op9_mixing.mix_documents(docs, block_words=16)
    assert out.columns == docs.columns and out.count()
    assert op9_mixing.mix_documents(none).count() == 0
    blank = spark.createDataFrame([(1, " ", None), (2, None, "a")], "doc_id long, text string, source string")
    assert op9_mixing.mix_documents(blank).count() == 0
