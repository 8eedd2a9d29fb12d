"""Collocation mining against its SQL and a brute-force version."""

import random
import re
from collections import Counter

import pytest

from riskloom.llm import common as C
from riskloom.llm import op11_collocations as P

SF01 = "/root/testdata/sf0.01"


def brute(rows, support, top):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i:i + k])) for i in range(len(ws) - k + 1))
    f = {x: c for x, c in f.items() if c >= support}
    out = {}
    for (lang, ws), a in f.items():
        if len(ws) < 2:
            continue
        inside = any(L == lang and len(o) > len(ws) and 100 * c >= 80 * a
                     and any(o[i:i + len(ws)] == ws for i in range(len(o) - len(ws) + 1)) for (L, o), c in f.items())
        if not inside:
            cuts = [(2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws))]
            s, k = min(cuts)
            out.setdefault(lang, []).append((" ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], s))
    return sorted((lang, i, *p) for lang, ps in out.items()
                  for i, p in enumerate(sorted(ps, key=lambda p: (-p[5], -p[1], p[0].encode()))[:top], 1))


def mined(docs, support, top, **options):
    return sorted(tuple(r) for r in P.collocations(*P.frequent_phrases(docs, C.Scratch(docs.sparkSession, "t"), support, **options), top).collect())


def test_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    got = P.op11_collocations(spark, SF01)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(con.sql(P.SQL).fetchall()) and len(rows) > 100


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    words = ["A", "a", "b", "é", "日本", "x\x00y", "c-d", "'", "﻿", "zz", "ü\x85v"]
    seps = [" "] * 12 + ["  ", "\t", " \t ", ".", ", ", "\n", "\r\n", "\x0b", "!", "? ", ";:"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(90))) for _ in range(60)]
    texts += [None, "", " \t ", "....", "one same text here", "one same text here", "a b " * 4000, "\n" + "q" * 9000 + " b" * 50]
    langs = [None, "und", "en", "", "fr"]
    return [(None if i % 7 == 0 else i // 2, t, langs[i % 5], "x", "x", "x", "x", "x") for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, shard string, key string, n string, phrase string, `a.b` string"


@pytest.mark.parametrize("shards,slice_bytes", [(3, 1 << 22), (1, 50), (8, 700)])
def test_matches_brute_force(spark, odd_rows, monkeypatch, shards, slice_bytes):
    """Whatever the shards and the slices."""
    monkeypatch.setattr(P, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(P, "HELD_PHRASES", 40)
    want = brute([(r[2], r[1]) for r in odd_rows], 5, 40)
    docs = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    assert mined(docs, 5, 40, shards=shards) == want and len(want) > 50


def test_crowded_bitmap_lets_more_through(spark):
    import numpy as np

    full = np.full((1 << P.BITMAP_BITS) // 8, 255, np.uint8)
    assert P._held(full, np.array([0, 1, 2**64 - 1], np.uint64)).all()
    words = P._Words(b"a b c\nd e\n", np.array([10]), np.array([0]), np.array([2]))
    runs = {k: len(at) for k, (at, _) in enumerate(words.runs(np.array([1], np.uint64), [full] * 3, 4), 1)}
    assert runs == {1: 5, 2: 3, 3: 1, 4: 0}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mined(none, 30, 10) == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "en")], "doc_id long, text string, lang string")
    assert mined(blank, 1, 10) == []
    one = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert mined(one, 1, 10) == [("und", 1, "a b", 1, 1, 1, 2, 1000000)]


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**17
    phrases = spark.createDataFrame([("en", 1, "a", 2 * big), ("en", 1, "b", big + 7), ("en", 2, "a b", big)], "lang string, words int, phrase string, f long")
    totals = spark.createDataFrame([("en", 4 * big)], "lang string, n long")
    assert [tuple(r) for r in P.collocations(phrases, totals).collect()] == [
        ("en", 1, "a b", big, 2 * big, big + 7, 4 * big, 2000000 * big // (3 * big + 7))]
