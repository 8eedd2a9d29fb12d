"""Importance resampling and packing against brute-force versions and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import common as C
from riskloom.llm import op12_packing, op13_importance

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BIG = 2**62
LONG = " ".join(f"w{i % 977}, and\nline" if i % 9 == 0 else f"w{i % 977}" for i in range(60_000))
TEXTS = [None, "", " \t\n ", "one", "one", "one two", LONG, "é ü 日本 😀   x y   z", "a  b   c d", "\x00 x \x7f", "don't  <|endoftext|> stop"]
SCHEMA = ("doc_id long, text string, _m string, _doc string, rank string, score string, start string, ids string, open string, "
          "sequence_id string, offset string, buckets string, `a.b` string")


def awkward(spark, texts):
    rows = [(i, t, *["x"] * 11) for i, t in enumerate(texts)]
    if rows:
        rows += [rows[-1], (None, "lost words without id", *["x"] * 11), (BIG + 1, "one", *["x"] * 11), (BIG + 3, "one", *["x"] * 11)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


# ---- importance resampling


def brute_features(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(ws), [zlib.crc32(" ".join(ws[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def brute_scores(docs, target):
    feats = [brute_features(t) for _, t in docs]
    s, t = Counter(), Counter()
    for _, f in feats:
        s.update(f)
    for x in target:
        t.update(brute_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for (doc, _), (n, f) in zip(docs, feats, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([doc, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    best = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(best[: 5 * len(best) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_importance_matches_brute_force(spark, sf):
    docs = [tuple(r) for r in C.table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in C.table(spark, sf, "benchmark").collect()]
    got = op13_importance.op13_importance(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, brute_scores(docs, target)))


def test_importance_buckets_of_awkward_texts():
    for t in [*TEXTS, "A-B_c", "a" * 5000 + " " + "b" * 5000, "ß ẞ İ K"]:
        assert sorted(op13_importance.text_buckets(t).tolist()) == sorted(brute_features(t)[1])


def test_importance_draw_on_awkward_tables(spark):
    df = awkward(spark, TEXTS + [" ".join(random.Random(i).choices("abcdefghij", k=30)) for i in range(60)])
    target = spark.createDataFrame([("a b c d e",), (None,), ("",)], "text string")
    rows = df.select("doc_id", "text").collect()
    want = brute_scores([tuple(r) for r in rows], ["a b c d e", None, ""])
    scratch = C.Scratch(spark, "t")
    inner = df.select("doc_id", F.monotonically_increasing_id().alias("_m"), "text")
    got = op13_importance.ranked(op13_importance.scored_documents(inner, target, scratch), scratch)
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == sorted(map(str, want))
    drawn = op13_importance.resample(df, target, percent=50)
    assert drawn.columns == df.columns and drawn.count() == sum(len(brute_features(r["text"])[1]) >= 57 for r in rows) * 50 // 100
    assert op13_importance.resample(df.limit(0), target).count() == 0
    assert op13_importance.resample(df, target.limit(0)).count() > 0


def test_importance_ranks_equal_scores(spark):
    """A third of all rows may hold one score: ranks stay gapless over the ranges."""
    rows = [(i % 3 if i < 3000 else i, i, 25, 7 if i < 3000 else i) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, _m long, n_words long, score long").repartition(5)
    got = {r["_m"]: r["rank"] for r in op13_importance.ranked(df, C.Scratch(spark, "t"), percent=90).collect()}
    order = sorted(rows, key=lambda r: (-r[3], r[0], r[1]))
    assert [got[r[1]] for r in order[:8100]] == list(range(1, 8101)) and all(got[r[1]] is None for r in order[8100:])


# ---- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def check_packing(pieces, want, length, max_gap):
    """Every id in exactly one piece; sequences gapless, within length, nearly full."""
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for doc, start, ids, total, seq, offset in pieces:
        assert len(ids)
        per_doc[doc].append((start, ids, total))
        per_seq[seq].append((offset, len(ids)))
    got = {}
    for doc, ps in per_doc.items():
        ps.sort(key=lambda p: p[0])
        at, ids = 0, []
        for start, piece, total in ps:
            assert start == at and total == ps[0][2]
            at += len(piece)
            ids += list(piece)
        assert at == ps[0][2]
        got[doc] = ids
    assert got == want
    gaps = []
    for ps in per_seq.values():
        at = 0
        for offset, n in sorted(ps):
            assert offset == at
            at += n
        assert at <= length
        gaps.append(length - at)
    assert sum(g > max_gap for g in gaps) <= 1
    return gaps


def test_packing_matches_tokenizer(spark, tokenizer):
    docs = C.table(spark, SF01, "documents").select("doc_id", "text").repartition(7)
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = op12_packing.pack(docs, C.Scratch(spark, "t"))
    gaps = check_packing([tuple(r) for r in pieces.collect()], want, 1024, op12_packing.MAX_GAP)
    assert sum(gaps) <= 0.01 * sum(map(len, want.values()))
    rows = op12_packing.op12_packing(spark, SF01).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, want.values()))
    for r in rows:
        ids = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(want[r["doc_id"]])


def test_packing_of_awkward_tables(spark, tokenizer):
    df = awkward(spark, TEXTS).withColumn("n", F.monotonically_increasing_id())
    got = op12_packing.pack(df, C.Scratch(spark, "t"), length=16, windows=3, fan=2, max_gap=1)
    assert got.columns == ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in got.collect()} >= {None, BIG + 1, BIG + 3}
    unique = df.select(F.col("n").alias("doc_id"), "text")
    pieces = op12_packing.pack(unique, C.Scratch(spark, "t"), length=16, windows=3, fan=2, max_gap=1)
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in unique.collect()}
    check_packing([tuple(r) for r in pieces.collect()], want, 16, 1)
    assert op12_packing.pack(df.limit(0), C.Scratch(spark, "t")).count() == 0


def test_packing_rounds(spark):
    """Many partitions, few windows: leftovers go through several rounds."""
    docs = spark.createDataFrame([(i, " ".join(["ab"] * (i % 23))) for i in range(400)], "doc_id long, text string").repartition(40)
    pieces = op12_packing.pack(docs, C.Scratch(spark, "t"), length=64, windows=2, fan=2, max_gap=2)
    rows = [tuple(r) for r in pieces.collect()]
    want = {d: [i for x in sorted(r[1:3] for r in rows if r[0] == d) for i in x[1]] for d in range(400)}
    check_packing(rows, want, 64, 2)
    assert len({r[4] >> 54 for r in rows}) >= 4
    packed = {r["sequence_id"]: r for r in op12_packing.sequences(pieces, 64).collect()}
    for r in packed.values():
        n = r["n_tokens"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 64) and r["starts"][0] == 0
    assert sum(r["n_tokens"] for r in packed.values()) == sum(len(r[2]) for r in rows)


def test_ids_are_those_of_the_tokenizer(spark, tokenizer):
    rng = random.Random(5)
    alphabet = "ab'stZ09.,!<|>_- \t\n\r\x0b\x85\u00a0\u3000\xad éß日́😀\x00١Ⅷ"
    texts = ["".join(rng.choices(alphabet + " " * 6, k=rng.randrange(60))) for _ in range(5000)] + [t or "" for t in TEXTS]
    texts += [f"{a}<|endoftext|>{b}" for a in ("", " ", "x", "x ", "\n") for b in ("", " ", "y", "  y")] + ["q" * 30_000, " " * 30_000]
    texts += [r["text"] or "" for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"))
              for r in C.table(spark, SF01, t).select(F.col(c).alias("text")).collect()]
    assert [op12_packing.encode(t).tolist() for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
