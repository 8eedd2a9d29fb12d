"""The corpus operators against brute-force versions on the driver's tables."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import common as C
from riskloom.llm import (op1_line_dedup, op2_sharding, op3_quality, op4_embedding_dedup, op5_minhash_dedup, op6_pii,
                          op7_decontamination, op8_chat, op9_mixing, op10_toxicity, queries)

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(C.WORD_CLASS)


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def docs(spark):
    return C.table(spark, SF01, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_lines_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    want = {r[0]: r for r in con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.oracle_sql()['op1_line_dedup']})").fetchall()}
    got = {r[0]: tuple(r) for r in op1_line_dedup.op1_line_dedup(spark, SF01).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert got == want and sum(r[2] for r in got.values()) > 0


@pytest.mark.parametrize("n_batches,fanout", [(1, 2), (5, 2), (6, 3)])
def test_lines_do_not_depend_on_batches(spark, docs, n_batches, fanout):
    a = op1_line_dedup.dropped_lines(docs, C.Scratch(spark, "t"), n_batches=n_batches, fanout=fanout)
    b = op1_line_dedup.dropped_lines(docs, C.Scratch(spark, "t"))
    key = lambda df: {(r["_d"], tuple(sorted(r["drop"]))) for r in df.collect()}
    assert key(a) == key(b)


def test_sharding_laws(spark, docs, texts):
    rows = op2_sharding.op2_sharding(spark, SF01).collect()
    assert {r["doc_id"] for r in rows} == texts.keys() and len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "rows"
    per = Counter(r["shard"] for r in rows)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    mix = Counter((r["shard"], r["source"]) for r in rows)
    for source, n in Counter(r["source"] for r in rows).items():
        assert all(abs(mix[s, source] - n / 24) < 1.5 for s in range(24))  # every shard matches the mixture


@pytest.mark.parametrize("module,query,label,least", [(op3_quality, "op3_quality", "quality", 0.95), (op10_toxicity, "op10_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, module, query, label, least):
    rows = {r["doc_id"]: r for r in getattr(module, query)(spark, SF01).collect()}
    marked = {r["doc_id"]: r[label] for r in C.table(spark, SF01, "labels").collect()}
    held = [d for d in marked if rows[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert np.mean([rows[d]["predicted"] == marked[d] for d in held]) >= least


def test_quality_uses_no_held_out_label(spark, docs):
    labels = C.table(spark, SF01, "labels")
    turned = labels.withColumn("quality", F.when(op10_toxicity.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    measured = op3_quality.measure(docs).cache()
    a, b = (op3_quality.fit(measured, x) for x in (labels, turned))
    np.testing.assert_allclose(a.mean, b.mean)
    assert a.scale == pytest.approx(b.scale)


def test_folding_and_exceptions():
    lex = op10_toxicity.Lexicon({"idiot": 5.0, "scum ": 5.0}, {"idiotic joke"})
    f = lambda t: op10_toxicity.features([t], lex)[0, 2]
    assert f("you IDIOT") > 0 and f("you 1d10t!") > 0 and f("уou іdіоt") > 0 and f("id​iot") > 0 and f("ídïot$$$") > 0
    assert f("scumbag") == 0 and f("an idiotic   joke, really") == 0 and f("") == 0 and f("videotape") == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:20] + 0.07 * rng.normal(size=(20, 24)), np.repeat(base[:2], 15, axis=0) + 0.05 * rng.normal(size=(30, 24)), base[3:6]])
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min(label[i], *label[link[i]]) if link[i].any() else label[i] for i in range(len(x))])
    rows = op4_embedding_dedup.links_and_components(df, C.Scratch(spark, "t"), tile_rows=16).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == {i: (int(link[i].sum()), int(label[i])) for i in range(len(x))}


def sets_of(texts):
    out = {}
    for d, t in texts.items():
        w = words(t)
        out[d] = frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(sets, percent=85):
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    held = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            held[s].append(d)
    seen = set()
    for ds in held.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = root(a), root(b)
                        comp[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def test_minhash_matches_brute_force(spark, texts):
    sets = sets_of(texts)
    rows = op5_minhash_dedup.op5_minhash_dedup(spark, SF01).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {d: len(s) for d, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(sets)


def test_minhash_crowds(spark, monkeypatch):
    """Regions over their size are deepened, and a crowd of near copies still comes together."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    texts = {}
    for d in range(120):
        w = list(base)
        w[int(rng.integers(0, 400))] = f"new{d}"
        texts[d] = " ".join(w)
    for d in range(120, 160):
        texts[d] = " ".join(f"v{i}" for i in rng.integers(0, 5000, 100))
    monkeypatch.setattr(op5_minhash_dedup, "REGION", 8)
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(4)
    rows = op5_minhash_dedup.near_duplicates(df, C.Scratch(spark, "t")).collect()
    assert {r["id"]: r["component_id"] for r in rows} == brute_components(sets_of(texts))


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    out = sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(kinds) for m in re.finditer(rx, text or "") if ok(m.group()))
    return [sum(x[1] == k for x in out) for k in range(4)], ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in out)


TRICKY = ["a@b.c_d@e.f x", "..@-.-", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "001.02.0003.255 256.1.1.1", "1234 5678 9012 3456-78",
          "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "+1 (555) 123-4567", "++1 23 45 67 89 0 +12",
          "é日本 x@y.zz 😀 1.1.1.1 +49 30 1234567890", "", None, "0" * 50, "1 2 3 4 5 6 7 8 9 0 1 2", "a" * 3000 + "@b.co", "1." * 2000 + "1",
          "u@h@h.com", "x@y..z", "4111 1111  1111 1111", "İ a@b.cd 9"]


def test_pii_matches_brute_force(spark, docs, texts):
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    want = {d: brute_spans(t) for d, t in (texts | {-1 - i: t for i, t in enumerate(TRICKY)}).items()}
    for r in op6_pii.find_spans(docs.select("doc_id", "text").union(extra), C.Scratch(spark, "t")).collect():
        n, spans = want[r["doc_id"]]
        assert [r[f"n_{k}"] for k in op6_pii.KINDS] == n and r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


def test_pii_bootstrapping(spark):
    known = [f"please write to our mail address u{i}@ex{i}.org today" for i in range(4)]
    new = ["please write to our mail address jane99-at-corp today", "something else is 99bottles of beer"]
    df = spark.createDataFrame(list(enumerate(known + new)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in op6_pii.find_spans(df, C.Scratch(spark, "t")).collect()}
    at = new[0].index("jane99")
    assert spans[4] == f"email:{at}:{at + len('jane99-at-corp')}" and spans[5] == ""


def test_decontamination_matches_brute_force(spark, texts):
    items = {r["item_id"]: words(r["text"]) for r in C.table(spark, SF01, "benchmark").collect()}
    shingles = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    want = set()
    for d, t in texts.items():
        w = words(t)
        held = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        want |= {(d, i) for i, s in shingles.items() if len(s & held) >= 0.8 * len(s)}
    rows = op7_decontamination.op7_decontamination(spark, SF01).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and want


def test_decontamination_shards_and_parts(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"what is the name of thing number q{i} x{i}?\nit is a{i} b{i} c{i} d{i} e{i} f{i} g{i}") for i in range(50)],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "z " * 200 + "what is the name of thing number q7 x7?\nit is a7 b7 c7 d7 e7 f7 g7 " + "y " * 100),
                                  (2, "what is the name of thing number q7 x7? it is nothing at all"), (3, "a7 b7 c7 d7 e7 f7 g7")],
                                 "doc_id long, text string")
    monkeypatch.setattr(op7_decontamination, "MAX_SHARD_BYTES", 500)
    shards = list(op7_decontamination.item_shards(items, 500))
    assert len(shards) > 3
    out = op7_decontamination.matches(docs, items, "doc_id").collect()
    assert [(r["doc_id"], r["item_id"]) for r in out] == [(1, 7)]


def test_wand_is_exact():
    rng = np.random.default_rng(2)
    vocab = [f"t{i}" for i in range(120)]
    pick = lambda n: " ".join(vocab[int(120 * x * x)] for x in rng.random(n))
    items = [(i, pick(int(rng.integers(4, 30)))) for i in range(37)]
    ix = op7_decontamination.Index(items)
    texts = [pick(int(rng.integers(0, 400))) for _ in range(40)] + [items[3][1], ""]
    got = {(k, at, i) for k, at, i in ix.passages(texts)}
    want = set()
    for k, t in enumerate(texts):
        w = op7_decontamination.words(t)
        for at in range(0, len(w) + 1, ix.stride):
            here = {ix.terms[x] for x in w[at:at + 2 * ix.stride] if x in ix.terms}
            for i in range(len(ix.ids)):
                if sum(ix.postings(x).get(i, 0.0) for x in here) >= op7_decontamination.MIN_SCORE:
                    want.add((k, at, i))
    assert got == want and want


def call(i, name, args, after=None):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args, "after": after}) + "</tool_call>"


def result(i, content):
    return "<tool_result>" + json.dumps({"tool_call_id": i, "content": content}) + "</tool_result>"


def test_chat_links_orders_and_validates(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ok " + call("b", "sum", {"x": "$a.v"}) + call("a", "get", {"k": 3})),
            (1, 2, "tool", result("a", {"v": 1}) + result("zz", 1)), (1, 3, "tool", result("b", "é")),
            (1, 4, "assistant", call("c", "get", {}, ["d"]) + call("d", "get", {"k": "x"}, ["c"]) + call("a", "get", {"k": 1})),
            (2, 0, "assistant", call("a", "get", {"k": 1, "z": 2}) + "<tool_call>no</tool_call>"), (1, 5, "tool", result("a", 2))]
    schemas = {"get": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}, "additionalProperties": False}}
    out = {(r["conv_id"], r["turn"]): r for r in op8_chat.format_chats(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    one = json.loads(out[1, 1]["json"])
    assert [c["id"] for c in one["tool_calls"]] == ["a", "b"] and one["content"] == "ok "
    assert [c["result"] for c in one["tool_calls"]] == [{"v": 1}, "é"] and [c["problem"] for c in one["tool_calls"]] == [None, "no schema"]
    assert {c["id"]: c["status"] for c in json.loads(out[1, 4]["json"])["tool_calls"]} == {"a": "repeated", "c": "circular", "d": "circular"}
    assert out[1, 2]["n_orphans"] == 1 and json.loads(out[1, 5]["json"])["tool_results"][0]["status"] == "repeated"
    two = json.loads(out[2, 0]["json"])
    assert two["tool_calls"][0]["problem"] == "$.z: unknown" and two["tool_calls"][0]["status"] == "no result" and two["content"] == "<tool_call>no</tool_call>"
    assert out[1, 1]["json"] == op8_chat.canonical(one)


def test_mixing_meets_targets(spark, docs, texts):
    rows = op9_mixing.op9_mixing(spark, SF01).collect()
    again = op9_mixing.op9_mixing(spark, SF01).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
        size[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(r["source_size"] == size[source[r["doc_id"]]] for r in rows)
    total, weight = sum(size.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    open_, want = set(size), {}
    while True:
        share = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * size[s]}
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    want |= {s: weight[s] * share for s in open_}
    assert target == pytest.approx(want) and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_mixing_caps_and_text(spark):
    rows = [(1, "a b c", "x"), (2, "d e f g", "y"), (3, " ".join(f"w{i}" for i in range(700)), "z"), (4, "h", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in op9_mixing.mix(
        df.select("doc_id", F.monotonically_increasing_id().alias("_id"), F.col("doc_id").alias("_k"), C.group_key("source").alias("_s"),
                  op9_mixing.word_count(F.col("text")).alias("size")), C.Scratch(spark, "t"), block_words=16).documents.collect()}
    assert [got[d]["taken"] for d in (1, 2, 4)] == [9, 12, 3] and got[3]["taken"] == 684
    out = op9_mixing.mix_documents(df, block_words=16).collect()
    assert Counter(r["doc_id"] for r in out) == {1: 3, 2: 3, 3: 1, 4: 3}
    long = next(r["text"] for r in out if r["doc_id"] == 3)
    assert len(long.split()) == 684 and set(long.split()) <= set(rows[2][1].split())


def test_permutation():
    for n in (1, 2, 3, 17, 64, 1000):
        i = np.arange(n)
        for key in (0, 5):
            assert sorted(op9_mixing._permute(i, np.full(n, n), np.full(n, key))) == i.tolist()


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (300, 2))]
    comp = {}

    def root(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        comp[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in C.components(df, C.Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in comp if any(x in e and e[0] != e[1] for e in edges)}


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    docs = C.table(spark, SF001, "documents")
    scratch = C.Scratch(spark, "t")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(scratch.cut(stage(spark, steps[-1], SF001), name))
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert all(s.columns == docs.columns for s in steps[:-1])
    lex = op10_toxicity.fit(docs, C.table(spark, SF001, "labels"))
    assert ids[1] == {r["doc_id"] for r in op10_toxicity.score_documents(docs, lex).where("score < 0.5").collect()}
    kept = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    comp = brute_components(sets_of(kept), 80)
    assert ids[2] == {d for d, c in comp.items() if d == c}
    bad = {r["doc_id"] for r in op7_decontamination.matches(steps[2], C.table(spark, SF001, "benchmark"), "doc_id").collect()}
    assert ids[3] == ids[2] - bad and ids[4] <= ids[3] and ids[5] == ids[4]
    n = Counter(r["shard"] for r in steps[5].collect())
    assert max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == steps[4].count()


def test_hash_sample_is_bounded_and_stable(spark):
    df = spark.range(50_000)
    a = C.hash_sample(df, F.xxhash64("id"), 500, 50_000).collect()
    b = C.hash_sample(df.repartition(7), F.xxhash64("id"), 500, 50_000).collect()
    assert len(a) == 500 and {r[0] for r in a} == {r[0] for r in b}
    assert C.hash_sample(df.limit(10), F.xxhash64("id"), 500, 10).count() == 10


@pytest.mark.parametrize("name", ["op4_embedding_dedup", "op5_minhash_dedup"])
def test_near_duplicates_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    got = queries.queries()[name](spark, SF001)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.project(", ".join(cols)).fetchall())


def test_registered_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and set(queries.oracle_sql()) <= set(names)
