"""Cases that an operator once did only in part."""

from collections import Counter, defaultdict

import corpus_pipeline
from riskloom.llm import common as C
from riskloom.llm import op5_minhash_dedup, op6_pii, op7_decontamination

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def smallest_linked(texts, percent):
    """The smallest id that each id is linked with, by an exact join."""
    sets = {d: set(op5_minhash_dedup.shingle_set(t).tolist()) for d, t in texts.items()}
    held, both, comp = defaultdict(list), Counter(), {d: d for d in texts}
    for d in sorted(sets):
        for s in sets[d]:
            both.update((a, d) for a in held[s])
            held[s].append(d)
    for _ in texts:
        before = dict(comp)
        for (a, b), m in both.items():
            if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            return comp


def test_pipeline_links_from_four_fifths(spark):
    docs = C.table(spark, SF01, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    want = {d for d, c in smallest_linked(texts, 80).items() if c == d}
    assert len(want) < sum(c == d for d, c in smallest_linked(texts, 85).items())
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF01).select("doc_id").collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_stages_after_links_from_four_fifths(spark):
    scratch, steps = C.Scratch(spark, "t"), [C.table(spark, SF001, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(scratch.cut(stage(spark, steps[-1], SF001), name))
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    kept = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    assert ids[2] == {d for d, c in smallest_linked(kept, 80).items() if c == d}
    bad = {r["doc_id"] for r in op7_decontamination.matches(steps[2], C.table(spark, SF001, "benchmark"), "doc_id").collect()}
    assert ids[3] == ids[2] - bad and ids[4] <= ids[3] and ids[5] == ids[4]
    n = Counter(r["shard"] for r in steps[5].collect())
    assert max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == steps[4].count()


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in op6_pii.find_spans(df, C.Scratch(spark, "t")).collect()}


def found(kind, text, value):
    return f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"


def test_pii_identifiers_of_several_words(spark):
    phones = ["+1 (826) 555-4081", "+1 (826) 555-4082", "+1 (311) 555-9000", "+1 (312) 555-9001"]
    cards = ["4111 1111 1111 1111", "4012 8888 8888 1881", "5555 5555 5555 4444"]
    new = [("phone", "you may call me 555 123 4567, or not", "555 123 4567"), ("phone", "you may call me (555) 123-4567 now", "(555) 123-4567"),
           ("phone", "you may call me 55512 345 - 678. 12 more", "55512 345 - 678"), ("card", "charge my card 4111 1111 1111 1112 please", "4111 1111 1111 1112"),
           ("phone", "you may call me 555 123 4568 +1 (826) 555-4081", "555 123 4568")]
    texts = [f"you may call me {p} today" for p in phones] + [f"charge my card {c} please" for c in cards] + [t for _, t, _ in new]
    spans = spans_of(spark, texts)
    for i, (kind, text, value) in enumerate(new):
        assert found(kind, text, value) in spans[len(phones) + len(cards) + i].split(",")
    two = spans_of(spark, [f"you may call me {p} today" for p in phones[:2]] * 2 + ["you may call me 555 123 4567"])
    assert two[4] == ""  # two different seeds, however often


def test_pii_rows_of_numbers_are_words(spark):
    numbers = " ".join(str(1000 + i) for i in range(40))
    seeds = [f"you may call me +1 (826) 555-40{i} today" for i in range(10, 16)]
    spans = spans_of(spark, [*seeds, "you may call me 12345 " + numbers])
    assert spans[6] == "phone:16:21"


def test_pii_context_holds_instances(spark):
    known = [f"tel 555123{i} mail u{i}@ex{i}.org fax 55{i}9876 done" for i in range(4)]
    texts = [*known, "tel 5551239 mail jane99-at-corp fax 5559877 done", "see u1@ex.org u2@ex.org u3@ex.org u4@ex.org u5@ex.org jane98-at-corp"]
    spans = spans_of(spark, texts)
    assert spans[4] == found("email", texts[4], "jane99-at-corp")
    assert found("email", texts[5], "jane98-at-corp") in spans[5].split(",")


def test_decontamination_reports_rows_without_doc_id(spark):
    big = 2**62 + 1
    items = spark.createDataFrame([(7, "what is the name of the thing? it is a b c d e")], "item_id long, text string")
    rows = [(None, "x what is the name of the thing? it is a b c d e"), (big, "what is the name of the thing? it is a b c d e y"), (None, "z"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["item_id"]) for r in op7_decontamination.matches(docs, items, "doc_id").collect()]
    assert sorted(got, key=str) == sorted([(None, 7), (big, 7)], key=str)
