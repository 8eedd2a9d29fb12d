import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import aggregates as AG
from riskloom.operators import ordering as SL
from riskloom.operators.ordered import exact_quantiles, running_totals
from riskloom.plans.fixture import admissions

from conftest import SF001


def _pair_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _step_ap(pairs):
    ths = sorted({s for s, _ in pairs}, reverse=True)
    P = sum(y for _, y in pairs)
    ap, prev_r = 0.0, 0.0
    for t in ths:
        tp = sum(1 for s, y in pairs if s >= t and y == 1)
        fp = sum(1 for s, y in pairs if s >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auc_and_ap_match_brute_force(spark):
    rnd = random.Random(3)
    pairs = [(round(rnd.random(), 2), int(rnd.random() < 0.4)) for _ in range(200)]  # ties included
    df = spark.createDataFrame(pairs, "score double, label int")
    got = AG.auc(df, "label", "score", digits=None, ).first()["auc"]
    assert got == pytest.approx(_pair_auc(pairs), abs=1e-12)
    ap = AG.average_precision(df, "label", "score", digits=None).first()["average_precision"]
    assert ap == pytest.approx(_step_ap(pairs), abs=1e-12)


def test_running_totals_many_ranges(spark):
    rnd = random.Random(5)
    rows = [(g, float(k), rnd.randint(1, 9)) for g in range(3) for k in rnd.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "g int, k double, c int")
    got = {(r["g"], r["k"]): r["cum_c"] for r in running_totals(df, "k", ["c"], ["g"], n_ranges=7).collect()}
    for g in range(3):
        acc = 0
        for _, k, c in sorted(r for r in rows if r[0] == g):
            acc += c
            assert got[(g, k)] == acc


def test_exact_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(1)
    vals = np.concatenate([rnd.integers(0, 50, 500).astype(float), rnd.normal(size=300)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, "v", probs, n_ranges=5).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


def test_quantile_buckets_like_qcut(spark):
    import pandas as pd
    rnd = np.random.default_rng(2)
    vals = np.round(rnd.random(1000), 2)
    df = spark.createDataFrame([(float(v),) for v in vals], "s double")
    got = [r["n"] for r in AG.quantile_buckets(df, "s", 10).orderBy("bucket").collect()]
    exp = pd.qcut(vals, 10, duplicates="drop").value_counts().sort_index().tolist()
    assert got == exp


def test_kfold_disjoint_complete_stratified(spark):
    adm = admissions(spark, SF001).select("admission_id", "label")
    f = SL.kfold(adm, "label", "admission_id", k=5, seed=42)
    rows = f.collect()
    assert len(rows) == adm.count() and len({r["admission_id"] for r in rows}) == len(rows)
    for lab in (0, 1):
        sizes = [sum(1 for r in rows if r["label"] == lab and r["fold"] == i) for i in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_pages_concatenate_to_sorted_table(spark):
    adm = admissions(spark, SF001).select("admission_id", "score")
    full = [r["admission_id"] for r in SL.sort_by(adm, "score", "desc", ["admission_id"]).collect()]
    pages = []
    for p in range(1, 9):
        pages += [r["admission_id"] for r in SL.page(adm, "score", "desc", ["admission_id"], p, 200).collect()]
    assert pages == full
    keyset, after = [], None
    while True:
        chunk = SL.keyset_page(adm, "score", "admission_id", 200, after).collect()
        if not chunk:
            break
        keyset += [r["admission_id"] for r in chunk]
        after = (chunk[-1]["score"], chunk[-1]["admission_id"])
    assert keyset == full


def test_medians_match_numpy(spark):
    rnd = np.random.default_rng(4)
    a, b = rnd.normal(size=301), rnd.integers(0, 7, 301).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    m = AG.medians(df, ["a", "b"]).first()
    assert m["a"] == pytest.approx(float(np.median(a))) and m["b"] == float(np.median(b))


def test_constraint_audit_counts_duplicates(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 1, "yy"), (2, 1, None), (None, 1, "z")], "k int, n int, s string")
    r = AG.constraint_audit(df, ["k", "n"], not_null=["s"], max_len={"s": 1}).first()
    assert (r["dup_keys"], r["dup_rows"], r["null_keys"], r["null_s"], r["toolong_s"]) == (1, 2, 1, 1, 1)
