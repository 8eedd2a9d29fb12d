import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import spec
from riskloom.functions import features as FE
from riskloom.functions import scalar as S
from riskloom.operators import aggregates as AG


def test_tier_edges_both_closures(spark):
    # FIXTURES B5: exact edges under right- and left-closed rules.
    rows = [(0.0, None, "Low"), (0.25, "Low", "Moderate"), (0.5, "Moderate", "High"),
            (0.75, "High", "Critical"), (1.0, "Critical", "Critical"), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "s double")
    got = df.select("s", S.tier("s", closed="right").alias("r"), S.tier("s", closed="left").alias("l")).collect()
    exp = {r[0]: (r[1], r[2]) for r in rows}
    for g in got:
        assert (g["r"], g["l"]) == exp[g["s"]]


def test_histogram_edges_match_numpy(spark):
    # FIXTURES B6: 0.15->2, 0.3->5, 0.35->6, 0.6->11, 0.7->13, 0.85->16, 0.95->18, 1.0->19.
    vals = [0.15, 0.3, 0.35, 0.6, 0.7, 0.85, 0.95, 1.0, 0.0, -0.1, 1.1]
    edges = np.linspace(0, 1, 21)
    assert AG.histogram_edges() == list(edges)
    counts, _ = np.histogram(vals, bins=edges)
    df = spark.createDataFrame([(v,) for v in vals], "score double")
    got = [r["count"] for r in AG.histogram(df, "score").orderBy("bin").collect()]
    assert got == counts.tolist()
    starts = [r["bin_start"] for r in AG.histogram(df, "score").orderBy("bin").collect()]
    assert starts == [round(float(e), 2) for e in edges[:-1]]


def test_clip_passes_missing_through(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (5.0,), (-3.0,), (300.0,)], "v double")
    got = [r[0] for r in df.select(S.clip("v", 0.0, 100.0)).collect()]
    assert math.isnan(got[0]) and got[1] is None and got[2:] == [5.0, 0.0, 100.0]


def test_flags_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (13.0,), (12.0,)], "wbc double")
    assert [r[0] for r in df.select(S.flag("wbc", "gt", 12.0)).collect()] == [0, 0, 1, 0]


def test_round_half_up(spark):
    df = spark.createDataFrame([(0.12345,)], "x double")
    assert df.select(S.round_n("x", 4)).first()[0] == 0.1235


def test_golden_feature_row(spark):
    # FIXTURES B1: the stored sample row of the reference's feature table.
    row = dict(age=70, length_of_stay=3, comorbidity_count=3, icu_flag=0, prior_admissions_1yr=0,
               prior_ed_visits_1yr=3, sodium=134.254, potassium=3.903, creatinine=0.638, bun=19.447,
               glucose=130.928, hemoglobin=15.177, wbc=8.228, platelets=141.351, albumin=3.408,
               total_bili=3.296, ast=17.397, alt=14.011, inr=1.182, lactate=3.169, troponin=0.163,
               heart_rate=62.9, systolic_bp=112.3, diastolic_bp=66.2, temperature=37.8, respiratory_rate=16.4,
               spo2=94.7, gender="F", race="White", insurance="Medicaid", primary_icd10="K57", care_unit="MED",
               discharge_disposition="Home")
    for m in ["ACE_inhibitor", "beta_blocker", "diuretic", "anticoagulant", "antibiotic", "insulin",
              "corticosteroid", "antidepressant", "statin", "bronchodilator", "antipsychotic", "opioid_analgesic"]:
        row[f"med_{m}"] = 1 if m in ("ACE_inhibitor", "corticosteroid", "statin", "antipsychotic") else 0
    df = spark.createDataFrame([row])
    out = FE.derive_features(df, spec.CLINICAL_SPEC).first().asDict()
    assert list(out) == spec.CLINICAL_SPEC.names and len(out) == 100
    f32 = lambda x: float(np.float32(x))
    assert out["creatinine_bun_ratio"] == f32(0.0328071154654026)
    assert out["sodium_potassium_ratio"] == f32(34.39763259887695)
    assert out["shock_index"] == f32(0.5601068735122681)
    assert out["pulse_pressure"] == f32(46.099998474121094)
    assert out["age_los_interaction"] == 210.0
    assert out["prior_admissions_ed_total"] == 3.0
    assert out["albumin_creatinine_ratio"] == f32(5.341684341430664)
    assert out["elevated_lactate"] == 1.0 and out["low_albumin"] == 1.0
    for k in ("high_wbc", "low_hemoglobin", "high_inr", "hypotension", "tachycardia", "hypoxia"):
        assert out[k] == 0.0
    assert out["gender_F"] == 1.0 and out["gender_M"] == 0.0 and out["primary_icd10_K57"] == 1.0


def test_one_hot_unseen_value_is_all_zero(spark):
    df = spark.createDataFrame([("X",), ("A",), (None,)], "c string")
    got = df.select(*FE.one_hot_columns({"c": ["A", "B"]})).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 0), (0, 0)]


def test_top_abs_orders_by_magnitude(spark):
    df = spark.createDataFrame([([("a", 0.1), ("b", -0.5), ("c", 0.3), ("d", 0.5)],)],
                               "arr array<struct<feature:string,value:double>>")
    got = df.select(S.top_abs("arr", 3).alias("t")).first()["t"]
    assert [(g["feature"], g["shap_value"], g["direction"]) for g in got] == [
        ("b", -0.5, "decreases_risk"), ("d", 0.5, "increases_risk"), ("c", 0.3, "increases_risk")]


def test_impute_after_derivation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 4.0), (3.0, None), (float("nan"), 8.0)], "a double, b double")
    out = FE.impute_median(df.withColumn("r", S.safe_ratio("a", "b", 0.0)), ["a", "b", "r"]).collect()
    # medians: a of {1,3} = 2, b of {2,4,8} = 4, r of {0.5} = 0.5
    assert [tuple(r) for r in out] == [(1.0, 2.0, 0.5), (2.0, 4.0, 0.5), (3.0, 4.0, 0.5), (2.0, 8.0, 0.5)]


def test_overlay_row_and_median_modes(spark):
    from riskloom.operators import relational as R
    table = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (3, 60.0, "c")], "id int, x double, s string")
    payload = spark.createDataFrame([(7, None), (8, 5.0)], "id int, x double")
    by_row = {r["id"]: (r["x"], r["s"]) for r in R.overlay(payload, table, ["x", "s"], "row", ["id"]).collect()}
    assert by_row == {7: (10.0, "a"), 8: (5.0, "a")}      # absent column s comes from the base row
    by_med = {r["id"]: r["x"] for r in R.overlay(payload, table, ["x"], "median").collect()}
    assert by_med == {7: 20.0, 8: 5.0}
