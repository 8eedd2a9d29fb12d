"""Model bindings: admissions features -> two boosted-tree models -> blend,
explanations, evaluation, persistence and a scoring stream (ML-*, IO-6,
IO-7, ST-6, AG-12).  These have no SQL oracle; tests check properties
(additivity, probability range, fold coverage, stream = batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import spec
from riskloom.functions import features as FE
from riskloom.functions import scalar as S
from riskloom.models import gbt as G
from riskloom.models import scoring as SC
from riskloom.models import treeshap as TS
from riskloom.operators import relational as R
from riskloom.operators.windows import prior_count
from riskloom.plans.fixture import admissions, table
from riskloom.session import cut_lineage, fits_at_once, spread_rows, spread_small
from riskloom.sources import tables as T
from riskloom.spec import Derived, FeatureSpec
from riskloom.streaming import monitor as M

QUERIES: dict = {}
SQL: dict = {}

GLOBAL_ROWS = 5000
#: Trees of every model that the registered queries fit, score, explain and
#: validate: the reference's 600.
TREES = G.N_TREES
FITS = {"gbt_a": lambda df, lab: G.fit_gbt_a(df, lab, TREES), "gbt_b": lambda df, lab: G.fit_gbt_b(df, lab, TREES)}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


ADM_SPEC = FeatureSpec(
    numeric=["score_raw", "los", "n_lines", "avg_discount", "avg_tax", "c_acctbal", "prior_count"],
    categorical={"priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
                 "status": ["F", "O", "P"],
                 "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
    derived=[Derived("price_per_line", "ratio", "score_raw", "n_lines"),
             Derived("los_x_lines", "product", "los", "n_lines"),
             Derived("big_discount", "gt", "avg_discount", threshold=0.05),
             Derived("negative_balance", "lt", "c_acctbal", threshold=0.0)])
KEEP = ["admission_id", "patient_id", "label"]


def admission_wide(spark: SparkSession, d: str) -> DataFrame:
    """Admissions with per-order line aggregates, balance and prior count."""
    adm = admissions(spark, d)
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.avg("l_discount").alias("avg_discount"),
        F.avg("l_tax").alias("avg_tax"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pc = prior_count(o, "o_custkey", "o_orderdate", 365).select("o_orderkey", "prior_count")
    return (adm.join(li, adm.admission_id == li.l_orderkey, "left")
            .join(c, adm.patient_id == c.c_custkey, "left")
            .join(pc, adm.admission_id == pc.o_orderkey, "left"))


def admission_features(spark: SparkSession, d: str, impute: bool = True) -> DataFrame:
    f = FE.derive_features(admission_wide(spark, d), ADM_SPEC, keep=KEEP, impute=impute)
    return R.assemble_array(f, ADM_SPEC.names, keep=KEEP)


_CACHE: dict = {}


def _once(spark: SparkSession, d: str, what: str, make):
    """A result shared by queries over the same tables within one application."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "features", lambda: cut_lineage(admission_features(spark, d)))


def model(spark: SparkSession, d: str, name: str):
    """(features, one model), each made once per application and table dir; a query on one
    model fits no other."""
    return (_once(spark, d, "spread", lambda: spread_rows(_rows(spark, d))),
            _once(spark, d, f"fit-{name}", lambda: FITS[name](_rows(spark, d), "label")))


def fitted(spark: SparkSession, d: str):
    """(features, model A, model B)."""
    from concurrent.futures import ThreadPoolExecutor

    at_once = fits_at_once(_rows(spark, d), 2)
    with ThreadPoolExecutor(max_workers=at_once) as pool:   # two independent fits share the executors
        (feats, ma), (_, mb) = pool.map(lambda name: model(spark, d, name), FITS)
    return feats, ma, mb


def held_out(spark: SparkSession, d: str) -> DataFrame:
    """Every row scored by models of the other folds, with the same trees as the
    fitted models; serves cross-validation and out-of-fold evaluation."""
    return _once(spark, d, "folds", lambda: G.out_of_fold(_rows(spark, d), "label", "admission_id", FITS, k=5))


def in_sample(spark: SparkSession, d: str) -> DataFrame:
    """Label and blend of every row, written once: the metrics read them several times."""
    def make():
        feats, ma, mb = fitted(spark, d)
        return cut_lineage(G.ensemble(ma, mb, feats).select("admission_id", "label", "_blend"))

    return _once(spark, d, "scores", make)


@register("ml1_fit_gbt_a")
def q_fit_a(spark, d):
    feats, ma = model(spark, d, "gbt_a")
    return G.predict_proba(ma, feats, "prob_a").select("admission_id", F.round("prob_a", 4).alias("prob_a"))


@register("ml2_fit_gbt_b")
def q_fit_b(spark, d):
    feats, mb = model(spark, d, "gbt_b")
    return G.predict_proba(mb, feats, "prob_b").select("admission_id", F.round("prob_b", 4).alias("prob_b"))


@register("ml4_cross_validate")
def q_cross_validate(spark, d):
    return G.cross_validate(held_out(spark, d), "label", list(FITS))


@register("ml5_ensemble")
def q_ensemble(spark, d):
    feats, ma, mb = fitted(spark, d)
    return G.ensemble(ma, mb, feats).select("admission_id", "prob_a", "prob_b", "ensemble_prob", "risk_tier")


@register("ml6_explain")
def q_explain(spark, d):
    feats, ma = model(spark, d, "gbt_a")
    ex = TS.explain(ma, feats, "features", ["admission_id"], ADM_SPEC.names, top_n=10)
    return ex.select("admission_id", "base_value", F.posexplode("explanation").alias("pos", "e")) \
        .select("admission_id", "base_value", "pos", "e.feature", "e.shap_value", "e.direction")


@register("ml6_explain_blend")
def q_explain_blend(spark, d):
    """Drivers of the blend: the weighted sum of both models' margins."""
    feats, ma, mb = fitted(spark, d)
    n = len(ADM_SPEC.names)
    both = TS.combine([TS.path_table(m, n, spark) for m in (ma, mb)], spec.BLEND_WEIGHTS)
    ex = TS.explain(None, feats, "features", ["admission_id"], ADM_SPEC.names, top_n=10, pt=both)
    return ex.select("admission_id", "base_value", F.posexplode("explanation").alias("pos", "e")) \
        .select("admission_id", "base_value", "pos", "e.feature", "e.shap_value", "e.direction")


@register("ml7_global_explain")
def q_global_explain(spark, d):
    """SL-5 -> ML-6 -> AG-12: importance on a seeded 5,000-row sample."""
    from riskloom.operators.ordering import sample_n
    feats, ma = model(spark, d, "gbt_a")
    sample = spread_small(sample_n(feats, GLOBAL_ROWS, 42, "admission_id"))
    return TS.importance(ma, sample, "features", ADM_SPEC.names)


@register("ag12_global_importance")
def q_global_importance(spark, d):
    """AG-12 over every row: explanations are partitioned, so no sample is needed."""
    feats, ma = model(spark, d, "gbt_a")
    return TS.importance(ma, feats, "features", ADM_SPEC.names)


@register("ag12_given_explanations", """
SELECT feature, round(avg(abs(v)), 4) AS mean_shap FROM (
  SELECT 'discount' AS feature, -l_discount AS v FROM lineitem UNION ALL SELECT 'quantity', l_quantity / 64 FROM lineitem
  UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY feature""")
def q_given_explanations(spark, d):
    """AG-12 over explanations that are already a table."""
    li = table(spark, d, "lineitem")
    return TS.global_importance(li.select(F.array(F.col("l_quantity") / 64, -F.col("l_discount"), "l_tax").alias("shap")),
                                ["quantity", "discount", "tax"])


@register("ml3_predict_proba")
def q_predict_proba(spark, d):
    feats, ma, mb = fitted(spark, d)
    a = G.predict_proba(ma, feats, "p_a")
    b = G.predict_proba(mb, a, "p_b")
    return b.select("admission_id", F.round("p_a", 6).alias("p_a"), F.round("p_b", 6).alias("p_b"))


@register("pr6_attach_scores")
def q_attach_scores(spark, d):
    """Scores and tier appended to the original admission rows."""
    feats, ma, mb = fitted(spark, d)
    scores = G.ensemble(ma, mb, feats).select("admission_id", "prob_a", "prob_b", "ensemble_prob", "risk_tier")
    return R.attach_scores(admissions(spark, d), scores, "admission_id")


@register("ml8_score_table")
def q_score_table(spark, d):
    _, ma, mb = fitted(spark, d)
    wide = admission_wide(spark, d)
    base = wide.orderBy("admission_id").limit(1)
    payload = wide.select(
        "admission_id", "score_raw", "priority", "status", F.lit(None).cast("double").alias("los"))
    out = SC.score_table(payload, base, ADM_SPEC, ma, mb, "admission_id")
    return out.select("admission_id", "prob_a", "prob_b", "ensemble_prob", "risk_tier",
                      G.F.to_json("explanation").alias("explanation_json"))


@register("ml9_detail")
def q_detail(spark, d):
    feats, ma, mb = fitted(spark, d)
    return SC.detail(admissions(spark, d), feats, "patient_id", 100, "admission_id", ADM_SPEC.names, ma, mb, record="patient")


@register("ml10_train_eval")
def q_train_eval(spark, d):
    return G.train_eval(in_sample(spark, d), "label")


@register("ml10_train_eval_out_of_fold")
def q_train_eval_oof(spark, d):
    """AUC / AP of the blend scored out of fold (each row by models that did
    not see it), next to the in-sample figures of ml10_train_eval."""
    oof = held_out(spark, d).withColumn("_blend", S.blend(list(FITS)))
    return G.train_eval(oof, "label")


@register("io6_run_metrics")
def q_run_metrics(spark, d):
    ev = G.train_eval(in_sample(spark, d), "label").first()               # one row
    bal = G.AG.class_balance(in_sample(spark, d), "label").first()        # one row
    params = {**{k: v for k, v in G.spec.GBT_A_PARAMS.items()}, "maxIter": TREES, "ensemble_weight_a": 0.5,
              "n_features": len(ADM_SPEC.names)}
    cv = G.AG.cv_summary(G.cross_validate(held_out(spark, d), "label", list(FITS)), "model", "auc").collect()  # one row per model
    metrics = {f"{r['model']}_cv_auc_{k}": r[k] for r in cv for k in ("mean", "std")}
    metrics |= {"ensemble_train_auc": ev["auc"], "ensemble_train_ap": ev["average_precision"],
               "n_rows": bal["n"], "positive_rate": bal["positive_rate"]}
    path = T.roundtrip_path(spark, "runs")
    T.run_metrics_sink(spark, params, metrics, path)
    return spark.read.parquet(path).drop("ts")


@register("io7_save_load")
def q_save_load(spark, d):
    feats, ma = model(spark, d, "gbt_a")
    path = T.roundtrip_path(spark, "model-a")
    G.save_model(ma, path, ADM_SPEC.names)
    loaded, names = G.load_model(spark, path)
    assert names == ADM_SPEC.names
    return G.predict_proba(loaded, feats, "prob_a").select("admission_id", F.round("prob_a", 4).alias("prob_a"))


@register("st6_score_stream")
def q_score_stream(spark, d):
    feats, ma, mb = fitted(spark, d)
    base = T.roundtrip_path(spark, "admit-topic")
    src, out, ck = f"{base}/in", f"{base}/out", f"{base}/_checkpoint"
    feats.write.mode("overwrite").parquet(src)           # the admissions topic, as files
    stream = spark.readStream.schema(feats.schema).option("maxFilesPerTrigger", 2).parquet(src)
    probs = {c: c for c in ("prob_a", "prob_b", "ensemble_prob")}
    M.run_to_completion(T.predictions_stream_sink(G.ensemble(ma, mb, stream), out, ck, key="admission_id", probs=probs, tier="risk_tier"))
    return spark.read.parquet(out).drop("predicted_at", "batch_id")
