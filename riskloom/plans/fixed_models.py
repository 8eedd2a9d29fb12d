"""Scoring, blending, explaining and storing with two small fixed ensembles.

The trees are written down here, put into MLlib's saved format and loaded like
any stored model; the same trees, as CASE expressions, are the DuckDB side.  So
everything behind a fit is held against SQL: probabilities, blend and tier, SHAP
values (closed form, at most two features a tree), the payload path, the stored
model and the scoring stream.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.models import gbt as G
from riskloom.models import scoring as SC
from riskloom.models import treeshap as TS
from riskloom.operators import aggregates as AG
from riskloom.operators import relational as R
from riskloom.operators.ordering import kfold
from riskloom.plans.fixture import admissions, with_admissions
from riskloom.plans.surface import _auc_sql
from riskloom.plans.models import ADM_SPEC, _once, admission_features, admission_wide
from riskloom.session import cut_lineage, scratch_path
from riskloom.sources import tables as T
from riskloom.streaming import monitor as M

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@dataclass(frozen=True)
class Split:
    feature: str
    threshold: float
    left: "Split | Leaf"
    right: "Split | Leaf"

    @property
    def cover(self) -> float:
        return self.left.cover + self.right.cover


@dataclass(frozen=True)
class Leaf:
    value: float
    cover: float


#: (weight, tree) of the two ensembles.
TREES_A = [(1.0, Split("score_raw", 0.3, Split("los", 20.0, Leaf(-0.7, 30), Leaf(-0.2, 50)), Split("los", 35.0, Leaf(0.1, 20), Leaf(0.55, 60)))),
           (0.5, Split("segment_BUILDING", 0.5, Leaf(-0.15, 80), Leaf(0.6, 20)))]
TREES_B = [(1.0, Split("los", 30.0, Leaf(-0.4, 60), Split("score_raw", 0.5, Leaf(0.2, 25), Leaf(0.9, 15)))),
           (0.25, Split("score_raw", 0.2, Leaf(-0.8, 10), Leaf(0.28, 90)))]
USED = ("score_raw", "los", "segment_BUILDING")


def build_model(spark: SparkSession, trees: list, names: list[str], uid: str) -> GBTClassificationModel:
    """An MLlib model of the given trees, through the saved format."""
    rows: list[tuple] = []

    def add(tree_id: int, node) -> int:
        me = len([r for r in rows if r[0] == tree_id])
        rows.append((tree_id, None))
        at = len(rows) - 1
        stats = [float(node.cover), 0.0, 0.0]
        if isinstance(node, Leaf):
            rows[at] = (tree_id, (me, node.value, 0.0, stats, int(node.cover), -1.0, -1, -1, (-1, [], -1)))
        else:
            left, right = add(tree_id, node.left), add(tree_id, node.right)
            rows[at] = (tree_id, (me, 0.0, 1.0, stats, int(node.cover), 0.1, left, right, (names.index(node.feature), [node.threshold], -1)))
        return me

    for i, (_, tree) in enumerate(trees):
        add(i, tree)
    meta = {"timestamp": 0, "sparkVersion": spark.version, "paramMap": {"impurity": "variance", "featuresCol": G.VECTOR}, "defaultParamMap": {}}
    path = scratch_path(spark, f"{uid}-{spark.sparkContext.applicationId}")
    top = meta | {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": uid, "numFeatures": len(names), "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(top),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    part = [(i, json.dumps(meta | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "uid": f"{uid}_{i}"}), w)
            for i, (w, _) in enumerate(trees)]
    spark.createDataFrame(part, "_1 int, _2 string, _3 double").coalesce(1).write.mode("overwrite").parquet(f"{path}/treesMetadata")
    spark.createDataFrame(rows, "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:long,"
                          "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,"
                          "numCategories:int>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def models(spark: SparkSession, d: str):
    return _once(spark, d, "fixed", lambda: (build_model(spark, TREES_A, ADM_SPEC.names, "fixedA"), build_model(spark, TREES_B, ADM_SPEC.names, "fixedB")))


def feats(spark: SparkSession, d: str) -> DataFrame:
    return admission_features(spark, d, impute=False)


# ---- the same trees as SQL -----------------------------------------------------
def _expected(node, known: set[str]) -> str:
    """The tree's value with the features of ``known`` given and the others
    averaged by cover."""
    if isinstance(node, Leaf):
        return f"CAST({node.value!r} AS DOUBLE)"
    a, b = _expected(node.left, known), _expected(node.right, known)
    if node.feature in known:
        return f'(CASE WHEN f_{node.feature} <= {node.threshold!r} THEN {a} ELSE {b} END)'
    return f"(({a}) * {node.left.cover / node.cover!r} + ({b}) * {node.right.cover / node.cover!r})"


def _features(node) -> set[str]:
    return set() if isinstance(node, Leaf) else {node.feature} | _features(node.left) | _features(node.right)


def _margin(trees: list) -> str:
    return " + ".join(f"{w!r} * {_expected(t, _features(t))}" for w, t in trees)


def _shapley(trees: list, feature: str) -> str:
    """Shapley value of the logit (twice the margin) for trees of up to two features."""
    terms = ["CAST(0 AS DOUBLE)"]
    for w, t in trees:
        used = _features(t)
        if feature not in used:
            continue
        rest = sorted(used - {feature})
        assert len(rest) <= 1
        alone = f"({_expected(t, {feature})} - {_expected(t, set())})"
        if rest:
            last = f"({_expected(t, used)} - {_expected(t, set(rest))})"
            terms.append(f"{2 * w!r} * ({alone} + {last}) / 2")
        else:
            terms.append(f"{2 * w!r} * {alone}")
    return " + ".join(terms)


def _scored_sql(body: str, los: str = "los", closed: str = "right") -> str:
    """``scored``: pa, pb, blend and tier per admission."""
    tier = ("CASE WHEN e >= 0.75 THEN 'Critical' WHEN e >= 0.5 THEN 'High' WHEN e >= 0.25 THEN 'Moderate' ELSE 'Low' END" if closed == "left" else
            "CASE WHEN e > 0.75 THEN 'Critical' WHEN e > 0.5 THEN 'High' WHEN e > 0.25 THEN 'Moderate' WHEN e > 0 THEN 'Low' END")
    return with_admissions(f""", f AS (
  SELECT *, coalesce(CAST(CAST(score_raw AS FLOAT) AS DOUBLE), 0) AS f_score_raw, coalesce(CAST(CAST({los} AS FLOAT) AS DOUBLE), 0) AS f_los,
         CASE WHEN segment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS "f_segment_BUILDING" FROM admissions),
p AS (SELECT *, 1 / (1 + exp(-2 * ({_margin(TREES_A)}))) AS pa, 1 / (1 + exp(-2 * ({_margin(TREES_B)}))) AS pb FROM f),
q AS (SELECT *, 0.5 * pa + 0.5 * pb AS e FROM p),
scored AS (SELECT * EXCLUDE (risk_tier), round(pa, 4) AS prob_a, round(pb, 4) AS prob_b, round(e, 4) AS ensemble_prob, {tier} AS risk_tier FROM q)
{body}""")


@register("ml3_fixed_trees", _scored_sql("SELECT admission_id, round(pa, 6) AS p_a, round(pb, 6) AS p_b FROM q"))
def q_proba(spark, d):
    ma, mb = models(spark, d)
    both = G.predict_proba(mb, G.predict_proba(ma, feats(spark, d), "p_a"), "p_b")
    return both.select("admission_id", F.round("p_a", 6).alias("p_a"), F.round("p_b", 6).alias("p_b"))


_SCORES = ["admission_id", "prob_a", "prob_b", "ensemble_prob", "risk_tier"]
_SCORES_SQL = f"SELECT {', '.join(_SCORES)} FROM scored"


@register("ml5_fixed_trees", _scored_sql(_SCORES_SQL))
def q_ensemble(spark, d):
    return G.ensemble(*models(spark, d), feats(spark, d)).select(*_SCORES)


def _phi(trees: list) -> str:
    return ", ".join(f'round({_shapley(trees, f)}, 6) AS phi_{f}' for f in USED)


def _explained(spark, d, model, pt=None):
    ex = TS.explain(model, feats(spark, d), "features", ["admission_id"], ADM_SPEC.names, pt=pt)
    return ex.select("admission_id", *[F.round(F.get("shap", F.lit(ADM_SPEC.names.index(f))), 6).alias(f"phi_{f}") for f in USED])


@register("ml6_fixed_trees", _scored_sql(f"SELECT admission_id, {_phi(TREES_A)} FROM f"))
def q_explain(spark, d):
    return _explained(spark, d, models(spark, d)[0])


@register("ml6_fixed_trees_blend", _scored_sql(f"SELECT admission_id, {_phi([(w / 2, t) for w, t in TREES_A + TREES_B])} FROM f"))
def q_explain_blend(spark, d):
    n = len(ADM_SPEC.names)
    return _explained(spark, d, None, TS.combine([TS.path_table(m, n, spark) for m in models(spark, d)], [0.5, 0.5]))


@register("ml8_fixed_trees", _scored_sql(_SCORES_SQL, los="(SELECT los FROM admissions ORDER BY admission_id LIMIT 1)", closed="left"))
def q_score_table(spark, d):
    """A payload without length of stay, over the first admission as base row."""
    wide = admission_wide(spark, d)
    payload = wide.select("admission_id", "score_raw", "segment", F.lit(None).cast("double").alias("los"))
    return SC.score_table(payload, wide.orderBy("admission_id").limit(1), ADM_SPEC, *models(spark, d), "admission_id").select(*_SCORES)


@register("ml9_fixed_trees", _scored_sql(f"{_SCORES_SQL} WHERE patient_id = 100 ORDER BY admission_id LIMIT 1"))
def q_detail(spark, d):
    return SC.detail(admissions(spark, d), feats(spark, d), "patient_id", 100, "admission_id", ADM_SPEC.names,
                     *models(spark, d)).select(*_SCORES)


@register("pr6_fixed_trees", _scored_sql(
    "SELECT admission_id, patient_id, hospital_id, score, label, los, prob_a, prob_b, ensemble_prob, risk_tier FROM scored"))
def q_attach(spark, d):
    scores = G.ensemble(*models(spark, d), feats(spark, d)).select(*_SCORES)
    return R.attach_scores(admissions(spark, d).select("admission_id", "patient_id", "hospital_id", "score", "label", "los"), scores, "admission_id")


@register("io7_fixed_trees", _scored_sql("SELECT admission_id, prob_a, prob_b FROM scored"))
def q_stored(spark, d):
    """Both models saved with their feature list, loaded, and applied."""
    out = feats(spark, d)
    for m, c in zip(models(spark, d), ("prob_a", "prob_b")):
        path = T.roundtrip_path(spark, "model")
        G.save_model(m, path, ADM_SPEC.names)
        loaded, names = G.load_model(spark, path)
        assert names == ADM_SPEC.names
        out = G.predict_proba(loaded, out, c)
    return out.select("admission_id", F.round("prob_a", 4).alias("prob_a"), F.round("prob_b", 4).alias("prob_b"))


@register("st6_fixed_trees", _scored_sql("""SELECT admission_id AS patient_id, prob_a, prob_b, ensemble_prob, risk_tier, 'v1.0' AS model_version,
       CAST(NULL AS VARCHAR) AS shap_top10 FROM scored"""))
def q_stream(spark, d):
    base = T.roundtrip_path(spark, "admit-topic")
    rows = feats(spark, d).repartition(4)
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    M.run_to_completion(T.predictions_stream_sink(G.ensemble(*models(spark, d), stream), f"{base}/out", f"{base}/_checkpoint", key="admission_id",
                                                  probs={c: c for c in ("prob_a", "prob_b", "ensemble_prob")}, tier="risk_tier"))
    return spark.read.parquet(f"{base}/out").drop("predicted_at", "batch_id")


# ---- metrics of the fixed trees ------------------------------------------------
def scored(spark, d):
    """Label, both models' probabilities and the blend of every row.  Written once: the
    metrics read it many times, and each reading would join the features anew."""
    def make():
        ma, mb = models(spark, d)
        both = G.predict_proba(mb, G.predict_proba(ma, feats(spark, d), "gbt_a"), "gbt_b")
        return cut_lineage(G.ensemble(ma, mb, both).select("admission_id", "label", "gbt_a", "gbt_b", "_blend"))

    return _once(spark, d, "fixed-scores", make)


def in_folds(spark, d):
    """Both models' probabilities with the folds that validation deals, written once."""
    return _once(spark, d, "fixed-folds", lambda: cut_lineage(
        kfold(scored(spark, d).select("admission_id", "label", "gbt_a", "gbt_b"), "label", "admission_id").select("label", "gbt_a", "gbt_b", "fold")))


def _fold_auc(model: str, column: str) -> str:
    """CTEs of one model's AUC per fold, from ``fo``."""
    run = _auc_sql(f"(SELECT fold, label, {column} AS score FROM fo)", "fold").replace("sc AS", f"sc_{model} AS").replace(
        "run AS", f"run_{model} AS").replace("FROM sc)", f"FROM sc_{model})")
    return run + (f", auc_{model} AS (SELECT '{model}' AS model, fold, sum(fp * ((cum_tp - tp) + tp / 2.0)) / (sum(tp) * sum(fp)) AS auc "
                  f"FROM run_{model} GROUP BY fold)")


_FOLDS = """, fo AS (SELECT label, pa, pb, CAST((row_number() OVER (PARTITION BY label
  ORDER BY substr(md5('42:' || CAST(admission_id AS VARCHAR)), 1, 13), admission_id) - 1) % 5 AS INTEGER) AS fold FROM q)"""
_CV = _FOLDS + _fold_auc("gbt_a", "pa") + _fold_auc("gbt_b", "pb") + ", cv AS (SELECT * FROM auc_gbt_a UNION ALL SELECT * FROM auc_gbt_b)"
_EVAL = _auc_sql("(SELECT label, e AS score FROM q)", None) + """, ev AS (
  SELECT round(sum(fp * ((cum_tp - tp) + tp / 2.0)) / (sum(tp) * sum(fp)), 6) AS auc,
         round(sum(tp * (cum_tp / (cum_tp + cum_fp))) / sum(tp), 6) AS average_precision FROM run)"""


@register("ml4_fixed_trees", _scored_sql(_CV + " SELECT model, fold, round(auc, 6) AS auc FROM cv"))
def q_fold_auc(spark, d):
    cv = G.cross_validate(in_folds(spark, d), "label", ["gbt_a", "gbt_b"])
    return cv.select("model", "fold", F.round("auc", 6).alias("auc"))


@register("ml7_fixed_trees", _scored_sql(", phi AS (SELECT " + _phi(TREES_A).replace("round(", "(").replace(", 6)", ")") + " FROM f) " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg(abs(phi_{f})), 4) AS mean_shap FROM phi" for f in USED)))
def q_importance(spark, d):
    rows = TS.importance(models(spark, d)[0], feats(spark, d), "features", ADM_SPEC.names)
    return rows.where(F.col("feature").isin(*USED))


@register("ml10_fixed_trees", _scored_sql(_EVAL + " SELECT auc, average_precision FROM ev"))
def q_train_eval(spark, d):
    return G.train_eval(G.ensemble(*models(spark, d), feats(spark, d)), "label")


@register("io6_fixed_trees", _scored_sql(_CV + _EVAL + """
SELECT 'metric' AS kind, model || '_cv_auc_mean' AS key, round(avg(auc), 4) AS value FROM cv GROUP BY model
UNION ALL SELECT 'metric', model || '_cv_auc_std', round(stddev_pop(auc), 4) FROM cv GROUP BY model
UNION ALL SELECT 'metric', 'ensemble_train_auc', auc FROM ev
UNION ALL SELECT 'metric', 'ensemble_train_ap', average_precision FROM ev
UNION ALL SELECT 'metric', 'n_rows', count(*) FROM f
UNION ALL SELECT 'metric', 'positive_rate', round(avg(label), 6) FROM f
UNION ALL SELECT 'param', 'n_features', 24"""))
def q_run_metrics(spark, d):
    """The run's parameters and metrics through the sink and back."""
    ev = G.train_eval(scored(spark, d), "label").first()
    balance = AG.class_balance(scored(spark, d), "label").first()
    cv = AG.cv_summary(G.cross_validate(in_folds(spark, d), "label", ["gbt_a", "gbt_b"]), "model", "auc").collect()  # a row a model
    metrics = {f"{r['model']}_cv_auc_{k}": r[k] for r in cv for k in ("mean", "std")}
    metrics |= {"ensemble_train_auc": ev["auc"], "ensemble_train_ap": ev["average_precision"], "n_rows": balance["n"],
                "positive_rate": round(balance["positive_rate"], 6)}
    path = T.roundtrip_path(spark, "runs")
    T.run_metrics_sink(spark, {"n_features": len(ADM_SPEC.names)}, metrics, path)
    return spark.read.parquet(path).select("kind", "key", F.col("value").cast("double").alias("value"))
