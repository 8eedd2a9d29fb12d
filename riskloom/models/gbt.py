"""Boosted-tree models, ensemble, evaluation and scoring (ML-1..5, ML-7..10).

MLlib's gradient-boosted trees replace both reference learners; :mod:`boosting`
fits them, as MLlib's own fit takes a job per tree level.  They have no L1/L2,
no leaf cap and draw the feature subset per node, so AUC parity with the
reference is not claimed; the number of trees is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import spec
from riskloom.functions import scalar as S
from riskloom.models import boosting
from riskloom.operators import aggregates as AG
from riskloom.operators.ordering import kfold

FEATURES = "features"
#: Trees per model; callers that need a quicker fit pass their number.
N_TREES = 600
VECTOR = "_fvec"


def to_vector(df: DataFrame, features_col: str = FEATURES, out: str = VECTOR) -> DataFrame:
    """array<float> -> ML dense vector, JVM-side (no categorical metadata, so
    every split is a threshold)."""
    return df.withColumn(out, array_to_vector(F.col(features_col)))


def positive_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n_neg / n_pos on positives, 1 on negatives (scale_pos_weight)."""
    lab = F.col(label)
    ratio = df.agg(F.try_divide(F.count_if(lab == 0).cast("double"), F.count_if(lab == 1).cast("double"))).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)).cast("double"))


def _fit(df: DataFrame, label: str, params: dict, max_iter: int, weight: str | None,
         features_col: str) -> GBTClassificationModel:
    p = boosting.Params(maxIter=max_iter, **params)
    data = df.select(F.col(features_col).alias("x"), F.col(label).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    trees, edges = boosting.fit(data, p)
    return boosting.to_mllib(df.sparkSession, trees, edges, p, label, VECTOR)


def fit_gbt_a(df: DataFrame, label: str, max_iter: int = N_TREES, features_col: str = FEATURES) -> GBTClassificationModel:
    """ML-1: depth 6, step .05, min child 5, row .8, col .7, positive-class weight."""
    w = positive_weight(df, label, "_w")
    return _fit(w, label, spec.GBT_A_PARAMS, max_iter, "_w", features_col)


def fit_gbt_b(df: DataFrame, label: str, max_iter: int = N_TREES, features_col: str = FEATURES) -> GBTClassificationModel:
    """ML-2: depth 7, step .05, min child 20, row .8, col .7, balanced weights."""
    w = AG.class_weights(df, label, "_w")
    return _fit(w, label, spec.GBT_B_PARAMS, max_iter, "_w", features_col)


def predict_proba(model: GBTClassificationModel, df: DataFrame, out: str = "prob",
                  features_col: str = FEATURES) -> DataFrame:
    """ML-3: P(class 1) as a double column."""
    scored = model.transform(to_vector(df, features_col))
    cols = [c for c in df.columns] + [vector_to_array(F.col("probability"))[1].alias(out)]
    return scored.select(*cols)


def ensemble(model_a, model_b, df: DataFrame, features_col: str = FEATURES, closed: str = "right") -> DataFrame:
    """ML-5: both probabilities, 50/50 blend (4 dp) and tier on the unrounded blend."""
    a = predict_proba(model_a, df, "_pa", features_col)
    b = predict_proba(model_b, a, "_pb", features_col)
    blend = S.blend(["_pa", "_pb"])
    return (b.withColumn("_blend", blend)
            .withColumn("prob_a", F.round("_pa", 4)).withColumn("prob_b", F.round("_pb", 4))
            .withColumn("ensemble_prob", F.round("_blend", 4))
            .withColumn("risk_tier", S.tier("_blend", closed=closed))
            .drop("_pa", "_pb"))


def out_of_fold(df: DataFrame, label: str, key: str, fits: dict[str, Callable], k: int = 5, seed: int = 42,
                features_col: str = FEATURES, parallelism: int = 5) -> DataFrame:
    """(key, label, fold, one probability per model): every row scored by models
    that never saw it.

    One set of k x models fits serves cross-validation and out-of-fold evaluation
    alike.  The fold table is written once to the shared checkpoint folder, and
    so are the scored folds, so no executor loss repeats a fit; at most
    ``parallelism`` folds, with all their models, are fitted at a time from driver
    threads, one model where a table needs more than a partition per core.
    """
    from concurrent.futures import ThreadPoolExecutor
    from functools import reduce

    from riskloom.session import cut_lineage, fits_at_once
    folds = cut_lineage(kfold(df.select(key, label, features_col), label, key, k=k, seed=seed))
    at_once = fits_at_once(folds, parallelism)

    def one(i: int) -> DataFrame:
        train, held = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
        with ThreadPoolExecutor(max_workers=len(fits) if at_once > 1 else 1) as pool:
            models = list(pool.map(lambda fit: fit(train, label), fits.values()))
        for name, model in zip(fits, models):
            held = predict_proba(model, held, name, features_col)
        return cut_lineage(held.select(key, label, "fold", *fits))

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        parts = list(pool.map(one, range(k)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_validate(scored: DataFrame, label: str, models: Sequence[str]) -> DataFrame:
    """ML-4: (model, fold, auc) from an :func:`out_of_fold` table."""
    out = None
    for m in models:
        part = AG.auc(scored, label, m, digits=None, group_cols=["fold"]).select(F.lit(m).alias("model"), "fold", "auc")
        out = part if out is None else out.unionByName(part)
    return out


def train_eval(scored: DataFrame, label: str, prob: str = "_blend") -> DataFrame:
    """ML-10: AUC and AP of the blend on the given rows (in-sample unless the
    scores came from held-out folds); one set of running totals for both."""
    return AG.auc_ap(scored, label, prob)


def save_model(model: GBTClassificationModel, path: str, feature_names: Sequence[str]) -> str:
    """IO-7: MLlib's own format plus the ordered feature list beside it."""
    from pyspark.sql import SparkSession

    from riskloom.sources.tables import write_feature_list
    model.write().overwrite().save(f"{path}/model")
    write_feature_list(SparkSession.getActiveSession(), feature_names, f"{path}/features")
    return path


def load_model(spark, path: str) -> tuple[GBTClassificationModel, list[str]]:
    from riskloom.sources.tables import read_feature_list
    return GBTClassificationModel.load(f"{path}/model"), read_feature_list(spark, f"{path}/features")
