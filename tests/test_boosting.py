"""The models of the registered queries have all their trees; the fit equals MLlib's."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from riskloom.models import boosting as B
from riskloom.models import gbt as G
from riskloom.plans import fixed_models as FM
from riskloom.plans import models as PM
from riskloom.session import cut_lineage

from conftest import SF001

PARAMS = dict(maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=1)


@pytest.fixture(scope="module")
def rows(spark):
    """Few different values a feature, so that both fits have the same bins."""
    rng, n = np.random.default_rng(3), 1500
    x = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 2, n), rng.integers(0, 7, n), rng.integers(0, 32, n), np.zeros(n)])
    y = (x[:, 0] * 0.3 + x[:, 1] * x[:, 2] - 0.1 * x[:, 3] + rng.normal(size=n) * 2) > 3
    return spark.createDataFrame([([float(v) for v in a], int(b), 2.5 if b else 1.0) for a, b in zip(x, y)],
                                 "features array<double>, label int, w double").cache()


def _apart(a, b, df) -> float:
    both = G.predict_proba(b, G.predict_proba(a, df, "p1"), "p2")
    return both.agg(F.max(F.abs(F.col("p1") - F.col("p2")))).first()[0]


def test_registered_models_have_the_references_trees(monkeypatch):
    asked = []
    monkeypatch.setattr(G, "fit_gbt_a", lambda df, label, max_iter=None: asked.append(max_iter))
    monkeypatch.setattr(G, "fit_gbt_b", lambda df, label, max_iter=None: asked.append(max_iter))
    for fit in PM.FITS.values():
        fit(None, "label")
    assert asked == [600, 600] and PM.TREES == 600


def test_six_hundred_trees_are_fitted(spark, rows):
    m = PM.FITS["gbt_a"](rows.limit(300), "label")
    assert m.getNumTrees == 600 and m.treeWeights[:2] == [1.0, 0.05]


def test_fit_equals_mllib(spark, rows):
    theirs = GBTClassifier(featuresCol=G.VECTOR, labelCol="label", weightCol="w", maxIter=6, **PARAMS).fit(G.to_vector(rows))
    ours = G._fit(rows, "label", PARAMS, 6, "w", "features")
    assert _apart(theirs, ours, rows) < 1e-9
    assert [t.numNodes for t in theirs.trees] == [t.numNodes for t in ours.trees]
    np.testing.assert_allclose(theirs.featureImportances.toArray(), ours.featureImportances.toArray(), atol=1e-9)


def test_fit_in_parts_equals_fit_in_one_task(spark, rows, monkeypatch):
    whole = G._fit(rows, "label", PARAMS, 3, "w", "features")
    monkeypatch.setattr(B, "TASK_ROWS", 400)
    assert _apart(whole, G._fit(rows, "label", PARAMS, 3, "w", "features"), rows) < 1e-9


def test_fit_does_not_depend_on_the_order_of_rows(spark, rows):
    params = PARAMS | dict(subsamplingRate=0.8, featureSubsetStrategy="0.7")
    a = G._fit(rows, "label", params, 4, "w", "features")
    assert _apart(a, G._fit(rows.orderBy(F.rand(1)), "label", params, 4, "w", "features"), rows) == 0.0


def test_edges_come_from_all_rows():
    values = np.arange(200_000, dtype=np.float64)[:, None]
    halves = B._merge([B.sketch_of(values[::2]), B.sketch_of(values[1::2])])
    assert sum(halves[0][1]) == 200_000
    np.testing.assert_allclose(B.edges_of(halves, 32)[0], np.arange(1, 32) * 6250, atol=200)
    rare = np.r_[np.zeros(99_999), 1.0][:, None]   # a value that a sample would miss
    assert B.edges_of(B.sketch_of(rare), 32)[0].tolist() == [0.5]


@pytest.mark.parametrize("bad", ["array(1D, CAST('NaN' AS DOUBLE)) AS features, 1 AS label", "array(1D, 2D) AS features, NULL AS label",
                                 "array(1D, NULL) AS features, 1 AS label", "array(1D, 2D) AS features, 2 AS label"])
def test_missing_values_are_errors(spark, bad):
    good = spark.sql("SELECT array(1D, 2D) AS features, CAST(id % 2 AS INT) AS label FROM range(20)")
    with pytest.raises(Exception, match="must"):
        G._fit(good.unionByName(spark.sql(f"SELECT {bad}")), "label", PARAMS, 2, None, "features")


def test_folds_fit_no_other_models(spark, monkeypatch):
    fits = []

    def small(df, label):
        fits.append(1)
        return G.fit_gbt_a(df, label, 2)

    monkeypatch.setattr(PM, "FITS", {"gbt_a": small, "gbt_b": small})
    monkeypatch.setattr(PM, "_CACHE", {})
    held = PM.held_out(spark, SF001)
    assert len(fits) == 10 and held.count() == held.select("admission_id").distinct().count() == 1500
    PM.QUERIES["ml1_fit_gbt_a"](spark, SF001)
    assert len(fits) == 11


def _runs_of(monkeypatch, module, name) -> list:
    runs, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: (runs.append(1), real(*a, **b))[1])
    return runs


def test_metrics_of_the_fixed_trees_read_written_scores(spark, monkeypatch):
    """F6, F8: features are joined once for all metrics, and no plan of a metric joins tables again."""
    monkeypatch.setattr(PM, "_CACHE", {})
    runs = _runs_of(monkeypatch, FM, "feats")
    cv = FM.QUERIES["ml4_fixed_trees"](spark, SF001)
    assert "orders.parquet" not in cv._jdf.queryExecution().optimizedPlan().toString() and len(cv.inputFiles()) > 0
    assert all("lineage-" in f for f in cv.inputFiles())
    assert FM.QUERIES["io6_fixed_trees"](spark, SF001).count() == 9 and len(runs) == 1


def test_a_written_plan_leaves_no_shuffle_files(spark):
    """F8: what a lineage cut shuffled is gone once it is written; the setting is put back."""
    import os

    def shuffled() -> int:
        # shuffle data files of the session's local folders
        top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(f.startswith("shuffle_") and f.endswith(".data") for d in top for _, _, names in os.walk(d) for f in names)

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key, "false"), shuffled()
    out = cut_lineage(spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).count())
    assert shuffled() <= before and spark.conf.get(key, "false") == was
    assert out.count() == 50_000
