"""The same operators on a table with missing values: every seventh admission has
a NULL score, every eleventh a NaN one, every thirteenth no label.  NaN counts as
missing: it sorts last, passes no bound, ranks last and is left out of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import spec
from riskloom.functions import scalar as S
from riskloom.operators import aggregates as AG
from riskloom.operators import ordering as SL
from riskloom.operators import relational as R
from riskloom.operators import windows as WI
from riskloom.plans.fixture import admissions, table, with_admissions

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def gappy(spark, d):
    """Admissions with holes in score and label."""
    i = F.col("admission_id")
    return (admissions(spark, d)
            .withColumn("score", F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, F.lit(float("nan"))).otherwise(F.col("score")))
            .withColumn("label", F.when(i % 13 == 0, F.lit(None)).otherwise(F.col("label")))
            .select("admission_id", "patient_id", "risk_tier", "score", "label"))


def gappy_sql(body: str) -> str:
    """``gappy`` as a table where NaN stays NaN in score and is NULL in s."""
    return with_admissions(f""", g0 AS (
  SELECT admission_id, patient_id, risk_tier,
         CASE WHEN admission_id % 7 = 0 THEN NULL WHEN admission_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE score END AS score,
         CASE WHEN admission_id % 13 = 0 THEN NULL ELSE label END AS label FROM admissions),
gappy AS (SELECT *, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM g0)
{body}""")


COLS = ["admission_id", "risk_tier", "score", "label"]
_COLS = ", ".join(COLS)


@register("sl1_sort_by_missing", gappy_sql("""
SELECT admission_id, row_number() OVER (ORDER BY s DESC NULLS LAST, admission_id) AS pos FROM gappy"""))
def q_sort(spark, d):
    out = SL.sort_by(gappy(spark, d).select("admission_id", "score"), "score", "desc", ["admission_id"])
    # The order itself is the result: number the sorted rows by the same key.
    return WI.global_rank(out.select("admission_id", S.missing_as_null("score").alias("s")),
                          [F.desc_nulls_last("s"), F.asc("admission_id")], "pos").select("admission_id", F.col("pos").cast("long").alias("pos"))


@register("sl2_page_missing", gappy_sql(f"""
SELECT {_COLS} FROM gappy ORDER BY s DESC NULLS LAST, admission_id LIMIT 50 OFFSET 50"""))
def q_page(spark, d):
    return SL.page(gappy(spark, d).select(*COLS), "score", "desc", ["admission_id"], 2, 50)


@register("sl4_top_k_missing", gappy_sql(f"SELECT {_COLS} FROM gappy ORDER BY s DESC NULLS LAST, admission_id LIMIT 20"))
def q_top_k(spark, d):
    return SL.top_k(gappy(spark, d).select(*COLS), "score", 20, ["admission_id"])


@register("sl6_kfold_missing", gappy_sql("""
SELECT admission_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY substr(md5('42:' || admission_id), 1, 13), admission_id) - 1) % 5
       AS INTEGER) AS fold FROM gappy"""))
def q_kfold(spark, d):
    return SL.kfold(gappy(spark, d), "label", "admission_id", k=5, seed=42).select("admission_id", "label", "fold")


@register("sl7_keyset_page_missing", gappy_sql(f"""
SELECT {_COLS} FROM gappy WHERE s IS NULL AND admission_id > 100 ORDER BY admission_id LIMIT 50"""))
def q_keyset(spark, d):
    """A page among the rows without a score, after (NULL, 100)."""
    return SL.keyset_page(gappy(spark, d).select(*COLS), "score", "admission_id", 50, after=(None, 100))


@register("fi2_filter_range_missing", gappy_sql(f"SELECT {_COLS} FROM gappy WHERE s >= 0.5"))
def q_range(spark, d):
    return R.filter_range(gappy(spark, d).select(*COLS), "score", lo=0.5)


@register("fi4_top_of_tier_missing", gappy_sql(f"""
SELECT {_COLS} FROM gappy WHERE risk_tier = 'High' ORDER BY s DESC NULLS LAST, admission_id LIMIT 25"""))
def q_top_of_tier(spark, d):
    return R.top_of_tier(gappy(spark, d).select(*COLS), "risk_tier", "High", "score", 25, ["admission_id"])


_RANKED = gappy_sql("""
, r AS (SELECT s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS fp
        FROM gappy WHERE s IS NOT NULL AND label IS NOT NULL GROUP BY s),
c AS (SELECT *, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(fp) OVER (ORDER BY s DESC) AS cfp FROM r)
""")


@register("ag14_auc_missing", _RANKED + "SELECT round(sum(fp * (ctp - tp + tp / 2.0)) / (sum(tp) * sum(fp)), 6) AS auc FROM c")
def q_auc(spark, d):
    return AG.auc(gappy(spark, d), "label", "score")


@register("ag15_average_precision_missing", _RANKED + """
SELECT round(sum(tp * (ctp / (ctp + cfp))) / sum(tp), 6) AS average_precision FROM c""")
def q_ap(spark, d):
    return AG.average_precision(gappy(spark, d), "label", "score")


@register("wi1_rank_groups_missing", gappy_sql("""
SELECT admission_id, CAST(row_number() OVER (ORDER BY s DESC NULLS LAST, admission_id) AS INTEGER) AS rank FROM gappy"""))
def q_rank(spark, d):
    return WI.rank_groups(gappy(spark, d).select("admission_id", "score"), "score", "admission_id").select("admission_id", "rank")


_BAND = " ".join(f"WHEN s / m > {t!r} THEN '{lab}'" for t, lab in spec.RELATIVE_BANDS)


@register("wi5_relative_band_missing", gappy_sql(f"""
SELECT admission_id, round(s / m, 4) AS share_of_max, CASE {_BAND} ELSE '{spec.RELATIVE_BAND_ELSE}' END AS band
FROM gappy, (SELECT max(s) AS m FROM gappy)"""))
def q_band(spark, d):
    return WI.relative_band(gappy(spark, d), "score").select("admission_id", "share_of_max", "band")


@register("sc9_scorecard_missing", gappy_sql("""
SELECT admission_id, round(1 / (1 + exp(-(-1 + 2 * (s - 0.5) + 0.5 * ln(1 + s) + 3 * greatest(s - 0.6, 0) + 1.5 * least(s - 0.2, 0)
       + 0.7 * CASE WHEN risk_tier = 'High' THEN 1 ELSE 0 END))), 6) AS risk FROM gappy"""))
def q_scorecard(spark, d):
    z = S.scorecard([("linear", "score", 2.0, 0.5), ("log1p", "score", 0.5), ("hinge_up", "score", 3.0, 0.6),
                     ("hinge_down", "score", 1.5, 0.2), ("is", "risk_tier", 0.7, "High")], intercept=-1.0)
    return gappy(spark, d).select("admission_id", F.round(z, 6).alias("risk"))


# Parts of operators that the other plans do not reach ---------------------------
@register("ag17_constraint_audit_unique", """
SELECT CAST((SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) AS dup_keys,
       CAST(0 AS BIGINT) AS dup_rows, CAST(count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS null_keys,
       (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS notunique_o_custkey,
       (SELECT count(*) FROM (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(*) > 1)) AS notunique_o_orderpriority
FROM orders""")
def q_audit(spark, d):
    return AG.constraint_audit(table(spark, d, "orders"), ["o_orderkey"], unique=["o_custkey", "o_orderpriority"])


@register("sc22_explanation_array", """
SELECT l_orderkey, l_linenumber, 'quantity' AS feature, round(l_quantity / 50, 4) AS shap_value, 'up' AS direction FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, 'discount', round(0 - l_discount, 4), 'down' FROM lineitem""")
def q_explanation(spark, d):
    """An array of explanation rows to JSON text and back."""
    li = table(spark, d, "lineitem")
    item = lambda n, v, w: F.struct(F.lit(n).alias("feature"), F.round(v, 4).alias("shap_value"), F.lit(w).alias("direction"))
    arr = F.array(item("quantity", F.col("l_quantity") / 50, "up"), item("discount", 0 - F.col("l_discount"), "down"))
    text = li.select("l_orderkey", "l_linenumber", arr.alias("a")).select("l_orderkey", "l_linenumber", S.to_explanation_json("a").alias("t"))
    return text.select("l_orderkey", "l_linenumber", F.explode(S.from_explanation_json("t")).alias("e")).select("l_orderkey", "l_linenumber", "e.*")


@register("sc27_series_as_arrays", """
SELECT list(n_nationkey ORDER BY n_nationkey) AS n_nationkey, list(n_name ORDER BY n_nationkey) AS n_name FROM nation""")
def q_series(spark, d):
    return S.series_as_arrays(table(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_name"])


@register("io5_predictions_explained", with_admissions("""
SELECT admission_id AS patient_id, score AS prob_a, round(score / 2, 6) AS prob_b, round(0.75 * score, 6) AS ensemble_prob, risk_tier,
       'v1.0' AS model_version,
       '[{"feature":"los","shap_value":' || CAST(coalesce(los, 0) AS VARCHAR) || '}]' AS shap_top10 FROM admissions"""))
def q_predictions(spark, d):
    from riskloom.sources import tables as T
    path = T.roundtrip_path(spark, "predictions")
    adm = admissions(spark, d).select(
        "admission_id", F.col("score").alias("pa"), F.round(F.col("score") / 2, 6).alias("pb"), F.round(F.col("score") * 0.75, 6).alias("pe"),
        "risk_tier", F.array(F.struct(F.lit("los").alias("feature"), F.coalesce("los", F.lit(0.0)).alias("shap_value"))).alias("why"))
    T.predictions_sink(adm, path, key="admission_id", probs={"prob_a": "pa", "prob_b": "pb", "ensemble_prob": "pe"}, tier="risk_tier",
                       explanation="why")
    return spark.read.parquet(path).drop("predicted_at")
