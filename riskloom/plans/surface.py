"""Query surface over the fixture: filters, projections, sorts, aggregates,
windows and joins (PR, FI, SL, AG, WI, JO).  Each entry pairs a Spark plan
with the DuckDB text of the same question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import spec
from riskloom.functions import scalar as S
from riskloom.operators import aggregates as AG
from riskloom.operators import heavy as HG
from riskloom.operators import ordering as SL
from riskloom.operators import relational as R
from riskloom.operators import sketches as SK
from riskloom.operators import windows as WI
from riskloom.plans.fixture import (EVENT_RANGES, HOSPITAL_DEFAULTS, admissions, hospital_dim, table,
                                    with_admissions)
from riskloom.sources.tables import roundtrip_path

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


PATIENT_COLS = ["admission_id", "patient_id", "hospital_id", "score", "risk_tier", "label", "los",
                "priority", "status", "segment"]
PATIENT_COLS_SQL = ", ".join(PATIENT_COLS)


def _share_sql(tier: str) -> str:
    return f"round(avg(CASE WHEN risk_tier = '{tier}' THEN 1.0 ELSE 0.0 END), 4)"


# --------------------------------------------------------------------------
# AG-4 + JO-2 + SC-7: the flagship
# --------------------------------------------------------------------------
def hospital_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    adm = admissions(spark, sf_dir)
    g = AG.group_summary(adm, "hospital_id", "score", "label", "los", "risk_tier")
    out = R.join_dimension(g, hospital_dim(spark, sf_dir), "hospital_id", defaults=HOSPITAL_DEFAULTS,
                           key_default={"name": "hospital_id"})
    return out.select("hospital_id", "name", "city", "lat", "lon", "n", "avg_score", "label_rate",
                      "avg_los", "pct_critical", "pct_high")


_GROUP_SUMMARY_SQL = f"""
, g AS (SELECT hospital_id, count(*) AS n, round(avg(score), 4) AS avg_score,
               round(avg(label), 4) AS label_rate, round(avg(los), 2) AS avg_los,
               {_share_sql('Critical')} AS pct_critical, {_share_sql('High')} AS pct_high
        FROM admissions WHERE hospital_id IS NOT NULL GROUP BY hospital_id)
"""

register("ag4_group_summary", with_admissions(_GROUP_SUMMARY_SQL + """
SELECT g.hospital_id, coalesce(d.name, CAST(g.hospital_id AS VARCHAR)) AS name,
       coalesce(d.city, 'Unknown') AS city, coalesce(d.lat, 39.5) AS lat, coalesce(d.lon, -98.35) AS lon,
       n, avg_score, label_rate, avg_los, pct_critical, pct_high
FROM g LEFT JOIN hospital_dim d ON g.hospital_id = d.hospital_id""", dims=True))(hospital_summary)


@register("ag1_kpis", with_admissions("""
SELECT count(*) AS total, round(avg(label), 4) AS label_rate, round(avg(score), 4) AS avg_score,
       round(avg(los), 2) AS avg_los, count(DISTINCT hospital_id) AS n_groups FROM admissions"""))
def q_kpis(spark, d):
    return AG.kpis(admissions(spark, d), "label", "score", "los", "hospital_id")


@register("ag2_tier_counts", with_admissions("""
SELECT risk_tier, count(*) AS n FROM admissions WHERE risk_tier IS NOT NULL GROUP BY risk_tier"""))
def q_tier_counts(spark, d):
    return AG.tier_counts(admissions(spark, d), "risk_tier")


_TIER_SPINE = " UNION ALL ".join(f"SELECT {i} AS tier_rank, '{t}' AS tier" for i, t in enumerate(spec.TIER_LABELS))


@register("ag3_tier_counts_ordered", with_admissions(f"""
, spine AS ({_TIER_SPINE}),
c AS (SELECT risk_tier AS tier, count(*) AS n FROM admissions WHERE risk_tier IS NOT NULL GROUP BY 1)
SELECT CAST(tier_rank AS INTEGER) AS tier_rank, spine.tier, coalesce(c.n, 0) AS n
FROM spine LEFT JOIN c ON spine.tier = c.tier"""))
def q_tier_counts_ordered(spark, d):
    return AG.tier_counts_ordered(admissions(spark, d), "risk_tier")


@register("ag5_group_mean_count", with_admissions("""
SELECT hospital_id, round(avg(score), 4) AS avg_value, count(*) AS n
FROM admissions WHERE hospital_id IS NOT NULL GROUP BY hospital_id"""))
def q_group_mean_count(spark, d):
    return AG.group_mean_count(admissions(spark, d), "hospital_id", "score")


_LINE_ADM_SQL = """
, lines AS (SELECT l.l_orderkey, p.p_brand, a.score, a.label
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
            JOIN admissions a ON l.l_orderkey = a.admission_id)
"""


def _lines_with_brand(spark, d):
    adm = admissions(spark, d).select("admission_id", "score", "label")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return (li.join(p, li.l_partkey == p.p_partkey, "inner")
            .join(adm, li.l_orderkey == adm.admission_id, "inner"))


@register("ag6_breakdown", with_admissions(_LINE_ADM_SQL + """
SELECT p_brand, count(*) AS count, round(avg(score), 4) AS avg_score, round(avg(label), 4) AS label_rate
FROM lines GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 15"""))
def q_breakdown(spark, d):
    return AG.breakdown(_lines_with_brand(spark, d), "p_brand", "score", "label", n=15)


@register("ag6_breakdown_bounded", with_admissions("""
, lines AS (SELECT l.l_partkey, a.score, a.label FROM lineitem l JOIN admissions a ON l.l_orderkey = a.admission_id)
SELECT l_partkey, count(*) AS count, round(avg(score), 4) AS avg_score, round(avg(label), 4) AS label_rate
FROM lines WHERE l_partkey IS NOT NULL GROUP BY l_partkey ORDER BY count DESC, l_partkey LIMIT 15"""))
def q_breakdown_bounded(spark, d):
    """The commonest parts among very many: bounds first, then only the candidates.
    The candidates are found on the lines alone, before the join, as each has one order."""
    adm = admissions(spark, d).select("admission_id", "score", "label")
    few = HG.candidates(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", 15)
    return AG.breakdown(few.join(adm, few.l_orderkey == adm.admission_id), "l_partkey", "score", "label", n=15)


def _hist_sql(col: str) -> str:
    edges = AG.histogram_edges()
    inner = ", ".join(repr(e) for e in edges[1:-1])
    spine = " UNION ALL ".join(f"SELECT {i} AS bin, {round(edges[i], 2)!r} AS bin_start" for i in range(len(edges) - 1))
    return f"""
, b AS (SELECT len(list_filter([{inner}], lambda e: e <= {col})) AS bin FROM admissions
        WHERE {col} >= {edges[0]!r} AND {col} <= {edges[-1]!r}),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
spine AS ({spine})
SELECT CAST(spine.bin AS INTEGER) AS bin, CAST(bin_start AS DOUBLE) AS bin_start, coalesce(c.count, 0) AS count
FROM spine LEFT JOIN c ON spine.bin = c.bin"""


@register("ag7_histogram", with_admissions(_hist_sql("score")))
def q_histogram(spark, d):
    return AG.histogram(admissions(spark, d), "score")


_DECILES = ", ".join(repr(i / 10) for i in range(11))


@register("ag8_quantile_buckets", with_admissions(f"""
, e AS (SELECT list_sort(list_distinct(quantile_cont(score, [{_DECILES}]))) AS e FROM admissions),
b AS (SELECT len(list_filter(e.e[2:len(e.e) - 1], lambda x: x < a.score)) AS bucket
      FROM admissions a, e WHERE a.score IS NOT NULL),
c AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket),
idx AS (SELECT unnest(generate_series(1, len(e) - 1)) AS i, e FROM e)
SELECT CAST(i - 1 AS INTEGER) AS bucket, round(e[i], 4) AS lo, round(e[i + 1], 4) AS hi, coalesce(c.n, 0) AS n
FROM idx LEFT JOIN c ON idx.i - 1 = c.bucket"""))
def q_quantile_buckets(spark, d):
    return AG.quantile_buckets(admissions(spark, d), "score", q=10)


@register("ag9_class_balance", with_admissions("""
SELECT count(*) AS n, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
       CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
       round(avg(label), 6) AS positive_rate,
       round(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN label = 1 THEN 1 ELSE 0 END), 6) AS neg_pos_ratio
FROM admissions WHERE label IS NOT NULL"""))
def q_class_balance(spark, d):
    return AG.class_balance(admissions(spark, d), "label")


@register("ag10_class_weights", with_admissions("""
, c AS (SELECT label, count(*) AS nc FROM admissions GROUP BY label),
w AS (SELECT label, (sum(nc) OVER ()) / (count(*) OVER () * nc) AS weight FROM c)
SELECT a.admission_id, a.label, round(w.weight, 6) AS weight FROM admissions a JOIN w ON a.label = w.label"""))
def q_class_weights(spark, d):
    adm = admissions(spark, d).select("admission_id", "label")
    return AG.class_weights(adm, "label").select("admission_id", "label", F.round("weight", 6).alias("weight"))


_LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("ag11_medians", "SELECT " + ", ".join(f"round(median({c}), 6) AS {c}" for c in _LINE_NUM) + " FROM lineitem")
def q_medians(spark, d):
    m = AG.medians(table(spark, d, "lineitem"), _LINE_NUM)
    return m.select(*[F.round(c, 6).alias(c) for c in _LINE_NUM])


def _folds_sql(k: int = 5, seed: int = 42) -> str:
    return f"""
, folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY label
              ORDER BY substr(md5('{seed}:' || CAST(admission_id AS VARCHAR)), 1, 13), admission_id) - 1) % {k} AS INTEGER) AS fold
            FROM admissions)
"""


def _auc_sql(src: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
, sc AS (SELECT {g}score AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS tp,
                sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS fp
         FROM {src} WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY {g}score),
run AS (SELECT *, sum(tp) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_tp,
               sum(fp) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_fp
        FROM sc)
"""


@register("ag11_merged_sketches", with_admissions("""
SELECT risk_tier, count(*) AS n, round(avg(score), 6) AS score_mean, min(score) AS score_min, max(score) AS score_max,
       TRUE AS median_within_bound FROM admissions GROUP BY risk_tier"""))
def q_merged_sketches(spark, d):
    """Eight batches sketched one by one, merged per tier; the median's true rank is
    held against the stated bound."""
    path = roundtrip_path(spark, "sketches")
    adm = admissions(spark, d).select("admission_id", "risk_tier", "score")
    for b in range(8):
        SK.write_batch(SK.batch_sketches(adm.where(F.col("admission_id") % 8 == b), ["score"], by=["risk_tier"]), path, b)
    found = SK.summary(SK.merged(spark, path, ["score"], by=["risk_tier"]), ["score"], by=["risk_tier"])
    m = F.col("score_median")
    ranks = adm.join(found, "risk_tier").groupBy("risk_tier").agg(F.count_if(F.col("score") < m).alias("below"), F.count_if(F.col("score") <= m).alias("upto"))
    e = F.lit(SK.rank_error())
    within = (F.col("below") / F.col("n") - e <= 0.5) & (F.col("upto") / F.col("n") + e >= 0.5)
    return found.join(ranks, "risk_tier").select("risk_tier", "n", F.round("score_mean", 6).alias("score_mean"), "score_min", "score_max",
                                                 within.alias("median_within_bound"))


@register("ag13_cv_summary", with_admissions(_folds_sql() + _auc_sql("folds", "fold") + """
, per AS (SELECT fold, sum(fp * ((cum_tp - tp) + tp / 2.0)) / (sum(tp) * sum(fp)) AS auc FROM run GROUP BY fold)
SELECT 'auc' AS metric, count(*) AS n_folds, round(avg(auc), 4) AS mean, round(stddev_pop(auc), 4) AS std FROM per"""))
def q_cv_summary(spark, d):
    adm = SL.kfold(admissions(spark, d), "label", "admission_id", k=5, seed=42)
    per = AG.auc(adm, "label", "score", group_cols=["fold"], digits=None)
    return AG.cv_summary(per.withColumn("metric", F.lit("auc")), "metric", "auc")


@register("ag14_auc", with_admissions(_auc_sql("admissions", None) + """
SELECT round(sum(fp * ((cum_tp - tp) + tp / 2.0)) / (sum(tp) * sum(fp)), 6) AS auc FROM run"""))
def q_auc(spark, d):
    return AG.auc(admissions(spark, d), "label", "score")


@register("ag15_average_precision", with_admissions(_auc_sql("admissions", None) + """
SELECT round(sum(tp * (cum_tp / (cum_tp + cum_fp))) / sum(tp), 6) AS average_precision FROM run"""))
def q_ap(spark, d):
    return AG.average_precision(admissions(spark, d), "label", "score")


_PROFILE_GROUPS = {"ids": ["admission_id", "patient_id", "hospital_id"],
                   "numeric": ["score", "score_raw", "los"],
                   "categorical": ["risk_tier", "priority", "status", "segment"]}


@register("ag16_profile", with_admissions("""
SELECT count(*) AS n_rows, 12 AS n_columns, 3 AS n_ids, 3 AS n_numeric, 4 AS n_categorical,
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM admissions"""))
def q_profile(spark, d):
    return AG.profile(admissions(spark, d), _PROFILE_GROUPS, label="label")


@register("ag17_constraint_audit", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n,
                  count(*) FILTER (WHERE l_partkey IS NULL) AS nn,
                  count(*) FILTER (WHERE length(l_returnflag) > 1) AS tl
           FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT count(*) FILTER (WHERE n > 1 AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL) AS dup_keys,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1 AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL), 0) AS BIGINT) AS dup_rows,
       CAST(coalesce(sum(n) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT) AS null_keys,
       CAST(coalesce(sum(nn), 0) AS BIGINT) AS null_l_partkey,
       CAST(coalesce(sum(tl), 0) AS BIGINT) AS toolong_l_returnflag
FROM k""")
def q_constraint_audit(spark, d):
    return AG.constraint_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
                               not_null=["l_partkey"], max_len={"l_returnflag": 1})


# --------------------------------------------------------------------------
# Windows
# --------------------------------------------------------------------------
@register("wi1_rank_groups", with_admissions(_GROUP_SUMMARY_SQL + """
SELECT hospital_id, avg_score, CAST(row_number() OVER (ORDER BY avg_score DESC NULLS LAST, hospital_id) AS INTEGER) AS rank FROM g"""))
def q_rank_groups(spark, d):
    g = AG.group_summary(admissions(spark, d), "hospital_id", "score", "label", "los", "risk_tier")
    return WI.rank_groups(g.select("hospital_id", "avg_score"), "avg_score", "hospital_id")


def _part_attrs(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey",
                    F.round((F.col("p_size") - 25) / F.lit(25.0), 4).alias("size_dev"),
                    F.round((F.col("p_retailprice") - 1500) / F.lit(1000.0), 4).alias("price_dev"),
                    F.round((F.length("p_name") - 20) / F.lit(20.0), 4).alias("name_dev"))


_PART_ATTRS_SQL = """
WITH attrs AS (SELECT p_partkey, round((p_size - 25) / 25.0, 4) AS size_dev,
                      round((p_retailprice - 1500) / 1000.0, 4) AS price_dev,
                      round((length(p_name) - 20) / 20.0, 4) AS name_dev FROM part),
long AS (SELECT p_partkey, 'size_dev' AS feature, size_dev AS value FROM attrs
         UNION ALL SELECT p_partkey, 'price_dev', price_dev FROM attrs
         UNION ALL SELECT p_partkey, 'name_dev', name_dev FROM attrs)
"""


@register("wi2_top_drivers", _PART_ATTRS_SQL + """
SELECT * FROM (SELECT p_partkey, feature, value,
       CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY abs(value) DESC, feature) AS INTEGER) AS rank FROM long)
WHERE rank <= 2""")
def q_top_drivers(spark, d):
    long = _part_attrs(spark, d).unpivot(["p_partkey"], ["size_dev", "price_dev", "name_dev"], "feature", "value")
    return WI.top_drivers(long, "p_partkey", "feature", "value", 2)


@register("wi3_last_n", """
SELECT * FROM (SELECT event_id, user_id, ts, value,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS recency FROM events)
WHERE recency <= 60""")
def q_last_n(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return WI.last_n(ev, "user_id", "ts", n=60, tiebreak="event_id")


@register("wi4_latest", """
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q_latest(spark, d):
    return WI.latest(table(spark, d, "events"), "user_id", "ts", ["event_type", "value"], tiebreak="event_id")


_BAND_SQL = " ".join(f"WHEN share > {t!r} THEN '{lab}'" for t, lab in spec.RELATIVE_BANDS)


@register("wi5_relative_band", f"""
WITH c AS (SELECT p_brand, count(*) AS n FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p_brand),
s AS (SELECT p_brand, n, n / (SELECT max(n) FROM c) AS share FROM c)
SELECT p_brand, n, round(share, 4) AS share_of_max, CASE {_BAND_SQL} ELSE '{spec.RELATIVE_BAND_ELSE}' END AS band FROM s""")
def q_relative_band(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    c = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return WI.relative_band(c, "n")


@register("wi6_return_within", with_admissions("SELECT admission_id, patient_id, label FROM admissions"))
def q_return_within(spark, d):
    return admissions(spark, d).select("admission_id", "patient_id", "label")


@register("wi7_prior_count", """
SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(epoch(o_orderdate) AS BIGINT)
       RANGE BETWEEN 31536000 PRECEDING AND 1 PRECEDING) AS prior_count FROM orders""")
def q_prior_count(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return WI.prior_count(o, "o_custkey", "o_orderdate", days=365).select("o_orderkey", "o_custkey", "prior_count")


# --------------------------------------------------------------------------
# Sorts, pages, samples, folds
# --------------------------------------------------------------------------
@register("sl1_sort_by", with_admissions(f"SELECT {PATIENT_COLS_SQL} FROM admissions ORDER BY los ASC NULLS LAST, admission_id"))
def q_sort_by(spark, d):
    return SL.sort_by(admissions(spark, d).select(*PATIENT_COLS), "los", "asc", ["admission_id"])


@register("sl2_page", with_admissions(f"""
SELECT {PATIENT_COLS_SQL} FROM admissions WHERE hospital_id = 7
ORDER BY score DESC NULLS LAST, admission_id LIMIT 50 OFFSET 100"""))
def q_page(spark, d):
    adm = R.filter_optional(admissions(spark, d), {"hospital_id": 7, "risk_tier": ""})
    return SL.page(adm.select(*PATIENT_COLS), "score", "desc", ["admission_id"], page_no=3, size=50)


@register("sl2_deep_page", with_admissions(f"""
SELECT {PATIENT_COLS_SQL} FROM admissions ORDER BY score DESC NULLS LAST, admission_id LIMIT 50 OFFSET 9950"""))
def q_deep_page(spark, d):
    """A page beyond the rows that are simply skipped: found by its first key."""
    adm = admissions(spark, d)
    return SL.page(adm.select(*PATIENT_COLS), "score", "desc", ["admission_id"], page_no=200, size=50)


@register("sl3_page_info", with_admissions("""
SELECT count(*) AS total, 2 AS page, 25 AS page_size, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages
FROM admissions WHERE hospital_id = 7 AND risk_tier = 'High'"""))
def q_page_info(spark, d):
    adm = R.filter_optional(admissions(spark, d), {"hospital_id": 7, "risk_tier": "High"})
    return SL.page_info(adm, 2, 25)


@register("sl4_top_k", with_admissions(f"SELECT {PATIENT_COLS_SQL} FROM admissions ORDER BY score DESC NULLS LAST, admission_id LIMIT 25"))
def q_top_k(spark, d):
    return SL.top_k(admissions(spark, d).select(*PATIENT_COLS), "score", 25, ["admission_id"])


@register("sl5_sample_n", with_admissions("""
SELECT admission_id, score FROM admissions ORDER BY md5('7:' || CAST(admission_id AS VARCHAR)), admission_id LIMIT 500"""))
def q_sample_n(spark, d):
    return SL.sample_n(admissions(spark, d).select("admission_id", "score"), 500, 7, "admission_id")


@register("sl6_kfold", with_admissions(_folds_sql() + "SELECT admission_id, label, fold FROM folds"))
def q_kfold(spark, d):
    return SL.kfold(admissions(spark, d).select("admission_id", "label"), "label", "admission_id", k=5, seed=42)


@register("sl7_keyset_page", with_admissions(f"""
SELECT {PATIENT_COLS_SQL} FROM admissions WHERE score IS NOT NULL AND (score < 0.5 OR (score = 0.5 AND admission_id > 1000))
ORDER BY score DESC, admission_id LIMIT 50"""))
def q_keyset_page(spark, d):
    return SL.keyset_page(admissions(spark, d).select(*PATIENT_COLS), "score", "admission_id", 50, after=(0.5, 1000))


# --------------------------------------------------------------------------
# Filters and projections
# --------------------------------------------------------------------------
@register("fi1_filter_optional", with_admissions(f"SELECT {PATIENT_COLS_SQL} FROM admissions WHERE hospital_id = 3 AND status = 'F'"))
def q_filter_optional(spark, d):
    adm = admissions(spark, d).select(*PATIENT_COLS)
    return R.filter_optional(adm, {"hospital_id": 3, "risk_tier": None, "status": "F", "segment": ""})


@register("fi2_filter_range", with_admissions(f"SELECT {PATIENT_COLS_SQL} FROM admissions WHERE score >= 0.0 AND score <= 0.25"))
def q_filter_range(spark, d):
    return R.filter_range(admissions(spark, d).select(*PATIENT_COLS), "score", 0.0, 0.25)


@register("fi3_lookup", with_admissions(f"""
SELECT {PATIENT_COLS_SQL} FROM admissions WHERE patient_id = 100 ORDER BY admit_ts, admission_id LIMIT 1"""))
def q_lookup(spark, d):
    adm = admissions(spark, d)
    return R.lookup(adm, "patient_id", 100, order_by=["admit_ts", "admission_id"]).select(*PATIENT_COLS)


@register("fi4_top_of_tier", with_admissions(f"""
SELECT {PATIENT_COLS_SQL} FROM admissions WHERE risk_tier = 'Critical' ORDER BY score DESC, admission_id LIMIT 10"""))
def q_top_of_tier(spark, d):
    adm = admissions(spark, d).select(*PATIENT_COLS)
    return R.top_of_tier(adm, "risk_tier", "Critical", "score", 10, tiebreak=["admission_id"])


def _ranges_sql(col: str, value: str) -> str:
    lo = " ".join(f"WHEN {col} = '{k}' THEN {a!r}" for k, (a, _) in EVENT_RANGES.items())
    hi = " ".join(f"WHEN {col} = '{k}' THEN {b!r}" for k, (_, b) in EVENT_RANGES.items())
    return f"coalesce({value} < (CASE {lo} END) OR {value} > (CASE {hi} END), false)"


@register("fi5_abnormal_only", f"SELECT * FROM events WHERE {_ranges_sql('event_type', 'value')}")
def q_abnormal_only(spark, d):
    return R.abnormal_only(table(spark, d, "events"), "value", "event_type", EVENT_RANGES)


@register("pr1_project", with_admissions(f"SELECT {PATIENT_COLS_SQL} FROM admissions"))
def q_project(spark, d):
    return R.project(admissions(spark, d), PATIENT_COLS)


@register("pr2_project_except", "SELECT * EXCLUDE (l_orderkey, l_partkey, l_suppkey, l_linenumber) FROM lineitem")
def q_project_except(spark, d):
    return R.project_except(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@register("pr3_rename", with_admissions("""
SELECT hospital_id, round(avg(score), 4) AS avg_risk, count(*) AS n_patients
FROM admissions WHERE hospital_id IS NOT NULL GROUP BY hospital_id"""))
def q_rename(spark, d):
    g = AG.group_mean_count(admissions(spark, d), "hospital_id", "score")
    return R.rename(g, {"avg_value": "avg_risk", "n": "n_patients"})


@register("pr4_cast_all", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CAST({c} AS FLOAT) AS {c}" for c in _LINE_NUM) + ", l_returnflag FROM lineitem")
def q_cast_all(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_NUM, "l_returnflag")
    return R.cast_all(li, _LINE_NUM, "float")


# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------
@register("jo1_assemble_entities", """
SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_nationkey, n.n_name, o.o_totalprice
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_assemble_entities(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.assemble_entities(o, [c], "o_custkey").join(n, "c_nationkey", "inner") \
        .select("o_orderkey", "o_custkey", "c_name", "c_nationkey", "n_name", "o_totalprice")


@register("jo2_join_dimension", with_admissions("""
, g AS (SELECT hospital_id, round(avg(score), 4) AS avg_value, count(*) AS n
        FROM admissions WHERE hospital_id IS NOT NULL GROUP BY hospital_id)
SELECT g.hospital_id, avg_value, n, coalesce(d.name, CAST(g.hospital_id AS VARCHAR)) AS name,
       coalesce(d.city, 'Unknown') AS city, coalesce(d.lat, 39.5) AS lat, coalesce(d.lon, -98.35) AS lon
FROM g LEFT JOIN hospital_dim d ON g.hospital_id = d.hospital_id""", dims=True))
def q_join_dimension(spark, d):
    g = AG.group_mean_count(admissions(spark, d), "hospital_id", "score")
    return R.join_dimension(g, hospital_dim(spark, d), "hospital_id", defaults=HOSPITAL_DEFAULTS,
                            key_default={"name": "hospital_id"})


@register("jo3_map_codes", """
SELECT c.c_custkey, c.c_nationkey, coalesce(n.n_name, 'Unknown') AS n_name, n.n_regionkey
FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c.c_nationkey = n.n_nationkey""")
def q_map_codes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    dim = table(spark, d, "nation").where(F.col("n_nationkey") < 20)
    return R.map_codes(c, "c_nationkey", dim, "n_nationkey", "n_name")


_PAYLOAD_SQL = """
WITH payload AS (SELECT p_partkey, CASE WHEN p_size < 20 THEN p_retailprice END AS p_retailprice,
                        CASE WHEN p_size > 30 THEN p_brand END AS p_brand FROM part),
base AS (SELECT * FROM part ORDER BY p_partkey LIMIT 1)
"""


def _payload(spark, d):
    p = table(spark, d, "part")
    payload = p.select("p_partkey", F.when(F.col("p_size") < 20, F.col("p_retailprice")).alias("p_retailprice"),
                       F.when(F.col("p_size") > 30, F.col("p_brand")).alias("p_brand"))
    base = p.orderBy("p_partkey").limit(1)
    return payload, base


@register("jo4_with_defaults", _PAYLOAD_SQL + """
SELECT payload.p_partkey, coalesce(payload.p_retailprice, base.p_retailprice) AS p_retailprice,
       coalesce(payload.p_brand, base.p_brand) AS p_brand, base.p_size AS p_size, base.p_type AS p_type
FROM payload, base""")
def q_with_defaults(spark, d):
    payload, base = _payload(spark, d)
    return R.with_defaults(payload, base, ["p_retailprice", "p_brand", "p_size", "p_type"])


@register("jo5_select_keys", """
SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_select_keys(spark, d):
    keys = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("o_custkey"))
    return R.select_keys(table(spark, d, "orders"), keys, "o_custkey")


@register("jo6_orphans", "SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def q_orphans(spark, d):
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.orphans(o, li, "o_orderkey")


@register("jo7_enrich_stream", """
SELECT e.event_id, e.user_id, c.c_name, c.c_acctbal, e.event_type, e.value
FROM events e JOIN customer c ON e.user_id = c.c_custkey""")
def q_enrich_stream_batch(spark, d):
    """Batch twin of the stream-static enrichment (the stream form is st1)."""
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_acctbal")
    return ev.join(c, "user_id", "inner")


@register("jo8_reject_unknown", """
SELECT * FROM events e WHERE NOT EXISTS (
  SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_mktsegment <> 'MACHINERY')""")
def q_reject_unknown_batch(spark, d):
    """Batch twin of the dead-letter split (the stream form is st5)."""
    known = table(spark, d, "customer").where(F.col("c_mktsegment") != "MACHINERY") \
        .select(F.col("c_custkey").alias("user_id"))
    return R.orphans(table(spark, d, "events"), known, "user_id")
