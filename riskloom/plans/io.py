"""Sources and sinks over the fixture (IO-*): each writes into the shared
scratch area and reads the result back, so the oracle compares what a later
reader sees."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.plans.fixture import admissions, table, with_admissions
from riskloom.sources import curve as Z
from riskloom.sources import tables as T

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")
NATION_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"


@register("io1_read_table", "SELECT * FROM orders")
def q_read_table(spark, d):
    return T.read_table(spark, f"{d}/orders.parquet", ORDERS_SCHEMA)


@register("io2_write_table", "SELECT * FROM orders")
def q_write_table(spark, d):
    path = T.roundtrip_path(spark, "orders")
    T.write_table(table(spark, d, "orders"), path)
    return T.read_table(spark, path, ORDERS_SCHEMA)


@register("io3_csv", "SELECT * FROM nation")
def q_csv(spark, d):
    path = T.roundtrip_path(spark, "nation-csv")
    T.write_csv(table(spark, d, "nation"), path)
    return T.read_csv(spark, path, NATION_SCHEMA)


@register("io3_csv_fields", "SELECT doc_id, text, CASE WHEN doc_id % 3 > 0 THEN source END AS source FROM documents")
def q_csv_fields(spark, d):
    """Texts with line breaks, quotes and commas, and missing values."""
    path = T.roundtrip_path(spark, "documents-csv")
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"))
    T.write_csv(docs, path)
    return T.read_csv(spark, path, docs.schema)


@register("io4_json", "SELECT * FROM nation")
def q_json(spark, d):
    path = T.roundtrip_path(spark, "nation-json")
    T.write_json(table(spark, d, "nation"), path)
    return T.read_json(spark, path, NATION_SCHEMA)


@register("io5_predictions_sink", with_admissions("""
SELECT admission_id AS patient_id, score AS risk_score, risk_tier, 'v1.0' AS model_version,
       CAST(NULL AS VARCHAR) AS shap_top10 FROM admissions"""))
def q_predictions_sink(spark, d):
    path = T.roundtrip_path(spark, "predictions")
    T.predictions_sink(admissions(spark, d), path, key="admission_id", probs={"risk_score": "score"}, tier="risk_tier")
    return spark.read.parquet(path).drop("predicted_at")


@register("io10_layout", with_admissions("""
SELECT admission_id, score, risk_tier FROM admissions WHERE risk_tier = 'Critical' AND score >= 0.9"""))
def q_layout(spark, d):
    path = T.roundtrip_path(spark, "scored")
    scored = admissions(spark, d).select("admission_id", "score", "risk_tier")
    T.write_table(scored, path, partition_by=["risk_tier"], sort_by=["score"])
    back = spark.read.parquet(path)
    # Partition pruning on risk_tier, row-group skipping on score (min/max).
    return back.where((F.col("risk_tier") == "Critical") & (F.col("score") >= 0.9)) \
        .select("admission_id", "score", "risk_tier")


_LOOKUPS = {"hospital": "hospital_id = 7", "tier": "risk_tier = 'Critical'", "score": "score >= 0.95",
            "patient": "patient_id IN (100, 101)"}


@register("io10_curve_layout", with_admissions(" UNION ALL ".join(
    f"SELECT '{name}' AS lookup, admission_id, patient_id, hospital_id, risk_tier, score FROM admissions WHERE {cond}"
    for name, cond in _LOOKUPS.items())))
def q_curve_layout(spark, d):
    """The four lookups of the scored table from one layout."""
    path = T.roundtrip_path(spark, "scored-curve")
    scored = admissions(spark, d).select("admission_id", "patient_id", "hospital_id", "risk_tier", "score")
    Z.write_curve(scored, path, ["hospital_id", "risk_tier", "score"], keys=["patient_id"])
    out = None
    for name, cond in _LOOKUPS.items():
        found = T.read_table(spark, path, scored.schema).where(cond).select(F.lit(name).alias("lookup"), *scored.columns)
        out = found if out is None else out.unionByName(found)
    return out
