"""Bindings of the operator library onto the driver's test tables.

The operators take column names; this module says which test-table columns
play which role (FIXTURES.md section C) and gives the DuckDB text of the same
binding for the oracle.

Roles: admission = order, patient = customer, hospital = nation (via the
customer), score = o_totalprice / 500000, label = next order of the same
customer within 30 days, length of stay = largest line quantity of the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import spec
from riskloom.functions import scalar as S
from riskloom.operators.windows import return_within
from riskloom.sources.tables import fixture_table

SCORE_DIVISOR = 500000.0
# Hospitals 20..24 are left out of the dimension to exercise the fallback.
HOSPITAL_DIM_MAX_KEY = 20

# Fixture normal ranges per event type (fixed test parameters).
EVENT_RANGES = {
    "view": (1.0, 100.0),
    "click": (1.0, 150.0),
    "purchase": (5.0, 200.0),
    "signup": (1.0, 50.0),
    "error": (0.0, 20.0),
}
# Fixture clip bounds per event type (fixed test parameters).
EVENT_CLIP = {
    "view": (0.5, 150.0),
    "click": (0.5, 200.0),
    "purchase": (1.0, 250.0),
    "signup": (0.5, 100.0),
    "error": (0.0, 40.0),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture_table(spark, sf_dir, name)


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, with the clinical roles as columns.

    Plan shape at scale: lineitem is pre-aggregated per order (partial
    aggregation, shuffle on l_orderkey); orders join it on the same key, then
    join customer on o_custkey; the label's window partitions by
    (o_custkey, time bucket).  Unused parts are pruned by Catalyst: a query
    that never reads ``los`` drops the lineitem branch (the right side is
    unique per key), one that never reads ``label`` drops the window.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    lq = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.max("l_quantity").alias("los")))
    base = (o.join(lq, o.o_orderkey == lq.l_orderkey, "left")
            .join(c, o.o_custkey == c.c_custkey, "left"))
    base = return_within(base, "o_custkey", "o_orderdate", "o_orderkey", days=30, out="label")
    score_raw = F.col("o_totalprice") / F.lit(SCORE_DIVISOR)
    return base.select(
        F.col("o_orderkey").alias("admission_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("c_nationkey").alias("hospital_id"),
        score_raw.alias("score_raw"),
        # 4-dp score by truncation: bit-identical in every engine.
        (F.floor(F.col("o_totalprice") / F.lit(50.0)) / F.lit(10000.0)).alias("score"),
        S.tier(score_raw, closed="right").alias("risk_tier"),
        F.col("label"),
        F.col("los"),
        F.col("o_orderdate").alias("admit_ts"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
    )


def hospital_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hospital dimension from nation (keys < 20 only): name, city, lat, lon."""
    n = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < HOSPITAL_DIM_MAX_KEY)
    i = F.col("n_nationkey") + F.lit(1)
    lat, lon = S.grid_point(i)
    cities = F.array(*[F.lit(c) for c in spec.HOSPITAL_CITIES])
    return n.select(F.col("n_nationkey").alias("hospital_id"), F.col("n_name").alias("name"),
                    F.element_at(cities, i).alias("city"),
                    F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


HOSPITAL_DEFAULTS = {"city": spec.HOSPITAL_FALLBACK["city"], "lat": spec.HOSPITAL_FALLBACK["lat"],
                     "lon": spec.HOSPITAL_FALLBACK["lon"]}


# --------------------------------------------------------------------------
# DuckDB text of the same bindings (oracle side)
# --------------------------------------------------------------------------
def _sql_tier(x: str) -> str:
    parts = []
    for lo, hi, lab in zip(spec.TIER_EDGES[:-1], spec.TIER_EDGES[1:], spec.TIER_LABELS):
        parts.append(f"WHEN {x} > {lo!r} AND {x} <= {hi!r} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


ADMISSIONS_SQL = f"""
_lq AS (SELECT l_orderkey, max(l_quantity) AS los FROM lineitem GROUP BY l_orderkey),
_adm AS (
  SELECT o.*, _lq.los, c.c_nationkey, c.c_mktsegment,
         lead(o.o_orderdate) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS _next
  FROM orders o LEFT JOIN _lq ON o.o_orderkey = _lq.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
admissions AS (
  SELECT o_orderkey AS admission_id, o_custkey AS patient_id, c_nationkey AS hospital_id,
         o_totalprice / 500000.0 AS score_raw,
         floor(o_totalprice / 50.0) / 10000.0 AS score,
         {_sql_tier('(o_totalprice / 500000.0)')} AS risk_tier,
         CAST(coalesce(date_diff('day', CAST(o_orderdate AS DATE), CAST(_next AS DATE)) <= 30, false) AS INTEGER) AS label,
         los, o_orderdate AS admit_ts, o_orderpriority AS priority, o_orderstatus AS status,
         c_mktsegment AS segment
  FROM _adm)
"""

_CITY_LIST = ", ".join("'" + c + "'" for c in spec.HOSPITAL_CITIES)
HOSPITAL_DIM_SQL = f"""
hospital_dim AS (
  SELECT n_nationkey AS hospital_id, n_name AS name,
         [{_CITY_LIST}][n_nationkey + 1] AS city,
         round(25.0 + ((CAST(n_nationkey + 1 AS DOUBLE) * 3.1) % 25.0), 6) AS lat,
         round(-125.0 + ((CAST(n_nationkey + 1 AS DOUBLE) * 4.7) % 55.0), 6) AS lon
  FROM nation WHERE n_nationkey < {HOSPITAL_DIM_MAX_KEY})
"""


def with_admissions(body: str, dims: bool = False) -> str:
    """Prefix an oracle query with the admissions (and hospital) CTEs."""
    ctes = ADMISSIONS_SQL + ("," + HOSPITAL_DIM_SQL if dims else "")
    return f"WITH {ctes} {body}"
