"""Scalar and feature functions over the fixture (SC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import spec
from riskloom.functions import features as FE
from riskloom.functions import scalar as S
from riskloom.operators import aggregates as AG
from riskloom.operators import relational as R
from riskloom.operators import windows as WI
from riskloom.plans.fixture import EVENT_CLIP, EVENT_RANGES, admissions, table, with_admissions
from riskloom.plans.surface import _ranges_sql, _payload, _PAYLOAD_SQL, _part_attrs
from riskloom.spec import Derived, FeatureSpec

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


EPS = spec.DERIVE_EPS
EPS_SQL = "CAST(1e-6 AS DOUBLE)"


# SC-1 / SC-2 ------------------------------------------------------------------
@register("sc1_one_hot", """
SELECT l_orderkey, l_linenumber,
       CAST(coalesce(l_returnflag = 'A', false) AS INTEGER) AS l_returnflag_A,
       CAST(coalesce(l_returnflag = 'N', false) AS INTEGER) AS l_returnflag_N,
       CAST(coalesce(l_returnflag = 'R', false) AS INTEGER) AS l_returnflag_R,
       CAST(coalesce(l_linestatus = 'F', false) AS INTEGER) AS l_linestatus_F,
       CAST(coalesce(l_linestatus = 'O', false) AS INTEGER) AS l_linestatus_O
FROM lineitem""")
def q_one_hot(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return FE.one_hot(li, ["l_returnflag", "l_linestatus"], keep=["l_orderkey", "l_linenumber"])


_WIDE_SQL = """
WITH v AS (SELECT DISTINCT 0 AS c, 'o_custkey' AS "column", CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey IS NOT NULL
           UNION SELECT DISTINCT 1, 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL),
w AS (SELECT "column", value, CAST(row_number() OVER (ORDER BY c, value) - 1 AS INTEGER) AS index FROM v)
"""


@register("sc1_dictionary", _WIDE_SQL + 'SELECT "column", value, index FROM w')
def q_dictionary(spark, d):
    """A vocabulary of as many values as customers, numbered and never collected."""
    return FE.dictionary(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"])


@register("sc2_encode_wide", _WIDE_SQL + """
SELECT o_orderkey, coalesce(a.index, -1) AS first, coalesce(b.index, -1) AS second FROM orders
LEFT JOIN w a ON a."column" = 'o_custkey' AND a.value = CAST(o_custkey AS VARCHAR)
LEFT JOIN w b ON b."column" = 'o_orderpriority' AND b.value = o_orderpriority""")
def q_encode_wide(spark, d):
    """Every order's positions in that vocabulary."""
    cols, o = ["o_custkey", "o_orderpriority"], table(spark, d, "orders")
    rows = FE.encode(o, cols, "o_orderkey", FE.dictionary(o, cols))
    at = [F.coalesce(F.get("indices", F.lit(i)), F.lit(-1)) for i in range(2)]
    return rows.select("o_orderkey", at[0].alias("first"), at[1].alias("second"))


_PRIORITY_VOCAB = {"o_orderpriority": ["1-URGENT", "2-HIGH", "9-UNSEEN"]}


@register("sc2_one_hot_apply", "SELECT o_orderkey, " + ", ".join(
    f"CAST(coalesce(o_orderpriority = '{v}', false) AS INTEGER) AS \"o_orderpriority_{v}\""
    for v in _PRIORITY_VOCAB["o_orderpriority"]) + " FROM orders")
def q_one_hot_apply(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *FE.one_hot_columns(_PRIORITY_VOCAB))


# SC-3 / SC-4 ------------------------------------------------------------------
@register("sc3_safe_ratio", f"""
SELECT l_orderkey, l_linenumber, l_extendedprice / (l_quantity + {EPS_SQL}) AS unit_price,
       l_discount / (l_tax + {EPS_SQL}) AS discount_tax_ratio FROM lineitem""")
def q_safe_ratio(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     S.safe_ratio("l_extendedprice", "l_quantity", EPS).alias("unit_price"),
                     S.safe_ratio("l_discount", "l_tax", EPS).alias("discount_tax_ratio"))


@register("sc4_arithmetic", """
SELECT l_orderkey, l_linenumber, l_extendedprice - l_tax AS price_minus_tax,
       l_quantity * l_discount AS qty_x_discount, l_discount + l_tax AS discount_plus_tax FROM lineitem""")
def q_arithmetic(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     S.difference("l_extendedprice", "l_tax").alias("price_minus_tax"),
                     S.product("l_quantity", "l_discount").alias("qty_x_discount"),
                     S.total("l_discount", "l_tax").alias("discount_plus_tax"))


# SC-5 ---------------------------------------------------------------------------
_FLAGS = [("high_quality", "quality", "gt", 0.0), ("not_toxic", "toxic", "lt", 1.0),
          ("long_text", "n_chars", "gt", 5000.0), ("short_text", "n_chars", "lt", 200.0)]


@register("sc5_threshold_flags", "SELECT d.doc_id, " + ", ".join(
    f"CAST(coalesce({c} {'>' if op == 'gt' else '<'} {t!r}, false) AS INTEGER) AS {n}" for n, c, op, t in _FLAGS)
    + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_threshold_flags(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels")
    j = docs.join(lab, "doc_id", "left")
    return j.select("doc_id", *S.threshold_flags(_FLAGS))


# SC-6 ---------------------------------------------------------------------------
@register("sc6_clip", """
SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal) THEN c_acctbal
       ELSE greatest(least(c_acctbal, 5000.0), 0.0) END AS acctbal_clipped FROM customer""")
def q_clip(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", "c_acctbal", S.clip("c_acctbal", 0.0, 5000.0).alias("acctbal_clipped"))


# SC-7 ---------------------------------------------------------------------------
def _tier_left_sql(x: str) -> str:
    parts = [f"WHEN {x} >= {lo!r} THEN '{lab}'" for lo, lab in reversed(list(zip(spec.TIER_EDGES[:-1], spec.TIER_LABELS)))]
    return f"CASE {' '.join(parts)} WHEN {x} IS NOT NULL THEN '{spec.TIER_LABELS[0]}' END"


@register("sc7_tier", with_admissions(f"""
SELECT admission_id, risk_tier AS tier_right, {_tier_left_sql('score_raw')} AS tier_left FROM admissions"""))
def q_tier(spark, d):
    adm = admissions(spark, d)
    return adm.select("admission_id", F.col("risk_tier").alias("tier_right"),
                      S.tier("score_raw", closed="left").alias("tier_left"))


# SC-8 / SC-9 --------------------------------------------------------------------
@register("sc8_blend", """
SELECT l_orderkey, l_linenumber, round(0.5 * (l_discount * 10) + 0.5 * (l_tax * 10), 6) AS blended FROM lineitem""")
def q_blend(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.round(S.blend([F.col("l_discount") * 10, F.col("l_tax") * 10]), 6).alias("blended"))


_SCORECARD = [("linear", "l_quantity", 0.03, 25.0), ("log1p", "l_extendedprice", 0.1),
              ("hinge_up", "l_discount", 5.0, 0.05), ("hinge_down", "l_tax", -3.0, 0.04),
              ("is", "l_returnflag", 0.4, "R")]


@register("sc9_scorecard", """
SELECT l_orderkey, l_linenumber, round(1.0 / (1.0 + exp(-(-2.5 + 0.03 * (l_quantity - 25.0) + 0.1 * ln(1 + l_extendedprice)
       + 5.0 * greatest(l_discount - 0.05, 0.0) + (-3.0) * least(l_tax - 0.04, 0.0)
       + 0.4 * CAST(coalesce(l_returnflag = 'R', false) AS DOUBLE)))), 6) AS risk FROM lineitem""")
def q_scorecard(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(S.scorecard(_SCORECARD, -2.5), 6).alias("risk"))


# SC-10 --------------------------------------------------------------------------
@register("sc10_impute_median", """
WITH j AS (SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic,
                  CAST(d.n_chars AS DOUBLE) AS n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT median(quality) AS mq, median(toxic) AS mt, median(n_chars) AS mn FROM j)
SELECT doc_id, coalesce(quality, mq) AS quality, coalesce(toxic, mt) AS toxic, coalesce(n_chars, mn) AS n_chars FROM j, m""")
def q_impute_median(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"),
                                          F.col("toxic").cast("double").alias("toxic"))
    j = docs.join(lab, "doc_id", "left")
    return FE.impute_median(j, ["quality", "toxic", "n_chars"]).select("doc_id", "quality", "toxic", "n_chars")


# SC-11 --------------------------------------------------------------------------
_ABSENT = {"p_container_size": 7.0}


@register("sc11_overlay", _PAYLOAD_SQL + """
SELECT payload.p_partkey, coalesce(payload.p_retailprice, base.p_retailprice) AS p_retailprice,
       coalesce(payload.p_brand, base.p_brand) AS p_brand, 7.0 AS p_container_size
FROM payload, base""")
def q_overlay(spark, d):
    payload, base = _payload(spark, d)
    out = R.with_defaults(payload, base, ["p_retailprice", "p_brand"])
    # Columns neither in the payload nor the base row take literal defaults;
    # payload columns unknown to the target are ignored by the final select.
    return out.withColumns({c: F.lit(v) for c, v in _ABSENT.items()}) \
        .select("p_partkey", "p_retailprice", "p_brand", *_ABSENT)


# SC-12 --------------------------------------------------------------------------
@register("sc12_coerce_numeric", r"""
SELECT event_id, regexp_extract(props, ':\s*([^}]*)', 1) AS raw,
       TRY_CAST(NULLIF(trim(regexp_extract(props, ':\s*([^}]*)', 1)), '') AS DOUBLE) AS num,
       TRY_CAST(NULLIF(trim(event_type), '') AS DOUBLE) AS type_num FROM events""")
def q_coerce_numeric(spark, d):
    ev = table(spark, d, "events")
    raw = F.regexp_extract("props", r":\s*([^}]*)", 1)
    return ev.select("event_id", raw.alias("raw"), S.coerce_numeric(raw).alias("num"),
                     S.coerce_numeric("event_type").alias("type_num"))


# SC-13 --------------------------------------------------------------------------
@register("sc13_top_abs", """
WITH attrs AS (SELECT p_partkey, round((p_size - 25) / 25.0, 4) AS size_dev,
                      round((p_retailprice - 1500) / 1000.0, 4) AS price_dev,
                      round((length(p_name) - 20) / 20.0, 4) AS name_dev FROM part),
long AS (SELECT p_partkey, 'size_dev' AS feature, size_dev AS value FROM attrs
         UNION ALL SELECT p_partkey, 'price_dev', price_dev FROM attrs
         UNION ALL SELECT p_partkey, 'name_dev', name_dev FROM attrs),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(value) DESC, feature) AS pos FROM long)
SELECT p_partkey, CAST(pos AS INTEGER) AS pos, feature, round(value, 4) AS shap_value,
       CASE WHEN value > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction
FROM r WHERE pos <= 2""")
def q_top_abs(spark, d):
    a = _part_attrs(spark, d)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
                    for c in ["size_dev", "price_dev", "name_dev"]])
    top = a.select("p_partkey", S.top_abs(arr, 2).alias("top"))
    return top.select("p_partkey", F.posexplode("top").alias("pos", "e")).select(
        "p_partkey", (F.col("pos") + 1).alias("pos"), "e.feature", "e.shap_value", "e.direction")


# SC-14 --------------------------------------------------------------------------
@register("sc14_abnormal", f"SELECT event_id, event_type, value, {_ranges_sql('event_type', 'value')} AS abnormal FROM events")
def q_abnormal(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", "value")
    return WI.abnormal_flags(ev, "value", "event_type", EVENT_RANGES)


# SC-15 --------------------------------------------------------------------------
@register("sc15_round_n", """
SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 1) AS r1, round(sqrt(l_extendedprice), 2) AS r2,
       round(sqrt(l_extendedprice), 3) AS r3, round(sqrt(l_extendedprice), 4) AS r4 FROM lineitem""")
def q_round_n(spark, d):
    li = table(spark, d, "lineitem")
    # sqrt keeps the inputs off exact .5 ties, where HALF_UP on the decimal
    # text (Spark) and on the scaled binary value (DuckDB) may disagree.
    x = F.sqrt("l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", *[S.round_n(x, n).alias(f"r{n}") for n in (1, 2, 3, 4)])


# SC-16 / SC-17 ------------------------------------------------------------------
_CODES_SQL = """
WITH codes AS (SELECT l.l_orderkey, string_agg(DISTINCT p.p_type, ',' ORDER BY p.p_type) AS codes
               FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey)
"""


def _codes(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return (li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey")
            .agg(S.code_list_join(F.array_sort(F.collect_set("p_type"))).alias("codes")))


@register("sc16_code_list", _CODES_SQL + """
SELECT l_orderkey, codes, CAST(len(string_split(codes, ',')) AS INTEGER) AS n_codes FROM codes""")
def q_code_list(spark, d):
    c = _codes(spark, d)
    return c.select("l_orderkey", "codes", S.code_list_size("codes").alias("n_codes"))


@register("sc17_exclude_from_list", _CODES_SQL + """
SELECT l_orderkey, array_to_string(list_filter(string_split(codes, ','), lambda x: x <> 'PROMO'), ',') AS codes_wo_promo FROM codes""")
def q_exclude_from_list(spark, d):
    c = _codes(spark, d)
    return c.select("l_orderkey", S.code_list_join(S.exclude_from_list(S.code_list("codes"), "PROMO")).alias("codes_wo_promo"))


# SC-18 / SC-19 ------------------------------------------------------------------
@register("sc18_format_id", """
SELECT c_custkey, printf('P%06d', c_custkey) AS patient_code, printf('HOSP_%03d', c_nationkey + 1) AS hospital_code,
       printf('Medical Center %03d', c_nationkey + 1) AS hospital_name FROM customer""")
def q_format_id(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.format_id("P", 6, "c_custkey").alias("patient_code"),
                    S.format_id("HOSP_", 3, F.col("c_nationkey") + 1).alias("hospital_code"),
                    S.format_id("Medical Center ", 3, F.col("c_nationkey") + 1).alias("hospital_name"))


@register("sc19_grid_point", """
SELECT n_nationkey, round(25.0 + ((CAST(n_nationkey + 1 AS DOUBLE) * 3.1) % 25.0), 6) AS lat,
       round(-125.0 + ((CAST(n_nationkey + 1 AS DOUBLE) * 4.7) % 55.0), 6) AS lon FROM nation""")
def q_grid_point(spark, d):
    n = table(spark, d, "nation")
    lat, lon = S.grid_point(F.col("n_nationkey") + 1)
    return n.select("n_nationkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


# SC-20 ---------------------------------------------------------------------------
@register("sc20_epoch_to_ts", """
SELECT event_id, epoch_us(ts) / 1000000.0 AS epoch_s, make_timestamp(CAST(round(epoch_us(ts) / 1000000.0 * 1000000) AS BIGINT)) AS ts_back
FROM events""")
def q_epoch_to_ts(spark, d):
    ev = table(spark, d, "events")
    e = S.ts_to_epoch("ts")
    return ev.select("event_id", e.alias("epoch_s"), S.epoch_to_ts(e).cast("timestamp_ntz").alias("ts_back"))


# SC-21 / SC-23 -------------------------------------------------------------------
@register("sc21_pct_of_cap", with_admissions("""
SELECT admission_id, round(least(1.0, abs(score) / 0.5), 6) AS pct_predict, round(least(1.0, abs(score) / 0.45), 6) AS pct_explain,
       round(abs(score), 6) AS pct_uncapped FROM admissions"""))
def q_pct_of_cap(spark, d):
    adm = admissions(spark, d)
    return adm.select("admission_id", F.round(S.pct_of_cap("score", spec.CAP_PREDICT), 6).alias("pct_predict"),
                      F.round(S.pct_of_cap("score", spec.CAP_EXPLAIN), 6).alias("pct_explain"),
                      F.round(S.pct_of_cap("score", None), 6).alias("pct_uncapped"))


@register("sc23_percent_label", with_admissions("""
, g AS (SELECT hospital_id, avg(CASE WHEN risk_tier = 'Critical' THEN 1.0 ELSE 0.0 END) AS share
        FROM admissions WHERE hospital_id IS NOT NULL GROUP BY hospital_id)
SELECT hospital_id, printf('%.1f%%', round(share * 100, 1)) AS pct_label, round(share * 100, 1) AS pct_value FROM g"""))
def q_percent_label(spark, d):
    adm = admissions(spark, d).where(F.col("hospital_id").isNotNull())
    g = adm.groupBy("hospital_id").agg(F.avg(F.coalesce(F.col("risk_tier") == "Critical", F.lit(False)).cast("double")).alias("share"))
    return g.select("hospital_id", S.percent_label("share").alias("pct_label"), S.percent_value("share").alias("pct_value"))


# SC-22 ---------------------------------------------------------------------------
@register("sc22_explanation_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, to_json({'k': CAST(json_extract(props, '$.k') AS INTEGER)}) AS props_json FROM events""")
def q_explanation_json(spark, d):
    ev = table(spark, d, "events")
    parsed = F.from_json("props", "struct<k:int>")
    return ev.select("event_id", parsed["k"].alias("k"), S.to_explanation_json(parsed).alias("props_json"))


# SC-24 ---------------------------------------------------------------------------
LINE_SPEC = FeatureSpec(
    numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    categorical={"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]},
    derived=[Derived("unit_price", "ratio", "l_extendedprice", "l_quantity"),
             Derived("price_minus_tax", "diff", "l_extendedprice", "l_tax"),
             Derived("qty_x_discount", "product", "l_quantity", "l_discount"),
             Derived("discount_plus_tax", "sum", "l_discount", "l_tax"),
             Derived("big_discount", "gt", "l_discount", threshold=0.05),
             Derived("small_order", "lt", "l_quantity", threshold=10.0)])


def _spec_sql(sp: FeatureSpec) -> str:
    cols = [f"CAST({c} AS FLOAT) AS {c}" for c in sp.numeric]
    cols += [f"CAST(CAST(coalesce({c} = '{v}', false) AS DOUBLE) AS FLOAT) AS {c}_{v}"
             for c, vals in sp.categorical.items() for v in vals]
    for dv in sp.derived:
        if dv.kind == "ratio":
            e = f"{dv.a} / ({dv.b} + {EPS_SQL})"
        elif dv.kind == "diff":
            e = f"{dv.a} - {dv.b}"
        elif dv.kind == "product":
            e = f"{dv.a} * {dv.b}"
        elif dv.kind == "sum":
            e = f"{dv.a} + {dv.b}"
        else:
            e = f"CAST(coalesce({dv.a} {'>' if dv.kind == 'gt' else '<'} {dv.threshold!r}, false) AS DOUBLE)"
        cols.append(f"CAST({e} AS FLOAT) AS {dv.name}")
    return ", ".join(cols)


@register("sc24_derive_features", f"SELECT l_orderkey, l_linenumber, {_spec_sql(LINE_SPEC)} FROM lineitem")
def q_derive_features(spark, d):
    li = table(spark, d, "lineitem")
    return FE.derive_features(li, LINE_SPEC, keep=["l_orderkey", "l_linenumber"])


@register("pr5_assemble", f"""
WITH f AS (SELECT l_orderkey, l_linenumber, {_spec_sql(LINE_SPEC)} FROM lineitem)
SELECT l_orderkey, l_linenumber, [{', '.join(LINE_SPEC.names)}] AS features FROM f""")
def q_assemble(spark, d):
    li = table(spark, d, "lineitem")
    f = FE.derive_features(li, LINE_SPEC, keep=["l_orderkey", "l_linenumber"])
    return R.assemble_array(f, LINE_SPEC.names, keep=["l_orderkey", "l_linenumber"])


# SC-25 / SC-26 / SC-27 / SC-28 -----------------------------------------------------
@register("sc25_zip_series", """
WITH h AS (SELECT * FROM (SELECT user_id, ts, event_id, value,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 60)
SELECT user_id, ts, value FROM h""")
def q_zip_series(spark, d):
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    hist = WI.history_arrays(WI.last_n(ev, "user_id", "ts", 60, tiebreak="event_id"), "user_id", "ts", ["value"],
                             tiebreak="event_id")
    pts = hist.select("user_id", F.explode(S.zip_series("ts", "value")).alias("p"))
    return pts.select("user_id", F.col("p.ts").alias("ts"), F.col("p.value").alias("value"))


@register("sc26_counts_as_map", with_admissions("""
SELECT risk_tier AS tier, count(*) AS n FROM admissions WHERE risk_tier IS NOT NULL GROUP BY risk_tier"""))
def q_counts_as_map(spark, d):
    counts = AG.tier_counts(admissions(spark, d), "risk_tier")
    return S.counts_as_map(counts, "risk_tier", "n").select(F.explode("counts").alias("tier", "n"))


@register("sc27_records", """
SELECT n_nationkey, to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS record FROM nation""")
def q_records(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", S.records(n, ["n_nationkey", "n_name", "n_regionkey"]))


@register("sc28_decode", """
SELECT l_orderkey, l_linenumber, coalesce(CASE l_linestatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Open' END, 'Unknown') AS status_label,
       coalesce(CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' END, 'Unknown') AS flag_label FROM lineitem""")
def q_decode(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     S.decode("l_linestatus", {"F": "Final", "O": "Open"}, "Unknown").alias("status_label"),
                     S.decode("l_returnflag", {"R": "Returned", "A": "Accepted"}, "Unknown").alias("flag_label"))


@register("sc6_clip_stream_bounds", f"""
SELECT event_id, event_type, value, CASE WHEN value IS NULL OR isnan(value) THEN value ELSE
  greatest(least(value, CASE {' '.join(f"WHEN event_type = '{k}' THEN {b!r}" for k, (_, b) in EVENT_CLIP.items())} END),
           CASE {' '.join(f"WHEN event_type = '{k}' THEN {a!r}" for k, (a, _) in EVENT_CLIP.items())} END) END AS clipped FROM events""")
def q_clip_stream_bounds(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", "value")
    lo, hi = S.range_lookup("event_type", EVENT_CLIP)
    return ev.withColumn("clipped", S.clip("value", lo, hi))


@register("sc11_overlay_median", """
WITH payload AS (SELECT p_partkey, CASE WHEN p_size < 20 THEN p_retailprice END AS p_retailprice,
                        CASE WHEN p_retailprice > 1500 THEN p_size END AS p_size FROM part)
SELECT p_partkey, coalesce(p_retailprice, (SELECT median(p_retailprice) FROM part)) AS p_retailprice,
       coalesce(CAST(p_size AS DOUBLE), (SELECT median(p_size) FROM part)) AS p_size FROM payload""")
def q_overlay_median(spark, d):
    p = table(spark, d, "part")
    payload = p.select("p_partkey", F.when(F.col("p_size") < 20, F.col("p_retailprice")).alias("p_retailprice"),
                       F.when(F.col("p_retailprice") > 1500, F.col("p_size")).cast("double").alias("p_size"))
    return R.overlay(payload, p, ["p_retailprice", "p_size"], mode="median")
