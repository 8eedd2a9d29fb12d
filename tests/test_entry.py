import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402

from conftest import SF001  # noqa: E402

FAST = ["ag1_kpis", "ag4_group_summary", "ag7_histogram", "ag8_quantile_buckets", "ag14_auc", "wi6_return_within",
        "wi7_prior_count", "sl6_kfold", "jo6_orphans", "sc24_derive_features", "fi5_abnormal_only", "st3_history"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns[:2] == ["hospital_id", "name"]


def test_registry_shape():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    # Every operator ID of the survey inventory has a registered query.
    ids = {k.split("_")[0] for k in q}
    need = ([f"io{i}" for i in range(1, 11)] + [f"pr{i}" for i in range(1, 7)] + [f"fi{i}" for i in range(1, 6)]
            + [f"jo{i}" for i in range(1, 9)] + [f"ag{i}" for i in range(1, 18)] + [f"wi{i}" for i in range(1, 8)]
            + [f"sl{i}" for i in range(1, 8)] + [f"sc{i}" for i in range(1, 29)] + [f"ml{i}" for i in range(1, 11)]
            + [f"st{i}" for i in range(1, 8)])
    assert sorted(set(need) - ids) == []


def test_fast_oracles_at_smallest_scale(spark):
    con = duck(SF001)
    q, s = E.queries(), E.oracle_sql()
    bad = [n for n in FAST if not compare(spark, con, n, q[n], s[n], SF001)]
    assert not bad
