"""Every registered query runs, and equals its SQL statement in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_sql import TABLES, canonical, plain

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")

# A cross-section; tools/check_sql.py compares all of them.
CHECKED = [
    "peri_event_mean", "peri_event_rate", "ttl_pulses", "bouts", "first_after_reference", "trial_class",
    "heatmap_order_counts", "null_envelope", "holm", "ordinal_match", "lag_features", "auc_ap_logloss",
    "centroid_lifetime", "staleness_case",
]


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["grp", "lag_i", "rel_t", "mean", "sem", "n_mice"] and df.count() == 34


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    df = entry.queries()[name](spark, PATH)
    got = canonical(pd.DataFrame([tuple(plain(v) for v in r) for r in df.collect()], columns=df.columns, dtype=object))
    cur = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == canonical(want)
