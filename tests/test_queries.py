"""A cross-section of registered queries against DuckDB; ``oracle.py`` runs all of them."""

import os

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
PICKED = [
    "features_all", "label_barrier", "walk_forward", "eval_roc_auc", "v_duplicates", "v_chronology",
    "next_open_fill", "liquidity_fold", "risk_screen", "ledger_fees", "snapshot", "perf_metrics",
    "trade_recon", "scan_csv_mapped",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
@pytest.mark.parametrize("name", PICKED)
def test_matches_duckdb(spark, name):
    problem = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not problem, problem


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(PICKED) <= set(entry.oracle_sql())
