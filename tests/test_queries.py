"""Registered queries against their SQL on the smallest tables.

All of them with TIDEMARK_ALL=1 (several minutes); by default one or two per family.
"""

import os

import pytest

from oracle import DATA, compare, connect
from tidemark.plans import load_all

QS = load_all()
SF = f"{DATA}/sf0.001"
SAMPLE = [
    "decision_log", "calendar_fill", "log_returns", "macd", "rolling_drawdown", "percent_ranks", "forward_fill", "sigma_winsorise",
    "asof_strictly_before", "rows_inside_periods", "run_spans", "triple_barrier", "path_dependent_controls", "psi_panel", "factsheet",
    "year_month_returns", "permutation_p_values", "backtest_overfitting", "purged_rolling_slices", "streamed_closed_bars", "upsert_new_wins",
]
NAMES = [n for n in QS if QS[n].sql] if os.environ.get("TIDEMARK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = QS[name].run(spark, SF).toPandas()
    assert compare(got, con.sql(QS[name].sql).df()) is None


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["series_id", "ts"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 150
