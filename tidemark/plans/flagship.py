"""From raw orders to an accounted decision log, in one plan."""

from __future__ import annotations

from tidemark.operators.accounting import equity
from tidemark.operators.decisions import decide
from tidemark.panel import DAILY
from tidemark.plans import tables as t
from tidemark.plans.catalog import query

SQL_EQUITY = t.SQL_DECISIONS + """, eq AS (
  SELECT *, product(1 + strat_ret) OVER w AS equity FROM decisions
  WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
eqd AS (
  SELECT *, equity / greatest(max(equity) OVER (PARTITION BY series_id ORDER BY ts), 1.0) - 1 AS drawdown FROM eq)"""


@query(
    "decision_log",
    "series_id ts regime k:2 pred:10 p_up:8 conf:8 alloc:7 is_large_move is_off_calendar next_ts asset_ret:8 cash_ret:8 strat_ret:8 equity:6 drawdown:7",
    f"WITH {SQL_EQUITY} SELECT * FROM eqd",
)
def decision_log(spark, sf_dir):
    return equity(t.decisions(spark, sf_dir), DAILY, "strat_ret")


# decisions on large moves alone: the next one may be months ahead, and nothing is left out at the start
_MOVES_ONLY = t.SQL_DECISIONS.replace("isodow(ts) <> 5 AS is_off_calendar", "true AS is_off_calendar").replace(f"WHERE ts >= DATE '{t.START}'", "")


@query(
    "decisions_off_calendar",
    "series_id ts regime pred:10 alloc:7 is_large_move is_off_calendar next_ts asset_ret:8 cash_ret:8 strat_ret:8",
    f"WITH {_MOVES_ONLY} SELECT * FROM decisions",
)
def decisions_off_calendar(spark, sf_dir):
    return decide(t.signals(spark, sf_dir), DAILY, weekdays=(), carry=["vol30"])
