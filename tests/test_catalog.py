"""Registered queries against their SQL at the smallest sample. All of them with TIDEMARK_ALL=1."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = [
    "daily_bars", "weekly_bars", "ind_sma", "ema30", "market_state", "signals_union", "confirmed_by", "first_touch", "barrier_exit",
    "hold_outcomes", "completed_bars", "group_cells", "ranked_universe", "stream_closed_weeks", "stream_slots_once", "new_members", "partial_runs", "payload_cells", "breakouts_view", "sector_momentum", "equity_curve", "landed_hits", "alert_ledger",
    "score_verdict", "screen_ten", "overlay", "page_fields", "auc", "upsert_latest", "stream_new_members",
]


def names():
    checks = entry.oracle_sql()
    return [n for n in checks if os.environ.get("TIDEMARK_ALL") or n in SOME]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="sample tables absent")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    res = check.connect(SF).execute(entry.oracle_sql()[name])
    want = ([d[0] for d in res.description], res.fetchall())
    verdict = check.compare(check.ordered(df.columns, [tuple(r) for r in df.collect()]), check.ordered(*want))
    assert verdict.startswith("ok"), verdict
