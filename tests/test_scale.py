"""Steps that grow with the input no faster than the input: their plans, and their results against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.catalog.books import curve
from tidemark.catalog.outcomes import RULES, closed
from tidemark.catalog.ranker import features
from tidemark.catalog.views import states_of
from tidemark.operators import ordering, outcomes, rangemin, signals
from tidemark.plans import ranker
from tidemark.session import SETTINGS
from tidemark.sources import standin

SF = "/root/testdata/sf0.001"


def test_leaps_over_doubled_minima():
    rng = random.Random(3)
    for n in (1, 2, 15, 64, 100):
        values = [rng.random() for _ in range(n)]
        starts = [rng.randrange(n) for _ in range(200)]
        levels = [rng.choice([-1.0, 0.05, 0.5, 2.0]) for _ in starts]
        want = [next((i for i in range(a, n) if values[i] <= x), n) for a, x in zip(starts, levels)]
        assert rangemin.first_at_or_under(np.array(values), np.array(starts), np.array(levels)).tolist() == want


def test_closed_trades_gather_no_bars(spark):
    plan = closed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "CoGroup" in plan
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") + plan.count("ShuffledHashJoin") <= 6
    assert standin.bar_table(spark, SF).count() > 0 and RULES.holds()


def test_no_method_stays_interpreted():
    assert int(SETTINGS["spark.sql.codegen.hugeMethodLimit"]) <= 8000


def test_imputation_unrolls_no_values(spark):
    rng = random.Random(5)
    rows = [(k % 2, rng.choice([None, 1.5, rng.gauss(0, 1)]), rng.gauss(5, 1) if k % 2 else None, float(k)) for k in range(5001)]
    frame = spark.createDataFrame(rows, "fold int, a double, `b c` double, d double").repartition(5)
    got = {(r.fold, r.feature): r.median for r in ranker.imputation(frame, ["a", "b c", "d"], "fold").collect()}
    for fold in (0, 1):
        for i, name in enumerate(["a", "b c", "d"], 1):
            known = [r[i] for r in rows if r[0] == fold and r[i] is not None]
            assert got[fold, name] == (np.median(known) if known else 0.0)
    # What is ranked is the part between the edges, not a row per value.
    ranked = []
    real = ordering.cumulative
    ordering.cumulative = lambda counted, *args: ranked.append(counted.count()) or real(counted, *args)
    try:
        assert ordering.medians(frame, "fold", {"d": F.col("d")}).count() == 2
    finally:
        ordering.cumulative = real
    assert ranked[0] < 300


def test_bars_with_coming_sessions_are_not_sorted_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        at = signals.locate(standin.signals(spark, SF), standin.bar_table(spark, SF), RULES)
        plan = at._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    # Only the signals are sorted for the join by day.
    assert "SortMergeJoin" in plan and sum("Sort [" in line and "__date#" in line for line in plan.splitlines()) == 1


def unbroadcast_plan(spark, frame):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        return frame()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")


def test_paths_are_sorted_once_and_narrow(spark):
    plan = unbroadcast_plan(spark, lambda: closed(spark, SF))
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    # Bars before the windows, and the signals; the join takes the windows' rows as they lie.
    assert sum("__back#" in line for line in sorts) == 2 and not any("entry_pos#" in line for line in sorts)


def test_states_work_out_the_touch_once(spark):
    plan = unbroadcast_plan(spark, lambda: states_of(spark, SF))
    # Week, day, path and tier; the results of the search are not joined with the signals again.
    assert plan.count("SortMergeJoin") == 4 and plan.count("CoGroup") == 1


def test_curves_work_out_the_trades_once(spark):
    ran = []
    real = rangemin.first_under
    rangemin.first_under = lambda searches, *args: ran.append(searches.columns) or real(searches, *args)
    try:
        made = curve(spark, SF)
    finally:
        rangemin.first_under = real
    # The search ran before the days' sums were cut, so nothing of it is left to run for the span and again for the values.
    assert made._jdf.queryExecution().executedPlan().toString().count("CoGroup") == 0
    assert len(ran) == 1 and "sector" not in ran[0]


def test_features_read_bars_as_they_lie(spark):
    plan = unbroadcast_plan(spark, lambda: features(spark, SF))
    # Only signals are shuffled by symbol, and indicators that are not asked for are not worked out.
    assert plan.count("Exchange hashpartitioning(symbol#") == 1
    assert "Window [" in plan and "__gain" not in plan and "__up#" not in plan


def test_signals_without_an_entry_pass_the_search_as_they_are(spark):
    bars = standin.bar_table(spark, SF)
    touched = outcomes.first_touch(signals.locate(standin.signals(spark, SF), bars, RULES), RULES)
    every = {tuple(r[c] for c in signals.KEY): r.asDict() for r in outcomes.barrier_exit(touched, bars, RULES, every=True).collect()}
    only = [r.asDict() for r in outcomes.barrier_exit(touched, bars, RULES).collect()]
    rest = [r.asDict() for r in touched.where("entry_pos IS NULL").collect()]
    assert only and rest and len(every) == len(only) + len(rest)
    assert all(every[tuple(r[c] for c in signals.KEY)] == r for r in only)
    for r in rest:
        got = every[tuple(r[c] for c in signals.KEY)]
        assert {c: got[c] for c in r} == r and all(got[c] is None for c in ("stop", "exit", "exit_date", "now", "ret", "last_date"))
