"""Range-minimum search against loops, layout by symbol without exchanges, stored models, scenarios and newest exports."""

import datetime as dt
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.catalog.outcomes import RULES
from tidemark.operators import books, outcomes, rangemin
from tidemark.plans import ranker
from tidemark.sources import files, standin

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sessions", [1, 15, 16, 17, 300, 4200])
def test_first_session_under_a_level(spark, sessions):
    rng = random.Random(sessions)
    lows = {s: [rng.random() for _ in range(n)] for s, n in ((1, sessions), (2, max(1, sessions // 3)))}
    bars = spark.createDataFrame([(s, i, v, i * 10) for s, row in lows.items() for i, v in enumerate(row)], "symbol long, pos int, low double, tag long")
    asked = [(k, s, a, rng.randrange(a, len(lows[s]) + 3), rng.choice([0.001, 0.01, 0.2, -1.0, None])) for k in range(300) for s in [rng.choice([1, 2])] for a in [rng.randrange(len(lows[s]))]]
    asked += [(300, 3, 0, 5, 1.0), (301, 1, None, 5, 1.0)]
    frame = spark.createDataFrame(asked, "k long, symbol long, a int, z int, level double")
    got = rangemin.first_under(frame, bars, "low", ["tag"], "a", "z", "level", sessions, "hit").collect()
    want = {}
    for k, s, a, z, level in asked:
        path = range(a, min(z + 1, len(lows.get(s, [])))) if a is not None and level is not None else []
        want[k] = next(((i, lows[s][i], i * 10) for i in path if lows[s][i] <= level), None)
    assert {r.k: tuple(r.hit) if r.hit else None for r in got} == want and len(got) == len(asked)
    assert got[0].__fields__ == [*frame.columns, "hit"] or set(got[0].__fields__) == {*frame.columns, "hit"}


def test_paths_need_no_exchange(spark):
    bars = standin.bar_table(spark, SF)
    plan = outcomes.path_bars(bars, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan


def test_stored_models(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, -1.0), (3, None, 4.0)], "k long, x double, ret double")
    assert ranker.newest_model(spark, path).count() == 0
    assert [(r.score, r.ml) for r in ranker.ranked_by_stored(rows, ranker.newest_model(spark, path)).collect()] == [(None, None)] * 3
    for version, on in ((3, False), (10, True)):
        ranker.store_model(ranker.model_row(spark, ranker.Model(["x"], [2.0], [2.0], [1.0], [float(version)], 0.0), on, [0.0, 0.5, float("nan")]), path, version)
    (tmp_path / "m" / "version=11").mkdir()
    stored = ranker.newest_model(spark, path)
    model, marks = ranker.model_of(stored)
    assert model.coef == [10.0] and marks == [0.0, 0.5, None] and stored.first()["on"]
    scored = {r.k: (r.score, r.ml) for r in ranker.ranked_by_stored(rows, stored).collect()}
    assert scored == {1: (pytest.approx(4.54e-05, abs=1e-7), 0), 2: (pytest.approx(0.999954602), 1), 3: (0.5, 1)}
    off = stored.withColumn("on", F.lit(None).cast("boolean"))
    ordered = ranker.ordered_by_gate(rows, ranker.ranked_by_stored(rows, stored), off, ["k"])
    assert ordered.where("score IS NULL").count() == 3


def test_difference_of_means(spark):
    rows = spark.createDataFrame([(1.0, 5.0, 1.0), (3.0, 5.0, -1.0), (None, 5.0, 2.0)], "x double, flat double, ret double")
    model = ranker.mean_difference(rows, ["x", "flat"])
    # The gap is filled by the median 2; winners' mean 1.5, the other's 3, spread sqrt(2/3).
    assert model.median == [2.0, 5.0] and model.coef == [pytest.approx(-1.5 / (2 / 3) ** 0.5, abs=1e-6), 0.0]


def test_scenarios_are_seeded_and_limited(spark):
    day = dt.date(2024, 1, 1)
    trades = spark.createDataFrame([("s", k, day, day, day, "Midcap" if k < 5 else "Smallcap", 0.1 * k if k % 2 else None) for k in range(20)] + [("t", 0, day, day, day, "Midcap", None)],
                                   "scanner string, symbol long, hit_date date, entry_date date, exit_date date, tier string, score double")
    run = lambda: books.scenarios(trades, [2, 6], ["tier", "score", "random"], 5).select("slots", "policy", "seed", "place", "symbol").collect()
    got = run()
    assert sorted(map(tuple, got)) == sorted(map(tuple, run())) and len(got) == (2 + 6) * 3 * 5
    of = lambda p, n: {r.seed: [x.symbol for x in sorted(got, key=lambda x: x.place) if (x.slots, x.policy, x.seed) == (n, p, r.seed)] for r in got}
    assert all(v == [19, 17, 15, 13, 11, 9] for v in of("score", 6).values())
    assert all(set(v[:5]) == set(range(5)) for v in of("tier", 6).values()) and len({tuple(v) for v in of("random", 6).values()}) == 5
    assert all(len(set(v)) == len(v) for v in of("random", 6).values())


def test_scenarios_are_ranked_exactly_after_bounds(spark):
    rng = random.Random(5)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    # The last day has two symbols, fewer than places; others have crowds of equal scores and tiers.
    rows = [(f"s{rng.randrange(3)}", k % 40 if d < 4 else k % 2, day(-k), day(d), rng.choice(["Midcap", "Largecap", None]), rng.choice([0.1, 0.9, None])) for d in range(5) for k in range(150)]
    trades = spark.createDataFrame(rows, "scanner string, symbol long, hit_date date, entry_date date, tier string, score double")
    made = books.scenarios(trades, [1, 3], ["tier", "score", "random"], 4)
    got = {(r.slots, r.policy, r.seed, r.entry_date, r.place): (r.scanner, r.symbol, r.hit_date) for r in made.collect()}
    want = {}
    lead = {"tier": lambda r: {"Midcap": 0, "Largecap": 1}.get(r[4], 3), "score": lambda r: 9 if r[5] is None else -r[5], "random": lambda r: 0}
    for policy, seed, d in itertools.product(lead, range(4), {r[3] for r in rows}):
        order = sorted((r for r in rows if r[3] == d), key=lambda r: (lead[policy](r), hashlib.md5(f"{seed}|{r[0]}|{r[1]}|{r[2]}".encode()).hexdigest(), r[0]))
        first = list({r[1]: r for r in reversed(order)}.values())
        for place, r in enumerate(sorted(first, key=order.index)[:3], 1):
            want |= {(n, policy, seed, d, place): r[:3] for n in (1, 3) if place <= n}
    assert got == want
    # Bounds of leads (twice: for the bounds of hashes, too) and of hashes cut the rows before any of them is sorted or dealt by scenario.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 3


def test_newest_export_opens_one_folder(spark, tmp_path):
    assert files.newest_file_rows(spark, str(tmp_path)) is None
    for name, text in (("2024-01-01.csv", "Code\nold\n"), ("notes.txt", "x")):
        (tmp_path / name).write_text(text)
    spark.createDataFrame([("new",), ("newer",)], "Code string").repartition(2).write.option("header", True).csv(str(tmp_path / "2024-02-01.csv"))
    rows = files.newest_file_rows(spark, str(tmp_path))
    assert sorted((r.Code, str(r["__asof"])) for r in rows.collect()) == [("new", "2024-02-01"), ("newer", "2024-02-01")]
    assert all("2024-02-01.csv" in f for f in rows.inputFiles())
