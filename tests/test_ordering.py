"""Ranks, quantiles and rank statistics against NumPy and pandas, with heavy ties."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import ordering


def data(spark, n=999):
    rng = np.random.default_rng(1)
    # A third of all rows share one value.
    v = np.where(rng.random(n) < 0.34, 0.5, rng.random(n).round(3))
    y = rng.random(n) < 0.4
    rows = [(i, float(a), bool(b), "ab"[i % 2]) for i, (a, b) in enumerate(zip(v, y))]
    return spark.createDataFrame(rows, "k int, v double, y boolean, g string"), pd.DataFrame(rows, columns=["k", "v", "y", "g"])


def test_global_row_number(spark):
    df, pdf = data(spark)
    got = {r.k: r.rank for r in ordering.global_row_number(df, [F.desc("v"), F.col("k")]).collect()}
    want = pdf.sort_values(["v", "k"], ascending=[False, True]).reset_index(drop=True)
    assert got == {int(k): i + 1 for i, k in enumerate(want.k)}


def test_quantiles(spark):
    df, pdf = data(spark)
    points = [0, 0.013, 0.25, 0.5, 0.9, 1]
    got = {(r.g, r.q): r.q_value for r in ordering.quantiles(df, ["g"], "v", points).collect()}
    for g, x in pdf.groupby("g"):
        assert np.allclose([got[(g, float(q))] for q in points], np.quantile(x.v, points), atol=1e-12)


def test_auc_and_fifths(spark):
    df, pdf = data(spark)
    r = pdf.v.rank()
    n1, n0 = pdf.y.sum(), (~pdf.y).sum()
    want = (r[pdf.y].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert abs(ordering.auc(df, "v", F.col("y")).first().auc - want) < 1e-12
    bins = {row.k: row.bin for row in ordering.fifths(df, "v", ["k"]).collect()}
    cut = pd.qcut(pdf.sort_values(["v", "k"]).v.rank(method="first"), 5, labels=False)
    assert bins == {int(pdf.k[i]): int(b) for i, b in cut.items()}
