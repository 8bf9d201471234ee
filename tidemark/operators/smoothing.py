"""Exponential smoothing y[t] = (1-a)*y[t-1] + a*x[t] without a recursive loop.

The recursion is a weighted sum with weights (1-a)**(t-i). Rows are cut into
blocks short enough for those powers to stay in range. Inside a block the sum is a
running window; earlier blocks enter through their end values, of which the last
three carry all weight above 1e-45. Values are taken relative to the series' first
value, so a constant series stays exactly constant.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exp_smooth(
    df: DataFrame,
    columns: dict[str, str],
    alpha: float,
    part: list[str],
    pos: str = "pos",
    first: int = 0,
) -> DataFrame:
    """Add smoothed columns `{source: out}`; the series starts at position `first`.

    `pos` must count 0, 1, 2, ... within each series and sources must not be NULL from `first` on.
    """
    keep = 1.0 - alpha
    block = max(8, math.ceil(35.0 / -math.log(keep)))
    fade = keep**block
    i = F.col(pos) - F.lit(first)
    whole = W.partitionBy(*part)
    steps = df.withColumns({"__b": F.floor(i / block), "__j": F.pmod(i, F.lit(block))})
    steps = steps.withColumns({f"__seed_{s}": F.max(F.when(i == 0, F.col(s))).over(whole) for s in columns})
    steps = steps.withColumns(
        {f"__dev_{s}": F.when(i >= 0, F.lit(alpha) * (F.col(s) - F.col(f"__seed_{s}"))) for s in columns}
    )
    running = W.partitionBy(*part, "__b").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    by_block = W.partitionBy(*part).orderBy("__b")
    grow = F.pow(F.lit(keep), -F.col("__j").cast("double"))
    to_end = F.pow(F.lit(keep), (F.lit(block - 1) - F.col("__j")).cast("double"))
    steps = steps.withColumns(
        {f"__in_{s}": F.sum(F.col(f"__dev_{s}") * grow).over(running) for s in columns}
        | {
            f"__e{n}_{s}": F.coalesce(F.sum(F.col(f"__dev_{s}") * to_end).over(by_block.rangeBetween(-n, -n)), F.lit(0.0))
            for s in columns
            for n in (1, 2, 3)
        }
    )
    j = F.col("__j").cast("double")
    out = {}
    for source, name in columns.items():
        carried = F.col(f"__e1_{source}") + fade * (F.col(f"__e2_{source}") + fade * F.col(f"__e3_{source}"))
        inner = F.col(f"__in_{source}") * F.pow(F.lit(keep), j)
        out[name] = F.when(i >= 0, F.col(f"__seed_{source}") + inner + carried * F.pow(F.lit(keep), j + 1))
    scratch = ["__b", "__j"]
    scratch += [f"__{k}_{s}" for s in columns for k in ("seed", "dev", "in", "e1", "e2", "e3")]
    return steps.withColumns(out).drop(*scratch)
