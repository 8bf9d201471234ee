"""First session from a start whose value is at or under a level, by doubled minima over a symbol's sessions.

Searches and sessions of a symbol meet in one group, bounded by the calendar on both sides; where bars are bucketed by
symbol, only searches are shuffled. Level k holds the minima of 2**k sessions in a row. A search leaps over the longest
stretch that stays above its level, from the widest level down, so it takes log2(n) steps however long its path is, and
all searches of a symbol take a step at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType


def first_at_or_under(values: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Per search the first place from `start` on whose value is at or under `level`; the number of values without one."""
    n = len(values)
    minima = [values]
    while 2 ** len(minima) <= n:
        half = 2 ** (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    at = start.copy()
    for k in range(len(minima) - 1, -1, -1):
        whole = at + 2**k <= n
        at += np.where(whole & (minima[k][np.where(whole, at, 0)] > level), 2**k, 0)
    return at


def _grouped(value: str, kept: list[str], start: str, until: str, level: str, longest: int, shape: StructType) -> Callable:
    schema = to_arrow_schema(shape)
    found = schema.field(len(schema) - 1)

    def run(searches: pa.Table, bars: pa.Table) -> pa.Table:
        n = bars.num_rows
        hit = np.zeros(searches.num_rows, bool)
        at = np.zeros(searches.num_rows, np.int64)
        if n and searches.num_rows and searches["symbol"][0].is_valid:
            bars = bars.sort_by("pos")
            # An unknown value is never at or under a level, and an unknown level finds nothing.
            values = bars[value].to_numpy()
            values = np.where(np.isnan(values), np.inf, values)
            known = searches[level].is_valid().to_numpy() & searches[start].is_valid().to_numpy() & searches[until].is_valid().to_numpy()
            begin = searches[start].fill_null(-1).to_numpy().astype(np.int64)
            known &= (begin >= 0) & (begin < n)
            places = first_at_or_under(values, np.where(known, begin, 0), searches[level].fill_null(0.0).to_numpy())
            hit = known & (places < n) & (places <= searches[until].fill_null(-1).to_numpy())
            at = np.where(hit, places, 0)
        rows = bars.select(["pos", value, *kept]).take(pa.array(at)) if hit.any() else None
        if rows is None:
            column = pa.nulls(searches.num_rows, found.type)
        else:
            parts = [c.combine_chunks().cast(f.type) for c, f in zip(rows.columns, found.type)]
            column = pa.StructArray.from_arrays(parts, fields=list(found.type), mask=pa.array(~hit))
        return searches.append_column(found.name, column)

    return run


def first_under(searches: DataFrame, bars: DataFrame, value: str, kept: list[str], start: str, until: str, level: str, longest: int, out: str) -> DataFrame:
    """Add `out`: (pos, low, *kept) of the first session in `start`..`until` with `value` at or under `level`, else NULL.

    `pos` counts 0, 1, 2, ... in each symbol; no symbol has more than `longest` sessions. NULL bounds or levels find nothing.
    """
    session = [StructField("pos", IntegerType()), StructField("low", bars.schema[value].dataType), *[bars.schema[c] for c in kept]]
    shape = StructType([*searches.schema.fields, StructField(out, StructType(session))])
    sessions = bars.select("symbol", "pos", value, *kept)
    run = _grouped(value, kept, start, until, level, longest, shape)
    return searches.groupBy("symbol").cogroup(sessions.groupBy("symbol")).applyInArrow(run, shape)
