"""Global ranks, exact quantiles and rank statistics without a single-task window.

Rows are range-partitioned in the wanted order and written once, so that each
partition's number and every row's place in it are fixed. Per-partition totals form a
table bounded by the partition count; their running sum gives each partition's offset.
Values are counted before the sort wherever ties may be heavy, so a value that holds a
third of all rows is one row by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keys import beside
from ..session import scratch_path, stored

_ROW_BITS = 33


def _fixed_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in total order with `__part` and `__i`, stored in the shared folder."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("__id", F.monotonically_increasing_id()).withColumns(
        {
            "__part": F.shiftrightunsigned("__id", _ROW_BITS).cast("int"),
            "__i": F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )
    path = scratch_path(spark, "ordered")
    tagged.drop("__id").write.parquet(path)
    return spark.read.parquet(path)


def global_row_number(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1..n over the whole table. `order` must end in a unique key, so that ties spread over partitions."""
    fixed = _fixed_order(df, order)
    sizes = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    # One row per partition: bounded by the partition count, so the broadcast is too.
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return (
        fixed.join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__before") + F.col("__i") + 1)
        .drop("__part", "__i", "__before")
    )


def cumulative(counted: DataFrame, group: list[str], value: str, sums: list[str]) -> DataFrame:
    """Running totals in value order within each group, as `before_<c>`, plus group totals `all_<c>`.

    `counted` must be unique on (group, value): counts per distinct value, not raw rows.
    """
    order = [F.col(c) for c in [*group, value]]
    fixed = _fixed_order(counted, order)
    parts = fixed.groupBy(*group, "__part").agg(*[F.sum(c).alias(f"__p_{c}") for c in sums])
    over_parts = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *group,
        "__part",
        *[F.coalesce(F.sum(f"__p_{c}").over(over_parts), F.lit(0)).alias(f"__o_{c}") for c in sums],
        *[F.sum(f"__p_{c}").over(W.partitionBy(*group)).alias(f"all_{c}") for c in sums],
    )
    inside = W.partitionBy("__part", *group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    running = fixed.withColumns({f"__r_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    joined = running.join(offsets, [*group, "__part"])
    return joined.withColumns({f"before_{c}": F.col(f"__o_{c}") + F.col(f"__r_{c}") for c in sums}).drop(
        "__i", *[f"__{k}_{c}" for c in sums for k in ("o", "r")]
    )


def quantiles(df: DataFrame, group: list[str], value: str, points: list[float], out: str = "q_value") -> DataFrame:
    """Exact linear-interpolated quantiles per group as rows (group, q, out); NULL values are left out."""
    grouped = group or ["__all"]
    base = df if group else df.withColumn("__all", F.lit(0))
    counted = base.where(F.col(value).isNotNull()).groupBy(*grouped, value).agg(F.count(F.lit(1)).alias("n"))
    running = cumulative(counted, grouped, value, ["n"])
    # Places per group: bounded by groups x points, however long the groups are.
    spans = running.groupBy(*grouped, "__part").agg(
        F.min("before_n").alias("lo"), F.max(F.col("before_n") + F.col("n")).alias("hi"), F.max("all_n").alias("total")
    )
    qs = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("q")
    place = (F.col("total") - 1) * F.col("q")
    wanted = spans.select(*grouped, "__part", "lo", "hi", "total", qs).select(
        *grouped, "__part", "lo", "hi", "q", place.alias("h"),
        F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("at"),
    ).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    hit = (F.col("at") >= F.col("before_n")) & (F.col("at") < F.col("before_n") + F.col("n"))
    found = running.join(wanted.drop("lo", "hi"), [*grouped, "__part"]).where(hit)
    low = F.min_by(value, "at")
    high = F.max_by(value, "at")
    share = F.max(F.col("h") - F.floor("h"))
    return found.groupBy(*grouped, "q").agg((low + (high - low) * share).alias(out)).drop("__all")


def median(df: DataFrame, group: list[str], value: str, out: str = "median") -> DataFrame:
    return quantiles(df, group, value, [0.5], out).drop("q")


CHUNK_ROWS, POINTS = 65536, 256


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of a task put together until they have `CHUNK_ROWS` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def numbers(chunk: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Column `i` after the first, and which of its values are known."""
    column = chunk.column(i + 1)
    return column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy()


def _groups(chunk: pa.Table) -> list[tuple[int | None, np.ndarray]]:
    group = chunk.column(0)
    known, valid = group.fill_null(0).to_numpy(), group.is_valid().to_numpy()
    out = [(int(g), valid & (known == g)) for g in np.unique(known[valid])]
    return out + ([] if valid.all() else [(None, ~valid)])


def profile(df: DataFrame, group: str, values: dict[str, Column], nested: list[int] | None = None) -> list[dict]:
    """Per group and column: rows, known values, their sum, mean and population variance, and edges around the median.

    With `nested`, a row counts in each group of that list from its own on; else in its own only. One pass: a chunk of rows
    gives its moments and `POINTS` values in equal steps of its order per column, so an edge errs by 1 / (2 * POINTS) of the
    rows at most, and edges lie twice as far out. Groups are few, such as folds: what is collected are their numbers.
    """
    names = list(values)
    rows = df.select(F.col(group).cast("long"), *[v.cast("double").alias(f"__{i}") for i, v in enumerate(values.values())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            out: list[tuple] = []
            mine = _groups(chunk)
            for i in range(len(names)):
                x, valid = numbers(chunk, i)
                for g, here in mine:
                    v = np.sort(x[here & valid])
                    m = len(v)
                    mean = float(v.mean()) if m else 0.0
                    at = ((np.arange(min(m, POINTS)) + 0.5) * m / max(min(m, POINTS), 1)).astype(np.int64)
                    out.append((g, i, int(here.sum()), m, float(v.sum()), mean, float(np.square(v - mean).sum()), v[at]))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=heads)

    shape = "g long, i int, n long, known long, total double, mean double, apart double, points array<double>"
    heads = [x.split()[0] for x in shape.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
    parts = rows.mapInArrow(told, shape)
    if nested is not None:
        parts = parts.withColumn("g", F.explode(F.filter(F.array(*[F.lit(y).cast("long") for y in nested]), lambda y: y >= F.col("g"))))

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        known = table["known"].to_numpy()
        # Sums of sorted numbers: the order in which chunks come never shows.
        total, some = float(np.sort(table["total"].to_numpy()).sum()), known > 0
        all_known = int(known.sum())
        mean = total / all_known if all_known else None
        lo = hi = var = None
        if all_known:
            var = float(np.sort((table["apart"].to_numpy() + known * np.square(table["mean"].to_numpy() - mean))).sum() / all_known)
            points = table["points"].combine_chunks()
            sizes = points.value_lengths().to_numpy()
            value = points.flatten().to_numpy()
            order = np.argsort(value, kind="stable")
            value, upto = value[order], np.cumsum(np.repeat(known[some] / sizes[some], sizes[some])[order])
            lo, hi = (float(value[min(int(np.searchsorted(upto, all_known * q)), len(value) - 1)]) for q in (0.5 - 1 / POINTS, 0.5 + 1 / POINTS))
        facts = [key[0].as_py(), key[1].as_py(), int(table["n"].to_numpy().sum()), all_known, total, mean, var, lo, hi]
        return pa.table([pa.array([x], k) for x, k in zip(facts, facts_kinds, strict=True)], names=facts_heads)

    facts_heads = ["g", "i", "n", "known", "total", "mean", "var", "lo", "hi"]
    facts_kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 5]
    facts_shape = "g long, i int, n long, known long, total double, mean double, var double, lo double, hi double"
    return [r.asDict() | {"feature": names[r.i]} for r in parts.groupBy("g", "i").applyInArrow(merged, facts_shape).collect()]


def medians(df: DataFrame, group: str, values: dict[str, Column], nested: list[int] | None = None, facts: list[dict] | None = None) -> DataFrame:
    """Exact medians of many columns as rows (group, feature, median), without a row per value; NULLs are left out.

    One pass finds edges around each median (`facts`, see `profile`); a second one counts the values under the lower edge and
    takes out those between the edges, about a hundredth of them, which are ranked exactly. With `nested`, a row counts in
    each group of that list from its own on. `df` is read twice, or once where the facts are given.
    """
    spark, kind = df.sparkSession, df.schema[group].dataType
    known = [f for f in facts or profile(df, group, values, nested) if f["g"] is not None and f["known"]]
    edges = [(f["g"], f["i"], f["lo"], f["hi"]) for f in known]
    rows = df.where(F.col(group).isNotNull()).select(
        F.col(group).cast("long"), *[v.cast("double").alias(f"__{i}") for i, v in enumerate(values.values())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            own = chunk.column(0).to_numpy()
            columns = {i: numbers(chunk, i) for i in {e[1] for e in edges}}
            for g, i, lo, hi in edges:
                x, valid = columns[i]
                here = valid & ((own == g) if nested is None else (own <= g))
                value, n = np.unique(x[here & (x >= lo) & (x <= hi)], return_counts=True)
                under = int((here & (x < lo)).sum())
                # A row without a value has the number of values under the lower edge.
                found = pa.array([*value.tolist(), None], pa.float64())
                keys = [pa.array(np.full(len(found), k), t) for k, t in ((g, pa.int64()), (i, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*keys, found, pa.array([*n.tolist(), under], pa.int64())], names=["g", "i", "value", "n"])

    # Read for the counts and for the ranks.
    told = stored(rows.mapInArrow(near, "g long, i int, value double, n long"))
    names = F.array(*[F.lit(n) for n in values])
    keyed = told.select(F.col("g").cast(kind).alias(group), F.element_at(names, F.col("i") + 1).alias("feature"), "value", "n")
    counted = keyed.where("value IS NOT NULL").groupBy(group, "feature", "value").agg(F.sum("n").alias("n"))
    running = cumulative(counted, [group, "feature"], "value", ["n"])
    under = keyed.where("value IS NULL").groupBy(group, "feature").agg(F.sum("n").alias("under"))
    sizes = spark.createDataFrame([(f["g"], f["feature"], f["known"]) for f in known], "g long, feature string, known long")
    place = (F.col("known") - 1) / F.lit(2.0)
    wanted = sizes.withColumn(group, F.col("g").cast(kind)).join(under, [group, "feature"]).select(
        group, "feature", (place - F.floor(place)).alias("share"),
        F.explode(F.array_distinct(F.array(F.floor(place) - F.col("under"), F.ceil(place) - F.col("under")))).alias("at"))
    hit = (F.col("at") >= F.col("before_n")) & (F.col("at") < F.col("before_n") + F.col("n"))
    # Two rows at most per group and column.
    found = running.join(F.broadcast(wanted), [group, "feature"]).where(hit)
    low, high = F.min_by("value", "at"), F.max_by("value", "at")
    return found.groupBy(group, "feature").agg((low + (high - low) * F.max("share")).alias("median"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: area under the curve by average ranks, NULL when a class is absent."""
    counted = df.groupBy(score).agg(
        F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg")
    )
    running = cumulative(counted.withColumn("__all", F.lit(0)), ["__all"], score, ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    ones, zeros = F.sum("pos"), F.sum("neg")
    return running.agg((wins / F.nullif(ones * zeros, F.lit(0))).alias("auc"), (ones + zeros).alias("n"))


def fifths(df: DataFrame, score: str, key: list[str], bins: int = 5) -> DataFrame:
    """Add `bin` 0..bins-1: equal-width cuts of the first-come rank, right ends included."""
    ranked = global_row_number(df, [F.col(score), *[F.col(k) for k in key]], "__rank")
    # One aggregate row, so the cross join is a broadcast of a single value.
    total = ranked.agg(F.count(F.lit(1)).alias("__n"))
    x = (F.col("__rank") - 1) * bins / F.nullif(F.col("__n") - 1, F.lit(0))
    cut = F.greatest(F.ceil(x).cast("int") - 1, F.lit(0))
    return ranked.transform(beside, total).withColumn("bin", F.coalesce(cut, F.lit(0))).drop("__rank", "__n")
