"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Water-filling works on one row per source. Every round spreads what is left over the sources that
are not clamped, by weight, clamps those that pass their cap, and stops when none does. Only three
numbers a round reach the driver. The clamped set only grows, so the rounds end.

A source's target is met by whole repetitions of all its documents and one seeded partial repetition.
For the partial one, documents stand in the order of a seeded hash; their sizes are first summed per
hash cell (at most 4,096 a source), then per sub-cell of the one cell where the target falls, then by
document inside that sub-cell, so no source is ever sorted whole. What the cut leaves open is filled by
the largest documents that still fit, for a few rounds, and then by the seeded order again: documents that do
not fit are skipped and the cut is made anew over the others, until none of the rest fits. Only whole documents
are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import global_row_number
from .common import WORD, blank_if_null, stored

CELL = 3  # hex digits: 4,096 cells


def n_words(text: str | Column) -> Column:
    return F.regexp_count(blank_if_null(text), F.lit(WORD)).cast("long")


def seeded(seed: int, key: Column) -> Column:
    """A hash in hex digits; its order is the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add `target` to one row per source (`source_size`, `weight`)."""
    cap = F.col("source_size") * max_epochs
    sources = sources.withColumn("clamped", F.lit(False))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        row = sources.agg(
            F.sum(F.when(F.col("clamped"), cap).otherwise(0)).alias("used"), F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("open")
        ).first()
        level = (total - (row["used"] or 0)) / row["open"] if row["open"] else 0.0
        over = ~F.col("clamped") & (F.lit(level) * F.col("weight") > cap)
        more = stored(sources.withColumn("clamped", F.col("clamped") | over), "mix-sources") if sources.where(over).limit(1).count() else None
        if more is None:
            return sources.withColumn("target", F.when(F.col("clamped"), cap.cast("double")).otherwise(F.lit(level) * F.col("weight")))
        sources = more


def weigh(docs: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source with its size and weight: weights repeat over the sources by code point, NULL last."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_number(sizes, [F.col("source").asc_nulls_last()], "place")
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, fill_rounds: int = 3,
) -> DataFrame:
    """Per row of `docs`: id, source, size, source_size, target, whole (repetitions all rows get), extra (0 or 1).

    Size is the number of words; NULL text has 0. A NULL source is a source of its own, a source without words
    has target 0, an empty table gives an empty result. Rows that share id, source and size fall together on the
    same side of the cut. Reruns with one seed agree. Other columns are ignored.
    """
    rows = stored(
        docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words(text).alias("size"), seeded(seed, F.col(key)).alias("h")), "mix-rows"
    )
    goals = water_fill(stored(weigh(rows, weights), "mix-weights"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    goals = goals.withColumn("whole", whole.cast("long")).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = stored(goals.select("source", "source_size", "target", "whole", "goal"), "mix-goals")
    same = lambda other: F.col("r.source").eqNullSafe(other["source"])
    r = rows.alias("r")

    def split(part: DataFrame, at: int, name: str) -> DataFrame:
        """For each source the words before the cell where its goal falls, `before`, and that cell, `name`."""
        cell = F.substring("h", at, CELL).alias(name)
        sums = part.groupBy("source", "goal", "before", cell).agg(F.sum("size").alias("n"))
        running = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy(name).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = sums.withColumn("before", F.col("before") + running).where(F.col("before") + F.col("n") > F.col("goal"))
        return placed.groupBy("source").agg(F.min(F.struct(name, "before")).alias("c")).select("source", f"c.{name}", "c.before")

    def seeded_cut(part: DataFrame, goals: DataFrame) -> DataFrame:
        """`goals` with the last hash of the seeded order whose words, from the start of `part`, stay within the goal, and these words."""
        r = part.alias("r")
        base = r.join(goals.alias("g"), same(goals)).select("r.*", "goal", F.lit(0).cast("long").alias("before"))
        first = stored(split(base, 1, "cell"), "mix-cells")
        inside = r.join(first.alias("f"), same(first) & (F.substring("h", 1, CELL) == F.col("cell"))).select("r.*", "cell", "before")
        inside = inside.alias("r").join(goals.alias("g"), same(goals)).select("r.*", "goal")
        second = stored(split(inside, 1 + CELL, "sub"), "mix-subcells")
        last = inside.drop("before").alias("r").join(second.alias("s"), same(second) & (F.substring("h", 1 + CELL, CELL) == F.col("sub"))).select("r.*", "sub", "before")
        # Ties count as one step: the range frame takes rows of one hash together.
        reached = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("h").rangeBetween(W.unboundedPreceding, 0))
        fits = last.withColumn("sum", reached).where(F.col("sum") <= F.col("goal"))
        cut = fits.groupBy("source").agg(F.max("h").alias("cut_h"), F.max("sum").alias("sum"))
        bounds = goals.alias("r").join(second.alias("s"), same(second), "left").join(first.alias("f"), same(first), "left").select(
            "r.*", "cell", "sub", F.col("s.before").alias("before")
        )
        bounds = bounds.alias("r").join(cut.alias("c"), same(cut), "left").select("r.*", "cell", "sub", "cut_h", F.coalesce("sum", "before").alias("got"))
        # Rows below the sub-cell are in; inside it up to the cut. A source whose goal is never passed takes all.
        bounds = bounds.withColumn("cut", F.coalesce(F.col("cut_h"), F.concat("cell", "sub"), F.lit("g"))).withColumn("got", F.coalesce("got", "source_size"))
        return stored(bounds.select(*goals.columns, "cut", "got"), "mix-bounds")

    bounds = seeded_cut(rows, goals)
    placed = r.join(bounds.alias("b"), same(bounds)).select("r.*", "source_size", "target", "whole", "goal", "cut")
    placed = placed.withColumn("extra", F.when((F.col("h") <= F.col("cut")) & (F.col("whole") < max_epochs), 1).otherwise(0))
    gap = stored(bounds.select("source", (F.col("goal") - F.col("got")).alias("gap")), "mix-gap")
    # Rows of one hash are taken together, so all of them must fit.
    rest = placed.where(F.col("extra") == 0).groupBy("source", "h").agg(F.sum("size").alias("size")).where("size > 0")

    def fitting(rest: DataFrame, gap: DataFrame) -> DataFrame:
        return rest.alias("r").join(gap.alias("g"), same(gap)).where(F.col("size") <= F.col("gap")).select("r.source", "r.h", "r.size", "gap")

    def less(gap: DataFrame, got: DataFrame) -> DataFrame:
        now = gap.alias("r").join(got.alias("a"), same(got), "left").select("r.source", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap"))
        return stored(now, "mix-gap")

    rest = stored(fitting(rest, gap).drop("gap"), "mix-rest")
    picks = rows.sparkSession.createDataFrame([], rows.select("source", "h").schema)
    for _ in range(fill_rounds):
        best = fitting(rest, gap).groupBy("source").agg(F.max(F.struct("size", "h")).alias("m"))
        best = stored(best.select("source", "m.h", F.col("m.size").alias("got")), "mix-picked")
        picks = picks.unionByName(best.select("source", "h"))
        gap = less(gap, best)
        rest = rest.alias("r").join(best.alias("p"), same(best) & (F.col("r.h") == F.col("p.h")), "left_anti")
    while True:
        # The first of what fits is always taken, so the rounds end.
        rest = stored(fitting(rest, gap), "mix-rest")
        if rest.isEmpty():
            break
        bounds = seeded_cut(rest.drop("gap"), rest.groupBy("source").agg(F.max("gap").alias("goal"), F.sum("size").alias("source_size")))
        judged = rest.alias("r").join(bounds.alias("b"), same(bounds)).select("r.source", "r.h", "r.size", "cut")
        picks = picks.unionByName(judged.where("h <= cut").select("source", "h"))
        gap = less(gap, bounds.select("source", "got"))
        rest = judged.where("h > cut").drop("cut")
    picked = picks.withColumn("picked", F.lit(1))
    done = placed.alias("r").join(picked.alias("p"), same(picked) & (F.col("r.h") == F.col("p.h")), "left").select("r.*", "picked")
    return done.withColumn("extra", F.greatest("extra", F.coalesce("picked", F.lit(0)))).drop("h", "goal", "cut", "picked")


def repeated(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of the mix with the columns of `docs`, each as often as the mix takes it."""
    mixed = mix(docs, key, **options)
    # Rows that share an id, source and size have one decision, so one row per id and source tells it.
    times = mixed.groupBy("id", "source", "size").agg(F.max(F.col("whole") + F.col("extra")).alias("__times"))
    source, text = options.get("source", "source"), options.get("text", "text")
    d, t = docs.withColumn("__size", n_words(text)).alias("d"), times.alias("t")
    on = F.col(f"d.{key}").eqNullSafe(F.col("t.id")) & F.col(f"d.{source}").eqNullSafe(F.col("t.source")) & (F.col("__size") == F.col("t.size"))
    joined = d.join(t, on).select("d.*", "__times").where("__times > 0")
    return joined.withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)
