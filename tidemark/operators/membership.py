"""Snapshot diffs: who joined a scanner, who came back, and half-read snapshots.

Members are compared row by row on (scanner, symbol); no member set is ever collected.
Tables of runs hold one row per scanner and run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import cut


def of_scanner() -> WindowSpec:
    """A scanner's runs in order."""
    return W.partitionBy("scanner").orderBy("run")


def scanner_runs(members: DataFrame) -> DataFrame:
    """Runs that hold rows for a scanner, with the run before and their place from the first and the last."""
    runs = members.groupBy("scanner", "run").agg(F.min("run_at").alias("run_at"))
    return runs.withColumns(
        {
            "prev_run": F.lag("run").over(of_scanner()),
            "place": F.row_number().over(of_scanner()),
            "from_end": F.row_number().over(W.partitionBy("scanner").orderBy(F.desc("run"))),
        }
    )


def entries(members: DataFrame) -> DataFrame:
    """New members of each run against the scanner's previous run; the first run only seeds.

    `fresh` was never seen on the scanner before, `retest` was and had dropped out.
    """
    runs = scanner_runs(members).select("scanner", "run", "prev_run")
    seen = F.lag("run").over(W.partitionBy("scanner", "symbol").orderBy("run"))
    joined = members.withColumn("last_seen", seen).join(runs, ["scanner", "run"])
    absent = F.col("last_seen").isNull() | (F.col("last_seen") < F.col("prev_run"))
    kind = F.when(F.col("last_seen").isNull(), "fresh").otherwise("retest")
    return joined.where(F.col("prev_run").isNotNull() & absent).withColumn("kind", kind)


def partial_reads(members: DataFrame, max_gap_hours: float = 2.0) -> DataFrame:
    """Half-read runs of each scanner: (scanner, run, base_run, next_run).

    Run i is half-read when it is a strict part of its base, the next run has all that was
    missing, and follows soon. The base is the run before, or that run's own base when it
    was half-read itself. Rounds repeat only for runs whose base moved, and end after the
    longest chain; the table of decisions has one row per scanner and run.
    """
    members = cut(members.select("scanner", "run", "run_at", "symbol"))
    runs = scanner_runs(members)
    gap = (F.unix_timestamp(F.lead("run_at").over(of_scanner())) - F.unix_timestamp("run_at")) / 3600.0
    state = cut(
        runs.select(
            "scanner", "run", F.lead("run").over(of_scanner()).alias("next_run"), gap.alias("gap"),
            F.lag("run").over(of_scanner()).alias("base_run"), F.lit(True).alias("open"), F.lit(False).alias("half"),
        )
    )
    while True:
        asked = state.where(
            F.col("open") & F.col("base_run").isNotNull() & F.col("next_run").isNotNull() & (F.col("gap") <= max_gap_hours)
        )
        roles = asked.select(
            "scanner", F.col("run").alias("case_run"),
            F.explode(
                F.array(
                    F.struct(F.col("base_run").alias("run"), F.lit("a").alias("role")),
                    F.struct(F.col("run").alias("run"), F.lit("b").alias("role")),
                    F.struct(F.col("next_run").alias("run"), F.lit("c").alias("role")),
                )
            ).alias("r"),
        ).select("scanner", "case_run", "r.run", "r.role")
        has = {r: F.max((F.col("role") == r).cast("int")).alias(r) for r in "abc"}
        per_symbol = members.select("scanner", "run", "symbol").join(roles, ["scanner", "run"]).groupBy(
            "scanner", "case_run", "symbol"
        ).agg(*has.values())
        verdict = per_symbol.groupBy("scanner", F.col("case_run").alias("run")).agg(
            (
                (F.sum(F.when((F.col("b") == 1) & (F.col("a") == 0), 1).otherwise(0)) == 0)
                & (F.sum(F.when((F.col("a") == 1) & (F.col("b") == 0), 1).otherwise(0)) > 0)
                & (F.sum(F.when((F.col("a") == 1) & (F.col("b") == 0) & (F.col("c") == 0), 1).otherwise(0)) == 0)
            ).alias("verdict")
        )
        decided = state.join(verdict, ["scanner", "run"], "left").withColumn(
            "half", F.when(F.col("open"), F.coalesce("verdict", F.lit(False))).otherwise(F.col("half"))
        )
        whole = F.last(F.when(~F.col("half"), F.col("run")), ignorenulls=True).over(
            of_scanner().rowsBetween(W.unboundedPreceding, -1)
        )
        moved = decided.withColumn("__base", whole).withColumn("open", ~F.col("__base").eqNullSafe(F.col("base_run")))
        state = cut(
            moved.select("scanner", "run", "next_run", "gap", F.col("__base").alias("base_run"), "open", "half")
        )
        if state.where("open").isEmpty():
            break
    return state.where("half").select("scanner", "run", "base_run", "next_run")


def repaired(members: DataFrame, partial: DataFrame) -> DataFrame:
    """Members without the rows of half-read runs."""
    return members.join(partial.select("scanner", "run"), ["scanner", "run"], "left_anti")


def false_entries(members: DataFrame, partial: DataFrame) -> DataFrame:
    """Entries to retract: members of the next run that were in the base but missing from a half-read run."""
    def of(column: str) -> DataFrame:
        cases = partial.select("scanner", F.col(column).alias("run"), F.col("run").alias("case_run"))
        return members.join(cases, ["scanner", "run"]).select("scanner", "case_run", "symbol")

    gone = of("base_run").join(of("run"), ["scanner", "case_run", "symbol"], "left_anti")
    named = gone.join(partial.select("scanner", F.col("run").alias("case_run"), "next_run"), ["scanner", "case_run"])
    return named.select("scanner", F.col("next_run").alias("run"), "symbol")
