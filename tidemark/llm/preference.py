"""Preference formatting: one prompt and two masked completions for a pair of conversations.

The prompt of a pair is the longest common prefix of turns (role and text) of its chosen and rejected
conversation; each completion is what follows. Work stays on single turns: a pair's turns meet by position, the first
place where they differ is one partial aggregation, and the result has a row per rendered turn. So no conversation
is gathered in one row or task, however long it is. Segments of one pair and side, in order, give the rendered text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import global_row_number
from .common import blank_if_null, stored

TEMPLATE = "<|{role}|>\n{text}\n"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): `at` orders a conversation's turns.

    Rows repeated in full count once. Several rows of one turn stand in order of role and text; a NULL turn comes last,
    NULL role and text count as empty. Rows without conv_id belong to no conversation and are left out.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(2**62)).alias("turn"), blank_if_null("role").alias("role"), blank_if_null("text").alias("text")
    ).distinct()
    alike = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return rows.select("conv_id", F.struct("turn", alike.alias("nth")).alias("at"), "role", "text")


def paired(rows: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): each conversation in one pair, those with the same first turn side by side.

    Conversations are numbered by first turn and id without one sorting task and taken two by two. The one with
    more assistant text is chosen, in a tie the one that comes first. An odd last one has no rejected partner.
    """
    answer = F.when(F.col("role") == "assistant", F.char_length("text")).otherwise(0)
    heads = rows.groupBy("conv_id").agg(F.min(F.struct("at", "role", "text")).alias("first"), F.sum(answer).alias("said"))
    ranked = global_row_number(heads.select("conv_id", "said", "first.role", "first.text"), [F.col("text"), F.col("role"), F.col("conv_id")], "place")
    best = F.max(F.struct("said", (-F.col("place")).alias("before"), "conv_id")).alias("c")
    worst = F.min(F.struct("said", (-F.col("place")).alias("before"), "conv_id")).alias("r")
    pairs = ranked.groupBy(F.floor((F.col("place") - 1) / 2).alias("pair_id")).agg(best, worst, F.count(F.lit(1)).alias("n"))
    return pairs.select("pair_id", F.col("c.conv_id").alias("chosen_id"), F.when(F.col("n") > 1, F.col("r.conv_id")).alias("rejected_id"))


def formatted(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Segments of all pairs: pair_id, chosen_id, rejected_id, side (prompt, chosen, rejected), turn, nth, role, segment, loss.

    `segment` is the rendered turn. `loss` tells whether it is trained on: assistant turns of a completion. A prompt
    is rendered once. Pairs without common prefix have no prompt; a conversation that is a prefix of the other has no
    completion of its own; a missing rejected conversation leaves the chosen one as completion. No turns, no segments.
    """
    ids = F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv_id")))
    sides = pairs.select("pair_id", F.explode(ids).alias("s")).select("pair_id", "s.side", "s.conv_id").where("conv_id is not null")
    both = stored(rows.join(sides, "conv_id"), "preference-turns")
    met = both.groupBy("pair_id", "at", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    differ = met.where("n = 1").groupBy("pair_id").agg(F.min("at").alias("cut"))
    marked = both.join(differ, "pair_id", "left").withColumn("common", F.col("cut").isNull() | (F.col("at") < F.col("cut")))
    shown = marked.where(~F.col("common") | (F.col("side") == "chosen"))
    side = F.when(F.col("common"), "prompt").otherwise(F.col("side"))
    head, rest = TEMPLATE.split("{role}")
    mid, tail = rest.split("{text}")
    segment = F.concat(F.lit(head), "role", F.lit(mid), "text", F.lit(tail))
    out = shown.select(
        "pair_id", side.alias("side"), F.col("at.turn").alias("turn"), F.col("at.nth").alias("nth"), "role", segment.alias("segment"),
        (~F.col("common") & (F.col("role") == "assistant")).alias("loss"),
    )
    return out.join(pairs, "pair_id").select("pair_id", "chosen_id", "rejected_id", *out.columns[1:])
