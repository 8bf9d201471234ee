"""Scanned rows: header and cell lists, table names, payload fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

MIN_FILLED = 3


def scan_rows(tables: DataFrame) -> DataFrame:
    """Rows as maps from tables with `headers` and `cells`; rows with fewer than three filled cells are no stocks."""
    rows = tables.where((F.size("headers") > 0) & (F.size("cells") > 0)).withColumn(
        "row", text.scanned_row(F.col("headers"), F.col("cells"))
    )
    return rows.where(text.nonblank_cells(F.col("row")) >= MIN_FILLED).withColumn("symbol", F.col("row")["_symbol"])


def trusted_titles(tables: DataFrame, known: list[str], snapshot: str = "snapshot") -> DataFrame:
    """Add `title_name`: the table's title when the snapshot's titles can be trusted, else NULL.

    They can when at least one is a known name and no known name repeats.
    """
    hit = F.when(F.col("title").isin(known), F.col("title"))
    seen = tables.groupBy(snapshot).agg(F.count(hit).alias("__hits"), F.count_distinct(hit).alias("__kinds"))
    good = (F.col("__hits") > 0) & (F.col("__hits") == F.col("__kinds"))
    return tables.join(seen, snapshot).withColumns({"trusted": good, "title_name": F.when(good, hit)}).drop(
        "__hits", "__kinds"
    )


def names_by_position(tables: DataFrame, names: list[str], snapshot: str = "snapshot") -> DataFrame:
    """Add `scanner`: trusted title, else the name at the table's place when the counts agree, else the title.

    A snapshot holds a handful of tables.
    """
    place = F.row_number().over(W.partitionBy(snapshot).orderBy("position"))
    count = F.count(F.lit(1)).over(W.partitionBy(snapshot))
    listed = F.get(F.array(*[F.lit(n) for n in names]), place - 1)
    by_place = F.when(count == len(names), listed).otherwise(F.col("title"))
    return tables.withColumn("scanner", F.when(F.col("trusted"), F.col("title_name")).otherwise(by_place))


def payload_entries(payload: Column) -> Column:
    """Payload cells as an ordered array of (key, value), each key cut at its first line."""
    keys = F.json_object_keys(payload)
    cells = F.from_json(payload, "map<string,string>")
    return F.transform(
        keys,
        lambda k: F.struct(F.split(k, "\n").getItem(0).alias("key"), cells[k].alias("value")),
    )
