"""Landed files: hit exports, company exports, bars, calendars, statements and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import bars as bar_ops
from ..operators.keys import latest_values

BOM = "﻿"


def _without_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip(BOM).strip('"') for c in df.columns])


def _own_headers(spark: SparkSession, files: str, known: str) -> DataFrame:
    """Cells of CSV files that have headers of their own: `__file` (its name), `names`, `cells`.

    A header is a line that holds the column name `known`; the number of columns of the widest one is read first.
    """
    is_name = rf'(?:^|,)\x{{FEFF}}?"?{known}"?(?:,|$)'
    lines = spark.read.text(files).where(F.rtrim("value").rlike(is_name))
    width = lines.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.schema(schema).csv(files)
    cells = F.transform(F.array(*raw.columns), lambda c: F.regexp_replace(c, r"^\x{FEFF}", ""))
    rows = raw.select(F.col("_metadata.file_name").alias("__file"), cells.alias("cells"))
    is_header = F.exists("cells", lambda c: F.trim(c) == known)
    heads = rows.where(is_header).groupBy("__file").agg(F.max(F.transform("cells", F.trim)).alias("names"))
    return rows.where(~F.coalesce(is_header, F.lit(False))).join(heads, "__file")


def _column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def hit_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of every CSV in a folder; the scanner is the file's stem. Each file has its own header, missing columns are blank."""
    rows = _own_headers(spark, f"{folder}/*.csv", "Symbol")
    stem = F.regexp_extract("__file", r"(.*)\.[^.]*$", 1)

    def cell(name: str) -> Column:
        return F.get("cells", F.nullif(F.array_position("names", F.lit(name)), F.lit(0)).cast("int") - 1)

    return rows.select(
        F.url_decode(F.regexp_replace(stem, r"\+", "%2B")).alias("scanner"),
        text.clean_code(cell("Symbol")).alias("symbol"),
        dates.day_month_year(cell("Date")).alias("hit_date"),
        text.text_or_blank(cell("Marketcapname")).alias("tier"),
        text.text_or_blank(cell("Sector")).alias("sector"),
        F.lit("backtest").alias("source"),
    )


def newest_entry(spark: SparkSession, folder: str, ending: str = ".csv") -> str | None:
    """The lexicographically last file or folder of exports with an ending; only the listing is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
    return max((n for n in names if n.endswith(ending)), default=None)


def newest_file_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows of the last CSV export of a folder, with `__file`, `__asof` and arrival place `__row`; None without any.

    An export is a file, or a folder of part files as Spark writes it. Older exports are not opened.
    """
    newest = newest_entry(spark, folder)
    if newest is None:
        return None
    rows = spark.read.option("header", True).csv(f"{folder}/{newest}").withColumns(
        {
            "__file": F.lit(newest),
            "__asof": asof_of(F.lit(newest), F.col("_metadata.file_modification_time")),
            "__row": F.struct(
                F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")
            ),
        }
    )
    return _without_bom(rows)


def asof_of(file_name: Column, modified: Column) -> Column:
    """Day of an export: the first ten characters of its name when they are a date, else its modification day."""
    stamped = F.try_to_date(F.substring(file_name, 1, 10), "yyyy-MM-dd")
    return F.coalesce(stamped, F.to_date(modified))


def rows_by_code(rows: DataFrame, code_columns: list[str], order: list[str]) -> DataFrame:
    """Rows keyed by each of their codes; the last row of a code stays."""
    codes = F.array_distinct(F.array(*[text.clean_code(_column(rows, c)) for c in code_columns]))
    each = rows.withColumn("code", F.explode(F.filter(codes, lambda c: c.isNotNull() & (c != ""))))
    values = [c for c in rows.columns if c not in order]
    return latest_values(each, ["code"], order, values)


def bar_table(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars landed as Parquet, cleaned and numbered."""
    return bar_ops.numbered(bar_ops.clean(spark.read.parquet(path)))


def event_calendar(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Event calendar from JSON arrays, one document a file or one array a line; rows whose date does not parse are dropped."""
    schema = "scrip_Code string, short_name string, Long_Name string, meeting_date string"
    raw = spark.read.schema(schema).option("multiLine", one_document).json(path)
    return raw.select(
        F.trim("scrip_Code").alias("code"), text.clean_code(F.col("short_name")).alias("short_name"),
        F.col("Long_Name").alias("name"), dates.long_date(F.col("meeting_date")).alias("meeting_date"),
    ).where(F.col("meeting_date").isNotNull())


def statement_fields(statements: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """One row per symbol with an array of values per field, newest first, in one pass over the statements.

    `statements`: symbol, label, period_rank (0 = newest), value; a label has a handful of periods. A line belongs to
    every field that lists its label; per field the earliest listed label that the symbol has counts.
    """
    roles = {}
    for field, labels in wanted.items():
        for i, label in enumerate(labels):
            roles.setdefault(label, []).append(F.struct(F.lit(field).alias("field"), F.lit(i).alias("rank")))
    named = F.lit(None).cast("array<struct<field:string,rank:int>>")
    for label, pairs in roles.items():
        named = F.when(F.col("label") == label, F.array(*pairs)).otherwise(named)
    lines = statements.select("symbol", "period_rank", "value", F.explode(named).alias("r")).select("symbol", "period_rank", "value", "r.*")
    ordered = F.array_sort(F.collect_list(F.struct("period_rank", "value")))
    series = lines.groupBy("symbol", "field", "rank").agg(F.transform(ordered, lambda s: s["value"]).alias("values"))
    best = [F.min_by(F.when(F.col("field") == f, F.col("values")), F.when(F.col("field") == f, F.col("rank"))).alias(f) for f in wanted]
    return statements.select("symbol").distinct().join(series.groupBy("symbol").agg(*best), "symbol", "left")


MODEL_SCHEMA = (
    "`on` boolean, trained_at string, trained_on bigint, features array<string>, "
    "params struct<median:array<double>, mean:array<double>, std:array<double>, coef:array<double>, intercept:double>, "
    "quantiles array<double>"
)


def model_file(spark: SparkSession, path: str) -> DataFrame:
    """A stored model as one row; no row when the file is absent or does not parse."""
    try:
        raw = spark.read.schema(MODEL_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], MODEL_SCHEMA)
        raise
    return raw.where(F.col("params").isNotNull())
