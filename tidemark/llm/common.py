"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back; every later branch reads that copy."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(df: DataFrame) -> DataFrame:
    """`df` with `__file` and `__row`, the place of each row in the files it is read from.

    A frame that isn't a plain read of Parquet files is written to the shared folder first,
    so that places are fixed and rows can be read again by them.
    """
    place = {"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")}
    try:
        return df.withColumns(place)
    except AnalysisException:
        return stored(df, "landed").withColumns(place)


def blank_if_null(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string"), F.lit(""))


def in_small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """`df`, whose Python tasks get at most so many rows at a time: batches of long texts stay small."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    return df
