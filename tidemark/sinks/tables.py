"""Table writes: append, partition replace, guarded replace, exports, ledgers and versioned upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..functions.numbers import finite
from ..operators.keys import earliest_values, latest_values, mirror_changes
from ..session import cut


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def subfolders(spark: SparkSession, path: str) -> list[int]:
    """Numbers that the folders of a path carry, `7` or `version=7`, in order; none where the path is not there."""
    if not exists(spark, path):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName().split("=")[-1] for f in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop) if f.isDirectory()]
    return sorted(int(n) for n in names if n.isdigit())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of one's own, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def append(rows: DataFrame, path: str) -> None:
    """Append events, one file set per call."""
    rows.write.mode("append").parquet(path)


def append_new(rows: DataFrame, path: str, key: list[str], order: list[str]) -> DataFrame:
    """Append the first row per key, for keys the table does not hold. Returns what was appended."""
    spark = rows.sparkSession
    values = [c for c in rows.columns if c not in key]
    fresh = earliest_values(rows, key, order, values)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    fixed = cut(fresh)
    fixed.write.mode("append").parquet(path)
    return fixed


def mirror(wanted: DataFrame, path: str, key: list[str], partition: str) -> DataFrame:
    """Make the partitions of `wanted` equal to it; other partitions stay. Returns counts of changes."""
    spark = wanted.sparkSession
    fixed = cut(wanted)
    if exists(spark, path):
        parts = fixed.select(partition).distinct()
        old = spark.read.parquet(path).join(parts, partition, "left_semi")
        full = [partition, *[k for k in key if k != partition]]
        changes = cut(mirror_changes(old, fixed, full).groupBy(partition, "change").agg(F.count(F.lit(1)).alias("n")))
    else:
        changes = fixed.groupBy(partition).agg(F.count(F.lit(1)).alias("n")).select(partition, F.lit("insert").alias("change"), "n")
    fixed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return changes


def replace_if_filled(rows: DataFrame, path: str, now: Column, hours: int = 12) -> bool:
    """Replace a table when rows arrived and the stored ones are old enough. Rows carry `fetched_at`."""
    spark = rows.sparkSession
    if exists(spark, path):
        age = spark.read.parquet(path).agg(
            ((F.unix_timestamp(now) - F.unix_timestamp(F.max("fetched_at"))) / 3600).alias("h")
        ).first()["h"]
        if age is not None and age < hours:
            return False
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def clean_numbers(rows: DataFrame) -> DataFrame:
    """NaN and infinite numbers to NULL in every floating column."""
    floats = [f.name for f in rows.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return rows.withColumns({c: finite(F.col(c)) for c in floats})


def export_json(rows: DataFrame, path: str) -> None:
    """Nested rows as JSON lines without NaN or infinity; NULL fields are written as null."""
    clean_numbers(rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def mark_once(keys: DataFrame, path: str, key: str) -> DataFrame:
    """Mark keys done and return those not marked before."""
    return append_new(keys.select(key).distinct(), path, [key], [])


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns added later: absent or NULL takes the default."""
    return rows.withColumns(
        {c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()}
    )


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Versions of a bucketed table, oldest first."""
    return [v for v in subfolders(spark, f"{path}/manifest") if exists(spark, f"{path}/manifest/{v}/_SUCCESS")]


def bucket_folders(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """Bucket -> version that last wrote it, of the newest version or of the newest up to `version`. One entry per bucket."""
    known = [v for v in _manifests(spark, path) if version is None or v <= version]
    if not known:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version int").parquet(f"{path}/manifest/{known[-1]}").collect()}


def _folder(path: str, bucket: int, version: int) -> str:
    return f"{path}/data/version={version}/bucket={bucket}"


def read_buckets(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest version of a bucketed table; no rows where nothing was written."""
    held = [_folder(path, b, v) for b, v in bucket_folders(spark, path).items()]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def merge_buckets(updates: DataFrame, path: str, version: int, key: list[str], order: list[str], buckets: int = 16) -> None:
    """Write the next version of a keyed table laid out by hash of its key: per key the row with the greatest `order` stays.

    Only buckets that `updates` meet are read and written, each into a folder of this version; the manifest, one row per
    bucket, names every bucket's newest folder and is written last. A repeated version starts from the same predecessor
    and writes the same folders. Folders that neither this manifest nor the one before names are removed.
    """
    spark = updates.sparkSession
    earlier = bucket_folders(spark, path, version - 1)
    placed = cut(updates.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
    met = [r["bucket"] for r in placed.select("bucket").distinct().collect()]
    if met:
        old = [_folder(path, b, earlier[b]) for b in met if b in earlier]
        shape = StructType([f for f in placed.schema if f.name != "bucket"])
        rows = placed
        if old:
            stored = spark.read.schema(shape).parquet(*old)
            rows = rows.unionByName(stored.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        values = [c for c in updates.columns if c not in key]
        # Rows of a bucket meet in one task each, so that a bucket is one file, and a key's rows are aggregated there.
        merged = latest_values(rows.repartition(min(buckets, len(met)), "bucket"), ["bucket", *key], order, values)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    now = earlier | {b: version for b in met}
    spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version}")
    for v in [v for v in _manifests(spark, path) if v < version][:-1]:
        for bucket, written in bucket_folders(spark, path, v).items():
            if written not in (earlier.get(bucket), now.get(bucket)):
                remove(spark, _folder(path, bucket, written))
        remove(spark, f"{path}/manifest/{v}")
